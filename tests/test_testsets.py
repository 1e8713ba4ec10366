"""Headline packing, splitters in SQL, links between chunks, test sets, points of global search: against plain Python."""

import json
import os
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica import catalogue, providers
from lattica.functions import text
from lattica.operators import retrieval
from lattica.plans import testsets

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]


def packed(t, least, most):
    """Word by word: (section, word) goes to the open chunk; a section's end closes it from `least` words on."""
    section, flat = 0, []
    heads = {0: None}
    for line in (t or "").split("\n"):
        if line.strip() and re.match(text.HEADLINE, line):
            section += 1
            heads[section] = line.strip()
        flat += [(section, w) for w in words(line)]
    out, held = [], []
    for i, (s, w) in enumerate(flat):
        held.append((s, w))
        if len(held) == most or (len(held) >= least and (i + 1 == len(flat) or flat[i + 1][0] != s)):
            out.append(held)
            held = []
    if held:
        if out and len(held) < least and len(out[-1]) + len(held) <= most:
            out[-1] = out[-1] + held
        else:
            out.append(held)
    return [(heads[c[0][0]], " ".join(w for _, w in c), len(c)) for c in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# Head", "Short line", "a b c d e f.", "x.", "", " ", "one two three four five six seven eight nine."]), max_size=25), st.integers(1, 9), st.integers(0, 9))
def test_packing(lines, least, more):
    t = "\n".join(lines)
    got = text.pack_sections(t, least, least + more)
    assert got == packed(t, least, least + more)
    assert " ".join(c for _, c, _ in got).split() == t.split()
    assert all(n <= least + more for _, _, n in got) and all(n >= least for _, _, n in got[:-1])


@needs_tables
def test_headline_chunks_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r.doc_id, i, *p) for r in docs.collect() for i, p in enumerate(packed(r.text, 100, 500))}
    assert {tuple(r) for r in text.chunk_by_headlines(docs).collect()} == want
    with pytest.raises(ValueError):
        text.chunk_by_headlines(docs, 10, 5)


@needs_tables
def test_table_function_splits_like_the_splitters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    text.register_split_function(spark)
    for kind in ("token", "sentence", "structure"):
        got = spark.sql("select doc_id, chunk_id, chunk from {d}, lateral split_text(text, '" + kind + "', 60, 7)", d=docs)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, text.chunk(docs, kind, 60, 7).collect()))
    with pytest.raises(Exception, match="unknown splitter"):
        spark.sql("select * from {d}, lateral split_text(text, 'other', 60, 7)", d=docs).collect()


@needs_tables
def test_linked_chunks(spark, monkeypatch):
    monkeypatch.setattr(testsets, "SHARD", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    phrases = text.keyphrases(docs, 8, "id").select("id", "term")
    sets = defaultdict(set)
    for r in phrases.collect():
        sets[r.id].add(r.term)
    links = {(r.a, r.b): r.shared for r in testsets.shared_links(docs, phrases).collect()}
    assert links and all(a < b and n == len(sets[a] & sets[b]) >= 2 for (a, b), n in links.items())
    # with a partner for every place in the order nothing is left to chance
    monkeypatch.setattr(testsets, "SHARD", 10_000)
    whole = {(r.a, r.b) for r in testsets.shared_links(docs, phrases, fan=len(sets)).collect()}
    assert whole == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2} >= set(links)
    groups = [(r.a, r.b) for r in testsets.multi_hop_groups(testsets.shared_links(docs, phrases)).collect()]
    assert set(groups) <= set(links) and len(groups) == len(set(groups))
    assert 0 < max(Counter(x for g in groups for x in g).values()) <= 2
    assert groups == [(r.a, r.b) for r in testsets.multi_hop_groups(testsets.shared_links(docs, phrases)).collect()] or set(groups) == {(r.a, r.b) for r in testsets.multi_hop_groups(testsets.shared_links(docs, phrases)).collect()}
    # the questions: at most two for a chunk and for a group, and only what the critic passes
    writer, judge = providers.get("questions-offline", questions=3), providers.get("judge-offline")
    made = testsets.question_set(docs, spark.createDataFrame(groups, "a long, b long"), writer, judge, 8.0).collect()
    given = {r.id: r.text for r in docs.collect()}
    want = Counter()
    for ids in [(i,) for i in given] + groups:
        whole = " ".join(given[i] for i in ids)
        for q in json.loads(writer.call([whole])[0])["qa"][:2]:
            verdict = json.loads(judge.call([json.dumps({"question": q["question"], "truth": whole, "answer": q["answer"], "contexts": [whole]})])[0])
            if verdict["answer_correctness"]["score"] >= 8.0:
                want[len(ids), tuple(map(str, ids)), q["question"], q["answer"]] += 1
    assert Counter((r.hops, tuple(r.contexts), r.input, r.expected_output) for r in made) == want
    few = testsets.question_set(docs, spark.createDataFrame(groups, "a long, b long"), writer, judge, 8.0, size=8).collect()
    assert len(few) == min(8, len(made)) and set(map(str, few)) <= set(map(str, made))


def test_similar_links_and_splits(spark):
    v = [[1.0, 0.0], [0.99, 0.141067], [0.0, 1.0], [-1.0, 0.0]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "item_id long, vec array<double>")
    assert {(r.a, r.b) for r in testsets.similar_links(rows).collect()} == {(0, 1)}
    n = Counter(r.s for r in spark.range(4000).select(testsets.split_of(F.col("id")).alias("s")).collect())
    assert 3000 < n["train"] < 3400 and 300 < n["test"] < 500 and 300 < n["validation"] < 500


@needs_tables
def test_points_come_from_many_batches(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.size(text.words(F.col("text"))).alias("tokens"))
    points = retrieval.global_search(d, lambda c: F.regexp_count(c, F.lit(r"\bthe\b")), 2000, 400)
    rows = points.collect()
    assert len({r.batch for r in rows}) > 2 and max(r.running for r in rows) <= 400
    batches = {r.id: f"{r.shard}/{r.batch}" for r in retrieval.token_batches(d, 2000, "id").collect()}
    assert all(batches[r.id] == r.batch and r.score == len(re.findall(r"\bthe\b", r.point)) for r in rows)
    best = retrieval.reduced(points).first()
    assert best.points == len(rows) and best.context.startswith(min(rows, key=lambda r: (-r.score, r.id, r.pos)).point)


def test_drift_ends_when_nothing_is_new(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (3, 1, 2), (8, 9, 3)], "src long, dst long, eid long")
    start = spark.createDataFrame([(1,)], "id long")
    mentions = spark.createDataFrame([("c1", 1), ("c2", 2), ("c2", 3), ("c9", 9)], "chunk_id string, entity long")
    community = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, community long")
    reports = spark.createDataFrame([(5, "five"), (6, "six")], "community long, report string")
    got = sorted(map(tuple, retrieval.drift_search(start, edges, mentions, community, reports, 9, 10).collect()))
    assert got == [(0, "chunk", "c1", 1), (0, "report", "five", 1), (1, "chunk", "c2", 2), (1, "report", "five", 1), (1, "report", "six", 1)]
    one = retrieval.drift_search(start, edges, mentions, community, reports, 9, 1).where("kind = 'chunk'").collect()
    assert sorted(map(tuple, one)) == [(0, "chunk", "c1", 1), (1, "chunk", "c2", 1), (2, "chunk", "c2", 1)]
    assert catalogue.SQL["drift_search"]
