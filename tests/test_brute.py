"""Queries without SQL, over the whole smallest tables, against plain Python."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lattica import catalogue, providers
from lattica.operators import algorithms, retrieval
from lattica.plans import rag

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def windows(text, size, overlap):
    t = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    return [" ".join(t[s : s + size]) for s in range(0, max(len(t) - overlap - 1, 0) + 1, size - overlap)] if t else []


def co_bought(spark):
    parts = defaultdict(set)
    for order, part in table(spark, "lineitem", "l_orderkey", "l_partkey"):
        parts[order].add(part)
    return {(a, b) for p in parts.values() for a in p for b in p if a < b}


def modularity(pairs, community):
    inside, ends = 0, Counter()
    for a, b in pairs:
        inside += community[a] == community[b]
        ends[community[a]] += 1
        ends[community[b]] += 1
    return inside / len(pairs) - sum((n / (2 * len(pairs))) ** 2 for n in ends.values())


def parts_of(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_louvain_and_refined_communities(spark):
    pairs = co_bought(spark)
    nodes = {n for p in pairs for n in p}
    found, scores = algorithms.louvain(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    community = {r.id: r.community for r in found.collect()}
    assert set(community) == nodes and scores == sorted(scores)
    assert modularity(pairs, community) == pytest.approx(scores[-1])
    assert scores[-1] > max(0.0, modularity(pairs, {n: n for n in nodes}))
    members, better = algorithms.leiden(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    rows = {r.id: [*r.levels] for r in members.collect()}
    assert set(rows) == nodes and better == sorted(better) and better[-1] >= scores[-1]
    assert modularity(pairs, {n: v[-1] for n, v in rows.items()}) == pytest.approx(better[-1])
    for k in range(len(next(iter(rows.values())))):
        group = {n: v[k] for n, v in rows.items()}
        parts = parts_of(nodes, [(a, b) for a, b in pairs if group[a] == group[b]])
        assert len(set(parts.values())) == len(set(group.values()))  # every group of every level is connected
        if k:
            assert len({(v[k - 1], v[k]) for v in rows.values()}) == len({v[k - 1] for v in rows.values()})  # and lies within one of the next
    assert {r.id: r.community for r in members.collect()} == {n: v[-1] for n, v in rows.items()}


def test_leiden_takes_a_loose_community_apart(spark):
    """Two cliques that only one node held together, given as one community, are two after it has left."""
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    e = spark.createDataFrame(clique(range(5)) + clique(range(10, 15)) + clique(range(20, 26)) + [(0, 20), (10, 21)], "src long, dst long")
    level = algorithms._Level(algorithms._weighted(e))
    loose = level.ids.withColumn("community", F.when(F.col("id") < 20, 0).otherwise(20).cast("long"))
    assert {r.id: r.community for r in algorithms.refined(e, loose).collect()} == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}, **{i: 20 for i in range(20, 26)}}
    sub = {r["id"]: r["sub"] for r in algorithms._refine(level.both, level.degree, level.twice, loose, 12).collect()}
    assert not {sub[i] for i in range(5)} & {sub[i] for i in range(10, 15)}
    found = algorithms.leiden(e)[0].select("id", "community").collect()
    assert {r.id: r.community for r in found} == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}, **{i: 20 for i in range(20, 26)}}


def test_community_reports_bottom_up(spark):
    """By the definition, over all customers: nations, regions, all; with a budget that only some levels fit in."""
    given = catalogue._customer_tree(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))
    texts, levels = {r.id: r.text for r in given[0].collect()}, {r.id: [*r.levels] for r in given[1].collect()}
    summary = lambda text: providers.get("generate-offline").call(["Context: " + text])[0]
    size = lambda t: len(t.split())
    for budget in (12, 90, 100_000):
        want, below = {}, None
        for k in range(3):
            groups = defaultdict(list)
            for i, v in levels.items():
                groups[v[k]].append(i)
            now = {}
            for g, ids in groups.items():
                full = sum(size(texts[i]) for i in ids)
                if k == 0:
                    parts, total = [], 0
                    for i in sorted(ids, key=lambda i: (-size(texts[i]), i)):
                        total += size(texts[i])
                        if total > budget:
                            break
                        parts.append(texts[i])
                    replaced, words = 0, " ".join(sorted(parts, key=parts.index))
                    whole = words if full <= budget else None
                else:
                    children = sorted({levels[i][k - 1] for i in ids}, key=lambda c: (-below[c][0], c))
                    left, chosen, replaced = full, [], 0
                    for c in children:
                        if left > budget:
                            left -= below[c][0] - size(below[c][2])
                            chosen.append(below[c][2])
                            replaced += 1
                        else:
                            chosen.append(below[c][1])
                    parts, total = [], 0
                    for t in chosen:
                        total += size(t)
                        if total > budget:
                            break
                        parts.append(t)
                    words = " ".join(parts)
                    whole = " ".join(below[c][1] for c in children) if full <= budget else None
                now[g] = (full, whole, " ".join(summary(words).split()[:budget]))
                want[k, g] = (now[g][2], size(now[g][2]), full, replaced)
            below = now
        got = rag.hierarchy_reports(*given, providers.get("generate-offline"), budget)
        assert {(r.level, r.community): (r.report, r.tokens, r.full_tokens, r.replaced) for r in got.collect()} == want
        assert all(t <= budget for _, t, _, _ in want.values())
        assert any(r for _, _, _, r in want.values()) == (budget < 1000)


def test_token_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 30)
    rows = catalogue.QUERIES["token_batches"](spark, SF).withColumn("o", F.xxhash64("doc_id", F.lit(86))).collect()
    tokens = {d: len([w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]) for d, t in table(spark, "documents", "doc_id", "text")}
    assert sorted(r.doc_id for r in rows) == sorted(tokens)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append((r.o, r.doc_id, r.batch))
    assert len(shards) > 1
    for held in shards.values():
        total, batch = 0, 0
        for _, doc, got in sorted(held):
            if total and total + tokens[doc] > 8000:
                total, batch = 0, batch + 1
            total += tokens[doc]
            assert got == batch


def test_recursive_chunks(spark):
    got = defaultdict(list)
    for r in sorted(catalogue.QUERIES["chunk_recursive"](spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_id)):
        got[r.doc_id].append(r.chunk)
    for doc, text in table(spark, "documents", "doc_id", "text"):
        at, end = 0, 0
        for chunk in got[doc]:
            assert 0 < len(chunk) <= 300 and chunk == chunk.strip()
            latest = len(text) - len(text[end:].lstrip())  # only white space may lie between chunks
            at = text.rfind(chunk, at, latest + len(chunk))
            assert at >= 0
            end = max(end, at + len(chunk))
            at += 1
        assert not text[end:].strip()


def test_semantic_chunks(spark):
    import numpy as np

    embed = providers.get("embed-offline")
    want = set()
    for doc, text in table(spark, "documents", "doc_id", "text"):
        said = [s for s in re.split(r"(?<=[.?!])[ \t\n\x0b\f\r]+", text) if s] if text is not None else []
        if not said:
            continue
        v = np.array(embed.call([" ".join(said[max(0, i - 1) : i + 2]) for i in range(len(said))]))
        distance = np.round(1 - (v[1:] * v[:-1]).sum(1), 9)
        limit = np.percentile(distance, 95) if len(distance) else 0.0
        chunk, held = 0, [said[0]]
        for s, d in zip(said[1:], distance):
            if d > limit:
                want.add((doc, chunk, " ".join(held)))
                chunk, held = chunk + 1, []
            held.append(s)
        want.add((doc, chunk, " ".join(held)))
    got = {(r.doc_id, r.chunk_id, r.chunk) for r in catalogue.QUERIES["chunk_semantic"](spark, SF).collect()}
    assert got == want


def test_transformed_graph(spark):
    told = providers.get("triplets-offline")
    import json

    want = set()
    for doc, text in table(spark, "benchmark", "item_id", "text"):
        for s, r, o in json.loads(told.call([text])[0])["triplets"]:
            want |= {(s, r.upper().replace(" ", "_"), o), (f"doc:{doc}", "MENTIONS", s), (f"doc:{doc}", "MENTIONS", o)}
    got = [tuple(r) for r in catalogue.QUERIES["transformed_graph"](spark, SF).select("src", "type", "dst").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rag_evaluation(spark):
    import json

    import numpy as np

    embed, judge, write = providers.get("embed-offline"), providers.get("judge-offline"), providers.get("questions-offline", questions=2)
    chunks = [(f"{d}#{i}", c) for d, t in table(spark, "benchmark", "item_id", "text") for i, c in enumerate(windows(t, 300, 50))]
    asked = [(q["question"], q["answer"]) for _, c in chunks for q in json.loads(write.call([c])[0])["qa"]]
    v = np.array(embed.call([c for _, c in chunks]))
    correct, relevant, prompts, replies = [], [], 0, 0
    for question, truth in asked:
        score = np.round(v @ np.array(embed.call([question])[0]), 6)
        best = sorted(range(len(chunks)), key=lambda i: (-score[i], chunks[i][0]))[:3]
        contexts = [chunks[i][1] for i in best]
        prompt = f"Question: {question}\nContext: " + "\n".join(contexts)
        answer = providers.get("generate-offline").call([prompt])[0]
        j = json.loads(judge.call([json.dumps({"truth": truth, "answer": answer, "contexts": contexts})])[0])
        correct.append(j["answer_correctness"]["score"])
        relevant.append(j["context_relevance"]["score"])
        prompts, replies = prompts + len(prompt.split()), replies + len(answer.split())
    got = catalogue.QUERIES["rag_evaluation"](spark, SF).first()
    assert (got.num_questions, got.total_prompt_tokens, got.total_completion_tokens) == (len(asked), prompts, replies)
    assert got.avg_answer_correctness == pytest.approx(np.mean(correct)) and got.avg_context_relevance == pytest.approx(np.mean(relevant))
    assert got.avg_answer_correctness > 0 and got.measured


def test_budget_is_taken_in_order(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101, 1 + i % 9) for i in range(500)], "id long, score long, tokens long")
    got = retrieval.take_to_budget(rows, 700, [F.desc("score"), F.asc("id")])
    running, want = 0, []
    for i in sorted(range(500), key=lambda i: (-((i * 37) % 101), i)):
        running += 1 + i % 9
        if running > 700:
            break
        want.append((i, running))
    assert sorted((r.id, r.running) for r in got.collect()) == sorted(want)
