"""Texts' way into a knowledge graph: what moves, and the same rows as plain Python."""

import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lattica import providers
from lattica.functions import text
from lattica.plans import rag

MODELS = ("embed-offline", "propositions-offline", "triplets-offline")
WHITE = r"(?<=[.?!])[ \t\n\x0b\f\r]+"


def _groups(s, percentile=0.95):
    """Plain Python: sentences grouped between breaks, each embedded with one neighbour on both sides."""
    v = providers.get("embed-offline").call([" ".join(s[max(i - 1, 0) : i + 2]) for i in range(len(s))])
    d = [round(1 - sum(a * b for a, b in zip(x, y)), 9) for x, y in zip(v, v[1:])]
    limit = np.percentile(d, 100 * percentile) if d else 0
    starts = [0, *(i + 1 for i, x in enumerate(d) if x > limit + 1e-12)]
    return [" ".join(s[a:b]) for a, b in zip(starts, [*starts[1:], len(s)]) if a < b]


def _docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(7, "Anna knows Bert. Bert likes green tea"), (7, None), (8, ""), (None, "One two three! Four"), (None, " \n\n "), (9001, "a"), (9002, "Anna knows Bert. Anna knows Bert.")]


def test_semantic_chunks_move_nothing(spark, monkeypatch):
    monkeypatch.setattr(providers, "TEXTS", 7)
    rows = _docs(spark)
    found = text.semantic_chunks(spark.createDataFrame(rows, "doc_id long, text string"), providers.column(providers.get("embed-offline")))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = Counter((d, i, c) for d, t in rows for i, c in enumerate(_groups([s for s in re.split(WHITE, t or "") if s])))
    assert Counter(map(tuple, found.collect())) == want


def test_each_replies_in_the_places_of_its_texts(spark, monkeypatch):
    monkeypatch.setattr(providers, "TEXTS", 3)
    lists = [["A. x"], [], None, ["B. x", None, "C. x", "D. x", "E. x"], ["F. x", "G. x"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>").coalesce(1)
    each = providers.column(providers.get("generate-offline")).each
    assert {r.i: r.y for r in df.select("i", each("x").alias("y")).collect()} == {0: ["A."], 1: [], 2: None, 3: ["B.", "", "C.", "D.", "E."], 4: ["F.", "G."]}


def test_knowledge_graph_of_whole_table(spark, monkeypatch):
    kept, cut = [], rag.cut
    monkeypatch.setattr(rag, "cut", lambda df, **o: (kept.append(df), cut(df, **o))[1])
    rows = _docs(spark)
    g, bad = rag.knowledge_graph(spark.createDataFrame(rows, "doc_id long, text string"), *map(providers.get, MODELS))
    assert [df.columns for df in kept] == [["doc_id", "text"], ["doc_id", "t", "raw"]]  # a text is stored once a step
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert [shuffles(df) for df in kept] == [0, 0] and shuffles(g.edges) == 2  # one for the edges, one for the mentions

    edges, names, chunks = set(), set(), set()
    said = lambda name, t, part: json.loads(providers.get(name).call([t])[0])[part]
    for d, t in rows:
        for i, piece in enumerate(text.split_recursively(t or "", 2000, 200, text.STRUCTURE_SEPARATORS)):
            at = str(i) if d is None else f"{d}#{i}"
            whole = " ".join(said(MODELS[1], piece, "propositions"))
            for group in _groups([s for s in re.split(WHITE, whole) if s]):
                chunks.add(at)
                for a, r, b in said(MODELS[2], group, "triplets"):
                    edges |= {(a, r.replace(" ", "_").upper(), b), (at, "MENTIONS", a), (at, "MENTIONS", b)}
                    names |= {a, b}
    got = [tuple(r) for r in g.edges.select("src", "type", "dst").collect()]
    assert len(edges) > 1000 and set(got) == edges and len(got) == len(edges)
    nodes = [(r.id, r.labels[0], r.name) for r in g.nodes.collect()]
    assert Counter(nodes) == Counter([(n, "Entity", n) for n in names] + [(c, "Chunk", None) for c in chunks])
    assert bad.count() == 0


def test_unreadable_replies_are_kept_as_they_came(spark):
    class Says:
        returns = "string"

        def call(self, texts):
            return ["no JSON" if "bad" in t else '{"triplets": [["a", "b"], ["c", null, "d"], ["x", "is", "y"]]}' for t in texts]

    docs = spark.createDataFrame([(1, "A bad one."), (2, "A good one.")], "doc_id int, text string")
    g, bad = rag.knowledge_graph(docs, *map(providers.get, MODELS[:2]), Says())
    assert {tuple(r) for r in bad.collect()} == {("1#0", "no JSON"), ("2#0", '["a","b"]')}
    assert {tuple(r) for r in g.edges.where(F.col("type").isNull() | (F.col("type") != "MENTIONS")).collect()} == {("c", None, "d"), ("x", "IS", "y")}
