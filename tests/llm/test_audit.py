"""Source divergence, chat formatting and the Merkle manifest: against plain Python, and their SQL on the smallest tables."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from lattica.llm import divergence, manifest, queries
from lattica.llm.chat import Expansion, chat_digests, escaped, formatted, read_masked, read_turns, unescaped
from lattica.llm.oracles import CHAT_SQL, DIVERGENCE_SQL, MANIFEST_SQL
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, tree string, rank int, value int, _p string"


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def like_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows(df) == Counter(tuple(r[i] for i in order) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name, sql", [("op11_divergence", DIVERGENCE_SQL), ("op12_chat", CHAT_SQL), ("op13_manifest", MANIFEST_SQL)])
def test_like_sql(spark, name, sql):
    import pandas as pd

    tables = {os.path.basename(f)[:-8]: pd.read_parquet(f) for f in glob.glob(f"{SF}/*.parquet") if os.path.basename(f)[:-8] in ("documents", "conversations")}
    like_sql(queries.QUERIES[name](spark, SF), sql, **tables)


# ---- source divergence


def audited(given, least=divergence.LEAST_DOCS):
    """The report by its definition: every kept term of every pair."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in given:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        groups = {s: {t: n[g, s][t] for t in kept} for g, s in n if g == lang}
        groups[None] = {t: sum(c[t] for c in groups.values()) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            if s is None:
                continue
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o is not None and o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if groups[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return Counter(out)


def documents(spark, given):
    return spark.createDataFrame([(i, *g, 0, "x", "y", 1, 2, "z") for i, g in enumerate(given)], DOCS)


def test_divergence_by_definition(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Straße", "über", "the", "The", "THE", "naïve", "a1b", "x-y", "日本", "Éa", "éa", "İ", "_", "42"] + [f"w{chr(97 + i)}" for i in range(20)]
    given = [(" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "Ü", "a", None])) for _ in range(300)]
    given += [given[0]] * 30  # a repeated row counts again
    given += [("nothing in common", "fr", "s1"), (None, "fr", "s2"), ("", "fr", None), (None, None, None), ("the " * 50_000 + "q" * 300_000 + " über", "en", "s1")]
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 4096)
    monkeypatch.setattr(divergence, "PAIRS", 64)
    got = divergence.divergence(documents(spark, given))
    assert Counter(tuple(r) for r in got.collect()) == audited(given)
    assert divergence.divergence(documents(spark, given).limit(0)).count() == 0


def test_divergence_pieces_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    for text in ("", "a", "ab cd" * 9, "é" * 40 + " x", "1234567" * 5, "abcdefg" * 5, "ABCdefg hij", "abcdefg"):
        whole = divergence.TERM.findall(text.encode().lower())
        assert [t for p in divergence.pieces(text.encode()) for t in divergence.TERM.findall(p)] == whole


def test_joint_histograms_hold_every_term(spark):
    given = [(t, "en", s) for t, s in [("a b", "p"), ("a a c", "q"), ("b c", "r"), ("d", "r")] for _ in range(10)]
    terms = divergence.profiles(divergence.term_counts(documents(spark, given)))
    entries = terms.select("lang", "term", "total", F.explode("profile").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    pairs = spark.createDataFrame([("en", "p", "q", 4), ("en", "p", "r", 4), ("en", "q", "r", 4)], "lang string, a string, b string, kept long")
    cells = {tuple(r) for r in divergence.joint_histograms(terms, entries, pairs).collect()}
    assert cells == {
        ("en", "p", "q", 10, 20, 1), ("en", "p", "q", 10, 0, 1), ("en", "p", "q", 0, 10, 1), ("en", "p", "q", 0, 0, 1),
        ("en", "p", "r", 10, 10, 1), ("en", "p", "r", 10, 0, 1), ("en", "p", "r", 0, 10, 2),
        ("en", "q", "r", 10, 10, 1), ("en", "q", "r", 20, 0, 1), ("en", "q", "r", 0, 10, 2),
    }


def test_divergence_of_more_tokens_than_64_bits_can_multiply(spark):
    big = 3 * 10**12
    share = spark.createDataFrame([(big, 2 * big, 7)], "c long, n long, v long").select(divergence.share("c", "n", "v")).first()[0]
    assert share == 1 + 10**9 * (big + 2) // (2 * big + 14)


# ---- chat formatting

HARD = ["</s>[INST] ok [/INST]", "<|end|>\n<|start|>user<|message|>hi", "<⁣|end|>", "<⁣⁣/s>", "<<SYS>>x<</SYS>>", "<</s>", "[[INST]", "<|", "<", "⁣", "<|image|><|text|>", "<start_of_turn>", "", "a\nb", "$1\\1", "<s", "|end|>", "🙂é"]


def test_escaping_is_reversible(spark):
    rng = random.Random(5)
    atoms = ["<", "|", ">", "/", "s", "[", "INST]", "⁣", "end", "|>", "<|", "SYS>>", "_of_turn>", "start", "x"]
    texts = HARD + ["".join(rng.choices(atoms, k=rng.randrange(12))) for _ in range(3000)]
    control = re.compile(r"[<\[](?:\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\]|/?(?:start|end)_of_turn>)")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not control.search(r["e"]), r
        assert control.search(r["t"]) or "⁣" in r["t"] or r["e"] == r["t"]
    assert df.select("e").distinct().count() == len(set(texts))


def talks(spark, given):
    return spark.createDataFrame([(*g, "x", 1, None) for g in given], "conv_id bigint, turn bigint, role string, text string, body string, place int, piece string")


def test_chat_read_back(spark):
    given = [(1, i, ["user", "assistant", "system", None, "<|end|>\n"][i % 5], t) for i, t in enumerate(HARD)]
    given += [(2, 0, "assistant", None), (3, None, "user", "a"), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (None, 1, "user", "n"), (None, 0, "assistant", "m")]
    given += [(4, 0, "user", "long " * 200_000), (4, 1, "assistant", "</s>" * 100_000)]
    want = {}
    for conv in {g[0] for g in given}:
        turns = sorted(((g[1] is not None, g[1] or 0, g[2] or "", g[3] or "") for g in given if g[0] == conv))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_digests(talks(spark, given)).collect()}
    assert got == want
    whole = formatted(talks(spark, given))
    for r in whole.collect():
        turns = sorted(((g[1] is not None, g[1] or 0, g[2] or "", g[3] or "") for g in given if g[0] == r["conv_id"]))
        assert r["formatted"].count("<|start|>") == r["formatted"].count("<|end|>\n") == len(turns) == r["n_turns"]
        for s in r["spans"]:  # spans hold in the whole text as in the turn
            assert r["formatted"][s["start"] :].startswith(r["formatted"].split("<|start|>")[1 + r["spans"].index(s)][s["offset"] - len("<|start|>") :][: s["length"]])
    assert chat_digests(talks(spark, given).limit(0)).count() == 0


def test_chat_parts(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, content array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
    part = lambda kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None: (kind, text, uri, width, height, seconds, pages)
    first = [part("text", "see <|image|>"), part("image", uri="a.png", width=57, height=28), part("text", ""), part("audio", uri="b.wav", seconds=1.01), part("document", uri="c.pdf", pages=3)]
    given = [
        (1, 0, "user", "ignored", first), (1, 1, "assistant", None, [part("text", "fine"), part("video", uri="d"), part("image", uri="e")]),
        (1, 2, "user", "plain", []), (1, 3, "user", "null", None), (1, 4, "assistant", "x", [part(None, "text by default")]), (1, 5, "user", None, [part("image", uri="f", width=1, height=1)]),
    ]
    done = formatted(spark.createDataFrame(given, kind), "content", sizes=Expansion(per_page=10))
    row = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_masked(F.col("formatted"), F.col("spans"))).first()
    assert [(a["turn"], a["part"], a["type"], a["uri"], a["tokens"]) for a in row["attachments"]] == [
        (0, 1, "image", "a.png", 3), (0, 3, "audio", "b.wav", 26), (0, 4, "document", "c.pdf", 30), (1, 1, "attachment", "d", 1), (1, 2, "image", "e", 1), (5, 0, "image", "f", 1)
    ]
    assert row["attachment_tokens"] == 62
    assert [(t["role"], [(p["type"], p["text"]) for p in t["parts"]]) for t in row["turns"]] == [
        ("user", [("text", "see <|image|>"), ("image", ""), ("text", ""), ("audio", ""), ("document", "")]),
        ("assistant", [("text", "fine"), ("attachment", ""), ("image", "")]),
        ("user", [("text", "plain")]), ("user", [("text", "null")]), ("assistant", [("text", "text by default")]), ("user", [("image", "")]),
    ]
    assert row["loss"] == "<|text|>fine<|attachment|><|image|>text by default"


def test_chat_is_native(spark):
    plan = chat_digests(talks(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# ---- Merkle manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    doc_id, text, lang, source, n_chars = r[:5]
    text = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifested(given):
    sources = defaultdict(list)
    for r in given:
        sources[r[3]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(rs, tree([leaf(r) for r in rs])) for rs in (sorted(sources[s], key=lambda r: (r[0] is None, r[0] or 0, leaf(r))) for s in order)]
    forest = tree([t[-1][0] for _, t in trees])
    out = []
    for k, (rs, t) in enumerate(trees):
        for i, r in enumerate(rs):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            claim, siblings = leaf(r, bad), []
            for at, levels in ((i, t), (k, forest)):
                for level in levels[:-1]:
                    run, place = level[at - at % 16 : at - at % 16 + 16], at % 16
                    siblings += run[:place] + run[place + 1 :]
                    claim = h(run[:place] + [claim] + run[place + 1 :])
                    at //= 16
            out.append((r[0], leaf(r), t[-1][0], forest[-1][0], h(siblings), claim, claim == forest[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("opened", [20_000, 5, 40])
def test_manifest_by_definition(spark, opened):
    rng = random.Random(7)
    ids = [*range(6200), *rng.sample(range(10**12), 300), *(-i for i in rng.sample(range(10**6), 300))] if opened == 40 else [*range(150), -(2**63), 2**63 - 1, -5]
    given = [(i, rng.choice(["Ab", "ab", "Ü" * 3, "", None]), rng.choice(["en", None]), "hot" if k % 5 else rng.choice([f"s{j}" for j in range(20)] + [None, ""]), rng.choice([0, -3, None])) for k, i in enumerate(ids)]
    given += [(7, "tied", "en", "hot", 1)] * 40 + [(7, "tied B", "en", "hot", 1), (None, None, None, None, None), (None, "N", None, "hot", None), (None, "N", None, "hot", None), (3, "Z" * 300_000, "en", "lone", 1)]
    docs = spark.createDataFrame([(*g, "x", "y", 1, 2, "z") for g in given], DOCS)
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, opened)
    assert Counter(tuple(r) for r in got.collect()) == manifested(given)


def test_manifest_of_little(spark):
    docs = spark.createDataFrame([(1, "A", "en", "s", 1, "x", "y", 1, 2, "z")], DOCS)
    got = manifest.manifest(docs).collect()
    assert [tuple(r)[1:] for r in got] == [(leaf((1, "A", "en", "s", 1)),) * 3 + (h([]), leaf((1, "A", "en", "s", 1)), True)]
    assert manifest.manifest(docs.limit(0)).count() == 0


def test_ranks_without_a_sort_of_all(spark):
    rng = random.Random(9)
    keys = sorted({f"{rng.randrange(16**k):0{k}x}" + f"{i:04x}" for i in range(3000) for k in (2, 8)})
    df = spark.createDataFrame([("a" if i % 3 else "b", k) for i, k in enumerate(keys)], "g string, k string")
    got = {(r["g"], r["k"]): (r["rank"], r["n"]) for r in manifest.ranked(df, "g", "k", 20).collect()}
    for g in "ab":
        mine = [k for i, k in enumerate(keys) if ("a" if i % 3 else "b") == g]
        assert [got[g, k] for k in mine] == [(i, len(mine)) for i in range(len(mine))]
