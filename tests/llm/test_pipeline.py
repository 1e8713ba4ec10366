import json
import random
import struct

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import queries
from lattica.llm.bpe import bpe_decode, bpe_encode, encode, pieces
from lattica.llm.fingerprints import edited_fingerprints
from lattica.llm.html import Page, main_text
from lattica.llm.lines import LINES_SQL, line_digests
from lattica.llm.mixing import mix_documents, mixed_documents
from lattica.llm.toxicity import fit, fold, letter, options, restore, score

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_bpe_round_trip(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    texts = ["", None, "Hello world's  end\n\n ", "é" * 1000, "\x00\x1c a　b", " ".join(["word, 12"] * 40_000), "x" * 60_000, "😀   ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    coded = bpe_encode(df, ranks, pattern)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe_decode(coded, ranks, pattern).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    from lattica.llm.bpe import encoding

    for t in texts:
        assert "".join(pieces(t or "", 7)) == (t or "")
        whole = encoding(ranks, pattern).encode_ordinary(t or "")
        assert encode(t, ranks, pattern).tolist() == whole
        assert [x for p in pieces(t or "", 7) for x in encoding(ranks, pattern).encode_ordinary(p)] == whole
    assert bpe_encode(df.limit(0), ranks, pattern).count() == 0


def test_mixing_budgets(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "en", [None, "b", "a", "é"][i % 4], 0) for i in range(400)] + [(5, "x y", "en", "a", 0)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    got = mix_documents(docs).collect()
    sizes, targets, taken = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = r.source_size
        targets[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    total = sum(sizes.values())
    # water level by bisection
    weights = {"a": 3.0, "b": 1.0, "é": 2.0, None: 3.0}
    lo, hi = 0.0, 10.0 * total
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * w) for s, w in weights.items()) < 1.5 * total else (lo, mid)
    for s in sizes:
        assert targets[s] == pytest.approx(min(2 * sizes[s], lo * weights[s]))
        assert taken[s] == int(targets[s] + 1e-9)
    assert sorted(map(str, got)) == sorted(map(str, mix_documents(docs.repartition(5)).collect()))
    # what each row takes: in the order of its key, after all rows of its source with smaller ones
    def key(i, n, t):  # of the id, the seed, the size and the text's own hash, one after the other
        h = 42
        for part in (struct.pack("<q", i), struct.pack("<i", 0), struct.pack("<q", n), struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), seed=42))):
            h = xxhash.xxh64_intdigest(part, seed=h)
        return h

    want, place = [], {}
    for _, i, n, s in sorted((key(i, len(t.split()), t), i, len(t.split()), s or "") for i, t, _, s, _ in rows):
        whole, goal = sizes[s or None], int(targets[s or None] + 1e-9)
        want.append((i, s, n, goal // whole * n + max(0, min(n, goal % whole - place.get(s, 0)))))
        place[s] = place.get(s, 0) + n
    assert sorted((r.doc_id, r.source or "", r.size, r.taken) for r in got) == sorted(want)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert words == taken
    empty = spark.createDataFrame([], DOCS)
    assert mix_documents(empty).count() == 0 and mixed_documents(empty).count() == 0
    assert mix_documents(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)).agg(F.sum("taken")).first()[0] == 0


def test_lines_like_sql(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "a\nb\n\nc\n"), (2, "x\n a\nb \nc"), (3, "b\nc\nq\nb\nc"), (4, None), (5, ""), (6, long + "\nz"), (7, "q\n" + long + "\r\nb"), (8, "a\na\na\na"), (9, "\n\n")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(LINES_SQL).fetchall())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_digests(docs).collect())
    assert got == want
    assert [r[2] for r in got] == [0, 3, 4, 0, 0, 0, 1, 3, 0]
    assert line_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", [2, 3])
def test_lines_like_brute_force(spark, run):
    """Rows without ids, of one id, and of their own, with lines from a few, against every run compared with every other."""
    import random

    from lattica.llm.lines import dedup_lines

    r = random.Random(run)
    line = lambda: r.choice([f"line {r.randrange(40)}", f"  own {r.randrange(10**9)}\t", "", " ", "}", "long " * 50 + str(r.randrange(3))])
    texts = ["\n".join(line() for _ in range(r.randrange(1, 30))) for _ in range(200)]
    rows = [(r.choice([None, 5, i]), t, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, f"a {i}\nb {i}", "x", "y") for i in range(3000)] + [(None, "one\ntwo\nthree", "x", "y")] * 3 + [(9999, "line 1\n" * 100_000, "x", "y"), (None, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, k string")
    hashes = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted({(i is None, i or 0, hashes[t], t) for i, t, _, _ in rows if t is not None})
    split = {t: [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for *_, t in order}
    seen, want = set(), {}
    for none, i, _, t in order:
        at, gone = split[t], set()
        for n, ok in ((run, lambda x: True), (1, lambda x: len(x.split()) >= 50)):
            for k in range(len(at) - n + 1):
                unit = tuple(x for _, x in at[k : k + n])
                if n == run or ok(unit[0]):
                    if unit in seen:
                        gone.update(range(at[k][0], at[k + n - 1][0] + 1))
                    seen.add(unit)
        want[None if none else i, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    got = dedup_lines(docs, run).select("row.doc_id", "row.text", "kept").collect()
    assert len(got) == len(rows)
    assert all(x.kept == (None if x.text is None else want[x.doc_id, x.text]) for x in got)


def test_fingerprints(spark):
    import hashlib

    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(10, words(0, 300)), (8, words(0, 300)), (9, words(60, 300)), (3, ""), (2, None), (-5, "ab"), (7, "é" * 10), (None, "z")]
    got = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [(None, "z")]
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[10].fingerprint == got[8].fingerprint and got[10].near_next == pytest.approx(236 / 296, abs=0.12)
    assert got[3].fingerprint == got[2].fingerprint == "" and got[3].near_next == 1.0
    assert len(got[10].fingerprint) == 256
    assert edited_fingerprints(spark.createDataFrame([], "doc_id int, text string, fingerprint string")).count() == 0


def fingerprint_of(text):
    """One-permutation MinHash as defined: hashes are XXH64 with a seed that is 42 or the hash of what stands before."""
    import re
    import struct

    import xxhash
    from lattica.llm.fingerprints import _PROBES, BINS

    def chain(values, kind="<q"):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
        return h

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashes = {chain(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    least = {}
    for h in hashes:
        least[h >> 57] = min(h, least.get(h >> 57, h))
    if not least:
        return ""
    r = random.Random(20_26)
    tables = [[r.randrange(BINS) for _ in range(BINS)] for _ in range(_PROBES)]
    out = []
    for b in range(BINS):
        of = next((x for x in [b, *(t[b] for t in tables)] if x in least), None)
        if of is None:
            of = min((signed(chain([b, f], "<i")), f) for f in least)[1]
        out.append(f"{chain([signed(least[of])]) & 255:02x}".upper())
    return "".join(out)


def test_fingerprints_like_brute_force(spark, monkeypatch):
    """Fingerprints, edited texts and neighbours in many buckets; text ids, an id far off, many null ids, and clashing names."""
    import hashlib

    from lattica.llm.fingerprints import BINS

    monkeypatch.setattr("lattica.llm.fingerprints.BUCKET", 8)
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(30)}" for _ in range(r.choice([0, 1, 3, 5, 6, 20, 400])))
    rows = [(i * 3, text(), "x") for i in range(300)] + [(10**15, "far off", "x"), (-(10**15), "é " * 10_000, "x")]

    def near(a, b):
        if a == b or not a or not b:
            return float(a == b)
        return max(0.0, (sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 2 * BINS, 2)) / BINS - 1 / 256) / (1 - 1 / 256))

    got = {x.doc_id: x for x in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, _key string")).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (key, t, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        changed = t[: len(t) - k] + following[:k]
        x, want = got[key], [fingerprint_of(v) for v in (t, changed, following)]
        assert (x.fingerprint, x.edited_fingerprint, x.edited_sha256) == (want[0], want[1], hashlib.sha256(changed.encode()).hexdigest())
        assert x.near_edited == pytest.approx(near(want[0], want[1])) and x.near_next == pytest.approx(near(want[0], want[2]))
    # by text ids the order is that of code points
    named = [(f"id{i:04}", t) for i, t, _ in rows[:100]]
    found = {x.doc_id: x.near_next for x in edited_fingerprints(spark.createDataFrame(named, "doc_id string, text string")).collect()}
    for (key, t), (_, following) in zip(sorted(named, reverse=True), sorted(named, reverse=True)[1:]):
        assert found[key] == pytest.approx(near(fingerprint_of(t), fingerprint_of(following)))
    none = edited_fingerprints(spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(1, "same")] * 50, "doc_id long, text string"))
    assert none.count() == 350 and none.where("edited_sha256 is null").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a="<p>x</p>";</script></head><body class="has-sidebar"><nav><a href=/>Menu</a></nav>
<div class="cookie-notice">We use</div><{0}><h1>A &amp; B</h1><p>One <b>bo</b>ld&nbsp;two<p>Three<br>four <!-- <p>no</p> --> five {2}</p><form>in</form></{1}>
<div class="post-7 comments"><article class="comment">Nice article, {2}</article></div><aside>x</aside><footer>&copy; foot</footer>"""


@pytest.mark.parametrize("paths", [10_000, -1])
def test_main_text(spark, monkeypatch, paths):
    monkeypatch.setattr("lattica.llm.html.PATHS", paths)
    more = "and more text " * 20
    pages = [(i, f"https://Host.example/{i}", PAGE.format(*t, more)) for i, t in enumerate([("article", "article")] * 3)]
    pages += [(10, "http://other.example/a", PAGE.format('div id="c12"', "div", more)), (11, None, None), (12, "x", ""), (13, "x", "plain <b>text"), (14, "http://host.example", "<article>short</article><div>" + more + "</div>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = " ".join(f"A & B One bold two Three four five {more}".split())
    assert [got[k] for k in (0, 1, 2, 10)] == [want] * 4
    assert (got[11], got[12], got[13], got[14]) == ("", "", "plain text", "short")
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0
    assert Page("<div " * 1000 + "a" * 100_000).text([]) is not None


@pytest.mark.parametrize("part", ["ul", "ol", "table", "blockquote", "figure", "section", "div"])
def test_main_text_keeps_whole_articles(spark, part):
    """Most of an article in one list, section or quote: its heading and introduction stay, on the page itself and by votes."""
    inner = "some text of the part " * 20
    whole = f"<h1>Title</h1><p>An introduction.</p><{part}>{inner}</{part}><p>An end.</p>"
    pages = [(i, f"http://{'a' if i else 'b'}.example/{i}", f"<nav>Menu</nav><{tag}>{html}</{tag}>") for i, (tag, html) in enumerate([("article", whole), ("div", whole)] + [("div", f"<{part}>{inner}</{part}>")] * 3)]
    pages.append((9, "http://c.example/", "<nav>Menu</nav><article class=x>one story</article><article class=y>" + inner + "</article>"))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = f"Title An introduction. {inner.strip()} An end."
    assert [got[0], got[1], got[9]] == [want, want, f"one story {inner.strip()}"]
    assert got[2] == inner.strip()


def test_main_text_of_articles_about_anything(spark):
    """Parts of an article whose class has a telltale word among others, formulas, and boxes that say nothing else."""
    html = """<body><article><h1>T</h1><section class="related-work">Before us</section><div class="side-effects">May occur</div><p>So <math>x = 1</math></p>
<div class="share-buttons">Share</div><ul class="related-posts"><li>More</li></ul><section id="comments">Nice</section></article></body>"""
    rows = [(1, "http://a.example/", html, "", ""), (1, "http://a.example/", html, "", "")]
    got = main_text(spark.createDataFrame(rows, "page_id int, url string, html string, host string, paths string")).collect()
    assert [(r.text, r.n_chars) for r in got] == [("T Before us May occur So x = 1", 30)] * 2


def test_main_text_by_what_a_host_repeats(spark):
    """Class names that no list has: what is the same on different pages goes, copies of a page count once."""
    page = "<body><div class='zq'>Start Topics Contact</div><div class='wx'>{0}</div><div class='yv'>All rights reserved {1}</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(f"Story {i} is about things of its own kind", 1)) for i in range(12)]
    rows += [(100 + i, "http://copies.example/", page.format("One story, copied", i % 2)) for i in range(20)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is about things of its own kind" for i in range(12))
    assert all("One story, copied" in got[100 + i] for i in range(20))


def test_main_text_of_deep_and_long_pages(spark):
    import time

    began = time.time()
    assert Page("<div>" * 100_000 + "deep" + "</div>" * 100_000 + "</section>" * 1000).text([]) == "deep"
    assert Page("<section>" + "<div>" * 50_000 + "x" + "</p></ul>" * 50_000).text([]) == "x"
    long = "word " * 1_000_000
    assert Page(f"<nav>menu</nav><article>{long}</article>").text([]) == long.strip()
    assert time.time() - began < 20


def labelled(spark, n=400):
    bad = ["moron", "idiot", "stupid", "loser"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = " ".join(f"word{chr(97 + (i * 7 + k) % 26)}{chr(97 + k % 26)}" for k in range(30)) + (" " + bad[i // 5 % 4] if toxic else "")
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_restores_and_scores(spark):
    docs, labels = labelled(spark)
    model = fit(docs, labels)
    assert restore("m0r0n", model.characters) == "moron" and restore("1d10t", model.characters) == "idiot"
    new = ["you m0r0n", "what an i d i o t", "so stuuuupid!!", "l.o.s.e.r", "$tupid", "a fine day", "", None, "call 555-0100 now!!!", "x" * 100_000]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(list(enumerate(new)), "doc_id int, text string"), model).collect()}
    assert [got[i] >= 0.7 for i in range(len(new))] == [True] * 5 + [False] * 5
    assert all(0 <= s <= 1 for s in got.values())
    none = fit(docs.limit(0), labels.limit(0))
    assert none.score("x") <= 0.5
    # held-out precision, recall and ranking: only rows whose labels were not read
    marks = {r.doc_id: r.toxic for r in labels.where(fold(F.col("doc_id")) == 1).collect()}
    held = {r.doc_id: r.score for r in score(docs, model).collect() if r.doc_id in marks}
    assert len(held) > 100 and all((s >= 0.7) == bool(marks[k]) for k, s in held.items())
    assert min(s for k, s in held.items() if marks[k]) > max(s for k, s in held.items() if not marks[k])
    assert len({round(s, 6) for s in held.values()}) >= 8
    # no length is beyond restoring
    for token in ("m" + "0" * 60 + "r" * 30 + "0n", "a/b-c/" * 9 + "m0r0n", "so,what:" * 8 + "$tup1d", "see:" * 12 + "1d10t"):
        assert len(token) > 40 and model.score("you " + token) >= 0.7, token
    assert model.score("f588a13e8ab71b41a6803e722e76d21eb69539fa" * 50) < 0.7


def test_restoring_is_exact(spark):
    """The decoded letters score as well as the best of all paths through the lattice."""
    import itertools

    docs, labels = labelled(spark)
    model = fit(docs, labels).characters

    def paths(token):
        choices, before = [], ""
        for c in token:
            choices.append([*options(c), *([("", -0.4)] if c == before and c.isalnum() else [])])
            before = c
        for path in itertools.product(*choices):
            a = b = 0
            total = 0.0
            for x, cost in path:
                total += cost
                if x:
                    total += model[a][b][letter(x)]
                    a, b = b, letter(x)
            yield total + model[a][b][0], "".join(x for x, _ in path)

    for token in ("m0r0n", "1d10t", "st##d", "l**e6", "aabb", "!!1|l", "w0#d*", "é1*6"):
        every = list(paths(token))
        best = max(t for t, _ in every)
        assert max(t for t, out in every if out == restore(token, model)) == pytest.approx(best)


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    texts = [(None, words("a")), (None, words("b")), (None, words("c")), (7, words("d")), (7, words("e")), (7, words("e")), (3, words("e") + " x"), (8, words("b")), (None, None), (None, ""), (9, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    want = [(None, words("a")), (8, words("b")), (None, words("c")), (7, words("d")), (3, words("e") + " x"), (None, None), (None, ""), (9, "")]
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(map(str, want))


def test_class_model(spark):
    import math
    from collections import Counter

    from lattica.llm.brown import class_scores

    rows = [(i, " ".join(["The cat sat", "le chat dort", "A dog ran"][(i + k) % 3] for k in range(i % 9))) for i in range(60)] + [(100, None), (101, "unseen Words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in class_scores(docs, F.col("doc_id") < 60).collect()}
    counts = Counter(w for i, t in rows if i < 60 for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words = [*(t or "").lower().split(), None]
        assert got[i].n_tokens == len(words) and got[i].n_known == sum(counts[w] > 0 for w in words) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    # the class model's score against its definition, by the classes that the exchange found
    from lattica.llm import brown
    from lattica.llm.common import Words

    taught = docs.where("doc_id < 60")
    model = brown.fit(taught, brown.count_words(taught))

    def classed(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes, shapes, _ = brown.tokens(Words(data, np.array([0, len(data)])))
        keys = brown._keys(hashes, shapes)
        return [(int(k), int(model.classes[np.searchsorted(model.keys, k)]) if k in set(model.keys) else brown.CLASSES + int(x)) for k, x in zip(keys, shapes)]

    end = classed("")[0][1]
    both, of_class, seen = Counter(), Counter(), Counter()
    for i, t in rows:
        if i < 60:
            c = classed(t)
            both.update(zip([end] + [x for _, x in c], [x for _, x in c]))
            of_class.update(x for _, x in c)
            seen.update(c)
    d, all_n = len(model.transitions), sum(both.values())
    own = {x: len({k for k, y in seen if y == x}) for x in range(d)}
    weight = (sum(n for (a, b), n in both.items() if (n - 1) / max(1, sum(m for (x, _), m in both.items() if x == a) - 1) > (of_class[b] - 1) / (all_n - 1)) + 1) / (all_n + 2)
    for i, t in rows:
        total, before = 0.0, end
        for k, x in classed(t):
            left = sum(m for (y, _), m in both.items() if y == before)
            alone = (of_class[x] + 0.1) / (all_n + 0.1 * d)
            total += math.log10(weight * both[before, x] / left + (1 - weight) * alone if left else alone)
            total += math.log10((seen[k, x] + 0.1) / (of_class[x] + 0.1 * max(1, own[x] + (x >= brown.CLASSES))))
            before = x
        assert got[i].score == pytest.approx(total), i
        assert got[i].perplexity == pytest.approx(10 ** (-total / got[i].n_tokens))
    assert len({x for _, x in classed("the cat sat le chat dort a dog ran")}) > 3
    assert class_scores(docs.limit(0), F.lit(True)).count() == 0
    assert class_scores(docs, F.lit(False)).count() == len(rows)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs, labels = labelled(spark)
    copies = docs.where("doc_id % 5 = 1").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [json.dumps(name) for name, _ in corpus_pipeline.STAGES]
    rows, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = rows.columns
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.columns == columns
        kept.append(rows.count())
    assert kept[0] == 400 and kept[1] == 400 and kept[2] <= 320
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[3]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
