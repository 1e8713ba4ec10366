import hashlib
import random
import re

import pytest
from lattica.llm.repeats import WINDOW, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """What the contract says, window by window."""
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = {}, []
    for key, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - WINDOW + 1):
            w = tuple(words[i : i + WINDOW])
            seen.setdefault(w, (key, i))
    for key, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - WINDOW + 1):
            if seen[tuple(words[i : i + WINDOW])] < (key, i):
                gone.update(range(i, i + WINDOW))
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def texts(seed, vocabulary, n=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}é"
    passages = [[word() for _ in range(r.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(0, 5)):
            words += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randrange(0, 60))]
        if rows and r.random() < 0.3:
            words = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.randrange(0, 3)):
                if words:
                    words[r.randrange(len(words))] = "edit"
        rows.append((i * 7 - 50, r.choice([" ", "\n", "\t \x0b"]).join(words)))
    return rows


@pytest.mark.parametrize("seed,vocabulary", [(1, 5000), (2, 30), (3, 2)])
def test_like_brute_force(spark, seed, vocabulary):
    rows = texts(seed, vocabulary) + [(1000, None), (1001, ""), (1002, "a " * 100), (1003, "a b " * 80 + "x"), (1004, "  ".join("abc" * 30))]
    random.Random(0).shuffle(rows)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute(rows)


def test_empty_table_clashing_columns_and_null_ids(spark):
    schema = "doc_id int, text string, a string, spans string, d string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(30)))
    rows = [(None, text, "", "", ""), (1, text, "", "", ""), (1, text, "", "", ""), (1, "other", "", "", "")]
    got = remove_repeats(spark.createDataFrame(rows, schema))
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in got.collect()) == [(False, 1, 0), (False, 30, 0), (False, 30, 0), (True, 30, 30)]


def test_many_rows_without_id(spark):
    """3,000 rows without an id against brute force, in the order of what tells them apart: texts of their own lose nothing."""
    from pyspark.sql import functions as F

    words = lambda k, n: " ".join(f"{k}_{i}" for i in range(n))
    rows = [(None, words(k, 26)) for k in range(2000)] + [(None, words(k % 10, 26)) for k in range(500)] + [(None, words(f"x{k}", 5) + " " + words("all", 30) + " " + words(f"y{k}", 5)) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.text for r in df.orderBy(F.xxhash64("text")).collect()]
    place = {t: k for k, t in enumerate(dict.fromkeys(order))}
    want = brute([(k, t) for t, k in place.items()])
    got = sorted({(place[r.kept] if r.kept in place else -1, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect()}, key=str)
    assert remove_repeats(df).count() == len(rows)
    assert sorted(g[1:] for g in got) == sorted(set(w[1:] for w in want))
    assert sum(r.n_removed for r in remove_repeats(df).collect()) == sum(w[2] for w in want for _ in range(order.count(next(t for t, k in place.items() if k == w[0])) if w[2] else 0))


def test_long_text(spark):
    r = random.Random(5)
    words = [f"x{r.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[150_000:150_060]))]
    got = {x.doc_id: x.n_removed for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), text=False).collect()}
    assert got == {1: 0, 2: 60}
