import random

import numpy as np
import pytest
from lattica.llm.chosen_path import near_duplicates
from lattica.llm.vectors import near_vectors


def closure(n, linked):
    least = list(range(n))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        least[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_jaccard(rows):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    links = [0] * n
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return sorted((rows[i][0], rows[c][0], links[i]) for i, c in enumerate(closure(n, pairs)))


def texts(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passage = [word() for _ in range(25)]
    rows = []
    for base in range(12):
        words = [word() for _ in range(r.randrange(1, 120))]
        if base % 3 == 0:
            words = passage + words
        for _ in range(r.choice([1, 1, 2, 5, 40])):
            copy = list(words)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, "one", "one", "one two", "   "]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_like_brute_force(spark, seed):
    rows = texts(seed)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_jaccard(rows)


def test_jaccard_large_buckets(spark, monkeypatch):
    """Near copies beyond one small bucket and one block, and texts that only share a passage."""
    for name, value in {"SMALL": 30, "BLOCK_SETS": 60, "ROWS": 16, "COLUMNS": 100}.items():
        monkeypatch.setattr(f"lattica.llm.chosen_path.{name}", value)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(3000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(20)]
    rows = []
    for _ in range(150):
        copy = list(base)
        for _ in range(r.randrange(0, 3)):
            copy[r.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(r.randrange(5, 30))]) for _ in range(150)]
    rows = list(enumerate(rows))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_jaccard(rows)


def test_jaccard_edges(spark):
    schema = "doc_id long, text string, x string, m string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (1, "other text", "", "")]
    got = sorted((str(r.doc_id), r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1, 0), ("1", 1, 2), ("1", 1, 2), ("None", 1, 2)]


def test_jaccard_many_rows_without_id(spark):
    """3,000 rows without an id: texts of their own, copies, and near copies; each row has its own result."""
    words = lambda k, n=30: [f"{k}w{i}" for i in range(n)]
    own = [" ".join(words(k)) for k in range(1000)]
    copies = [" ".join(words(-1))] * 1000
    near = [" ".join(words(-2, 60 + k % 5)) for k in range(1000)]
    rows = [(None, t) for t in own + copies + near] + [(7, " ".join(words(5)) + " end"), (8, "x" * 2_000_000), (9, "y " * 300_000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_links for r in got) == sorted([0] * 999 + [1] * 2 + [999] * 2000 + [0, 0])
    assert sorted(str(r.class_id) for r in got if r.n_links < 2) == sorted(["None"] * 999 + ["7", "7", "8", "9"])
    assert sum(r.kept for r in got if r.n_links == 999) == 1000 + 200


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((len(rows), [float(np.float32(v)) for v in centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])], int(k % 3)))
    rows += [(1000, rows[0][1], None), (1001, None, 1), (1002, [], 1), (1003, [0.0] * 16, 1), (1004, [float("nan")] + [1.0] * 15, 1), (1005, [None] + [1.0] * 15, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [2.0 * v for v in rows[0][1]], 0)]
    valid = lambda r: r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])
    linked, links = [], [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if valid(a) and valid(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    linked.append((i, j))
                    links[i] += 1
                    links[j] += 1
    assert len(linked) > 200
    want = sorted((rows[i][0], links[i], rows[c][0], i == c) for i, c in enumerate(closure(len(rows), linked)))
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("block", [2048, 20])
def test_vectors_of_few_directions(spark, monkeypatch, block):
    """Vectors of 64 components that lie in 4 dimensions: links point to the border of a list more than random ones do."""
    monkeypatch.setattr("lattica.llm.vectors.CELL", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 4)) @ np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    rows = [(i, [float(np.float32(v)) for v in row], i % 2) for i, row in enumerate(x)]
    unit = np.array([r[1] for r in rows])
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    near = (unit @ unit.T >= 0.93) & (np.arange(1500)[:, None] % 2 == np.arange(1500)[None] % 2)
    component = closure(1500, list(zip(*np.nonzero(np.tril(near, -1)))))
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(i, int(near[i].sum()) - 1, component[i]) for i in range(1500)]


def test_vectors_edges(spark):
    schema = "vec_id int, embedding array<float>, label string, e string, h int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], "a", "", 0), (5, [1.0, -0.0], "a", "", 0), (5, [1.0, 0.0], "a", "", 0)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [("5", 2, 5), ("5", 2, 5), ("None", 2, 5)]
