"""Words, lines and shingles that collide under any polynomial modulo 2 ** 64 are told apart."""

import numpy as np
import pytest
from lattica.llm.chosen_path import near_duplicates
from lattica.llm.common import mix64, span_hashes
from lattica.llm.lines import line_digests
from lattica.llm.repeats import remove_repeats

SIZES = [1 << k for k in range(10, 17)]


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", SIZES)
def test_span_hashes(n):
    bits = np.array([int(c) for c in thue_morse(n, "01")])
    values = mix64(np.array([3, 5], np.uint64))[np.r_[bits, 1 - bits, bits]]
    starts = np.arange(3) * n
    h = span_hashes(values, starts, starts + n)
    assert h[0] == h[2] != h[1]


def test_operators(spark):
    docs = []
    for n in SIZES:
        one, two = thue_morse(n), thue_morse(n, "ba")
        docs += [one, two]
    texts = list(enumerate(docs))
    for r in remove_repeats(spark.createDataFrame([(i, t + " " + " ".join(f"{i}z{k}" for k in range(19))) for i, t in texts], "doc_id long, text string")).collect():
        assert r["n_removed"] == 0
    lines = [(i, t + f"\nnext line of {i // 2}") for i, t in texts]
    assert all(r["n_removed"] == 0 for r in line_digests(spark.createDataFrame(lines, "doc_id long, text string")).collect())
    alone = [(i, t) for i, t in texts]
    assert all(r["n_links"] == 0 for r in near_duplicates(spark.createDataFrame(alone, "doc_id long, text string")).collect())
