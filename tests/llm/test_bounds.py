"""What a task or a call may take: malformed pages, distances of centres, samples, ties of the mix."""

import os
import time
import tracemalloc

import numpy as np
import pytest
from lattica.llm import vectors
from lattica.llm.common import hash_sample
from lattica.llm.html import Page, main_text, markup
from lattica.llm.mixing import mix_documents, mixed_documents
from pyspark.sql import functions as F

STORY = "".join(f"<p>Sentence {i} of the story.</p>" for i in range(9))
WANT = " ".join(f"Sentence {i} of the story." for i in range(9))


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><article>{STORY}",
    f"<html><head><meta charset=x><title>T</title><body><article>{STORY}</article>",
    f"<title>T</title><article>{STORY}</article><button>",
    f"<article><button>{STORY}</article><button>go</button>",
    f"<article><select>{STORY}</article>",
    f"<article><svg viewBox='0 0'/>{STORY}</article>",
    f"<article><button><div>Click</div></button>{STORY}</article>",
    f"<article><video src=x><p>fallback</p></video>{STORY}</article>",
    f"<article><noscript><p>off</p></noscript><iframe>{STORY}</article>",
    f"<article data-x='a>b'>{STORY}</article><script>if (a < b) '<article>x</article>'",
    f"<article>{STORY}</article><!-- <p>no</p>",
])
def test_malformed_pages_keep_their_text(spark, page):
    assert Page(page).text([]) == WANT
    pages = spark.createDataFrame([(i, "http://h/a", page) for i in range(2)], "page_id long, url string, html string")
    assert {r.text for r in main_text(pages).collect()} == {WANT}


@pytest.mark.parametrize("page", ['<a "' * 1_250_000, "<a \"'>" * 600_000, "<title>" * 500_000, "<button>" * 500_000, "<a " * 900_000 + '"', '<a x=">' * 500_000 + "'", "<!--" * 900_000, "</" * 900_000, "<div>" * 300_000])
def test_long_open_markup_takes_time_in_proportion(page):
    began = time.perf_counter()
    Page(page).text([])
    assert time.perf_counter() - began < 8
    at = 0
    for start, end, *_ in markup(page):  # pieces follow each other
        assert at <= start < end
        at = end


def test_memory_of_probes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index(x, [], np.array([0, 768]), np.sqrt(vectors.nearest(x, x)[1]))
    tracemalloc.start()
    may, d = vectors.probes(index, x[:512], 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and may[np.arange(512), np.arange(512)].all()
    assert np.allclose(index.gaps, np.sqrt(((x[:, None, :8] * 0).sum(2) + np.maximum(0, 2 - 2 * x @ x.T))), atol=1e-6)


def test_samples_are_small_before_they_are_sorted(spark):
    rows = spark.range(40_000).withColumn("h", F.xxhash64("id"))
    want = [r.id for r in rows.orderBy("h").limit(50).collect()]
    got = hash_sample(rows, F.col("h"), 50, 40_000)
    assert [r.id for r in got.collect()] == want
    assert rows.where(F.col("h") < -(1 << 63) + int(300 / 40_000 * 2**64)).count() < 400
    assert hash_sample(rows.limit(20), F.col("h"), 50, 20).count() == 20


def test_mix_of_texts_without_ids_does_not_depend_on_partitions(spark):
    given = [(None, ["a", "b", None][i % 3], f"one two three four word{i}", "en", 9) for i in range(399)]
    docs = spark.createDataFrame(given, "doc_id long, source string, text string, lang string, n_chars long")
    runs = [sorted(map(str, mixed_documents(docs.repartition(n, order)).collect())) for n, order in ((1, "text"), (7, "n_chars"), (5, "source"))]
    assert runs[0] == runs[1] == runs[2]
    assert mix_documents(docs).columns == ["doc_id", "source", "size", "source_size", "target", "taken"]


def test_pipeline_stage_keeps_a_clashing_column(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11, "mine"), (2, "a b c d e f", "en", "s", 11, "too"), (3, None, "en", "s", 0, "none")], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r._row) for r in kept.collect()) == [(1, "mine"), (3, "none")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_a_disguised_word_is_found_inside_tokens_of_any_length(spark):
    from lattica.llm import toxicity

    sf = "/root/testdata/sf0.01"
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    word = max((f[1:] for f in model.weights if f[0] == "=" and len(f) > 8), key=lambda w: model.weights["=" + w])
    disguised = word.replace("a", "4").replace("e", "3").replace("i", "1").replace("o", "0").replace("s", "$")
    scores = [model.score("zq" * n + disguised + "qz" * n) for n in (1, 4, 9, 14, 30)]
    assert disguised != word and min(scores) > 0.5 and max(scores) - min(scores) < 1e-9
