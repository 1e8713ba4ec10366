import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica import providers
from lattica.functions import metrics, text
from lattica.plans import rag


@pytest.mark.parametrize("n", [0, 1, 5, 6, 8, 9])
def test_token_windows(spark, n):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "doc_id int, text string")
    got = [r.chunk.split() for r in text.chunk(docs, "TOKEN", 5, 2).orderBy("chunk_id").collect()]
    words = [str(i) for i in range(n)]
    want, s = [], 0
    while s < n:
        want.append(words[s : s + 5])
        if s + 5 >= n:
            break
        s += 3
    assert got == want


def test_char_windows_and_bad_arguments(spark):
    docs = spark.createDataFrame([(1, "ab   cd"), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in text.chunk(docs, "char", 3, 0).orderBy("chunk_id").collect()] == [(1, 0, "ab"), (1, 1, "c"), (1, 2, "d")]
    with pytest.raises(ValueError):
        text.chunk(docs, "other")
    with pytest.raises(ValueError):
        text.chunk(docs, "token", 3, 3)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n!", max_size=80), st.integers(1, 20))
def test_recursive_pieces(t, size):
    pieces = text.split_recursively(t, size)
    assert all(len(p) <= size and p for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(t.split())


def test_recursive_overlap(spark):
    got = text.split_recursively("one two three four five", 9, 4, (" ",))
    assert got == ["one two", "two three", "four five"] or all(len(p) <= 9 for p in got)
    docs = spark.createDataFrame([(1, "A b. C d. E f."), (2, None)], "doc_id int, text string")
    assert {r.doc_id for r in text.chunk(docs, "sentence", 6, 0).collect()} == {1}


def test_semantic_chunks_and_headlines(spark):
    docs = spark.createDataFrame([(1, "Cats purr. Cats sleep. Stocks fell. Stocks rose."), (2, "# Head\nbody here.\nOther head\nmore.")], "doc_id int, text string")
    got = text.semantic_chunks(docs.where("doc_id = 1"), providers.column(providers.get("embed-offline")), 0.5, 0)
    assert " ".join(r.chunk for r in got.orderBy("chunk_id").collect()) == "Cats purr. Cats sleep. Stocks fell. Stocks rose." and got.count() == 2
    assert [(r.headline, r.body) for r in text.headlines(docs.where("doc_id = 2")).orderBy("section").collect()] == [("# Head", "body here."), ("Other head", "more.")]


def test_trim_and_capture(spark):
    row = spark.range(1).select(text.trim_white(F.lit("\t7157 ")).alias("a"), text.captured(F.lit("HPO:abc[2021-06-21]"), r"HPO:(\w+)\[").alias("b"), text.captured(F.lit("none"), r"\[(\d{4})").alias("c"), text.or_default(F.lit(""), F.lit("human")).alias("d")).first()
    assert tuple(row) == ("7157", "abc", None, "human")


def test_verdict_arithmetic(spark):
    rows = spark.createDataFrame([([1, 0, 0],), ([0, 0],), ([0, 1],), ([],), ([1, 0],)], "v array<int>")
    got = rows.select(metrics.context_precision(F.col("v")).alias("p"), metrics.faithfulness(F.col("v")).alias("f")).collect()
    assert [r.p for r in got[:3]] == pytest.approx([0.9999999999, 0.0, 0.5], abs=2e-10)
    assert (got[1].f, got[4].f) == (0.0, 0.5) and math.isnan(got[3].f)


@pytest.mark.parametrize("said,choice", [("B)", "B"), (" c", "C"), ("The answer is C", "A"), ("xyz", "INVALID"), ("", "INVALID")])
def test_multiple_choice(spark, said, choice):
    assert spark.range(1).select(metrics.mcq_choice(F.lit(said))).first()[0] == choice


def test_prompts_accuracy_and_validation(spark):
    o = F.create_map(*[F.lit(x) for x in ("A", "one", "B", "two", "C", "three", "D", "four", "E", "")])
    assert spark.range(1).select(metrics.mcq_prompt(F.lit("Q?"), o)).first()[0] == "Q?\nA) one\nB) two\nC) three\nD) four\nAnswer with one letter."
    assert tuple(metrics.mcq_accuracy(spark.createDataFrame([], "is_correct boolean")).first()) == (0, 0, 0.0)
    assert spark.range(1).select(metrics.validated(F.lit("x"), F.lit("")).alias("a"), metrics.validated(F.lit("x")).alias("b")).first()["a"] == "missing input"
    assert "(no contexts retrieved)" in spark.range(1).select(rag.judge_prompt(F.lit("q"), F.lit("t"), F.lit("a"), F.array().cast("array<string>"))).first()[0]


def test_endpoint_shapes_and_judges(spark):
    rows = ['{"contexts": [{"content": "c", "text": "t"}], "answer": "a"}', '{"documents": [{"text": "t"}, "u"]}', '{"results": []}', '["x"]', "{}", "bad"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").select(metrics.normalise_reply(F.col("p")).alias("r")).select("r.*").collect()
    assert [(r.contexts, r.answer) for r in got] == [(["c"], "a"), (["t", "u"], "t"), ([], ""), (["x"], "x"), ([], ""), ([], "")]
    j = spark.createDataFrame([('{"answer_correctness": {"score": " 7 ", "reason": "r"}}',), ("nope",)], "p string").select(metrics.parse_judge(F.col("p")).alias("j")).select("j.*").collect()
    assert (j[0].answer_correctness_score, j[0].answer_correctness_reason, j[1].answer_correctness_score) == (7.0, "r", None)


def test_empty_evaluation_is_zero(spark):
    schema = "answer_correctness_score double, context_relevance_score double, latency_ms double, prompt_tokens long, completion_tokens long, total_tokens long"
    assert tuple(metrics.evaluation_summary(spark.createDataFrame([], schema)).first()) == (0.0, 0.0, 0.0, 0, 0, 0, 0)


def test_providers(spark):
    with pytest.raises(ValueError):
        providers.get("elsewhere")
    providers.register("Echo", lambda: providers.JsonOnly(providers.ExtractiveGenerator()))
    assert providers.get("echo").call(["Context: One. Two."]) == ["One."]
    rows = spark.createDataFrame([("the cat sat", "the cat sat down"), ("no", "something else")], "answer string, reference string")
    assert [r.score for r in rag.discrete_metric(rows, providers.get("passfail-offline")).orderBy("answer").collect()] == ["fail", "pass"]
    docs = spark.createDataFrame([(1, "Anna knows Bert. Bert likes green tea. Carl sleeps.")], "doc_id int, text string")
    g, bad = rag.knowledge_graph(docs, *map(providers.get, ("embed-offline", "propositions-offline", "triplets-offline")))
    assert {(r.src, r.type, r.dst) for r in g.edges.where("type <> 'MENTIONS'").collect()} == {("Anna", "KNOWS", "Bert"), ("Bert", "LIKES", "green tea")}
    assert rag.golden_set(docs, providers.get("questions-offline", questions=5)).count() == 2
    community = g.nodes.where("name is not null").select("id", F.lit(1).alias("community"))
    assert rag.community_reports(g, community, providers.get("generate-offline")).count() == 1


def test_verdicts_and_errors(spark):
    kind = "user_input string, reference string, response string, retrieved_contexts array<string>"
    rows = [("q", "tea is hot", "Tea is hot. Ice is red.", ["tea is very hot", "cold", "no"]), (None, "r", "r", ["c"]), ("q", "", "", ["c"]), ("q", "r", "r", []), ("q", "none such words", " ", ["a"])]
    df = spark.createDataFrame(rows, kind)
    got = rag.judged_context_precision(df, providers.get("verdict-offline")).collect()
    assert {(r.error, tuple(r.verdicts or ()), r.value) for r in got} == {(None, (1, 0, 0), 0.9999999999), ("user_input is missing", (), None), ("reference is missing", (), None), ("retrieved_contexts is missing", (), None), (None, (0,), 0.0)}
    got = {(r.error, tuple(r.statements or ()), tuple(r.verdicts or ()), str(r.value)) for r in rag.judged_faithfulness(df, providers.get("propositions-offline"), providers.get("verdict-offline")).collect()}
    assert got == {(None, ("Tea is hot.", "Ice is red."), (1, 0), "0.5"), ("user_input is missing", (), (), "None"), ("response is missing", (), (), "None"), ("retrieved_contexts is missing", (), (), "None"), (None, (), (), "nan")}


def test_endpoint_keys_decide_by_presence(spark):
    said = ['{"contexts": null, "documents": ["d"]}', '{"documents": ["d"], "results": ["r"]}', '{"results": [{"content": "", "text": "t"}]}', '["x"]', "plain words", '{"answer": "a"}', None]
    got = [tuple(r.r)[:2] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", metrics.normalise_reply(F.col("s")).alias("r")).orderBy("i").collect()]
    assert got == [([], ""), (["d"], "d"), (["t"], "t"), (["x"], "x"), ([], ""), ([], "a"), ([], "")]


def test_propositions_keep_their_places(spark):
    chunks = spark.createDataFrame([(1, 0, "A b c. D e f."), (1, 1, "G h i."), (2, 0, "")], "doc_id int, chunk_id int, chunk string")
    assert sorted(map(tuple, rag.listed_propositions(chunks, providers.get("propositions-offline")).collect())) == [(1, 0, 0, "A b c."), (1, 0, 1, "D e f."), (1, 1, 0, "G h i.")]


def test_kg_pipeline(spark):
    docs = spark.createDataFrame([(1, "Anna knows Bert. Bert likes tea."), (2, "Anna likes tea.")], "doc_id int, text string")
    make = lambda **o: rag.kg_pipeline(docs, *map(providers.get, ("embed-offline", "triplets-offline")), size=3, overlap=0, **o)
    edges = {tuple(r) for r in make().edges.collect()}
    assert edges == {
        ("1#0", "FROM_DOCUMENT", "1"), ("1#1", "FROM_DOCUMENT", "1"), ("2#0", "FROM_DOCUMENT", "2"), ("1#0", "NEXT_CHUNK", "1#1"),
        ("Anna", "KNOWS", "Bert"), ("Bert", "LIKES", "tea"), ("Anna", "LIKES", "tea"),
        ("Anna", "FROM_CHUNK", "1#0"), ("Bert", "FROM_CHUNK", "1#0"), ("Bert", "FROM_CHUNK", "1#1"), ("tea", "FROM_CHUNK", "1#1"), ("Anna", "FROM_CHUNK", "2#0"), ("tea", "FROM_CHUNK", "2#0"),
    }
    g = make(types=("KNOWS",))
    assert {(r.src, r.dst) for r in g.of_type("KNOWS", "LIKES").collect()} == {("Anna", "Bert")}
    assert {r.id: r.embedding is not None for r in g.nodes.collect()} == {"1": False, "2": False, "1#0": True, "1#1": True, "2#0": True, "Anna": False, "Bert": False}
    worded = rag.evaluate(spark.createDataFrame([("q", "a", "t", "s", "p", "k", "1")], "question string, answer string, question_type string, source string, persona string, task string, chunk_id string"), providers.get("generate-offline"), providers.get("generate-offline"), worded=True).first()
    assert worded.rag_answer == "q" and worded.answer_correctness_score is None


def test_discrete_prompts_extractors_and_presets(spark, tmp_path):
    from lattica.sources import sinks

    class Says:
        returns = "string"

        def call(self, texts):
            return [" PASS\n" if "every point" in t and '"answer":"a"' in t else "maybe" if "point by point" in t else "fail" for t in texts]

    rows = spark.createDataFrame([("a", "x"), ("b", "x")], "answer string, reference string")
    got = rag.discrete_experiments(rows, Says())
    assert {(r.answer, r.prompt, r.score) for r in got.collect()} == {("a", "strict", "pass"), ("b", "strict", "fail"), ("a", "lenient", "fail"), ("b", "lenient", "fail"), ("a", "reasoned", None), ("b", "reasoned", None)}
    assert {(r.prompt, r.score) for r in rag.discrete_experiments(spark.createDataFrame([("same words here", "same words here")], "answer string, reference string"), providers.get("passfail-offline")).collect()} == {(p, "pass") for p in rag.DISCRETE_PROMPTS}
    path = sinks.write_experiment(got.withColumn("all", F.array("answer", "raw")), str(tmp_path), "discrete_", "run1")
    assert path.endswith("/discrete_run1") and spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).count() == 6
    with pytest.raises(Exception, match="exists"):
        sinks.write_experiment(got, str(tmp_path), "discrete_", "run1")

    class Count:
        returns = "string"

        def call(self, texts):
            return [str(len(t.split()) - 1) for t in texts]

    docs = spark.createDataFrame([(1, "w " * 3000), (2, "w w"), (3, None)], "doc_id int, text string")
    made = {r.doc_id: (r.headline, r.summary, r.keyphrases) for r in rag.extracted(docs, {k: Count() for k in rag.EXTRACTED}).collect()}
    assert made == {1: ("300", "300", "2000"), 2: ("2", "2", "2"), 3: ("0", "0", "0")}
    assert [text.chunk_preset(docs, p).where("doc_id = 1").count() for p in ("report", "golden")] == [5, 3]
