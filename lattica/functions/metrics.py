"""Evaluation as column expressions: verdict arithmetic, judge replies, multiple choice, and the aggregates over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHOICES = "ABCDE"


def context_precision(verdicts: Column) -> Column:
    """Average precision of ranked 0/1 verdicts: sum of v_k * precision at k, over their number + 1e-10."""
    at_k = F.transform(F.sequence(F.lit(1), F.size(verdicts)), lambda k: F.get(verdicts, k - 1) * F.aggregate(F.slice(verdicts, F.lit(1), k), F.lit(0.0), lambda t, v: t + v) / k)
    total = F.aggregate(verdicts, F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(verdicts) == 0, F.lit(0.0)).otherwise(F.aggregate(at_k, F.lit(0.0), lambda t, v: t + v) / (total + 1e-10))


def faithfulness(verdicts: Column) -> Column:
    """Supported statements over all; NaN without statements."""
    return F.when(F.size(verdicts) == 0, F.lit(float("nan"))).otherwise(F.aggregate(verdicts, F.lit(0.0), lambda t, v: t + v) / F.size(verdicts))


def token_f1(answer: Column, reference: Column) -> Column:
    """F1 of the words of two texts, counted with repeats; 0 if either has none."""
    from lattica.functions.text import words

    a, b = words(F.lower(F.coalesce(answer, F.lit("")))), words(F.lower(F.coalesce(reference, F.lit(""))))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda t, w: t + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def token_f1_of(rows: DataFrame, keys: Sequence[str], answer: str, reference: str) -> DataFrame:
    """(keys, f1): `token_f1` of two text columns, for texts of any length; rows of equal keys are one text each side.

    Words are counted by key before they meet, so the work follows the number of words, not its square.
    """
    from lattica.functions.text import words

    of = lambda c: words(F.lower(F.coalesce(F.col(c), F.lit(""))))
    sides = F.concat(*[F.transform(of(c), lambda w: F.struct(w.alias("w"), F.lit(x).alias("a"), F.lit(1 - x).alias("b"))) for c, x in ((answer, 1), (reference, 0))])
    counted = rows.select(*keys, F.explode(sides).alias("x")).groupBy(*keys, "x.w").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    total = counted.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.least("a", "b")).alias("common"))
    f1 = F.when((F.col("a") > 0) & (F.col("b") > 0), 2.0 * F.col("common") / (F.col("a") + F.col("b"))).otherwise(F.lit(0.0))
    found = total.select(*keys, f1.alias("f1"))
    return rows.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("f1", F.lit(0.0)).alias("f1"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<double> columns; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def answer_correctness(answer: Column, reference: Column, a_vec: Column, r_vec: Column, f1_weight: float = 0.75) -> Column:
    """Token F1 and the similarity of embeddings, weighted."""
    return f1_weight * token_f1(answer, reference) + (1 - f1_weight) * F.coalesce(cosine(a_vec, r_vec), F.lit(0.0))


def parse_judge(reply: Column) -> Column:
    """A struct of two scores and reasons from a judge's JSON; what is missing or malformed is null."""
    part = lambda k, f: F.get_json_object(reply, f"$.{k}.{f}")
    fields = []
    for k in ("answer_correctness", "context_relevance"):
        fields += [part(k, "score").try_cast("double").alias(f"{k}_score"), part(k, "reason").alias(f"{k}_reason")]
    return F.struct(*fields)


def normalise_reply(payload: Column) -> Column:
    """contexts (array<string>), answer and token counts of a retrieval endpoint's JSON.

    Contexts are the first of contexts, documents, results whose key is there, even with null, or the payload itself if
    it is a list; an item is its content, else its text, else itself. Without an answer the first context is it, or ''.
    Anything else than JSON is an empty answer (see `plain_as_json` for models that reply in plain text).
    """
    field = lambda k: F.get_json_object(payload, f"$.{k}")
    keys, listed = F.json_object_keys(payload), payload.rlike(r"^\s*\[")
    raw = F.when(listed, payload)
    for k in ("contexts", "documents", "results"):
        raw = raw.when(F.array_contains(keys, k), field(k))
    items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    text = F.transform(items, lambda x: F.coalesce(F.nullif(F.get_json_object(x, "$.content"), F.lit("")), F.nullif(F.get_json_object(x, "$.text"), F.lit("")), x))
    count = lambda k: F.coalesce(F.get_json_object(payload, f"$.token_usage.{k}").try_cast("long"), F.lit(0)).alias(k)
    answer = F.coalesce(F.nullif(field("answer"), F.lit("")), F.get(text, 0), F.lit(""))
    return F.struct(text.alias("contexts"), answer.alias("answer"), count("prompt_tokens"), count("completion_tokens"), count("total_tokens"))


def plain_as_json(reply: Column) -> Column:
    """A reply that is no JSON object or list as the answer of one."""
    return F.when(F.json_object_keys(reply).isNull() & ~reply.rlike(r"^\s*\["), F.to_json(F.struct(reply.alias("answer")))).otherwise(reply)


def mcq_prompt(question: Column, options: Column) -> Column:
    """The question and its lettered options; E only where it isn't empty."""
    lines = [F.when(F.coalesce(options[k], F.lit("")) != "", F.concat(F.lit(f"{k}) "), options[k])) if k == "E" else F.concat(F.lit(f"{k}) "), F.coalesce(options[k], F.lit(""))) for k in CHOICES]
    return F.concat_ws("\n", question, *lines, F.lit("Answer with one letter."))


def mcq_choice(answer: Column) -> Column:
    """The letter that begins an answer, else the first of A to E that it contains anywhere, else INVALID."""
    said = F.upper(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    out = F.when(said.startswith("A"), "A")
    for k in CHOICES[1:]:
        out = out.when(said.startswith(k), k)
    for k in CHOICES:
        out = out.when(said.contains(k), k)
    return out.otherwise("INVALID")


def mcq_accuracy(results: DataFrame, correct: str = "is_correct") -> DataFrame:
    """(total, correct, accuracy in percent); 0 for no rows."""
    n = F.coalesce(F.sum(F.col(correct).cast("int")), F.lit(0))
    return results.agg(F.count("*").alias("total"), n.alias("correct"), F.coalesce(F.try_divide(100.0 * n, F.count("*")), F.lit(0.0)).alias("accuracy"))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row of averages and sums; a null score counts as 0 and in the number of rows, and no rows give zeros."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias(f"avg_{c.removesuffix('_score')}")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return rows.agg(mean("answer_correctness_score"), mean("context_relevance_score"), mean("latency_ms"), total("prompt_tokens", "total_prompt_tokens"), total("completion_tokens", "total_completion_tokens"), total("total_tokens", "total_tokens"), F.count("*").alias("num_questions"))


#: Metrics by name: functions from a row's columns to a column.
METRICS: dict[str, Callable[..., Column]] = {"context_precision": context_precision, "faithfulness": faithfulness, "token_f1": token_f1, "answer_correctness": answer_correctness}


def register_metric(name: str, metric: Callable[..., Column]) -> None:
    """Adds a metric; a name that is taken is an error."""
    if name in METRICS:
        raise ValueError(f"metric {name!r} is registered")
    METRICS[name] = metric


def experiment(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """rows with experiment, the metric's name, value, and error where a required column is null or empty (value is null there)."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    wrong = validated(*[F.col(c) for c in columns])
    return rows.select("*", F.lit(name).alias("experiment"), F.when(wrong.isNull(), METRICS[name](*[F.col(c) for c in columns])).alias("value"), wrong.alias("error"))


def metric_result(value: Column, reasons: Column, **traces: Column) -> Column:
    """A struct of a metric's value, its reasons joined, and its traces."""
    return F.struct(value.alias("value"), F.array_join(reasons, ", ").alias("reason"), F.struct(*[c.alias(k) for k, c in traces.items()]).alias("traces"))


def validated(*required: Column) -> Column:
    """The first of several required text or array columns that is null or empty, as an error text; null if all are there."""
    out = F.lit(None).cast("string")
    for c in reversed(required):
        out = F.when(c.isNull() | (F.length(c.cast("string")) == 0), F.lit("missing input")).otherwise(out)
    return out


def input_error(*required: str) -> Column:
    """'<column> is missing' for the first of the required text or array columns that is null or empty; null if all are there."""
    out = F.lit(None).cast("string")
    for c in reversed(required):
        given = F.col(c)
        out = F.when(given.isNull() | (F.length(given.cast("string")) == 0) | (given.cast("string") == "[]"), F.lit(f"{c} is missing")).otherwise(out)
    return out


def verdict(reply: Column) -> Column:
    """1 or 0 of a judge's reply {"verdict": ...}; one that can't be read, or says something else, is 0."""
    said = F.lower(F.get_json_object(reply, "$.verdict"))
    return F.when(said.isin("1", "1.0", "true", "yes"), 1).otherwise(0)
