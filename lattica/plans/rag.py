"""Question sets, evaluation and knowledge graphs from texts, as chains of DataFrames around providers.

Providers' replies are written once before they are used, so that no reply is asked for twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica import providers
from lattica.functions.metrics import context_precision, faithfulness, input_error, mcq_accuracy, mcq_choice, mcq_prompt, normalise_reply, parse_judge, plain_as_json, verdict
from lattica.functions.text import STRUCTURE_SEPARATORS, chunk, chunk_recursively, first_words, or_default, semantic_chunks, trim_white, words
from lattica.operators.graph import PropertyGraph, triplets_to_graph
from lattica.operators.retrieval import normalised, top_k
from lattica.plans.lineage import cut
from lattica.session import ship
from lattica.sources.readers import first_rows
from lattica.sources.sinks import QA_COLUMNS

_QA = "struct<qa: array<struct<question_type: string, question: string, answer: string, persona: string, task: string>>>"


def question_library(docs: DataFrame, writer: providers.Provider, kind: str = "token", size: int = 300, overlap: int = 50, source: str = "offline", human: DataFrame | None = None, retrieve: providers.Provider | None = None) -> DataFrame:
    """Questions about each chunk of docs (doc_id, text[, path]), then a human's; missing fields are '', a human's source 'human'."""
    ship(docs.sparkSession)
    path = F.col("path") if "path" in docs.columns else F.lit(None).cast("string")
    chunks = chunk(docs, kind, size, overlap).join(docs.select("doc_id", path.alias("file_path")), "doc_id")
    said = cut(chunks.withColumn("reply", providers.column(writer)(F.col("chunk"))))
    rows = said.select("*", F.explode(F.from_json("reply", _QA)["qa"]).alias("q"))
    text = lambda c: F.coalesce(F.col(f"q.{c}"), F.lit("")).alias(c)
    rows = rows.select(text("question_type"), F.lit(source).alias("source"), text("question"), text("answer"), "q.persona", "q.task", "chunk_id", "chunk", "file_path")
    if retrieve is None:
        rows = rows.withColumn("retrieved_contexts", F.lit(None).cast("array<string>"))
    else:
        rows = cut(rows.withColumn("retrieved_contexts", normalise_reply(providers.column(retrieve)(F.col("question")))["contexts"]))
    if human is not None:
        h = human
        for c, kind_of in rows.dtypes:
            if c not in h.columns:
                h = h.withColumn(c, F.lit(None).cast(kind_of))
        rows = rows.unionByName(h.withColumn("source", or_default(F.col("source"), F.lit("human"))).select(*rows.columns))
    return rows.select(*QA_COLUMNS)


def answer_questions(questions: DataFrame, chunks: DataFrame, embedder: providers.Provider, generator: providers.Provider, k: int = 5) -> DataFrame:
    """(question, reply, latency_ms): each different question answered from the k chunks (chunk_key, chunk) that are nearest to it.

    reply is a struct of contexts, best first, the generated answer, and counts of words as tokens. A question that no
    chunk is near, such as one without words, is answered from no context.
    """
    ship(questions.sparkSession)
    embed = providers.column(embedder)
    asked = questions.select("question").distinct()
    q = normalised(cut(asked.select(F.col("question").alias("query_id"), embed(F.col("question")).alias("e"))), "query_id", "e")
    items = normalised(cut(chunks.select(F.col("chunk_key").alias("item_id"), embed(F.col("chunk")).alias("e"))), "item_id", "e")
    hits = top_k(q, items, k).join(chunks.select(F.col("chunk_key").alias("item_id"), "chunk"), "item_id")
    near = hits.groupBy(F.col("query_id").alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("contexts"))
    known = asked.join(near, "question", "left").select("question", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nContext: "), F.array_join("contexts", "\n"))
    said = cut(known.withColumn("prompt", prompt).withColumn("said", providers.timed(generator)(F.col("prompt"))))
    n = lambda c: F.size(F.split(F.trim(c), r"\s+")).cast("long")
    reply = F.struct("contexts", F.col("said.reply").alias("answer"), n("prompt").alias("prompt_tokens"), n("said.reply").alias("completion_tokens"), (n("prompt") + n("said.reply")).alias("total_tokens"))
    return said.select("question", reply.alias("reply"), "said.latency_ms")


def evaluate(questions: DataFrame, rag: providers.Provider | DataFrame, judge: providers.Provider, worded: bool = False) -> DataFrame:
    """Each question (question, answer, and the columns of a question set) answered and judged.

    rag: a provider that replies in JSON or with a plain answer, or the answers themselves (see `answer_questions`). A
    provider's time is measured. The judge is asked in JSON, or, if worded, by `judge_prompt`.
    """
    ship(questions.sparkSession)
    if isinstance(rag, DataFrame):
        asked = questions.join(rag, "question")
    else:
        asked = questions.withColumn("said", providers.timed(rag)(F.col("question"))).withColumn("reply", normalise_reply(plain_as_json(F.col("said.reply")))).withColumn("latency_ms", F.col("said.latency_ms"))
    asked = cut(asked)
    data = F.to_json(F.struct("question", F.col("answer").alias("truth"), F.col("reply.answer").alias("answer"), F.col("reply.contexts").alias("contexts")))
    said = asked.withColumn("prompt", judge_prompt(F.col("question"), F.col("answer"), F.col("reply.answer"), F.col("reply.contexts")) if worded else data)
    judged = cut(said.withColumn("j", parse_judge(providers.column(judge)(F.col("prompt")))))
    total = F.col("reply.prompt_tokens") + F.col("reply.completion_tokens")
    return judged.select(
        "question", F.col("answer").alias("ground_truth_answer"), F.col("reply.answer").alias("rag_answer"), F.col("reply.contexts").alias("retrieved_contexts"),
        "j.*", "latency_ms", "reply.prompt_tokens", "reply.completion_tokens", total.alias("total_tokens"),
        "question_type", "source", "persona", "task", F.col("chunk_id").cast("string").try_cast("int").alias("chunk_id"),
    )


def judge_prompt(question: Column, truth: Column, answer: Column, contexts: Column) -> Column:
    """The text of a judge's prompt; contexts are set apart by lines of dashes."""
    joined = F.when(F.size(contexts) > 0, F.array_join(contexts, "\n---\n")).otherwise(F.lit("(no contexts retrieved)"))
    return F.concat(F.lit("Question: "), question, F.lit("\nExpected: "), truth, F.lit("\nAnswer: "), answer, F.lit("\nContexts:\n"), joined)


def _judged(parts: DataFrame, judge: providers.Provider, statement: str, context: Column) -> DataFrame:
    """(row, verdicts): the verdicts of each row's parts (row, pos, statement), in order."""
    asked = F.to_json(F.struct(F.col(statement).alias("statement"), context.alias("context")))
    said = cut(parts.withColumn("reply", providers.column(judge)(asked)))
    order = F.array_sort(F.collect_list(F.struct("pos", verdict(F.col("reply")).alias("v"))))
    return said.groupBy("row").agg(F.transform(order, lambda x: x["v"]).alias("verdicts"))


def judged_context_precision(rows: DataFrame, judge: providers.Provider) -> DataFrame:
    """rows (user_input, reference, retrieved_contexts, ...) with verdicts, value and error.

    A judge says of each context, by itself, whether it helps to arrive at the reference. A row that lacks one of the
    three inputs has the error that names the first and no value.
    """
    ship(rows.sparkSession)
    known = cut(rows.withColumns({"row": F.monotonically_increasing_id(), "error": input_error("user_input", "reference", "retrieved_contexts")}))
    parts = known.where("error is null").select("row", "reference", F.posexplode("retrieved_contexts").alias("pos", "context"))
    out = known.join(_judged(parts, judge, "reference", F.col("context")), "row", "left").withColumn("value", F.when(F.col("error").isNull(), context_precision(F.col("verdicts"))))
    return out.select(*rows.columns, "verdicts", "value", "error")


def judged_faithfulness(rows: DataFrame, statements: providers.Provider, judge: providers.Provider) -> DataFrame:
    """rows (user_input, response, retrieved_contexts, ...) with statements, verdicts, value and error.

    A response is taken apart into statements, and a judge says of each whether the contexts support it. Without
    statements the value is NaN; a row that lacks one of the three inputs has the error that names the first and no value.
    """
    ship(rows.sparkSession)
    known = rows.withColumns({"row": F.monotonically_increasing_id(), "error": input_error("user_input", "response", "retrieved_contexts")})
    known = cut(known.withColumn("statements", F.when(F.col("error").isNull(), F.coalesce(F.from_json(providers.column(statements)(F.col("response")), "struct<propositions: array<string>>")["propositions"], F.array().cast("array<string>")))))
    parts = known.select("row", "retrieved_contexts", F.posexplode("statements").alias("pos", "statement"))
    judged = known.join(_judged(parts, judge, "statement", F.array_join("retrieved_contexts", "\n")), "row", "left").withColumn("verdicts", F.when(F.col("error").isNull(), F.coalesce("verdicts", F.array().cast("array<int>"))))
    return judged.withColumn("value", F.when(F.col("error").isNull(), faithfulness(F.col("verdicts")))).select(*rows.columns, "statements", "verdicts", "value", "error")


def discrete_metric(rows: DataFrame, judge: providers.Provider, allowed: tuple[str, ...] = ("pass", "fail")) -> DataFrame:
    """rows (answer, reference, ...) with score, null where a judge says what isn't allowed."""
    ship(rows.sparkSession)
    said = providers.column(judge)(F.to_json(F.struct("answer", "reference")))
    return cut(rows.withColumn("score", said)).withColumn("score", F.when(F.col("score").isin(*allowed), F.col("score")))


#: Instructions of a pass-or-fail judge, by the name of the prompt.
DISCRETE_PROMPTS = {
    "strict": "Say pass if the answer agrees with the reference in every point, else fail.",
    "lenient": "Say pass if the answer holds what matters most in the reference, else fail.",
    "reasoned": "Compare the answer with the reference point by point, then say pass or fail.",
}


def discrete_experiments(rows: DataFrame, judge: providers.Provider, prompts: dict[str, str] | None = None, allowed: tuple[str, ...] = ("pass", "fail")) -> DataFrame:
    """rows (answer, reference, ...) once for each prompt, with prompt, score and raw; score is null where a judge says what isn't allowed."""
    ship(rows.sparkSession)
    prompts = prompts or DISCRETE_PROMPTS
    each = rows.withColumn("prompt", F.explode(F.array(*map(F.lit, prompts))))
    told = F.create_map(*[F.lit(x) for item in prompts.items() for x in item])[F.col("prompt")]
    said = cut(each.withColumn("raw", providers.column(judge)(F.to_json(F.struct(told.alias("instruction"), "answer", "reference")))))
    plain = F.lower(trim_white(F.col("raw")))
    return said.withColumn("score", F.when(plain.isin(*allowed), plain))


#: What is extracted from a text, and how many of its words an extractor sees at most.
EXTRACTED = {"headline": 300, "summary": 300, "keyphrases": 2000}


def extracted(docs: DataFrame, extractors: dict[str, providers.Provider], caps: dict[str, int] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with a column for each extractor, which sees the first words of a text up to its cap (see `EXTRACTED`)."""
    ship(docs.sparkSession)
    caps = {**EXTRACTED, **(caps or {})}
    return cut(docs.withColumns({name: providers.column(p)(F.concat(F.lit("Context: "), first_words(F.coalesce("text", F.lit("")), caps[name]))) for name, p in extractors.items()}))


def lexical_graph(docs: DataFrame, chunks: DataFrame) -> PropertyGraph:
    """Document and Chunk nodes with FROM_DOCUMENT edges and NEXT_CHUNK edges between neighbours."""
    node = lambda df, label, text: df.select("id", F.array(F.lit(label)).alias("labels"), text.alias("text"))
    chunk_id = F.concat_ws("#", "doc_id", "chunk_id")
    c = chunks.withColumn("id", chunk_id).withColumn("next", F.lead(chunk_id).over(Window.partitionBy("doc_id").orderBy("chunk_id")))
    nodes = node(docs.select(F.col("doc_id").cast("string").alias("id")), "Document", F.lit(None).cast("string")).unionByName(node(c, "Chunk", F.col("chunk")))
    edges = c.select(F.col("id").alias("src"), F.lit("FROM_DOCUMENT").alias("type"), F.col("doc_id").cast("string").alias("dst"))
    return PropertyGraph(nodes, edges.unionByName(c.where("next is not null").select(F.col("id").alias("src"), F.lit("NEXT_CHUNK").alias("type"), F.col("next").alias("dst"))))


def listed_propositions(chunks: DataFrame, propositions: providers.Provider) -> DataFrame:
    """(doc_id, segment, pos, proposition): what a provider takes from chunks (doc_id, chunk_id, chunk), with their places; replies that can't be read give none."""
    ship(chunks.sparkSession)
    said = cut(chunks.select("doc_id", F.col("chunk_id").alias("segment"), providers.column(propositions)(F.col("chunk")).alias("reply")))
    return said.select("doc_id", "segment", F.posexplode(F.from_json("reply", "struct<propositions: array<string>>")["propositions"]).alias("pos", "proposition"))


def kg_pipeline(docs: DataFrame, embedder: providers.Provider, triplets: providers.Provider, types: tuple[str, ...] | None = None, size: int = 200, overlap: int = 20) -> PropertyGraph:
    """The lexical graph of docs (doc_id, text) with embeddings on its chunks, and the entities found in them.

    Documents and chunks are linked by FROM_DOCUMENT and NEXT_CHUNK, entities to their chunks by FROM_CHUNK. types: a
    schema's relationship types; others are pruned, and entities that only they named. Entities of one name are one.
    """
    ship(docs.sparkSession)
    chunks = cut(chunk(docs, "token", size, overlap).withColumns({"embedding": providers.column(embedder)(F.col("chunk")), "reply": providers.column(triplets)(F.col("chunk"))}))
    lexical = lexical_graph(docs, chunks)
    chunk_id = F.concat_ws("#", "doc_id", "chunk_id")
    told = chunks.select(chunk_id.alias("chunk"), F.explode(F.from_json("reply", "struct<triplets: array<array<string>>>")["triplets"]).alias("triplet")).where(F.size("triplet") == 3)
    if types is not None:
        told = told.where(F.upper(F.replace(F.get("triplet", 1), F.lit(" "), F.lit("_"))).isin(*types))
    told = cut(told)
    entities, _ = triplets_to_graph(told)  # entities are their names, so those of one name are one already
    came = told.select(F.explode(F.array(F.get("triplet", 0), F.get("triplet", 2))).alias("src"), F.lit("FROM_CHUNK").alias("type"), F.col("chunk").alias("dst")).distinct()
    nodes = lexical.nodes.join(chunks.select(chunk_id.alias("id"), "embedding"), "id", "left")
    return PropertyGraph(nodes.unionByName(entities.nodes, allowMissingColumns=True), lexical.edges.unionByName(entities.edges).unionByName(came))


#: How texts and triplets are stored: in small files, so that many tasks can read what few have written.
FILES = {"maxRecordsPerFile": 2_000, "compression": "zstd"}


def knowledge_graph(docs: DataFrame, embedder: providers.Provider, propositions: providers.Provider, triplets: providers.Provider, size: int = 2000, overlap: int = 200) -> tuple[PropertyGraph, DataFrame]:
    """The resolved entity graph of docs (doc_id, text), with MENTIONS edges from chunks, and the replies that couldn't be read.

    Texts are cut at structure, then into propositions, which are grouped by meaning; triplets are taken from the groups.
    Each row of docs is a text by itself; chunks of equal doc_id and place are one node. Up to the triplets nothing is
    shuffled, and what providers reply is written in files of some rows, so that the next step's tasks don't depend on docs' files.
    """
    ship(docs.sparkSession)
    chunks = chunk_recursively(docs, size, overlap, STRUCTURE_SEPARATORS)
    said = F.from_json(providers.column(propositions)(F.col("chunk")), "struct<propositions: array<string>>")["propositions"]
    joined = cut(chunks.select(F.concat_ws("#", "doc_id", "chunk_id").alias("doc_id"), F.array_join(said, " ").alias("text")), **FILES)
    groups = semantic_chunks(joined.where("text <> ''"), providers.column(embedder))
    said = groups.select("doc_id", providers.column(triplets)(F.col("chunk")).alias("reply")).withColumn("t", F.from_json("reply", "struct<triplets: array<array<string>>>")["triplets"])
    told = cut(said.select("doc_id", "t", F.when(F.col("t").isNull(), F.col("reply")).alias("raw")), **FILES)
    rows = told.where("t is not null").select("doc_id", F.explode("t").alias("triplet"))
    graph, bad = triplets_to_graph(rows)  # entities are their names, so those of one name are one already
    mentions = rows.where(F.size("triplet") == 3).select(F.col("doc_id").alias("src"), F.lit("MENTIONS").alias("type"), F.explode(F.array(F.get("triplet", 0), F.get("triplet", 2))).alias("dst")).distinct()
    chunk_nodes = told.select(F.col("doc_id").alias("id")).distinct().select("id", F.array(F.lit("Chunk")).alias("labels"), F.lit(None).cast("string").alias("name"))
    quarantine = told.where("t is null").select("doc_id", "raw").unionByName(bad.select("doc_id", F.to_json("triplet").alias("raw")))
    return PropertyGraph(graph.nodes.unionByName(chunk_nodes), graph.edges.unionByName(mentions)), quarantine


def community_reports(graph: PropertyGraph, community: DataFrame, summarise: providers.Provider) -> DataFrame:
    """(community, report, tokens): a provider's summary of the names in each community."""
    ship(graph.nodes.sparkSession)
    names = graph.nodes.join(community, "id").groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("name")), ". ").alias("text"))
    done = cut(names.withColumn("report", providers.column(summarise)(F.concat(F.lit("Context: "), F.col("text")))))
    return done.select("community", "report", F.size(F.split("report", r"\s+")).alias("tokens"))


def _tokens(c: Column | str) -> Column:
    return F.size(words(F.col(c) if isinstance(c, str) else c)).cast("long")


def _to_budget(parts: DataFrame, budget: int, *order: Column) -> DataFrame:
    """(community, text): each community's parts (community, text, tokens) in order, joined while their tokens are within the budget.

    What a community takes, each of its shares of rows takes too, so shares are cut first: no task gets a whole large community.
    """
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = parts.withColumn("_share", F.spark_partition_id())
    some = shares.withColumn("_sum", F.sum("tokens").over(upto("community", "_share"))).where(F.col("_sum") <= budget)
    whole = some.withColumns({"_sum": F.sum("tokens").over(upto("community")), "_at": F.row_number().over(Window.partitionBy("community").orderBy(*order))}).where(F.col("_sum") <= budget)
    return whole.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), " ").alias("text"))


def hierarchy_reports(texts: DataFrame, members: DataFrame, summarise: providers.Provider, budget: int = 8000) -> DataFrame:
    """(level, community, report, tokens, full_tokens, replaced): reports for the communities of every level, from the finest up.

    texts: (id, text) of the graph's elements; members: (id, levels), each element's community on every level, which lie
    within each other. A community of the first level is described by its elements, longest first, as far as the budget
    of words goes. Above, a community's text is its subcommunities' texts; while that is above the budget, the longest is
    replaced by its report, and what is then still above the budget is left out, shortest last. Reports are cut at the
    budget too. Nulls are empty texts; ties go to the smaller id.
    """
    ship(texts.sparkSession)
    known = cut(members.join(texts, "id", "left").select("id", "levels", F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", _tokens("text")))
    depth = known.agg(F.max(F.size("levels"))).first()[0] or 0
    reports = below = None
    for k in range(depth):
        at = known.select(F.get("levels", k).alias("community"), *([] if k == 0 else [F.get("levels", k - 1).alias("child")]), "id", "text", "tokens")
        full = at.groupBy("community").agg(F.sum("tokens").alias("full_tokens"))
        if k == 0:
            context = _to_budget(at, budget, F.desc("tokens"), F.asc("id"))
            stated = full.join(context, "community", "left").select("community", "full_tokens", F.coalesce("text", F.lit("")).alias("context"), F.lit(0).cast("long").alias("replaced"))
            stated = stated.withColumn("whole", F.when(F.col("full_tokens") <= budget, F.col("context")))
        else:
            children = at.select("community", "child").distinct().join(below.select(F.col("community").alias("child"), F.col("full_tokens").alias("n"), "whole", "report", F.col("tokens").alias("m")), "child").join(full, "community")
            order = [F.desc("n"), F.asc("child")]
            saved = F.coalesce(F.sum(F.col("n") - F.col("m")).over(Window.partitionBy("community").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            children = cut(children.withColumn("gone", F.col("full_tokens") - saved > budget).withColumn("text", F.when(F.col("gone"), F.col("report")).otherwise(F.col("whole"))).withColumn("tokens", F.when(F.col("gone"), F.col("m")).otherwise(F.col("n"))))
            whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "child", F.when(F.col("full_tokens") <= budget, F.col("whole")).alias("whole")))), lambda x: x["whole"]), " ")
            stated = children.groupBy("community", "full_tokens").agg(F.sum(F.col("gone").cast("long")).alias("replaced"), whole.alias("whole"))
            stated = stated.join(_to_budget(children.select("community", "text", "tokens", "n", "child"), budget, *order), "community", "left")
            stated = stated.select("community", "full_tokens", F.coalesce("text", F.lit("")).alias("context"), "replaced", F.when(F.col("full_tokens") <= budget, F.col("whole")).alias("whole"))
        said = cut(stated.withColumn("report", providers.column(summarise)(F.concat(F.lit("Context: "), "context"))))
        said = said.withColumn("report", F.array_join(F.slice(words(F.coalesce("report", F.lit(""))), 1, budget), " ")).withColumn("tokens", _tokens("report"))
        below = cut(said)
        level = below.select(F.lit(k).alias("level"), "community", "report", "tokens", "full_tokens", "replaced")
        reports = level if reports is None else reports.unionByName(level)
    return reports


def golden_set(docs: DataFrame, writer: providers.Provider, size: int = 1024, per_context: int = 2, least: int = 5) -> DataFrame:
    """Questions with expected answers from contexts that are long enough, at most `per_context` for each context."""
    ship(docs.sparkSession)
    contexts = chunk(docs, "token", size, 0).where(F.size(F.split("chunk", r"\s+")) >= least)
    said = cut(contexts.withColumn("reply", providers.column(writer)(F.col("chunk"))))
    rows = said.select("doc_id", "chunk_id", "chunk", F.posexplode(F.from_json("reply", _QA)["qa"]).alias("pos", "q"))
    return rows.where(F.col("pos") < per_context).select("doc_id", "chunk_id", F.col("chunk").alias("context"), F.col("q.question").alias("input"), F.col("q.answer").alias("expected_output"))


def transformed_graph(docs: DataFrame, transformer: providers.Provider) -> PropertyGraph:
    """Nodes and relationships that a provider finds in docs (doc_id, text), labelled __Entity__, with MENTIONS edges from Document nodes."""
    ship(docs.sparkSession)
    schema = "struct<nodes: array<string>, relationships: array<array<string>>>"
    told = cut(docs.select("doc_id", "text", F.from_json(providers.column(transformer)(F.col("text")), schema).alias("g")))
    entity = told.select(F.explode("g.nodes").alias("id")).distinct().select("id", F.array(F.lit("__Entity__")).alias("labels"), F.col("id").alias("name"), F.lit(None).cast("string").alias("text"))
    source = told.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.array(F.lit("Document")).alias("labels"), F.lit(None).cast("string").alias("name"), "text")
    graph, _ = triplets_to_graph(told.select(F.explode("g.relationships").alias("triplet")))
    mentions = told.select(F.concat(F.lit("doc:"), "doc_id").alias("src"), F.lit("MENTIONS").alias("type"), F.explode("g.nodes").alias("dst")).distinct()
    return PropertyGraph(entity.unionByName(source), graph.edges.unionByName(mentions))


def claims(told: DataFrame) -> DataFrame:
    """(doc_id, subject, claim, since, until) of a provider's replies (doc_id, reply): JSON {"claims": [...]}; dates that can't be read are null."""
    schema = "struct<claims: array<struct<subject: string, claim: string, since: string, until: string>>>"
    rows = told.select("doc_id", F.explode(F.from_json("reply", schema)["claims"]).alias("c"))
    return rows.select("doc_id", "c.subject", "c.claim", F.col("c.since").try_cast("date").alias("since"), F.col("c.until").try_cast("date").alias("until"))


def multiple_choice_benchmark(samples: DataFrame, model: providers.Provider, sample: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """Results and their accuracy for samples (id, question, options map, correct): the first of them by id are asked, all for None or 0."""
    ship(samples.sparkSession)
    asked = first_rows(samples, sample, "id").withColumn("prompt", mcq_prompt(F.col("question"), F.col("options")))
    said = cut(asked.withColumn("reply", providers.column(model)(F.col("prompt"))))
    results = said.withColumn("choice", mcq_choice(F.col("reply"))).withColumn("is_correct", F.col("choice") == F.col("correct"))
    return results, mcq_accuracy(results)
