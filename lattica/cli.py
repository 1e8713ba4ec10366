"""Command line: question sets from a text file, evaluation of a logged question set, and the multiple-choice benchmark."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica import providers
from lattica.functions.metrics import evaluation_summary
from lattica.plans import rag, testsets
from lattica.sources import readers, sinks


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("questions", help="write questions about a text file")
    ask.add_argument("path")
    ask.add_argument("--splitter", default="token")
    ask.add_argument("--size", type=int, default=400)
    ask.add_argument("--overlap", type=int, default=50)
    ask.add_argument("--writer", default="questions-offline")
    judge = commands.add_parser("evaluate", help="evaluate the question set of a run")
    judge.add_argument("--rag", default="generate-offline")
    judge.add_argument("--judge", default="judge-offline")
    choose = commands.add_parser("benchmark", help="multiple choice over a Parquet table (id, question, options, correct)")
    choose.add_argument("path")
    choose.add_argument("--sample", type=int, default=10)
    choose.add_argument("--model", default="generate-offline")
    choose.add_argument("--split", choices=["train", "test", "validation"], help="rows of one split, by a column split or else by a hash of id")
    for p in (ask, judge, choose):
        p.add_argument("--run", required=True, help="the run's folder")
    a = parser.parse_args(words)
    spark = spark or SparkSession.builder.getOrCreate()
    run = sinks.Run(spark, a.run)
    run.log_parameters(vars(a))
    if a.command == "questions":
        docs = readers.Readers().load(spark, a.path).select(F.lit(0).alias("doc_id"), "text", "path")
        run.log_table("questions", rag.question_library(docs, providers.get(a.writer), a.splitter, a.size, a.overlap))
    elif a.command == "evaluate":
        rows = rag.evaluate(readers.load_run_table(spark, a.run, "questions"), providers.get(a.rag), providers.get(a.judge))
        run.log_table("evaluation", rows)
        run.log_metrics(evaluation_summary(rows).first().asDict())
    else:
        samples = spark.read.parquet(a.path)
        if a.split:
            samples = samples.where((F.col("split") if "split" in samples.columns else testsets.split_of(F.col("id"))) == a.split)
        results, accuracy = rag.multiple_choice_benchmark(samples, providers.get(a.model), a.sample)
        run.log_table("answers", results)
        run.log_metrics(accuracy.first().asDict())
    run.end()


if __name__ == "__main__":
    main()
