"""Table enrichment: feature joins, first values, counts and friendship queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def enrich(df: DataFrame, features: DataFrame, left: str, right: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """df with feature columns under a prefix, by a left join; repeated feature keys repeat rows."""
    f = features.select(F.col(right).alias("_k"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return df.join(f, df[left] == f["_k"], "left").drop("_k")


def first_by_group(df: DataFrame, key: str, columns: Sequence[str], order: Column) -> DataFrame:
    """For each key that isn't null the first value of each column that isn't null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def friends_of_friends(edges: DataFrame, person: Column) -> DataFrame:
    """(friend) for each way person -> x -> friend that doesn't end at the person; repeats and direct friends stay."""
    a = edges.select(F.col("src").alias("p"), F.col("dst").alias("x"))
    b = edges.select(F.col("src").alias("x"), F.col("dst").alias("friend"))
    return a.where(F.col("p") == person).join(b, "x").where("friend <> p").select("friend")


def collected(df: DataFrame, column: str) -> DataFrame:
    """One row: all different values of a column in order, and how many there are; none for an empty table."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().agg(F.array_sort(F.collect_list(column)).alias("all"), F.count("*").alias("n"))


def by_size(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """The order by an array's size: nulls are last ascending and first descending; an empty array has size 0."""
    size = F.when(F.col(column).isNotNull(), F.size(column))
    return [size.desc_nulls_first() if descending else size.asc_nulls_last()]


def datetime_of(text: Column) -> Column:
    """The moment that an ISO text names, in UTC unless it has an offset; null if it names none."""
    return F.try_to_timestamp(text)
