"""Voting and fusion over repeated reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the lowest of equals, and the share of its reads."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("votes").alias("reads"), F.count("*").alias("values")).select(
        *keys, F.col("b")[value].alias(value), F.col("b")["votes"].alias("votes"), "reads", "values", F.round(F.col("b")["votes"] / F.col("reads"), 6).alias("agreement"))


def first_to_lead(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value that reaches the highest count first, in the order of reads."""
    w = Window.partitionBy(*keys, value).orderBy(order)
    seen = df.withColumn("_seen", F.row_number().over(w))
    return seen.groupBy(*keys).agg(F.max_by(value, F.struct("_seen", -F.col(order))).alias(value), F.max("_seen").cast("long").alias("votes"))


def best_read(df: DataFrame, keys: list[str], good: str, order: str) -> DataFrame:
    """One read of each key: a good one before others, then the earliest."""
    w = Window.partitionBy(*keys).orderBy(F.col(good).desc(), F.col(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def stability(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of the commonest label and 1 - sum of squared shares."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg(F.round(F.max("n") / total, 6).alias("agree"), F.round(1 - F.sum(F.col("n") * F.col("n")) / (total * total), 6).alias("diversity"))
