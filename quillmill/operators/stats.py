"""Statistics of corpora, samples and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corruption_stats(rows: DataFrame) -> DataFrame:
    """(total, corrupted, rate, avg_edits of the corrupted); of an empty table zero, zero and nulls."""
    n, bad = F.count("*"), F.count_if("is_corrupted")
    return rows.agg(n.alias("total"), bad.alias("corrupted"), F.round(F.try_divide(bad, n), 6).alias("rate"), F.round(F.avg(F.when(F.col("is_corrupted"), F.col("num_edits"))), 6).alias("avg_edits"))


def edit_types(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("edits").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def sample_kinds(rows: DataFrame) -> DataFrame:
    """(kind, n): by labels, an insertion means a deleted character (S), else a deletion a repeated one (M), else a
    replacement (R); none of them is a positive."""
    kind = (
        F.when(F.exists("insert_labels", lambda x: x > 0), "S").when(F.array_contains(F.col("op_labels").cast("array<int>"), 1), "M").when(F.array_contains(F.col("op_labels").cast("array<int>"), 2), "R").otherwise("positive")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def changed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "split").agg(F.count("*").alias("n"), F.count_if(F.col("original") != F.col("corrupted")).alias("n_changed"))


def f_score(predicted: DataFrame, true: DataFrame, key: list[str], beta: float = 0.5) -> DataFrame:
    """(n_predicted, n_true, n_right, precision, recall, f_half) of distinct edits; null where nothing was predicted."""
    p, t = predicted.select(*key).distinct().withColumn("p", F.lit(1)), true.select(*key).distinct().withColumn("t", F.lit(1))
    n = p.join(t, key, "full").agg(F.count("p").alias("n_predicted"), F.count("t").alias("n_true"), F.count(F.col("p") + F.col("t")).alias("n_right"))
    precision, recall = F.try_divide("n_right", "n_predicted"), F.try_divide("n_right", "n_true")
    b = beta * beta
    return n.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide((1 + b) * precision * recall, b * precision + recall), 6).alias("f_half"))


def mean_losses(batches: DataFrame, key: list[str], losses: list[str]) -> DataFrame:
    """The mean over batches of each loss by `key`; 0 where no batch has a positive one."""
    mean = lambda c: F.when(F.sum(c) > 0, F.sum(c) / F.count("*")).otherwise(0.0)
    return batches.groupBy(*key).agg(*[mean(c).alias(c) for c in losses])
