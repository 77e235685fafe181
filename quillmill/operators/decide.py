"""Decision rules at prediction time: thresholds, budgets, templates, refinement, acceptance and edits; and schedules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import let
from .features import CLS, MASK, PAD, SEP

INT = "array<int>"


def argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def op_decision(p: Column, least: float = 0.5) -> Column:
    """The likeliest op; a deletion less likely than `least` is no change."""
    best = argmax(p)
    return F.when((best == 1) & (F.get(p, F.lit(1)) < least), 0).otherwise(best)


def insert_decision(p: Column, least: float = 0.5, enabled: bool = True) -> Column:
    """The likeliest count of insertions if any is likely enough."""
    return F.when(1 - F.get(p, F.lit(0)) >= least, argmax(p)).otherwise(0) if enabled else F.lit(0)


def insert_cap(n: Column, most: int = 6, ratio: float = 0.1) -> Column:
    return F.least(F.lit(most), F.floor(n * ratio).cast("int") + 1)


def budgeted(ops: Column, inserts: Column, most: int = 6, ratio: float = 0.1) -> Column:
    """Insertions under one budget for the sentence, spent from left to right; none after a deletion."""
    cap = insert_cap(F.size(ops), most, ratio)
    wanted = F.zip_with(ops, inserts, lambda o, i: F.when(o != 1, F.greatest(i, F.lit(0))).otherwise(0))
    before = lambda w, k: F.aggregate(F.slice(w, 1, k), F.lit(0), lambda a, x: a + x)
    return let(wanted, lambda w: F.transform(w, lambda x, k: F.greatest(F.lit(0), F.least(x, cap - F.least(before(w, k), cap)))))


def sparse_template(ids: Column, ops: Column, inserts: Column) -> Column:
    """[CLS], each kept id, a [MASK] for each replaced one and for each insertion after it, [SEP]."""
    part = lambda x, i: F.concat(
        F.when(F.get(ops, i) == 0, F.array(x)).when(F.get(ops, i) == 2, F.array(F.lit(MASK))).otherwise(F.array().cast(INT)), F.array_repeat(F.lit(MASK), F.get(inserts, i))
    )
    return F.concat(F.array(F.lit(CLS)), F.flatten(F.transform(ids, part)), F.array(F.lit(SEP)))


def source_to_template(ops: Column, inserts: Column) -> Column:
    """For each source id its place in the sparse template ([CLS] is 0), or -1 if it is deleted. `inserts` are budgeted."""
    def of(w: Column) -> Column:
        upto = lambda i: F.aggregate(F.slice(w, 1, i), F.lit(1), lambda a, x: a + x["n"])
        return F.transform(w, lambda x, i: F.when(x["here"], upto(i)).otherwise(-1))

    return let(F.zip_with(ops, inserts, lambda o, i: F.struct((F.when(o.isin(0, 2), 1).otherwise(0) + i.cast("int")).alias("n"), o.isin(0, 2).alias("here"))), of)


def padded_batches(rows: DataFrame, batch: str, template: str, width: int = 512) -> DataFrame:
    """`rows` with template and `mask` filled with [PAD] to the longest template of their batch, `width` at most."""
    longest = rows.groupBy(batch).agg(F.least(F.max(F.size(template)), F.lit(width)).alias("_w"))
    fit = lambda a, w, x: F.slice(F.concat(a, F.array_repeat(F.lit(x), w)), F.lit(1), w)
    out = rows.join(longest, batch)
    ones = F.transform(template, lambda x: F.lit(1))
    return out.withColumn("mask", fit(ones, F.col("_w"), 0)).withColumn(template, fit(F.col(template).cast(INT), F.col("_w"), PAD)).drop("_w")


def class_weights(most: int = 3, keep: float = 1.0, delete: float = 3.0, replace: float = 2.0, none: float = 1.0, some: float = 5.0) -> tuple[Column, Column]:
    """Weights of the ops and of the counts of insertions, by label."""
    return F.array(*map(F.lit, (keep, delete, replace))), F.array(*map(F.lit, (none, *[some] * most)))


def weighted_error(predicted: Column, true: Column, weights: Column) -> Column:
    """The share of the weight of all labels that stands on wrong ones; ignored labels weigh nothing."""
    both = F.filter(F.zip_with(predicted, true, lambda p, t: F.struct(p.cast("int").alias("p"), t.cast("int").alias("t"))), lambda x: x["t"] >= 0)
    weight = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(weights, x["t"]))
    return let(both, lambda b: F.try_divide(weight(F.filter(b, lambda x: x["p"] != x["t"])), weight(b)))


def capped_length(ops: Column, inserts: Column, most: int = 6, ratio: float = 0.1) -> Column:
    """Target length with the cap on each position's insertions, not on their sum; ignored labels count nothing."""
    cap = insert_cap(F.size(ops), most, ratio)
    return F.aggregate(F.arrays_zip(ops.alias("o"), inserts.alias("i")), F.lit(0), lambda n, x: n + F.when(x["o"].isin(0, 2), 1 + F.least(F.greatest(x["i"], F.lit(0)), cap)).otherwise(0))


def full_template(ids: Column, n: Column, width: int) -> Column:
    """[CLS] ids [SEP] [MASK] x n [SEP] within `width`."""
    own = F.slice(ids, 1, width - 3)
    room = F.greatest(F.lit(0), F.least(n, F.lit(width - 3) - F.size(own)))
    return F.concat(F.array(F.lit(CLS)), own, F.array(F.lit(SEP)), F.array_repeat(F.lit(MASK), room), F.array(F.lit(SEP)))


def least_sure(ids: Column, confidence: Column, ratio: float = 0.15) -> Column:
    """Positions of the max(1, int(n x ratio)) least sure ids that aren't special, in order of confidence, then place."""
    real = F.filter(F.zip_with(ids, confidence, lambda x, c: F.struct(x.alias("x"), c.alias("c"))), lambda z: z["x"].isNotNull())
    placed = F.filter(F.transform(real, lambda z, i: F.struct(z["c"].alias("c"), i.alias("i"), z["x"].alias("x"))), lambda z: ~z["x"].isin(PAD, CLS, SEP))
    n = F.greatest(F.lit(1), F.floor(F.size(placed) * ratio).cast("int"))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda z: z["i"])


def remasked(ids: Column, positions: Column) -> Column:
    return F.transform(ids, lambda x, i: F.when(F.array_contains(positions, i), MASK).otherwise(x))


def filled(template: Column, predicted: Column) -> Column:
    """Predictions in place of [MASK]s only."""
    return F.zip_with(template, predicted, lambda t, p: F.when(t == MASK, p).otherwise(t))


def top_tokens(p: Column, k: int = 5) -> Column:
    """The k likeliest tokens as (token, p), the lower token first at a tie."""
    rows = F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("token")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(x["token"].alias("token"), (-x["m"]).alias("p")))


def accepted(p: Column, least: float = 0.5) -> Column:
    return p > least


def accepted_edits(edits: Column, p: Column, least: float = 0.5) -> Column:
    """The edits whose own probability is accepted; without one there is none."""
    return F.transform(F.filter(F.zip_with(edits, p, lambda e, x: F.struct(e.alias("e"), x.alias("p"))), lambda z: z["p"] > least), lambda z: z["e"])


def extracted_edits(df: DataFrame, key: str, source: str, ops: str, inserts: str) -> DataFrame:
    """(key, position, type, source_char, count): an edit for each op that changes something and for each insertion."""
    names = F.create_map(F.lit(1), F.lit("DELETE"), F.lit(2), F.lit("REPLACE"))
    edits = F.flatten(
        F.transform(
            F.arrays_zip(F.col(ops).alias("o"), F.col(inserts).alias("i")),
            lambda x, i: F.filter(
                F.array(
                    F.struct(i.alias("position"), names[x["o"].cast("int")].alias("type"), F.lit(1).alias("count")), F.struct(i.alias("position"), F.when(x["i"] > 0, "INSERT").alias("type"), x["i"].cast("int").alias("count"))
                ),
                lambda e: e["type"].isNotNull(),
            ),
        )
    )
    rows = df.select(key, F.col(source).alias("s"), F.explode(edits).alias("e"))
    return rows.select(key, "e.position", "e.type", F.substring("s", F.col("e.position") + 1, F.lit(1)).alias("source_char"), "e.count")


def learning_rate(step: Column, warmup: int, total: int, kind: str = "linear") -> Column:
    """Factor of the rate at a step: a linear rise, then linear or cosine decay, or none."""
    import math

    rest = {
        "linear": F.greatest(F.lit(0.0), (total - step) / max(1, total - warmup)),
        "cosine": F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / max(1, total - warmup)))),
        "constant": F.lit(1.0),
    }[kind]
    return F.when(step < warmup, step / max(1, warmup)).otherwise(rest)


def sampling_ratio(step: Column, start: float, end: float, total: int, kind: str = "linear") -> Column:
    """Share of own predictions used at a step, from `start` to `end` in `total` steps."""
    import math

    done = F.least(F.lit(1.0), step / max(1, total))
    return start + (end - start) * (done if kind == "linear" else 0.5 * (1 - F.cos(F.lit(math.pi) * done)))


Predictor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def predict(df: DataFrame, predictor: Predictor, schema: str) -> DataFrame:
    """The plug for a model: batches of rows in, batches of `schema` out."""
    return df.mapInPandas(predictor, schema)
