"""Texts in, corrections out: decision rules around a model that is plugged in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decide
from ..operators.features import MASK
from .config import Settings

EDITS = "array<struct<position:int,type:string,count:int>>"


@dataclass(frozen=True)
class Corrector:
    """`plan` takes (key, ids) to (key, p_op array<array<double>>, p_insert array<array<double>>), `fill` takes (key, ids)
    to (key, filled array<int>, confidence array<double>); both are functions of DataFrames, so a model may run in
    mapInPandas or a rule in built-ins. With `refine_rounds`, the least sure ids are masked and filled again."""

    plan: object
    fill: object
    settings: Settings = Settings()

    def templates(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """(key, ids, ops, inserts, template) of (key, ids), ids without special ones."""
        d = self.settings.decisions
        p = rows.join(self.plan(rows), key)
        ops = F.transform("p_op", lambda x: decide.op_decision(x, d.delete_at))
        inserts = F.transform("p_insert", lambda x: decide.insert_decision(x, d.insert_at, self.settings.labels.enable_insert))
        p = p.withColumn("ops", ops).withColumn("wanted", inserts).withColumn("inserts", decide.budgeted(F.col("ops"), F.col("wanted"), d.most_inserts, d.insert_ratio))
        template = decide.sparse_template(F.col("ids"), F.col("ops"), F.col("inserts"))
        if self.settings.features.full_mask:
            width = self.settings.features.width
            p = p.withColumn("ids", F.slice("ids", 1, width - 3))
            template = decide.full_template(F.col("ids"), decide.capped_length(F.col("ops"), F.col("wanted"), d.most_inserts, d.insert_ratio), width)
        return p.withColumn("template", template).select(key, "ids", "ops", "inserts", "template")

    def correct(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """(key, ids, prediction, confidence, is_changed, edits). Confidence is the mean over the final ids."""
        d = self.settings.decisions
        t = self.templates(rows, key)
        now = t.join(self.fill(t.select(key, F.col("template").alias("ids"))), key)
        if self.settings.features.full_mask:  # the target stands behind the source's [SEP]; nothing is refined
            n = F.size("ids") + 2
            now = now.withColumn("filled", F.slice("filled", n + 1, F.greatest(F.size("filled") - n, F.lit(0))))
        for _ in range(0 if self.settings.features.full_mask or not d.refine else d.refine_rounds):
            again = now.select(key, decide.remasked(F.col("filled"), decide.least_sure(F.col("filled"), F.col("confidence"), d.refine_ratio)).alias("ids"))
            now = now.drop("filled", "confidence").join(self.fill(again), key)
        own = F.filter("filled", lambda x: ~x.isin(0, 101, 102, MASK))
        return now.select(
            key, "ids", own.alias("prediction"), _mean(F.col("confidence")).alias("confidence"), (own != F.col("ids").cast("array<int>")).alias("is_changed"), _edits(F.col("ops"), F.col("inserts")).cast(EDITS).alias("edits")
        )

    def accept(self, rows: DataFrame, score: Column, key: str = "id") -> DataFrame:
        """Predictions that a verifier's score doesn't accept are the source again."""
        ok = decide.accepted(score, self.settings.decisions.accept_at)
        return rows.withColumn("prediction", F.when(ok, F.col("prediction")).otherwise(F.col("ids").cast("array<int>"))).withColumn("accepted", ok)


def _mean(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(c), F.lit(1))


def _edits(ops: Column, inserts: Column) -> Column:
    kind = F.create_map(F.lit(1), F.lit("DELETE"), F.lit(2), F.lit("REPLACE"))
    both = F.transform(
        F.arrays_zip(ops.alias("o"), inserts.alias("i")),
        lambda x, i: F.array(
            F.struct(i.cast("int").alias("position"), kind[x["o"]].alias("type"), F.lit(1).alias("count")), F.struct(i.cast("int").alias("position"), F.when(x["i"] > 0, "INSERT").alias("type"), x["i"].cast("int").alias("count"))
        ),
    )
    return F.filter(F.flatten(both), lambda e: e["type"].isNotNull())
