"""Confusion sets as a table (char, confusion, type, weight, ord); `ord` keeps the order of entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_from_entries(entries: DataFrame) -> DataFrame:
    """Rows of (char, confusions[, confusion_type, weights, entry_id]) to pairs; null chars and members are dropped, a
    missing weight is 1."""
    rows = entries.where("char is not null").select("entry_id", "char", F.col("confusion_type").alias("type"), "weights", F.posexplode("confusions").alias("pos", "confusion"))
    return rows.where("confusion is not null").select("char", "confusion", "type", F.coalesce(F.get("weights", F.col("pos")), F.lit(1.0)).alias("weight"), (F.shiftleft(F.col("entry_id").cast("long"), 20) + F.col("pos")).alias("ord"))


def lookup(pairs: DataFrame, type: str | None = None, most: int | None = None) -> DataFrame:
    """(char, confusions): per char the distinct confusions in order of first entry, of one type if given, `most` at most."""
    rows = pairs if type is None else pairs.where(F.col("type") == type)
    first = rows.groupBy("char", "confusion").agg(F.min("ord").alias("ord"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "confusion"))), lambda x: x["confusion"])
    return first.groupBy("char").agg((F.slice(ordered, 1, most) if most else ordered).alias("confusions"))


def stats(pairs: DataFrame) -> DataFrame:
    """(type, n_pairs, n_chars), and a row with type null for all; pairs count with repetitions."""
    return pairs.select("char", F.coalesce("type", F.lit("none")).alias("type")).rollup("type").agg(F.count("*").alias("n_pairs"), F.countDistinct("char").alias("n_chars"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(char, confusion) of either set, once."""
    return a.select("char", "confusion").union(b.select("char", "confusion")).distinct()


def from_raw_fields(lines: DataFrame, col: str = "value") -> DataFrame:
    """Raw stroke or sound files: a head and fields of characters, each of which is a confusion; the head itself, comments
    and blank lines are left out."""
    rows = lines.select(F.trim(col).alias("l")).where("l <> '' and not l like '#%'").select(F.split("l", "\t", -1).alias("f"))
    chars = F.flatten(F.transform(F.slice("f", 2, 1 << 20), lambda x: F.split(x, "")))
    return rows.select(F.element_at("f", 1).alias("char"), F.explode(chars).alias("confusion")).where("confusion <> '' and confusion <> char").distinct()


def from_table(rows: DataFrame, type: str, order: str) -> DataFrame:
    """A built-in or own table (char, confusions) as pairs of one type, with weight 1. Of a repeated char the last row, by
    `order`, holds."""
    last = rows.where("char is not null").groupBy("char").agg(F.max_by("confusions", order).alias("confusions"), F.max(order).alias("o"))
    pairs = last.select("char", "o", F.posexplode("confusions").alias("pos", "confusion")).where("confusion is not null")
    return pairs.select("char", "confusion", F.lit(type).alias("type"), F.lit(1.0).alias("weight"), (F.shiftleft(F.col("o").cast("long"), 20) + F.col("pos")).alias("ord"))


def confusion_set(shape: DataFrame | None = None, pinyin: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """The pairs of a shape table, of a pinyin table and of more pairs, in this order; any may be left out (a set of shapes
    only, of sounds only, or of a file's pairs only)."""
    parts = [p.withColumn("_k", F.lit(k)) for k, p in enumerate((shape, pinyin, more)) if p is not None]
    if not parts:
        raise ValueError("no table is given")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("char", "confusion", "type", "weight", (F.col("ord") + F.shiftleft(F.col("_k").cast("long"), 56)).alias("ord"))


def added(pairs: DataFrame, new: DataFrame, type: str = "custom") -> DataFrame:
    """The pairs with (char, confusion) of `new` behind them, of one type and weight 1."""
    more = new.select("char", "confusion", F.lit(type).alias("type"), F.lit(1.0).alias("weight"), (F.lit(1) * (1 << 62)).cast("long").alias("ord"))
    return pairs.unionByName(more)
