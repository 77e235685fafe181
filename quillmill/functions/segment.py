"""Sentence segmentation with code-point places, by marks and quotation marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A sentence: anything up to a closing mark; what is quoted is taken whole, an open quotation to the end.
SENTENCE = r'(?:[^"「『。！？；]++|["「『][^"」』]*+(?:["」』]|\z))*+(?:[。！？；]|\z)'
SENTENCE_UNQUOTED = r"[^。！？；]*+(?:[。！？；]|\z)"
WEAK = "，、："


def _placed(pieces: Column, gap: int = 0) -> Column:
    """(text, start, end) structs of consecutive pieces with `gap` code points between them; prefix sums in one pass over
    short arrays."""
    n = F.transform(pieces, lambda x: F.length(x) + gap)
    start = lambda i: F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x)
    return F.transform(pieces, lambda x, i: F.struct(x.alias("text"), start(i).alias("start"), (start(i) + F.length(x)).alias("end")))


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text, start, end) of lines that aren't empty. Null texts have none. Line numbers count all lines.
    Places are running sums per text, which hold for any number of lines."""
    rows = df.select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "text"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("k").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before.cast("int")).withColumn("end", F.col("start") + F.length("text")).where("text <> ''").withColumnRenamed("k", key)


def split_sentences(df: DataFrame, key: str, text: str, quotes: bool = True) -> DataFrame:
    """(key, line_no, piece_no, text, start, end): sentences within lines, quotations kept whole if `quotes`."""
    found = F.filter(F.regexp_extract_all("line", F.lit(SENTENCE if quotes else SENTENCE_UNQUOTED), F.lit(0)), lambda x: F.length(x) > 0)
    lines = df.select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    pieces = lines.withColumn("p", F.when(F.col("line") == "", F.array(F.lit(""))).otherwise(found))
    rows = pieces.select("k", "line_no", F.size("p").alias("of"), F.posexplode("p").alias("piece_no", "text"))
    # One running sum over lines and pieces places both; a line end counts with the last piece of its line.
    n = F.length("text") + (F.col("piece_no") == F.col("of") - 1).cast("int")
    start = (F.sum("n").over(Window.partitionBy("k").orderBy("line_no", "piece_no")) - F.col("n")).cast("int")
    placed = rows.withColumn("n", n).withColumn("start", start).where("text <> ''")
    return placed.select(F.col("k").alias(key), "line_no", "piece_no", "text", "start", (F.col("start") + F.length("text")).alias("end"))


def cut_long(text: str, limit: int) -> list[str]:
    """A sentence over the limit, cut after the last weak mark in the second half of each full piece, else hard."""
    out, rest = [], text
    while len(rest) > limit:
        at = max((i for i in range(max(0, limit - limit // 2) + 1, limit) if rest[i] in WEAK), default=0)
        out.append(rest[: at + 1] if at else rest[:limit])
        rest = rest[len(out[-1]) :]
    return out + [rest] if rest else out


def split_long(sentences: DataFrame, limit: int = 128) -> DataFrame:
    """The sentences with those over `limit` cut; (.., piece_no, part_no, ..) orders them. Each cut depends on the one
    before, which no built-in expresses."""

    @F.pandas_udf("array<string>")
    def parts(s: pd.Series) -> pd.Series:
        return s.map(lambda x: cut_long(x, limit))

    keep = [c for c in sentences.columns if c not in ("text", "start", "end")]
    long = F.when(F.length("text") > limit, parts("text")).otherwise(F.array("text"))
    rows = sentences.withColumn("l", long).select(*keep, F.col("start").alias("s0"), F.posexplode(_placed(F.col("l"))).alias("part_no", "p"))
    return rows.select(*keep, "part_no", "p.text", (F.col("s0") + F.col("p.start")).cast("int").alias("start"), (F.col("s0") + F.col("p.end")).cast("int").alias("end"))


def merge_short(pieces: DataFrame, key: str, order: list[str], least: int = 5) -> DataFrame:
    """Pieces shorter than `least` join the piece before; those in front of the first long one are dropped. The end is
    start + length of the joined text, also where a line end between them was dropped. `sentence_id` numbers the result;
    blank ones are dropped afterwards, so that numbers may have gaps."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = pieces.withColumn("grp", F.sum((F.length("text") >= least).cast("int")).over(w)).where("grp > 0")
    joined = rows.groupBy(key, "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "").alias("text"), F.min("start").alias("start")
    )
    done = joined.select(key, (F.col("grp") - 1).cast("int").alias("sentence_id"), "text", F.col("start").alias("original_start"), (F.col("start") + F.length("text")).cast("int").alias("original_end"))
    return done.where(F.length(F.trim("text")) > 0)


def processed_sentences(df: DataFrame, key: str, text: str, limit: int = 128, least: int = 5) -> DataFrame:
    """Documents to sentence rows: lines, sentences, long ones cut, short ones joined."""
    return merge_short(split_long(split_sentences(df, key, text), limit), key, ["line_no", "piece_no", "part_no"], least)


def split_parallel(df: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """(key, pair_no, source, target): sentence pairs where both texts have as many sentences and similar lengths, else
    the whole pair as one."""
    s, t = F.col(source), F.col(target)
    cut = lambda c: F.filter(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), lambda x: F.length(x) > 0)
    similar = F.abs(F.length(s) - F.length(t)) <= 0.2 * F.length(s)
    pairs = F.when(similar & (F.size(cut(s)) == F.size(cut(t))), F.arrays_zip(cut(s).alias("source"), cut(t).alias("target"))).otherwise(
        F.array(F.struct(s.alias("source"), t.alias("target")))
    )
    return df.where(s.isNotNull() & t.isNotNull()).select(key, F.posexplode(pairs).alias("pair_no", "p")).select(key, "pair_no", "p.source", "p.target")
