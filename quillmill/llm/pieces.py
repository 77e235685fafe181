"""Problem 2: texts over a limit, cut into overlapping pieces at natural boundaries.

Prefix sums of the units' lengths place every boundary; a binary search finds the last boundary under the limit; the
next piece starts the overlap before it. Where no boundary is in reach, the piece is cut hard at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import over_batches, spread, table

# A boundary lies after each of these, unless ASCII digits stand on both sides of it.
BREAKS = "。！？；，、：!?;, "
LIMIT, OVERLAP = 128, 16

_UNIT = re.compile(f"(?:[^{BREAKS}]|(?<=[0-9])[{BREAKS}](?=[0-9]))*[{BREAKS}]|(?:[^{BREAKS}]|(?<=[0-9])[{BREAKS}](?=[0-9]))+$", re.S)


def boundaries(text: str) -> list[int]:
    """The sorted places after which a cut is natural: prefix sums of the lengths of the units between them."""
    return list(accumulate(len(m) for m in _UNIT.findall(text))) if text else []


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], bool]:
    """The pieces' (start, end), and whether all but the last end at a boundary.

    To take the last boundary in reach is best: a piece that ends later reaches every end that an earlier one does.
    A piece must end more than the overlap behind its start, else the next one would not advance.
    """
    at, start, natural, pieces = boundaries(text), 0, True, []
    while len(text) - start > limit:
        i = bisect_right(at, start + limit) - 1
        if i >= 0 and at[i] > start + overlap:
            end = at[i]
        else:
            end, natural = start + limit, False
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, len(text))], natural


def pieces(df: DataFrame, key: str, text: str, start: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_id, piece_text, original_start, original_end, cut_kind) of every text; cut_kind is `whole` for a text
    within the limit, which is one piece, also when empty. A null text has no piece; with a null `start`, places count
    from 0. Texts of any length take time in proportion to it. `limit` must exceed `overlap`. Other columns of `df`,
    whatever their names, are not read."""
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    schema = pa.schema([("k", pa.int64()), ("piece_id", pa.int32()), ("piece_text", pa.string()), ("original_start", pa.int32()), ("original_end", pa.int32()), ("cut_kind", pa.string())])

    def work(batch):
        out = []
        for k, s, o in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found, natural = cut(s, limit, overlap)
            kind = "whole" if len(s) <= limit else "natural" if natural else "forced"
            out += [(k, i, s[a:b], (o or 0) + a, (o or 0) + b, kind) for i, (a, b) in enumerate(found)]
        return list(zip(*out)) if out else [[]] * 6

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(start).cast("int").alias("o")).where("t is not null")
    return over_batches(rows, work, schema, "k long, piece_id int, piece_text string, original_start int, original_end int, cut_kind string").withColumnRenamed("k", key)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of sentences as pieces within the limit."""
    return pieces(spread(table(spark, sf_dir, "sentences", ["seg_id", "text", "original_start"])), "seg_id", "text", "original_start")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows over the limit and how they can be cut; from the pieces themselves, so first pieces only are kept."""
    long = spread(table(spark, sf_dir, "sentences", ["seg_id", "text", "original_start"])).where(F.length("text") > LIMIT)
    return pieces(long, "seg_id", "text", "original_start").where("piece_id = 0").select("seg_id", "cut_kind")


# The rows over the limit are plain SQL; how each is cut follows from one piece to the next, hence the recursion.
ORACLES = {
    "p2_found": f"""
WITH RECURSIVE t AS (SELECT seg_id, text, length(text) AS n FROM sentences WHERE length(text) > {LIMIT}),
b AS (SELECT seg_id, i AS e FROM (SELECT seg_id, text, unnest(range(1, n + 1)) AS i FROM t)
      WHERE instr('{BREAKS}', substr(text, i, 1)) > 0
        AND NOT coalesce(regexp_full_match(substr(text, i - 1, 1), '[0-9]') AND i > 1 AND regexp_full_match(substr(text, i + 1, 1), '[0-9]'), false)),
w AS (SELECT t.seg_id, n, 0 AS s, true AS ok FROM t
      UNION ALL
      SELECT seg_id, n, e - {OVERLAP}, ok AND found FROM (
        SELECT w.seg_id, w.n, w.ok, coalesce(x.e, w.s + {LIMIT}) AS e, x.e IS NOT NULL AS found FROM w
        LEFT JOIN LATERAL (SELECT max(b.e) AS e FROM b WHERE b.seg_id = w.seg_id AND b.e > w.s + {OVERLAP} AND b.e <= w.s + {LIMIT}) x ON true
        WHERE w.n - w.s > {LIMIT}))
SELECT seg_id, CASE WHEN bool_and(ok) THEN 'natural' ELSE 'forced' END AS cut_kind FROM w GROUP BY seg_id"""
}
QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
