"""Character alignment of pairs: minimal edit scripts and the stdlib's matching blocks, as Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, DELETE, REPLACE, INSERT = range(4)
OPS = "array<struct<op_type:int,source_pos:int,target_pos:int,source_char:string,target_char:string>>"


def minimal_ops(source: str, target: str) -> list[tuple]:
    """A shortest script. Of several: the common start and end are kept, then walking back from the end keeping or
    replacing comes before deleting, deleting before inserting. Work is cut to a band that is doubled until it holds the
    distance."""
    a = 0
    while a < min(len(source), len(target)) and source[a] == target[a]:
        a += 1
    b = 0
    while b < min(len(source), len(target)) - a and source[-1 - b] == target[-1 - b]:
        b += 1
    s, t = source[a : len(source) - b], target[a : len(target) - b]
    ops = [(KEEP, i, i, c, c) for i, c in enumerate(source[:a])]
    n, m = len(s), len(t)
    band = max(1, abs(n - m))
    far = n + m + 1
    while True:
        rows = [{j: j for j in range(min(m, band) + 1)}]
        for i in range(1, n + 1):
            prev, row = rows[-1], {}
            for j in range(max(0, i - band), min(m, i + band) + 1):
                best = prev.get(j, far) + 1
                if j:
                    best = min(best, row.get(j - 1, far) + 1, prev.get(j - 1, far) + (s[i - 1] != t[j - 1]))
                row[j] = best
            rows.append(row)
        if rows[n].get(m, far) <= band or band >= max(n, m):
            break
        band *= 2
    i, j, back = n, m, []
    while i or j:
        here = rows[i][j]
        if i and j and rows[i - 1].get(j - 1, far) + (s[i - 1] != t[j - 1]) == here:
            i, j = i - 1, j - 1
            back.append((KEEP if s[i] == t[j] else REPLACE, a + i, a + j, s[i], t[j]))
        elif i and rows[i - 1].get(j, far) + 1 == here:
            i -= 1
            back.append((DELETE, a + i, -1, s[i], None))
        else:
            j -= 1
            back.append((INSERT, -1, a + j, None, t[j]))
    ops += back[::-1]
    return ops + [(KEEP, len(source) - b + i, len(target) - b + i, source[len(source) - b + i], target[len(target) - b + i]) for i in range(b)]


def block_ops(source: str, target: str) -> list[tuple]:
    """Ops from the stdlib's matching blocks; an uneven replacement is replacements, then deletions or insertions."""
    out = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, source, target).get_opcodes():
        if tag == "equal":
            out += [(KEEP, a + k, c + k, source[a + k], target[c + k]) for k in range(b - a)]
            continue
        both = min(b - a, d - c) if tag == "replace" else 0
        out += [(REPLACE, a + k, c + k, source[a + k], target[c + k]) for k in range(both)]
        out += [(DELETE, i, -1, source[i], None) for i in range(a + both, b)]
        out += [(INSERT, -1, j, None, target[j]) for j in range(c + both, d)]
    return out


def _ops_udf(work):
    @F.pandas_udf(OPS)
    def ops(s: pd.Series, t: pd.Series) -> pd.Series:
        names = ("op_type", "source_pos", "target_pos", "source_char", "target_char")
        return pd.Series([None if x is None or y is None else [dict(zip(names, o)) for o in work(x, y)] for x, y in zip(s, t)])

    return ops


def align(df: DataFrame, source: str, target: str, mode: str = "minimal") -> DataFrame:
    """`df` with `ops` and `edit_distance` (the number of ops that change something). A null side gives null ops."""
    ops = _ops_udf({"minimal": minimal_ops, "blocks": block_ops}[mode])(F.col(source), F.col(target))
    return df.withColumn("ops", ops).withColumn("edit_distance", F.size(F.filter("ops", lambda o: o["op_type"] != KEEP)))


def applied(ops: Column) -> Column:
    """The target that the ops make."""
    return F.array_join(F.transform(F.filter(ops, lambda o: o["op_type"] != DELETE), lambda o: F.coalesce(o["target_char"], o["source_char"])), "")


def op_counts(ops: Column) -> list[Column]:
    def of(k: int) -> Column:  # a second parameter of the lambda would be the place in the array
        return F.size(F.filter(ops, lambda o: o["op_type"] == k))

    return [of(k).alias(n) for k, n in enumerate(("n_keep", "n_delete", "n_replace", "n_insert"))]


def shown(ops: Column) -> Column:
    """The script for reading: a kept as it is, [-a], [a>b], [+b]."""
    return F.array_join(
        F.transform(
            ops,
            lambda o: F.when(o["op_type"] == DELETE, F.concat(F.lit("[-"), o["source_char"], F.lit("]")))
            .when(o["op_type"] == REPLACE, F.concat(F.lit("["), o["source_char"], F.lit(">"), o["target_char"], F.lit("]")))
            .when(o["op_type"] == INSERT, F.concat(F.lit("[+"), o["target_char"], F.lit("]")))
            .otherwise(o["source_char"]),
        ),
        "",
    )
