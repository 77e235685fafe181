"""Training labels and fill-in templates, from aligned pairs or straight from a known edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import DELETE, INSERT, REPLACE, align

MASK, UNK = "[MASK]", "[UNK]"
INT = "array<int>"


def _positions(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast(INT))


def with_owner(ops: Column) -> Column:
    """Ops with `owner`: the source position an insertion belongs to, the character to its left, or 0 in front."""
    return F.transform(
        ops, lambda o, i: F.struct(o["op_type"].alias("op"), o["source_pos"].alias("pos"), o["target_char"].alias("char"), F.coalesce(F.array_max(F.transform(F.slice(ops, 1, i + 1), lambda x: x["source_pos"])), F.lit(-1)).alias("left"))
    )


def planner_labels(df: DataFrame, source: str, ops: str = "ops", most: int = 3, delete: bool = True, insert: bool = True) -> DataFrame:
    """`df` with op_labels and insert_labels, one a source character. Insertions count for the character to their left, at
    most `most`; those in front count for character 0 and, if that is deleted, are added to the first that isn't."""
    o = F.col("_o")
    at = _positions(F.col(source))
    has = lambda i, k: F.exists(o, lambda x: (x["pos"] == i) & (x["op"] == k))
    op = F.transform(at, lambda i: F.when(has(i, DELETE) & F.lit(delete), 1).when(has(i, REPLACE), 2).otherwise(0))
    count = lambda i: F.size(F.filter(o, lambda x: (x["op"] == INSERT) & (F.greatest(x["left"], F.lit(0)) == i))) if insert else F.lit(0)
    first_kept = F.array_position(F.slice("op_labels", 2, F.size("op_labels")), 0)
    first_replaced = F.array_position(F.slice("op_labels", 2, F.size("op_labels")), 2)
    nearest = F.least(F.when(first_kept > 0, first_kept), F.when(first_replaced > 0, first_replaced))
    head = F.element_at("_c", 1)
    moved = F.when((F.size("op_labels") > 1) & (F.element_at("op_labels", 1) == 1) & (head > 0), nearest)
    return (
        df.withColumn("_o", with_owner(F.col(ops)))
        .withColumn("op_labels", op.cast(INT))
        .withColumn("_c", F.transform(at, count).cast(INT))
        .withColumn("insert_labels", F.transform("_c", lambda c, i: F.least(F.least(c, F.lit(most)) + F.when(i == moved, head).otherwise(0), F.lit(most))).cast(INT))
        .drop("_o", "_c")
    )


def gold_template(df: DataFrame, source: str, ops: str = "ops") -> DataFrame:
    """`df` with template_tokens, gold_tokens and mask_positions. Kept characters stand, replaced ones are masked, deleted
    ones vanish together with what would be inserted after them; a mask without a known character has [UNK]."""
    token = lambda t, g: F.struct(t.alias("t"), g.alias("g"))
    none = F.lit(None).cast("string")
    o = F.col("_o")

    def of(i: Column) -> Column:
        op = F.get("op_labels", i)
        char = F.substring(source, i + 1, F.lit(1))
        new = F.get(F.transform(F.filter(o, lambda x: (x["pos"] == i) & (x["op"] == REPLACE)), lambda x: x["char"]), F.lit(0))
        own = F.transform(F.filter(o, lambda x: (x["op"] == INSERT) & (F.greatest(x["left"], F.lit(0)) == i)), lambda x: x["char"])
        n = F.get("insert_labels", i)
        holes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: token(F.lit(MASK), F.coalesce(F.get(own, j), F.lit(UNK))))).otherwise(F.array().cast("array<struct<t:string,g:string>>"))
        return F.when(op == 1, F.array().cast("array<struct<t:string,g:string>>")).otherwise(F.concat(F.array(F.when(op == 2, token(F.lit(MASK), F.coalesce(new, F.lit(UNK)))).otherwise(token(char, none))), holes))

    rows = df.withColumn("_o", with_owner(F.col(ops))).withColumn("_t", F.flatten(F.transform(_positions(F.col(source)), of)))
    return _from_tokens(rows).drop("_o", "_t")


def _from_tokens(rows: DataFrame) -> DataFrame:
    t = F.col("_t")
    return (
        rows.withColumn("template_tokens", F.transform(t, lambda x: x["t"]))
        .withColumn("gold_tokens", F.transform(F.filter(t, lambda x: x["g"].isNotNull()), lambda x: x["g"]))
        .withColumn("mask_positions", F.filter(F.transform(t, lambda x, i: F.when(x["g"].isNotNull(), i)), lambda x: x.isNotNull()).cast(INT))
    )


def direct_labels(df: DataFrame, corrupted: str, edit: str) -> DataFrame:
    """`df` with labels and template of `corrupted` from the one edit that made it (position, type, original, error), or
    from none: no alignment. A deleted first character is asked for in front, though its label stands at 0."""
    s, e = F.col(corrupted), F.col(edit)
    at, p, kind = _positions(s), e["position"], F.coalesce(e["type"], F.lit(""))
    k = F.length(e["error"])
    op = F.transform(at, lambda i: F.when((kind == "M") & (i > p) & (i <= p + k), 1).when((kind == "R") & (i == p), 2).otherwise(0))
    ins = F.transform(at, lambda i: F.when((kind == "S") & (i == F.greatest(p - 1, F.lit(0))), 1).otherwise(0))
    token = lambda t, g: F.struct(t.alias("t"), g.alias("g"))
    none = F.lit(None).cast("string")
    chars = F.transform(at, lambda i: token(F.when((kind == "R") & (i == p), MASK).otherwise(F.substring(s, i + 1, F.lit(1))), F.when((kind == "R") & (i == p), e["original"]).otherwise(none)))
    hole = F.array(token(F.lit(MASK), e["original"]))
    tokens = (
        F.when(kind == "S", F.concat(F.slice(chars, 1, p), hole, F.slice(chars, p + 1, F.greatest(F.length(s), F.lit(1)))))
        .when(kind == "M", F.filter(chars, lambda x, i: ~((i > p) & (i <= p + k))))
        .otherwise(chars)
    )
    return _from_tokens(df.withColumn("op_labels", op.cast(INT)).withColumn("insert_labels", ins.cast(INT)).withColumn("_t", tokens)).drop("_t")


def target_length(ops: Column, inserts: Column) -> Column:
    """How long the target is by its labels: what isn't deleted, and what is inserted after it."""
    return F.aggregate(F.arrays_zip(ops.alias("o"), inserts.alias("i")), F.lit(0), lambda n, x: n + F.when(x["o"].isin(0, 2), 1 + F.greatest(x["i"].cast("int"), F.lit(0))).otherwise(0))


def labels_valid(source: Column, ops: Column, inserts: Column, most: int = 3) -> Column:
    return (F.size(ops) == F.length(source)) & (F.size(inserts) == F.length(source)) & F.forall(ops, lambda x: x.isin(0, 1, 2)) & F.forall(inserts, lambda x: x.between(0, most))


def template_valid(tokens: Column, gold: Column, masks: Column) -> Column:
    return (F.size(gold) == F.size(masks)) & F.forall(masks, lambda i: F.get(tokens, i) == MASK)


def processed(df: DataFrame, source: str, target: str, key: str, mode: str = "minimal", most: int = 3) -> DataFrame:
    """Pairs to labels and templates in one chain; `sample_id` comes from the key, never from the order of rows."""
    done = gold_template(planner_labels(align(df, source, target, mode), source, most=most), source)
    return done.withColumn("sample_id", F.concat(F.lit("sample_"), F.col(key).cast("string")))
