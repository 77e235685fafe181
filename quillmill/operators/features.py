"""Fixed-width training features of labelled pairs, over a vocabulary of characters."""

from __future__ import annotations

import json
import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, let

PAD, UNK, CLS, SEP, MASK, IGNORE = 0, 100, 101, 102, 103, -100
MOST_TOKENS = 100_000
VECTORS = {"input_ids": "h", "attention_mask": "b", "op_labels": "b", "insert_labels": "b", "template_input_ids": "h", "template_attention_mask": "b", "infill_labels": "h"}
INT = "array<int>"


class Vocabulary:
    """Token -> id as literals: characters of the basic plane by an array over code points, which is looked up in one
    step, other tokens by a map. vocab[column] is the id, or null. A vocabulary is bounded (MOST_TOKENS)."""

    def __init__(self, ids: dict[str, int]) -> None:
        plain = {ord(t): i for t, i in ids.items() if len(t) == 1 and ord(t) < 0x10000}
        self.size = max(plain, default=-1) + 1
        self.table = F.from_json(F.lit(json.dumps([plain.get(o) for o in range(self.size)])), "array<int>")
        self.rest = F.from_json(F.lit(json.dumps({t: i for t, i in ids.items() if len(t) != 1 or ord(t) >= 0x10000})), "map<string,int>")

    def __getitem__(self, token: Column) -> Column:
        point = F.ascii(token)
        return F.when((F.length(token) == 1) & (point < min(self.size, 0x10000)), F.get(self.table, point)).otherwise(self.rest[token])


def vocabulary(vocab: DataFrame) -> Vocabulary:
    rows = vocab.where("token is not null").select("token", "token_id").limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError("the vocabulary is too large for a literal")
    return Vocabulary({r.token: r.token_id for r in rows})


def char_ids(text: Column, vocab: Vocabulary) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.coalesce(vocab[c], F.lit(UNK)))).otherwise(F.array().cast(INT))


def _fit(a: Column, width: int, fill: int) -> Column:
    """`a` cut or filled up to `width`."""
    return F.slice(F.concat(a.cast(INT), F.array_repeat(F.lit(fill), width)), 1, width)


def encoded(text: Column, vocab: Vocabulary, width: int) -> Column:
    """[CLS] ids [SEP], with at most width - 2 ids, filled with [PAD]."""
    return _fit(F.concat(F.array(F.lit(CLS)), F.slice(char_ids(text, vocab), 1, width - 2), F.array(F.lit(SEP))), width, PAD)


def mask_of(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != PAD).cast("int"))


def padded_ops(ops: Column, width: int) -> Column:
    return _fit(F.concat(F.array(F.lit(IGNORE)), F.slice(ops.cast(INT), 1, width - 2), F.array(F.lit(IGNORE))), width, IGNORE)


def padded_inserts(inserts: Column, width: int) -> Column:
    return _fit(F.concat(F.array(F.lit(0)), F.slice(inserts.cast(INT), 1, width - 2), F.array(F.lit(0))), width, 0)


def sparse_features(tokens: Column, gold: Column, vocab: Vocabulary, width: int) -> tuple[Column, Column]:
    """(template ids, infill labels): the label of the i-th [MASK] is the i-th gold token's id, all else is ignored."""
    ids = F.transform(tokens, lambda t: F.when(t == "[MASK]", MASK).otherwise(F.coalesce(vocab[t], F.lit(UNK))))
    template = _fit(F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, width - 2), F.array(F.lit(SEP))), width, PAD)
    nth = lambda a, i: F.size(F.filter(F.slice(a, 1, i + 1), lambda x: x == MASK))
    labels = let(template, lambda t: F.transform(t, lambda x, i: F.when(x == MASK, F.coalesce(vocab[F.get(gold, nth(t, i) - 1)], F.lit(UNK))).otherwise(IGNORE)))
    return template, labels


def full_features(source: Column, target: Column, n: Column, vocab: Vocabulary, width: int) -> tuple[Column, Column]:
    """(template ids, infill labels) of [CLS] source [SEP] [MASK] x N [SEP], N cut to what is left of the width."""
    ids = F.slice(char_ids(source, vocab), 1, width - 3)
    room = F.greatest(F.lit(0), F.least(n, F.lit(width - 3) - F.size(ids)))
    wanted = char_ids(target, vocab)
    template = F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)), F.array_repeat(F.lit(MASK), room), F.array(F.lit(SEP)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(ids) + 2), F.slice(F.concat(wanted, F.array_repeat(F.lit(IGNORE), room)), F.lit(1), room))
    return _fit(template, width, PAD), _fit(labels, width, IGNORE)


def auxiliary_labels(ids: Column, ops: Column, key: Column, share: float = 0.15, seed: int = 42, epoch: int = 0) -> Column:
    """For int(share x kept) of the kept positions, chosen by hash, their own id; all else is ignored. Both arrays padded."""
    kept = F.filter(F.transform(ops, lambda o, i: F.when(o == 0, i)), lambda i: i.isNotNull())
    n = F.floor(F.size(kept) * share).cast("int")
    chosen = F.transform(F.slice(F.array_sort(F.transform(kept, lambda i: F.struct(draw(seed, epoch, key, "aux", i).alias("r"), i.alias("i")))), 1, n), lambda x: x["i"])
    return let(chosen, lambda c: F.transform(ids, lambda x, i: F.when(F.array_contains(c, i), x).otherwise(IGNORE)))


def packed(df: DataFrame, columns: dict[str, str] = VECTORS) -> DataFrame:
    """`df` with `record`: the vectors one after the other, little-endian, 2 or 1 bytes a value."""

    @F.pandas_udf("binary")
    def pack(*vectors: pd.Series) -> pd.Series:
        kinds = list(columns.values())
        return pd.Series([b"".join(struct.pack(f"<{len(v)}{k}", *map(int, v)) for v, k in zip(row, kinds)) if all(v is not None for v in row) else None for row in zip(*vectors)])

    return df.withColumn("record", pack(*map(F.col, columns)))


def unpacked(df: DataFrame, width: int, columns: dict[str, str] = VECTORS) -> DataFrame:
    """The vectors of `record`, back."""
    @F.pandas_udf(f"struct<{', '.join(f'{c}:array<int>' for c in columns)}>")
    def unpack(records: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in columns}
        for r in records:
            at = 0
            for c, k in columns.items():
                out[c].append(list(struct.unpack_from(f"<{width}{k}", r, at)) if r is not None else None)
                at += width * struct.calcsize(k)
        return pd.DataFrame(out)

    return reduce(lambda d, c: d.withColumn(c, F.col("_v")[c]), columns, df.withColumn("_v", unpack("record"))).drop("_v")


def shuffled(df: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """The rows of an epoch in an order of their own, the same whatever the partitions were: a range sort by draws."""
    return df.withColumn("_r", draw(seed, epoch, F.col(key))).orderBy("_r", key).drop("_r")


def shard_of(key: Column, shards: int, seed: int = 42) -> Column:
    """The rank that a row belongs to."""
    return (draw(seed, "shard", key) % shards).cast("int")


def batches(df: DataFrame, key: str, size: int, seed: int = 42, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """`df` with `batch` and `slot`: batches of `size` rows by draws, in groups of some 64 batches by the same
    draws, so that no order of all rows is made. `drop_last` leaves incomplete batches out."""
    n = max(1, df.count() // (64 * size))  # groups of some 64 batches
    h = draw(seed, epoch, "batch", F.col(key))
    w = Window.partitionBy("_g").orderBy("_h", key)
    out = df.withColumn("_h", h).withColumn("_g", F.col("_h") % n).withColumn("_r", F.row_number().over(w) - 1)
    out = out.withColumn("batch", F.concat_ws("-", "_g", F.floor(F.col("_r") / size))).withColumn("slot", F.col("_r") % size)
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("batch"))).where(F.col("_n") == size).drop("_n")
    return out.drop("_h", "_g", "_r")
