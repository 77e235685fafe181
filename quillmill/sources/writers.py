"""Writers: samples, frozen sets, confusion sets, predictions and fixed-width records."""

from __future__ import annotations

import json
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import VECTORS, packed
from ..runtime import checkpointed


def write_samples(samples: DataFrame, path: str) -> None:
    """JSON lines by split, which readers of one split prune to."""
    samples.write.partitionBy("split").mode("overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """A small report (one row, or a row a group) as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def _line(rows: DataFrame, line: str) -> DataFrame:
    """One line, in one partition, in the session of `rows`."""
    return rows.sparkSession.range(1, numPartitions=1).select(F.lit(line).alias("value"))


def write_frozen(rows: DataFrame, path: str, fmt: str = "jsonl") -> None:
    out = rows.select("source", "target", "is_corrupted", "num_edits")
    if fmt == "tsv":
        out.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)
    elif fmt == "json":  # the files, one after the other, are one array; no task holds all rows
        rows = checkpointed(out.select(F.to_json(F.struct("*")).alias("v"), F.monotonically_increasing_id().alias("i")))
        first = rows.agg(F.min("i")).first()[0]
        end = _line(rows, "]" if first is not None else "[]")
        rows.select(F.concat(F.when(F.col("i") == F.lit(first), "[").otherwise(","), "v").alias("value")).unionAll(end).write.mode("overwrite").text(path)
    elif fmt == "jsonl":
        out.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_confusions(lookup: DataFrame, path: str, fmt: str = "tsv") -> None:
    """(char, confusions), sorted by char."""
    rows = lookup.orderBy("char")
    if fmt == "tsv":
        _line(rows, "# char, confusions").unionAll(rows.select(F.concat_ws("\t", "char", "confusions").alias("value"))).write.mode("overwrite").text(path)
    elif fmt in ("json", "jsonl"):
        rows.select("char", "confusions").write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_predictions(rows: DataFrame, path: str, fmt: str = "json", only_changed: bool = False, edits: bool = False) -> None:
    if only_changed:
        rows = rows.where("source <> prediction")
    if fmt == "json":
        keep = ["source", "prediction", "is_changed", "confidence"] + ["edits"] * edits
        rows.select(*[c for c in keep if c in rows.columns]).write.mode("overwrite").json(path)
    elif fmt in ("parallel", "txt"):
        rows.select(F.concat_ws("\t", "source", "prediction").alias("value") if fmt == "parallel" else F.col("prediction").alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_records(features: DataFrame, path: str, width: int) -> None:
    """Fixed-width records as one .bin and one .idx file per partition under `path`, which every executor can write to.
    The index has the width (u32), the count (u64) and each record's offset (u64), little-endian. A retried task writes
    its files anew under the same name, each by one rename."""
    size = width * sum(struct.calcsize(k) for k in VECTORS.values())
    os.makedirs(path, exist_ok=True)

    def write(no, rows):
        name, n = os.path.join(path, f"part-{no:05d}"), 0
        with open(f"{name}.tmp", "wb") as f:
            for r in rows:
                f.write(r.record)
                n += 1
        with open(f"{name}.idx.tmp", "wb") as f:
            f.write(struct.pack("<IQ", width, n) + struct.pack(f"<{n}Q", *range(0, n * size, size)))
        os.replace(f"{name}.tmp", f"{name}.bin")
        os.replace(f"{name}.idx.tmp", f"{name}.idx")
        yield n

    total = packed(features).select("record").where("record is not null").rdd.mapPartitionsWithIndex(write).sum()
    with open(os.path.join(path, "meta.json"), "w") as f:
        json.dump({"max_seq_length": width, "record_bytes": size, "records": total}, f)


def read_records(spark, path: str, width: int) -> DataFrame:
    """(record) of the .bin files, cut by the record's size."""
    size = width * sum(struct.calcsize(k) for k in VECTORS.values())
    return spark.sparkContext.binaryRecords(os.path.join(path, "*.bin"), size).map(lambda r: (bytearray(r),)).toDF("record binary")
