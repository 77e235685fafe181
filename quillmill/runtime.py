"""Session, table and checkpoint helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The Parquet table `name` of `sf_dir`, whole; `columns` prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least the cluster's cores.

    A file with one row group is one task however large it is. Scans that already have enough splits are left
    alone, so that no shuffle is paid on large inputs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in `spark.checkpoint.dir`; one of our own only where it is unset, as in
    local tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        set_to = sc.getConf().get("spark.checkpoint.dir", None)
        if not set_to and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_to or os.path.join(tempfile.gettempdir(), f"quillmill-{os.getpid()}"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor costs no recomputation and a Python
    stage that several branches read runs once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the shared checkpoint folder: as `checkpointed`, but column by column, so that readers
    of some columns read these only. The table is removed when the JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """`df`, for a broadcast join if it has at most `most` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def over_batches(df: DataFrame, work: Callable[..., list | tuple], schema: pa.Schema, ddl: str, init: Callable[[], object] | None = None) -> DataFrame:
    """`work(batch[, state])` over Arrow batches of `df`; it returns the output columns in the order of `schema`.

    `init` makes the state once per task. Nothing is kept between batches, so memory follows the batch size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = init() if init else None
        for batch in batches:
            if batch.num_rows:
                out = work(batch, state) if init else work(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def hash_pair(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes: a 128-bit key, short enough to shuffle in place of a text."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("h2")]
