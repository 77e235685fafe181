"""The per-row operators on streams: they keep no state, so they run on readStream unchanged; and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize


def normalized_stream(texts: DataFrame, col: str = "text") -> DataFrame:
    return texts.withColumn(col, normalize(F.col(col)))


def changed_rate(rows: DataFrame, time: str = "created_at", late: str = "30 days", width: str = "7 days") -> DataFrame:
    """(start, n, n_corrupted) per window of event time; rows later than `late` are dropped by the watermark."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if("is_corrupted").alias("n_corrupted"))
        .select(F.col("w.start").alias("start"), "n", "n_corrupted")
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that has arrived, as a table at `path`; then it stops. Rows go from executors to files, never to the driver.
    Batches have a folder each, written anew if one is repeated; of complete results the last one holds."""
    done: list[int] = []

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={no}")
        done.append(no)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{path}/batch={done[-1]}" if mode == "complete" else path).select(*stream.columns)
