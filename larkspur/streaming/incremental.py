"""Extension (the batch scans have no stream of their own): incremental scans as a stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import decisions
from larkspur.sources import sinks


def scan_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of scan results in `folder`, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def catch_up(stream: DataFrame, table: str, checkpoint: str, keys: list[str]) -> None:
    """Merge all that is new into the snapshots in `table`, in micro-batches, and stop.

    Of several rows for a key in one batch the last by scanned_at counts; a batch that is repeated after a failure merges
    to the same table.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, _: int) -> None:
        whole = F.struct(*batch.columns)
        new = batch.groupBy(*keys).agg(F.max_by(whole, "scanned_at").alias("r")).select("r.*")
        if sinks.has_snapshot(spark, table):  # whatever else goes wrong with the old version ends the batch
            sinks.update_snapshot(spark, table, lambda old: decisions.replace(old, new, keys))
        else:
            sinks.write_snapshot(new, table, after=0)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bursts(stream: DataFrame, key: str, at: str, gap: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): shots of a source in a row with no pause longer than `gap`, with a watermark for late ones."""
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
