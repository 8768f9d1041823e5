"""Micro-batch ingestion of captured listings, written once whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.sinks import append_ledger, append_listings
from shelfmark.schema import LISTING_SCHEMA


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 8, schema=LISTING_SCHEMA, progress: list | None = None) -> DataFrame:
    """Run all new files through the sink and stop. A replayed batch or another copy of a row adds nothing: the table, not the cursor, decides.

    ``progress`` gets (batch, rows read) of every batch that had rows.
    """

    def put(batch: DataFrame, _: int) -> None:
        append_listings(batch, target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    return spark.read.parquet(target)


def finish(listings: DataFrame, rungs: DataFrame, ledger: str) -> DataFrame:
    """The ledger with rows for finished scans (scan_id, rung) that had none."""
    append_ledger(listings.join(rungs, "scan_id"), ledger)
    return listings.sparkSession.read.parquet(ledger)


def cursor(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch that is done, from the checkpoint; null before the first and after ``cleared``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(name) for name in done if name.isdecimal()), default=None)


def cleared(spark: SparkSession, checkpoint: str) -> None:
    """Forget the cursor: the next run reads all files again, and adds nothing that is written already."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def host_counts(stream: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Requests and failures of each host over a captured fetch log (a stream or a table), with a watermark for late rows."""
    bad = F.col("status").isNull() | (F.col("status") >= 500) | (F.col("status") == 408)
    return stream.withWatermark("fetched_at", window).groupBy(F.window("fetched_at", window), "host").agg(F.count("*").alias("requests"), F.count_if(bad).alias("failures"))
