"""The queue worker: every waiting address is scanned once, from captured pages, and its entry tells how that went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.extract import ladder


def worked(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries (url, status, row_seq) that wait or were left running, as DONE with their rows and rung, or as ERROR; others stay as they are.

    All waiting addresses are scanned at once; the entry of an address decides, so a worker that is started again scans only what is left.
    ``pages``: captured pages (url, status, body, kind, currency, entered: the address they belong to).
    """
    waiting = queue.where("status in ('PENDING', 'RUNNING')").select("url").distinct()
    own = pages.join(waiting.select(F.col("url").alias("entered")), "entered").withColumn("scan_id", F.col("entered")).drop("entered")
    rows = ladder(own.withColumn("fetched_at", F.lit(None).cast("timestamp")))
    got = rows.groupBy(F.col("scan_id").alias("url")).agg(F.min("rung").alias("rung"), F.count("*").alias("rows"))
    ended = queue.join(got, "url", "left").withColumn("open", F.col("status").isin("PENDING", "RUNNING"))
    status = F.when(~F.col("open"), F.col("status")).when(F.col("rows") > 0, "DONE").otherwise("ERROR")
    note = F.when(F.col("rows") > 0, F.concat(F.col("rows").cast("string"), F.lit(" rows of rung "), F.col("rung").cast("string"))).otherwise("nothing could be read")
    return ended.select("url", status.alias("status"), F.when(F.col("open"), note).otherwise("").alias("note"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "row_seq")
