"""Writing: append, overwrite, queue updates, CSV lines and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.operators.snapshot import first_wins
from shelfmark.operators.trust import scan_ledger
from shelfmark.runtime import exists
from shelfmark.schema import LISTING_COLUMNS


def guarded(c: Column) -> Column:
    """A leading = + - @ would be a formula in a spreadsheet: a quote goes before it."""
    s = c.cast("string")
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_cell(c: Column) -> Column:
    """Quoted if it holds a quote, a line end, a comma or a semicolon; blank stays blank."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",;\\n\\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns])


def write_csv(rows: DataFrame, path: str, columns: list[str], before: list[str] = ()) -> None:
    """A header (after lines ``before``) and a line a row, as part files whose order is that of the rows: the header's own, then one for each of their partitions."""
    head = rows.sparkSession.createDataFrame([(line,) for line in [*before, ",".join(columns)]], "line string").coalesce(1)
    head.union(rows.select(csv_line(rows, columns).alias("line"))).write.mode("overwrite").text(path)


def cut_reason(c: Column) -> Column:
    s = F.regexp_replace(c, r"[\s|]+\z", "")
    return F.when(F.length(s) > 4000, F.concat(F.substring(s, 1, 4000), F.lit("…"))).otherwise(s)


def stamped(rows: DataFrame, scan_id: str, source_url: str, store: str, platform: str) -> DataFrame:
    """Product rows as listing rows of a scan, in the fixed column order."""
    scan = {"scan_id": F.lit(scan_id), "source_url": F.lit(source_url), "store": F.lit(store), "platform": F.lit(platform), "captured_at": F.current_timestamp()}
    return rows.select(*[(scan[c] if c in scan else F.col(c)).alias(c) for c in LISTING_COLUMNS], "row_seq")


def append_listings(batch: DataFrame, path: str) -> int:
    """Append the rows of a batch that are not written yet: the first of each (scan_id, external_id), and rows without an id by their place, so that a replay adds none.

    The table is partitioned by store and scan, and only the partitions of the batch's scans are read. The batch is worked out once. Returns how many
    rows were appended.
    """
    spark = batch.sparkSession
    fresh = first_wins(batch).withColumn("__key", row_key()).persist()
    try:
        rows = fresh
        if exists(spark, path):
            have = spark.read.schema(batch.schema).parquet(path)
            scans = [r["scan_id"] for r in fresh.select("scan_id").distinct().limit(MOST_SCANS + 1).collect()]
            if len(scans) <= MOST_SCANS:  # names of partitions: the others are not even listed
                have = have.where(F.col("scan_id").isin([x for x in scans if x is not None]) | F.lit(None in scans) & F.col("scan_id").isNull())
            written = have.select(F.col("scan_id").alias("__scan"), row_key().alias("__written"))
            rows = fresh.join(written, F.col("scan_id").eqNullSafe(F.col("__scan")) & (F.col("__key") == F.col("__written")), "left_anti")
        seen = Observation()
        whole = rows.drop("__key").hint("rebalance", "store", "scan_id")  # a scan's rows in few files; large scans are split
        whole.observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy("store", "scan_id").parquet(path)
        return seen.get["n"]
    finally:
        fresh.unpersist()


#: Up to so many scans of a batch prune the table's partitions by name.
MOST_SCANS = 1000


def row_key() -> Column:
    """What tells a row from others of its scan: its id, or without one its place."""
    return F.coalesce(F.concat(F.lit("id "), "external_id"), F.concat(F.lit("at "), F.to_json(F.struct("row_seq"))))




def append_ledger(finished: DataFrame, path: str) -> None:
    """One ledger row for each finished scan that has none yet."""
    spark = finished.sparkSession
    rows = scan_ledger(finished)
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("scan_id"), "scan_id", "left_anti")
    rows.write.mode("append").parquet(path)


def rebuild(rows: DataFrame, path: str) -> DataFrame:
    """A derived table, replaced as a whole."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def padded(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Ragged rows (at, cells: list of strings) as columns c0, c1 and so on, blanks up to the widest."""
    widest = rows.agg(F.coalesce(F.max(F.size(cells)), F.lit(0)).alias("n")).first()["n"]
    return rows.select("at", *[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(widest)])


def with_status(queue: DataFrame, url: str, status: str, scan_id: str | None, note: str) -> DataFrame:
    """The queue with the entries of a url that are not done yet updated."""
    own = (F.col("url") == url) & (F.col("status") != "DONE")
    return queue.withColumns({"scan_id": F.when(own, F.lit(scan_id)).otherwise(F.col("scan_id")), "note": F.when(own, F.lit(note)).otherwise(F.col("note")), "status": F.when(own, F.lit(status)).otherwise(F.col("status"))})


def queued(pasted: DataFrame, text: str = "text") -> DataFrame:
    """Pasted lists as queue rows: one for each address (the first of equals, normalised) as PENDING, unusable ones as ERROR."""
    from shelfmark.functions.urls import normalised, pasted_urls

    pieces = pasted.select("row_seq", F.posexplode(pasted_urls(F.col(text))).alias("at", "piece")).withColumn("n", normalised(F.col("piece"))["url"])
    good = pieces.where("n is not null").groupBy("n").agg(F.min(F.struct("row_seq", "at")).alias("p")).select(F.col("n").alias("url"), F.lit("PENDING").alias("status"), F.lit("").alias("note"), "p.*")
    bad = pieces.where("n is null").select(F.col("piece").alias("url"), F.lit("ERROR").alias("status"), F.lit("not an http(s) address").alias("note"), "row_seq", "at")
    return good.unionByName(bad)
