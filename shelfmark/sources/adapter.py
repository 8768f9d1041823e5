"""The driver's order tables seen as a snapshot store of listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.snapshot import LATEST, latest_of_ledger
from shelfmark.operators.trust import scan_ledger
from shelfmark.runtime import materialized

SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@dataclass
class Store:
    """Listing rows and the ledger of scans; a row's place is its ``row_seq``."""

    listings: DataFrame
    scans: DataFrame
    complete: bool = False

    def joined(self) -> DataFrame:
        """Listings with verdict and rung of their scan (null without a ledger row); the ledger keeps one row a scan, the last."""
        last = self.scans.groupBy("scan_id").agg(F.max_by(F.struct("verdict", "rung"), "row_seq").alias("x")).select("scan_id", "x.verdict", "x.rung")
        if self.complete:  # every scan is in the ledger, so that it tells the latest of each source as well
            latest = latest_of_ledger(self.scans).select("scan_id", F.lit(True).alias(LATEST))
            last = last.join(latest, "scan_id", "left").withColumn(LATEST, F.coalesce(LATEST, F.lit(False)))
        return self.listings.where("scan_id is not null").join(last, "scan_id", "left")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wide = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    wide = wide.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity"), 0)
    full = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 0)
    missing = ((F.col("n_nationkey") % 3 == 1) & (F.col("l_tax") == 0)) | ((F.col("n_nationkey") % 3 == 2) & (F.col("l_tax") <= 0.03))
    price = F.when(~missing, raw)
    money = F.when(F.col("n_regionkey").isin(0, 1), "VND").when(F.col("n_regionkey") == 2, "USD").when(F.col("n_regionkey") == 3, "EUR")
    year = F.year("l_shipdate")
    return wide.select(
        F.concat("n_name", F.lit("-"), year.cast("string")).alias("scan_id"), F.col("l_shipdate").alias("captured_at"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")).alias("source_url"), F.col("n_name").alias("store"), F.col("r_name").alias("platform"),
        F.col("l_partkey").cast("string").alias("external_id"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/p/"), F.col("l_partkey").cast("string")).alias("product_url"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("l_suppkey").cast("string").alias("sku"), F.col("p_size").cast("string").alias("variant"),
        price.alias("price"), F.when(~full.eqNullSafe(price), full).alias("list_price"), F.when(price.isNotNull(), money).alias("currency"),
        F.when(F.col("l_linestatus") == "O", "IN").when(F.col("l_linestatus") == "F", "OUT").alias("stock_state"),
        F.lit(None).cast("long").alias("stock_qty"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("review_count"),
        F.lit(None).cast("long").alias("sold_count"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("short_desc"),
        (1 + (F.col("n_nationkey") + year) % 5).cast("int").alias("rung"), F.struct(*SEQ).alias("row_seq"),
    )


def store(spark: SparkSession, sf_dir: str) -> Store:
    """Listings, and their ledger: written once a session and folder, a row a scan, as a store keeps it."""
    rows = listings(spark, sf_dir)
    ledgers = spark.sparkContext.__dict__.setdefault("_shelfmark_ledgers", {})
    if sf_dir not in ledgers:
        ledgers[sf_dir] = materialized(scan_ledger(rows), "ledger")
    return Store(rows.drop("rung"), ledgers[sf_dir], True)
