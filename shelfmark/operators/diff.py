"""Comparing two snapshots of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.snapshot import last_wins, ranked_scans
from shelfmark.schema import half_up


def change() -> Column:
    """NEW, GONE, PRICE_UP, PRICE_DOWN, BACK_IN_STOCK, OUT_OF_STOCK or null; a price change hides a stock change."""
    both = F.col("in_old") & F.col("in_new")
    priced = F.col("old_price").isNotNull() & F.col("new_price").isNotNull() & (F.col("old_price") != F.col("new_price"))
    stock = F.col("new_stock").isNotNull() & ~F.col("old_stock").eqNullSafe(F.col("new_stock"))
    return (
        F.when(F.col("in_old").isNull(), "NEW")
        .when(F.col("in_new").isNull(), "GONE")
        .when(both & priced, F.when(F.col("new_price") > F.col("old_price"), "PRICE_UP").otherwise("PRICE_DOWN"))
        .when(both & stock, F.when(F.col("new_stock") == "IN", "BACK_IN_STOCK").otherwise("OUT_OF_STOCK"))
    )


def side(rows: DataFrame, name: str) -> DataFrame:
    slim = last_wins(rows.select("source_url", "external_id", "scan_id", "title", "price", "stock_state", "row_seq"), "source_url", "external_id")
    return slim.select("source_url", "external_id", F.lit(True).alias(f"in_{name}"), F.col("title").alias(f"{name}_title"), F.col("price").alias(f"{name}_price"), F.col("stock_state").alias(f"{name}_stock"), F.col("scan_id").alias(f"{name}_scan"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two snapshots (of one or many sources at once), the last row of each external_id counting."""
    both = side(old, "old").join(side(new, "new"), ["source_url", "external_id"], "full").withColumn("change", change())
    delta = F.col("new_price") - F.col("old_price")
    pct = F.when(F.col("old_price") != 0, half_up(delta / F.when(F.col("old_price") != 0, F.col("old_price")) * 100, 1))
    return both.where("change is not null").select("source_url", "external_id", F.coalesce("new_title", "old_title").alias("title"), "change", "old_price", "new_price", delta.alias("delta"), pct.alias("pct"), "old_stock", "new_stock", "old_scan", "new_scan")


def latest_two(rows: DataFrame, scans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the scan before the last and of the last scan of every source that was scanned twice. A ledger ``scans`` with first_seen saves ranking them by their rows."""
    two = ranked_scans(rows if scans is None or "first_seen" not in scans.columns else scans, 2)
    twice = two.where("place = 2").select("source_url")
    pick = lambda k: rows.join(two.where(F.col("place") == k).join(twice, "source_url", "left_semi").select("source_url", "scan_id"), ["source_url", "scan_id"], "left_semi")
    return pick(2), pick(1)


def latest_changes(rows: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    old, new = latest_two(rows, scans)
    return compared(old, new)


def caveats(rows: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """(source_url, code, detail) of what to mind about the changes of each source: one_scan, half_day, identical, gone."""
    ranked = ranked_scans(rows if scans is None or "first_seen" not in scans.columns else scans, 2)
    seen = F.unix_micros(F.col("seen").cast("timestamp")) / 86400e6
    per = ranked.groupBy("source_url").agg(F.count("*").alias("scans"), F.abs(F.max(F.when(F.col("place") == 1, seen)) - F.max(F.when(F.col("place") == 2, seen))).alias("days"))
    found = latest_changes(rows, scans).groupBy("source_url").agg(F.count("*").alias("changes"), F.count_if(F.col("change") == "GONE").alias("gone"))
    twice, n = F.col("scans") > 1, F.coalesce("changes", F.lit(0))
    make = lambda code, when, detail: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail") if isinstance(detail, str) else detail.alias("detail")))
    says = F.array_compact(F.array(
        make("one_scan", ~twice, "needs at least two scans"),
        make("half_day", twice & (F.col("days") < 0.5), "less than half a day apart: likely an hourly offer, not a change of price"),
        make("identical", twice & (n == 0), "both scans are the same"),
        make("gone", twice & (F.coalesce("gone", F.lit(0)) > 0), F.concat(F.col("gone").cast("string"), F.lit(" rows gone may also mean a page limit or new ids"))),
    ))
    return per.join(found, "source_url", "left").select("source_url", F.explode(says).alias("x")).select("source_url", "x.*")


def consecutive_changes(rows: DataFrame) -> DataFrame:
    """The same over every pair of consecutive scans: (source_url, external_id, scan_id, previous price, price)."""
    from pyspark.sql import Window

    slim = last_wins(rows.select("source_url", "scan_id", "external_id", "captured_at", "price", "row_seq"), "source_url", "scan_id", "external_id")
    order = Window.partitionBy("source_url", "external_id").orderBy("captured_at", "scan_id")
    return slim.withColumn("previous_price", F.lag("price").over(order)).withColumn("previous_scan", F.lag("scan_id").over(order)).where("previous_scan is not null and price != previous_price").drop("row_seq")
