"""Verdicts of scans, their propagation to every result, and warnings on a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.schema import BLANK_CURRENCY_SHARE, DAYS_APART, KEY_FIELDS, KEY_FILL_LEAST, MISSING_BELOW, PRICE_FILL_LEAST, PRODUCT_FIELDS, VERDICTS, half_up, verdict_name, verdict_rank


def verdict(rows: Column, rung: Column, price_fill: Column, key_fill: Column) -> Column:
    """The rules from the top: nothing read, too few prices, guessed from HTML, platform feeds, structured pages."""
    return (
        F.when((rows == 0) | rung.isNull() | (rung == 6), "UNSCANNABLE")
        .when(price_fill < PRICE_FILL_LEAST, "LOW")
        .when(rung == 5, "LOW")
        .when(rung.isin(1, 2), F.when(key_fill >= KEY_FILL_LEAST, "HIGH").otherwise("MEDIUM"))
        .when(rung.isin(3, 4), "MEDIUM")
        .otherwise("LOW")
    )


def scan_fills(listings: DataFrame, *extra: Column) -> DataFrame:
    """Per scan: rows, and the filled rows of every product field."""
    return listings.groupBy("scan_id").agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in PRODUCT_FIELDS], *extra)


def mostly_missing() -> Column:
    """Fields filled in fewer than half of the rows, the emptiest first: ``name (percent%)``."""
    worst = F.array_sort(F.array(*[F.struct((F.col(f"n_{c}") / F.col("n")).alias("f"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(PRODUCT_FIELDS)]))
    return F.array_join(F.transform(F.filter(worst, lambda x: x["f"] < MISSING_BELOW), lambda x: F.concat(x["c"], F.lit(" ("), F.floor(x["f"] * 100 + 0.5).cast("string"), F.lit("%)"))), ", ")


def scan_ledger(listings: DataFrame) -> DataFrame:
    """One row a scan with its measured verdict; ``listings`` carry the rung that yielded them."""
    newest = F.min(F.struct((-F.unix_micros(F.col("captured_at").cast("timestamp"))).alias("age"), F.col("row_seq").alias("seq")))["seq"]
    fills = scan_fills(listings, F.min_by("captured_at", "row_seq").alias("first_seen"), newest.alias("newest_seq"), F.max("rung").alias("rung"), F.min("captured_at").alias("started"), F.max("captured_at").alias("finished"), F.min("row_seq").alias("row_seq"), F.first("source_url").alias("entered_url"), F.first("platform").alias("platform"))
    price_fill = F.col("n_price") / F.col("n")
    key_fill = F.least(*[F.col(f"n_{c}") / F.col("n") for c in KEY_FIELDS])
    return fills.select("scan_id", "started", "finished", "entered_url", "platform", "rung", F.col("n").alias("n_rows"), half_up(price_fill * 100, 1).alias("price_fill_pct"), mostly_missing().alias("mostly_missing"), verdict(F.col("n"), F.col("rung"), price_fill, key_fill).alias("verdict"), "row_seq", "first_seen", "newest_seq")


def worst(verdicts: Column) -> Column:
    """Aggregate: the worst of known verdicts; null if none is known."""
    return verdict_name(F.max(verdict_rank(verdicts)))


def trust_by_scan(rows: DataFrame) -> DataFrame:
    """Per contributing scan of a selection (rows joined with the ledger): verdict, rung, first-seen date, rows."""
    return rows.groupBy("scan_id").agg(F.max("verdict").alias("verdict"), F.max("rung").alias("rung"), F.min_by("source_url", "row_seq").alias("source_url"), F.min_by("captured_at", "row_seq").alias("first_seen"), F.count("*").alias("rows"))


def trust_summary(rows: DataFrame) -> DataFrame:
    """One row: scans, counts by verdict, the worst verdict, rows and price fill of the selection, and the sentence."""
    per = rows.groupBy("scan_id").agg(F.max("verdict").alias("verdict"), F.count("*").alias("rows"), F.count("price").alias("priced"))
    counts = [F.count_if(F.col("verdict") == v).alias(f"scans_{v.lower()}") for v in VERDICTS]
    out = per.agg(F.count("*").alias("scans"), *counts, F.count_if(verdict_rank(F.col("verdict")).isNull()).alias("unknown_scans"), worst(F.col("verdict")).alias("worst"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("priced"), F.lit(0)).alias("priced"))
    out = out.withColumn("price_fill", F.when(F.col("rows") > 0, F.col("priced") / F.col("rows")).otherwise(F.lit(0.0)))
    return out.withColumn("sentence", trust_sentence(F.col("worst"), F.col("scans"), F.col("rows"))).withColumn("action", action(F.col("worst")))


def trust_sentence(worst_: Column, scans: Column, rows: Column) -> Column:
    lead = F.concat(rows.cast("string"), F.lit(" rows of "), scans.cast("string"), F.lit(" scans: "))
    says = F.when(worst_ == "HIGH", "read from platform feeds.").when(worst_ == "MEDIUM", "read from web pages; check three rows by hand.").when(worst_ == "LOW", "guessed or short of prices; verify everything.").when(worst_ == "UNSCANNABLE", "nothing could be read.").otherwise("trust unknown.")
    return F.when(rows == 0, F.lit("No rows.")).otherwise(F.concat(lead, says))


def action(verdict_: Column) -> Column:
    return F.when(verdict_ == "HIGH", "use as it is").when(verdict_ == "MEDIUM", "spot-check").when(verdict_ == "LOW", "verify all").when(verdict_ == "UNSCANNABLE", "get the data another way")


def warnings(rows: DataFrame, small_groups: list[str] | None = None, small_count: int | None = None) -> DataFrame:
    """(ord, severity, code, detail) of the rules that a selection breaks, from one pass over it and one over its scans. Of many small groups their count and the first names are enough."""
    own = rows.agg(
        F.count("*").alias("n"), F.count("price").alias("priced"), F.count_if(F.col("price").isNotNull() & (F.coalesce(F.trim("currency"), F.lit("")) == "")).alias("blank"),
        F.array_sort(F.collect_set(F.when(F.col("price").isNotNull(), F.nullif(F.trim("currency"), F.lit(""))))).alias("currencies"),
    )
    seen = rows.groupBy("scan_id").agg(F.min_by("captured_at", "row_seq").alias("first_seen")).agg(F.count("*").alias("scans"), ((F.max(F.unix_micros(F.col("first_seen").cast("timestamp"))) - F.min(F.unix_micros(F.col("first_seen").cast("timestamp")))) / 86400e6).alias("days"))
    pct = lambda x: F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))
    make = lambda i, severity, code, when, detail: F.when(when, F.struct(F.lit(i).alias("ord"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail")))
    small = small_groups or []
    many = len(small) if small_count is None else small_count
    found = F.array_compact(F.array(
        make(1, "high", "mixed_currency", F.size("currencies") > 1, F.array_join("currencies", ", ")),
        make(2, "mid", "blank_currency", (F.col("priced") > 0) & (F.col("blank") / F.greatest("priced", F.lit(1)) > BLANK_CURRENCY_SHARE), pct(F.col("blank") / F.greatest("priced", F.lit(1)))),
        make(3, "high", "few_prices", (F.col("n") > 0) & (F.col("priced") / F.greatest("n", F.lit(1)) < PRICE_FILL_LEAST), pct(F.col("priced") / F.greatest("n", F.lit(1)))),
        make(4, "mid", "distant_scans", (F.col("scans") > 1) & (F.col("days") > DAYS_APART), F.concat(F.floor(F.col("days") + 0.5).cast("string"), F.lit(" days"))),
        make(5, "low", "small_groups", F.lit(bool(small)), F.lit(f"{many}: " + ", ".join(small[:5]) + ("..." if many > 5 else ""))),
    ))
    return own.join(seen).select(F.explode(found).alias("w")).select("w.*")


def fill_rates(listings: DataFrame, scans: DataFrame) -> DataFrame:
    """Per scan of the ledger, newest first: rows and the share filled of every product field; scans without rows appear too."""
    fills = scan_fills(listings).select("scan_id", "n", *[(F.col(f"n_{c}") / F.col("n")).alias(f"fill_{c}") for c in PRODUCT_FIELDS])
    return scans.select("scan_id", "started", "verdict", "rung").join(fills, "scan_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reason_counts(rows: DataFrame) -> DataFrame:
    """(field, reason, n) of why fields are missing (``missing_reason``: map); a trailing remark in brackets is cut."""
    return rows.select(F.explode("missing_reason").alias("field", "reason")).select("field", F.regexp_replace("reason", r"\s*\([^)]*\)\z", "").alias("reason")).groupBy("field", "reason").agg(F.count("*").alias("n"))


def warning_counts(rows: DataFrame) -> DataFrame:
    """(warning, n) over the rows' warnings (``row_warnings``: list), a trailing remark in brackets cut; mergeable, as a count by text is."""
    return rows.select(F.explode("row_warnings").alias("w")).groupBy(F.regexp_replace("w", r"\s*\([^)]*\)\z", "").alias("warning")).agg(F.count("*").alias("n"))


def top_reasons(counts: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("field").orderBy(F.desc("n"), "reason")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
