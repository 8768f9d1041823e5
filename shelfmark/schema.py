"""Column lists, types, enumerations and default settings of the snapshot store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that an extractor fills; all others belong to the scan.
PRODUCT_FIELDS = [
    "external_id", "product_url", "title", "brand", "category", "sku", "variant", "price", "list_price", "currency",
    "stock_state", "stock_qty", "rating", "review_count", "sold_count", "image_url", "short_desc",
]
SCAN_FIELDS = ["scan_id", "captured_at", "source_url", "store", "platform"]
LISTING_COLUMNS = SCAN_FIELDS + PRODUCT_FIELDS
LEDGER_COLUMNS = ["scan_id", "started", "finished", "entered_url", "url_kind", "platform", "rung", "n_rows", "price_fill_pct", "mostly_missing", "verdict", "reason", "operator"]
CHANGE_COLUMNS = ["compared_at", "source_url", "external_id", "title", "change", "old_price", "new_price", "delta", "pct", "old_stock", "new_stock", "old_scan", "new_scan"]
QUEUE_COLUMNS = ["added_at", "url", "status", "scan_id", "note"]
#: Not sent with a page of rows.
HEAVY_COLUMNS = ["short_desc"]

_KINDS = {"captured_at": T.TimestampType(), "price": T.DoubleType(), "list_price": T.DoubleType(), "rating": T.DoubleType(), "stock_qty": T.LongType(), "review_count": T.LongType(), "sold_count": T.LongType()}
LISTING_SCHEMA = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in LISTING_COLUMNS] + [T.StructField("row_seq", T.LongType())])
LEDGER_SCHEMA = T.StructType([T.StructField(c, {"started": T.TimestampType(), "finished": T.TimestampType(), "rung": T.IntegerType(), "n_rows": T.LongType(), "price_fill_pct": T.DoubleType()}.get(c, T.StringType())) for c in LEDGER_COLUMNS] + [T.StructField("row_seq", T.LongType())])

#: From best to worst; the rank is the place.
VERDICTS = ["HIGH", "MEDIUM", "LOW", "UNSCANNABLE"]
KEY_FIELDS = ["external_id", "product_url", "title", "price"]
PRICE_FILL_LEAST, KEY_FILL_LEAST, MISSING_BELOW = 0.70, 0.95, 0.50
BLANK_CURRENCY_SHARE, DAYS_APART, SMALL_GROUP = 0.20, 14, 5
UNSPECIFIED = "(unspecified)"
TOP_STORES, TOP_GROUPS, CHART_GROUPS, FACET_VALUES = 8, 40, 12, 300
PAGE_LIMIT, PAGE_DEFAULT = 500, 100

# Defaults of the settings table (key, value); the delay has a floor.
DEFAULT_SETTINGS = [
    ("request_delay_ms", "1500"), ("requests_per_host", "500"), ("page_cap", "20"), ("user_agent", "ShelfmarkBot/1.0"),
    ("run_budget_ms", "270000"), ("failures_in_a_row", "3"), ("operator", ""),
]
DELAY_FLOOR_MS = 1500


def verdict_rank(verdict: Column) -> Column:
    """0 best to 3 worst; null for blank or unknown verdicts, which worst-of ignores."""
    out = F.lit(None).cast("int")
    for rank, name in enumerate(VERDICTS):
        out = F.when(verdict == name, F.lit(rank)).otherwise(out)
    return out


def verdict_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.get(F.array(*[F.lit(v) for v in VERDICTS]), rank))


def half_up(x: Column, digits: int) -> Column:
    """Round half towards plus infinity."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k
