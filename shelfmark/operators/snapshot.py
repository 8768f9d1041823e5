"""Selecting listings: the latest scan of each source, filters, order and pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.runtime import materialized
from shelfmark.schema import HEAVY_COLUMNS, PAGE_DEFAULT, PAGE_LIMIT


#: Pages up to so many rows are found by a top-k.
DEEP = 10_000
#: Whether a row's scan is the newest of its source, where the ledger told it.
LATEST = "latest_scan"


@dataclass(frozen=True)
class FilterSpec:
    """A conjunction; empty parts pass. ``latest_only`` picks the newest scan of each source before anything else."""

    stores: list[str] = field(default_factory=list)
    platforms: list[str] = field(default_factory=list)
    brands: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    verdicts: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    stock_state: str | None = None
    has_price: bool = False
    price_from: float | None = None
    price_to: float | None = None
    keyword: str = ""
    latest_only: bool = True
    finished_only: bool = False

    def describe(self) -> str:
        named = [("store", self.stores), ("platform", self.platforms), ("brand", self.brands), ("category", self.categories), ("verdict", self.verdicts), ("source", self.sources)]
        parts = [f"{name} in {', '.join(values)}" for name, values in named if values]
        parts += [f"stock {self.stock_state}"] if self.stock_state else []
        parts += ["priced"] if self.has_price else []
        parts += [f"price >= {self.price_from:g}"] if self.price_from is not None else []
        parts += [f"price <= {self.price_to:g}"] if self.price_to is not None else []
        parts += [f"contains '{self.keyword.strip()}'"] if self.keyword.strip() else []
        parts.append("latest scan of each source" if self.latest_only else "all scans")
        return "; ".join(parts)


def newest_first(captured_at: str = "captured_at", seq: str = "row_seq") -> Column:
    """Least for the newest row; of equal times the first row."""
    return F.struct((-F.unix_micros(F.col(captured_at).cast("timestamp"))).alias("age"), F.col(seq).alias("seq"))


def latest_scans(rows: DataFrame) -> DataFrame:
    """(source_url, scan_id) of each source's newest row: one narrow partial aggregation, no window over whole rows."""
    return rows.groupBy("source_url").agg(F.min_by("scan_id", newest_first()).alias("scan_id"))


def latest_of_ledger(scans: DataFrame) -> DataFrame:
    """The same from a ledger that knows each scan's newest row: a row a scan instead of all listings."""
    return scans.groupBy(F.col("entered_url").alias("source_url")).agg(F.min_by("scan_id", newest_first("finished", "newest_seq")).alias("scan_id"))


def latest_snapshot(rows: DataFrame, finished_only: bool = False) -> DataFrame:
    """All rows of the newest scan of each source; ``finished_only`` leaves scans without a ledger row aside. A column LATEST from the ledger saves looking for it."""
    if LATEST in rows.columns:
        return rows.where(LATEST)
    pool = rows.where(F.col("verdict").isNotNull()) if finished_only else rows
    return rows.join(latest_scans(pool), ["source_url", "scan_id"], "left_semi")


def _one_of(name: str, values: list[str]) -> Column:
    """A null field equals the empty string."""
    return F.coalesce(F.col(name), F.lit("")).isin(*values)


def predicates(spec: FilterSpec) -> list[Column]:
    """Cheap ones first."""
    lists = [("store", spec.stores), ("platform", spec.platforms), ("brand", spec.brands), ("category", spec.categories), ("verdict", spec.verdicts), ("source_url", spec.sources)]
    out = [_one_of(name, values) for name, values in lists if values]
    if spec.stock_state:
        out.append(F.col("stock_state") == spec.stock_state)
    if spec.has_price:
        out.append(F.col("price").isNotNull())
    if spec.price_from is not None:
        out.append(F.col("price") >= spec.price_from)
    if spec.price_to is not None:
        out.append(F.col("price") <= spec.price_to)
    if word := spec.keyword.strip().lower():
        text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "sku", "brand", "category", "variant")])
        out.append(F.instr(F.lower(text), word) > 0)
    return out


def filtered(rows: DataFrame, spec: FilterSpec) -> DataFrame:
    if spec.latest_only:
        rows = latest_snapshot(rows, spec.finished_only)
    return reduce(lambda df, p: df.where(p), predicates(spec), rows)


def order_by(rows: DataFrame, name: str = "captured_at", descending: bool | None = None) -> list[Column]:
    """Blanks last both ways, ties by place; strings in Vietnamese collation. Without a column: the newest first."""
    c = F.collate(F.col(name), "vi") if isinstance(rows.schema[name].dataType, T.StringType) else F.col(name)
    down = name == "captured_at" if descending is None else descending
    return [c.desc_nulls_last() if down else c.asc_nulls_last(), F.col("row_seq").asc()]


def page(rows: DataFrame, number: int = 1, size: int = PAGE_DEFAULT, name: str = "captured_at", descending: bool | None = None, total: int | None = None) -> DataFrame:
    """One page: size 1 to 500, page number clamped to what there is; heavy columns are not sent.

    A top-k for the first DEEP rows. A page further down is found by its place: rows are sorted over all tasks, counted by partition, and only
    the partitions that hold the page are read.
    """
    size = max(1, min(PAGE_LIMIT, size))
    total = rows.count() if total is None else total
    last = max(1, -(-total // size))
    number = max(1, min(number, last))
    first, slim = (number - 1) * size, rows.drop(*HEAVY_COLUMNS, LATEST)
    if first + size <= DEEP:
        return slim.orderBy(*order_by(rows, name, descending)).offset(first).limit(size)
    placed = materialized(slim.orderBy(*order_by(rows, name, descending)).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ordered")
    parts = sorted(placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("low")).collect())  # a row a partition
    wanted, before = F.lit(False), 0
    for part in parts:
        low, high = max(first, before), min(first + size, before + part["n"])
        if low < high:
            wanted = wanted | (F.col("__part") == part["__part"]) & F.col("__at").between(part["low"] + low - before, part["low"] + high - before - 1)
        before += part["n"]
    return placed.where(wanted).orderBy("__at").drop("__part", "__at")


def first_wins(rows: DataFrame) -> DataFrame:
    """One row for each external_id of a scan, the first; rows without an id all stay, each by its own place. One partial aggregate keeps one row a key."""
    own = F.when(F.col("external_id").isNull(), F.col("row_seq"))
    return rows.groupBy("scan_id", "external_id", own.alias("__own")).agg(F.min_by(F.struct(*rows.columns), F.col("row_seq")).alias("__x")).select("__x.*")


def last_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key, the last; rows with a blank key go."""
    keyed = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return keyed.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col("row_seq")).alias("__x")).select("__x.*")


def ranked_scans(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(source_url, scan_id, seen, rows, place): scans of each source by the time of their first row, newest first; from listings, or from a ledger that has first_seen."""
    if "first_seen" in rows.columns:
        per = rows.select(F.col("entered_url").alias("source_url"), "scan_id", F.col("first_seen").alias("seen"), F.col("n_rows").alias("rows"))
    else:
        per = rows.groupBy("source_url", "scan_id").agg(F.min_by("captured_at", "row_seq").alias("seen"), F.count("*").alias("rows"))
    out = per.withColumn("place", F.row_number().over(Window.partitionBy("source_url").orderBy(F.desc("seen"), F.desc("scan_id"))))
    return out if most is None else out.where(F.col("place") <= most)
