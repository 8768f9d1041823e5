"""The five reports, their registry and exports. Each carries rows, chart, tiles, trust and warnings of one selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import diff, stats, trust
from shelfmark.operators.sinks import write_csv
from shelfmark.operators.snapshot import LATEST, FilterSpec, filtered, order_by, page
from shelfmark.runtime import materialized
from shelfmark.schema import LISTING_COLUMNS, PAGE_DEFAULT, SMALL_GROUP, half_up
from shelfmark.sources.adapter import Store

LABELS = {"brand": "Brand", "category": "Category", "store": "Store", "platform": "Platform", "grp": "Group", "rows": "Rows", "fill": "% priced", "min": "Lowest", "p25": "25%", "median": "Median", "p75": "75%", "max": "Highest", "in_stock": "In stock", "currency": "Currency", "cheapest": "Cheapest"}
PERCENT = ("fill", "share")


@dataclass
class Report:
    code: str
    title: str
    columns: list[str]
    rows: DataFrame
    trust: DataFrame
    warnings: DataFrame
    chart: DataFrame | None = None
    tiles: DataFrame | None = None
    params: dict = field(default_factory=dict)

    def flat(self) -> DataFrame:
        """Labels as header; shares in percent with one decimal."""
        return self.rows.select(*[(half_up(F.col(c) * 100, 1) if c in PERCENT or c.startswith("fill_") else F.col(c)).alias(LABELS.get(c, c)) for c in self.columns])


def _tiles(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("scan_id").alias("scans"), *stats.price_columns()).withColumn("fill", F.when(F.col("rows") > 0, F.col("n") / F.col("rows")).otherwise(0.0))


def price_ladder(store: Store, rows: DataFrame, by: str = "brand") -> Report:
    ladder = stats.by_group(rows, by)
    few = ladder.where((F.col("n") > 0) & (F.col("n") < SMALL_GROUP)).select("grp")
    small = few.count(), [r["grp"] for r in few.limit(6).collect()]
    return Report("PRICE_LADDER", f"Price ladder by {by}", ["grp", "rows", "fill", "min", "p25", "median", "p75", "max", "in_stock", "currency"], ladder, trust.trust_summary(rows), trust.warnings(rows, small[1], small[0]), stats.ladder_chart(ladder), _tiles(rows), {"by": by})


def price_distribution(store: Store, rows: DataFrame, bins: int = 12) -> Report:
    bars = stats.histogram(rows, bins)
    total = bars.agg(F.sum("n").alias("t"))
    shares = bars.join(total).select("from_price", "to_price", "n", (F.col("n") / F.col("t")).alias("share")).orderBy("from_price")
    return Report("PRICE_DISTRIBUTION", "Price distribution", ["from_price", "to_price", "n", "share"], shares, trust.trust_summary(rows), trust.warnings(rows), bars, _tiles(rows))


def competitors(store: Store, rows: DataFrame, by: str = "category") -> Report:
    table, stores = stats.pivot(rows, by)
    return Report("COMPETITORS", f"Stores by {by}", table.columns, table, trust.trust_summary(rows), trust.warnings(rows), None, _tiles(rows), {"by": by, "stores": stores})


def changes(store: Store, rows: DataFrame, source_url: str | None = None) -> Report:
    """Between the two latest scans of a source (of all sources without one). The filter does not apply."""
    own = (lambda df, c: df) if source_url is None else (lambda df, c: df.where(F.col(c) == source_url))
    whole, scans = own(store.joined(), "source_url"), own(store.scans, "entered_url") if "first_seen" in store.scans.columns else None
    old, new = diff.latest_two(whole, scans)
    both = old.unionByName(new)
    found = diff.compared(old, new)
    severity = F.when(F.col("code").isin("one_scan", "half_day"), "mid").otherwise("low")
    more = diff.caveats(whole, scans).select(F.lit(9).alias("ord"), severity.alias("severity"), "code", "detail")
    warn = trust.warnings(both).union(more if source_url is not None else more.where("code != 'one_scan'").groupBy("ord", "severity", "code").agg(F.concat(F.count("*").cast("string"), F.lit(" sources")).alias("detail")))
    return Report("CHANGES", "Changes between two scans", found.columns, found, trust.trust_summary(both), warn, found.groupBy("change").agg(F.count("*").alias("n")), None, {"source_url": source_url})


def scan_quality(store: Store, rows: DataFrame) -> Report:
    """Fill rates of all scans, newest first. The filter does not apply."""
    table = trust.fill_rates(store.listings, store.scans).orderBy(F.desc("started"), "scan_id")
    return Report("SCAN_QUALITY", "Quality of scans", table.columns, table, trust.trust_summary(rows), trust.warnings(rows), store.scans.groupBy("verdict").agg(F.count("*").alias("scans")))


REPORTS: dict[str, Callable[..., Report]] = {"PRICE_LADDER": price_ladder, "PRICE_DISTRIBUTION": price_distribution, "COMPETITORS": competitors, "CHANGES": changes, "SCAN_QUALITY": scan_quality}


def report(store: Store, code: str, spec: FilterSpec = FilterSpec(), **params) -> Report:
    """Filter, then trust, then the report; an unknown code gives an empty report with a warning."""
    rows = filtered(store.joined(), spec)
    if code not in REPORTS:
        spark = store.listings.sparkSession
        none = spark.createDataFrame([], "grp string")
        return Report(code, "Unknown report", ["grp"], none, trust.trust_summary(rows.limit(0)), spark.createDataFrame([(0, "high", "unknown_report", code)], "ord int, severity string, code string, detail string"))
    return REPORTS[code](store, rows, **params)


def export_csv(rep: Report, path: str) -> None:
    """The verdict and the sentence first, then header and rows."""
    t = rep.trust.first()
    flat = rep.flat()
    write_csv(flat, path, flat.columns, [str(t["worst"] or ""), str(t["sentence"])])


def export_sheet(rep: Report, spec: FilterSpec) -> list[list[str]]:
    """Title, trust, action, warnings and filter that stand above the table."""
    t = rep.trust.first()
    return [[rep.title], ["Trust", t["worst"] or ""], ["", t["sentence"]], ["Action", t["action"] or ""], *[["Warning", w["severity"], w["code"], w["detail"]] for w in rep.warnings.orderBy("ord").collect()], ["Filter", spec.describe()]]


def sheet(rep: Report, spec: FilterSpec) -> DataFrame:
    """The whole sheet as one table (at, cells c0, c1 and so on): what stands above, the labels, the rows in order; short rows are padded with blanks."""
    flat = rep.flat()
    above = [*export_sheet(rep, spec), flat.columns]
    wide = max(len(flat.columns), *map(len, above))
    names = [f"c{i}" for i in range(wide)]
    head = rep.rows.sparkSession.createDataFrame([(i, *row, *[""] * (wide - len(row))) for i, row in enumerate(above)], "at long, " + ", ".join(f"{n} string" for n in names))
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(f"`{x}`") for x in flat.columns)] + [F.lit("")] * (wide - len(flat.columns))
    # places within partitions of ordered rows, and how many rows the partitions before have: a row a partition
    rows = flat.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)], F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    rows = materialized(rows, "sheet")
    before = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = before.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    body = rows.join(before, "part").select((F.lit(len(above)) + F.col("before") + F.col("id") - F.col("first")).alias("at"), *names)
    return head.unionByName(body)


@dataclass
class Found:
    """The answer to a data query: one page, and what holds for the whole match."""

    page: DataFrame
    total: int
    stats: DataFrame
    trust: DataFrame
    warnings: DataFrame
    tiles: DataFrame
    says: str


def data_query(store: Store, spec: FilterSpec, number: int = 1, size: int = PAGE_DEFAULT, name: str = "captured_at", descending: bool | None = None) -> Found:
    """Filter, order and one page, with statistics, trust, warnings and tiles over all that matches; the match is worked out once."""
    rows = materialized(filtered(store.joined(), spec).drop(LATEST), "match")
    total = rows.count()
    return Found(page(rows, number, size, name, descending, total), total, stats.described(rows), trust.trust_summary(rows), trust.warnings(rows), _tiles(rows), spec.describe())


def export_rows(store: Store, spec: FilterSpec, path: str, name: str = "captured_at", descending: bool | None = None) -> None:
    """All matching rows with all columns, in order."""
    rows = filtered(store.joined(), spec)
    write_csv(rows.orderBy(*order_by(rows, name, descending)), path, LISTING_COLUMNS)


def page_bundle(store: Store) -> dict[str, DataFrame]:
    """What a start page shows: scans newest first, sources by scans, facets, and totals."""
    rows = store.joined()
    catalog = store.listings.sparkSession.createDataFrame([(i, code) for i, code in enumerate(REPORTS)], "place long, code string")
    return {"catalog": catalog, "scans": store.scans.orderBy(F.desc("started"), "scan_id"), "sources": stats.url_counts(rows), "facets": stats.facets(rows), "totals": rows.agg(F.count("*").alias("rows"), F.count_distinct("scan_id").alias("scans"))}
