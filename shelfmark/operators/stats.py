"""Describing, grouping, binning and facets of prices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.schema import CHART_GROUPS, FACET_VALUES, TOP_GROUPS, TOP_STORES, UNSPECIFIED, half_up

QUARTILES = [0.25, 0.5, 0.75]


def price_columns(c: str = "price") -> list[Column]:
    """n, min, p25, median, p75, max, mean, sum of a column; all but n null if nothing is filled. Quartiles are exact and interpolated."""
    q = F.percentile(c, F.array(*[F.lit(x) for x in QUARTILES]))
    two = lambda x: half_up(x, 2)
    return [
        F.count(c).alias("n"), F.min(c).alias("min"), two(F.get(q, F.lit(0))).alias("p25"), two(F.get(q, F.lit(1))).alias("median"),
        two(F.get(q, F.lit(2))).alias("p75"), F.max(c).alias("max"), two(F.avg(c)).alias("mean"), F.sum(c).alias("total"),
    ]


def described(rows: DataFrame, c: str = "price") -> DataFrame:
    return rows.agg(*price_columns(c))


def dominant_currency(counts: Column) -> Column:
    """From array<struct<n desc, first seen, code>>: '' if none, the code, or the code and how many others."""
    best = F.array_sort(counts)
    code = F.get(best, F.lit(0))["code"]
    return F.when(F.size(counts) == 0, "").when(F.size(counts) == 1, code).otherwise(F.concat(code, F.lit(" (+"), (F.size(counts) - 1).cast("string"), F.lit(" others)")))


def currencies(rows: DataFrame, *keys: str) -> DataFrame:
    """The dominant currency of each group; ties go to the one seen first. Two levels, so that what is listed is one entry a code."""
    code = F.trim("currency")
    per = rows.groupBy(*keys, F.when(code != "", code).alias("code")).agg(F.count("*").alias("k"), F.min("row_seq").alias("first"))
    listed = F.collect_list(F.when(F.col("code").isNotNull(), F.struct((-F.col("k")).alias("k"), "first", "code")))
    return per.groupBy(*keys).agg(dominant_currency(listed).alias("currency"))


def by_group(rows: DataFrame, group: str, top: int | None = None) -> DataFrame:
    """The price ladder: one row for each value of ``group`` (blank: UNSPECIFIED), most rows first, ties by first place."""
    keyed = rows.withColumn("grp", F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit(UNSPECIFIED)))
    ladder = keyed.groupBy("grp").agg(F.count("*").alias("rows"), *price_columns(), F.count_if(F.col("stock_state") == "IN").alias("in_stock"), F.min("row_seq").alias("first_seq"))
    out = ladder.join(currencies(keyed, "grp"), "grp").withColumn("fill", F.col("n") / F.col("rows")).orderBy(F.desc("rows"), "first_seq")
    return out if top is None else out.limit(top)


def ladder_chart(ladder: DataFrame, most: int = CHART_GROUPS) -> DataFrame:
    """The groups with a price that have most rows, then by median."""
    return ladder.where(F.col("min").isNotNull()).orderBy(F.desc("rows"), "first_seq").limit(most).select("grp", "min", "median", "max", "rows").orderBy(F.desc("median"), "grp")


def nice_step(x: float) -> float:
    """Rounded up to 1, 2 or 5 times a power of ten."""
    if not x > 0:
        return 1.0
    power = 10.0 ** math.floor(math.log(x) / math.log(10))
    ratio = x / power
    return (1 if ratio <= 1 else 2 if ratio <= 2 else 5 if ratio <= 5 else 10) * power


def histogram(rows: DataFrame, bins: int = 12, most: int | None = 201) -> DataFrame:
    """(from_price, to_price, n) over equal steps of a round width, empty ones too; a single price is one bin of width 0."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min("price"), F.max("price")).first()
    schema = "from_price double, to_price double, n long"
    if low is None:
        return spark.createDataFrame([], schema)
    if low == high:
        return rows.where("price is not null").agg(F.lit(low).alias("from_price"), F.lit(low).alias("to_price"), F.count("*").alias("n"))
    step = nice_step((high - low) / bins)
    start = math.floor(low / step) * step
    count = int(math.floor((high - start) / step)) + 1
    count = count if most is None else min(most, count)
    at = F.least(F.greatest(F.floor((F.col("price") - start) / step), F.lit(0)), F.lit(count - 1)).cast("long")
    counted = rows.where("price is not null").groupBy(at.alias("id")).agg(F.count("*").alias("n"))
    return spark.range(count).join(counted, "id", "left").select((F.lit(start) + F.col("id") * step).alias("from_price"), (F.lit(start) + (F.col("id") + 1) * step).alias("to_price"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("from_price")


FACETS = ["store", "platform", "brand", "category", "verdict"]


def facets(rows: DataFrame, names: list[str] | None = None, most: int | None = FACET_VALUES) -> DataFrame:
    """(facet, value, n) of all facets in one pass: most frequent first, then Vietnamese collation; blanks are skipped, at most ``most`` values each (all: None)."""
    names = names or FACETS
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in names]))
    counted = rows.select(pairs.alias("p")).select("p.*").where("value is not null and value != ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), F.collate(F.col("value"), "vi"))
    return counted.withColumn("place", F.row_number().over(order)).where(F.lit(most).isNull() | (F.col("place") <= most))


def pivot(rows: DataFrame, group: str = "category", stores: int = TOP_STORES, groups: int = TOP_GROUPS) -> tuple[DataFrame, list[str]]:
    """Median price by group and store for the stores and groups with most priced rows: (grp, c0.., cheapest), and the stores in order.

    Only the names of the top stores reach the driver, at most ``stores``.
    """
    priced = rows.where("price is not null").select(F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit(UNSPECIFIED)).alias("grp"), F.coalesce("store", F.lit("(unknown)")).alias("store"), "price", "row_seq")
    top = [r["store"] for r in priced.groupBy("store").agg(F.count("*").alias("n"), F.min("row_seq").alias("f")).orderBy(F.desc("n"), "f").limit(stores).collect()]
    ranked = priced.groupBy("grp").agg(F.count("*").alias("n"), F.min("row_seq").alias("f"), *[half_up(F.percentile(F.when(F.col("store") == s, F.col("price")), F.lit(0.5)), 2).alias(f"c{i}") for i, s in enumerate(top)])
    cells = F.array(*[F.when(F.col(f"c{i}").isNotNull(), F.struct(F.col(f"c{i}").alias("m"), F.lit(i).alias("i"), F.lit(s).alias("s"))) for i, s in enumerate(top)]) if top else F.array()
    cheapest = F.array_min(F.array_compact(cells))["s"] if top else F.lit(None).cast("string")
    out = ranked.orderBy(F.desc("n"), "f").limit(groups).withColumn("cheapest", cheapest)
    return out.select("grp", *[f"c{i}" for i in range(len(top))], "cheapest"), top


def url_counts(rows: DataFrame) -> DataFrame:
    """Per source: scans and rows."""
    per = rows.groupBy("source_url", "scan_id").agg(F.count("*").alias("k"))
    return per.groupBy("source_url").agg(F.count("*").alias("scans"), F.sum("k").alias("rows")).orderBy(F.desc("scans"), F.desc("rows"))
