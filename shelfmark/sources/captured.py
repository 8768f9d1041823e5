"""Captured documents instead of a live network: fetch logs, their policy outcomes, settings and the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.html import challenge
from shelfmark.runtime import exists
from shelfmark.schema import DEFAULT_SETTINGS, DELAY_FLOOR_MS, LEDGER_SCHEMA, LISTING_SCHEMA

PAGE_SCHEMA = "url string, status int, content_type string, body string, fetched_at timestamp, final_url string, scan_id string"


def json_body(body: Column) -> Column:
    """The parsed JSON of a body without its byte-order mark; null if it does not parse."""
    return F.try_parse_json(F.regexp_replace(body, r"^\ufeff", ""))


def fetch_outcome(status: Column, body: Column) -> Column:
    """ok, blocked (challenge or 403), retry (network error, 429, 503), refused (other 4xx), failed (other 5xx)."""
    return F.when(challenge(body, status).isNotNull(), "blocked").when(status.isNull() | status.isin(0, 429, 503), "retry").when(status.between(400, 499) & (status != 408), "refused").when(status >= 400, "failed").otherwise("ok")


def attempts(log: DataFrame, most: int = 3) -> DataFrame:
    """The answer that counts for each (scan_id, url): the first that needs no retry within ``most`` tries, else the last of them."""
    order = Window.partitionBy("scan_id", "url").orderBy("fetched_at", "seq")
    tried = log.withColumn("outcome", fetch_outcome(F.col("status"), F.col("body"))).withColumn("try", F.row_number().over(order)).where(F.col("try") <= most)
    return tried.groupBy("scan_id", "url").agg(F.min_by(F.struct("status", "body", "final_url", "outcome", "try"), F.struct((F.col("outcome") == "retry").alias("again"), F.when(F.col("outcome") == "retry", -F.col("try")).otherwise(F.col("try")))).alias("x")).select("scan_id", "url", "x.*")


def failure_log(log: DataFrame, most: int | None = 30) -> DataFrame:
    """(scan_id, place, url, outcome): the last ``most`` addresses (all: None) of each scan whose answer that counts is not ok, the newest first."""
    failed = attempts(log).where("outcome != 'ok'").join(log.groupBy("scan_id", "url").agg(F.max("seq").alias("seq")), ["scan_id", "url"])
    placed = failed.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("seq"))))
    return placed.where(F.lit(most).isNull() | (F.col("place") <= most)).select("scan_id", "place", "url", "outcome")


def host_health(log: DataFrame, failures: int = 3, cap: int = 500, stretch: str = "hour") -> DataFrame:
    """Per (scan_id, host): requests, the longest run of failures, whether the host is dead or over its cap. 4xx answers end a run; 5xx and 408 lengthen it."""
    bad = F.col("status").isNull() | (F.col("status") >= 500) | F.col("status").isin(0, 408)
    # runs are found within stretches of time, so that a busy host is not one task's work; stretches are then joined in order
    own = ["scan_id", "host", "stretch"]
    order = Window.partitionBy(*own).orderBy("fetched_at", "seq")
    rows = log.withColumn("stretch", F.date_trunc(stretch, "fetched_at")).withColumn("bad", bad)
    runs = rows.withColumn("run", F.sum((~bad).cast("int")).over(order)).groupBy(*own, "run").agg(F.count_if("bad").alias("k"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    parts = runs.groupBy(*own).agg(F.sum("n").alias("n"), F.max("k").alias("longest"), (F.max("run") == 0).alias("whole"), F.coalesce(F.max(F.when(F.col("run") == 0, F.col("k"))), zero).alias("head"), F.max_by("k", "run").alias("tail"))
    listed = F.array_sort(F.collect_list(F.struct("stretch", "longest", "whole", "head", "tail")))

    def step(state: Column, x: Column) -> Column:
        open_ = state["open"] + x["head"]
        return F.struct(F.greatest(state["best"], open_, x["longest"]).alias("best"), F.when(x["whole"], open_).otherwise(x["tail"]).alias("open"))

    longest = F.aggregate(listed, F.struct(zero.alias("best"), zero.alias("open")), step, lambda s: s["best"])
    return parts.groupBy("scan_id", "host").agg(F.sum("n").alias("requests"), longest.alias("failures_in_a_row")).withColumn("dead", F.col("failures_in_a_row") >= failures).withColumn("over_cap", F.col("requests") > cap)


def final_urls(redirects: DataFrame, hops: int = 5) -> DataFrame:
    """(url, final_url, hops) by following (url, target) at most ``hops`` times; a longer chain has final_url null."""
    out = redirects.select("url", F.col("target").alias("final_url"), F.lit(1).alias("hops"))
    step = redirects.select(F.col("url").alias("final_url"), F.col("target").alias("next"))
    for _ in range(hops):
        joined = out.join(step, "final_url", "left")
        out = joined.select("url", F.coalesce("next", "final_url").alias("final_url"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    out = out.select("url", "final_url", F.least("hops", F.lit(hops + 1)).alias("hops"))
    return out.withColumn("final_url", F.when(F.col("hops") <= hops, F.col("final_url")))


def settings(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(key, value): a stored value wins over the default unless blank; the delay has a floor."""
    base = spark.createDataFrame(DEFAULT_SETTINGS, "key string, fallback string")
    own = base.withColumn("own", F.lit(None).cast("string")) if overrides is None else base.join(overrides.select("key", F.nullif(F.trim("value"), F.lit("")).alias("own")), "key", "left")
    value = F.coalesce("own", "fallback")
    floor = F.greatest(F.coalesce(value.try_cast("long"), F.lit(DELAY_FLOOR_MS)), F.lit(DELAY_FLOOR_MS)).cast("string")
    return own.select("key", F.when(F.col("key") == "request_delay_ms", floor).otherwise(value).alias("value"))


def next_in_queue(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'PENDING'").orderBy("row_seq").limit(1)


def queue_counts(queue: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return queue.agg(n("PENDING", "RUNNING").alias("waiting"), n("DONE").alias("done"), n("ERROR").alias("failed"), F.count("*").alias("total"))


TABLES = {"listings": LISTING_SCHEMA, "scans": LEDGER_SCHEMA}


def ensure_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The listing and ledger tables in a folder, created with their columns if they are missing and left alone if not."""
    for name, schema in TABLES.items():
        if not exists(spark, f"{folder}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def scan_so_far(listings: DataFrame, scan_id: str, fields: list[str]) -> DataFrame:
    """What is already written of one scan: rows, distinct ids, filled fields."""
    return listings.where(F.col("scan_id") == scan_id).agg(F.count("*").alias("rows"), F.count_distinct("external_id").alias("ids"), *[F.count(c).alias(f"filled_{c}") for c in fields])
