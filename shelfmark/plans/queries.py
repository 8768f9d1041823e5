"""The registered queries of the store: each returns the whole result over the driver's tables or over inline vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import html as H
from shelfmark.functions import money as M
from shelfmark.functions import robots as R
from shelfmark.functions import urls as U
from shelfmark.operators import diff, extract, sinks, stats, trust
from shelfmark.operators.snapshot import FilterSpec, filtered, first_wins, last_wins, latest_snapshot, page, ranked_scans
from shelfmark.plans import reports
from shelfmark.plans import vectors as V
from shelfmark.runtime import materialized, shared_folder
from shelfmark.schema import PRODUCT_FIELDS, half_up
from shelfmark.sources import captured
from shelfmark.sources.adapter import SEQ, Store, store
from shelfmark.sources.adapter import listings as adapter_listings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flat(rows: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns and the row's place as plain columns."""
    return rows.select(*columns, *[F.col(f"row_seq.{c}").alias(c) for c in SEQ])


CORE = ["scan_id", "captured_at", "source_url", "store", "external_id", "brand", "price", "currency", "stock_state"]


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).joined()


def inline(spark: SparkSession, values: list, name: str = "v") -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, {name} string")


@query
def store_load_join(spark, sf_dir):
    return flat(joined(spark, sf_dir), *CORE, "verdict", "rung")


@query
def latest_snapshot_rows(spark, sf_dir):
    return flat(latest_snapshot(joined(spark, sf_dir)), *CORE, "verdict")


@query
def filter_conjunction(spark, sf_dir):
    spec = FilterSpec(platforms=["ASIA", "EUROPE"], stock_state="IN", has_price=True, latest_only=False)
    return flat(filtered(joined(spark, sf_dir), spec), *CORE)


@query
def filter_price_range(spark, sf_dir):
    return flat(filtered(joined(spark, sf_dir), FilterSpec(price_from=1000.0, price_to=1500.0)), *CORE)


@query
def filter_keyword(spark, sf_dir):
    return flat(filtered(joined(spark, sf_dir), FilterSpec(keyword=" Brand#1", latest_only=False)), *CORE)


@query
def filter_verdict(spark, sf_dir):
    return flat(filtered(joined(spark, sf_dir), FilterSpec(verdicts=["LOW"])), *CORE, "verdict")


@query
def sort_nulls_last_page(spark, sf_dir):
    rows = filtered(joined(spark, sf_dir), FilterSpec())
    return flat(page(rows, 2, 100, "price", True), *CORE)


@query
def describe_price(spark, sf_dir):
    return stats.described(filtered(joined(spark, sf_dir), FilterSpec()))


def _ladder(by: str) -> Query:
    def run(spark, sf_dir):
        return stats.by_group(joined(spark, sf_dir), by).drop("first_seq")

    run.__name__ = f"group_ladder_{by}"
    return query(run)


for _by in ("brand", "category", "store", "platform"):
    _ladder(_by)


@query
def price_ladder_latest(spark, sf_dir):
    """The flagship: price ladder by brand over the latest snapshot, with the worst verdict of the scans behind it."""
    needed = ["scan_id", "brand", "price", "currency", "stock_state", "verdict", "row_seq"]
    rows = materialized(filtered(joined(spark, sf_dir), FilterSpec()).select(*needed), "selection")  # ladder, currencies and trust read it
    ladder = stats.by_group(rows, "brand").drop("first_seq")
    return ladder.join(trust.trust_summary(rows).select("worst", F.col("scans").alias("trust_scans")))


@query
def ladder_chart_top12(spark, sf_dir):
    return stats.ladder_chart(stats.by_group(joined(spark, sf_dir), "brand"))


@query
def price_histogram(spark, sf_dir):
    return stats.histogram(joined(spark, sf_dir), 12)


@query
def facet_counts(spark, sf_dir):
    return stats.facets(joined(spark, sf_dir))


@query
def facets_top5(spark, sf_dir):
    return stats.facets(joined(spark, sf_dir), ["brand", "category"], 5)


@query
def competitor_pivot_top(spark, sf_dir):
    """Fewer places than there are stores and brands."""
    return stats.pivot(joined(spark, sf_dir), "brand", 3, 10)[0]


@query
def sort_names(spark, sf_dir):
    """Blanks last both ways, and the alphabet of the language: d before đ before e."""
    rows = inline(spark, V.NAMES, "title").select("title", F.col("i").alias("row_seq"))
    pages = [page(rows, 1, 500, "title", down).select("title", "row_seq", F.lit(down).alias("down"), F.monotonically_increasing_id().alias("place")) for down in (False, True)]
    return pages[0].union(pages[1])


@query
def competitor_pivot(spark, sf_dir):
    return stats.pivot(joined(spark, sf_dir))[0]


@query
def trust_summary(spark, sf_dir):
    return trust.trust_summary(filtered(joined(spark, sf_dir), FilterSpec()))


@query
def trust_by_scan(spark, sf_dir):
    return trust.trust_by_scan(joined(spark, sf_dir))


@query
def trust_worst_by_store(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("store").agg(trust.worst(F.col("verdict")).alias("worst"), F.count("*").alias("rows"))


@query
def data_warnings(spark, sf_dir):
    return trust.warnings(joined(spark, sf_dir))


@query
def scan_fill_rates(spark, sf_dir):
    s = store(spark, sf_dir)
    return trust.fill_rates(s.listings, s.scans).select("scan_id", "verdict", "n", *[half_up(F.col(f"fill_{c}"), 4).alias(f"fill_{c}") for c in PRODUCT_FIELDS])


@query
def scan_verdicts(spark, sf_dir):
    return store(spark, sf_dir).scans.select("scan_id", "started", "finished", "rung", "n_rows", "price_fill_pct", "verdict")


@query
def missing_reason_topk(spark, sf_dir):
    rows = store(spark, sf_dir).listings
    why = F.map_from_entries(F.array_compact(F.array(F.when(F.col("price").isNull(), F.struct(F.lit("price").alias("k"), F.concat(F.lit("unreadable ("), "platform", F.lit(")")).alias("v"))), F.when(F.col("list_price").isNull(), F.struct(F.lit("list_price").alias("k"), F.concat(F.lit("none in "), "platform").alias("v"))), F.when(F.col("currency").isNull(), F.struct(F.lit("currency").alias("k"), F.concat(F.lit("unnamed by "), "platform").alias("v"))))))
    return trust.top_reasons(trust.reason_counts(rows.withColumn("missing_reason", why)), 2)


@query
def snapshot_diff(spark, sf_dir):
    s = store(spark, sf_dir)
    return diff.latest_changes(s.listings, s.scans)


@query
def diff_counts(spark, sf_dir):
    return snapshot_diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


def _keys(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = store(spark, sf_dir)
    old, new = diff.latest_two(s.listings, s.scans)
    return tuple(x.select("source_url", "external_id").distinct() for x in (old, new))


@query
def new_items_anti(spark, sf_dir):
    old, new = _keys(spark, sf_dir)
    return new.join(old, ["source_url", "external_id"], "left_anti")


@query
def gone_items_anti(spark, sf_dir):
    old, new = _keys(spark, sf_dir)
    return old.join(new, ["source_url", "external_id"], "left_anti")


@query
def items_in_both(spark, sf_dir):
    old, new = _keys(spark, sf_dir)
    return old.intersect(new)


@query
def consecutive_price_changes(spark, sf_dir):
    return diff.consecutive_changes(store(spark, sf_dir).listings).select("source_url", "external_id", "previous_scan", "scan_id", "previous_price", "price")


@query
def two_snapshot_union(spark, sf_dir):
    s = store(spark, sf_dir)
    old, new = diff.latest_two(s.listings, s.scans)
    return old.unionByName(new).groupBy("source_url").agg(F.count("*").alias("rows"), F.count_distinct("scan_id").alias("scans"))


@query
def ranked_scans_two(spark, sf_dir):
    return ranked_scans(store(spark, sf_dir).scans, 2)


@query
def dedupe_first_wins(spark, sf_dir):
    """Every 17th part has no id, and so stays."""
    rows = store(spark, sf_dir).listings.select(*CORE, "row_seq")
    return flat(first_wins(rows.withColumn("external_id", F.when(F.col("row_seq.l_partkey") % 17 != 0, F.col("external_id")))), *CORE)


@query
def dedupe_last_wins(spark, sf_dir):
    return flat(last_wins(store(spark, sf_dir).listings.select(*CORE, "row_seq"), "scan_id", "external_id"), *CORE)


@query
def url_scan_counts(spark, sf_dir):
    return stats.url_counts(store(spark, sf_dir).listings)


@query
def url_normalize(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("i"), "url")
    both = pages.unionByName(inline(spark, V.URLS, "url").select((-1 - F.col("i")).cast("long").alias("i"), "url"))
    n = U.normalised(F.col("url"))
    return both.select("i", n["url"].alias("clean"), n["origin"].alias("origin"), n["host"].alias("host"), n["path"].alias("path"), F.array_join(n["removed"], ",").alias("removed"))


@query
def url_classify(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").unionByName(inline(spark, V.URLS, "url").select("url"))
    return pages.groupBy(U.url_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query
def url_resolve(spark, sf_dir):
    rows = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(V.RESOLVE)], "i int, base string, href string")
    return rows.select("i", U.resolved(F.col("base"), F.col("href")).alias("address"))


@query
def url_multi_split(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(V.PASTED)), "row_seq int, text string")
    return sinks.queued(rows).select("url", "status", "row_seq", "at")


@query
def url_path_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", U.path_id(F.col("url")).alias("path_id"))


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query
def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.length(H.visible_text(F.col("html"))).cast("long").alias("n"), F.md5(H.visible_text(F.col("html"))).alias("digest"))


@query
def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.title(F.col("html")).alias("title"))


@query
def html_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(H.links(F.col("html"))).alias("at", "l")).select("page_id", F.col("at").cast("long").alias("at"), "l.href", "l.text")


@query
def html_entities(spark, sf_dir):
    return inline(spark, V.HTML).select("i", H.decoded(F.col("v")).alias("decoded"), H.title(F.col("v")).alias("title"), F.size(H.links(F.col("v"))).alias("links"))


@query
def html_blocks_removed(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.length(H.without_blocks(F.col("html"))).cast("long").alias("n"))


@query
def html_meta_canonical(spark, sf_dir):
    return inline(spark, [V.OG_PAGE, V.MICRO_PAGE, V.LD_PAGE]).select("i", H.meta(F.col("v"), "product:price:amount").alias("amount"), H.canonical(F.col("v")).alias("canonical"), H.page_currency(F.col("v")).alias("currency"), F.size(H.json_blocks(F.col("v"))).alias("blocks"))


@query
def js_shell_flag(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.is_shell(F.col("html")).alias("shell"), H.challenge(F.col("html"), F.lit(200)).alias("challenge"), H.platform(F.col("html")).alias("platform"))


@query
def sitemap_locations(spark, sf_dir):
    return inline(spark, V.SITEMAPS).select("i", H.is_sitemap_index(F.col("v")).alias("is_index"), F.posexplode(H.sitemap_locations(F.col("v"))).alias("at", "loc"))


@query
def price_parse_table(spark, sf_dir):
    p = M.human_price(F.col("v"))
    return inline(spark, V.PRICES).select("i", p["price"].alias("price"), p["currency"].alias("currency"), p["stripped"].alias("stripped"), p["reason"].alias("reason"))


@query
def flexible_price_table(spark, sf_dir):
    p = M.flexible_price(F.col("v"), F.lit("VND"))
    return inline(spark, V.PRICES).select("i", p["price"].alias("price"), p["currency"].alias("currency"), p["warning"].isNotNull().alias("warned"))


@query
def machine_number(spark, sf_dir):
    return inline(spark, V.NUMBERS).select("i", M.machine_number(F.col("v")).alias("value"), M.is_number(F.col("v")).alias("numeric"))


@query
def int_parse(spark, sf_dir):
    return inline(spark, V.COUNTS).select("i", M.whole_number(F.col("v")).alias("value"))


@query
def rating_parse(spark, sf_dir):
    return inline(spark, V.RATINGS).select("i", M.star_rating(F.col("v")).alias("value"))


@query
def number_format(spark, sf_dir):
    return store(spark, sf_dir).listings.where("price is not null").groupBy("store").agg(F.max("price").alias("m")).select("store", M.dotted(F.col("m")).alias("highest"))


@query
def price_mentions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(M.mentions(F.col("text"))).alias("at", "mention")).select("doc_id", F.col("at").cast("long").alias("at"), "mention")


def told(rows: DataFrame) -> DataFrame:
    """Reasons and warnings as plain text, counts as doubles."""
    why = F.array_sort(F.transform(F.map_entries("missing_reason"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("stock_qty", "review_count", "sold_count")})
    return rows.select("*", F.array_join(why, "; ").alias("missing"), F.array_join("row_warnings", "; ").alias("warned")).drop("missing_reason", "row_warnings")


def _captured(spark) -> DataFrame:
    return spark.createDataFrame(V.PAGES, "scan_id string, url string, body string")


@query
def price_mentions_asof(spark, sf_dir):
    keep = ["scan_id", "url"]
    return extract.nearest_anchor(extract.price_places(_captured(spark), keep), keep)


@query
def robots_rules(spark, sf_dir):
    files = spark.createDataFrame(V.ROBOTS, "origin string, body string")
    return R.rules(files).where("line >= 0")


@query
def robots_longest_match(spark, sf_dir):
    files = spark.createDataFrame(V.ROBOTS, "origin string, body string")
    paths = files.select("origin").crossJoin(spark.createDataFrame([(p,) for p in V.ROBOT_PATHS], "path string"))  # ten literal paths
    return R.allowed(paths, R.applying(R.rules(files), "shelfmarkbot"))


@query
def products_json_explode(spark, sf_dir):
    docs = spark.createDataFrame([("f", "https://a.example", "https://a.example", "VND", V.FEED)], "scan_id string, origin string, url string, currency string, body string")
    return extract.products_json(docs, ["scan_id"]).transform(told).withColumn("v_at", F.coalesce("v_at", F.lit(-1)))


@query
def woo_json_explode(spark, sf_dir):
    return extract.woo_json(spark.createDataFrame([("w", V.WOO)], "scan_id string, body string"), ["scan_id"]).transform(told)


@query
def jsonld_nodes(spark, sf_dir):
    return extract.json_ld(_captured(spark), ["scan_id", "url"]).transform(told)


@query
def microdata_open_graph(spark, sf_dir):
    return extract.micro_or_graph(_captured(spark), ["scan_id", "url"]).transform(told)


@query
def html_guess_rows(spark, sf_dir):
    return extract.html_guess(_captured(spark), ["scan_id", "url"]).transform(told)


@query
def rung_selection(spark, sf_dir):
    p = _captured(spark).select("scan_id", F.lit(200).alias("status"), "url", "body", F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("entered").alias("kind"), F.lit("VND").alias("currency"))
    feed = spark.createDataFrame([("s9", 200, "https://a.example/products.json", V.FEED, "feed"), ("s9", 200, "https://a.example/", V.GUESS_PAGE, "entered")], "scan_id string, status int, url string, body string, kind string")
    both = p.unionByName(feed.select("scan_id", "status", "url", "body", F.lit(None).cast("timestamp").alias("fetched_at"), "kind", F.lit("VND").alias("currency")))
    return extract.ladder(both).groupBy("scan_id", "rung").agg(F.count("*").alias("rows"), F.count("price").alias("priced"))


@query
def settings_overlay(spark, sf_dir):
    own = spark.createDataFrame([("request_delay_ms", "200"), ("page_cap", " 50 "), ("user_agent", "  ")], "key string, value string")
    return captured.settings(spark, own)


def _queue(spark, sf_dir) -> DataFrame:
    """Orders as a work queue: open ones wait, finished ones are done, the rest run or failed by priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderpriority") < "3", "RUNNING").otherwise("ERROR")
    return o.select(F.concat(F.lit("https://q.example/"), (F.col("o_orderkey") % 1000).cast("string")).alias("url"), status.alias("status"), F.lit(None).cast("string").alias("scan_id"), F.lit("").alias("note"), F.col("o_orderkey").alias("row_seq"))


@query
def queue_counts(spark, sf_dir):
    return captured.queue_counts(_queue(spark, sf_dir))


@query
def queue_next(spark, sf_dir):
    return captured.next_in_queue(_queue(spark, sf_dir)).select("url", "status", "row_seq")


@query
def queue_update(spark, sf_dir):
    return sinks.with_status(_queue(spark, sf_dir), "https://q.example/7", "DONE", "scan-7", "ok").groupBy("status", "scan_id", "note").agg(F.count("*").alias("n"))


@query
def host_failures(spark, sf_dir):
    """Events as a fetch log: users are hosts, event types decide the answer."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.lit("s").alias("scan_id"), (F.col("user_id") % 50).cast("string").alias("host"), F.when(F.col("value") < 20, 503).when(F.col("value") < 30, 404).otherwise(200).alias("status"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"))
    return captured.host_health(log)


@query
def scan_so_far(spark, sf_dir):
    return captured.scan_so_far(store(spark, sf_dir).listings, "NATION_3-1997", ["price", "currency", "title"])


@query
def csv_lines(spark, sf_dir):
    rows = filtered(joined(spark, sf_dir), FilterSpec())
    rows = rows.withColumn("title", F.concat("title", F.lit('; "'), "brand", F.lit('"')))
    return flat(rows.withColumn("line", sinks.csv_line(rows, ["scan_id", "title", "price", "currency", "source_url"])), "line")


@query
def formula_guard(spark, sf_dir):
    return inline(spark, V.CELLS).select("i", sinks.guarded(F.col("v")).alias("guarded"), sinks.csv_cell(F.col("v")).alias("cell"), sinks.cut_reason(F.concat("v", F.lit(" | "))).alias("reason"))


def ingested_rows(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """All listings, written as files, replayed once more, and taken in through the streaming sink."""
    from shelfmark.streaming.ingest import ingest

    rows = store(spark, sf_dir).listings
    rows = rows.withColumn("external_id", F.when(F.col("row_seq.l_partkey") % 17 != 0, F.col("external_id"))).withColumn("row_seq", F.xxhash64("row_seq"))
    for part in ("a", "b"):
        rows.write.mode("overwrite").parquet(f"{folder}/in/{part}")
    return ingest(spark, f"{folder}/in/*", f"{folder}/out", f"{folder}/checkpoint", schema=rows.schema)


def ingested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ingested_rows(spark, sf_dir, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    return got.groupBy("store", "scan_id").agg(F.count("*").alias("rows"), F.count_distinct("external_id").alias("ids"))


@query
def ingest_idempotent(spark, sf_dir):
    """All listings, every 17th part of them without an id, are ingested, and replayed as whole files and in other batches."""
    return ingested_counts(spark, sf_dir)


# --- documents and policies ---


@query
def json_bodies(spark, sf_dir):
    parsed = captured.json_body(F.col("v"))
    return inline(spark, V.BODIES).select("i", parsed.isNotNull().alias("parsed"), F.try_variant_get(parsed, "$.a", "string").alias("a"))


@query
def redirect_chains(spark, sf_dir):
    return captured.final_urls(spark.createDataFrame(V.REDIRECTS, "url string, target string"))


@query
def agent_tokens(spark, sf_dir):
    return inline(spark, V.AGENTS).select("i", R.agent_token(F.col("v")).alias("token"))


@query
def robots_policy(spark, sf_dir):
    answers = spark.createDataFrame(V.ROBOT_ANSWERS, "origin string, status int, body string")
    return R.allowed_by_origin(spark.createDataFrame(V.ROBOT_QUESTIONS, "origin string, path string"), answers, "shelfmarkbot")


@query
def robots_group_choice(spark, sf_dir):
    paths = spark.createDataFrame([(origin, path) for origin, _ in V.GROUPS for path in ("/x", "/y")], "origin string, path string")
    return R.allowed(paths, R.applying(R.rules(spark.createDataFrame(V.GROUPS, "origin string, body string")), "shelfmarkbot"))


def _fetches(spark) -> DataFrame:
    log = spark.createDataFrame([(i, *x) for i, x in enumerate(V.FETCHES)], "seq int, scan_id string, url string, status int, body string")
    return log.withColumn("fetched_at", F.lit(0).cast("timestamp")).withColumn("final_url", F.col("url"))


@query
def failure_log(spark, sf_dir):
    return captured.failure_log(_fetches(spark), 3)


@query
def host_windows(spark, sf_dir):
    """Events as a fetch log, counted by host and ten minutes."""
    from shelfmark.streaming.ingest import host_counts

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select((F.col("user_id") % 50).cast("string").alias("host"), F.when(F.col("value") < 20, 503).otherwise(200).alias("status"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return host_counts(log).select(F.unix_seconds("window.start").alias("begins"), "host", "requests", "failures")


@query
def ingest_resumes(spark, sf_dir):
    """Two files, then a third, then all again after the cursor was cleared: (run, batch, rows read, rows written so far, cursor)."""
    from shelfmark.streaming.ingest import cleared, cursor, ingest

    folder, out = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}", []
    rows = spark.range(6).select(F.lit("s").alias("scan_id"), F.lit("a").alias("store"), F.when(F.col("id") != 3, F.col("id").cast("string")).alias("external_id"), F.col("id").alias("row_seq"))
    for run, files in enumerate(([0, 1], [2], [])):
        for k in files:
            rows.where(f"row_seq div 2 = {k}").coalesce(1).write.parquet(f"{folder}/in/{k}")
        if run == 2:
            cleared(spark, f"{folder}/checkpoint")
        seen: list = []
        n = ingest(spark, f"{folder}/in/*", f"{folder}/out", f"{folder}/checkpoint", 1 if run < 2 else 9, rows.schema, seen).count()
        out += [(run, batch, read, n, cursor(spark, f"{folder}/checkpoint")) for batch, read in seen]
    return spark.createDataFrame(out, "run long, batch long, read long, written long, cursor long")


@query
def fetch_attempts(spark, sf_dir):
    return captured.attempts(_fetches(spark)).select("scan_id", "url", F.coalesce("status", F.lit(0)).alias("status"), "outcome", "try")


@query
def page_states(spark, sf_dir):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(V.STATES)], "i int, status int, body string")
    return rows.select("i", H.challenge(F.col("body"), F.col("status")).alias("challenge"), H.platform(F.col("body")).alias("platform"), H.is_shell(F.col("body")).alias("shell"))


@query
def scalar_text(spark, sf_dir):
    return inline(spark, V.SCALARS).select("i", extract.filled(F.col("v")).alias("value"))


@query
def day_gaps(spark, sf_dir):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(V.DAYS)], "i int, a string, b string")
    return rows.select("i", M.days_between(M.day(F.col("a")), M.day(F.col("b"))).alias("days"))


@query
def filter_descriptions(spark, sf_dir):
    specs = [FilterSpec(), FilterSpec(stores=["a", "b"], has_price=True, latest_only=False), FilterSpec(platforms=["P"], brands=["B"], categories=["C"], verdicts=["LOW"], sources=["u"], stock_state="IN", price_from=5, price_to=7.5, keyword=" x y ")]
    return inline(spark, [x.describe() for x in specs], "says")


@query
def sitemap_priority(spark, sf_dir):
    return extract.sitemap_plan(spark.createDataFrame(V.SITEMAP_PAGES, "scan_id string, seq int, url string, body string"))


@query
def ladder_gating(spark, sf_dir):
    pages = spark.createDataFrame(V.GATED_PAGES, "scan_id string, url string, body string, kind string")
    pages = pages.select("scan_id", F.lit(200).alias("status"), "url", "body", F.lit(None).cast("timestamp").alias("fetched_at"), "kind", F.lit("VND").alias("currency"))
    return extract.gated(spark.createDataFrame(V.REQUESTS, "scan_id string, url string, redirect string"), pages)


@query
def queue_worker(spark, sf_dir):
    from shelfmark.streaming.worker import worked

    urls = [u for _, u, _ in V.PAGES if "micro" not in u] + ["https://x.example/products/none"]
    queue = spark.createDataFrame([(i, u, "RUNNING" if i == 1 else "PENDING") for i, u in enumerate(urls)], "row_seq int, url string, status string")
    pages = _captured(spark).select(F.col("url").alias("entered"), F.lit(200).alias("status"), "url", "body", F.lit("entered").alias("kind"), F.lit("VND").alias("currency"))
    once = materialized(worked(queue, pages), "queue")
    again = worked(once.where("status = 'DONE'").select("url", "status", "row_seq"), pages)  # a second worker finds nothing to do
    return once.join(again.where("status = 'DONE'").select("row_seq"), "row_seq", "left").drop("row_seq")


# --- tables ---


@query
def stamped_rows(spark, sf_dir):
    docs = spark.createDataFrame([("f", "https://a.example", "https://a.example", "VND", V.FEED)], "scan_id string, origin string, url string, currency string, body string")
    rows = extract.products_json(docs, ["scan_id"]).withColumn("row_seq", (2 * F.col("p_at") + F.coalesce("v_at", F.lit(0)) - F.when(F.col("p_at") > 1, 1).otherwise(0)).cast("long"))
    return sinks.stamped(rows, "scan-1", "https://a.example/", "a.example", "Shopify").select("scan_id", "source_url", "store", "platform", "external_id", "price", "currency", "row_seq")


@query
def catalog_tables(spark, sf_dir):
    folder = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    first = captured.ensure_tables(spark, folder)
    spark.createDataFrame([(None,) * len(first["listings"].columns)], first["listings"].schema).write.mode("append").parquet(f"{folder}/listings")
    again = captured.ensure_tables(spark, folder)
    parts = [t.agg(F.lit(name).alias("name"), F.lit(len(t.columns)).cast("long").alias("columns"), F.count("*").alias("rows")) for name, t in again.items()]
    return parts[0].union(parts[1])


@query
def derived_table(spark, sf_dir):
    rows = sinks.padded(spark.createDataFrame(list(enumerate(V.RAGGED)), "at long, cells array<string>"))
    path = f"{shared_folder(spark)}/derived-{uuid.uuid4().hex}"
    sinks.rebuild(rows.where("at > 1"), path)
    return sinks.rebuild(rows, path)


@query
def ledger_append(spark, sf_dir):
    """All scans finished in two batches, the second with scans that the ledger has already."""
    rows = adapter_listings(spark, sf_dir)
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    sinks.append_ledger(rows.where("rung < 3"), path)
    sinks.append_ledger(rows, path)
    return spark.read.parquet(path).select("scan_id", "rung", "n_rows", "price_fill_pct", "verdict")


@query
def warning_counts(spark, sf_dir):
    rows = store(spark, sf_dir).listings
    return trust.warning_counts(rows.select(F.array_compact(F.array(M.implausible(F.col("price"), F.col("currency")), F.when(F.col("price").isNull(), F.concat(F.lit("no price ("), "external_id", F.lit(")"))))).alias("row_warnings")))


# --- reports ---


def _report(spark, sf_dir, code: str = "PRICE_LADDER", spec: FilterSpec = FilterSpec(), **params) -> reports.Report:
    return reports.report(store(spark, sf_dir), code, spec, **params)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def report_flat(spark, sf_dir):
    return _report(spark, sf_dir).flat()


@query
def report_shares(spark, sf_dir):
    return _report(spark, sf_dir, "PRICE_DISTRIBUTION").rows


@query
def report_tiles(spark, sf_dir):
    return _report(spark, sf_dir).tiles


@query
def report_sheet(spark, sf_dir):
    return reports.sheet(_report(spark, sf_dir), FilterSpec())


@query
def report_unknown(spark, sf_dir):
    return _report(spark, sf_dir, "NONE").warnings


@query
def report_csv(spark, sf_dir):
    path = f"{shared_folder(spark)}/report-csv-{uuid.uuid4().hex}"
    reports.export_csv(_report(spark, sf_dir, by="platform"), path)
    return _lines(spark, path)


@query
def rows_csv(spark, sf_dir):
    """All matching rows with all columns; a checksum of the cells would hide nothing, so the lines themselves are returned."""
    path = f"{shared_folder(spark)}/rows-csv-{uuid.uuid4().hex}"
    reports.export_rows(store(spark, sf_dir), FilterSpec(platforms=["ASIA"]), path, "price", True)
    return _lines(spark, path)


@query
def change_caveats(spark, sf_dir):
    s = store(spark, sf_dir)
    return diff.caveats(s.listings, s.scans)


@query
def start_page(spark, sf_dir):
    """Totals, sources, scans and reports as (part, name, n)."""
    parts = reports.page_bundle(store(spark, sf_dir))
    totals = parts["totals"].select(F.explode(F.array(*[F.struct(F.lit("totals").alias("part"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("rows", "scans")])).alias("x")).select("x.*")
    sources = parts["sources"].select(F.lit("scans of").alias("part"), F.col("source_url").alias("name"), F.col("scans").alias("n"))
    scans = parts["scans"].select(F.lit("rows of").alias("part"), F.col("scan_id").alias("name"), F.col("n_rows").alias("n"))
    catalog = parts["catalog"].select(F.lit("report").alias("part"), F.col("code").alias("name"), F.col("place").alias("n"))
    return totals.union(sources).union(scans).union(catalog)


@query
def data_query(spark, sf_dir):
    """Page 3 of the priced rows, and what is told of the whole match beside it."""
    found = reports.data_query(store(spark, sf_dir), FilterSpec(has_price=True), 3, 50, "price", True)
    whole = found.stats.crossJoin(found.trust.select("worst", "scans", "sentence"))  # one row by one row
    page = found.page.agg(F.count("*").alias("page_rows"), F.max("price").alias("page_max"), F.min("price").alias("page_min"))
    warned = found.warnings.agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("warnings"))
    return whole.crossJoin(page).crossJoin(warned).withColumn("total_rows", F.lit(found.total)).withColumn("says", F.lit(found.says))


__all__ = ["QUERIES", "Store"]
