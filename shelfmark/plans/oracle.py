"""ANSI SQL, as DuckDB runs it over the driver's tables, for the registered queries that SQL can express."""

from __future__ import annotations

from shelfmark.functions.html import ENTITIES
from shelfmark.functions.money import CURRENCIES
from shelfmark.functions.urls import CATEGORY_PATHS, PRODUCT_PATHS, TRACKING, UNSCANNABLE
from shelfmark.plans import expected
from shelfmark.plans import vectors as V
from shelfmark.schema import DEFAULT_SETTINGS, LISTING_COLUMNS, PRODUCT_FIELDS

SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
CORE = "scan_id, captured_at, source_url, store, external_id, brand, price, currency, stock_state"


def text(s: str) -> str:
    """A SQL literal; line ends and carriage returns by code, as literals keep them too."""
    return "'" + s.replace("'", "''") + "'"


def values(items: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {text(x)})" for i, x in enumerate(items)) + ") AS t(i, v)"


LISTINGS = f"""
raw AS (SELECT l.*, p_name, p_brand, p_type, p_size, n_name, n_nationkey, n_regionkey, r_name, year(l_shipdate) AS y,
  round(l_extendedprice * (1 - l_discount) / l_quantity, 0) AS raw_price, round(l_extendedprice / l_quantity, 0) AS full_price
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
priced AS (SELECT *, CASE WHEN NOT ((n_nationkey % 3 = 1 AND l_tax = 0) OR (n_nationkey % 3 = 2 AND l_tax <= 0.03)) THEN raw_price END AS price FROM raw),
listings AS (SELECT n_name || '-' || y AS scan_id, l_shipdate AS captured_at, 'https://' || lower(n_name) || '.example/' AS source_url, n_name AS store, r_name AS platform,
  l_partkey::VARCHAR AS external_id, 'https://' || lower(n_name) || '.example/p/' || l_partkey AS product_url, p_name AS title, p_brand AS brand, p_type AS category, l_suppkey::VARCHAR AS sku, p_size::VARCHAR AS variant,
  price, CASE WHEN full_price IS DISTINCT FROM price THEN full_price END AS list_price,
  CASE WHEN price IS NOT NULL THEN CASE WHEN n_regionkey IN (0, 1) THEN 'VND' WHEN n_regionkey = 2 THEN 'USD' WHEN n_regionkey = 3 THEN 'EUR' END END AS currency,
  CASE l_linestatus WHEN 'O' THEN 'IN' WHEN 'F' THEN 'OUT' END AS stock_state, (1 + (n_nationkey + y) % 5)::INT AS rung,
  NULL::BIGINT AS stock_qty, NULL::DOUBLE AS rating, NULL::BIGINT AS review_count, NULL::BIGINT AS sold_count, NULL::VARCHAR AS image_url, NULL::VARCHAR AS short_desc, {SEQ} FROM priced),
scans AS (SELECT scan_id, min(captured_at) AS started, max(captured_at) AS finished, max(rung) AS rung, count(*) AS n_rows, floor(count(price) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS price_fill_pct,
  CASE WHEN count(price)::DOUBLE / count(*) < 0.7 THEN 'LOW' WHEN max(rung) = 5 THEN 'LOW'
    WHEN max(rung) IN (1, 2) THEN CASE WHEN least(count(external_id), count(product_url), count(title), count(price))::DOUBLE / count(*) >= 0.95 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'MEDIUM' END AS verdict
  FROM listings GROUP BY scan_id),
joined AS (SELECT listings.* EXCLUDE (rung), scans.verdict, scans.rung FROM listings LEFT JOIN scans USING (scan_id)),
newest AS (SELECT source_url, scan_id FROM (SELECT source_url, scan_id, row_number() OVER (PARTITION BY source_url ORDER BY captured_at DESC, {SEQ}) AS k FROM listings) WHERE k = 1),
latest AS (SELECT joined.* FROM joined SEMI JOIN newest USING (source_url, scan_id))
"""

STATS = """count(price) AS n, min(price) AS min, floor(quantile_cont(price, 0.25) * 100 + 0.5) / 100 AS p25, floor(quantile_cont(price, 0.5) * 100 + 0.5) / 100 AS median,
  floor(quantile_cont(price, 0.75) * 100 + 0.5) / 100 AS p75, max(price) AS max, floor(avg(price) * 100 + 0.5) / 100 AS mean, sum(price) AS total"""


def over(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([LISTINGS.strip(), *more]) + "\n" + sql


def ladder(source: str, by: str) -> str:
    """CTEs grp_rows, codes and ladder."""
    return f"""keyed AS (SELECT *, coalesce(nullif({by}, ''), '(unspecified)') AS grp FROM {source}),
ladder_rows AS (SELECT grp, count(*) AS rows, {STATS}, count(*) FILTER (stock_state = 'IN') AS in_stock, min(row({SEQ})) AS first_seq FROM keyed GROUP BY grp),
codes AS (SELECT grp, trim(currency) AS code, count(*) AS k, min(row({SEQ})) AS first FROM keyed WHERE trim(currency) <> '' GROUP BY grp, trim(currency)),
money AS (SELECT grp, count(*) AS kinds, first(code ORDER BY k DESC, first) AS code FROM codes GROUP BY grp),
ladder AS (SELECT r.grp, rows, n, min, p25, median, p75, max, mean, total, in_stock, CASE WHEN kinds IS NULL THEN '' WHEN kinds = 1 THEN code ELSE code || ' (+' || (kinds - 1) || ' others)' END AS currency, n::DOUBLE / rows AS fill, first_seq
  FROM ladder_rows r LEFT JOIN money USING (grp))"""


TRUST = """per_scan AS (SELECT scan_id, max(verdict) AS verdict, count(*) AS rows, count(price) AS priced FROM latest GROUP BY scan_id),
trust AS (SELECT count(*) AS scans, count(*) FILTER (verdict = 'HIGH') AS scans_high, count(*) FILTER (verdict = 'MEDIUM') AS scans_medium, count(*) FILTER (verdict = 'LOW') AS scans_low, count(*) FILTER (verdict = 'UNSCANNABLE') AS scans_unscannable,
  count(*) FILTER (verdict IS NULL) AS unknown_scans, ['HIGH', 'MEDIUM', 'LOW', 'UNSCANNABLE'][max(list_position(['HIGH', 'MEDIUM', 'LOW', 'UNSCANNABLE'], verdict))] AS worst, sum(rows)::BIGINT AS rows, sum(priced)::BIGINT AS priced, sum(priced)::DOUBLE / sum(rows) AS price_fill FROM per_scan)"""

RANKED = f"""per_url AS (SELECT source_url, scan_id, first(captured_at ORDER BY {SEQ}) AS seen, count(*) AS rows FROM listings GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY seen DESC, scan_id DESC)::INT AS place FROM per_url),
twice AS (SELECT source_url FROM ranked WHERE place = 2),
old_rows AS (SELECT listings.* FROM listings SEMI JOIN (SELECT source_url, scan_id FROM ranked WHERE place = 2) USING (source_url, scan_id)),
new_rows AS (SELECT listings.* FROM listings SEMI JOIN (SELECT source_url, scan_id FROM ranked SEMI JOIN twice USING (source_url) WHERE place = 1) USING (source_url, scan_id))"""

DIFF = f"""old_side AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url, external_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS k FROM old_rows) WHERE k = 1),
new_side AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url, external_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS k FROM new_rows) WHERE k = 1),
both_sides AS (SELECT coalesce(n.source_url, o.source_url) AS source_url, coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.title, o.title) AS title, o.price AS old_price, n.price AS new_price, o.stock_state AS old_stock, n.stock_state AS new_stock, o.scan_id AS old_scan, n.scan_id AS new_scan,
  CASE WHEN o.scan_id IS NULL THEN 'NEW' WHEN n.scan_id IS NULL THEN 'GONE' WHEN o.price <> n.price THEN CASE WHEN n.price > o.price THEN 'PRICE_UP' ELSE 'PRICE_DOWN' END
    WHEN n.stock_state IS NOT NULL AND o.stock_state IS DISTINCT FROM n.stock_state THEN CASE WHEN n.stock_state = 'IN' THEN 'BACK_IN_STOCK' ELSE 'OUT_OF_STOCK' END END AS change
  FROM old_side o FULL JOIN new_side n ON o.source_url = n.source_url AND o.external_id = n.external_id),
changes AS (SELECT source_url, external_id, title, change, old_price, new_price, new_price - old_price AS delta, CASE WHEN old_price <> 0 THEN floor((new_price - old_price) / old_price * 100 * 10 + 0.5) / 10 END AS pct, old_stock, new_stock, old_scan, new_scan FROM both_sides WHERE change IS NOT NULL)"""

SQL: dict[str, str] = {
    "store_load_join": over(f"SELECT {CORE}, verdict, rung, {SEQ} FROM joined"),
    "latest_snapshot_rows": over(f"SELECT {CORE}, verdict, {SEQ} FROM latest"),
    "filter_conjunction": over(f"SELECT {CORE}, {SEQ} FROM joined WHERE platform IN ('ASIA', 'EUROPE') AND stock_state = 'IN' AND price IS NOT NULL"),
    "filter_price_range": over(f"SELECT {CORE}, {SEQ} FROM latest WHERE price BETWEEN 1000 AND 1500"),
    "filter_keyword": over(f"SELECT {CORE}, {SEQ} FROM joined WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(sku, '') || ' ' || coalesce(brand, '') || ' ' || coalesce(category, '') || ' ' || coalesce(variant, '')), 'brand#1')"),
    "filter_verdict": over(f"SELECT {CORE}, verdict, {SEQ} FROM latest WHERE verdict = 'LOW'"),
    "sort_nulls_last_page": over(f"SELECT {CORE}, {SEQ} FROM latest ORDER BY price DESC NULLS LAST, {SEQ} LIMIT 100 OFFSET least(100, greatest(0, (ceil((SELECT count(*) FROM latest) / 100.0) - 1)::BIGINT * 100))"),
    "describe_price": over(f"SELECT {STATS} FROM latest"),
    **{f"group_ladder_{by}": over("SELECT * EXCLUDE (first_seq) FROM ladder", ladder("joined", by)) for by in ("brand", "category", "store", "platform")},
    "price_ladder_latest": over("SELECT ladder.* EXCLUDE (first_seq), trust.worst, trust.scans AS trust_scans FROM ladder, trust", ladder("latest", "brand"), TRUST),
    "ladder_chart_top12": over("SELECT grp, min, median, max, rows FROM (SELECT * FROM ladder WHERE min IS NOT NULL ORDER BY rows DESC, first_seq LIMIT 12)", ladder("joined", "brand")),
    "price_histogram": over(
        "SELECT start + id * step AS from_price, start + (id + 1) * step AS to_price, coalesce(k, 0)::BIGINT AS n FROM f, (SELECT unnest(range(0, 201)) AS id) LEFT JOIN counted USING (id) WHERE id < bins",
        "m AS (SELECT min(price) AS lo, max(price) AS hi, (max(price) - min(price)) / 12 AS x FROM joined)",
        "e AS (SELECT *, pow(10, floor(log10(x))) AS p FROM m)",
        "s AS (SELECT *, p * CASE WHEN x / p <= 1 THEN 1 WHEN x / p <= 2 THEN 2 WHEN x / p <= 5 THEN 5 ELSE 10 END AS step FROM e)",
        "f AS (SELECT *, floor(lo / step) * step AS start, least(201, floor((hi - floor(lo / step) * step) / step) + 1)::BIGINT AS bins FROM s)",
        "counted AS (SELECT least(greatest(floor((price - start) / step), 0), bins - 1)::BIGINT AS id, count(*) AS k FROM joined, f WHERE price IS NOT NULL GROUP BY 1)"),
    "facet_counts": over(" UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS place FROM joined WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("store", "platform", "brand", "category", "verdict"))),
    "facets_top5": over("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS place FROM joined WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("brand", "category")) + ") WHERE place <= 5"),
    "trust_summary": over("""SELECT *, CASE WHEN rows = 0 THEN 'No rows.' ELSE rows || ' rows of ' || scans || ' scans: ' || CASE worst WHEN 'HIGH' THEN 'read from platform feeds.' WHEN 'MEDIUM' THEN 'read from web pages; check three rows by hand.'
  WHEN 'LOW' THEN 'guessed or short of prices; verify everything.' WHEN 'UNSCANNABLE' THEN 'nothing could be read.' ELSE 'trust unknown.' END END AS sentence,
  CASE worst WHEN 'HIGH' THEN 'use as it is' WHEN 'MEDIUM' THEN 'spot-check' WHEN 'LOW' THEN 'verify all' WHEN 'UNSCANNABLE' THEN 'get the data another way' END AS action FROM trust""", TRUST),
    "ledger_append": over("SELECT scan_id, rung, n_rows, price_fill_pct, verdict FROM scans"),
    "warning_counts": over("SELECT 'implausible VND price' AS warning, count(*) AS n FROM listings WHERE currency = 'VND' AND (price < 1000 OR price <> floor(price)) HAVING count(*) > 0 UNION ALL SELECT 'no price', count(*) FROM listings WHERE price IS NULL HAVING count(*) > 0"),
    "trust_by_scan": over(f"SELECT scan_id, max(verdict) AS verdict, max(rung) AS rung, first(source_url ORDER BY {SEQ}) AS source_url, first(captured_at ORDER BY {SEQ}) AS first_seen, count(*) AS rows FROM joined GROUP BY scan_id"),
    "trust_worst_by_store": over("SELECT store, ['HIGH', 'MEDIUM', 'LOW', 'UNSCANNABLE'][max(list_position(['HIGH', 'MEDIUM', 'LOW', 'UNSCANNABLE'], verdict))] AS worst, count(*) AS rows FROM joined GROUP BY store"),
    "data_warnings": over(
        """SELECT 1::INT AS ord, 'high' AS severity, 'mixed_currency' AS code, codes AS detail FROM a WHERE kinds > 1
UNION ALL SELECT 2, 'mid', 'blank_currency', floor(blank::DOUBLE / priced * 100 + 0.5)::BIGINT || '%' FROM a WHERE priced > 0 AND blank::DOUBLE / priced > 0.2
UNION ALL SELECT 3, 'high', 'few_prices', floor(priced::DOUBLE / n * 100 + 0.5)::BIGINT || '%' FROM a WHERE n > 0 AND priced::DOUBLE / n < 0.7
UNION ALL SELECT 4, 'mid', 'distant_scans', floor(days + 0.5)::BIGINT || ' days' FROM b WHERE scans > 1 AND days > 14""",
        "a AS (SELECT count(*) AS n, count(price) AS priced, count(*) FILTER (price IS NOT NULL AND coalesce(trim(currency), '') = '') AS blank, count(DISTINCT nullif(trim(currency), '')) AS kinds, string_agg(DISTINCT nullif(trim(currency), ''), ', ' ORDER BY nullif(trim(currency), '')) AS codes FROM joined)",
        f"seen AS (SELECT scan_id, first(captured_at ORDER BY {SEQ}) AS t FROM joined GROUP BY scan_id)",
        "b AS (SELECT count(*) AS scans, (epoch_us(max(t)) - epoch_us(min(t))) / 86400e6 AS days FROM seen)"),
    "scan_fill_rates": over("SELECT scan_id, verdict, n_rows AS n, " + ", ".join(f"floor(count({c})::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS fill_{c}" for c in PRODUCT_FIELDS) + " FROM joined JOIN (SELECT scan_id, n_rows FROM scans) USING (scan_id) GROUP BY ALL"),
    "scan_verdicts": over("SELECT scan_id, started, finished, rung, n_rows, price_fill_pct, verdict FROM scans"),
    "missing_reason_topk": over(
        "SELECT field, reason, n, place FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, reason)::INT AS place FROM counted) WHERE place <= 2",
        "why AS (SELECT 'price' AS field, 'unreadable' AS reason FROM listings WHERE price IS NULL UNION ALL SELECT 'list_price', 'none in ' || platform FROM listings WHERE list_price IS NULL UNION ALL SELECT 'currency', 'unnamed by ' || platform FROM listings WHERE currency IS NULL)",
        "counted AS (SELECT field, reason, count(*) AS n FROM why GROUP BY ALL)"),
    "snapshot_diff": over("SELECT * FROM changes", RANKED, DIFF),
    "diff_counts": over("SELECT change, count(*) AS n FROM changes GROUP BY change", RANKED, DIFF),
    "new_items_anti": over("SELECT DISTINCT source_url, external_id FROM new_rows ANTI JOIN old_rows USING (source_url, external_id)", RANKED),
    "gone_items_anti": over("SELECT DISTINCT source_url, external_id FROM old_rows ANTI JOIN new_rows USING (source_url, external_id)", RANKED),
    "items_in_both": over("SELECT source_url, external_id FROM old_rows INTERSECT SELECT source_url, external_id FROM new_rows", RANKED),
    "consecutive_price_changes": over(
        "SELECT source_url, external_id, previous_scan, scan_id, previous_price, price FROM steps WHERE previous_scan IS NOT NULL AND price <> previous_price",
        "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url, scan_id, external_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS k FROM listings) WHERE k = 1)",
        "steps AS (SELECT source_url, external_id, scan_id, price, lag(price) OVER w AS previous_price, lag(scan_id) OVER w AS previous_scan FROM one WINDOW w AS (PARTITION BY source_url, external_id ORDER BY captured_at, scan_id))"),
    "two_snapshot_union": over("SELECT source_url, count(*) AS rows, count(DISTINCT scan_id) AS scans FROM (SELECT * FROM old_rows UNION ALL SELECT * FROM new_rows) GROUP BY source_url", RANKED),
    "ranked_scans_two": over("SELECT source_url, scan_id, seen, rows, place FROM ranked WHERE place <= 2", RANKED),
    "dedupe_first_wins": over(f"SELECT {CORE.replace('external_id', 'CASE WHEN l_partkey % 17 <> 0 THEN external_id END AS external_id')}, {SEQ} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, external_id ORDER BY {SEQ}) AS k FROM listings) WHERE k = 1 OR l_partkey % 17 = 0"),
    "dedupe_last_wins": over(f"SELECT {CORE}, {SEQ} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, external_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS k FROM listings) WHERE k = 1"),
    "url_scan_counts": over("SELECT source_url, count(DISTINCT scan_id) AS scans, count(*) AS rows FROM listings GROUP BY source_url"),
    "number_format": over("SELECT store, replace(format('{:,}', floor(max(price) + 0.5)::BIGINT), ',', '.') AS highest FROM listings WHERE price IS NOT NULL GROUP BY store"),
    "scan_so_far": over("SELECT count(*) AS rows, count(DISTINCT external_id) AS ids, count(price) AS filled_price, count(currency) AS filled_currency, count(title) AS filled_title FROM listings WHERE scan_id = 'NATION_3-1997'"),
    "csv_lines": over(f"SELECT concat_ws(',', scan_id, title, coalesce(price::VARCHAR, ''), coalesce(currency, ''), source_url) AS line, {SEQ} FROM latest").replace("scan_id, title, coalesce", "scan_id, '\"' || title || '; \"\"' || brand || '\"\"\"', coalesce"),
    "ingest_idempotent": over("SELECT store, scan_id, count(DISTINCT external_id) FILTER (l_partkey % 17 <> 0) + count(*) FILTER (l_partkey % 17 = 0) AS rows, count(DISTINCT external_id) FILTER (l_partkey % 17 <> 0) AS ids FROM listings GROUP BY store, scan_id"),
}

# the eight stores with most priced rows, and the forty categories; six there are
SQL["competitor_pivot"] = over(
    "SELECT grp, c0, c1, c2, c3, c4, c5, c6, c7, CASE " + " ".join(f"WHEN c{i} = lowest THEN s{i}" for i in range(8)) + " END AS cheapest FROM (SELECT *, least(c0, c1, c2, c3, c4, c5, c6, c7) AS lowest FROM cells)",
    f"stores8 AS (SELECT store, (row_number() OVER (ORDER BY n DESC, f))::INT - 1 AS i FROM (SELECT store, count(*) AS n, min(row({SEQ})) AS f FROM joined WHERE price IS NOT NULL GROUP BY store) ORDER BY i LIMIT 8)",
    "cells AS (SELECT category AS grp, " + ", ".join(f"floor(quantile_cont(price, 0.5) FILTER (i = {k}) * 100 + 0.5) / 100 AS c{k}, (SELECT store FROM stores8 WHERE i = {k}) AS s{k}" for k in range(8)) + " FROM joined LEFT JOIN stores8 USING (store) WHERE price IS NOT NULL GROUP BY category)",
)

SQL["competitor_pivot_top"] = over(
    "SELECT grp, c0, c1, c2, CASE " + " ".join(f"WHEN c{i} = lowest THEN s{i}" for i in range(3)) + " END AS cheapest FROM (SELECT *, least(c0, c1, c2) AS lowest FROM cells ORDER BY n DESC, f LIMIT 10)",
    f"stores3 AS (SELECT store, (row_number() OVER (ORDER BY n DESC, f))::INT - 1 AS i FROM (SELECT store, count(*) AS n, min(row({SEQ})) AS f FROM joined WHERE price IS NOT NULL GROUP BY store) ORDER BY i LIMIT 3)",
    "cells AS (SELECT brand AS grp, count(*) AS n, min(row(" + SEQ + ")) AS f, " + ", ".join(f"floor(quantile_cont(price, 0.5) FILTER (i = {k}) * 100 + 0.5) / 100 AS c{k}, (SELECT store FROM stores3 WHERE i = {k}) AS s{k}" for k in range(3)) + " FROM joined LEFT JOIN stores3 USING (store) WHERE price IS NOT NULL GROUP BY brand)",
)

# --- URLs ---
_URL_PARTS = r"""s0 AS (SELECT i, trim(url, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM src),
s1 AS (SELECT i, CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.\-]*://') THEN t WHEN starts_with(t, '//') THEN 'https:' || t WHEN regexp_matches(t, '^[a-zA-Z0-9][a-zA-Z0-9.\-]*\.[a-zA-Z]{2,}(/|$|\?|#)') THEN 'https://' || t END AS s FROM s0),
s2 AS (SELECT i, regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['scheme', 'authority', 'path', 'query', 'fragment']) AS p FROM s1),
s3 AS (SELECT i, lower(p.scheme) AS scheme, regexp_replace(p.authority, '^.*@', '') AS auth, p.path AS path, substr(p.query, 2) AS query FROM s2),
s4 AS (SELECT *, regexp_extract(auth, ':([0-9]+)$', 1) AS port, regexp_replace(lower(regexp_replace(auth, ':[0-9]+$', '')), '\.$', '') AS host FROM s3),
s5 AS (SELECT *, scheme IN ('http', 'https') AND host <> '' AND (contains(host, '.') OR host = 'localhost') AS ok, regexp_replace(path, '/{2,}', '/', 'g') AS flat FROM s4),
n AS (SELECT i, ok, host, CASE WHEN flat = '' THEN '/' WHEN length(flat) > 1 AND ends_with(flat, '/') THEN substr(flat, 1, length(flat) - 1) ELSE flat END AS path,
  scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END AS origin,
  list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs FROM s5),
q AS (SELECT *, list_filter(pairs, lambda x: NOT trk(x)) AS kept, list_transform(list_filter(pairs, lambda x: trk(x)), lambda x: split_part(x, '=', 1)) AS gone FROM n)"""
_TRACKS = "(starts_with(lower(split_part(x, '=', 1)), 'utm_') OR lower(split_part(x, '=', 1)) IN (" + ", ".join(map(text, TRACKING)) + "))"
_URL_CTES = _URL_PARTS.replace("trk(x)", _TRACKS)


def _any(patterns: list[str]) -> str:
    return text("(?i)(?:" + "|".join(p.replace(r"\z", "$") for p in patterns) + ")")


SQL["url_normalize"] = f"WITH src AS (SELECT page_id AS i, url FROM pages UNION ALL SELECT -1 - i, v FROM {values(V.URLS)}), {_URL_CTES} SELECT i, CASE WHEN ok THEN origin || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS clean, CASE WHEN ok THEN origin END AS origin, CASE WHEN ok THEN host END AS host, CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN array_to_string(gone, ',') END AS removed FROM q"
_MARKET = " OR ".join(f"regexp_matches(host, {text(p.replace(chr(92) + 'z', '$'))})" for _, p in UNSCANNABLE)
SQL["url_classify"] = f"""WITH src AS (SELECT page_id AS i, url FROM pages UNION ALL SELECT -1 - i, v FROM {values(V.URLS)}), {_URL_CTES},
k AS (SELECT CASE WHEN NOT coalesce(ok, false) THEN 'UNKNOWN'
  WHEN {_MARKET} THEN CASE WHEN regexp_matches(path, {_any(PRODUCT_PATHS)}) OR regexp_matches(path, '(?i)/item/') THEN 'MARKETPLACE_PRODUCT' WHEN regexp_matches(path, '(?i)/shop/[^/]+') OR regexp_matches(path, '(?i)^/shop/') OR regexp_matches(path, '^/[^/]+$') OR path = '/' THEN 'MARKETPLACE_SHOP' ELSE 'UNKNOWN' END
  WHEN path = '/' THEN 'STORE' WHEN regexp_matches(path, {_any(PRODUCT_PATHS)}) THEN 'PRODUCT' WHEN regexp_matches(path, {_any(CATEGORY_PATHS)}) THEN 'CATEGORY' ELSE 'UNKNOWN' END AS kind FROM q)
SELECT kind, count(*) AS n FROM k GROUP BY kind"""
SQL["url_path_id"] = f"WITH src AS (SELECT page_id AS i, url FROM pages), {_URL_CTES} SELECT i AS page_id, CASE WHEN regexp_replace(path, '/$', '') = '' THEN '/' ELSE regexp_replace(path, '/$', '') END AS path_id FROM s5 WHERE ok"

# --- HTML ---
_NO_BLOCKS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


def _decode(x: str) -> str:
    out = f"replace({x}, '&amp;', chr(57360))"
    for name, value in ENTITIES:
        out = f"replace({out}, '{name}', {text(value)})"
    return f"replace({out}, chr(57360), '&')"


def _visible(x: str) -> str:
    return "trim(regexp_replace(" + _decode(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


SQL["html_blocks_removed"] = f"SELECT page_id, length({_NO_BLOCKS})::BIGINT AS n FROM pages"
SQL["html_text"] = f"SELECT page_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT page_id, {_visible(_NO_BLOCKS)} AS t FROM pages)"
SQL["html_title"] = f"SELECT page_id, coalesce(nullif({_visible('h')}, ''), {_visible('t')}) AS title FROM (SELECT page_id, regexp_extract(html, '(?is)<h1\\b[^>]*>(.{{0,400}}?)</h1>', 1) AS h, regexp_extract(html, '(?is)<title\\b[^>]*>(.{{0,400}}?)</title>', 1) AS t FROM pages)"
SQL["js_shell_flag"] = f"""WITH t AS (SELECT page_id, html, {_visible(_NO_BLOCKS)} AS v FROM pages),
f AS (SELECT *, regexp_matches(v, '(?:[₫đ$€£¥]|VNĐ|VND)\\s*[0-9][0-9., ]{{2,}}|[0-9][0-9., ]{{2,}}\\s*(?:[₫đ$€£¥]|VNĐ|VND)') AS priced FROM t)
SELECT page_id, CASE WHEN trim(html) = '' THEN true ELSE NOT priced AND ((length(v) < 600 AND length(html) > 2000) OR (length(v)::DOUBLE / length(html) < 0.02 AND length(html) > 20000)) END AS shell, NULL::VARCHAR AS challenge, '' AS platform FROM f"""

# --- numbers ---
SQL["machine_number"] = f"SELECT i, CASE WHEN regexp_matches(trim(v), '^[0-9]+(\\.[0-9]+)?$') THEN trim(v)::DOUBLE END AS value, regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS numeric FROM {values(V.NUMBERS)}"
SQL["int_parse"] = f"SELECT i, CASE WHEN regexp_matches(d, '^[0-9]+$') THEN d::BIGINT END AS value FROM (SELECT i, regexp_replace(trim(v), '[., ]', '', 'g') AS d FROM {values(V.COUNTS)})"
SQL["rating_parse"] = f"SELECT i, CASE WHEN regexp_matches(d, '^[0-9]{{1,2}}(\\.[0-9]{{1,2}})?$') AND try_cast(d AS DOUBLE) <= 5 THEN d::DOUBLE END AS value FROM (SELECT i, regexp_replace(trim(v), ',', '.') AS d FROM {values(V.RATINGS)})"
SQL["price_mentions"] = '''WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?:[₫đ$€£¥]|VNĐ|VND)\\s*[0-9][0-9., ]{2,}|[0-9][0-9., ]{2,}\\s*(?:[₫đ$€£¥]|VNĐ|VND)') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS mention, generate_subscripts(l, 1) - 1 AS "at" FROM m) SELECT doc_id, "at"::BIGINT AS "at", mention FROM u WHERE "at" < 400'''

# --- settings, queue, fetch log ---
SQL["settings_overlay"] = "SELECT d.key, CASE WHEN d.key = 'request_delay_ms' THEN greatest(coalesce(nullif(trim(o.value), ''), d.value)::BIGINT, 1500)::VARCHAR ELSE coalesce(nullif(trim(o.value), ''), d.value) END AS value FROM (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in DEFAULT_SETTINGS) + ") AS d(key, value) LEFT JOIN (VALUES ('request_delay_ms', '200'), ('page_cap', ' 50 '), ('user_agent', '  ')) AS o(key, value) ON d.key = o.key"
_QUEUE = "q AS (SELECT 'https://q.example/' || (o_orderkey % 1000) AS url, CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderpriority < '3' THEN 'RUNNING' ELSE 'ERROR' END AS status, o_orderkey AS row_seq FROM orders)"
SQL["queue_counts"] = f"WITH {_QUEUE} SELECT count(*) FILTER (status IN ('PENDING', 'RUNNING')) AS waiting, count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'ERROR') AS failed, count(*) AS total FROM q"
SQL["queue_next"] = f"WITH {_QUEUE} SELECT url, status, row_seq FROM q WHERE status = 'PENDING' ORDER BY row_seq LIMIT 1"
SQL["queue_update"] = f"WITH {_QUEUE}, u AS (SELECT *, url = 'https://q.example/7' AND status <> 'DONE' AS own FROM q) SELECT CASE WHEN own THEN 'DONE' ELSE status END AS status, CASE WHEN own THEN 'scan-7' END AS scan_id, CASE WHEN own THEN 'ok' ELSE '' END AS note, count(*) AS n FROM u GROUP BY ALL"
SQL["host_failures"] = """WITH log AS (SELECT 's' AS scan_id, (user_id % 50)::VARCHAR AS host, value < 20 AS bad, ts, event_id FROM events),
r AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY host ORDER BY ts, event_id) AS run FROM log), k AS (SELECT scan_id, host, run, count(*) FILTER (bad) AS k, count(*) AS n FROM r GROUP BY ALL)
SELECT scan_id, host, sum(n)::BIGINT AS requests, max(k) AS failures_in_a_row, max(k) >= 3 AS dead, sum(n) > 500 AS over_cap FROM k GROUP BY scan_id, host"""

SQL["host_windows"] = "SELECT epoch(time_bucket(INTERVAL '10 minutes', ts::TIMESTAMP))::BIGINT AS begins, (user_id % 50)::VARCHAR AS host, count(*) AS requests, count(*) FILTER (value < 20) AS failures FROM events GROUP BY ALL"

# --- cells, links, sitemaps ---
SQL["formula_guard"] = f"""SELECT i, CASE WHEN substr(v, 1, 1) IN ('=', '+', '-', '@') THEN '''' || v ELSE v END AS guarded,
CASE WHEN regexp_matches(v, '[",;\\n\\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell, regexp_replace(v || ' | ', '[\\s|]+$', '') AS reason FROM {values(V.CELLS)}"""
SQL["html_links"] = f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.{{0,300}}?</a>') AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS k FROM a),
h AS (SELECT page_id, k, {_decode("regexp_extract(regexp_extract(tag, '(?is)^<a\\b[^>]*>'), '(?i)href\\s*=\\s*(?:\"([^\"]*)\"|[^\\s\">]+)', 1)")} AS href, {_visible("regexp_replace(tag, '(?is)^<a\\b[^>]*>|</a>$', '', 'g')")} AS text FROM u)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS "at", href, text FROM h WHERE href <> ''"""
SQL["sitemap_locations"] = f"""WITH x AS (SELECT i, regexp_matches(v, '(?i)<sitemapindex') AS is_index, regexp_extract_all(v, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1) AS l FROM {values(V.SITEMAPS)}),
u AS (SELECT i, is_index, trim(replace(unnest(l), '&amp;', '&')) AS loc, generate_subscripts(l, 1) AS k FROM x)
SELECT i, is_index, (row_number() OVER (PARTITION BY i ORDER BY k) - 1)::INT AS "at", loc FROM u WHERE loc <> ''"""

# --- prices ---
_SAME = "CASE WHEN regexp_matches({0}, '^[0-9]{{1,3}}([.][0-9]{{3}})+$') OR regexp_matches({0}, '^[0-9]{{1,3}}(,[0-9]{{3}})+$') OR regexp_matches({0}, '^[0-9]{{1,3}}( [0-9]{{3}})+$') THEN '' WHEN NOT regexp_matches({0}, '^[0-9]{{1,3}}[., ]') THEN 'first_group_not_1_to_3_digits' ELSE 'later_group_not_3_digits (' || {0} || ')' END"
_STEPS = [f"p0 AS (SELECT i, v, trim(v) AS raw, trim(v) AS s, []::VARCHAR[] AS codes, []::VARCHAR[] AS strips FROM {values(V.PRICES)})"]
for _k, (_pattern, _code) in enumerate(CURRENCIES):
    _STEPS.append(f"p{_k + 1} AS (SELECT i, v, raw, regexp_replace(s, {text(_pattern)}, ' ', 'g') AS s, CASE WHEN regexp_matches(s, {text(_pattern)}) THEN list_append(codes, '{_code}') ELSE codes END AS codes, CASE WHEN regexp_matches(s, {text(_pattern)}) THEN list_append(strips, array_to_string(regexp_extract_all(s, {text(_pattern)}), '')) ELSE strips END AS strips FROM p{_k})")
SQL["price_parse_table"] = "WITH " + ",\n".join(_STEPS) + f""",
b AS (SELECT *, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS bare FROM p{len(CURRENCIES)}),
g AS (SELECT *, contains(bare, '.')::INT + contains(bare, ',')::INT + contains(bare, ' ')::INT AS kinds, regexp_extract(bare, '^(.*)[., ]([0-9]*)$', 1) AS whole, regexp_extract(bare, '^(.*)[., ]([0-9]*)$', 2) AS part, regexp_extract(bare, '([., ])[0-9]*$', 1) AS last FROM b),
r AS (SELECT *, CASE WHEN kinds = 0 THEN '' WHEN kinds > 2 THEN 'too_many_separators' WHEN kinds = 1 THEN {_SAME.format("bare")} WHEN NOT regexp_matches(part, '^[0-9]{{1,2}}$') THEN 'bad_fraction' WHEN contains(whole, last) THEN 'first_group_not_1_to_3_digits' ELSE {_SAME.format("whole")} END AS why,
  CASE WHEN raw = '' THEN 'blank' WHEN len(codes) > 1 THEN 'different_currencies' WHEN regexp_matches(s, '(?i)[0-9]\\s*((k|nghìn|nghin|ngàn|ngan|tr|trieu|triệu|m|cu|ty|b)([^0-9A-Za-z_]|$)|(củ|tỷ)[0-9A-Za-z_])') THEN 'shorthand (' || trim(v) || ')'
    WHEN regexp_matches(s, '[a-zA-ZÀ-ỹ]') THEN 'letters_left' WHEN contains(s, '-') THEN 'minus_or_range' WHEN bare = '' THEN 'no_digits' WHEN NOT regexp_matches(bare, '^[0-9][0-9., ]*$') THEN 'odd_character' END AS early FROM g)
SELECT i, CASE WHEN early IS NULL AND why = '' THEN CASE WHEN kinds < 2 THEN regexp_replace(bare, '[., ]', '', 'g')::DOUBLE ELSE (regexp_replace(whole, '[., ]', '', 'g') || '.' || part)::DOUBLE END END AS price,
  CASE WHEN early IS NULL OR early NOT IN ('blank', 'different_currencies') THEN codes[1] END AS currency, CASE WHEN raw = '' THEN '' WHEN len(codes) > 1 THEN strips[2] ELSE coalesce(strips[1], '') END AS stripped,
  coalesce(early, nullif(why, ''), CASE WHEN len(codes) = 0 THEN 'no_currency_seen' END, '') AS reason FROM r"""
SQL["flexible_price_table"] = f"""WITH h AS ({SQL["price_parse_table"]}),
m AS (SELECT h.*, CASE WHEN regexp_matches(trim(v), '^[0-9]+(\\.[0-9]+)?$') THEN trim(v)::DOUBLE END AS machine FROM h JOIN {values(V.PRICES)} USING (i)),
r AS (SELECT i, coalesce(machine, price) AS price, CASE WHEN machine IS NOT NULL THEN 'VND' ELSE coalesce(currency, CASE WHEN price IS NOT NULL THEN 'VND' END) END AS currency FROM m)
SELECT i, price, currency, coalesce(currency = 'VND' AND (price < 1000 OR price <> floor(price)), false) AS warned FROM r"""

# --- robots: the lines that apply to the agent, as patterns ---
SQL["robots_longest_match"] = (
    "WITH rules(origin, kind, value, pattern, n) AS (VALUES ('https://a.example', 'disallow', '/private', '^/private', 8), ('https://a.example', 'allow', '/private/open', '^/private/open', 13), ('https://b.example', 'disallow', '/*.pdf$', '^/.*\\.pdf$', 6), ('https://b.example', 'disallow', '/x*y', '^/x.*y', 4)), "
    + "o(origin) AS (VALUES " + ", ".join(f"({text(origin)})" for origin, _ in V.ROBOTS) + "), p(path) AS (VALUES " + ", ".join(f"({text(x)})" for x in V.ROBOT_PATHS) + "), "
    + "m AS (SELECT o.origin, p.path, max(n) FILTER (kind = 'allow') AS a, max(n) FILTER (kind = 'disallow') AS d, max_by(value, n) FILTER (kind = 'disallow') AS rule FROM o CROSS JOIN p LEFT JOIN rules r ON r.origin = o.origin AND regexp_matches(CASE WHEN p.path = '' THEN '/' ELSE p.path END, r.pattern) GROUP BY o.origin, p.path) "
    + "SELECT origin, path, NOT coalesce(d > coalesce(a, -1), false) AS allowed, CASE WHEN d > coalesce(a, -1) THEN rule END AS rule FROM m"
)

# --- reports ---
_FLAT = "grp, rows, floor(n::DOUBLE / rows * 100 * 10 + 0.5) / 10 AS fill, min, p25, median, p75, max, in_stock, currency"
_LABELS = ["Group", "Rows", "% priced", "Lowest", "25%", "Median", "75%", "Highest", "In stock", "Currency"]
_NAMES = ["grp", "rows", "fill", "min", "p25", "median", "p75", "max", "in_stock", "currency"]
SQL["report_flat"] = over("SELECT " + ", ".join(f'{n} AS "{x}"' for n, x in zip(_NAMES, _LABELS, strict=True)) + f" FROM (SELECT {_FLAT} FROM ladder)", ladder("latest", "brand"))
_BASE = "WITH " + LISTINGS.strip()


def _selecting(name: str, source: str) -> str:
    """The SQL of a query over all rows, over other rows instead."""
    return _BASE + SQL[name][len(_BASE) :].replace("FROM joined", f"FROM {source}")


SQL["report_shares"] = _selecting("price_histogram", "latest").replace("coalesce(k, 0)::BIGINT AS n FROM f", "coalesce(k, 0)::BIGINT AS n, coalesce(k, 0)::DOUBLE / (SELECT count(price) FROM latest) AS share FROM f")
SQL["report_tiles"] = over(f"SELECT count(*) AS rows, count(DISTINCT scan_id) AS scans, {STATS}, count(price)::DOUBLE / count(*) AS fill FROM latest")
_TRUST_SAYS = SQL["trust_summary"].split("FROM trust")[0].rsplit("SELECT *, ", 1)[1]
_WARN_CTES, _WARN_BODY = _selecting("data_warnings", "latest")[len("WITH ") :].split("\nSELECT 1::INT AS ord", 1)
_SAYS = f"says AS (SELECT worst, {_TRUST_SAYS} FROM trust), warned AS (SELECT *, row_number() OVER (ORDER BY ord) AS k, count(*) OVER () AS many FROM (SELECT 1::INT AS ord{_WARN_BODY}))"
_BLANKS = lambda k: ", ''" * k
SQL["report_sheet"] = f"""WITH {_WARN_CTES}, {ladder("latest", "brand")}, {TRUST}, {_SAYS}, w AS (SELECT count(*) AS n FROM warned),
few AS (SELECT grp, row_number() OVER (ORDER BY rows DESC, first_seq) AS k, count(*) OVER () AS many FROM ladder WHERE n > 0 AND n < 5),
small AS (SELECT max(many) || ': ' || string_agg(grp, ', ' ORDER BY k) FILTER (k <= 5) || CASE WHEN max(many) > 5 THEN '...' ELSE '' END AS detail FROM few HAVING count(*) > 0),
top AS (SELECT 0 AS "at", 'Price ladder by brand' AS c0, '' AS c1, '' AS c2, '' AS c3{"".join(f", '' AS c{i}" for i in range(4, 10))} UNION ALL SELECT 1, 'Trust', worst{_BLANKS(8)} FROM says UNION ALL SELECT 2, '', sentence{_BLANKS(8)} FROM says UNION ALL SELECT 3, 'Action', action{_BLANKS(8)} FROM says
  UNION ALL SELECT 3 + k, 'Warning', severity, code, detail{_BLANKS(6)} FROM warned UNION ALL SELECT 4 + w.n, 'Warning', 'low', 'small_groups', detail{_BLANKS(6)} FROM small, w),
mid AS (SELECT count(*) AS n FROM top),
body AS (SELECT mid.n AS "at", 'Filter' AS c0, 'latest scan of each source' AS c1{"".join(f", '' AS c{i}" for i in range(2, 10))} FROM mid UNION ALL SELECT mid.n + 1, {", ".join(text(x) for x in _LABELS)} FROM mid
  UNION ALL SELECT mid.n + 1 + row_number() OVER (ORDER BY rows DESC, first_seq), {", ".join(f"coalesce({x}::VARCHAR, '')" for x in _NAMES)} FROM (SELECT {_FLAT}, first_seq FROM ladder), mid)
SELECT "at"::BIGINT AS "at", {", ".join(f"c{i}" for i in range(10))} FROM top UNION ALL SELECT "at"::BIGINT, {", ".join(f"c{i}" for i in range(10))} FROM body"""
_CELL = lambda x: f"CASE WHEN regexp_matches({x}, '[\",;\\n\\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
SQL["report_csv"] = f"""WITH {LISTINGS.strip()}, {ladder("latest", "platform")}, {TRUST}, says AS (SELECT worst, {_TRUST_SAYS} FROM trust)
SELECT worst AS line FROM says UNION ALL SELECT sentence FROM says UNION ALL SELECT {text(",".join(_LABELS))} UNION ALL SELECT concat_ws(',', {", ".join(_CELL(f"coalesce({x}::VARCHAR, '')") for x in _NAMES)}) FROM (SELECT {_FLAT} FROM ladder)"""
SQL["rows_csv"] = over(f"SELECT {text(','.join(LISTING_COLUMNS))} AS line UNION ALL SELECT concat_ws(',', {', '.join(_CELL(f'coalesce({c}::VARCHAR, {text("")})') for c in LISTING_COLUMNS)}) FROM latest WHERE platform = 'ASIA'")
SQL["change_caveats"] = over(
    """SELECT source_url, 'one_scan' AS code, 'needs at least two scans' AS detail FROM per WHERE scans = 1
UNION ALL SELECT source_url, 'half_day', 'less than half a day apart: likely an hourly offer, not a change of price' FROM per WHERE days < 0.5
UNION ALL SELECT source_url, 'identical', 'both scans are the same' FROM per WHERE scans > 1 AND source_url NOT IN (SELECT source_url FROM changes)
UNION ALL SELECT source_url, 'gone', count(*) || ' rows gone may also mean a page limit or new ids' FROM changes WHERE change = 'GONE' GROUP BY source_url""",
    RANKED, DIFF, "per AS (SELECT source_url, count(*) AS scans, max(seen) FILTER (place = 1)::DATE - max(seen) FILTER (place = 2)::DATE AS days FROM ranked WHERE place <= 2 GROUP BY source_url)")
SQL["start_page"] = over("SELECT 'totals' AS part, 'rows' AS name, count(*) AS n FROM joined UNION ALL SELECT 'totals', 'scans', count(DISTINCT scan_id) FROM joined UNION ALL SELECT 'scans of', source_url, count(DISTINCT scan_id) FROM joined GROUP BY source_url UNION ALL SELECT 'rows of', scan_id, count(*) FROM joined GROUP BY scan_id UNION ALL SELECT * FROM (VALUES ('report', 'PRICE_LADDER', 0), ('report', 'PRICE_DISTRIBUTION', 1), ('report', 'COMPETITORS', 2), ('report', 'CHANGES', 3), ('report', 'SCAN_QUALITY', 4))")
_MATCH = "match AS (SELECT * FROM latest WHERE price IS NOT NULL)"
SQL["data_query"] = f"""{_BASE}, {_MATCH}{_selecting("data_warnings", "match")[len(_BASE) :].split(chr(10) + "SELECT 1::INT AS ord", 1)[0]}, {TRUST.replace("FROM latest", "FROM match")}, {_SAYS},
pg AS (SELECT price FROM match ORDER BY price DESC, {SEQ} LIMIT 50 OFFSET 100)
SELECT s.*, says.worst, trust.scans, sentence, (SELECT count(*) FROM pg) AS page_rows, (SELECT max(price) FROM pg) AS page_max, (SELECT min(price) FROM pg) AS page_min, (SELECT coalesce(string_agg(code, ',' ORDER BY code), '') FROM warned) AS warnings,
  (SELECT count(*) FROM match) AS total_rows, 'priced; latest scan of each source' AS says FROM (SELECT {STATS} FROM match) s, says, trust"""

SQL |= expected.SQL
