"""What queries over inline documents must return, as SQL VALUES.

The tables of the first twelve (addresses, entities, robots lines, extractors, rungs) were read off a run and then checked against the rules line by
line, so they guard against change more than against a misread rule. The others were written from the rules before their queries ran.
"""

from __future__ import annotations

from shelfmark.plans import vectors as V
from shelfmark.schema import LEDGER_SCHEMA, LISTING_SCHEMA, PRODUCT_FIELDS

#: SQL types by the names used below.
TYPES = {"s": "VARCHAR", "i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}
PRODUCT_TYPES = {"price": "d", "list_price": "d", "rating": "d", "stock_qty": "d", "review_count": "d", "sold_count": "d"}
PRODUCT = " ".join(f"{f}:{PRODUCT_TYPES.get(f, 's')}" for f in PRODUCT_FIELDS) + " missing:s warned:s"


def literal(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def sql(columns: str, rows: list[tuple]) -> str:
    """``columns``: name:type, blank between; a table without rows has its columns all the same."""
    named = [c.split(":") for c in columns.split()]
    picked = ", ".join(f'"{n}"::{TYPES[t]} AS "{n}"' for n, t in named)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) or "(" + ", ".join("NULL" for _ in named) + ")"
    return f"SELECT {picked} FROM (VALUES {body}) AS t(" + ", ".join(f'"{n}"' for n, _ in named) + ")" + ("" if rows else " WHERE false")


def product(*keys, why: dict[str, str] | None = None, warned: str = "", **fields) -> tuple:
    """A product row: fields not named are blank, and blank ones are "not in source" unless ``why`` says else."""
    missing = "; ".join(f"{f}: {(why or {}).get(f, 'not in source')}" for f in sorted(PRODUCT_FIELDS) if fields.get(f) is None)
    return (*keys, *[fields.get(f) for f in PRODUCT_FIELDS], missing, warned)


_MAT = {"title": "Mat", "brand": "V", "category": "Mats", "currency": "VND", "image_url": "i.png", "short_desc": "Soft"}
_FEED_WHY = {"stock_qty": "feed tells no stock", "list_price": "no list price"}
_BARE = "product without variants"
_LD = {"external_id": "p1", "product_url": "https://x.example/products/mat", "title": "Mat", "brand": "V", "sku": "M1", "currency": "VND", "rating": 4.8, "review_count": 137.0, "image_url": "a.png"}
_FEED_ROWS = [
    product("f", 0, 0, external_id="1:11", product_url="https://a.example/products/mat?variant=11", sku="M-R", variant="Red", price=259000.0, list_price=329000.0, stock_state="IN", why=_FEED_WHY, **_MAT),
    product("f", 0, 1, external_id="1:12", product_url="https://a.example/products/mat?variant=12", sku="M-B", variant="Blue", price=500.0, stock_state="OUT", why=_FEED_WHY, warned="implausible VND price (500.0)", **_MAT),
    product("f", 1, 0, external_id="2:21", product_url="https://a.example/products/rug", title="Rug", currency="VND", why=_FEED_WHY | {"price": "unreadable price"}),
    product("f", 2, -1, external_id="/products/bare", product_url="https://a.example/products/bare", title="Bare", currency="VND", why=_FEED_WHY | {"price": _BARE, "list_price": _BARE}),
]

_B = "https://shop.example"
_RESOLVED = ["/products/y", "/a/d", "/a/b/e", "/a/b/f", None, None, "", "/a/b/c.html#top", "/a/b/c.html?p=2", "", "/g", ""]
_RESOLVED_ROOT = ["/products/y", "/d", "/e", "/f", None, None, "", "#top", "?p=2", "", "/g", ""]
_FIXED = {4: "https://cdn.example/x", 5: "https://o.example/z"}

EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "url_resolve": ("i:i address:s", [(12 * k + i, _FIXED[i] if x is None else _B + x if x else "") for k, part in enumerate((_RESOLVED, _RESOLVED_ROOT)) for i, x in enumerate(part)] + [(24 + i, _FIXED[5] if i == 5 else "") for i in range(12)]),
    "url_multi_split": ("url:s status:s row_seq:i at:i", [("https://a.example/x", "PENDING", 0, 0), ("https://b.example/", "PENDING", 0, 3), ("bad", "ERROR", 0, 2)]),
    "html_entities": ("i:i decoded:s title:s links:i", [
        (0, "<p>a & b <c> AB  dé</p>", "", 0), (1, "<script>var x='<p>';</script><p>shown</p><!-- hidden --><style>p{}</style>", "", 0), (2, "<h1> First <b>one</b></h1><title>t</title>", "First one", 0),
        (3, '<title>Only "t"</title>', 'Only "t"', 0), (4, "", "", 0), (5, '<div id="root"></div>', "", 0), (6, "&lt; &#65; 😀 &#0; ...", "", 0), (7, "<noscript>no</noscript><a href='/x'>link - one</a><a href=\"\">none</a><A HREF=/y>two</A>", "", 2)]),
    "html_meta_canonical": ("i:i amount:s canonical:s currency:s blocks:i", [(0, "189.000", "/products/og", "VND", 0), (1, None, "", "VND", 0), (2, None, "", "VND", 2)]),
    "price_mentions_asof": ("scan_id:s url:s pos:l amount:s anchor_pos:l href:s text:s", [
        ("s4", "https://x.example/", 38, "1.250.000 ₫", 0, "/products/a", "Mat A"), ("s4", "https://x.example/", 89, "250.000  đ", 55, "/products/b", "Mat B"), ("s4", "https://x.example/", 180, "99.000 ₫", 141, "https://o.example/z", "Away")]),
    "robots_rules": ("origin:s agent:s kind:s value:s line:i", [
        ("https://a.example", "*", "disallow", "/private", 1), ("https://a.example", "*", "allow", "/private/open", 2), ("https://a.example", "*", "crawl-delay", "2", 3), ("https://a.example", None, "sitemap", "https://a.example/s.xml", 4),
        *[("https://b.example", agent, kind, value, line) for agent in ("shelf", "other") for kind, value, line in (("disallow", "/*.pdf$", 2), ("disallow", "/x*y", 3), ("allow", "", 4))],
        ("https://b.example", "*", "disallow", "/", 7), ("https://c.example", "nobody", "disallow", "/", 3)]),
    "products_json_explode": (f"scan_id:s p_at:i v_at:i {PRODUCT}", _FEED_ROWS),
    "woo_json_explode": (f"scan_id:s p_at:i {PRODUCT}", [
        product("w", 0, external_id="5", product_url="https://w.example/product/mat", title="Mat & rug", category="A | B", sku="W5", price=350000.0, list_price=420000.0, currency="VND", stock_state="IN", stock_qty=3.0, rating=4.5, review_count=2.0, image_url="w.png", short_desc="x"),
        product("w", 1, external_id="6", product_url="https://w.example/product/r", title="Range", currency="USD", review_count=0.0, why={"price": "price range", "list_price": "price range", "rating": "no reviews yet"}),
        product("w", 2, external_id="7", product_url="https://w.example/product/s", title="Same", price=10.0, currency="USD", stock_state="OUT", why={"list_price": "equals price", "rating": "no reviews yet"})]),
    "jsonld_nodes": (f"scan_id:s url:s block_at:i node_at:i {PRODUCT}", [
        product("s1", "https://x.example/products/mat", 0, 0, price=459000.0, stock_state="IN", why={"list_price": "no list price"}, **_LD),
        product("s1", "https://x.example/products/mat", 0, 1, why={"list_price": "no list price", "price": "price range (1-2)"}, **_LD)]),
    "microdata_open_graph": (f"scan_id:s url:s {PRODUCT}", [
        product("s2", "https://x.example/products/og", external_id="/products/og", product_url="https://x.example/products/og", title="Og mat", price=189.0, currency="VND", image_url="o.png", warned="implausible VND price (189.0)"),
        product("s3", "https://x.example/products/micro", external_id="MM-1", product_url="https://x.example/products/micro", title="Micro mat", sku="MM-1", price=329000.0, currency="VND", stock_state="OUT")]),
    "html_guess_rows": (f"scan_id:s url:s {PRODUCT}", [
        product("s4", "https://x.example/", external_id=f"/products/{k}", product_url=f"https://x.example/products/{k}", title=f"Mat {k.upper()}", price=p, currency="VND", warned="guessed from HTML; verify by hand") for k, p in (("a", 1250000.0), ("b", 250000.0))]),
    "rung_selection": ("scan_id:s rung:i rows:l priced:l", [("s1", 4, 2, 1), ("s2", 4, 1, 1), ("s3", 4, 1, 1), ("s4", 5, 2, 2), ("s9", 1, 4, 2)]),
    # --- documents and policies ---
    "json_bodies": ("i:i parsed:b a:s", [(0, True, "1"), (1, True, "x"), (2, False, None), (3, False, None), (4, True, None), (5, False, None)]),
    "redirect_chains": ("url:s final_url:s hops:i", [("a", "c", 2), ("b", "c", 1), *[(f"r{k}", "end" if 7 - k <= 5 else None, min(7 - k, 6)) for k in range(7)], ("self", None, 6)]),
    "agent_tokens": ("i:i token:s", [(0, "shelfmarkbot"), (1, "other"), (2, "a"), (3, "")]),
    "robots_policy": ("origin:s path:s policy:s allowed:b rule:s", [
        ("https://a.example", "/private", "read", False, "/private"), ("https://a.example", "/open", "read", True, None), ("https://gone.example", "/private", "allow_all", True, None),
        ("https://down.example", "/open", "disallow_all", False, None), ("https://mute.example", "/open", "disallow_all", False, None), ("https://never.example", "/open", "disallow_all", False, None)]),
    "robots_group_choice": ("origin:s path:s allowed:b rule:s", [
        ("https://long.example", "/x", False, "/x"), ("https://long.example", "/y", True, None), ("https://short.example", "/x", True, None), ("https://short.example", "/y", False, "/y"),
        ("https://star.example", "/x", False, "/"), ("https://star.example", "/y", False, "/")]),
    "fetch_attempts": ("scan_id:s url:s status:i outcome:s try:i", [
        ("s", "u1", 200, "ok", 2), ("s", "u2", 503, "retry", 3), ("s", "u3", 404, "refused", 1), ("s", "u4", 403, "blocked", 1), ("s", "u5", 200, "blocked", 1), ("s", "u6", 500, "failed", 1), ("s", "u7", 0, "retry", 1), ("t", "u1", 408, "failed", 1)]),
    "failure_log": ("scan_id:s place:i url:s outcome:s", [("s", 1, "u7", "retry"), ("s", 2, "u6", "failed"), ("s", 3, "u5", "blocked"), ("t", 1, "u1", "failed")]),
    "ingest_resumes": ("run:l batch:l read:l written:l cursor:l", [(0, 0, 2, 4, 1), (0, 1, 2, 4, 1), (1, 2, 2, 6, 2), (2, 0, 6, 6, 0)]),
    "page_states": ("i:i challenge:s platform:s shell:b", [
        (0, "just a moment...", "", False), (1, "HTTP 403", "Shopify", False), (2, None, "WordPress/WooCommerce", False), (3, None, "", True), (4, None, "", False), (5, None, "Haravan", False), (6, None, "", True), (7, "captcha-delivery", "", False)]),
    "sort_names": ("title:s row_seq:i down:b place:l", [(V.NAMES[i], i, down, k) for down, order in ((False, (5, 2, 1, 6, 0, 4, 3)), (True, (4, 0, 1, 6, 2, 5, 3))) for k, i in enumerate(order)]),
    "scalar_text": ("i:i value:s", [(0, "a b"), (1, None), (2, None), (3, "0"), (4, None)]),
    "day_gaps": ("i:i days:d", [(0, 1.0), (1, 0.5), (2, None), (3, None), (4, 31.0), (5, 0.25)]),
    "filter_descriptions": ("i:i says:s", [
        (0, "latest scan of each source"), (1, "store in a, b; priced; all scans"), (2, "platform in P; brand in B; category in C; verdict in LOW; source in u; stock IN; price >= 5; price <= 7.5; contains 'x y'; latest scan of each source")]),
    "sitemap_priority": ("scan_id:s kind:s place:i url:s", [
        *[("s1", "sitemap", i, f"https://a.example/{x}") for i, x in enumerate(("product-1.xml", "san-pham-2.xml", "pages.xml", "posts.xml"))],
        ("s1", "product", 0, "https://a.example/products/a"), ("s1", "product", 1, "https://a.example/products/b"), ("s2", "product", 0, "https://b.example/one"), ("s2", "product", 1, "https://b.example/two")]),
    "stamped_rows": ("scan_id:s source_url:s store:s platform:s external_id:s price:d currency:s row_seq:l", [
        ("scan-1", "https://a.example/", "a.example", "Shopify", ident, price, "VND", i) for i, (ident, price) in enumerate((("1:11", 259000.0), ("1:12", 500.0), ("2:21", None), ("/products/bare", None)))]),
    "catalog_tables": ("name:s columns:l rows:l", [("listings", len(LISTING_SCHEMA.fields), 1), ("scans", len(LEDGER_SCHEMA.fields), 0)]),
    "derived_table": ("at:l c0:s c1:s c2:s", [(0, "a", "", ""), (1, "b", "c", "d"), (2, "", "", ""), (3, "e", "f", "")]),
    "report_unknown": ("ord:i severity:s code:s detail:s", [(0, "high", "unknown_report", "NONE")]),
    "ladder_gating": ("scan_id:s entered:s kind:s rung:i rows:l note:s", [
        ("g1", "https://x.example/products/mat", "PRODUCT", 4, 2, None), ("g2", "https://shopee.vn/brand", "MARKETPLACE_SHOP", 6, 0, "unscannable host: Shopee"), ("g3", "https://shopee.vn/brand", "MARKETPLACE_SHOP", 6, 0, "unscannable host: Shopee"),
        ("g4", "https://x.example/collections/mats", "CATEGORY", 1, 4, "rows of the whole store"), ("g5", "not an address", "UNKNOWN", 6, 0, "not an http(s) address"), ("g6", "https://x.example/shell", "UNKNOWN", 6, 0, "nothing could be read")]),
    "queue_worker": ("url:s status:s note:s rows:l", [
        ("https://x.example/", "DONE", "2 rows of rung 5", 2), ("https://x.example/products/mat", "DONE", "2 rows of rung 4", 2), ("https://x.example/products/none", "ERROR", "nothing could be read", 0), ("https://x.example/products/og", "DONE", "1 rows of rung 4", 1)]),
}

SQL: dict[str, str] = {name: sql(*table) for name, table in EXPECTED.items()}
