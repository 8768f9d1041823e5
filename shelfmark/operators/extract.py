"""Extractors: one captured document gives no, one or many listing rows; the best rung that yields rows wins.

Rungs 1 and 2 read platform feeds, 3 and 4 structured data in pages, 5 guesses from HTML. Every output has
PRODUCT_FIELDS, ``missing_reason`` (map of field to reason) and ``row_warnings`` (list).
"""

from __future__ import annotations

import itertools
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import html as H
from shelfmark.functions import money as M
from shelfmark.functions import urls as U
from shelfmark.runtime import materialized, shipped
from shelfmark.schema import PRODUCT_FIELDS

KINDS = {"price": "double", "list_price": "double", "rating": "double", "stock_qty": "long", "review_count": "long", "sold_count": "long"}


def filled(c: Column) -> Column:
    return F.nullif(M.trimmed(c.cast("string")), F.lit(""))


def as_rows(df: DataFrame, values: dict[str, Column], reasons: dict[str, str | Column], warnings: list[Column], keep: list[str]) -> DataFrame:
    """Project onto the product fields and tell why a field is blank."""
    nothing = F.lit("not in source")
    made = {f: values.get(f, F.lit(None)).cast(KINDS.get(f, "string")) for f in PRODUCT_FIELDS}
    out = df.select(*keep, *[c.alias(f) for f, c in made.items()], *[(reasons[f] if isinstance(reasons.get(f), Column) else F.lit(reasons[f]) if f in reasons else nothing).alias(f"why_{f}") for f in PRODUCT_FIELDS], F.array_compact(F.array(*warnings) if warnings else F.array().cast("array<string>")).alias("row_warnings"))
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.when(F.col(f).isNull(), F.col(f"why_{f}")).alias("v")) for f in PRODUCT_FIELDS]), lambda p: p["v"].isNotNull())
    return out.withColumn("missing_reason", F.map_from_entries(pairs)).drop(*[f"why_{f}" for f in PRODUCT_FIELDS])


_FEED = "struct<id:string,title:string,handle:string,vendor:string,product_type:string,body_html:string,description:string,images:array<struct<src:string>>,image:struct<src:string>,variants:array<struct<id:string,title:string,sku:string,price:string,compare_at_price:string,available:boolean,inventory_quantity:string,featured_image:struct<src:string>>>>"


def products_json(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rung 1: products times variants of a platform's product feed (columns body, origin, url, currency)."""
    body = F.regexp_replace("body", "^\\ufeff", "")
    listed = F.coalesce(F.from_json(body, f"struct<products:array<{_FEED}>>")["products"], F.transform(F.array(F.from_json(body, f"struct<product:{_FEED}>")["product"]), lambda x: x), F.from_json(body, f"array<{_FEED}>"))
    p = docs.select(*keep, "origin", "url", "currency", F.posexplode(F.filter(listed, lambda x: x.isNotNull())).alias("p_at", "p"))
    v = p.select(*keep, "origin", "url", "currency", "p_at", "p", F.posexplode_outer("p.variants").alias("v_at", "v"))
    base = F.when(F.col("p.handle").isNotNull(), F.concat("origin", F.lit("/products/"), "p.handle")).otherwise(F.coalesce("url", F.lit("")))
    many = F.size("p.variants") > 1
    price = M.machine_number(F.col("v.price"))
    reason = F.when(F.col("v").isNull(), "product without variants")
    values = {
        "external_id": filled(F.when(F.col("p.id").isNotNull() & F.col("v.id").isNotNull(), F.concat("p.id", F.lit(":"), "v.id")).when(F.col("p.id").isNotNull(), F.col("p.id")).when(F.col("p.handle").isNotNull(), U.path_id(base))),
        "product_url": filled(F.when(many & F.col("v.id").isNotNull(), F.concat(base, F.lit("?variant="), "v.id")).otherwise(base)),
        "title": filled(F.col("p.title")), "brand": filled(F.col("p.vendor")), "category": filled(F.col("p.product_type")), "sku": filled(F.col("v.sku")),
        "variant": F.nullif(filled(F.col("v.title")), F.lit("Default Title")), "price": price, "list_price": M.machine_number(F.col("v.compare_at_price")),
        "currency": filled(F.col("currency")), "stock_state": F.when(F.col("v.available"), "IN").when(~F.col("v.available"), "OUT"),
        "stock_qty": M.whole_number(F.col("v.inventory_quantity")),
        "image_url": filled(F.coalesce(F.get("p.images", F.lit(0))["src"], F.col("p.image.src"), F.col("v.featured_image.src"))),
        "short_desc": filled(H.short_description(F.coalesce("p.body_html", "p.description", F.lit("")))),
    }
    reasons = {"price": F.coalesce(reason, F.lit("unreadable price")), "list_price": F.coalesce(reason, F.lit("no list price")), "currency": "feed names no currency", "stock_qty": "feed tells no stock"}
    return as_rows(v, values, reasons, [M.implausible(price, F.col("currency"))], [*keep, "p_at", "v_at"])


_WOO = "struct<id:string,name:string,permalink:string,sku:string,prices:struct<price:string,regular_price:string,currency_code:string,currency_minor_unit:string,price_range:struct<min_amount:string,max_amount:string>>,is_in_stock:boolean,stock_quantity:string,average_rating:string,review_count:string,categories:array<struct<name:string>>,images:array<struct<src:string>>,short_description:string,description:string,variations:array<struct<id:string>>>"


def woo_json(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rung 2: a store API with prices in minor units; a range of prices stays blank."""
    body = F.regexp_replace("body", "^\\ufeff", "")
    one = F.from_json(body, _WOO)
    listed = F.coalesce(F.from_json(body, f"array<{_WOO}>"), F.from_json(body, f"struct<products:array<{_WOO}>>")["products"], F.when(one["id"].isNotNull(), F.array(one)))
    p = docs.select(*keep, F.posexplode(F.filter(listed, lambda x: x.isNotNull())).alias("p_at", "p"))
    money = F.col("p.prices")
    unit = F.pow(F.lit(10.0), F.coalesce(M.whole_number(money["currency_minor_unit"]), F.lit(2)))
    ranged = F.coalesce(money["price_range"]["min_amount"] != money["price_range"]["max_amount"], F.lit(False))
    price = F.when(~ranged, M.whole_number(money["price"]) / unit)
    full = F.when(~ranged, M.whole_number(money["regular_price"]) / unit)
    reviews = M.whole_number(F.col("p.review_count"))
    names = F.filter(F.transform("p.categories", lambda c: M.trimmed(c["name"])), lambda n: n != "")
    values = {
        "external_id": filled(F.coalesce("p.id", U.path_id(F.col("p.permalink")))), "product_url": filled(F.col("p.permalink")), "title": filled(H.decoded(F.col("p.name"))),
        "category": filled(F.array_join(names, " | ")), "sku": filled(F.col("p.sku")), "price": price, "list_price": F.nullif(full, price), "currency": filled(money["currency_code"]),
        "stock_state": F.when(F.col("p.is_in_stock"), "IN").when(~F.col("p.is_in_stock"), "OUT"), "stock_qty": M.whole_number(F.col("p.stock_quantity")),
        "review_count": reviews, "rating": F.when(reviews > 0, M.star_rating(F.col("p.average_rating"))), "image_url": filled(F.get("p.images", F.lit(0))["src"]),
        "short_desc": filled(H.short_description(F.coalesce(F.nullif("p.short_description", F.lit("")), "p.description", F.lit("")))),
    }
    reasons = {"price": F.when(ranged, "price range").otherwise("unreadable price"), "list_price": F.when(ranged, "price range").when(full == price, "equals price").otherwise("no list price"), "rating": F.when(F.coalesce(reviews, F.lit(0)) == 0, "no reviews yet").otherwise("unreadable rating")}
    return as_rows(p, values, reasons, [M.implausible(price, money["currency_code"])], [*keep, "p_at"])


def product_nodes(tree, most: int | None = 5000) -> list[dict]:
    """Objects of type Product among the first ``most`` nodes of a JSON tree (all: None), breadth first."""
    found, queue, at = [], [tree], 0
    while at < len(queue) and (most is None or at < most):
        node = queue[at]
        at += 1
        if isinstance(node, list):
            queue.extend(node)
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if any(isinstance(k, str) and k.lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
                found.append(node)
            queue.extend(v for v in node.values() if isinstance(v, dict | list))
    return found


def _text(value) -> str:
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, bool):
        return str(value).lower()
    return json.dumps(value) if isinstance(value, int | float) else ""


def _named(value, *keys: str) -> str:
    if isinstance(value, list):
        return _named(value[0], *keys) if value else ""
    if isinstance(value, dict):
        return next((t for k in keys if (t := _text(value.get(k)))), "")
    return value.strip() if isinstance(value, str) else ""


_NODE = ["id", "name", "brand", "category", "sku", "node_url", "image", "description", "offer", "offer_type", "offer_url", "offer_sku", "offer_name", "offer_price", "offer_currency", "low", "high", "availability", "rating", "reviews", "rated"]


def _node_offers(node: dict) -> list[tuple]:
    offers = node.get("offers")
    rated = node.get("aggregateRating")
    rated = rated[0] if isinstance(rated, list) and rated else rated
    rated = rated if isinstance(rated, dict) else None
    out = []
    for o in offers if isinstance(offers, list) else [offers]:
        o = o if isinstance(o, dict) else None
        price = "" if o is None else _text(o["price"]) if "price" in o else _named(o.get("priceSpecification"), "price")
        get = lambda k, o=o: _text(o.get(k)) if o else ""
        ident = next((t for k in ("@id", "productID", "sku") if (t := _text(node.get(k)))), "") or get("sku") or _text(node.get("mpn"))
        out.append((ident, _text(node.get("name")), _named(node.get("brand"), "name"), _named(node.get("category"), "name"), _text(node.get("sku")), _text(node.get("url")), _named(node.get("image"), "url", "contentUrl"), _text(node.get("description")),
                    o is not None, get("@type").lower(), get("url"), get("sku"), get("name"), price, get("priceCurrency"), get("lowPrice"), get("highPrice"), get("availability"),
                    _text(rated.get("ratingValue")) if rated else "", _text(rated["reviewCount"] if "reviewCount" in rated else rated.get("ratingCount")) if rated else "", rated is not None))
    return out


def json_ld_nodes(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each offer of each Product node: a walk over a JSON tree of unknown depth, so it runs over Arrow batches."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema if f.name in keep}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "block_at int", "node_at int", *[f"{c} {'boolean' if c in ('offer', 'rated') else 'string'}" for c in _NODE]])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                for i, block in enumerate(row[-1] if row[-1] is not None else ()):
                    try:
                        tree = json.loads(block)
                    except ValueError:
                        continue
                    for j, offer in enumerate(x for node in product_nodes(tree) for x in _node_offers(node)):
                        rows.append((*row[:-1], i, j, *offer))
            yield pd.DataFrame(rows, columns=[*keep, "block_at", "node_at", *_NODE])

    shipped(pages.sparkSession)
    return pages.select(*keep, H.json_blocks(F.col("body")).alias("blocks")).mapInPandas(run, schema)


def json_ld(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Rungs 3 and 4: structured products (columns body, url; keep must hold url)."""
    n = json_ld_nodes(pages, keep)
    address = F.coalesce(filled(F.col("node_url")), filled(F.col("offer_url")), F.col("url"))
    address = F.when(address.startswith("http"), address).otherwise(U.resolved(F.col("url"), address))
    ranged = F.col("offer_type") == "aggregateoffer"
    n = n.withColumn("address", address).withColumn("read", M.flexible_price(F.nullif("offer_price", F.lit("")), filled(F.col("offer_currency"))))
    address, read = F.col("address"), F.col("read")
    values = {
        "external_id": F.coalesce(filled(F.col("id")), U.path_id(address)), "product_url": filled(address), "title": filled(H.decoded(F.col("name"))), "brand": filled(F.col("brand")),
        "category": filled(F.col("category")), "sku": F.coalesce(filled(F.col("sku")), filled(F.col("offer_sku"))), "variant": filled(F.col("offer_name")),
        "price": F.when(F.col("offer") & ~ranged, read["price"]), "currency": F.coalesce(filled(F.col("offer_currency")), F.when(F.col("offer") & ~ranged, read["currency"])),
        "stock_state": F.when(F.col("offer") & ~ranged, H.stock_state(F.col("availability"))), "rating": M.star_rating(F.nullif("rating", F.lit(""))), "review_count": M.whole_number(F.nullif("reviews", F.lit(""))),
        "image_url": filled(F.col("image")), "short_desc": filled(H.short_description(F.col("description"))),
    }
    reasons = {"price": F.when(~F.col("offer"), "no offer").when(ranged, F.concat(F.lit("price range ("), "low", F.lit("-"), "high", F.lit(")"))).otherwise("unreadable price"), "currency": "no currency named", "list_price": "no list price", "rating": F.when(F.col("rated"), "unreadable rating").otherwise("no rating")}
    return as_rows(n, values, reasons, [F.when(F.col("offer") & ~ranged, read["warning"])], [*keep, "block_at", "node_at"])


def microdata(html: Column, most: int | None = 2000) -> Column:
    """array<struct<key, value>> of the first ``most`` itemprops (all: None) in order: content, href or src, else the text that follows."""
    found = H.first_of(F.regexp_extract_all(html, F.lit(r"""(?s)(<[a-zA-Z][^>]*itemprop\s*=\s*["']?[a-zA-Z]+["']?[^>]*>(?:[^<]{0,299}(?=<))?)"""), F.lit(1)), most)

    def one(x: Column) -> Column:
        tag, after = F.regexp_extract(x, r"(?s)^(<[^>]*>)", 1), F.regexp_extract(x, r"(?s)^<[^>]*>(.*)\z", 1)
        value = F.coalesce(*[F.nullif(H.attribute(tag, a), F.lit("")) for a in ("content", "href", "src")], F.nullif(H.visible_text(after), F.lit("")))
        return F.struct(F.lower(F.regexp_extract(tag, r"""itemprop\s*=\s*["']?([a-zA-Z]+)""", 1)).alias("key"), value.alias("value"))

    return F.filter(F.transform(found, one), lambda p: p["value"].isNotNull())


def micro_or_graph(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Microdata, then Open Graph: one row a page, none without a price signal."""
    p = pages.select(*keep, "body", microdata(F.col("body")).alias("md"), H.meta_pairs(F.col("body")).alias("mt"))
    md = lambda key: F.get(F.filter("md", lambda x: x["key"] == key), F.lit(0))["value"]
    mt = lambda key: F.try_element_at(F.filter("mt", lambda x: x["key"] == key), F.lit(-1))["value"]
    raw = F.coalesce(md("price"), mt("product:price:amount"), mt("og:price:amount"), mt("price"))
    code = filled(F.coalesce(md("pricecurrency"), mt("product:price:currency"), mt("og:price:currency"), mt("currency")))
    p = p.withColumn("raw", raw).withColumn("code", code).where("raw is not null")
    address = F.coalesce(mt("og:url"), F.nullif(H.canonical(F.col("body")), F.lit("")), F.col("url"))
    address = F.when(address.startswith("http"), address).otherwise(U.resolved(F.col("url"), address))
    p = p.withColumn("address", address).withColumn("read", M.flexible_price(F.col("raw"), F.col("code")))
    address, read = F.col("address"), F.col("read")
    values = {
        "external_id": F.coalesce(filled(md("sku")), filled(md("productid")), filled(mt("product:retailer_item_id")), U.path_id(address)), "product_url": filled(address),
        "title": filled(H.decoded(F.coalesce(md("name"), mt("og:title"), H.title(F.col("body"))))), "brand": F.coalesce(filled(md("brand")), filled(mt("product:brand")), filled(mt("og:brand"))),
        "category": F.coalesce(filled(md("category")), filled(mt("product:category"))), "sku": F.coalesce(filled(md("sku")), filled(mt("product:retailer_item_id"))), "price": read["price"],
        "currency": F.coalesce(F.col("code"), read["currency"]), "stock_state": H.stock_state(F.coalesce(md("availability"), mt("product:availability"), mt("og:availability"))),
        "image_url": F.coalesce(filled(mt("og:image")), filled(md("image"))), "short_desc": filled(H.short_description(F.coalesce(mt("og:description"), md("description")))),
    }
    return as_rows(p, values, {"price": "unreadable price", "currency": "no currency named"}, [read["warning"]], keep)


_PRICE = re.compile(r"(?:(₫|đ|VNĐ|VND)\s*([0-9][0-9., ]{2,})|([0-9][0-9., ]{2,})\s*(₫|đ|VNĐ|VND))")
_ANCHOR = re.compile(r"<a\b([^>]*)>(.{0,300}?)</a>", re.I | re.S)
_HREF = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s">]+))""", re.I)


def price_places(pages: DataFrame, keep: list[str], prices: int | None = 600, anchors: int | None = 3000) -> DataFrame:
    """(keep, kind price or anchor, pos, a, b): amounts and links with their places in the page without blocks; built-ins give no places."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema if f.name in keep}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "kind string, pos long, a string, b string"])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                text = row[-1] or ""
                for m in itertools.islice(_PRICE.finditer(text), prices):
                    rows.append((*row[:-1], "price", m.start(), f"{m[2] or m[3]} {m[1] or m[4]}", None))
                for m in itertools.islice(_ANCHOR.finditer(text), anchors):
                    if (h := _HREF.search(m[1])) and (href := h[1] or h[2] or h[3]):
                        rows.append((*row[:-1], "anchor", m.start(), href, m[2]))
            yield pd.DataFrame(rows, columns=[*keep, "kind", "pos", "a", "b"])

    shipped(pages.sparkSession)
    return pages.select(*keep, H.without_blocks(F.col("body")).alias("clean")).mapInPandas(run, schema)


def nearest_anchor(places: DataFrame, keep: list[str], within: int = 1200) -> DataFrame:
    """As-of join: each price with the nearest anchor before it, fewer than ``within`` characters away; none otherwise."""
    before = Window.partitionBy(*keep).orderBy("pos").rangeBetween(-(within - 1), -1)
    anchor = F.last(F.when(F.col("kind") == "anchor", F.struct("pos", "a", "b")), ignorenulls=True).over(before)
    return places.withColumn("anchor", anchor).where("kind = 'price'").select(*keep, "pos", F.col("a").alias("amount"), F.col("anchor.pos").alias("anchor_pos"), H.decoded(F.col("anchor.a")).alias("href"), H.visible_text(F.col("anchor.b")).alias("text"))


def html_guess(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Rung 5: amounts and the link before them, same origin, the first for each address; else the page as one product."""
    near = nearest_anchor(price_places(pages, keep), keep).where("href is not null and text != ''")
    origin = U.normalised(F.col("url"))["origin"]
    own = near.withColumn("address", U.resolved(F.col("url"), F.col("href"))).where(F.col("address").startswith(origin) & (F.col("address") != ""))
    first = own.groupBy(*keep, "address").agg(F.min_by(F.struct("text", "amount", "pos"), "pos").alias("x")).select(*keep, "address", F.col("x.text").alias("name"), F.col("x.amount").alias("amount"))
    rest = pages.join(first.select(*keep).distinct(), keep, "left_anti").withColumn("amount", F.get(M.mentions(H.visible_text(F.col("body"))), F.lit(0))).where("amount is not null")
    whole = rest.select(*keep, F.coalesce(F.nullif(H.canonical(F.col("body")), F.lit("")), F.col("url")).alias("address"), H.title(F.col("body")).alias("name"), "amount")
    both = first.unionByName(whole)
    both = both.withColumn("read", M.human_price(F.col("amount")))
    read = F.col("read")
    values = {"external_id": U.path_id(F.col("address")), "product_url": filled(F.col("address")), "title": filled(F.col("name")), "price": read["price"], "currency": read["currency"]}
    return as_rows(both, values, {"price": F.concat(F.lit("unreadable price: "), read["reason"]), "currency": "no currency named"}, [F.lit("guessed from HTML; verify by hand")], keep)


# What product sitemaps and product pages are called, and how many of each a scan reads.
PRODUCT_SITEMAP, SITEMAP_CHILDREN, SITEMAP_PRODUCTS = r"(?i)product|san-pham|sanpham", 10, 200


def sitemap_plan(sitemaps: DataFrame, children: int | None = SITEMAP_CHILDREN, products: int | None = SITEMAP_PRODUCTS) -> DataFrame:
    """(scan_id, kind, place, url) of what captured sitemaps (scan_id, seq, url, body) lead to: the child sitemaps of an index, product ones first, and product pages.

    Of a list without product addresses all count if its own name speaks of products. Each address counts once, at its first place; ``None`` lifts a limit.
    """
    body = F.col("body")
    found = sitemaps.select("scan_id", "seq", "url", H.is_sitemap_index(body).alias("index"), F.posexplode(H.sitemap_locations(body)).alias("at", "loc"))
    fits = U.any_of(F.coalesce(U.split_url(F.col("loc"))["path"], F.lit("")), U.PRODUCT_PATHS)
    listed = found.withColumn("product", fits).withColumn("any", F.max("product").over(Window.partitionBy("scan_id", "seq")))
    first = F.when(F.col("index"), F.when(F.col("loc").rlike(PRODUCT_SITEMAP), 0).otherwise(1)).otherwise(0)
    kept = listed.where(F.col("index") | F.col("product") | (~F.col("any") & F.col("url").rlike(PRODUCT_SITEMAP)))
    kind = F.when(F.col("index"), "sitemap").otherwise("product")
    once = kept.groupBy("scan_id", kind.alias("kind"), F.col("loc").alias("url")).agg(F.min(F.struct(first.alias("first"), "seq", "at")).alias("p"))
    out = once.withColumn("place", F.row_number().over(Window.partitionBy("scan_id", "kind").orderBy("p")) - 1)
    limit = F.when(F.col("kind") == "sitemap", F.lit(children)).otherwise(F.lit(products))
    return out.where(limit.isNull() | (F.col("place") < limit)).select("scan_id", "kind", "place", "url")


def gated(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(scan_id, entered, kind, rung, rows, note) of every request (scan_id, url, redirect): which rung gave rows, by the rules that stand before the rungs.

    A redirect's target replaces the address and is judged like it. What is no address, and hosts that cannot be scanned, give rung 6 without work. For a
    product address its product pages are not read (rung 3). A category whose rows come from the platform's feed gets the rows of the whole store.
    """
    asked = requests.withColumn("entered", F.coalesce("redirect", "url"))
    n = U.normalised(F.col("entered"))
    asked = asked.select("scan_id", "entered", U.url_kind(F.col("entered")).alias("kind"), F.when(n.isNull(), "not an http(s) address").otherwise(F.concat(F.lit("unscannable host: "), U.unscannable(n["host"]))).alias("stop"))
    own = pages.join(asked.where("stop is null").select("scan_id", F.col("kind").alias("asked")), "scan_id")
    rows = ladder(own.where(~((F.col("kind") == "product") & F.col("asked").isin("PRODUCT", "MARKETPLACE_PRODUCT"))).drop("asked"))
    got = rows.groupBy("scan_id").agg(F.min("rung").alias("rung"), F.count("*").alias("rows"))
    whole = (F.col("kind") == "CATEGORY") & (F.col("rung") <= 2)
    note = F.coalesce("stop", F.when(F.col("rung").isNull(), "nothing could be read").when(whole, "rows of the whole store"))
    return asked.join(got, "scan_id", "left").select("scan_id", "entered", "kind", F.coalesce("rung", F.lit(6)).alias("rung"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), note.alias("note"))


def best_rung(rows: DataFrame) -> DataFrame:
    """Of all rungs' rows (scan_id, rung) those of the least rung that yielded any, scan by scan."""
    rows = materialized(rows, "rungs")  # both sides of the join read it
    least = rows.groupBy("scan_id").agg(F.min("rung").alias("rung"))
    return rows.join(least, ["scan_id", "rung"], "left_semi")


def ladder(pages: DataFrame, page_cap: int | None = 20) -> DataFrame:
    """Listing rows of all scans from captured pages (PAGE_SCHEMA plus kind: feed, store_api, product or entered; currency).

    Scans of unscannable hosts give nothing; blocked pages and shells are passed over; rung 3 takes at most ``page_cap`` product pages a scan (all: None).
    """
    keep = ["scan_id", "url"]
    shipped(pages.sparkSession)
    n = U.normalised(F.col("url"))
    good = pages.withColumn("origin", n["origin"]).where(U.unscannable(n["host"]).isNull() & n.isNotNull()).where(H.challenge(F.col("body"), F.col("status")).isNull() & (F.coalesce("status", F.lit(0)) < 400))
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("fetched_at", "url"))
    products = good.where("kind = 'product'").withColumn("place", place).where(F.lit(page_cap).isNull() | (F.col("place") <= page_cap))
    entered = good.where("kind = 'entered'")

    def structured(part: DataFrame, rung: int) -> DataFrame:
        ld = json_ld(part, keep).drop("block_at", "node_at")
        rest = part.join(ld.select(*keep).distinct(), keep, "left_anti")
        return ld.unionByName(micro_or_graph(rest, keep)).withColumn("rung", F.lit(rung))

    parts = [
        products_json(good.where("kind = 'feed'"), keep).drop("p_at", "v_at").withColumn("rung", F.lit(1)),
        woo_json(good.where("kind = 'store_api'"), keep).drop("p_at").withColumn("rung", F.lit(2)),
        structured(products, 3), structured(entered, 4),
        html_guess(entered.where(~H.is_shell(F.col("body"))), keep).withColumn("rung", F.lit(5)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return best_rung(out)
