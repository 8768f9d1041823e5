"""URL splitting, normalising, resolving and classifying as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.money import let, trimmed

# Query parameters that only track.
TRACKING = ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ttclid", "spm", "xptdk", "zanpid", "yclid", "_ga", "_gl"]
# Hosts that cannot be scanned from a server (name, pattern).
UNSCANNABLE = [
    ("Shopee", r"(?i)(^|\.)shopee\.(vn|com|sg|co\.id|co\.th|ph|com\.my|com\.br)\z"),
    ("Lazada", r"(?i)(^|\.)lazada\.(vn|com|co\.id|co\.th|com\.my|com\.ph|sg)\z"),
    ("TikTok Shop", r"(?i)(^|\.)(tiktok|tiktokshop)\.(com|vn)\z"),
    ("Tiki", r"(?i)(^|\.)tiki\.vn\z"),
    ("International marketplace", r"(?i)(^|\.)(amazon\.[a-z.]+|aliexpress\.com|taobao\.com|1688\.com)\z"),
]
# Paths of products and of categories.
PRODUCT_PATHS = [r"/products/[^/]+", r"/product/[^/]+", r"/san-pham/[^/]+", r"/sanpham/[^/]+", r"/p/[^/]+", r"-p[0-9]+\.html\z", r"-i\.[0-9]+\.[0-9]+", r"/dp/[A-Z0-9]{6,}"]
CATEGORY_PATHS = [r"/collections/[^/]+\z", r"/collection/[^/]+", r"/product-category/[^/]+", r"/category/[^/]+", r"/categories/[^/]+", r"/danh-muc/[^/]+", r"/danhmuc/[^/]+", r"/c/[^/]+", r"/cua-hang/?\z", r"/shop/?\z"]

_WHOLE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"


def split_url(url: Column) -> Column:
    """struct(scheme, host, port, path, query, fragment); null if it is no usable http(s) address."""
    t = trimmed(url)
    absolute = lambda s: F.when(s.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), s).when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9.\-]*\.[a-zA-Z]{2,}(/|\z|\?|#)"), F.concat(F.lit("https://"), s))
    return let(let(t, absolute), _parts)


def _parts(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, _WHOLE, i)
    scheme = F.lower(part(1))
    authority = F.regexp_replace(part(2), r"^.*@", "")
    port = F.regexp_extract(authority, r":([0-9]+)\z", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":[0-9]+\z", "")), r"\.\z", "")
    ok = s.rlike(_WHOLE) & scheme.isin("http", "https") & (host != "") & ((F.instr(host, ".") > 0) | (host == "localhost"))
    whole = F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), part(3).alias("path"), F.substring(part(4), F.lit(2), F.length(s)).alias("query"), F.substring(part(5), F.lit(2), F.length(s)).alias("fragment"))
    return F.when(ok, whole)


def is_tracking(name: Column) -> Column:
    n = F.lower(name)
    return n.startswith("utm_") | n.isin(*TRACKING)


def normalised(url: Column) -> Column:
    """struct(url, origin, host, path, removed); null if unusable."""
    return let(split_url(url), _normalised)


def _normalised(p: Column) -> Column:
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")
    name = lambda x: F.substring_index(x, "=", 1)
    kept = F.filter(pairs, lambda x: ~is_tracking(name(x)))
    removed = F.transform(F.filter(pairs, lambda x: is_tracking(name(x))), name)
    path = F.regexp_replace(p["path"], "/{2,}", "/")
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    default = ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80")) | (p["port"] == "")
    origin = F.concat(p["scheme"], F.lit("://"), p["host"], F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"])))
    clean = F.concat(origin, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(p.isNotNull(), F.struct(clean.alias("url"), origin.alias("origin"), p["host"].alias("host"), path.alias("path"), removed.alias("removed")))


def resolved(base: Column, href: Column) -> Column:
    """An absolute address for a link on a page; '' if there is none."""
    return let(F.struct(trimmed(href).alias("h"), split_url(base).alias("b")), lambda x: _resolved(x["h"], x["b"]))


def _resolved(h: Column, b: Column) -> Column:
    origin = F.concat(b["scheme"], F.lit("://"), b["host"], F.when(b["port"] == "", "").otherwise(F.concat(F.lit(":"), b["port"])))
    folder = F.regexp_replace(b["path"], r"[^/]*\z", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), h)
    empty = F.array().cast("array<string>")
    fold = lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(x)))
    walked = F.regexp_replace(F.array_join(F.aggregate(F.split(joined, "/"), empty, fold), "/"), "/{2,}", "/")
    return (
        F.when(F.coalesce(h, F.lit("")) == "", "")
        .when(h.rlike(r"(?i)^(mailto|tel|javascript|data):"), "")
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), h)
        .when(b.isNull(), "")
        .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("#") | h.startswith("?"), F.concat(origin, b["path"], h))
        .otherwise(F.concat(origin, walked))
    )


def unscannable(host: Column) -> Column:
    """The marketplace's name; null for other hosts."""
    return reduce(lambda out, item: F.when(host.rlike(item[1]), F.lit(item[0])).otherwise(out), reversed(UNSCANNABLE), F.lit(None).cast("string"))


def any_of(path: Column, patterns: list[str]) -> Column:
    return path.rlike("(?i)(?:" + "|".join(patterns) + ")")


def url_kind(url: Column) -> Column:
    return let(normalised(url), _kind)


def _kind(n: Column) -> Column:
    path, market = n["path"], unscannable(n["host"])
    item = any_of(path, PRODUCT_PATHS) | path.rlike("(?i)/item/")
    shop = path.rlike("(?i)/shop/[^/]+") | path.rlike("(?i)^/shop/") | path.rlike(r"^/[^/]+\z") | (path == "/")
    return (
        F.when(n.isNull(), "UNKNOWN")
        .when(market.isNotNull(), F.when(item, "MARKETPLACE_PRODUCT").when(shop, "MARKETPLACE_SHOP").otherwise("UNKNOWN"))
        .when(path == "/", "STORE")
        .when(any_of(path, PRODUCT_PATHS), "PRODUCT")
        .when(any_of(path, CATEGORY_PATHS), "CATEGORY")
        .otherwise("UNKNOWN")
    )


def pasted_urls(text: Column) -> Column:
    """The non-blank pieces of a pasted list."""
    return F.filter(F.split(text, r"[\r\n,;\s]+"), lambda x: x != "")


def path_id(url: Column) -> Column:
    """The path as an id of last resort."""
    path = F.regexp_replace(split_url(url)["path"], r"/\z", "")
    return F.when(path == "", "/").otherwise(path)
