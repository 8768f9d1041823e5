"""HTML, sitemap and page-state readers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.money import BLANKS, let, mentions, trimmed

# Named entities that are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&ndash;", "-"), ("&mdash;", "-"), ("&hellip;", "..."), ("&eacute;", "é")]
# Signs of a bot challenge, looked for in the first 20000 characters.
CHALLENGES = [
    "cf-browser-verification", "_cf_chl", "cf_chl_opt", "just a moment...", "checking your browser", "attention required! | cloudflare",
    "ddos protection by", "captcha-delivery", "geo.captcha-delivery.com", "px-captcha", "are you a human", "incapsula incident id",
    "access denied", "request unsuccessful. incapsula", "verify you are human", "enable javascript and cookies to continue",
]
# Platform signatures, the first that fits counts.
PLATFORMS = [
    ("Shopify", r"(?i)cdn\.shopify\.com|Shopify\.theme|shopify-section"), ("Haravan", r"(?i)haravan\.com|Haravan\.|hstatic\.net"),
    ("Sapo/Bizweb", r"(?i)bizweb\.dkstatic\.vn|sapoapp|Sapo\.|sapo-section"), ("WordPress/WooCommerce", r"(?i)wp-content|wp-includes|woocommerce"),
    ("Magento", r"(?i)Magento_|mage/|magento"), ("Nhanh.vn", r"(?i)nhanh\.vn"), ("KiotViet", r"(?i)kiotviet"), ("Wix", r"(?i)wixstatic\.com|wix-code"), ("LadiPage", r"(?i)ladipage|ladi-"),
]
# Patterns of anchors, structured blocks, empty roots, and places where a page states its currency.
ANCHOR = r"(?is)(<a\b[^>]*>.{0,300}?</a>)"
JSON_BLOCK = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
EMPTY_ROOT = r"""(?i)<(div|main)\b[^>]*id\s*=\s*["']?(root|app|__next|__nuxt|q-app)["']?[^>]*>\s*</(div|main)>"""
CURRENCY_SCRIPT = r'\.currency\s*=\s*\{[^}]*"active"\s*:\s*"([A-Z]{3})"'
CURRENCY_ITEM = r"""(?i)itemprop\s*=\s*["']?pricecurrency["']?[^>]*content\s*=\s*["']([A-Za-z]{3})["']"""
CURRENCY_BLOCK = r'"priceCurrency"\s*:\s*"([A-Za-z]{3})"'


def decoded(s: Column) -> Column:
    """Named entities at once, then hexadecimal and decimal ones (so text can be decoded twice, as pages need it)."""
    mark = "\ue010"
    out = F.replace(s, F.lit("&amp;"), F.lit(mark))
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return _numeric(F.replace(out, F.lit(mark), F.lit("&")))


def _char(n: Column) -> Column:
    # char() keeps 8 bits only; other code points come through a JSON escape (pairs of surrogates above FFFF)
    unit = lambda v: F.concat(F.lit("\\u"), F.lpad(F.hex(v), 4, "0"))
    high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(1023))
    text = F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))
    return F.get_json_object(F.concat(F.lit('{"c":"'), text, F.lit('"}')), "$.c")


def _numeric(s: Column) -> Column:
    def put(whole: Column, pattern: str, base: int) -> Column:
        return let(whole, lambda text: replaced(text, pattern, base))

    def replaced(text: Column, pattern: str, base: int) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        digits = lambda m: F.regexp_extract(m, pattern, 1)
        value = lambda m: F.when(F.length(digits(m)) <= 8, F.conv(digits(m), base, 10).try_cast("long"))
        fits = lambda v: (v > 0) & (v < 0x110000) & ~v.between(0xD800, 0xDFFF)
        return F.when(F.size(codes) > 0, F.aggregate(codes, text, lambda out, m: F.when(fits(value(m)), F.replace(out, m, _char(value(m)))).otherwise(out))).otherwise(text)

    return put(put(s, "&#x([0-9a-fA-F]+);", 16), "&#([0-9]+);", 10)


def first_of(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def without_blocks(html: Column) -> Column:
    """Scripts, styles, noscripts and comments give a blank each."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", " ")


def visible_text(html: Column) -> Column:
    return trimmed(F.regexp_replace(decoded(F.regexp_replace(without_blocks(html), "<[^>]*>", " ")), BLANKS, " "))


def attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?i){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s">]+))"""
    return decoded(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}\b[^>]*>)"), F.lit(1))


def meta_pairs(html: Column) -> Column:
    """array<struct<key, value>> of meta tags that have both, in order."""
    filled = lambda c: F.nullif(c, F.lit(""))
    pair = lambda t: F.struct(F.lower(F.coalesce(filled(attribute(t, "property")), filled(attribute(t, "name")), filled(attribute(t, "itemprop")))).alias("key"), filled(attribute(t, "content")).alias("value"))
    return F.filter(F.transform(tags(html, "meta"), pair), lambda p: p["key"].isNotNull() & p["value"].isNotNull())


def meta(html: Column, key: str) -> Column:
    """The last value of a meta key."""
    return F.try_element_at(F.filter(meta_pairs(html), lambda p: p["key"] == key), F.lit(-1))["value"]


def canonical(html: Column) -> Column:
    own = F.filter(tags(html, "link"), lambda t: t.rlike(r"""(?i)rel\s*=\s*["']?canonical"""))
    return F.coalesce(attribute(F.get(own, F.lit(0)), "href"), F.lit(""))


def title(html: Column) -> Column:
    """The first h1, or the title."""
    h1 = visible_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.{0,400}?)</h1>", 1))
    return F.coalesce(F.nullif(h1, F.lit("")), visible_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.{0,400}?)</title>", 1)))


def json_blocks(html: Column) -> Column:
    """Texts of ld+json scripts."""
    found = F.regexp_extract_all(html, F.lit(JSON_BLOCK), F.lit(1))
    clean = lambda s: trimmed(F.regexp_replace(F.regexp_replace(s, r"^\s*//<!\[CDATA\[|\]\]>\s*\z", ""), "<!--|-->", ""))
    return F.filter(F.transform(found, clean), lambda s: s != "")


def links(html: Column, most: int | None = 3000) -> Column:
    """array<struct<href, text>> of anchors with an address, the first ``most`` (all: None)."""
    found = first_of(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), most)
    one = lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "href").alias("href"), visible_text(F.regexp_replace(a, r"(?is)^<a\b[^>]*>|</a>\z", "")).alias("text"))
    return F.filter(F.transform(found, one), lambda x: x["href"] != "")


def sitemap_locations(xml: Column, most: int | None = 60000) -> Column:
    found = first_of(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), most)
    return F.filter(F.transform(found, lambda u: trimmed(decoded(u))), lambda u: u != "")


def is_sitemap_index(xml: Column) -> Column:
    return F.coalesce(xml.rlike(r"(?i)<sitemapindex\b"), F.lit(False))


def challenge(html: Column, status: Column, head_chars: int | None = 20000) -> Column:
    """The sign of a bot challenge at the beginning of the page (anywhere: None); null if there is none."""
    whole = F.coalesce(html, F.lit(""))
    head = F.lower(whole if head_chars is None else F.substring(whole, 1, head_chars))
    first = reduce(lambda out, sign: F.when(F.instr(head, sign) > 0, F.lit(sign)).otherwise(out), reversed(CHALLENGES), F.lit(None).cast("string"))
    return F.coalesce(first, F.when(status == 403, F.lit("HTTP 403")))


def platform(html: Column, head_chars: int | None = 400_000) -> Column:
    head = html if head_chars is None else F.substring(html, 1, head_chars)
    return reduce(lambda out, item: F.when(head.rlike(item[1]), F.lit(item[0])).otherwise(out), reversed(PLATFORMS), F.lit(""))


def page_currency(html: Column) -> Column:
    """A currency that the page states itself (script, meta, structured data); '' if none."""
    script = lambda who: F.nullif(F.regexp_extract(html, who + CURRENCY_SCRIPT, 1), F.lit(""))
    item = F.nullif(F.regexp_extract(html, CURRENCY_ITEM, 1), F.lit(""))
    block = F.nullif(F.regexp_extract(F.array_join(json_blocks(html), "\n"), CURRENCY_BLOCK, 1), F.lit(""))
    return F.coalesce(script("Shopify"), script("Haravan"), F.upper(meta(html, "product:price:currency")), F.upper(meta(html, "og:price:currency")), F.upper(item), F.upper(block), F.lit(""))


def stock_state(availability: Column) -> Column:
    """IN, OUT or null from a schema.org availability."""
    s = F.lower(trimmed(availability))
    has = lambda *words: s.rlike("|".join(words))
    return F.when(has("instock", "in_stock", "limitedavailability"), "IN").when(has("outofstock", "soldout", "discontinued"), "OUT")


def short_description(html: Column) -> Column:
    return F.substring(visible_text(html), 1, 300)


def is_shell(html: Column) -> Column:
    """Whether scripts must draw the page: blank, an empty root, or hardly any text, and no price; never with structured products."""
    text = visible_text(html)
    product = F.array_join(json_blocks(html), "\n").rlike(r'(?i)"@type"\s*:\s*(\[[^\]]*)?"product"')
    root = html.rlike(EMPTY_ROOT)
    priced, n, m = F.size(mentions(text)) > 0, F.length(html), F.length(text)
    shell = ~priced & (root | ((m < 600) & (n > 2000)) | ((m / n < 0.02) & (n > 20000)))
    return F.when(trimmed(F.coalesce(html, F.lit(""))) == "", True).when(product, False).otherwise(shell)
