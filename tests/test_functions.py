import pytest
from pyspark.sql import functions as F

from shelfmark.functions import html as H
from shelfmark.functions import money as M
from shelfmark.functions import urls as U
from shelfmark.operators import extract
from shelfmark.plans import vectors as V
from shelfmark.sources import captured


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("out")).first()["out"]


PRICES = {
    "1.250.000": (1250000, None), "1,250,000": (1250000, None), "250.000₫": (250000, "VND"), "250.000 đ": (250000, "VND"), "1.250.000 VND": (1250000, "VND"), "1 250 000": (1250000, None), "250000": (250000, None),
    "1.250.00": (None, None), "3.5": (None, None), "250k": (None, None), "1tr2": (None, None), "12.34.567": (None, None), "": (None, None), "Liên hệ": (None, None), "1.250.000₫ - 2.000.000₫": (None, "VND"), "-250.000": (None, None),
    "259000.00": (None, None), "1.250.000,50": (1250000.5, None), "1.250,000": (None, None), "S$100": (None, "USD"), "250.000 vnđ": (None, "VND"), "$100": (100, "USD"),
}


def test_human_prices(spark):
    df = spark.createDataFrame([(k,) for k in PRICES], "v string").select("v", M.human_price(F.col("v")).alias("p"))
    assert {r["v"]: (r["p"]["price"], r["p"]["currency"]) for r in df.collect()} == PRICES
    reasons = {"250k": "shorthand (250k)", "1tr2": "letters_left", "": "blank", "-250.000": "minus_or_range", "3.5": "later_group_not_3_digits (3.5)", "1.250.000": "no_currency_seen"}
    got = {r["v"]: r["p"]["reason"] for r in df.collect()}
    assert {k: got[k] for k in reasons} == reasons


@pytest.mark.parametrize("text,out", [("259000.00", 259000.0), ("1.250.000", None), (None, None), ("", None)])
def test_machine(spark, text, out):
    assert one(spark, text, M.machine_number) == out


@pytest.mark.parametrize("text,out", [("1.234", 1234), ("abc", None), ("4.5", 45)])
def test_counts(spark, text, out):
    assert one(spark, text, M.whole_number) == out


@pytest.mark.parametrize("text,out", [("4.5", 4.5), ("4,5", 4.5), ("9", None), ("x", None)])
def test_rating(spark, text, out):
    assert one(spark, text, M.star_rating) == out


def test_flexible(spark):
    p = one(spark, "3.5", lambda c: M.flexible_price(c, F.lit("VND")))
    assert p["price"] == 3.5 and p["warning"]


KINDS = ["STORE", "STORE", "CATEGORY", "CATEGORY", "CATEGORY", "PRODUCT", "PRODUCT", "PRODUCT", "PRODUCT", "MARKETPLACE_SHOP", "MARKETPLACE_SHOP", "MARKETPLACE_PRODUCT", "MARKETPLACE_PRODUCT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_url_kinds(spark):
    df = spark.createDataFrame(list(enumerate(V.URLS[:16])), "i int, v string").select("i", U.url_kind(F.col("v")).alias("k")).orderBy("i")
    assert [r["k"] for r in df.collect()] == KINDS


@pytest.mark.parametrize(
    "url,out",
    [("HTTPS://Brand.VN:443/products/x#mo-ta", "https://brand.vn/products/x"), ("https://u:p@a.example/x//y/?utm_a=1&page=2", "https://a.example/x/y?page=2"), ("ftp://a.example", None), ("javascript:x", None), ("", None), ("a.example", "https://a.example/")],
)
def test_normalised(spark, url, out):
    got = one(spark, url, U.normalised)
    assert (got["url"] if got else None) == out


@pytest.mark.parametrize("href,out", [("/products/y", "https://a.example/products/y"), ("../d", "https://a.example/x/d"), ("//cdn.example/z", "https://cdn.example/z"), ("https://o.example/", "https://o.example/"), ("javascript:x", "")])
def test_resolved(spark, href, out):
    assert one(spark, href, lambda c: U.resolved(F.lit("https://a.example/x/y/z"), c)) == out


def test_entities(spark):
    assert one(spark, "a&amp;lt;&#65;&#x1F600;&eacute;&#0;", H.decoded) == "a&lt;A😀é&#0;"
    assert one(spark, "<h1> a <b>b</b></h1>", H.title) == "a b"


def test_shell_and_challenge(spark):
    assert one(spark, '<div id="root"></div>', H.is_shell) is True
    assert one(spark, "", H.is_shell) is True
    assert one(spark, "<p>5.000 đ</p>", H.is_shell) is False
    assert one(spark, "Just a moment...", lambda c: H.challenge(c, F.lit(200))) == "just a moment..."


def test_feed(spark):
    docs = spark.createDataFrame([("f", "https://a.example", "https://a.example", "VND", V.FEED)], "scan_id string, origin string, url string, currency string, body string")
    rows = extract.products_json(docs, ["scan_id"]).orderBy("p_at", "v_at").collect()
    assert [r["external_id"] for r in rows] == ["1:11", "1:12", "2:21", "/products/bare"]
    assert (rows[0]["price"], rows[0]["list_price"], rows[0]["stock_state"], rows[0]["short_desc"]) == (259000, 329000, "IN", "Soft")
    assert rows[1]["row_warnings"] and rows[2]["variant"] is None and rows[2]["price"] is None
    assert rows[3]["missing_reason"]["price"] == "product without variants"


def test_store_api(spark):
    rows = extract.woo_json(spark.createDataFrame([("w", V.WOO)], "scan_id string, body string"), ["scan_id"]).orderBy("p_at").collect()
    assert (rows[0]["price"], rows[0]["list_price"], rows[0]["rating"], rows[0]["category"], rows[0]["title"]) == (350000, 420000, 4.5, "A | B", "Mat & rug")
    assert rows[1]["price"] is None and rows[1]["missing_reason"]["price"] == "price range" and rows[1]["rating"] is None
    assert rows[2]["price"] == 10 and rows[2]["list_price"] is None


def test_pages(spark):
    pages = spark.createDataFrame(V.PAGES, "scan_id string, url string, body string")
    ld = extract.json_ld(pages, ["scan_id", "url"]).orderBy("node_at").collect()
    assert (ld[0]["price"], ld[0]["currency"], ld[0]["stock_state"], ld[0]["rating"], ld[0]["review_count"]) == (459000, "VND", "IN", 4.8, 137)
    assert ld[1]["price"] is None
    mo = {r["scan_id"]: r for r in extract.micro_or_graph(pages, ["scan_id", "url"]).collect()}
    assert mo["s3"]["price"] == 329000 and mo["s3"]["stock_state"] == "OUT" and mo["s2"]["title"] == "Og mat"
    guess = extract.html_guess(pages.where("scan_id = 's4'"), ["scan_id", "url"]).collect()
    assert {(r["title"], r["price"]) for r in guess} == {("Mat A", 1250000), ("Mat B", 250000)}
    assert all(r["row_warnings"] for r in guess)


def test_nearest_anchor_distance(spark):
    body = "<a href='/a'>A</a>" + "x" * 1181 + "1.000 đ" + "y" * 1300 + "2.000 đ"
    pages = spark.createDataFrame([("s", "https://a.example/", body)], "scan_id string, url string, body string")
    rows = extract.nearest_anchor(extract.price_places(pages, ["scan_id", "url"]), ["scan_id", "url"]).orderBy("pos").collect()
    assert [r["text"] for r in rows] == ["A", None]


def test_robots(spark):
    from shelfmark.functions import robots as R

    files = spark.createDataFrame(V.ROBOTS, "origin string, body string")
    paths = files.select("origin").crossJoin(spark.createDataFrame([(p,) for p in V.ROBOT_PATHS], "path string"))
    got = {(r["origin"][8], r["path"]): r["allowed"] for r in R.allowed(paths, R.applying(R.rules(files), "shelfmarkbot")).collect()}
    assert got[("a", "/private/open/1")] and not got[("a", "/private/x")] and got[("a", "")]
    assert got[("b", "/")] and not got[("b", "/a.pdf")] and got[("b", "/a.pdf?x")] and not got[("b", "/x1y")]
    assert got[("c", "/early")]


def test_settings(spark):
    own = spark.createDataFrame([("request_delay_ms", "200"), ("page_cap", " 50 "), ("user_agent", " ")], "key string, value string")
    got = {r["key"]: r["value"] for r in captured.settings(spark, own).collect()}
    assert got["request_delay_ms"] == "1500" and got["page_cap"] == "50" and got["user_agent"] == "ShelfmarkBot/1.0"


def test_redirects(spark):
    chain = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(7)], "url string, target string")
    got = {r["url"]: (r["final_url"], r["hops"]) for r in captured.final_urls(chain).collect()}
    assert got["u5"] == ("u7", 2) and got["u2"] == ("u7", 5) and got["u0"][0] is None


def test_attempts(spark):
    log = spark.createDataFrame([("s", "u", 503, "", 1), ("s", "u", 200, "ok", 2), ("s", "v", 503, "", 1), ("s", "w", 404, "", 1)], "scan_id string, url string, status int, body string, seq int").withColumn("final_url", F.col("url")).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    got = {r["url"]: r["outcome"] for r in captured.attempts(log).collect()}
    assert got == {"u": "ok", "v": "retry", "w": "refused"}
