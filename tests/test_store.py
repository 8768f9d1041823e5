import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from store_fixture import small_store

from shelfmark.operators import diff, sinks, snapshot, stats, trust
from shelfmark.operators.snapshot import FilterSpec, filtered, first_wins, last_wins, page
from shelfmark.plans import reports
from shelfmark.sources import captured


@pytest.fixture(scope="module")
def store(spark):
    return small_store(spark)


@pytest.fixture(scope="module")
def joined(store):
    return store.joined().cache()


@pytest.mark.parametrize(
    "spec,n",
    [
        (FilterSpec(latest_only=False), 16), (FilterSpec(), 10), (FilterSpec(stores=["beta.example"]), 4), (FilterSpec(categories=["Kitchen"]), 1), (FilterSpec(brands=["Beta"]), 4),
        (FilterSpec(price_from=200000, price_to=400000), 5), (FilterSpec(has_price=True), 9), (FilterSpec(verdicts=["LOW"]), 4), (FilterSpec(keyword="đệm"), 4), (FilterSpec(keyword="s-a9"), 1),
        (FilterSpec(stores=["alpha.example"], categories=["Bath"], has_price=True), 5), (FilterSpec(keyword="%"), 0), (FilterSpec(stores=["nowhere"]), 0), (FilterSpec(finished_only=True), 10),
    ],
)
def test_filters(joined, spec, n):
    assert filtered(joined, spec).count() == n
    assert spec.describe()


def test_latest_runs_before_other_filters(joined):
    assert filtered(joined, FilterSpec(price_from=600000)).count() == 1
    assert filtered(joined.where("scan_id != 'C'"), FilterSpec(price_from=600000)).count() == 1


def test_blanks_sort_last_both_ways(joined):
    for down in (False, True):
        rows = page(filtered(joined, FilterSpec()), 1, 500, "price", down).collect()
        assert rows[-1]["price"] is None and len(rows) == 10


def test_page_clamps(joined):
    rows = filtered(joined, FilterSpec())
    assert page(rows, 99, 3, "price", False).count() == 1
    assert page(rows, 1, 3, "price", False).count() == 3
    assert "short_desc" not in page(rows).columns


def test_deep_pages(joined, monkeypatch):
    rows = joined.repartition(5)
    want = [[r["row_seq"] for r in page(rows, n, 3, "price", True).collect()] for n in range(1, 8)]
    monkeypatch.setattr(snapshot, "DEEP", 0)
    assert [[r["row_seq"] for r in page(rows, n, 3, "price", True).collect()] for n in range(1, 8)] == want and len(want[5]) == 1
    assert page(joined.where("false"), 4, 3).count() == 0


def test_failures_in_a_row_over_stretches(spark):
    rng = random.Random(3)
    log = [(f"h{i % 3}", rng.choice([200, 404, 500, 503, None, 408, 500]), datetime(2026, 9, 1) + timedelta(minutes=rng.randrange(3000)), i) for i in range(400)]
    log += [("dead", 500, datetime(2026, 9, 1) + timedelta(hours=k), 1000 + k) for k in range(9)]
    want = {}
    for host, status, _, _ in sorted(log, key=lambda x: (x[2], x[3])):
        n, run, best = want.get(host, (0, 0, 0))
        run = run + 1 if status is None or status >= 500 or status == 408 else 0
        want[host] = n + 1, run, max(best, run)
    got = captured.host_health(spark.createDataFrame(log, "host string, status int, fetched_at timestamp, seq long").withColumn("scan_id", F.lit("s")))
    assert {r["host"]: (r["requests"], r["failures_in_a_row"]) for r in got.collect()} == {h: (n, best) for h, (n, _, best) in want.items()}


def test_describe(joined):
    d = stats.described(filtered(joined, FilterSpec())).first()
    assert (d["n"], d["median"], d["p25"], d["p75"], d["mean"], d["total"]) == (9, 300000, 200000, 400000, 330000, 2970000)
    none = stats.described(joined.where("false")).first()
    assert none["n"] == 0 and none["median"] is None and none["total"] is None


def test_ladder(joined):
    rows = {r["grp"]: r for r in stats.by_group(filtered(joined, FilterSpec()), "store").collect()}
    a, b = rows["alpha.example"], rows["beta.example"]
    assert (a["rows"], a["median"], a["p25"], a["p75"], a["mean"]) == (6, 350000, 225000, 475000, 370000)
    assert (b["rows"], b["n"], b["median"], b["fill"], b["p25"], b["p75"]) == (4, 3, 250000, 0.75, 200000, 300000)
    blank = stats.by_group(joined.withColumn("brand", F.lit(None).cast("string")), "brand").first()
    assert blank["grp"] == "(unspecified)"


@pytest.mark.parametrize("x,step", [(37, 50), (12000, 20000), (0.7, 1), (0, 1), (1000, 1000)])
def test_nice_step(x, step):
    assert stats.nice_step(x) == step


def test_histogram(joined):
    rows = filtered(joined, FilterSpec())
    assert [r["n"] for r in stats.histogram(rows, 6).collect()] == [2, 2, 2, 1, 1, 0, 1]
    assert [r["n"] for r in stats.histogram(rows, 12).collect()] == [1, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0, 1]
    assert stats.histogram(rows.where("false")).count() == 0
    one = stats.histogram(rows.where("price = 120000")).collect()
    assert len(one) == 1 and one[0]["n"] == 1


@pytest.mark.parametrize("codes,out", [(["VND", "VND"], "VND"), (["VND", "USD", "VND"], "VND (+1 others)"), ([None, ""], "")])
def test_dominant_currency(spark, codes, out):
    df = spark.createDataFrame([(i, c, "g") for i, c in enumerate(codes)], "row_seq long, currency string, g string")
    assert stats.currencies(df, "g").first()["currency"] == out


def test_facets(joined):
    rows = {(r["facet"], r["value"]): r["n"] for r in stats.facets(joined).collect()}
    assert rows[("store", "alpha.example")] == 12 and rows[("store", "beta.example")] == 4


def test_pivot(joined):
    table, stores = stats.pivot(filtered(joined, FilterSpec()))
    rows = {r["grp"]: r for r in table.collect()}
    assert stores == ["alpha.example", "beta.example"]
    assert (rows["Bath"]["c0"], rows["Bath"]["c1"], rows["Bath"]["cheapest"]) == (300000, 250000, "beta.example")
    assert (rows["Kitchen"]["c0"], rows["Kitchen"]["c1"]) == (500000, None)


def test_trust(joined):
    t = trust.trust_summary(filtered(joined, FilterSpec())).first()
    assert (t["worst"], t["scans"], t["scans_high"], t["scans_low"]) == ("LOW", 2, 1, 1)
    t = trust.trust_summary(filtered(joined, FilterSpec(stores=["alpha.example"]))).first()
    assert (t["worst"], t["scans"]) == ("HIGH", 1)
    assert trust.trust_summary(joined.where("false")).first()["worst"] is None


def test_warnings(joined):
    codes = lambda df, small=None: {r["code"] for r in trust.warnings(df, small).collect()}
    assert codes(joined.where("scan_id = 'C'")) == set()
    assert codes(joined.where("scan_id = 'C'"), ["x"]) == {"small_groups"}
    mixed = joined.withColumn("currency", F.when(F.col("row_seq") == 1, "USD").otherwise(F.col("currency")))
    assert "mixed_currency" in codes(mixed)
    assert "blank_currency" in codes(joined.withColumn("currency", F.lit(None).cast("string")))
    assert "few_prices" in codes(joined.withColumn("price", F.when(F.col("row_seq") < 5, F.col("price"))))
    far = joined.withColumn("captured_at", F.when(F.col("scan_id") == "C", F.expr("timestamp'2026-10-01 00:00:00'")).otherwise(F.col("captured_at")))
    assert "distant_scans" in codes(far)


def test_diff(joined):
    kinds = {r["change"]: r["n"] for r in diff.latest_changes(joined).groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"PRICE_UP": 1, "NEW": 1, "GONE": 1, "BACK_IN_STOCK": 2}
    up = diff.latest_changes(joined).where("change = 'PRICE_UP'").first()
    assert (up["old_price"], up["new_price"], up["delta"], up["pct"]) == (100000, 120000, 20000, 20.0)


def test_dedupe(spark):
    df = spark.createDataFrame([("s", "1", "a", 1), ("s", "1", "b", 2), ("s", None, "c", 3), ("s", None, "d", 4)], "scan_id string, external_id string, title string, row_seq long")
    assert sorted(r["title"] for r in first_wins(df).collect()) == ["a", "c", "d"]
    assert [r["title"] for r in last_wins(df, "scan_id", "external_id").collect()] == ["b"]


def test_reports(store, tmp_path):
    r = reports.report(store, "PRICE_LADDER", by="store")
    assert r.rows.count() == 2 and r.chart.count() == 2 and r.trust.first()["worst"] == "LOW"
    d = reports.report(store, "PRICE_DISTRIBUTION")
    assert sum(x["n"] for x in d.rows.collect()) == 9 and abs(sum(x["share"] for x in d.rows.collect()) - 1) < 1e-9
    assert reports.report(store, "CHANGES", source_url="https://alpha.example/").rows.count() == 5
    assert [w["code"] for w in reports.report(store, "CHANGES", source_url="https://alpha.example/").warnings.where("ord = 9").collect()] == ["gone"]
    once = reports.report(store, "CHANGES", source_url="https://beta.example/")
    assert once.rows.count() == 0 and [w["code"] for w in once.warnings.where("ord = 9").collect()] == ["one_scan"]
    q = reports.report(store, "SCAN_QUALITY", FilterSpec(stores=["nowhere"])).rows.collect()
    assert [x["scan_id"] for x in q] == ["C", "B", "A"] and q[1]["fill_price"] == 0.75 and q[1]["fill_stock_qty"] == 0
    assert reports.report(store, "NONE").warnings.first()["code"] == "unknown_report"
    reports.export_csv(r, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert parts[0].read_text().splitlines()[0] == "LOW" and len(text.splitlines()) == 5
    sheet = {x["at"]: x["c0"] for x in reports.sheet(r, FilterSpec()).collect()}
    assert [sheet[i] for i in range(4)] == ["Price ladder by store", "Trust", "", "Action"] and [sheet[i] for i in sorted(sheet)][-3:] == ["Group", "alpha.example", "beta.example"]
    assert reports.export_sheet(r, FilterSpec())[1] == ["Trust", "LOW"]
    reports.export_rows(store, FilterSpec(), str(tmp_path / "all"))
    assert len("".join(p.read_text() for p in (tmp_path / "all").glob("part-*")).splitlines()) == 11
    assert reports.page_bundle(store)["totals"].first()["rows"] == 16


def test_csv_cells(spark):
    df = spark.createDataFrame([('x,y', 'say "hi"', None)], "a string, b string, c string")
    assert df.select(sinks.csv_line(df, ["a", "b", "c"])).first()[0] == '"x,y","say ""hi""",'


@pytest.mark.parametrize(
    "rows,rung,price,key,out",
    [(0, 1, 0.0, 0.0, "UNSCANNABLE"), (5, 6, 1.0, 1.0, "UNSCANNABLE"), (5, 1, 1.0, 1.0, "HIGH"), (5, 1, 0.85, 0.85, "MEDIUM"), (5, 2, 0.69, 0.69, "LOW"), (5, 3, 1.0, 1.0, "MEDIUM"), (5, 5, 1.0, 1.0, "LOW"), (5, 1, 1.0, 0.9, "MEDIUM")],
)
def test_verdict(spark, rows, rung, price, key, out):
    assert spark.range(1).select(trust.verdict(F.lit(rows), F.lit(rung), F.lit(price), F.lit(key))).first()[0] == out


def test_idempotent_appends(store, tmp_path):
    path = str(tmp_path / "listings")
    a = store.listings.where("scan_id = 'A'")
    assert sinks.append_listings(a, path) == 6
    assert sinks.append_listings(a, path) == 0
    assert sinks.append_listings(store.listings, path) == 10
    nameless = store.listings.withColumn("external_id", F.when(F.col("row_seq") % 2 == 0, F.col("external_id"))).withColumn("scan_id", F.concat(F.lit("00"), "row_seq"))
    assert sinks.append_listings(nameless, path) == 16
    assert sinks.append_listings(nameless, path) == 0


def test_price_ladder_counts_all_small_groups(spark):
    store = small_store(spark)
    many = store.joined().where("scan_id = 'A' and row_seq = 1").withColumn("brand", F.explode(F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.concat(F.lit("B"), i.cast("string")))))
    found = reports.REPORTS["PRICE_LADDER"](store, many, by="brand").warnings.where("code = 'small_groups'").collect()
    assert [w["detail"].split(":")[0] for w in found] == ["1200"] and found[0]["detail"].endswith("...") and found[0]["detail"].count(",") == 4
