import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark.plans.oracle import SQL
from shelfmark.plans.queries import QUERIES, ingested_counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["store_load_join", "latest_snapshot_rows", "group_ladder_brand", "price_histogram", "snapshot_diff", "scan_verdicts", "url_normalize", "html_text", "ingest_idempotent", "price_ladder_latest"])
def test_same_as_sql(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(SQL[name]).fetchdf())


QUICK = ["url_resolve", "html_entities", "robots_rules", "robots_policy", "robots_group_choice", "products_json_explode", "woo_json_explode", "jsonld_nodes", "json_bodies", "redirect_chains", "fetch_attempts", "page_states", "day_gaps", "sitemap_priority", "sort_names", "stamped_rows", "catalog_tables", "derived_table", "ledger_append", "report_sheet", "rows_csv", "change_caveats", "data_query", "dedupe_first_wins"]


@pytest.mark.parametrize("name", QUICK)
def test_same_as_expected(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(SQL[name]).fetchdf())


def test_every_query_of_the_store_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", ["price_ladder_latest", "store_load_join", "latest_snapshot_rows", "snapshot_diff", "two_snapshot_union", "consecutive_price_changes", "dedupe_first_wins", "group_ladder_brand", "data_warnings", "scan_fill_rates", "change_caveats"])
def test_order_lines_are_read_twice_at_most(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines()) <= 2


def test_sql_has_no_strangers():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streaming_restart_adds_nothing(spark, tmp_path):
    from shelfmark.plans.queries import ingested_rows
    from shelfmark.streaming.ingest import ingest

    first = ingested_rows(spark, DATA, str(tmp_path))
    n = first.count()
    assert first.where("external_id is null").count() > 0
    again = ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/other-checkpoint", schema=spark.read.parquet(f"{tmp_path}/in/a").schema)
    assert again.count() == n


def test_ingestion_takes_all_stores(spark, db):
    got = ingested_counts(spark, DATA).toPandas()
    assert rows(got) == rows(db.execute(SQL["ingest_idempotent"]).fetchdf()) and (got["rows"] > got["ids"]).any()
    assert got["store"].nunique() == 10  # all that this small table has
