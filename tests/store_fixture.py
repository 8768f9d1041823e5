"""A small store with known answers: two sources, one of them scanned twice."""

from datetime import datetime

from shelfmark.schema import LISTING_COLUMNS, LISTING_SCHEMA
from shelfmark.sources.adapter import Store

T1, T2, T3 = datetime(2026, 9, 1, 8), datetime(2026, 9, 2, 9), datetime(2026, 9, 10, 8)


def _row(seq, scan, at, store, ext, title, brand, category, price, stock):
    host = f"https://{store}/"
    values = {"scan_id": scan, "captured_at": at, "source_url": host, "store": store, "platform": "P", "external_id": ext, "product_url": f"{host}p/{ext}", "title": title, "brand": brand, "category": category, "sku": f"S-{ext}", "price": price, "currency": "VND" if price is not None else None, "stock_state": stock}
    return tuple(values.get(c) for c in LISTING_COLUMNS) + (seq,)


def small_store(spark) -> Store:
    rows = [_row(i + 1, "A", T1, "alpha.example", f"A{i}", f"Mat {i}", "Alpha", "Bath" if i < 4 else "Kitchen", 100000.0 * (i + 1), "IN" if i % 2 == 0 else "OUT") for i in range(6)]
    rows += [_row(7 + i, "B", T2, "beta.example", f"B{i}", f"Tấm Đệm {i}", "Beta", "Bath", [150000.0, 250000.0, 350000.0, None][i], "IN" if i < 3 else None) for i in range(4)]
    prices = [120000.0, 200000.0, 300000.0, 400000.0, 500000.0, 700000.0]
    rows += [_row(11 + i, "C", T3, "alpha.example", f"A{i}" if i < 5 else "A9", f"Mat {i}" if i < 5 else "Mat new", "Alpha", "Kitchen" if i == 4 else "Bath", prices[i], "IN") for i in range(6)]
    scans = spark.createDataFrame([("A", T1, "HIGH", 1, 1), ("B", T2, "LOW", 5, 2), ("C", T3, "HIGH", 1, 3)], "scan_id string, started timestamp, verdict string, rung int, row_seq long")
    return Store(spark.createDataFrame(rows, LISTING_SCHEMA), scans)
