import random

import corpus_pipeline
import pandas as pd
import public_tokenizers as P
from pyspark.sql import functions as F
from test_spans_join import brute_join, brute_spans

from shelfmark.llm import knn, packing, spans


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    passage = make(60) + "."
    rows, labels = [], []
    for i in range(120):
        text = make(rng.randrange(30, 150)) + "."
        if i % 10 == 3:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 10 == 5 and i > 10:
            text = rows[i - 5][1] + " tail"
        elif i % 10 == 7:
            text = text + "\n" + passage
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 10 != 3), 0))
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    sf_dir = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    assert {r["doc_id"] for r in good.collect()} == {i for i, q, _ in labels if q}
    assert good.columns == corpus_pipeline.COLUMNS
    left = [(r[0], r[1]) for r in rows if r[0] % 10 != 3]
    groups = brute_join(left, 5, 80, 100)
    unique = [(d, t) for d, t in left if groups[d][1] == d]
    final = brute_spans(unique, **spans.PASSAGES)
    coder = packing.vocabulary_encoder(P.path("byte_bpe_50k.json"), P.PATTERN, True)
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    want = {d: len(ids) + 1 for d, ids in zip(final, coder.encode(list(final.values())), strict=True)}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert len(unique) < len(left) and any(final[d] != t for d, t in unique)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    text, other = "These five words are here. " * 3 + "One more of them. And the last one.", "Nothing like it at all. Is it not so. Yes it is."
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (None, text, "en", "s", 5), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, "w" * 200000, "en", "s", 9), (6, "long words " * 50000, "en", "s", 9), (None, other, "en", "s", 9), (None, other, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pd.DataFrame(rows, columns=docs.columns).astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(1, 1), (2, 1), (3, 0), (5, 1)], columns=["doc_id", "quality"]).to_parquet(tmp_path / "labels.parquet")
    clash = docs.withColumn("score", F.lit("x")).withColumn("removed_runs", F.lit(1)).withColumn("c0", F.lit(1)).withColumn("tag", F.lit("x")).toDF(*docs.columns, "score", "removed_runs", "c0", "TEXT")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, f"file://{tmp_path}")
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        got = out.collect()
        if name == "near_duplicates":
            kept = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in got)
            assert kept == sorted([(1, len(text)), (3, 0), (4, 0), (5, 200000), (6, 550000), (0, len(other))])
        if name == "repeated_passages":
            assert {(3, None, None), (4, "", 0), (5, "w" * 200000, 9)} <= {(r["doc_id"], r["text"], r["n_chars"]) for r in got} and len(got) == len(rows)
        if name == "packing":
            assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4, 5, 6} and sum(r["start"] == 0 for r in got) == len(rows)


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().astype({"doc_id": "int64"}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": [1], "quality": [1]}).to_parquet(tmp_path / "labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.count() == 0, name
    assert knn.judged(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
