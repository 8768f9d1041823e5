"""Operator 9: a quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams, hashed four-grams of character classes, and how often words and lines repeat. Term
vectors are damped, weighted and projected by a truncated SVD fitted on labelled rows. All documents are compared with all
labelled vectors by blocked cosine products; the nearest ``neighbours`` vote, weighted by a power of their cosine.

The fit uses at most ``most_labelled`` labelled rows, those with the smallest hash of their id: a documented bound of the
classifier, which also bounds its broadcast (most_labelled * (dims + 1) floats plus terms * dims floats). Scoring covers every whole text.

Defined cases: null and empty texts have no terms and score the share of label 1 in the fit; equal texts score
alike; a document labelled twice has the smaller label; without any labelled row every score is 0.5; null ids are never
labelled or held out; an empty table gives no row; columns are taken by their exact names, and other columns change nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.store import begin, free_name, give_back, picked
from shelfmark.runtime import shipped

TRIGRAMS, SHAPES, COUNTS = 1024, 512, 24
TERMS = TRIGRAMS + SHAPES + COUNTS
DIMS, NEIGHBOURS, MOST_LABELLED, POWER = 48, 15, 4096, 4


def _classes() -> np.ndarray:
    """A class for every byte: lower, upper, digit, high byte, line end, space, and each sign its own."""
    out = np.arange(256, dtype=np.int64) % 40 + 8
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b"\n\r", b" \t")):
        out[list(chars)] = i
    return out


_CLASS = _classes()


def _spread(x: np.ndarray, m: int) -> np.ndarray:
    return (x * 2654435761 & 0xFFFFFFFF) * m >> 32


def _share(x: float) -> int:
    return min(7, int(8 * x))


def terms(texts: list[str | None]) -> np.ndarray:
    """One row of TERMS term weights a text, of length 1 (0 for empty texts)."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        x = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(x) >= 3:
            y = x.astype(np.int64)
            out[i, :TRIGRAMS] = np.bincount(_spread(y[:-2] << 16 | y[1:-1] << 8 | y[2:], TRIGRAMS), minlength=TRIGRAMS)
        c = _CLASS[x]
        if len(c) >= 4:
            c = ((c[:-3] * 48 + c[1:-2]) * 48 + c[2:-1]) * 48 + c[3:]
            out[i, TRIGRAMS : TRIGRAMS + SHAPES] = np.bincount(_spread(c, SHAPES), minlength=SHAPES)
        words, lines = text.split(), text.splitlines()
        pairs = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
        known = len(set(words)) / max(1, len(words)) ** 0.8
        for k, share in enumerate((pairs, min(1.0, known), 1 - len(set(lines)) / max(1, len(lines)))):
            out[i, TRIGRAMS + SHAPES + 8 * k + _share(share)] = 1
    np.log1p(out[:, : TRIGRAMS + SHAPES], out=out[:, : TRIGRAMS + SHAPES])
    for a, b, weight in ((0, TRIGRAMS, 0.6), (TRIGRAMS, TRIGRAMS + SHAPES, 1.0), (TRIGRAMS + SHAPES, TERMS, 0.6)):
        size = np.linalg.norm(out[:, a:b], axis=1, keepdims=True)
        out[:, a:b] *= weight / np.maximum(size, 1e-12)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    mean: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = ((rows - self.mean) * self.weight) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None], block: int = 512) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        full = [i for i, t in enumerate(texts) if t]
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for begin in range(0, len(full), block):
            own = full[begin : begin + block]
            near = self.project(terms([texts[i] for i in own])) @ self.vectors.T
            # rounded cosines with the row's number below make all keys differ, so that ties fall alike everywhere
            key = np.rint(near * 1e5).astype(np.int64) * len(self.labels) + np.arange(len(self.labels))
            best = np.argpartition(key, -k, axis=1)[:, -k:]
            best.sort(axis=1)
            vote = np.maximum(np.round(np.take_along_axis(near, best, 1), 5), 0) ** POWER + 1e-9
            out[own] = (vote * self.labels[best]).sum(axis=1) / vote.sum(axis=1)
        return np.round(out, 6)


def fit(rows: np.ndarray, labels: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS, seed: int = 7) -> Model:
    """Truncated SVD by randomised subspace iteration over weighted, centred term rows."""
    if not len(rows):
        return Model(np.zeros(TERMS), np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), labels, neighbours, 0.5)
    mean = rows.mean(axis=0)
    weight = 1 / (rows.std(axis=0) + 0.02)
    x = (rows - mean) * weight
    dims = max(1, min(dims, *x.shape))
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((len(x), min(dims + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ v.T)[:, :dims].astype(np.float32)
    model = Model(mean.astype(np.float32), weight.astype(np.float32), axes, np.zeros((0, dims), np.float32), labels.astype(np.float64), neighbours, float(labels.mean()))
    model.vectors = model.project(rows.astype(np.float32)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of the labelled rows that are not held out, at most ``most_labelled`` of them."""
    spark = shipped(docs.sparkSession)
    known = picked(labels, doc_id=id_col, label=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text != ''")
    ids = {r["doc_id"]: r["label"] for r in chosen.collect()}  # at most most_labelled rows
    lookup = spark.sparkContext.broadcast(ids)
    # the bounded list of ids is broadcast, so only texts of the fit reach Python
    few = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))

    def run(batches):
        for own in batches:
            if len(own):
                yield pd.DataFrame({"doc_id": own["doc_id"], "terms": [t.astype(np.float16).tobytes() for t in terms(own["text"].tolist())]})

    def fit_all(batches):
        parts = [pdf for pdf in batches if len(pdf)]
        got = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame({"doc_id": [], "terms": []})
        rows = np.stack([np.frombuffer(t, np.float16) for t in got["terms"]]).astype(np.float32) if len(got) else np.zeros((0, TERMS), np.float32)
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows, np.array([lookup.value[int(d)] for d in got["doc_id"]], np.float64)))]})

    # rows that repeat an id count once; the fit's one task gets at most most_labelled rows of TERMS half floats
    found = texts.join(few, "doc_id", "left_semi").mapInPandas(run, "doc_id long, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms"))
    return pickle.loads(found.repartition(1).mapInPandas(fit_all, "model binary").first()["model"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, with score and predicted (score_1, predicted_1 and so on where a column has the name)."""
    shared = shipped(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin("knn")
        for texts in parts:
            yield pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]))
        give_back()

    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names).withColumn("score", score(F.col(names[docs.columns.index(text_col)]).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).toDF(*docs.columns, free_name(docs, "score"), free_name(docs, "predicted"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = picked(docs, doc_id="doc_id", text="text")
    return scored(rows, fitted(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
