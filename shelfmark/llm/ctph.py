"""Operator 4: context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text where it hits a residue of the block size 2^k (at size 1 every byte is a chunk); every chunk
gives one of 64 letters. A fingerprint is ``block size:letters:letters at twice the block size`` with at most 64 and 32
letters, the last of which stands for all the rest. Fingerprints whose block sizes are equal or differ by a factor of two are compared by
edit distance (insertions and deletions), after runs of a letter are cut to three; those without seven letters in
a row in common (half of the letters, if the shorter one has fewer than 14) are unlike.

Defined cases: a null text is empty and has fingerprint ``1::``; equal texts have equal fingerprints and likeness 1; with a
single row the next document is the row itself; rows with equal ids follow each other by a hash of the text, the larger first; a null id sorts after
all others; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.store import picked
from shelfmark.runtime import shipped

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LONG, SHORT, COMMON = 7, 64, 32, 7
#: Bytes hashed at once.
BLOCK_BYTES = 2 << 20
#: Bytes of text in a bucket of neighbouring documents.
BUCKET_BYTES = 64 << 20


def _triggers(data: np.ndarray) -> np.ndarray:
    """For every place the largest k for which the rolling hash ends a chunk there at block size 2^k."""
    x = data.astype(np.uint32)
    total, weighted, shifted = x.copy(), x * np.uint32(WINDOW), x.copy()
    for k in range(1, WINDOW):
        past = x[:-k]
        total[k:] += past
        weighted[k:] += past * np.uint32(WINDOW - k)
        shifted[k:] ^= past << np.uint32(5 * k)
    h = total + weighted + shifted
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    low = h & (~h + np.uint32(1))
    return np.where(h == 0, 32, np.frexp(low.astype(np.float32))[1] - 1).astype(np.int8)


def _letters(view: memoryview, n: int, cuts: np.ndarray, most: int) -> str:
    ends = cuts[: most - 1].tolist()
    if not ends or ends[-1] < n:
        ends.append(n)
    begin, out = 0, []
    for end in ends:
        if end > begin:
            out.append(LETTERS[zlib.crc32(view[begin:end]) & 63])
        begin = end
    return "".join(out)


def fingerprints(texts: list[bytes]) -> list[str]:
    """One fingerprint a byte string; each depends on its own bytes alone."""
    out: list[str] = []
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end]) + WINDOW
            end += 1
        gap = b"\0" * WINDOW
        data = np.frombuffer(gap + gap.join(texts[begin:end]) + gap, np.uint8)
        rank = _triggers(data)
        start = WINDOW
        for text in texts[begin:end]:
            n = len(text)
            deep = rank[start : start + n]
            k = max(0, int(np.ceil(np.log2(max(n, 1) / LONG))))
            while k and np.count_nonzero(deep >= k) + 1 < SHORT:
                k -= 1
            view = memoryview(text)
            out.append(f"{1 << k}:{_letters(view, n, np.flatnonzero(deep >= k) + 1, LONG)}:{_letters(view, n, np.flatnonzero(deep > k) + 1, SHORT)}")
            start += n + WINDOW
        begin = end
    return out


def _short_runs(s: str) -> str:
    return s if len(s) < 4 else "".join(c for i, c in enumerate(s) if i < 3 or not c == s[i - 1] == s[i - 2] == s[i - 3])


def _common_run(a: str, b: str) -> bool:
    n = min(COMMON, (min(len(a), len(b)) + 1) // 2)
    return n > 0 and not {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1))


def common_subsequence(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Lengths of the longest common subsequences of strings of up to 64 letters, all pairs at once, one bit a letter."""
    if not pairs:
        return np.empty(0, np.int64)
    first = np.zeros((len(pairs), LONG), np.int64) - 1
    second = np.zeros((len(pairs), LONG), np.int64) - 1
    for i, (a, b) in enumerate(pairs):
        first[i, : len(a)] = np.frombuffer(a.encode(), np.uint8)
        second[i, : len(b)] = np.frombuffer(b.encode(), np.uint8)
    bit = np.uint64(1) << np.arange(LONG, dtype=np.uint64)
    v = np.full(len(pairs), ~np.uint64(0))
    for j in range(LONG):
        letter = second[:, j]
        same = np.where((first == letter[:, None]) & (letter >= 0)[:, None], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        u = v & same
        v = (v + u) | (v - u)
    return LONG - np.unpackbits(v.view(np.uint8)).reshape(len(pairs), 64).sum(axis=1).astype(np.int64)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints."""
    out = np.zeros(len(pairs))
    todo, whose = [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for s, t in ([(a, b), (a2, b2)] if p == q else [(a2, b)] if 2 * p == q else [(a, b2)] if p == 2 * q else []):
            s, t = _short_runs(s), _short_runs(t)
            if _common_run(s, t):
                todo.append((s, t))
                whose.append(i)
    for begin in range(0, len(todo), 4096):
        part, rows = todo[begin : begin + 4096], whose[begin : begin + 4096]
        size = np.array([len(s) + len(t) for s, t in part])
        np.maximum.at(out, rows, 2 * common_subsequence(part) / size)
    return out


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (bucket, role, doc_id, text) such that within a bucket, by role and descending id, every role 0 row is followed by its next document.

    Ids are dealt to buckets of about ``bucket_bytes`` of text by quantiles, rows without an id by a hash of their text; the first rows of the next bucket come again with role 1. One
    shuffle of the texts, a task for each bucket.
    """
    spark = shipped(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("named", F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("doc_id", F.lit(0))).withColumn("h", F.xxhash64("text"))
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.coalesce(F.sum(F.when(F.col("named"), size)), F.lit(0)).alias("named"), F.coalesce(F.sum(F.when(~F.col("named"), size)), F.lit(0)).alias("other")).first()
    unnamed = 1 + total["other"] // bucket_bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total["named"] // bucket_bytes)
    marks = rows.where("named").select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = np.unique(np.array(marks, np.float64))

    def buckets(named: pd.Series, key: pd.Series, h: pd.Series) -> np.ndarray:
        spread = np.minimum((h.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5) * unnamed, unnamed - 1).astype(np.int64)
        return np.where(named.to_numpy(bool), unnamed + np.searchsorted(bounds, key.to_numpy(np.float64), side="left"), spread)

    @F.pandas_udf("long")
    def bucket_of(named: pd.Series, key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(buckets(named, key, h))

    place = F.struct("named", "key", "h")
    tops = rows.select("named", "key", "h").groupBy(bucket_of("named", "key", "h").alias("b")).agg(F.max(place).alias("top"))
    tops = sorted((r["b"], tuple(r["top"])) for r in tops.collect())  # a row a bucket
    again = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    @F.pandas_udf("array<struct<bucket:long,role:int>>")
    def places(named: pd.Series, key: pd.Series, h: pd.Series) -> pd.Series:
        own = zip(buckets(named, key, h).tolist(), zip(named.tolist(), key.tolist(), h.tolist(), strict=True), strict=True)
        return pd.Series([[(b, 0)] + ([(again[k], 1)] if k in again else []) for b, k in own])

    dealt = rows.select(F.explode(places("named", "key", "h")).alias("p"), "named", "key", "h", "doc_id", "text").select("p.bucket", "p.role", "named", "key", "h", "doc_id", "text")
    order = ["bucket", "role", F.desc("named"), F.desc("key"), F.desc("h"), "text"]
    return dealt.repartitionById(unnamed + len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions(*order)


RESULT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """RESULT_SCHEMA, one row a document."""

    def run(batches):
        kept = None  # the last row of the batch before: its next document is still to come
        for pdf in batches:
            rows = list(zip(pdf["bucket"], pdf["role"], pdf["doc_id"], pdf["text"], strict=True))
            prints = fingerprints([r[3].encode("utf-8", "surrogatepass") for r in rows])
            if kept is not None:
                rows, prints = [kept[0], *rows], [kept[1], *prints]
            pairs = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i][0] == rows[i + 1][0]]
            kept = rows[-1], prints[-1]
            if not pairs:
                continue
            changed = [edited(rows[i][3], rows[i + 1][3]).encode("utf-8", "surrogatepass") for i in pairs]
            other = fingerprints(changed)
            out = pd.DataFrame({
                "doc_id": pd.array([rows[i][2] for i in pairs], "Int64"), "n_chars": [len(rows[i][3]) for i in pairs], "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
                "fingerprint": [prints[i] for i in pairs], "edited_fingerprint": other,
                "near_edited": likeness([(prints[i], o) for i, o in zip(pairs, other, strict=True)]), "near_next": likeness([(prints[i], prints[i + 1]) for i in pairs]),
            })
            yield out

    return in_order(docs).mapInPandas(run, RESULT_SCHEMA)
