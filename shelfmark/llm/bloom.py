"""Bloom filters built with DataFrame aggregates and probed with numpy.

Keys are 64-bit hashes (signed longs in Spark). Bit i of a key is (low + i * odd high) mod m, m a power of two.
A filter has at most MAX_BITS bits whatever the input, so its broadcast has a fixed bound; ``thinned`` joins
larger sets of keys instead, and callers check what a filter lets through exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import shipped

MAX_BITS = 1 << 27
HASHES = 4
#: 64-bit words of a block, the unit in which a filter is gathered.
BLOCK = 1024


@dataclass
class Bloom:
    bits: int
    words: np.ndarray

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        """Per key (int64 or uint64 array): False only if it was surely never added."""
        k = keys.astype(np.uint64, copy=False) if keys.dtype != np.int64 else keys.view(np.uint64)
        low, high = k & np.uint64(0xFFFFFFFF), (k >> np.uint64(32)) | np.uint64(1)
        out = np.ones(len(k), bool)
        for i in range(HASHES):
            at = (low + np.uint64(i) * high) & np.uint64(self.bits - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def size_for(n: int, bits_per_key: int = 12) -> int:
    return min(MAX_BITS, max(64, 1 << max(1, int(n) * bits_per_key - 1).bit_length()))


def build(df: DataFrame, key: Column, n: int, bits_per_key: int = 12) -> Bloom:
    """The filter of all values of ``key`` (a long); n is about how many there are."""
    shipped(df.sparkSession)
    bits = size_for(n, bits_per_key)
    low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + F.lit(i) * high).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]))
    filled = df.where(key.isNotNull()).select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))

    def pack(batches):
        blocks: dict[int, np.ndarray] = {}
        for pdf in batches:
            w, b = pdf["w"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64).view(np.uint64)
            for k in np.unique(w // BLOCK):
                own = w // BLOCK == k
                blocks.setdefault(int(k), np.zeros(BLOCK, np.uint64))[w[own] % BLOCK] = b[own]
        yield pd.DataFrame({"k": list(blocks), "words": [x.tobytes() for x in blocks.values()]}).astype({"k": "int64"})

    # whole blocks reach the driver, bits / 8 bytes in all
    words = np.zeros(max(BLOCK, bits // 64), np.uint64)
    for row in filled.repartition(F.floor(F.col("w") / BLOCK)).mapInPandas(pack, "k long, words binary").collect():
        words[row["k"] * BLOCK : (row["k"] + 1) * BLOCK] = np.frombuffer(row["words"], np.uint64)
    return Bloom(bits, words)


def thinned(rows: DataFrame, key: Column, keys: DataFrame, bits_per_key: int = 12) -> DataFrame:
    """The rows whose ``key`` is likely among ``keys`` (one column h, distinct longs), all that are in it included.

    A filter that fits MAX_BITS is broadcast; beyond that the keys are joined, which shuffles both sides but has no bound.
    """
    n = keys.count()
    if n * bits_per_key > MAX_BITS:
        return rows.withColumn("__key", key).join(keys.select(F.col("h").alias("__key")), "__key", "left_semi").drop("__key")
    test = rows.sparkSession.sparkContext.broadcast(build(keys, F.col("h"), n, bits_per_key))

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        return pd.Series(test.value.might_hold(h.to_numpy(np.int64)))

    return rows.where(likely(key))
