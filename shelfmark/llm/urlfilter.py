"""Operator 3: URL rules tested through a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 takes for listed though they
are not, level 3 the listed keys that level 2 takes for false positives, and so on until nothing is left. Since
every key that a page can ask for is in the universe the cascade was built over, its answers are exact and no join is needed.

Keys are host suffix + path prefix. A url asks for one key for each suffix of its host and each path length
that a rule has. The longest listed key wins (host plus path; the longer host if equal).

Defined cases: a url that is null or has no ``://`` has an empty host and path; a url that no rule
fits is allowed, as its keys are not listed; rows keep their number, equal ones and null ids too; repeated and clashing rules: the last one counts; an
empty table or no rule is no special case; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bloom
from shelfmark.llm.store import picked, written
from shelfmark.runtime import shipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to / ? # or the end, A-Z lower-cased; then up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule for this host and path can have, the likeliest to win first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per = lambda s: F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length(path) >= n), lambda n: F.struct((-F.length(s) - n).alias("worth"), (-F.length(s)).alias("host_worth"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))
    return F.transform(F.array_sort(F.flatten(F.transform(suffixes, per))), lambda x: x["key"])


def key_hash(key: Column, level: int) -> Column:
    return F.xxhash64(key, F.lit(level))


@dataclass
class Cascade:
    """Levels by part of the key space; a key's part is its hash modulo the number of parts."""

    parts: list[list[bloom.Bloom]]

    @property
    def deep(self) -> int:
        return max([0, *map(len, self.parts)])

    def listed(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Per key of the universe, whether it is listed; hashes: one array a level, and at the end one that deals keys to parts."""
        out = np.zeros(len(hashes[-1]), bool)
        part = (hashes[-1].view(np.uint64) % np.uint64(max(1, len(self.parts)))).astype(np.int64)
        for p, levels in enumerate(self.parts):
            own = np.flatnonzero(part == p)
            passed = own
            for i, level in enumerate(levels):
                now = level.might_hold(hashes[i][passed])
                out[passed[~now]] = i % 2 == 1
                passed = passed[now]
            out[passed] = len(levels) % 2 == 1
        return out


PART_LEVEL = -1


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 8) -> Cascade:
    """A cascade for the keys in ``listed`` over ``universe`` (both: column key, distinct). Both sides stay distributed; only filters reach the driver.

    A list that would fill a filter of MAX_BITS is dealt to parts by hash, each with a cascade of its own, so that no list is too long; all filters
    together have some two bytes a key.
    """
    parts = -(-listed.count() * bits_per_key // bloom.MAX_BITS)
    if parts <= 1:
        return Cascade([_levels(listed.select("key"), universe.select("key"), bits_per_key)] * parts)
    dealt = lambda df, p: df.where(F.expr(f"cast(conv(hex(xxhash64(key, {PART_LEVEL})), 16, 10) as decimal(20)) % {parts} = {p}")).select("key")
    return Cascade([_levels(dealt(listed, p), dealt(universe, p), bits_per_key) for p in range(parts)])


def _levels(inside: DataFrame, universe: DataFrame, bits_per_key: int) -> list[bloom.Bloom]:
    """Filters in turn for keys inside, and for those outside that the filter before takes for them, until none is left."""
    levels: list[bloom.Bloom] = []
    outside = universe.join(inside, "key", "left_anti")
    while n := inside.count():
        i = len(levels)
        levels.append(bloom.build(inside, key_hash(F.col("key"), i), n, bits_per_key))
        passing = _passing(outside, levels[i], i)
        if i == 0:
            passing = written(passing, "cascade")  # few are left: later levels scan only these
        inside, outside = passing, inside
    return levels


def _passing(keys: DataFrame, level: bloom.Bloom, i: int) -> DataFrame:
    test = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(h):
        import pandas as pd

        return pd.Series(test.value.might_hold(h.to_numpy(np.int64)))

    return keys.where(passes(key_hash(F.col("key"), i)))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id", bits_per_key: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict by ``rules`` (verdict, host, path)."""
    spark = shipped(pages.sparkSession)
    verdicts = {host.translate(str.maketrans(UPPER, LOWER)) + path: verdict for verdict, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = host_and_path(F.col("url").cast("string"))
    rows = picked(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keyed = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    cascades = {}
    for verdict in ("allow", "block"):
        own = [(k,) for k, v in verdicts.items() if v == verdict]
        listed = spark.createDataFrame(own, "key string")
        cascades[verdict] = build_cascade(listed, universe, bits_per_key)
    deep = max(c.deep for c in cascades.values())
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("rule string, verdict string")
    def verdict_of(keys, hashes):
        import pandas as pd

        sizes = np.fromiter((0 if k is None else len(k) for k in keys), np.int64, len(keys))
        flat = np.concatenate([*[k for k in keys if k is not None], np.empty(0, object)])
        stacked = np.concatenate([*[np.stack([np.asarray(x, np.int64) for x in h]) for h in hashes if h is not None and len(h)], np.empty((0, deep + 1), np.int64)])
        by = [np.ascontiguousarray(stacked[:, i]) for i in range(deep + 1)]
        allow, block = shared.value["allow"].listed(by), shared.value["block"].listed(by)
        hit = np.flatnonzero(allow | block)
        row = np.repeat(np.arange(len(keys)), sizes)[hit]
        rule, verdict = np.full(len(keys), None, object), np.full(len(keys), "allow", object)
        first = np.unique(row, return_index=True)
        rule[first[0]] = flat[hit[first[1]]]
        verdict[first[0]] = np.where(block[hit[first[1]]], "block", "allow")
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    hashes = F.transform("keys", lambda k: F.array(*[key_hash(k, i) for i in [*range(deep), PART_LEVEL]]))
    return keyed.withColumn("v", verdict_of(F.col("keys"), hashes)).select("page_id", "host", "path", "v.rule", "v.verdict")


