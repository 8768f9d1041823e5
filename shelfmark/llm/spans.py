"""Operator 5: removal of sentences that repeated runs cover.

A text is cut into sentences after ``. ! ?`` before white space and at line ends. Every run of ``sentences`` consecutive sentences is hashed, and the
hashes are joined over the whole corpus. The first place of a run is the first one in the document with the smallest doc_id (and of several
texts under one id, that with the smallest text hash); the sentences under any other place are removed. Runs have no least number of words unless
``min_words`` asks for one, so that short lines which many documents share, as licences or headings, can be left alone.

That finds no passage that begins and ends inside of sentences, as in texts without punctuation. With ``max_words`` a sentence of that many words or more
is cut, before the word with the least hash (the last of equal ones) of each window of ``max_words // 2`` words, so that a passage is cut alike
wherever it begins, and the shortest runs of two pieces or more with at least ``passage_words`` words, one from each piece and one to each, are
hashed as well. With 16 and 20 any passage of over 50 words holds a run, whatever its words. What is left of a sentence then stays.

Runs are told apart by 96 bits, 64 of which are counted. Repeats inside a document are found where it is read. Across documents hashes alone are counted first, by partial
aggregation; then a Bloom filter of the repeated hashes tells which places are joined. Hot runs are spread by adaptive skew splits; nothing is dropped.

Defined cases: a null text stays null; an empty text or one of fewer sentences than a run stays as it is; rows that repeat an id
and its text count as one document, and keep what they only share with each other; different texts under one id, or without an id, are
documents of their own; a null id comes before all others; an empty table gives no row; other columns pass through unchanged, whatever their names, and the new
column is called removed_runs_1 and so on where a column has its name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bloom
from shelfmark.llm.store import CACHES, begin, dropped, free_name, freed, give_back, written
from shelfmark.llm.words import CACHE_WORDS, mixed
from shelfmark.runtime import shipped

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1342543DE82EF95)
_INVERSE, _OTHER_INVERSE = (np.uint64(pow(int(b), -1, 1 << 64)) for b in (_BASE, _OTHER))
_WORD = re.compile(r"\S+")
_ENDS = (".", "!", "?")


class SentenceWords(dict):
    """Word -> unsigned 64-bit hash whose lowest bit tells whether the word ends a sentence. Emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word[-1] in _ENDS)
        return value


_words = SentenceWords()


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


#: Parameters for passages of over 50 words anywhere in a text; shorter lines that documents share stay.
PASSAGES = {"min_words": 20, "max_words": 16, "passage_words": 20}
RUN_SCHEMA = "h long, g int, doc long, rid long, at int, sentences int, again boolean"
NO_ID = -(2**63)
RUN_BASE = 1 << 31
PLACE = np.uint64(2**32 - 1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The places of the least hash of every window of so many words, the last one of equals."""
    if len(h) < width:
        return np.empty(0, np.int64)
    key = h & ~PLACE | PLACE - np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return np.unique(PLACE - (key & PLACE)).astype(np.int64)


def _begins(h: np.ndarray, line_starts: list[int], max_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each piece, and at the end the number of words; and which of them begin a sentence."""
    n = len(h)
    first = np.zeros(n + 1, bool)
    first[1:] = (h & np.uint64(1)).astype(bool)
    first[line_starts] = True
    first[0] = first[n] = True
    at = np.flatnonzero(first)
    if max_words is None:
        return at, np.arange(len(at))
    long = np.flatnonzero(np.diff(at) >= max_words)
    if len(long):
        marked = _least(h, max(1, max_words // 2))
        inside = np.isin(np.searchsorted(at, marked, side="right") - 1, long)
        first[marked[inside]] = True
        pieces = np.flatnonzero(first)
        return pieces, np.searchsorted(pieces, at)
    return at, np.arange(len(at))


def _runs(begins: np.ndarray, whole: np.ndarray, sentences: int, min_words: int, passage_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last piece of every run, in order and each once. ``whole``: the pieces that begin a sentence."""
    n = len(begins) - 1
    both = []
    if passage_words is None or min_words < passage_words:  # else the shortest runs within such a run cover all of its sentences
        long = begins[whole[sentences:]] - begins[whole[:-sentences]] >= min_words
        both = [whole[:-sentences][long] * (n + 1) + whole[sentences:][long]]
    if passage_words is not None:
        at = np.arange(n + 1)
        last = np.maximum(at[:-1] + 2, np.searchsorted(begins, begins[:-1] + passage_words, side="left"))
        first = np.minimum(at[1:] - 2, np.searchsorted(begins, begins[1:] - passage_words, side="right") - 1)
        after, before = last <= n, first >= 0
        both += [at[:-1][after] * (n + 1) + last[after], first[before] * (n + 1) + at[1:][before]]
    return np.divmod(np.unique(np.concatenate(both)), n + 1)


_known: dict[int, np.ndarray] = {}


CACHES["spans"] = lambda: (_words.clear(), _known.clear())


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    """The first powers of an odd base modulo 2^64, n at least."""
    if (have := _known.get(int(base))) is None or len(have) <= n:
        have = _known[int(base)] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(2 * n, 1 << 15), base, np.uint64))])
    return have


def text_runs(text: str | None, sentences: int, min_words: int = 0, max_words: int | None = None, passage_words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of a text (64 bits and 32 more), with their first and one past their last piece."""
    words: list[str] = []
    starts: list[int] = []
    for line in (text or "").splitlines():
        starts.append(len(words))
        words += line.split()
    starts = [s for s in starts if s < len(words)]
    if not words:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64))
    hashes = _hashed(words)
    begins, whole = _begins(hashes, starts, max_words)
    first, last = _runs(begins, whole, sentences, min_words, passage_words if max_words is not None else None)
    # a sum of h[i] * base^i over the run, times base^-place: the same wherever the run stands
    a, b = begins[first], begins[last]
    names = []
    for own, base, inverse in ((hashes, _BASE, _INVERSE), (hashes ^ (hashes >> np.uint64(29)), _OTHER, _OTHER_INVERSE)):
        power, back = _powers_of(base, len(words) + 1), _powers_of(inverse, len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(own * power[: len(words)], out=total[1:])
        names.append(mixed((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)))
    return names[0].view(np.int64), (names[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), first, last


def _covered(runs) -> set[int]:
    return {s for r in runs for s in range(r // RUN_BASE, r // RUN_BASE + r % RUN_BASE)}


def without(text: str, gone: set[int], max_words: int | None = None) -> str:
    """The text without the pieces numbered in ``gone``; each takes the white space after it along."""
    spans, words, starts, at = [], [], [], 0
    for line in text.splitlines(keepends=True):
        starts.append(len(words))
        for m in _WORD.finditer(line):
            words.append(m[0])
            spans.append(at + m.start())
        at += len(line)
    starts = [s for s in starts if s < len(words)]
    begins, _ = _begins(_hashed(words), starts, max_words)
    edges = [spans[i] if i < len(spans) else len(text) for i in begins.tolist()]
    keep, out = 0, []
    for s in sorted(gone):
        if s >= len(edges) - 1:
            continue
        out.append(text[keep : edges[s]])
        keep = edges[s + 1]
    out.append(text[keep:])
    return "".join(out)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3, min_words: int = 0, max_words: int | None = None, passage_words: int = 20) -> DataFrame:
    """All rows and columns of ``docs``; the text without repeated sentences, and a column ``removed_runs`` (how many later places of runs it held)."""
    spark = shipped(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, text_name = docs.toDF(*names), names[docs.columns.index(text_col)]
    key = F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit(NO_ID))
    text = F.col(text_name).cast("string")
    rows = plain.select(key.alias("doc"), F.xxhash64(text).alias("rid"), text.alias("text"))

    def runs(batches):
        begin("spans")
        for pdf in (whole.iloc[i : i + 1000] for whole in batches for i in range(0, len(whole), 1000)):
            parts = []
            for i, t in enumerate(pdf["text"]):
                h, g, first, last = text_runs(t, sentences, min_words, max_words, passage_words)
                if len(h):
                    again = np.ones(len(h), bool)
                    again[np.unique(h, return_index=True)[1]] = False  # the first place of each run in this text
                    parts.append((i, h, g, first, last - first, again))
            if parts:
                at = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                h, g, first, length, again = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4, 5))
                yield pd.DataFrame({"h": h, "g": g, "doc": pdf["doc"].to_numpy()[at], "rid": pdf["rid"].to_numpy()[at], "at": first.astype(np.int32), "sentences": length.astype(np.int32), "again": again})
        give_back()

    places = written(rows.mapInPandas(runs, RUN_SCHEMA), "runs")
    once = places.where("not again")
    repeated = written(once.select("h").groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "repeated")
    freed(spark)
    shared = written(bloom.thinned(once.select("h", "g", "doc", "rid", "at", "sentences"), F.col("h"), repeated), "shared")
    place = F.struct("doc", "rid")
    first = written(shared.groupBy("h", "g").agg(F.min(place).alias("first")), "first")  # the join alone can be split where a run is in many places
    freed(spark)
    later = shared.join(first, ["h", "g"]).where(place != F.col("first")).select("doc", "rid", "at", "sentences")
    later = later.unionByName(places.where("again").select("doc", "rid", "at", "sentences"))
    # a run is one number, place times RUN_BASE plus length; they are spread to sentences where the text is cut
    run = F.col("at").cast("long") * RUN_BASE + F.col("sentences")
    found = written(later.groupBy("doc", "rid").agg(F.collect_set(run).alias("gone")), "found")
    for table in (places, repeated, shared, first):
        dropped(table)
    freed(spark)

    @F.pandas_udf("string")
    def cut(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([x if y is None else without(x, _covered(y), max_words) for x, y in zip(t, g, strict=True)], dtype=object)

    joined = plain.withColumn("doc", key).withColumn("rid", F.xxhash64(text)).join(found, ["doc", "rid"], "left")
    new = F.when(F.col("gone").isNull(), text).otherwise(cut(F.coalesce(text, F.lit("")), F.col("gone")))
    out = joined.select(*[new.alias(c) if c == text_name else F.col(c) for c in names], F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
    return out.toDF(*docs.columns, free_name(docs, "removed_runs"))
