"""Operator 7: byte-level BPE over length-bucketed padded numpy matrices.

Words (matches of the tokenizer's pattern) that a worker has not met are grouped by length into padded matrices
of token ids. In each round every row merges its leftmost pair of least rank, pairs are looked up in an open hash table, and the row is
compacted; rows without a pair leave the matrix. A word beyond the last bucket is a matrix row of its own length, in which the rounds that would merge
one pair after another are taken at once. Words met before come from a bounded cache. Decoding gathers token bytes.

Defined cases: a null text is empty and has no ids; texts and words of any length are encoded whole; rows that repeat an id are encoded
each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.store import CACHES, begin, picked
from shelfmark.runtime import shipped

BUCKETS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, 512, 4096)
CACHE_WORDS, MATRIX_CELLS = 500_000, 1 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(left) * 3).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = self._key(left, right)
        todo, at, self.probes = np.arange(len(key)), self._home(key), 0
        while len(todo):
            free = self.keys[at[todo]] == -1
            put = todo[free]
            self.keys[at[put]] = key[put]
            won = self.keys[at[todo]] == key[todo]
            done = todo[won]
            self.values[at[done]] = merged[done]
            todo = todo[~won]
            at[todo] = at[todo] + 1 & self.mask
            self.probes += 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair does not merge or a side is padding (negative)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = self._key(left[todo], right[todo])
        at = self._home(key)
        while len(todo):
            seen = self.keys[at]
            hit = seen == key
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (seen != -1)
            todo, key, at = todo[go], key[go], at[go] + 1 & self.mask
        return out.reshape(shape)


class Encoder:
    """Ranks are ids: the token of rank r has id r."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words_in = ranks, regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.piece = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.piece[rank] = token
        self.piece_size = np.array([len(p) for p in self.piece], np.int64)
        self.piece_begin = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.piece), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.flat_n = np.empty(1 << 20, np.int32), 0
        self.begin, self.size = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def merged_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string (one word each, none empty)."""
        out: list[np.ndarray | None] = [None] * len(rows)
        sizes = np.array([len(r) for r in rows], np.int64)
        low = 0
        for high in BUCKETS:
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            step = max(1, MATRIX_CELLS // high)
            for i in range(0, len(own), step):
                self._matrix(rows, own[i : i + step], sizes, high, out)
            low = high
        for i in np.flatnonzero(sizes > low):
            out[i] = self._row(rows[i])
        return out  # type: ignore[return-value]

    def _matrix(self, rows: list[bytes], own: np.ndarray, sizes: np.ndarray, width: int, out: list) -> None:
        data = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
        ids = np.where(np.arange(width) < sizes[own][:, None], self.single[data], np.int32(-1))
        length, who = sizes[own].copy(), own
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(own), 0), NONE)
        while len(who):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(who), np.int64)
            best = rank[np.arange(len(who)), at] if rank.shape[1] else np.full(len(who), NONE)
            ended = best == NONE
            if ended.any():
                for i in np.flatnonzero(ended):
                    out[who[i]] = ids[i, : length[i]].copy()
                go = ~ended
                ids, rank, length, who, at, best = ids[go], rank[go], length[go], who[go], at[go], best[go]
                if not len(who):
                    return
            n = np.arange(len(who))
            ids[n, at] = best
            if ids.shape[1] > 2:
                moved = np.arange(ids.shape[1] - 1)
                ids = np.concatenate([np.take_along_axis(ids, moved + (moved > at[:, None]), 1), np.full((len(who), 1), -1, np.int32)], axis=1)
                moved = np.arange(rank.shape[1] - 1)
                rank = np.concatenate([np.take_along_axis(rank, moved + (moved >= at[:, None]), 1), np.full((len(who), 1), NONE, np.int32)], axis=1)
            else:
                ids[:, 1] = -1
                rank[:] = NONE
            length = length - 1
            left = np.maximum(at - 1, 0)
            rank[n, left] = np.where(at > 0, self.pairs.find(ids[n, left], ids[n, at]), rank[n, left])
            right = np.minimum(at + 1, ids.shape[1] - 1)
            rank[n, np.minimum(at, rank.shape[1] - 1)] = np.where(at + 1 < length, self.pairs.find(ids[n, at], ids[n, right]), NONE)
            keep = int(length.max())
            if keep + 4 < ids.shape[1]:
                ids, rank = ids[:, : keep + 1], rank[:, :keep]

    def _row(self, word: bytes) -> np.ndarray:
        """One long row: all places of its least pair, from the left and not overlapping, unless a merge makes a pair of lower rank."""
        ids = self.single[np.frombuffer(word, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            run = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(at) != 1) + 1])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]
            done = self._merge(ids, rank, at, best)
            if done[1].size and done[1].min() < best:
                done = self._merge(ids, rank, at[:1], best)
            ids, rank = done
        return ids

    def _merge(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
        """A row and its ranks after the pairs that begin at ``at`` became ``token``."""
        ids = ids.copy()
        ids[at] = token
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))
        ids, rank = ids[keep], np.append(rank, NONE)[keep][:-1]
        for side in (new - 1, new):
            side = side[(side >= 0) & (side < len(rank))]
            rank[side] = self.pairs.find(ids[side], ids[side + 1])
        return ids, rank

    def _learn(self, new: list[str]) -> None:
        rows, whole = [w.encode("utf-8", "surrogatepass") for w in new], self.ranks.get
        known = [whole(r) for r in rows]
        rest = [i for i, k in enumerate(known) if k is None]
        merged = dict(zip(rest, self.merged_rows([rows[i] for i in rest]), strict=True))
        ids = [merged[i] if k is None else (k,) for i, k in enumerate(known)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(self.known)
        while self.flat_n + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(new) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.empty_like(self.begin)]), np.concatenate([self.size, np.empty_like(self.size)])
        if total:
            self.flat[self.flat_n : self.flat_n + total] = np.concatenate(ids)
        self.begin[n : n + len(new)] = self.flat_n + np.cumsum(sizes) - sizes
        self.size[n : n + len(new)] = sizes
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        self.flat_n += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text (int32)."""
        split = [self.words_in(t) for t in texts]
        flat_words = [w for words in split for w in words]
        if len(self.known) > CACHE_WORDS:
            self._forget()
        new = list(set(flat_words).difference(self.known))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat_words), np.int64, len(flat_words))
        ids, ends = gathered(self.flat, self.begin[at], self.size[at])
        edges = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        at = ids.astype(np.int64)
        return gathered(self.piece_bytes, self.piece_begin[at], self.piece_size[at])[0].tobytes()


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[begin : begin + size] one after another, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - size), size) + np.arange(total)], ends


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file (base64 token and rank a line); one a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return Encoder(ranks, pattern)


CACHES["bpe"] = encoder.cache_clear


def groups(items: list, size: int):
    """Lists of items whose lengths add up to about ``size``."""
    part, n = [], 0
    for x in items:
        part.append(x)
        n += len(x)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes that they decode to; with_ids adds ``ids array<int>``."""

    def run(batches):
        begin("bpe")
        coder = encoder(vocabulary, pattern)
        for pdf in batches:
            doc_ids, at = pdf["doc_id"].tolist(), 0
            for texts in groups([t or "" for t in pdf["text"]], 1 << 20):
                all_ids = coder.encode(texts)
                frame = {
                    "doc_id": pd.array([None if pd.isna(d) else int(d) for d in doc_ids[at : at + len(texts)]], "Int64"), "n_tokens": [len(i) for i in all_ids],
                    "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in all_ids], "decoded_sha256": [hashlib.sha256(coder.decode(i)).hexdigest() for i in all_ids],
                }
                if with_ids:
                    frame["ids"] = list(all_ids)
                yield pd.DataFrame(frame)
                at += len(texts)

    shipped(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, ENCODED_SCHEMA + (", ids array<int>" if with_ids else ""))
