"""Operator 6: packing by cutting-stock column generation.

Each document is cut into full sequences and a rest. Rests are counted in a histogram of at most ``capacity / grain``
lengths, whose size does not depend on the corpus. A linear program over patterns (how many rests of each length fill one sequence) is
solved on it by the revised simplex method; a knapsack dynamic program over the dual prices finds each new pattern. Solutions are rounded
down; what is left, at most a few rests for each pattern, is packed by best fit. Every rest has a rank among those of its length, and its
rank alone tells its pattern, copy and place, so documents are assigned without any group in one task.

Defined cases: a null text is empty and gives one piece with the end token alone; the string of an added token inside a text gives that token's id
(``keep_added``); rows that repeat an id are packed each; an empty table gives no piece; other columns are ignored. Sequences are filled from 0 without gaps; the rest is padding.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.bpe import groups
from shelfmark.llm.store import CACHES, begin, in_task, picked, written
from shelfmark.runtime import shipped

CAPACITY, GRAIN, END_ID = 2048, 8, 1
PIECE_SCHEMA = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, bin int, task int, nth long"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


#: Fixed value: how the byte-level pre-tokenizer of ``tokenizers`` splits a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alone(letters: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """What the merges make of one word."""
    while len(letters) > 1:
        best = min(range(len(letters) - 1), key=lambda i: ranks.get((letters[i], letters[i + 1]), len(ranks)))
        if (letters[best], letters[best + 1]) not in ranks:
            break
        letters[best : best + 2] = [letters[best] + letters[best + 1]]
    return letters


@lru_cache(maxsize=8)
def same_merges(path: str, pattern: str) -> bool:
    """Whether a vocabulary file is proven to give the ids of an engine that splits by ``pattern`` and merges by the ids of the results.

    The file must have no step but a byte-level split and merges, and these must make ids in order. Then both apply the same merges if every token comes
    out whole when its letters are merged alone: a pair that makes a token, but is not its own merge, would be left over there.
    """
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split, letters = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
    plain = not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and pattern == BYTE_LEVEL
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return False
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    ranks = {m: i for i, m in enumerate(pairs)}
    if order != sorted(set(order)) or not all(c in model["vocab"] for c in letters) or any(model["vocab"][c] >= order[0] for c in letters):
        return False
    return {*model["vocab"]} == {*letters, *(a + b for a, b in pairs)} and all(_alone(list(a + b), ranks) == [a + b] for a, b in pairs)


class VocabularyEncoder:
    """Ids of a vocabulary file of the ``tokenizers`` library, as its encode without adding special tokens gives them.

    With ``fast`` (see ``same_merges``) the same merges are run by the ``tiktoken`` engine; texts that hold the string of an added token go to the library.
    With ``keep_added`` off, strings of special tokens are ordinary letters.
    """

    def __init__(self, path: str, pattern: str, fast: bool, keep_added: bool = True):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not keep_added
        self.engine, self.added = None, []
        if fast:
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            letters = byte_letters()
            self.added = [t["content"] for t in spec.get("added_tokens") or [] if keep_added or not t.get("special")]
            self.engine = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}, special_tokens={})

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.engine is None:
            return self.library(texts)
        return [self.library([t])[0] if any(a in t for a in self.added) else self.engine.encode_to_numpy(t, disallowed_special=()) for t in texts]


@lru_cache(maxsize=2)
def vocabulary_encoder(path: str, pattern: str, fast: bool, keep_added: bool = True) -> VocabularyEncoder:
    """One a worker."""
    return VocabularyEncoder(path, pattern, fast, keep_added)


CACHES["packing"] = vocabulary_encoder.cache_clear


def cut(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int | None = END_ID, keep_added: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECE_SCHEMA: full pieces (bin 0) and rests (bin = length in grains, rounded up), numbered within task and bin."""
    fast = same_merges(vocabulary, pattern)

    def run(batches):
        from pyspark import TaskContext

        begin("packing")
        task, coder, counts = TaskContext.get().partitionId(), vocabulary_encoder(vocabulary, pattern, fast, keep_added), np.zeros(capacity // grain + 2, np.int64)
        for pdf in batches:
            doc_ids, done = pdf["doc_id"].tolist(), 0
            for texts in groups([t or "" for t in pdf["text"]], 1 << 20):
                rows = []
                for doc_id, ids in zip(doc_ids[done : done + len(texts)], coder.encode(texts), strict=True):
                    if end_id is not None:
                        ids = np.append(ids, end_id)
                    data = memoryview(ids.astype("<u4").tobytes())
                    for start in range(0, len(ids), capacity):
                        n = min(capacity, len(ids) - start)
                        b = 0 if n == capacity else -(-n // grain)
                        rows.append((doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(ids), b, task, int(counts[b])))
                        counts[b] += 1
                done += len(texts)
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "task", "nth"])
                frame["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in frame["doc_id"]], "Int64")
                yield frame

    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECE_SCHEMA)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of greatest worth: its worth and how often it takes each size."""
    worth, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        n = np.searchsorted(sizes, c, side="right")
        if n:
            value = worth[c - sizes[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > worth[c - 1] + 1e-12:
                worth[c], took[c] = value[k], k
                continue
        worth[c] = worth[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(worth[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots."""
    n = len(matrix)
    work = np.hstack([matrix.astype(np.float64), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def patterns_for(demand: dict[int, int], capacity: int, most_rounds: int = 4000, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """(how often each size, how many sequences) so that every size is met; sizes: sorted keys of ``demand``.

    Column generation until Farley's bound shows that no more than ``gap`` is left to gain.
    """
    sizes = np.array(sorted(demand), np.int64)
    need = np.array([demand[int(s)] for s in sizes], np.float64)
    m = len(sizes)
    if not m:
        return []
    columns = np.zeros((m, m), np.int64)
    np.fill_diagonal(columns, capacity // sizes)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ need
    least = float(need @ sizes) / capacity
    for turn in range(most_rounds):
        if turn % 200 == 199:
            inverse = inverted(columns)
            x = inverse @ need
        prices = inverse.sum(axis=0)
        worth, column_ = best_pattern(prices, sizes, capacity)
        least = max(least, float(prices @ need) / worth)
        if worth <= 1 + 1e-9 or float(x.sum()) <= least * (1 + gap):
            break
        d = inverse @ column_
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        step = ratio[out]
        x = x - step * d
        x[out] = step
        columns[:, out] = column_
    times = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    chosen = [(columns[:, j].copy(), int(times[j])) for j in range(m) if times[j]]
    left = np.maximum(need.astype(np.int64) - columns @ times, 0)
    # best fit over what rounding left, the longest first: the space left in a sequence tells where it fits best
    by_space: dict[int, list[np.ndarray]] = {}
    for k in range(m - 1, -1, -1):
        for _ in range(int(left[k])):
            space = next((s for s in range(int(sizes[k]), capacity + 1) if by_space.get(s)), None)
            row = by_space[space].pop() if space is not None else np.zeros(m, np.int64)
            row[k] += 1
            by_space.setdefault((capacity if space is None else space) - int(sizes[k]), []).append(row)
    return chosen + [(row, 1) for rows in by_space.values() for row in rows]


def packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int | None = END_ID, keep_added: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: each token in exactly one piece, sequences of at most ``capacity``."""
    shipped(docs.sparkSession)
    pieces = written(cut(docs, vocabulary, pattern, capacity, grain, end_id, keep_added), "pieces")
    per_task = pieces.groupBy("bin", "task").agg(F.count("*").alias("n"))
    before = written(per_task.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "ranks")
    histogram = {int(r["bin"]): int(r["n"]) for r in before.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most capacity / grain + 1 rows
    rests = {b: n for b, n in histogram.items() if b}
    sizes, base = sorted(rests), 0
    table: dict[int, list[tuple[int, int, int]]] = {b: [] for b in sizes}  # bin -> (first rank, copies, first sequence)
    filled = dict.fromkeys(sizes, 0)
    for counts, times in in_task(docs.sparkSession, lambda: patterns_for(rests, capacity // grain)):
        for k in np.flatnonzero(counts):
            b = sizes[k]
            table[b].append((filled[b], times, base))
            filled[b] += int(counts[k]) * times
        base += times
    arrays = {b: np.array(rows, np.int64).T for b, rows in table.items()}

    @F.pandas_udf("long")
    def sequence_of(bins: pd.Series, ranks: pd.Series) -> pd.Series:
        b, r = bins.to_numpy(np.int64), ranks.to_numpy(np.int64)
        out = base + r
        for one in np.unique(b[b > 0]):
            own = np.flatnonzero(b == one)
            first, copies, sequence = arrays[int(one)]
            at = np.searchsorted(first, r[own], side="right") - 1
            out[own] = sequence[at] + (r[own] - first[at]) % copies[at]
        return pd.Series(out)

    ranked = pieces.join(before.select("bin", "task", "before"), ["bin", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.withColumn("sequence_id", sequence_of("bin", "rank"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))
