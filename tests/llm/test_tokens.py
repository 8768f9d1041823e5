import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = ["", " ", "hello world", "it's  we'll\n\n x\t", "a" * 300, "日本語のテキスト 😀👍🏽", "<|endoftext|> not special", "x² ½ y", "\x00\x1c\x85", "Thlyouble | inesea!! ***", "é" * 5000, "ab" * 3000, "a b" * 4000]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder(reference):
    coder = bpe.encoder(RANKS, P.PATTERN)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abcdefghijklmnop éßñ'.,!\n 0123", k=rng.randrange(400))) for _ in range(200)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_long_words_are_rows_of_their_own(reference):
    coder = bpe.encoder(RANKS, P.PATTERN)
    rng = random.Random(2)
    words = ["a" * 5000, "a" * 5001, "".join(rng.choices("abcde", k=6000)), "".join(rng.choices("th", k=9000)), "".join(rng.choices("thequickbrown", k=60000)), "é" * 4097]
    for word in words:
        assert coder._row(word.encode()).tolist() == reference.encode_ordinary(word)
    assert [x.tolist() for x in coder.encode(words)] == [reference.encode_ordinary(w) for w in words]
    for word in ["a", "ab", "hello", "ing", "zqzq", "aaa"]:
        assert coder._row(word.encode()).tolist() == reference.encode_ordinary(word)


def plain_merges(word, ranks):
    """Byte pair encoding written out: the leftmost pair of least rank, again and again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_rows_where_a_merge_makes_a_lower_rank():
    """Ranks that no training gives: merging the second pair makes a pair that goes first."""
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 90, b"abc": 5, b"ca": 50, b"abca": 4, b"aa": 60, b"aaa": 7, b"aaaa": 8}
    rng = random.Random(3)
    coder = bpe.Encoder(ranks, P.PATTERN)
    for _ in range(300):
        word = bytes(rng.choices(b"abcaa", k=rng.randrange(1, 40)))
        assert coder._row(word).tolist() == plain_merges(word, ranks)
        assert coder.merged_rows([word])[0].tolist() == plain_merges(word, ranks)


def test_pair_table():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 900, 4000), rng.integers(0, 900, 4000)
    keys = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(left, right, strict=True))}
    own = np.array(list(keys), np.int64)
    table = bpe.PairTable(own[:, 0], own[:, 1], np.arange(len(own), dtype=np.int32))
    assert table.find(own[:, 0], own[:, 1]).tolist() == list(range(len(own)))
    assert (table.find(np.array([901, -1]), np.array([1, 1])) == bpe.NONE).all()


def test_encoded_table(spark, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "x"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encoded(docs, RANKS, P.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "x" if r["doc_id"] is None else dict(rows)[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encoded(docs.where("false"), RANKS, P.PATTERN).count() == 0


ADDED = ["<|endoftext|>", "<|endoftext|> x", "a <|endoftext|> b", "tail<|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endoftext|", "x<|endoftext|>" * 300]


def test_vocabulary_encoder_is_the_library():
    library = Tokenizer.from_file(JSON)
    assert packing.same_merges(JSON, P.PATTERN) and not packing.same_merges(JSON, P.PATTERN + "|x") and not packing.same_merges(P.path("word_bpe_49k.json"), P.PATTERN)
    coder = packing.vocabulary_encoder(JSON, P.PATTERN, True)
    assert coder.engine is not None
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choices("abcdefgh é.,\n'tsd 019ßñ", k=rng.randrange(300))) for _ in range(400)] + ADDED
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.encode(["<|endoftext|> x"])[0].tolist() == [50256, 2124]
    slow = packing.vocabulary_encoder(JSON, P.PATTERN, False)
    assert slow.engine is None and [x.tolist() for x in slow.encode(texts)] == [x.tolist() for x in coder.encode(texts)]
    library.encode_special_tokens = True
    assert [x.tolist() for x in packing.vocabulary_encoder(JSON, P.PATTERN, True, False).encode(ADDED)] == [library.encode(t, add_special_tokens=False).ids for t in ADDED]


def test_every_code_point_is_split_alike():
    """The engine and the library know the same letters, numbers and spaces."""
    library, coder = Tokenizer.from_file(JSON), packing.vocabulary_encoder(JSON, P.PATTERN, True)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 !{c}?{c}{c}" for c in points[i : i + 3000]) for i in range(0, len(points), 3000)]
    for begin in range(0, len(texts), 20):
        part = texts[begin : begin + 20]
        assert all(np.array_equal(x, np.array(e.ids, np.uint32)) for x, e in zip(coder.encode(part), library.encode_batch_fast(part, add_special_tokens=False), strict=True))


def test_packing(spark):
    library = Tokenizer.from_file(JSON)
    rng = random.Random(4)
    texts = ["".join(rng.choices(["the ", "cat ", "zq", "\n", "é"], k=int(rng.expovariate(1 / 600)))) for _ in range(400)] + ["the " * 9000, "", None, "same text"] + ["same text"] * 50 + ADDED
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit("clash")).repartition(5)
    got = packing.packed(docs, JSON, P.PATTERN).toPandas()
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own, at = got[got.doc_id == i].sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= 2048
    sequences = got.sequence_id.nunique()
    assert got.length.sum() / (2048 * sequences) > 0.95
    assert packing.packed(docs.where("false"), JSON, P.PATTERN).count() == 0


def test_patterns_meet_demand_near_the_bound():
    rng = np.random.default_rng(5)
    demand = {int(s): int(n) for s, n in zip(range(1, 257), rng.poisson(3000 * np.exp(-np.arange(256) / 50)), strict=True) if n}
    found = packing.patterns_for(demand, 256)
    sizes = np.array(sorted(demand))
    made = sum(counts * times for counts, times in found)
    assert (made >= np.array([demand[s] for s in sizes])).all()
    assert all(counts @ sizes <= 256 for counts, _ in found)
    assert sum(t for _, t in found) <= 1.01 * sum(s * n for s, n in demand.items()) / 256 + 2
    assert packing.patterns_for({}, 256) == []


def test_knapsack():
    worth, counts = packing.best_pattern(np.array([0.3, 0.5]), np.array([3, 5]), 11)
    assert counts.tolist() == [2, 1] and abs(worth - 1.1) < 1e-9
