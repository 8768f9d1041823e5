import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import bloom, graph, ngram_join, spans


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + "."


def plain_pieces(text, max_words=None):
    """(place of the first character, words, whether a sentence begins) of each piece, written without the module's helpers."""
    found = [(m.start(), m[0]) for m in re.finditer(r"\S+", text or "")]
    begins = {0: True}
    for i in range(1, len(found)):
        end = found[i - 1][0] + len(found[i - 1][1])
        if found[i - 1][1][-1] in ".!?" or len((text[end : found[i][0]] + "x").splitlines()) > 1:
            begins[i] = True
    if max_words:
        edges = [*sorted(begins), len(found)]
        width = max_words // 2
        value = [xxhash.xxh64_intdigest(w.encode()) >> 32 for _, w in found]
        marks = {max(range(i, i + width), key=lambda k: (-value[k], k)) for i in range(len(found) - width + 1)}
        for a, b in zip(edges, edges[1:]):
            for m in marks if b - a >= max_words else ():
                if a < m < b:
                    begins[m] = False
    edges = [*sorted(begins), len(found)]
    return [(found[a][0], tuple(w for _, w in found[a:b]), begins[a]) for a, b in zip(edges, edges[1:]) if a < b]


def plain_runs(pieces, sentences=3, min_words=0, max_words=None, passage_words=20):
    """(first, past the last) of every run."""
    n, out = len(pieces), set()
    whole = [i for i, p in enumerate(pieces) if p[2]] + [n]
    total = [0, *itertools.accumulate(len(p[1]) for p in pieces)]
    size = lambda a, b: total[b] - total[a]
    out |= {(whole[i], whole[i + sentences]) for i in range(len(whole) - sentences) if size(whole[i], whole[i + sentences]) >= min_words}
    for i in range(n if max_words else 0):
        out |= {(i, j) for j in itertools.islice((j for j in range(i + 2, n + 1) if size(i, j) >= passage_words), 1)}
        out |= {(j, i + 1) for j in itertools.islice((j for j in range(i - 1, -1, -1) if size(j, i + 1) >= passage_words), 1)}
    return out


def brute_spans(rows, max_words=None, min_words=0, **more):
    """Places by document in order of id; every later place of a run goes."""
    first, gone, cut = {}, {}, {d: plain_pieces(t, max_words) for d, t in rows}
    for doc, _ in sorted(rows, key=lambda r: r[0]):
        local = set()
        for a, b in sorted(plain_runs(cut[doc], min_words=min_words, max_words=max_words, **more)):
            key = tuple(w for p in cut[doc][a:b] for w in p[1])
            if first.setdefault(key, doc) != doc or key in local:
                gone.setdefault(doc, set()).update(range(a, b))
            local.add(key)
    out = {}
    for doc, text in rows:
        at = [p[0] for p in cut[doc]] + [len(text or "")]
        out[doc] = "".join([text[: at[0]], *[text[at[i] : at[i + 1]] for i in range(len(cut[doc])) if i not in gone[doc]]]) if doc in gone else text
    return out


@pytest.mark.parametrize("max_words,min_words", [(None, 0), (16, 0), (16, 20)])
def test_spans_against_brute_force(spark, max_words, min_words):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, k) for k in (9, 12, 30, 8))
    long_sentence, short = sentence(rng, 70), "Five words are in here. So few. And five in here too."
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        if i % 7 == 0:
            parts.insert(0, "lead in words " + long_sentence)
        if i % 5 == 0:
            parts.insert(rng.randrange(len(parts) + 1), short)
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "short."), (104, "Und " * 3000), (105, "Und " * 3000), (106, passage * 3), (107, f" \n{short}\n\n"), (108, f"{short} {short}")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, gone string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["gone"], r["removed_runs"]) for r in spans.deduplicated(docs, min_words=min_words, max_words=max_words).collect()}
    want = brute_spans(rows, max_words, min_words)
    assert {d: t[0] for d, t in got.items()} == want and {t[1] for t in got.values()} == {"c"}
    kept = [d for d, t in rows if t and passage in t and passage in got[d][0]]
    assert kept == [0] and ([d for d, t in rows if t and short in t and short in got[d][0]] == [0]) == (not min_words)
    assert got[103][2] == 0 and got[100][0] is None and (got[105][0] == "") == bool(max_words)
    assert max_words or "lead in words" not in got[7][0] or long_sentence in got[7][0]
    assert spans.deduplicated(docs.where("false")).count() == 0


def test_sentences_are_whole_by_default(spark):
    """Without cutting, nothing but whole sentences goes."""
    rng = random.Random(14)
    passage = " ".join(words(rng, 60))
    rows = [(i, f"{sentence(rng, 9)} lead {i} {passage} tail {i}. {sentence(rng, 5)}") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)
    got = {r["doc_id"]: r["text"] for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), **spans.PASSAGES).collect()}
    assert got[0] == rows[0][1] and all(len(got[i].split()) < len(rows[i][1].split()) - 40 and f"lead {i}" in got[i] for i in (1, 2))


def test_repeated_rows_stay_alike(spark):
    rng = random.Random(6)
    text = " ".join(sentence(rng, 12) for _ in range(5))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["removed_runs"] > 0) for r in spans.deduplicated(docs).collect()))
    assert got == [(0, False), (1, True), (1, True), (2, True)]


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    for ids in ([7] * 6, [None] * 6, [None, None, 3, 3, 4, 4]):
        rows = [(i, f"{sentence(rng, 25)} {passage} {sentence(rng, 25)}") for i in ids]
        got = spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        kept = [r["doc_id"] for r in got if passage in r["text"]]
        assert kept == [ids[0]] and sum(r["removed_runs"] > 0 for r in got) == 5
        assert all(passage[:20] not in r["text"] for r in got if r["removed_runs"])


def test_closing_sentences_of_a_passage_go(spark):
    rng = random.Random(9)
    for lengths in ((15, 15, 3), (3, 15, 15), (12, 9, 14, 1, 2)):
        passage = " ".join(sentence(rng, n) for n in lengths)
        rows = [(i, f"{sentence(rng, 9)} {passage} {sentence(rng, 9)}") for i in range(4)]
        got = {r["doc_id"]: r["text"] for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), **spans.PASSAGES).collect()}
        assert got == {i: t if i == 0 else t.replace(f"{passage} ", "") for i, t in rows}


def words(rng, n, kinds=0):
    few = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(kinds)]
    return [rng.choice(few) if few else "".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def marked(rng, n, ends):
    """So many words, sentences ending now and then or at given numbers of words."""
    out = words(rng, n)
    for i in ends if isinstance(ends, list) else [i for i in range(n) if rng.random() < ends]:
        out[i] += "."
    return out


def shared_words(passage, rng):
    """Which words of a passage lie in a run that two hosts share, the passage standing mid-sentence in both; by the windows of words."""
    texts = [[*words(rng, rng.randrange(1, 40)), *passage, *words(rng, rng.randrange(1, 40))] for _ in range(2)]
    starts = [next(i for i in range(len(t)) if t[i : i + len(passage)] == passage) for t in texts]
    found = []
    for t in texts:
        h, _, a, b = spans.text_runs(" ".join(t), 3, **spans.PASSAGES)
        begins, _ = spans._begins(spans._hashed(t), [0], 16)
        found.append({(k, tuple(t[x:y])): (x, y) for k, x, y in zip(h.tolist(), begins[a].tolist(), begins[b].tolist(), strict=True)})
    assert {k for k, _ in found[0]} & {k for k, _ in found[1]} == {k for k, _ in found[0].keys() & found[1].keys()}
    got = set()
    for k in found[0].keys() & found[1].keys():
        x, y = found[0][k]
        got |= set(range(x - starts[0], y - starts[0]))
    return got & set(range(len(passage)))


def test_passages_over_50_words_always_hold_a_run():
    rng = random.Random(11)
    passages = [words(rng, 51) for _ in range(600)] + [words(rng, 51, k) for k in (1, 2, 3) for _ in range(40)] + [["tim"] * 120]
    passages += [marked(rng, 51, p) for p in (0.03, 0.07, 0.15, 0.3) for _ in range(150)] + [marked(rng, 51, [15, 34]) for _ in range(50)]
    assert [p for p in passages if not shared_words(p, rng)] == []


def plain_shingles(text, width):
    """Written without the module's helpers."""
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute_join(rows, width, part, whole):
    sets = {d: plain_shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("width,part,whole", [(4, 85, 100), (5, 80, 100)])
def test_join_against_brute_force(spark, width, part, whole):
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(400)]
    bases = [rng.choices(vocabulary, k=n) for n in (1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 30, 45, 60, 90, 140, 300, 900)]
    rows = []
    for base in bases:
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [words[at], rng.choice(vocabulary)]])
            rows.append((len(rows), rng.choice([" ", "\t"]).join(words)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \x0b "), (len(rows) + 3, rows[5][1].upper())]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, c string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs, width, ngram_join.Threshold(part, whole)).collect()}
    assert got == brute_join([(d, t or "") for d, t in rows], width, part, whole)


def test_join_edges(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A B c d e"), (None, "a b c d e"), (3, "x"), (4, "x"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 1, 3), (4, 1, 3), (5, 0, 5)], key=str)
    assert ngram_join.linked(docs.where("false")).count() == 0


def test_join_of_a_large_group_of_near_copies(spark):
    """No pair is listed for members of one component, and few for those that only come near."""
    rng = random.Random(12)
    base = words(rng, 120)
    rows = []
    for i in range(900):
        text, changes = list(base), 0 if i % 9 == 0 else rng.randrange(1, 7)
        for _ in range(changes):
            text[rng.randrange(len(text))] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs).collect()}
    assert got == brute_join(rows, 4, 85, 100)
    assert len({c for _, c in got.values()}) > 20


def test_join_takes_long_texts_and_clashing_columns(spark):
    rng = random.Random(13)
    long = words(rng, 30000)
    rows = [(1, " ".join(long)), (2, " ".join(long[:28000])), (3, " ".join(long[:20000])), (4, "w" * 300000), (5, "w" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "s", "k", "c", "o", "l", "TEXT", "sketch"):
        docs = docs.withColumn(name + ("" if name != "TEXT" else " "), F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs).collect()}
    assert got == brute_join(rows, 4, 85, 100) and got[2][1] == 1 and got[3][1] == 3 and got[5][1] == 4


def test_ids_with_several_texts_join_their_links(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(5, a), (3, a), (5, b), (7, b), (7, c), (9, c), (None, c), (11, "none like it"), (11, "")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 5, 7, 9)} == {3} and {r["component_id"] for r in got if r["doc_id"] == 11} == {11}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] and len(got) == len(rows)


def test_sketches_never_reject_similar_sets():
    rng = np.random.default_rng(8)
    for n in (3, 20, 200, 5000):
        a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**64 - 1, n // 3, dtype=np.uint64)]))
        apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        assert ngram_join.least_difference(x, y) <= apart
        assert ngram_join.least_difference(ngram_join.folded(x, 128), ngram_join.folded(y, 128)) <= apart
        assert ngram_join.least_difference(x, x) == 0 and ngram_join.least_difference(x, y) > apart // 2


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["v"]: r["c"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
    first = graph.components(spark.createDataFrame(edges[:50], "u long, v long"))
    got = {r["v"]: r["c"] for r in graph.merged(first, spark.createDataFrame(edges[30:], "u long, v long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_extra_columns_survive(spark):
    names = ["doc_id", "text", "TEXT", "gone", "doc", "rid", "removed_runs", "Removed_Runs_1", "c0", "a.b", "__doc"]
    rows = [(i, "One is here. Two is here. Three is here.", f"own {i}", *["x"] * 8) for i in range(3)]
    docs = spark.createDataFrame(rows, [f"n{i}" for i in range(len(names))]).toDF(*names)
    out = spans.deduplicated(docs)
    assert out.columns == [*names, "removed_runs_2"]
    assert sorted((r[0], r[1], r[2], r[10], r[11]) for r in out.collect()) == [(0, rows[0][1], "own 0", "x", 0), (1, "", "own 1", "x", 1), (2, "", "own 2", "x", 1)]
    assert ngram_join.linked(docs, 2).where("component_id = 0").count() == 3


def test_large_sets_of_keys_are_joined(spark, monkeypatch):
    """Beyond the size of a filter the same rows come through, and no others."""
    rows = spark.range(300).select(F.xxhash64("id").alias("k"), "id")
    keys = rows.where("id % 7 = 0").select(F.col("k").alias("h"))
    wanted = {r["id"] for r in rows.collect() if r["id"] % 7 == 0}
    assert wanted <= {r["id"] for r in bloom.thinned(rows, F.col("k"), keys).collect()}
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    joined = bloom.thinned(rows, F.col("k"), keys)
    assert {r["id"] for r in joined.collect()} == wanted and joined.columns == ["k", "id"]


def test_representatives(spark):
    rng = random.Random(15)
    text, other = " ".join(words(rng, 40)), " ".join(words(rng, 30))
    near = text + " tail"
    rows = [(1, text, "a"), (1, text, "a"), (2, near, "b"), (None, text, "c"), (None, text, "d"), (1, other, "e"), (5, other, "f"), (None, "alone here", "g"), (None, "alone here", "g"), (7, "", "h"), (7, None, "h"), (7, "", "h"), (9, "alone too", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)
    got = ngram_join.representatives(docs)
    assert got.columns == ["doc_id", "text", "tag"]
    kept = sorted(((r["doc_id"], r["text"], r["tag"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, text, "a"), (1, other, "e"), (None, "alone here", "g"), (7, "", "h"), (7, None, "h"), (7, "", "h"), (9, "alone too", "i")], key=str)
    assert ngram_join.representatives(docs.where("false")).count() == 0
