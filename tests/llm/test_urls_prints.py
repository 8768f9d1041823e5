import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bloom, ctph, urlfilter
from shelfmark.llm.queries import URL_RULES


def brute(url, rules=URL_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/", "http://Example.ORG/es/x", "http://sub.example.org/en/12", "http://example.org/en/2?x#y", "http://myexample.org/es/", "http://a.com/de/1", "http://a.com/fr/", "http://com/fr/", "http://a.com.net/fr/", "x://a.org#/es/", "http://a.org/" + "p" * 30000, "ftp://a.com/de/\nx", "://com/de/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages, URL_RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlfilter.judged(pages.where("false"), URL_RULES).count() == 0
    assert urlfilter.judged(pages, []).where("verdict = 'allow'").count() == len(urls)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).cache()
    listed = universe.where("hash(key) % 3 = 0")
    cascade = urlfilter.build_cascade(listed, universe, bits_per_key=2)
    assert cascade.deep > 2
    check_cascade(cascade, universe)


def check_cascade(cascade, universe):
    levels = [*range(cascade.deep), urlfilter.PART_LEVEL]
    rows = universe.select("key", F.array(*[urlfilter.key_hash(F.col("key"), i) for i in levels]).alias("h"), (F.expr("hash(key) % 3") == 0).alias("in")).toPandas()
    h = np.stack(rows["h"].to_numpy())
    assert (cascade.listed([np.ascontiguousarray(h[:, i]) for i in range(len(levels))]) == rows["in"].to_numpy()).all()


def test_long_lists_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 11)
    universe = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).cache()
    cascade = urlfilter.build_cascade(universe.where("hash(key) % 3 = 0"), universe)
    assert len(cascade.parts) == 3
    check_cascade(cascade, universe)
    assert urlfilter.build_cascade(universe.where("false"), universe).listed([np.arange(3)]).tolist() == [False] * 3


def test_the_corpus_needs_several_levels(spark):
    """With the few bits that few rules get, other keys pass the first level, and the next ones put them right."""
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.format_string("http://h%s.com/p%s/de/x", F.col("id") % 97, F.col("id")).alias("url"))
    rules = [("block", f"h{i}.com", f"/p{i}") for i in range(20)] + [("allow", f"h{i}.com", f"/p{i + 97}") for i in range(20)]
    universe = pages.select(F.explode(urlfilter.keys_of(*urlfilter.host_and_path(F.col("url")), sorted({len(r[2]) for r in rules}))).alias("key")).distinct()
    listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == "block"], "key string")
    assert urlfilter.build_cascade(listed, universe).deep > 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages.union(pages), rules).collect()}
    assert got == {r["page_id"]: brute(r["url"], rules) for r in pages.collect()}


def test_fingerprints_do_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 700, 5000, 40000)]
    together = ctph.fingerprints(texts)
    assert together == [ctph.fingerprints([t])[0] for t in texts]
    assert together[0] == "1::"


def test_common_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(2)
    pairs = [("".join(rng.choices("abcd", k=rng.randrange(65))), "".join(rng.choices("abcd", k=rng.randrange(65)))) for _ in range(60)]
    assert list(ctph.common_subsequence(pairs)) == [lcs(a, b) for a, b in pairs]


def test_edits_are_near_and_strangers_are_not():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(500)]
    a, b = " ".join(rng.choices(words, k=800)), " ".join(rng.choices(words, k=800))
    x, y, z = ctph.fingerprints([a.encode(), ctph.edited(a, b).encode(), b.encode()])
    assert ctph.likeness([(x, y)])[0] > 0.5 and ctph.likeness([(x, z)])[0] < 0.2 and ctph.likeness([(x, x)])[0] == 1


def plain_fingerprint(data):
    """The fingerprint written out byte by byte."""
    def rolling(i):
        window = [data[i - k] if i >= k else 0 for k in range(7)]
        total, weighted, shifted = sum(window), sum(b * (7 - k) for k, b in enumerate(window)), 0
        for k, b in enumerate(window):
            shifted ^= b << 5 * k & 0xFFFFFFFF
        h = total + weighted + shifted & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ h >> 13

    def letters(size, most):
        ends = [i + 1 for i in range(len(data)) if rolling(i) % size == 0][: most - 1]
        out, begin = "", 0
        for end in [*ends, len(data)]:
            if end > begin:
                out, begin = out + ctph.LETTERS[zlib.crc32(data[begin:end]) % 64], end
        return out

    k = 0
    while len(data) > 64 << k:
        k += 1
    while k and sum(rolling(i) % (1 << k) == 0 for i in range(len(data))) + 1 < 32:
        k -= 1
    return f"{1 << k}:{letters(1 << k, 64)}:{letters(2 << k, 32)}"


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (p, *a), (q, *b) = ((int(z.split(":")[0]), *z.split(":")[1:]) for z in (x, y))
    best = 0.0
    for s, t in zip(a, b) if p == q else [(a[1], b[0])] if 2 * p == q else [(a[0], b[1])] if p == 2 * q else []:
        s, t = (re.sub(r"(.)\1{3,}", r"\1\1\1", z) for z in (s, t))
        n = min(7, (min(len(s), len(t)) + 1) // 2)
        if not n or not any(s[i : i + n] in t for i in range(len(s) - n + 1)):
            continue
        row = list(range(len(t) + 1))
        for i, c in enumerate(s):  # edit distance by insertions and deletions
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(row[j] if c == d else 1 + min(row[j + 1], new[j]))
            row = new
        best = max(best, 1 - row[-1] / (len(s) + len(t)))
    return best


def test_fingerprints_against_plain_loops():
    rng = random.Random(5)
    texts = [bytes(rng.choices(kinds, k=n)) for kinds in (range(256), b"ab cde\n", b"a") for n in (0, 1, 2, 6, 7, 8, 63, 64, 65, 128, 129, 700, 3000)]
    texts += [t[: len(t) // 2] + b"x" + t[len(t) // 2 :] for t in texts]
    prints = ctph.fingerprints(texts)
    assert prints == [plain_fingerprint(t) for t in texts]
    pairs = [(x, y) for x in prints for y in prints]
    assert np.allclose(ctph.likeness(pairs), [plain_likeness(x, y) for x, y in pairs], atol=1e-12)


@pytest.mark.parametrize("bucket_bytes", [100, 1 << 20])
def test_next_documents_over_buckets(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(ctph.in_order, "__defaults__", ("doc_id", "text", bucket_bytes))
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ab cdé", k=rng.randrange(200)))) for i in rng.sample(range(10000), 120)] + [(-5, None), (20001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).repartition(5)
    ids = sorted((i for i, _ in rows), reverse=True)
    texts = {i: t or "" for i, t in rows}
    got = {r["doc_id"]: r for r in ctph.fingerprinted(docs).collect()}
    assert len(got) == len(rows)
    for i, d in enumerate(ids):
        after = ids[(i + 1) % len(ids)]
        assert got[d]["edited_sha256"] == hashlib.sha256(ctph.edited(texts[d], texts[after]).encode()).hexdigest()
        assert got[d]["fingerprint"] == ctph.fingerprints([texts[d].encode()])[0]
        assert got[d]["near_edited"] == pytest.approx(plain_likeness(got[d]["fingerprint"], plain_fingerprint(ctph.edited(texts[d], texts[after]).encode())))
        assert got[d]["near_next"] == pytest.approx(plain_likeness(got[d]["fingerprint"], plain_fingerprint(texts[after].encode())))
    unnamed = spark.createDataFrame([(None, "no id %d %s" % (i % 90, "x" * (i % 90))) for i in range(120)] + [(3, "z" * 400000), (3, "y"), (3, "y")], "doc_id long, text string").repartition(4)
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]) for r in unnamed.withColumn("h", F.xxhash64("text")).collect()), key=lambda r: (*[-x for x in r[:3]], r[3]))
    want = [(len(r[3]), hashlib.sha256(ctph.edited(r[3], order[(i + 1) % len(order)][3]).encode()).hexdigest()) for i, r in enumerate(order)]
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in ctph.fingerprinted(unnamed).collect()) == sorted(want)
    assert ctph.fingerprinted(docs.where("false")).count() == 0
    assert ctph.fingerprinted(docs.where("doc_id = -5")).first()["near_next"] == 1.0
    twins = spark.createDataFrame([(7, "abc"), (7, "abc"), (None, "x")], "doc_id long, text string")
    assert ctph.fingerprinted(twins).count() == 3
