"""Operator 8: an exact Jaccard join on word shingles by partitioning the token universe.

Two sets with Jaccard similarity >= t and sizes a <= b differ in at most H = floor((1 - t) / (1 + t) * (a + b)) tokens. Sizes
fall in bands; each band hashes the universe into segments. A segment of demand 1 is indexed by the hash of its subset, one
of demand 2 by that and by all its one-deletion neighbourhoods. If the demands add up to H + 1, some segment of a
similar pair differs in fewer tokens than its demand, so the pair meets in the index: by pigeonhole no link is lost. Whether a band
takes demands of 1 or 2 is chosen by the cost of index rows and of chance meetings, from the band's measured population.

Bands of demand 1 have E segments more than needed, so a similar pair agrees in E + 1 segments at least. Every text then leaves out its
costliest entries, those whose groups are largest, as long as they are at most E. Of a pair's common entries those that either side left out
are all among the at most E that the side with the lower limit left out, so one common entry stays on both sides.

Equal sets are one class from the start, named by 128 bits. The members of an index group are first tested against a pivot, the
member that shares most entries with others, and links are merged to components. Then the members outside of the pivot's component are tested against
the heaviest of themselves. What is left are groups that hold several components, and only members of different ones can still give a
new link. Such groups are gathered by their pivot, where a member has one row however many groups it shares, and dealt in blocks: those outside of the pivot's
component against each other and against its members, never two members of that component. A pair is listed once for each pivot, and only if
it shares a group and its sizes and sketches allow a link.

A sketch has a bit for each of 2^k ranges of hashes, which tells whether the set has an odd number of tokens there. Two sketches differ in at most as
many bits as the sets differ in tokens, so what they reject is surely unlike; the rest is decided on whole sets of shingles, compared as
words. Links, components and candidates stay distributed.

Defined cases: a null or empty text and one without words have the empty set, link with nothing and are their own component; texts with
fewer words than a shingle have their whole word sequence as one shingle; rows that repeat an id keep their number and share a component, whatever their
texts link with; a null id links nothing and has a null component; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import bloom
from shelfmark.llm.graph import components, merged
from shelfmark.llm.store import begin, dropped, freed, give_back, picked, written
from shelfmark.llm.words import mixed, shingle_hashes, words_of
from shelfmark.runtime import shipped

BAND_RATIO = 1.3
#: Spare segments for each difference allowed, and the chance that two texts share a token, for the cost model.
SPARE, CHANCE = 0.25, 0.05
#: Bits of the sketches that are compared inside index groups, bits of the largest ones, and members of a block.
COARSE, FINE, BLOCK = 1 << 10, 1 << 15, 128
#: In how many passes over the entries their hashes are counted, which divides the disk that the shuffle takes.
COUNT_PASSES = 2
#: Bytes of a text for each of its shingles, for the cost model.
BYTES_A_WORD = 6.5


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least ``part / whole``, exact in integers."""

    part: int
    whole: int

    def holds(self, common: int, union: int) -> bool:
        return self.whole * common >= self.part * union and common > 0

    def most_different(self, a: int, b: int) -> int:
        return (self.whole - self.part) * (a + b) // (self.whole + self.part)

    def largest_partner(self, n: int) -> int:
        return n * self.whole // self.part

    def least_partner(self, n: int) -> int:
        return -(-n * self.part // self.whole)


def bands_up_to(n: int) -> np.ndarray:
    """Least sizes of the bands, enough for sizes up to n."""
    out = [1]
    while out[-1] <= n:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return np.array(out, np.int64)


@dataclass(frozen=True)
class Allocation:
    """Of a band: how many segments have demand 1 and 2, and how many entries a text may leave out."""

    ones: int
    twos: int
    spare: int


def allocated(low: int, high: int, population: int, threshold: Threshold) -> Allocation:
    """The cheaper of both kinds of demand for sizes low..high (larger partners beyond high included): rows, and meetings by chance at a fiftieth of a row."""
    most = threshold.most_different(high, threshold.largest_partner(high))
    spare = int(np.ceil(SPARE * most))
    size = (low + high) / 2
    ones, twos = Allocation(most + 1 + spare, 0, spare), Allocation(0, most // 2 + 1, 0)
    tokens = size / ones.ones
    one_cost = ones.ones + population / 50 * ones.ones * (np.exp(-tokens * (1 - CHANCE)) - np.exp(-tokens) * (1 + tokens * CHANCE) * bool(spare))
    tokens = size / twos.twos
    two_cost = twos.twos * (1 + tokens) + population / 50 * twos.twos * (1 + tokens) * np.exp(-tokens * (1 - CHANCE)) / CHANCE
    return ones if one_cost <= two_cost else twos


@dataclass
class Index:
    threshold: Threshold
    lows: np.ndarray
    plans: dict[int, Allocation]

    def bands_of(self, n: int) -> range:
        """The text's own band, and those below in which a smaller partner may lie."""
        band = lambda k: int(np.searchsorted(self.lows, k, side="right")) - 1
        return range(band(self.threshold.least_partner(n)), band(n) + 1)

    def entries(self, tokens: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """For each band of a set (distinct unsigned 64-bit tokens): its index entries as hashes, the band, and how many may be left out."""
        out = []
        for band in self.bands_of(len(tokens)):
            plan = self.plans[band]
            total = plan.ones + 2 * plan.twos
            slot = ((mixed(tokens + np.uint64(band * 2 + 1)) >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
            segment = np.where(slot < plan.ones, slot, plan.ones + (slot - plan.ones) // 2) if plan.twos else slot
            segments = plan.ones + plan.twos
            count = np.bincount(segment, minlength=segments)
            # a subset's hash is the sum of its tokens, so deletions are differences; halves of 32 bits add up exactly in doubles
            low, high = np.bincount(segment, _low(tokens), segments), np.bincount(segment, _high(tokens), segments)
            subset = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
            named = lambda seg, hashes, size, b=band: mixed(mixed(hashes + size.astype(np.uint64)) ^ mixed(seg.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(b)))
            hashes = named(np.arange(segments), subset, count)
            if plan.twos:
                own = np.flatnonzero(segment >= plan.ones)
                hashes = np.concatenate([hashes, named(segment[own], subset[segment[own]] - tokens[own], count[segment[own]] - 1)])
            out.append((hashes.view(np.int64), band, plan.spare))
        return out


def _low(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.float64)


def _high(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.float64)


def sketch(tokens: np.ndarray) -> bytes:
    """For each of 2^k residues of hashes, whether an odd number of tokens falls there: at least two bits a token up to FINE."""
    bits = max(COARSE, min(FINE, 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, size: int) -> bytes:
    """The sketch of the same set with fewer bits, ``size`` bytes."""
    y = np.frombuffer(x, np.uint8)
    while len(y) > size:
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return y.tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many tokens two sets do not share, from their sketches; the finer one is folded first."""
    size = min(len(a), len(b))
    x, y = np.frombuffer(folded(a, size), np.uint64), np.frombuffer(folded(b, size), np.uint64)
    return int(np.bitwise_count(x ^ y).sum())


def _nulls(n: int) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.zeros(n, np.int64), np.ones(n, bool))


def _token_sets(batches, width: int, rows: int = 100):
    """Some rows, and the sorted distinct tokens of their texts."""
    for pdf in batches:
        for begin in range(0, len(pdf), rows):
            part = pdf.iloc[begin : begin + rows]
            yield part, [np.unique(shingle_hashes(words_of(t), width)) for t in part["text"]]


def _class_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit names of a set; equal sets have equal names."""
    if not len(tokens):
        return 0, 0
    with np.errstate(over="ignore"):
        n = np.uint64(len(tokens))
        sums = [tokens.sum(dtype=np.uint64) ^ mixed(tokens ^ (tokens >> np.uint64(7))).sum(dtype=np.uint64) + n, mixed(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + n]
        names = mixed(np.array(sums, np.uint64)).view(np.int64)
    return int(names[0]), int(names[1])


PAIR = ["u", "ou", "v", "ov"]
PAIR_SCHEMA = "u long, ou long, v long, ov long"


def _of(df: DataFrame, side: str, **values: str) -> DataFrame:
    """Rows keyed by (c, o), renamed for one side of a pair."""
    return df.select(F.col("c").alias(side), F.col("o").alias(f"o{side}"), *[F.col(old).alias(new) for old, new in values.items()])


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (u, v: classes; ou, ov: their documents) that their sketches do not rule out. ``sketches``: (c, o, n, sketch)."""

    def run(batches):
        for pdf in batches:
            ok = [least_difference(x, y) <= threshold.most_different(a, b) for x, y, a, b in zip(pdf["x"], pdf["y"], pdf["a"], pdf["b"], strict=True)]
            yield pdf.loc[ok, PAIR]
        give_back()

    both = pairs.join(_of(sketches, "v", n="b", sketch="y"), ["v", "ov"]).join(_of(sketches, "u", n="a", sketch="x"), ["u", "ou"])
    return both.mapInPandas(run, PAIR_SCHEMA)


def shingles(text: str, width: int) -> set[bytes]:
    """The set that ``shingle_hashes`` names, as words."""
    words = words_of(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """The pairs whose sets are similar, each compared in whole, as words. ``texts``: (c, o, text), one text a class."""

    def run(batches):
        begin("ngram_join")
        last = kept = None
        for pdf in batches:
            ok = []
            for u, ou, a, b in zip(pdf["u"], pdf["ou"], pdf["a"], pdf["b"], strict=True):
                if (u, ou) != last:
                    last, kept = (u, ou), shingles(a, width)
                other = shingles(b, width)
                both = len(kept & other)
                ok.append(threshold.holds(both, len(kept) + len(other) - both))
            yield pdf.loc[ok, PAIR]
        give_back()

    both = pairs.join(_of(texts, "v", text="b"), ["v", "ov"]).join(_of(texts, "u", text="a"), ["u", "ou"])
    return both.select(*PAIR, "a", "b").mapInPandas(run, PAIR_SCHEMA)


def _texts(rows: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """(c, o, text), one for each class in ``own`` (c, c2, o, tag): only rows with their tags are shuffled."""

    def true_texts(batches):
        """Rows that share a tag may hold other texts: keep those that are of the class."""
        for pdf in batches:
            ok = [_class_of(np.unique(shingle_hashes(words_of(t), width))) == (c, d) for t, c, d in zip(pdf["text"], pdf["c"], pdf["c2"], strict=True)]
            yield pdf.loc[ok, ["c", "o", "text"]]
        give_back()

    few = bloom.thinned(rows.select("tag", "text"), F.col("tag"), own.select(F.col("tag").alias("h")).distinct())
    return few.join(own, "tag").select("c", "c2", "o", "text").mapInPandas(true_texts, "c long, o long, text string").dropDuplicates(["c", "o"])


def _across(apart: DataFrame, coarse: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs of members of one group (s) in different components (c, o, n, l, weight) that sizes and sketches do not rule out.

    All groups with one pivot are one piece of work: a member has one row there, and a mask of the groups it is in. Those outside of the pivot's
    component are dealt in blocks of about BLOCK; each meets the other blocks, and those of the component's members.
    """
    home = apart.groupBy("s").agg(F.max(F.struct("weight", "c", "o", "l")).alias("p")).select("s", F.col("p.c").alias("pc"), F.col("p.o").alias("po"), F.col("p.l").alias("pl"))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    homed = apart.join(home, "s").groupBy("pc", "po", "pl", "c", "o", "n", "l").agg(F.bit_or(bit).alias("mask"))
    homed = written(homed.withColumn("main", F.col("l") == F.col("pl")), "homed")
    sizes = homed.groupBy("pc", "po").agg(*[F.ceil(F.count_if(k) / BLOCK).cast("int").alias(name) for name, k in (("nm", F.col("main")), ("no", ~F.col("main")))])
    sizes = written(sizes, "sizes")  # the join alone can be split where a pivot has many members
    spread = lambda n: F.pmod(F.xxhash64("c", "o"), F.col(n)).cast("int")
    own = homed.join(sizes, ["pc", "po"]).join(coarse, ["c", "o"]).withColumn("b", F.when(F.col("main"), F.col("no") + spread("nm")).otherwise(spread("no")))
    against = F.sequence(F.lit(0), F.when(F.col("main"), F.col("no") - 1).otherwise(F.col("no") + F.col("nm") - 1))
    dealt = own.withColumn("t", F.explode(against)).select("pc", "po", F.least("b", "t").alias("i"), F.greatest("b", "t").alias("j"), "b", "c", "o", "n", "l", "mask", "h")
    work = ["pc", "po", "i", "j"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """All pairs inside the pieces of work of sorted rows, those a distance apart at once."""
        i, j, b, c, o, n, label, mask = (rows[k].to_numpy(np.int64) for k in ("i", "j", "b", "c", "o", "n", "l", "mask"))
        piece = rows.groupby(work, sort=False).ngroup().to_numpy()
        h = np.frombuffer(b"".join(rows["h"]), np.uint64).reshape(len(rows), COARSE // 64)
        found = []
        x = np.arange(len(rows))
        for apart_by in range(1, len(rows)):
            x = x[x + apart_by < len(rows)]
            x = x[piece[x] == piece[x + apart_by]]
            if not len(x):
                break
            y = x + apart_by
            low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = ((i[x] == j[x]) | (b[x] != b[y])) & (label[x] != label[y]) & (mask[x] & mask[y] != 0) & (threshold.whole * low >= threshold.part * high)
            p, q = x[ok], y[ok]
            near = np.bitwise_count(h[p] ^ h[q]).sum(axis=1, dtype=np.int64) <= (threshold.whole - threshold.part) * (n[p] + n[q]) // (threshold.whole + threshold.part)
            found.append(np.stack([p[near], q[near]]))
        at = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
        p, q = np.where((c[at[0]] < c[at[1]]) | (c[at[0]] == c[at[1]]) & (o[at[0]] <= o[at[1]]), at, at[::-1])
        return pd.DataFrame({"u": c[p], "ou": o[p], "v": c[q], "ov": o[q]})

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = int((pdf[work] == pdf[work].iloc[-1]).all(axis=1).to_numpy().argmax())
            held = pdf.iloc[last:]
            if last:
                yield compare(pdf.iloc[:last])
        if held is not None and len(held):
            yield compare(held)
        give_back()

    return dealt.repartition(*work).sortWithinPartitions(*work).mapInPandas(run, PAIR_SCHEMA).distinct()


def _pairs(star: DataFrame) -> DataFrame:
    """Distinct pairs of members (c, o) and pivots (pc, po), the smaller first."""
    a, b = F.struct("c", "o"), F.struct(F.col("pc").alias("c"), F.col("po").alias("o"))
    return star.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).select(F.col("a.c").alias("u"), F.col("a.o").alias("ou"), F.col("b.c").alias("v"), F.col("b.o").alias("ov")).distinct()


def linked(docs: DataFrame, width: int = 4, threshold: Threshold = Threshold(85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _linked(rows.withColumn("tag", F.xxhash64("doc_id", "text")), width, threshold, True).drop("tag")


def representatives(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group one row stays, that with the smallest id (null ids last; of equal ids by a hash of the row).

    Here texts alone make groups, whatever their ids: a null id takes part, and texts that share an id are apart unless they are alike. Of rows that are
    equal in all columns one stays. Rows without words link with nothing and all stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    tagged = plain.withColumn("id", F.col(id_).cast("long")).withColumn("tag", F.xxhash64(*[F.col(c) for c in names], F.concat_ws(",", *[F.isnull(c).cast("int").cast("string") for c in names])))
    groups = _linked(tagged.select(F.col("id").alias("doc_id"), "tag", F.col(text).cast("string").alias("text")), width, threshold, False)
    order = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "tag")
    first = groups.where("component_id is not null").groupBy("component_id").agg(F.min(order).alias("k")).select("k.doc_id", "k.tag")
    # rows that are equal in all columns have one tag; those of groups that keep such rows are few
    several = groups.groupBy("doc_id", "tag").agg(F.count("*").alias("rows"))
    first = written(first.alias("a").join(several.alias("b"), (F.col("a.tag") == F.col("b.tag")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select(F.col("a.doc_id").alias("kept"), F.col("a.tag").alias("kept_tag"), "rows"), "representatives")
    match = (F.col("tag") == F.col("kept_tag")) & F.col("id").eqNullSafe(F.col("kept"))
    once = tagged.join(first.where("rows = 1"), match, "left_semi")
    one_of = tagged.join(first.where("rows > 1"), match, "left_semi").groupBy("id", "tag").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    wordless = tagged.where(~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return once.select(*names).union(one_of.select(*names)).union(wordless.select(*names)).toDF(*docs.columns)


def _linked(rows: DataFrame, width: int, threshold: Threshold, by_id: bool) -> DataFrame:
    """doc_id, tag, n_shingles, component_id for every row (doc_id, tag, text).

    With ``by_id`` documents are what links, a null id links nothing, and a component is named by its smallest id. Without, texts are: a class
    has the smallest id that it alone holds or else a number beyond 2^62 made of its name, and texts without words have no component.
    """
    spark = shipped(rows.sparkSession)

    # sizes are not known yet: the cost model takes them from lengths, and no size has more tokens than half of its bytes
    length = F.octet_length(F.coalesce("text", F.lit("")))
    lows = bands_up_to((rows.agg(F.max(length).alias("m")).first()["m"] or 0) // 2 + 1)
    guessed = F.array_size(F.filter(F.array(*[F.lit(int(x)) for x in lows]), lambda x: x <= length / BYTES_A_WORD)) - 1
    population = {r["band"]: r["k"] for r in rows.groupBy(guessed.alias("band")).agg(F.count("*").alias("k")).collect()}  # a row a band
    plans = {i: allocated(int(lows[i]), int(lows[i + 1]) - 1, population.get(i, 0) + population.get(i + 1, 0), threshold) for i in range(len(lows) - 1)}
    index = spark.sparkContext.broadcast(Index(threshold, lows, plans))

    def entries(batches):
        """One row a text (s null, with its sketch), and one (s, c, band, spare) for each entry of its set."""
        begin("ngram_join")
        seen = {}
        for pdf, sets in _token_sets(batches, width):
            names = np.array([_class_of(t) for t in sets], np.int64).reshape(-1, 2)
            counts = np.array([len(t) for t in sets], np.int64)
            ids = pd.array([None if pd.isna(d) else int(d) for d in pdf["doc_id"].tolist()], "Int64")
            yield pd.DataFrame({"doc_id": ids, "tag": pdf["tag"].to_numpy(np.int64), "n": counts, "c": names[:, 0], "c2": names[:, 1], "sketch": [sketch(t) if len(t) else None for t in sets], "s": _nulls(len(sets)), "band": 0, "spare": 0})
            own = []
            for i, tokens in enumerate(sets):
                name = names[i, 0], names[i, 1]
                if len(tokens) and name not in seen:  # copies in one task are indexed once
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[name] = True
                    own += [(i, *x) for x in index.value.entries(tokens)]
            if own:
                repeat = lambda k: np.repeat([x[k] for x in own], [len(x[1]) for x in own])
                at = repeat(0)
                yield pd.DataFrame({"doc_id": _nulls(len(at)), "tag": _nulls(len(at)), "n": counts[at], "c": names[at, 0], "c2": _nulls(len(at)), "sketch": None, "s": np.concatenate([x[1] for x in own]), "band": repeat(2), "spare": repeat(3)})
        give_back()

    both = written(rows.mapInPandas(entries, "doc_id long, tag long, n long, c long, c2 long, sketch binary, s long, band int, spare int"), "entries")
    heads = written(both.where("s is null").select("doc_id", "tag", "n", "c", "c2", "sketch"), "heads")
    members = heads.drop("sketch")
    # entries that there is one of are left behind by a count of hashes alone; then those of one class
    keyed = both.where("s is not null")
    counted = []
    for part in range(COUNT_PASSES):  # the shuffle of one part is given back before the next
        own = keyed.select("s").where(F.pmod(F.col("s"), F.lit(COUNT_PASSES)) == part)
        counted.append(written(own.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s"), "shared"))
        freed(spark)
    shared = reduce(DataFrame.union, counted)
    few = bloom.thinned(keyed.select("s", "c", "n", "band", "spare"), F.col("s"), shared.select(F.col("s").alias("h")), 8)
    pool = written(few.groupBy("s", "c", "n", "band", "spare").agg(F.count("*").alias("copies")).drop("copies"), "pool")
    dropped(both)
    for table in counted:
        dropped(table)
    freed(spark)
    several = pool.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    # the costliest entries of a text in a band go while they are at most ``spare``; equal costs go together
    ahead = Window.partitionBy("c", "band").orderBy(F.desc("k")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    costly = written(pool.join(several, "s").withColumn("ahead", F.count("*").over(ahead)).where("ahead > spare").select("s", "c", "n"), "costly")
    dropped(pool)
    shares = costly.join(costly.groupBy("s").agg(F.count("*").alias("k")).where("k > 1"), "s")
    # how much a text shares with others: a text that many were copied from has most
    full = members.where("n > 0")
    # ids with several texts
    twice = full.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("c", "c2")).alias("a"), F.max(F.struct("c", "c2")).alias("b")).where("a != b").select("doc_id")
    if by_id:
        classes = full.where("doc_id is not null").groupBy("c", "c2").agg(F.min("doc_id").alias("o"), F.count("*").alias("copies"), F.min("tag").alias("tag"))
    else:
        own = full.join(twice.withColumn("shared", F.lit(True)), "doc_id", "left")
        classes = own.groupBy("c", "c2").agg(F.min(F.when(F.col("shared").isNull(), F.col("doc_id"))).alias("o"), F.count("*").alias("copies"), F.min("tag").alias("tag"))
        classes = classes.withColumn("o", F.coalesce("o", F.expr("(c & 4611686018427387903L) | 4611686018427387904L")))
    classes = written(classes, "classes")
    weight = shares.groupBy("c").agg(F.sum("k").alias("weight")).join(classes.select("c", "c2", "o", "tag"), "c")
    weight = written(weight, "weight")
    met = written(shares.drop("k").join(weight.select("c", "o", "weight"), "c"), "met")
    dropped(costly)
    sketches = heads.where("n > 0").groupBy("c", "c2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(weight.select("c", "c2", "o"), ["c", "c2"])
    sketches = written(sketches.select("c", "o", "n", "sketch"), "sketches")
    freed(spark)
    tried = None

    def similar(pairs: DataFrame) -> DataFrame:
        """The links among pairs that were not compared before."""
        nonlocal tried
        new = _likely(pairs, sketches, threshold)
        likely = written(new if tried is None else new.join(tried, PAIR, "left_anti"), "likely")
        if likely.isEmpty():
            return likely
        tried = likely if tried is None else tried.union(likely)
        own = likely.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("ou").alias("o")), F.struct(F.col("v").alias("c"), F.col("ov").alias("o")))).alias("x")).select("x.c", "x.o").distinct()
        own = written(own.join(weight.select("c", "c2", "o", "tag"), ["c", "o"]), "owners")
        texts = written(_texts(rows, own, width), "texts")  # the joins alone can be split where a pivot has many candidates
        links = written(_verified(likely, texts, width, threshold), "links")
        dropped(own)
        dropped(texts)
        return links

    fits = F.expr(f"{threshold.whole} * least(n, pn) >= {threshold.part} * greatest(n, pn)")
    heaviest = F.max(F.struct("weight", "c", "o", "n")).alias("p")
    pivot = [F.col(f"p.{k}").alias(f"p{k}") for k in ("c", "o", "n")]
    star = met.join(met.groupBy("s").agg(heaviest).select("s", *pivot), "s").where(fits & ((F.col("c") != F.col("pc")) | (F.col("o") != F.col("po"))))
    links = similar(_pairs(star))
    edges = links.select(F.col("ou").alias("u"), F.col("ov").alias("v"))
    if by_id:  # documents are joined by the links of their classes, and an id with several texts joins those
        edges = edges.union(full.join(twice, "doc_id").join(classes, ["c", "c2"]).select(F.col("doc_id").alias("u"), F.col("o").alias("v")))
    label = components(edges)

    def labelled(label: DataFrame) -> DataFrame:
        """The groups that still hold several components."""
        tagged = met.join(label.select(F.col("v").alias("o"), F.col("c").alias("l")), "o", "left").withColumn("l", F.coalesce("l", "o"))
        several = tagged.groupBy("s").agg(F.min("l").alias("l0"), F.max("l").alias("l1"), F.max(F.struct("weight", "c", "o", "l"))["l"].alias("pl")).where("l0 != l1").select("s", "pl")
        return written(tagged.join(several, "s").select("s", "c", "o", "n", "weight", "l", "pl"), "apart")

    def rest(apart: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Labels after members outside of a pivot's component were tested against the heaviest of themselves, and then all that were not tested yet."""
        loose = apart.where("l != pl")
        star = loose.join(loose.groupBy("s").agg(F.max(F.struct("weight", "c", "o", "n", "l")).alias("p")).select("s", *pivot, F.col("p.l").alias("ql")), "s").where(fits & (F.col("l") != F.col("ql")))
        links = similar(_pairs(star))
        label = merged(label, links.select(F.col("ou").alias("u"), F.col("ov").alias("v")))
        dropped(apart)
        # what is left: members of one group in different components, and not tested yet
        apart = labelled(label)

        @F.pandas_udf("binary")
        def coarse(x: pd.Series) -> pd.Series:
            return pd.Series([folded(y, COARSE // 8) for y in x], dtype=object)

        flat = written(sketches.join(apart.select("c", "o").distinct(), ["c", "o"], "left_semi").select("c", "o", coarse("sketch").alias("h")), "coarse")
        links = similar(written(_across(apart.drop("pl"), flat, threshold), "pairs"))
        label = merged(label, links.select(F.col("ou").alias("u"), F.col("ov").alias("v")))
        dropped(flat)
        return label, apart

    apart = labelled(label)
    if not apart.isEmpty():
        label, apart = rest(apart, label)
    freed(spark)
    # one row for each class that has copies or links
    placed = classes.join(label.select(F.col("v").alias("o"), F.col("c").alias("l")), "o", "left").where("copies > 1 or l is not null or o >= 4611686018427387904L")
    placed = written(placed.select("c", "c2", F.coalesce("l", "o").alias("component")), "components")
    for table in (apart, met, sketches, weight, classes):
        dropped(table)
    out = members.join(placed, ["c", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")) if by_id else F.when(F.col("n") > 0, F.coalesce("component", "doc_id"))
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"))
