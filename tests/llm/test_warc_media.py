import hashlib
import io
import random
import re
import tarfile
import zlib

from pyspark.sql import functions as F

from shelfmark.llm import media, warc
from shelfmark.llm.store import opened, scratch


def parse(data):
    return list(warc.salvage(warc._Memory(data), len(data)))


def records(n=4):
    return [warc.record_bytes("response", f"urn:x-page:{i}", f"http://a/{i}", f"payload {i}".encode() * 50) for i in range(n)]


def test_whole_archives_gzip_plain_and_mixed():
    raw = records()
    for data in (b"".join(map(warc.gzip_member, raw)), b"".join(raw), warc.gzip_member(raw[0]) + raw[1] + warc.gzip_member(raw[2] + raw[3])):
        rows = parse(data)
        assert [r["record_id"] for r in rows] == [f"urn:x-page:{i}" for i in range(4)] and all(r["kind"] == "record" for r in rows)


def test_damage_is_skipped_and_logged():
    members = [warc.gzip_member(r) for r in records()]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + b"garbage" + members[2] + members[3][: len(members[3]) // 2]
    rows = parse(data)
    assert [r["record_id"] for r in rows if r["kind"] == "record"] == ["urn:x-page:0", "urn:x-page:2"]
    gaps = [(r["begin"], r["end"]) for r in rows if r["kind"] == "gap"]
    a = len(members[0])
    assert gaps == [(a, a + len(broken) + 7), (a + len(broken) + 7 + len(members[2]), len(data))]


def found(rows):
    return [int(r["record_id"].rsplit(":", 1)[1]) for r in rows if r["kind"] == "record"]


def test_records_after_damage_inside_a_member():
    raw = records(5)
    for bad in range(5):
        flipped = [r.replace(b"payload", b"PAYLOAD", 1) if i == bad else r for i, r in enumerate(raw)]
        rows = parse(warc.gzip_member(raw[0]) + warc.gzip_member(b"".join(flipped)) + warc.gzip_member(raw[1]))
        assert found(rows) == [0, *[i for i in range(5) if i != bad], 1]
        gap, = [r for r in rows if r["kind"] == "gap"]
        begin = sum(map(len, raw[:bad]))
        assert (gap["begin"], gap["inner_begin"], gap["inner_end"]) == (len(warc.gzip_member(raw[0])), begin, begin + len(raw[bad]))


def test_members_that_break_off_or_fail_their_checksum_give_the_records_with_digests():
    raw = records(4)
    member = warc.gzip_member(b"".join(raw))
    bad_crc = member[:-8] + b"\0\0\0\0" + member[-4:]
    rows = parse(bad_crc + warc.gzip_member(raw[0]))
    assert found(rows) == [0, 1, 2, 3, 0] and [(r["begin"], r["inner_begin"]) for r in rows if "inner_begin" in r and r["kind"] == "gap"] == [(0, sum(map(len, raw)))]
    rng = random.Random(1)
    raw = [warc.record_bytes("response", f"urn:x-page:{i}", "u", rng.randbytes(3000)) for i in range(4)]
    member = warc.gzip_member(b"".join(raw))
    assert found(parse(member[: len(member) * 5 // 8])) == [0, 1]
    torn = bytearray(member)
    torn[len(member) * 5 // 8] ^= 0xFF  # stored bytes: only record 2 differs, and the checksum
    rows = parse(bytes(torn) + b"xx" + warc.gzip_member(raw[0]) + raw[1])
    assert found(rows) == [0, 1, 3, 0, 1] and [(r["begin"], r["end"]) for r in rows if r["kind"] == "gap" and "inner_begin" not in r] == [(len(member) - 4, len(member) + 2)]
    plain = [re.sub(rb"WARC-[A-Za-z]+-Digest: [^\r]*\r\n", b"", r) for r in raw]
    assert found(parse(warc.gzip_member(b"".join(plain)))) == [0, 1, 2, 3]
    assert found(parse(warc.gzip_member(b"".join(plain))[:-4])) == []


def test_large_members_are_read_by_windows(monkeypatch):
    rng = random.Random(2)
    raw = [warc.record_bytes("response", f"urn:x-page:{i}", "u", rng.randbytes(400) * rng.randrange(1, 4000)) for i in range(12)]
    member = warc.gzip_member(b"".join(raw))
    whole = parse(member + member[:-5])
    monkeypatch.setattr(warc, "KEPT_BYTES", 1000)
    assert parse(member + member[:-5]) == whole and found(whole) == [*range(12)] * 2
    assert parse(warc.gzip_member(b"") + raw[0])[0]["record_id"] == "urn:x-page:0"


def test_every_archive_is_a_task(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(40)], "page_id long, url string, html string").repartition(6)
    files = warc.write_warc(warc.archived(pages).repartition(6), scratch(spark, "warc"))
    n = files.count()
    got = warc.read_warc(warc.spread(files), payloads=False)
    assert n == 6 and got.rdd.getNumPartitions() == 6 and got.count() == 40
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_plain_damage():
    raw = records()
    bad_length = raw[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    flipped = raw[2].replace(b"payload 2", b"PAYLOAD 2", 1)
    rows = parse(raw[0] + bad_length + flipped + raw[3])
    assert [r["record_id"] for r in rows if r["kind"] == "record"] == ["urn:x-page:0", "urn:x-page:3"]
    assert sum(r["end"] - r["begin"] for r in rows if r["kind"] == "gap") == len(bad_length) + len(flipped)


def test_empty_and_foreign_bytes():
    assert parse(b"") == []
    assert [(r["kind"], r["begin"], r["end"]) for r in parse(b"no archive at all")] == [("gap", 0, 17)]


def test_pages_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\n d", None), (4, "u", ""), (5, "u", "other é" * 5000), (None, "u", "same"), (5, "u", "other é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.page_archive(pages).collect()), key=str)
    size = len(("other é" * 5000).encode())
    want = [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, size, "response", None), (5, size, "response", None), (None, 4, "response", None)]
    assert sorted((g[:4] for g in got), key=str) == sorted(want, key=str)
    assert {g[4] for g in got if g[1] == 4} == {warc.sha1_base32(b"same")}
    assert warc.page_archive(pages.where("false")).count() == 0


def plain_medium(payload):
    """The image, its samples as read back, and its features, written out."""
    lines = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    header = (64).to_bytes(4, "big") + len(lines).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    packed = zlib.compress(b"".join(b"\0" + x for x in lines), 5)
    image = bytes([137, 80, 78, 71, 13, 10, 26, 10]) + chunk(b"IHDR", header) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")
    raw = zlib.decompress(packed)
    mean = sum(payload) / len(payload)
    dev = (sum((b - mean) ** 2 for b in payload) / len(payload)) ** 0.5
    bands = [sum(b // 16 == k for b in payload) * 1000 // len(payload) for k in range(16)]
    return image, b"".join(raw[i + 1 : i + 65] for i in range(0, len(raw), 65)), f"png;64x{len(lines)};8;mean={mean:.3f};dev={dev:.3f};bands={','.join(map(str, bands))}"


def test_media_round_trip(spark):
    texts = [(1, "x"), (2, None), (3, ""), (4, "é" * 64), (5, "x"), (None, "long " * 50000), (5, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("t", F.lit("clash")).toDF("doc_id", "text", "digest", "shard", "Text")
    rows = media.document_media(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = next((t for i, t in texts if i == r["doc_id"]), "") or ""
        payload = media.padded(text.encode())
        media_, samples, feature = plain_medium(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media_), hashlib.sha256(media_).hexdigest(), feature) and samples == payload
        assert r["digest"] == r["media_sha256"] and r["length"] == r["media_bytes"] and r["offset"] % 512 == 0 and r["shard"].endswith(".tar")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.document_media(docs.where("false")).count() == 0


def test_shards_are_tar_and_headers_alone_fill_metadata(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}" * 40) for i in range(9)], "doc_id long, text string").coalesce(1)
    index = media.store_media(docs, scratch(spark, "media"))
    where = media.addresses(index)
    assert where.count() == 3
    meta = media.media_columns(where, payloads=False).first()
    assert meta["width"] == 64 and meta["bit_depth"] == 8 and meta["feature"] is None
    fs, path = opened(where.first()["shard"])
    with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(path).read())) as tar:
        names = {m.name: tar.extractfile(m).read() for m in tar}
    assert all(hashlib.sha256(data).hexdigest() + ".png" == name for name, data in names.items()) and len(names) == 3
