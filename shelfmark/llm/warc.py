"""Operator 1: WARC archives and a salvage reader.

``write_warc`` stores one record a row as gzip members; ``read_warc`` reads gzip or plain archives. After a
failed check (magic, inflation with its CRC, version line, header, length, terminator or block digest) the reader
searches for the next member or version line that is valid, goes on there, and logs the bytes between as a gap.
It does so inside members too: damage to one record of a member loses that record alone, and of a member that breaks off or
fails its CRC every record is kept that a digest of its own vouches for. Members are inflated by windows, so memory follows a record.

Defined cases: a null payload is empty; a null id is kept as null; rows with equal ids stay
separate records; an empty table gives no file and no row; other columns are ignored. Among rows with equal
payloads of at least ``min_bytes`` bytes, those with the largest id are responses (all of
them, if the id repeats) and the others revisit it; rows without an id are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.store import opened, picked, scratch, written
from shelfmark.runtime import shipped

#: A new archive is begun beyond so many bytes.
SHARD_BYTES = 256 << 20
_STEP = 1 << 16
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_SAFE_URI = re.compile(r"[\x00-\x20\x7f]")
MOST_TASKS = 20_000
#: Inflated members up to so many bytes are kept while they are read; larger ones are inflated again by windows.
KEPT_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: begin and end are places in the archive as stored; inner_begin and inner_end those in the inflated member, null outside of members.
RECORD_SCHEMA = "path string, kind string, begin long, end long, inner_begin long, inner_end long, reason string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record around an HTTP response. A revisit keeps the HTTP header and drops the payload."""
    digest = sha1_base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind != "revisit":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + _SAFE_URI.sub(lambda m: f"%{ord(m[0]):02X}", uri),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damage(ValueError):
    """A check that failed."""


class _Bytes:
    """Reads and searches in a file by windows, so that memory follows a record and not the archive."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.window):
            self.file.seek(at)
            self.window, self.at = self.file.read(max(n, min(1 << 20, self.size - at))), at
        return self.window[at - self.at : at - self.at + n]

    def find(self, what: tuple[bytes, ...], at: int) -> int:
        """The first place from ``at`` on where one of ``what`` stands, or the size."""
        while at < self.size:
            window = self.read(at, _STEP + 16)
            if hits := [p for p in (window.find(w) for w in what) if p >= 0]:
                return at + min(hits)
            if at + len(window) >= self.size:
                break
            at += max(1, len(window) - 15)
        return self.size


def _record(src: _Bytes, at: int, vouched: bool = True) -> tuple[dict, int]:
    """The record whose version line stands at ``at``, and its end. Unless something ``vouched`` for the bytes, a digest of the record has to."""
    head = src.read(at, 4096)
    while (cut := head.find(b"\r\n\r\n")) < 0:
        if len(head) >= 1 << 20 or at + len(head) >= src.size:
            raise Damage("header without end")
        head = src.read(at, 2 * len(head))
    lines = head[:cut].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Damage("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "surrogatepass" if b"\xed" in value else "replace")
    if not (fields.get(b"content-length") or "").isdecimal() or b"warc-type" not in fields:
        raise Damage("no length or no type")
    begin, n = at + cut + 4, int(fields[b"content-length"])
    if begin + n + 4 > src.size:
        raise Damage("truncated record")
    block = src.read(begin, n + 4)
    if block[n:] != b"\r\n\r\n":
        raise Damage("no terminator where the length ends")
    block = block[:n]
    kind, end = fields[b"warc-type"], begin + n + 4
    named = fields.get(b"warc-block-digest", "")
    if named.startswith("sha1:"):
        if named[5:] != sha1_base32(block):
            raise Damage("block digest differs")
        vouched = True
    out = {"warc_type": kind, "record_id": fields.get(b"warc-record-id", "").strip("<>") or None, "target_uri": fields.get(b"warc-target-uri"), "refers_to": fields.get(b"warc-refers-to", "").strip("<>") or None}
    payload = block
    if fields.get(b"content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damage("HTTP header without end")
        if kind == "revisit" and (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)):
            out["payload_bytes"] = int(m[1])
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        out["payload_digest"] = digest
    else:
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": sha1_base32(payload)}
        if digest and digest != out["payload_digest"]:
            raise Damage("payload digest differs")
        vouched = vouched or bool(digest)
    if not vouched:
        raise Damage("no digest in a damaged member")
    return out, end


def _inflating(src: _Bytes, at: int):
    """Parts of the gzip member at ``at``, up to its end or damage; returns where that is, and what is wrong. zlib checks the CRC and the length."""
    z, pos, data, more = zlib.decompressobj(31), at, b"", False
    while not z.eof:
        if not data and not more:
            data = src.read(pos, _STEP)
            pos += len(data)
            if not data:
                return pos, "truncated member"
        before = z.copy()
        try:
            out = z.decompress(data, 1 << 20)
        except zlib.error:
            # once more, byte by byte, to keep all that stands before the damage
            for i in range(len(data)):
                try:
                    if part := before.decompress(data[i : i + 1]):
                        yield part
                except zlib.error:
                    return pos - len(data) + i + 1, "member does not inflate"
            return pos, "member does not inflate"
        data, more = z.unconsumed_tail, len(out) == 1 << 20
        if out:
            yield out
    return pos - len(z.unused_data), None


class _Member:
    """A file over the inflated bytes of a member. Seeking back a little is served from the last parts; further back it is inflated anew."""

    def __init__(self, src: _Bytes, begin: int):
        self.src, self.begin, self.size, self.kept = src, begin, 0, []
        self.end, self.damage = self._each(self._keep)
        self.kept = b"".join(self.kept) if self.kept is not None else None
        self.at, self.parts = 0, None

    def _each(self, take) -> tuple[int, str | None]:
        parts = _inflating(self.src, self.begin)
        while True:
            try:
                take(next(parts))
            except StopIteration as over:
                return over.value

    def _keep(self, part: bytes) -> None:
        self.size += len(part)
        if self.size > KEPT_BYTES:
            self.kept = None
        else:
            self.kept.append(part)

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        if self.kept is not None:
            return self.kept[self.at : self.at + n]
        if self.parts is None or self.at < self.base:
            self.parts, self.held, self.base = _inflating(self.src, self.begin), bytearray(), 0
        while self.base + len(self.held) < self.at + n and (part := next(self.parts, None)) is not None:
            self.held += part
            if (spare := min(self.at - self.base, len(self.held)) - (2 << 20)) > 0:
                del self.held[:spare]
                self.base += spare
        return bytes(self.held[self.at - self.base : self.at - self.base + n])


def _inside(member: _Member) -> Iterator[dict]:
    """Records and gaps of a member, by places in its inflated bytes. Without any record it is damage as a whole."""
    src, at, lost, why, found = _Bytes(member, member.size), 0, None, "", False
    while at < src.size:
        try:
            row, end = _record(src, at, member.damage is None)
        except Damage as e:
            if lost is None:
                lost, why = at, str(e)
            at = src.find((_VERSION,), at + 1)
            continue
        if lost is not None:
            yield {"kind": "gap", "inner_begin": lost, "inner_end": at, "reason": f"in member: {why}"}
            lost = None
        yield row | {"kind": "record", "inner_begin": at, "inner_end": end}
        found, at = True, end
    if not found and (why or member.damage):
        raise Damage(member.damage or why)
    if lost is not None or member.damage:
        yield {"kind": "gap", "inner_begin": src.size if lost is None else lost, "inner_end": src.size, "reason": f"in member: {member.damage or why}"}


def salvage(file, size: int) -> Iterator[dict]:
    """Records and gaps of one archive in order. A gap inside a member that gave records names the member and the inflated bytes."""
    src, at, lost, why = _Bytes(file, size), 0, None, ""
    plain_from = 0  # up to it, in a member that gave its records, only other members are searched for
    while at < size:
        held, member = [], None
        try:
            if src.read(at, 3) == _MAGIC:
                member = _Member(src, at)
                end, rows = member.end, _inside(member)
            elif src.read(at, len(_VERSION)) == _VERSION:
                row, end = _record(src, at)
                rows = iter([row | {"kind": "record"}])
            else:
                raise Damage("neither a member nor a version line")
            for row in rows:  # up to the first record, before which nothing is sure
                held.append(row)
                if row["kind"] == "record":
                    break
        except Damage as e:
            if lost is None:
                lost, why = max(at, plain_from), str(e)
            at = _next(src, at + 1, plain_from)
            continue
        if lost is not None and lost < at:
            yield {"kind": "gap", "begin": lost, "end": at, "reason": why}
        lost = None
        for rows_ in (held, rows):
            for row in rows_:
                yield row | {"begin": at, "end": end}
        if member is None or not member.damage:
            at = end
        else:  # the next member may begin before the place where the damage was noticed
            plain_from, lost, why = end, end, member.damage
            at = _next(src, at + 1, plain_from)
    if lost is not None and lost < size:
        yield {"kind": "gap", "begin": lost, "end": size, "reason": why}


def _next(src: _Bytes, at: int, plain_from: int) -> int:
    """Where the next member or version line may begin."""
    if at < plain_from and (hit := src.find((_MAGIC,), at)) < plain_from:
        return hit
    return src.find((_MAGIC, _VERSION), max(at, plain_from))


class _Memory:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        return self.data[self.at : self.at + n]


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows`` (record_id, uri, payload, refers_to; refers_to set means revisit) as .warc.gz files in ``folder``.

    Returns the manifest (path, records), itself a committed table: files of lost or repeated attempts are never listed.
    """

    def put(batches):
        import pandas as pd

        fs = root = out = None
        for pdf in batches:
            for record_id, uri, payload, refers_to in zip(pdf["record_id"], pdf["uri"], pdf["payload"], pdf["refers_to"], strict=True):
                if out is None:
                    if fs is None:
                        fs, root = opened(folder)
                        fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = record_bytes("revisit" if refers_to is not None else "response", record_id, uri or "", (payload or "").encode("utf-8", "surrogatepass"), refers_to)
                data = gzip_member(data)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= SHARD_BYTES:
                    out.close()
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    shipped(rows.sparkSession)
    return written(rows.select("record_id", "uri", "payload", "refers_to").mapInPandas(put, "path string, records long"), "warc-manifest")


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives named in column ``path``; RECORD_SCHEMA, kind record or gap."""
    names = [f.strip().split(" ")[0] for f in RECORD_SCHEMA.split(",")]

    def get(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                fs, name = opened(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for row in salvage(file, file.size()):
                        payload = row.get("payload") or b""
                        if not payloads:
                            row.pop("payload", None)
                            payload = b""
                        rows.append(row | {"path": path})
                        held += len(payload) + 200
                        if held >= 8 << 20:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    shipped(files.sparkSession)
    return files.select("path").mapInPandas(get, RECORD_SCHEMA)


def spread(files: DataFrame) -> DataFrame:
    """A task for each archive, up to MOST_TASKS; adaptive execution would join the few rows of a manifest into one task."""
    return files.repartitionByRange(max(1, min(files.count(), MOST_TASKS)), "path")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows for ``write_warc``: record_id, uri, payload, and refers_to where a row revisits an equal payload."""
    rows = picked(pages, id=id_col, uri=url_col, payload=payload_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("uri").cast("string").alias("uri"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    # only payloads that repeat are listed: partial aggregation first, then a join that adaptive execution may split at hot payloads
    repeated = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    joined = rows.join(repeated, "sha1", "left")
    return joined.select(name(F.col("id")).alias("record_id"), "uri", "payload", F.when((F.octet_length("payload") >= min_bytes) & (F.col("id") != F.col("first")), name(F.col("first"))).alias("refers_to"))


def page_archive(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC, read the archives back through the salvage reader, and return one row a page."""
    spark = pages.sparkSession
    files = write_warc(archived(pages), scratch(spark, "warc"))
    got = read_warc(spread(files), payloads=False).where("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as long)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), "target_uri")
