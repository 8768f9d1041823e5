"""Operator 2: media columns over content-addressed payloads in tar shards.

A payload becomes an 8-bit grey PNG of 64 columns. Each task appends the distinct media it meets to a tar shard of its own;
the index carries digest, shard, offset and length. A digest that several tasks stored is
served from its smallest (shard, offset). Metadata columns come from range reads of the first 33 bytes alone.

Defined cases: a null text is empty; an empty text becomes 64 zero bytes; repeated rows and equal texts share
one address and all values; an empty table gives no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.store import opened, picked, scratch, written
from shelfmark.runtime import shipped

WIDTH = 64
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
#: Bytes of media for a reading task, and of a shard that are read together.
TASK_BYTES, STRETCH_BYTES = 32 << 20, 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX_SCHEMA = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
FEATURE_SCHEMA = "digest string, shard string, offset long, length long, width long, height long, bit_depth int, colour int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes, to: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of ``to``."""
    return data + b"\0" * (-len(data) % to if data else to)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_bytes(payload: bytes, level: int = 5) -> bytes:
    """An 8-bit grey image, one byte a sample, WIDTH samples a row; lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def png_payload(data: bytes) -> bytes:
    """The samples of an image that ``png_bytes`` made."""
    head, at, parts = png_header(data), 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise ValueError("chunk CRC differs")
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(head["height"], head["width"] + 1)
    if raw[:, 0].any():
        raise ValueError("row filter other than none")
    return raw[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def feature_of(payload: bytes) -> str:
    """Mean, deviation, and the shares of sixteen equal bands of the samples, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"mean={x.mean():.3f};dev={x.std():.3f};bands=" + ",".join(map(str, bands))


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as a medium into tar shards in ``folder``; returns the index, one row a document (INDEX_SCHEMA).

    Within a shard a medium is stored once. The index is a committed table, so shards of lost attempts are never named.
    """

    def put(batches):
        import pandas as pd

        fs = root = out = None
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                key = hashlib.blake2b(data, digest_size=16).digest()
                if out is None:
                    if fs is None:
                        fs, root = opened(folder)
                        fs.create_dir(root, recursive=True)
                    name, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                if key not in known:
                    media = png_bytes(padded(data))
                    digest = hashlib.sha256(media).hexdigest()
                    out.write(tar_header(f"{digest}.png", len(media)) + media + b"\0" * (-len(media) % 512))
                    known[key] = digest, at + 512, len(media)
                    at += 512 + len(media) + -len(media) % 512
                digest, offset, length = known[key]
                rows.append((doc_id, len(data), digest, f"{folder}/{name}", offset, length))
                if at >= SHARD_BYTES:
                    out.write(b"\0" * 1024)
                    out.close()
                    out = None
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            yield frame.astype({"doc_id": "Int64"})
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    shipped(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInPandas(put, INDEX_SCHEMA), "media-index")


def addresses(index: DataFrame) -> DataFrame:
    """One (shard, offset, length) for each digest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")


def media_columns(where: DataFrame, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """FEATURE_SCHEMA for rows (digest, shard, offset, length), read by so many tasks.

    Metadata columns need the header's range only; without ``payloads`` nothing else is read and the other columns are null.
    """
    names = [f.strip().split(" ")[0] for f in FEATURE_SCHEMA.split(",")]

    def get(batches):
        import pandas as pd

        path = file = None
        for pdf in batches:
            rows = []
            for digest, shard, offset, length in zip(pdf["digest"], pdf["shard"], pdf["offset"], pdf["length"], strict=True):
                if shard != path:
                    if file is not None:
                        file.close()
                    fs, name = opened(shard)
                    path, file = shard, fs.open_input_file(name)
                row = {"digest": digest, "shard": shard.rsplit("/", 1)[-1], "offset": offset, "length": length} | png_header(file.read_at(HEADER_BYTES, offset))
                if payloads:
                    media = file.read_at(length, offset)
                    payload = png_payload(media)
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
                    row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(payload)}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names, dtype=object)
        if file is not None:
            file.close()

    spark = shipped(where.sparkSession)
    if tasks is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a stretch of a shard is read by one task, in order
    spread = where.repartition(max(1, tasks), "shard", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("shard", "offset")
    return spread.mapInPandas(get, FEATURE_SCHEMA)


def document_media(docs: DataFrame) -> DataFrame:
    """Every text stored, read back and described; one row a document, with digest, shard file, offset and length of its medium."""
    index = store_media(docs, scratch(docs.sparkSession, "media"))
    stored = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))
    got = media_columns(addresses(index), tasks=tasks).withColumn("feature", F.format_string("png;%dx%d;%d;%s", "width", "height", "bit_depth", "feature"))
    out = index.select("doc_id", "n_bytes", "digest").join(got, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length")
