"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG of 64 samples a line. Each task of the
scan writes its own tar shard, whose members are named by the payload's SHA-256 and follow each
other in scan order; a payload that stands again in a task is stored once. Rows carry digest, shard,
offset and length of the PNG, so payloads never go through a shuffle. Copies in different tasks are stored once a task (at
most as often as there are tasks); ``places`` picks one location for each digest, which all rows of it share and every read uses.
``metadata`` fills the metadata columns from range reads of the first 33 bytes alone (signature and IHDR); ``load`` reads a
member's range, decodes it and computes features, once for each digest; ``described`` gives the rows what was found for their digest.

A shard is written under a temporary name and moved when whole; a task that runs again writes the same
bytes. The index is written before it is read, so no shard is read that is not whole.

Defined cases: a null text is an empty one; an empty text is 64 zero bytes; repeated rows share one member;
an empty table writes nothing; a very long text is one member; of several locations the least by shard and offset is taken; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _store
from factloom.llm._common import join_groups, map_arrow, materialise, scratch

LINE = 64
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % LINE if raw else LINE)


def encode(data: bytes) -> bytes:
    """A PNG with one sample a byte, ``LINE`` samples a line, no line filter."""
    lines = np.zeros((len(data) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode(data: bytes) -> bytes:
    width, height, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that this store does not write")
    return lines[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Sizes and integer statistics of the samples, and a 64-bit mark of the columns above the mean."""
    x = np.frombuffer(data, np.uint8)
    columns = x.reshape(-1, LINE).sum(0, dtype=np.int64)
    bits = sum(1 << k for k in range(LINE) if int(columns[k]) * LINE > int(columns.sum()))
    counts = np.bincount(x, minlength=256)
    return f"{LINE}x{len(x) // LINE};min={int(x.min())};max={int(x.max())};sum={int(x.sum(dtype=np.int64))};distinct={int((counts > 0).sum())};mark={bits:016x}"


def _member(name: str, data: bytes) -> tuple[bytes, bytes]:
    """A tar header, and the padding after the data."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.USTAR_FORMAT), bytes(-len(data) % 512)


def _writer(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, out, name, stored = TaskContext.get().partitionId(), 0, None, "", {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py()
                data = payload(raw)
                key = hashlib.sha256(data).digest()
                if out is not None and out.at >= shard_bytes:
                    out.write(bytes(1024))
                    out.close()
                    out, k, stored = None, k + 1, {}
                if out is None:
                    name = f"shard-{task:06d}-{k:04d}.tar"
                    out = _store.Writer(folder, name)
                if key not in stored:
                    png = encode(data)
                    head, tail = _member(f"{key.hex()}.png", png)
                    out.write(head)
                    stored[key] = (out.write(png), len(png))
                    out.write(tail)
                rows.append((doc.as_py(), len(raw or b""), key.hex(), name, *stored[key]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return run


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Write the shards; (the index: doc_id, n_bytes, digest, shard, offset, length; the folder)."""
    folder = folder or scratch(docs.sparkSession, "media")
    _store.make(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(map_arrow(rows, _writer(folder, shard_bytes), INDEX), "media-index"), folder


def places(index: DataFrame) -> DataFrame:
    """One location for each digest, and its number of rows: digest, shard, offset, length, n_rows."""
    found = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_at"), F.count(F.lit(1)).alias("n_rows"))
    return materialise(found.select("digest", "_at.shard", "_at.offset", "_at.length", "n_rows"), "media-places")


def described(index: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the index (doc_id, n_bytes) with their digest's columns of ``found`` (places, with more columns)."""
    return join_groups(index.select("doc_id", "n_bytes", "digest"), found, ["digest"], "n_rows", index.count())


def _ranges(index: DataFrame) -> DataFrame:
    """Rows of one shard's stretch together and in order, so that a task reads forward."""
    spark = index.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.rdd.getNumPartitions())
    stretch = F.expr(f"offset div {16 << 20}")
    return index.repartition(n, "shard", stretch).sortWithinPartitions("shard", "offset")


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index (or places) with width, height and bits, from header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _store.Reader(folder)
        for batch in batches:
            at = batch.schema.get_field_index
            found = [header(reader.read(s.as_py(), o.as_py(), HEADER_BYTES)) for s, o in zip(batch.column(at("shard")), batch.column(at("offset")), strict=True)]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in cols)], names=[*batch.schema.names, "width", "height", "bits"])
        reader.close()

    return map_arrow(_ranges(index), run, f"{_columns(index)}, width int, height int, bits int")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def load(index: DataFrame, folder: str) -> DataFrame:
    """The index (or places) with payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _store.Reader(folder)
        last, value = None, None
        for batch in batches:
            at, rows = batch.schema.get_field_index, []
            for s, o, n in zip(batch.column(at("shard")), batch.column(at("offset")), batch.column(at("length")), strict=True):
                place = (s.as_py(), o.as_py(), n.as_py())
                if place != last:  # rows of one member follow each other
                    media = reader.read(*place)
                    data = decode(media)
                    last, value = place, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), hashlib.sha256(media).hexdigest(), feature(data))
                rows.append(value)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*batch.schema.names, *names])
        reader.close()

    return map_arrow(_ranges(index), run, f"{_columns(index)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")
