"""Media columns: content-addressed payloads in tar shards.

A payload is kept losslessly as an 8-bit PNG (rows of 64 RGB pixels, 192 bytes), the PNG as one member of a tar shard,
named by the payload's SHA-256. Rows carry digest, shard, offset and length; ``header_columns`` fills width, height, depth
and colour type from a range read of the first 33 bytes alone, and ``read_payloads`` reads whole members back.

A task writes each distinct payload of its rows once, into shards of its own: a retried or speculative attempt writes other
files, and only those named by the index (itself a written table) are ever read. ``catalog`` names one place per digest
for compaction across shards.

Defined results: null text is an empty payload; equal texts have equal digests, media and features; an empty table
gives an empty index; repeated rows share a member; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, fresh_path, materialize, slices, texts

ROW = 192
WIDTH = ROW // 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
CHUNK = 1 << 20
#: A shard is closed once it holds this many bytes; read tasks take ranges of about this size.
SHARD_BYTES = 64 << 20


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of a row."""
    return text + b" " * (-len(text) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    packed = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 1)
    parts = [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(media: bytes) -> bytes:
    width, height, depth, colour = png_header(media[:HEADER])
    if (width, depth, colour) != (WIDTH, 8, 2):
        raise ValueError("a PNG of 64 RGB pixels a row is expected")
    at, parts = HEADER, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Eight shares (per mille) of the sample values by their upper three bits, then mean and deviation in hundredths."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    shares = counts.reshape(8, 32).sum(1) * 1000 // n
    return ",".join(map(str, shares.tolist())) + f";{total * 100 // n};{int((max(n * squares - total * total, 0)) ** 0.5 * 100) // n}"


class ShardWriter:
    """Appends members to tar shards in a folder and tells where each one's bytes lie."""

    def __init__(self, folder: str):
        self.folder, self.shard, self.out, self.at = folder, "", None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            files, path = fs.FileSystem.from_uri(self.folder)
            files.create_dir(path, recursive=True)
            self.shard, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = files.open_output_stream(f"{path}/{self.shard}")
        info = tarfile.TarInfo(f"{name[:2]}/{name}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        place = self.at + len(head)
        block = head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)
        self.out.write(block)
        self.at += len(block)
        return self.shard, place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            self.out.close()
            self.out = None


INDEX = "digest string, shard string, offset long, length long, n_bytes long"


def store(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes every text's payload; returns the written index ``(id, digest, shard, offset, length, n_bytes)`` and the shards' folder."""
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    folder = fresh_path(spark, "media")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, places = ShardWriter(folder), {}
        try:
            for batch in slices(batches, "t"):
                rows = []
                for text in texts(batch, "t"):
                    payload = pad(text)
                    key = hashlib.sha256(payload).digest()
                    if key not in places:
                        media = encode_png(payload)
                        places[key] = (*writer.add(key.hex(), media), len(media))
                    shard, offset, length = places[key]
                    rows.append((key.hex(), shard, offset, length, len(text)))
                yield pa.RecordBatch.from_arrays([column(batch, "i"), *(pa.array(x) for x in zip(*rows, strict=True))], ["i", "digest", "shard", "offset", "length", "n_bytes"])
        finally:
            writer.close()

    index = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {id_type}, {INDEX}")
    return materialize(index, "media-index").withColumnRenamed("i", id_col), folder


def catalog(index: DataFrame) -> DataFrame:
    """One place for each digest: the least shard and offset that hold it."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def _by_place(index: DataFrame) -> DataFrame:
    """Rows dealt by shard range and sorted, so that each task reads a range of a shard once, forwards."""
    return index.withColumn("block", F.col("offset") / F.lit(SHARD_BYTES // 4)).withColumn("block", F.floor("block")).repartition("shard", "block").sortWithinPartitions("shard", "offset").drop("block")


def _ranged(index: DataFrame, folder: str, fields: str, names: list[str], read) -> DataFrame:
    """Adds columns that ``read(file, offset, length)`` gives; equal places in a row are read once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        opened, file, last, value = None, None, None, None
        for batch in batches:
            got = []
            for place in zip(*(column(batch, c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if place != last:
                    if place[0] != opened:
                        if file is not None:
                            file.close()
                        opened, file = place[0], files.open_input_file(f"{path}/{place[0]}")
                    value, last = read(file, *place[1:]), place
                got.append(value)
            cols = [pa.array(x) for x in zip(*got, strict=True)] if got else [pa.array([]) for _ in names]
            if got:
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return _by_place(index).mapInArrow(run, f"{schema}, {fields}")


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """Adds ``width, height, depth, colour`` from 33 bytes of each member."""
    return _ranged(index, folder, "width long, height long, depth long, colour long", ["width", "height", "depth", "colour"], lambda f, offset, length: png_header(f.read_at(HEADER, offset)))


def _measure(f, offset: int, length: int) -> tuple:
    media = f.read_at(length, offset)
    payload = decode_png(media)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))


MEASURED = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def measured_columns(index: DataFrame, folder: str) -> DataFrame:
    """Header columns from 33 bytes, then whole members read back: payload and media digests and sample feature."""
    return _ranged(header_columns(index, folder), folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", MEASURED, _measure)


def read_payload(folder: str, shard: str, offset: int, length: int) -> bytes:
    """One payload, by its place."""
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{path}/{shard}") as f:
        return decode_png(f.read_at(length, offset))


def as_tar(data: bytes) -> dict[str, bytes]:
    """Members of a shard's bytes, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
