"""Media columns (operator 10): content-addressed payloads in tar shards.

Each payload is stored as an 8-bit grey PNG in a tar shard of the shared folder; rows carry its digest, shard,
offset and length.  Image metadata is filled from reads of the header bytes alone; features come from a later
read of the stored bytes, never from the source.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayring.llm._io import new_path, written
from wayring.llm._words import released

#: Samples in a row of the stored image; payloads are padded to a multiple.
WIDTH = 64
#: Bytes of a tar shard after which a task begins another.
SHARD_BYTES = 64 << 20
#: Signature, length, type and the 13 bytes of the image header with its checksum.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``WIDTH``."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image, one sample per payload byte, ``WIDTH`` samples a row, no filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first bytes alone."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", data[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Eight-bin histogram, mean, deviation and sign changes about the mean of the samples."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x >> 5, minlength=8)
    high = x > x.mean()
    return "h=" + ",".join(map(str, hist)) + f";mean={x.mean():.4f};std={x.std():.4f};zc={int((high[1:] != high[:-1]).sum())}"


class _ShardWriter:
    """A tar file at a URI; ``add`` returns where the member's data lie."""

    def __init__(self, folder: str) -> None:
        self.name = f"{uuid.uuid4().hex}.tar"
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.stream = fs.open_output_stream(f"{path}/{self.name}")
        self.at = 0
        self.seen: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            block = info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % 512)
            self.stream.write(block)
            self.seen[digest] = (self.at + 512, len(data))
            self.at += len(block)
        return self.seen[digest]

    def close(self) -> None:
        self.stream.write(b"\0" * 1024)
        self.stream.close()


def store_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's padded payload into tar shards under ``folder``; ``doc_id, n_bytes, digest, shard, offset, length``.

    A shard holds each content once.  Shards carry names of their own, so a task that is run again leaves the
    rows of its last attempt and at most an unused file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _ShardWriter | None = None
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode()
                    payload = padded(data)
                    digest = hashlib.sha256(payload).hexdigest()
                    if shard is None:
                        shard = _ShardWriter(folder)
                    offset, length = shard.add(digest, b"") if digest in shard.seen else shard.add(digest, encode_png(payload))
                    rows.append((len(data), digest, shard.name, offset, length))
                    if shard.at >= SHARD_BYTES:
                        shard.close()
                        shard = None
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(released(run), "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def _ranges(folder: str, batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    fs, path = pafs.FileSystem.from_uri(folder)
    name, file = None, None
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            found = []
            for shard, offset, length in zip(part.column("shard").to_pylist(), part.column("offset").to_pylist(), part.column("length").to_pylist(), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{path}/{shard}")
                found.append(file.read_at(length if whole else min(length, HEADER_BYTES), offset))
            yield part, found
    if file is not None:
        file.close()


#: Stored bytes that one range of the index stands for, about.
READ_BYTES = 16 << 20


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """``index`` rows with ``width, height, bits``, from reads of ``HEADER_BYTES`` bytes at each offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _ranges(folder, batches, whole=False):
            columns = list(zip(*map(png_header, found), strict=True))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.int32()) for c in columns)], names=[*part.schema.names, "width", "height", "bits"])

    kinds = ", ".join(f"{n} {t}" for n, t in index.dtypes)
    return index.mapInArrow(released(run), f"{kinds}, width int, height int, bits int")


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Per stored content: payload size and digest as read back, the checksum of its tail, the stored form's digest, a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _ranges(folder, batches, whole=True):
            rows = []
            for data in found:
                payload = decode_png(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("digest"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return index.mapInArrow(released(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media rows of every text: stored, located, described by header reads, and read back for features.

    Columns: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    shard, offset, length, width, height, bits``.  A null text is an empty payload of one padded row.  Equal
    texts share one stored content, the first by shard and offset.  Null ids and repeated rows are kept; other
    columns are ignored; an empty table gives an empty table; a very long text is one payload.  ``folder`` must be a URI or path that every
    executor reaches; by default it lies in the shared checkpoint folder.
    """
    folder = folder or new_path(docs.sparkSession, "media")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    index = written(store_payloads(docs, folder, id_col, text_col), "media-index")
    places = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")
    # as many ranges as the stored bytes ask for; the index itself is far smaller than what its rows make a task read
    stored = index.agg(F.sum("length")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(stored // READ_BYTES) + 1)
    ordered = written(places.repartitionByRange(ranges, "shard", "offset").sortWithinPartitions("shard", "offset"), "media-places")
    described = fill_metadata(ordered, folder).join(read_features(ordered, folder), "digest")
    return index.select("doc_id", "n_bytes", "digest").join(described, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "bits"
    )
