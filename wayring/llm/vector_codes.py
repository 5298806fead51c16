"""Vector code compression (operator 12): product quantization in integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that starts as
the parts of the vectors with the least ids.  The codebooks are broadcast; tasks compute all squared distances of a
block of vectors as ``|x|^2 - 2 x.c + |c|^2`` with exact int64 matrix products and take the first least one.  Each
round, tasks send sums and counts per entry, which one grouped shuffle merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayring.llm._io import written
from wayring.llm._words import released

#: Vectors of one matrix product.
BLOCK_ROWS = 2048
#: Labels whose sums are broadcast at most; beyond, the sums meet the rows in a salted join.
BROADCAST_LABELS = 100_000
#: Parts into which the rows of a label fall in that join.
SALTS = 64


def integer_rows(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that are kept and their components as integers, one row each.

    Null and empty vectors and those with null, infinite or NaN components are dropped; the others must agree in size.
    """
    column = column.cast(pa.large_list(column.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # without the items of null lists
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(sizes > 0)
    if not len(kept):
        return kept, np.zeros((0, 0), np.int64)
    finite = np.logical_and.reduceat(np.isfinite(values), (np.cumsum(sizes) - sizes)[kept])
    values = values[np.repeat(finite, sizes[kept])]
    kept = kept[finite]
    if len(np.unique(sizes[kept])) > 1:
        raise ValueError("vectors of different sizes have no common codebook")
    scaled = np.floor(values * scale).reshape(len(kept), -1)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component is beyond 64-bit integers")
    return kept, scaled.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of equal ones, and the squared distance.

    Sums stay below ``4 n m^2`` for ``n`` components of at most ``m``; where that may pass 64 bits, rows are computed
    with Python's integers, which have no bound.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most >= 1 << 63:
        x, entries = x.astype(object), entries.astype(object)
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]
    index = squares.argmin(axis=1)
    return index, squares[np.arange(len(x)), index]


class Codebooks:
    """The entries of all parts: an array of parts by entries by components."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries

    @classmethod
    def first(cls, rows: np.ndarray, parts: int) -> Codebooks:
        if rows.shape[1] % parts:
            raise ValueError(f"vectors of {rows.shape[1]} components have no {parts} equal parts")
        return cls(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy())

    def assigned(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each row's parts (rows by parts) and the summed squared distance."""
        parts, _, width = self.entries.shape
        if rows.shape[1] != parts * width:
            raise ValueError("vectors of different sizes have no common codebook")
        found = [nearest(rows[:, p * width : (p + 1) * width], self.entries[p]) for p in range(parts)]
        return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            kept, rows = integer_rows(part.column(0), scale)
            if len(kept):
                yield part, kept, rows


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors; ``None`` without any vector.

    The first entries are those of the rows with the least ids (null ids last, rows of one id by vector); fewer
    vectors make fewer entries.  Only codebooks pass through the driver: ``parts`` times ``entries`` rows.
    """
    column = F.col(vector_col)
    usable = column.isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    least = vectors.where(usable).select(F.col(id_col).alias("id"), column.alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not least:
        return None
    books = Codebooks.first(integer_rows(pa.array([r.v for r in least], pa.list_(pa.float64())), scale)[1], parts)
    names = [f"s{k}" for k in range(books.entries.shape[2])]
    schema = "part int, entry int, n long, " + ", ".join(f"{name} decimal(38,0)" for name in names)
    kinds = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *((name, pa.decimal128(38, 0)) for name in names)])
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
        merged = vectors.select(vector_col).mapInArrow(released(_summing(shared, scale, kinds)), schema).groupBy("part", "entry")
        for row in merged.agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in names)).collect():
            books.entries[row.part, row.entry] = [int(row[name]) // row.n for name in names]
        shared.destroy()
    return books


def _summing(shared, scale: int, kinds: pa.Schema):
    """Sums and counts per entry over all vectors of a task; sums of a block are flushed into unbounded integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(shared.value)
        parts, entries, width = books.entries.shape
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        waiting, room = np.zeros((parts * entries, width), np.int64), 1 << 62
        for _, _, rows in _blocks(batches, scale):
            index, _ = books.assigned(rows)
            most = int(np.abs(rows).max(initial=0)) * len(rows)
            if most >= 1 << 62:
                rows = rows.astype(object)
                sums = sums + waiting
                waiting, room = np.zeros_like(waiting), 1 << 62
            elif most > room:
                sums = sums + waiting
                waiting, room = np.zeros_like(waiting), 1 << 62
            slot = (index + np.arange(parts) * entries).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            into = sums if rows.dtype == object else waiting
            np.add.at(into, slot, rows.reshape(-1, width))
            room -= min(most, room)
        sums = sums + waiting
        used = np.flatnonzero(counts)
        columns = [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(counts[used])]
        columns += [pa.array(map(Decimal, sums[used, k].tolist()), pa.decimal128(38, 0)) for k in range(width)]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return run


def encode_vectors(vectors: DataFrame, books: Codebooks, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, code, error`` of every vector that is kept: entry indexes as two hex digits each, summed distances.

    No shuffle.  More than 256 entries, which two digits cannot name, are refused, and so are errors beyond 64 bits.
    """
    if books.entries.shape[1] > 256:
        raise ValueError("a code of two hex digits names 256 entries at most")
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codebooks(shared.value)
        for part, kept, rows in _blocks(batches, scale):
            index, error = known.assigned(rows)
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            rest = [part.column(k).take(pa.array(kept)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([rest[0].cast(pa.int64()), rest[1], pa.array(codes, pa.string()), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    rows = vectors.select(F.col(vector_col).alias("v"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"vec_id long, label {kind}, code string, error long")


def with_label_errors(coded: DataFrame, most_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` and the error summed over equal labels, nulls together.

    Sums are merged before their shuffle.  Up to ``most_labels`` of them are broadcast; more meet the rows in a join
    over label and salt, so that no label's rows are of one task.
    """
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= most_labels:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = coded.withColumn("salt", F.pmod(F.hash("vec_id", "code"), F.lit(SALTS)))
    spread = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that is kept.

    Dropped are null and empty vectors and those with null or non-finite components; ids may be null or repeated, each
    row has its code; equal distances go to the lower entry; vectors of different sizes, or of a size that ``parts`` does
    not divide, are refused; results beyond 64 bits raise an error; other columns are ignored; without any vector the
    result is empty.  The codes are written once to the shared folder, where sums of labels and the result read them.
    """
    books = train(vectors, parts, entries, rounds, scale, id_col, vector_col)
    if books is None:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    coded = written(encode_vectors(vectors, books, scale, id_col, vector_col, label_col), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
