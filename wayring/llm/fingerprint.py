"""Document fingerprints (operator 4): a homomorphic multiset hash over paragraphs.

A paragraph (a non-empty line) is hashed to a wide vector of 1,024 lanes modulo 2**16, and its three-word
shingles are counted on 256 signed lanes of 64 bits.  A document's state is the lane-wise sum of both over its
paragraphs, so it does not depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its lanes (:func:`updated_state`, :func:`update_fingerprints`).  The fingerprint is the SHA-256 of
the state; the likeness of two fingerprints is the cosine of the states' signed lanes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayring.llm._words import LOWER, mix, released, spans, word_hash

LANES = 1024
LIKENESS_LANES = 256
#: Paragraphs whose vectors are held at once.
HASHED = 256


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def paragraph_sum(parts: Iterable[str]) -> np.ndarray:
    """Sum of the paragraphs' vectors modulo 2**16 per lane; each distinct one is hashed once, ``HASHED`` at a time."""
    counted = Counter(parts)
    distinct, total = iter(counted.items()), np.zeros(LANES, np.uint16)
    while some := list(islice(distinct, HASHED)):
        rows = np.frombuffer(b"".join(hashlib.shake_128(p.encode()).digest(2 * LANES) for p, _ in some), "<u2").reshape(-1, LANES)
        times = np.array([n & 0xFFFF for _, n in some], np.uint16)
        total += (rows * times[:, None]).sum(axis=0, dtype=np.uint16)
    return total


def edited_sum(vector: np.ndarray, old: list[str], new: list[str]) -> np.ndarray:
    """The vector after the paragraphs of ``old`` became those of ``new``: deletions and insertions only."""
    before, after = Counter(old), Counter(new)
    return vector - paragraph_sum((before - after).elements()) + paragraph_sum((after - before).elements())


def packed_state(vector: np.ndarray, lanes: np.ndarray) -> bytes:
    return vector.astype("<u2").tobytes() + lanes.astype("<i8").tobytes()


def digest(state: bytes) -> str:
    return hashlib.sha256(state).hexdigest()


def updated_state(state: bytes, removed: Sequence[str], added: Sequence[str]) -> bytes:
    """The state after paragraphs were removed and added, without the rest of the text."""
    vector, lanes = np.frombuffer(state, "<u2", LANES), np.frombuffer(state, "<i8", LIKENESS_LANES, 2 * LANES)
    change = likeness_vectors(["\n".join(removed), "\n".join(added)])
    return packed_state(vector - paragraph_sum(removed) + paragraph_sum(added), lanes - change[0] + change[1])


def likeness_vectors(texts: list[str]) -> np.ndarray:
    """Signed lanes of each text: its paragraphs' three-word shingles, or the words of shorter paragraphs."""
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    buf = LOWER[np.frombuffer(b"".join(data), np.uint8)]
    edges = np.unique(np.concatenate([offs, np.flatnonzero(buf == 10)]))
    starts, ends, first = spans(buf, edges)
    h = word_hash(buf, starts, ends)
    words = np.diff(first)
    owner = np.clip(np.searchsorted(offs, edges[:-1], "right") - 1, 0, len(texts) - 1) if len(edges) > 1 else np.zeros(0, int)
    paragraph = np.repeat(np.arange(len(words)), words)
    short = (words < 3)[paragraph]
    keys, docs = [h[short]], [owner[paragraph[short]]]
    if len(h) > 2:
        same = paragraph[2:] == paragraph[:-2]
        keys.append(mix((h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:-1]) * np.uint64(0x165667B19E3779F9) + h[2:])[same])
        docs.append(owner[paragraph[2:][same]])
    key, doc = np.concatenate(keys), np.concatenate(docs)
    lane = doc * LIKENESS_LANES + (key >> np.uint64(56)).astype(np.int64)
    sign = 1.0 - 2.0 * (key & np.uint64(1)).astype(float)
    return np.bincount(lane, weights=sign, minlength=len(texts) * LIKENESS_LANES).astype(np.int64).reshape(len(texts), LIKENESS_LANES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine, cut to 0..1; two all-zero rows are alike."""
    a, b = a.astype(float), b.astype(float)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    both_empty = ~a.any(1) & ~b.any(1)
    return np.where(both_empty, 1.0, np.clip((a * b).sum(1) / np.where(size > 0, size, 1.0), 0.0, 1.0))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _ranged(docs: DataFrame, rows_bytes: int) -> tuple[DataFrame, int]:
    """Rows (bucket, ghost, id, text): ranges of descending ids, each closed by a copy of the row that follows it.

    The cut points come from quantiles of the ids and number as the buckets do; so do the ghosts.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_bytes))
    cuts = np.array(sorted(set(docs.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else [], float)

    @F.pandas_udf("int")
    def bucket_of(ids):
        found = len(cuts) - np.searchsorted(cuts, ids.fillna(-np.inf).to_numpy(float), "right")
        return ids.__class__(np.where(ids.isna(), len(cuts) + 1, found)).astype("int32")

    bucketed = docs.withColumn("bucket", bucket_of(F.col("id")))
    # the first row of each bucket: its largest id and, among equal ids, the least text
    heads = docs.select("id").withColumn("bucket", bucket_of(F.col("id"))).groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()
    if not heads:
        return bucketed.withColumn("ghost", F.lit(False)), 1
    target = [(heads[k - 1].bucket, h.id) for k, h in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(target, "to_bucket int, head long"))
    ghosts = docs.join(wanted, F.col("id").eqNullSafe(F.col("head"))).groupBy("to_bucket").agg(F.first("head").alias("id"), F.min("text").alias("text"))
    rows = bucketed.select("bucket", F.lit(False).alias("ghost"), "id", "text").unionByName(ghosts.select(F.col("to_bucket").alias("bucket"), F.lit(True).alias("ghost"), "id", "text"))
    return rows, heads[-1].bucket + 1


def update_fingerprints(changes: DataFrame) -> DataFrame:
    """``changes`` (``doc_id, state, removed, added``, the last two arrays of paragraphs) with the new ``state`` and ``fingerprint``.

    Null arrays and null or empty paragraphs change nothing; a null state is that of an empty text; paragraphs
    removed must have been there, which a sum cannot tell.  Other columns are ignored; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = packed_state(paragraph_sum([]), np.zeros(LIKENESS_LANES))
        for batch in batches:
            states = []
            for state, *both in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                states.append(updated_state(state or empty, *([p for text in side or [] for p in paragraphs(text or "")] for side in both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.binary()), pa.array(map(digest, states), pa.string())], names=["doc_id", "state", "fingerprint"])

    rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "state", "removed", "added")
    return rows.mapInArrow(released(run), "doc_id long, state binary, fingerprint string")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 24 << 20, states: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edit by the next text in descending id order.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, and the
    updatable ``state`` of the text (4,096 bytes) if ``states``.  The texts are shuffled once, by range of ids.
    A very long text is one row, hashed whole.  A null text counts as empty; null ids come last; rows of equal id
    are ordered by text; a lone row follows itself.  Fingerprints of equal texts are equal, and so are those of
    texts whose paragraphs are permuted.  Other columns are ignored; an empty table gives an empty table.
    """

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["state"] if states else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                if waiting is not None:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                own = [k for k in range(len(rows) - 1) if not rows[k][0]]
                if not own:
                    continue
                texts = [r[2] for r in rows]
                edits = [edited_text(texts[k], texts[k + 1]) for k in own]
                lanes, edited_lanes = likeness_vectors(texts), likeness_vectors(edits)
                out: list[list] = [[], [], [], [], [], []]
                for k, edit in zip(own, edits, strict=True):
                    old, new = paragraphs(texts[k]), paragraphs(edit)
                    vector = paragraph_sum(old)
                    state = packed_state(vector, lanes[k])
                    new_state = packed_state(edited_sum(vector, old, new), edited_lanes[len(out[0])])
                    for column, value in zip(out, (rows[k][1], len(texts[k]), hashlib.sha256(edit.encode()).hexdigest(), digest(state), digest(new_state), state), strict=True):
                        column.append(value)
                index = np.array(own)
                near_edited = np.where(np.array(out[3]) == np.array(out[4]), 1.0, likeness(lanes[index], edited_lanes))
                near_next = likeness(lanes[index], lanes[index + 1])
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.string()) for c in out[2:5]), pa.array(near_edited), pa.array(near_next), *([pa.array(out[5], pa.binary())] if states else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    clean = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, parts = _ranged(clean, bucket_bytes)
    ordered = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.col("id").desc_nulls_last(), "text")
    return ordered.select("bucket", "ghost", "id", "text").mapInArrow(released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", state binary" * states)
