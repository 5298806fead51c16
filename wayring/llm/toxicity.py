"""Toxicity (operator 2): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded, documented sample of labelled rows, dealt over a fixed number of shards.  Each
shard runs FTRL-proximal with per-coordinate rates and L1; the shards' states are averaged after each round
and the next round starts from the average.  Every n-gram of the sampled texts is learned from, however rare;
L1 keeps the weights sparse, so the model is a short list of (bucket, weight) pairs that is broadcast to score
every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.llm._io import discard, written
from wayring.llm._words import LOWER, NOT_ALNUM, mix, prefix_hash, slices, span_hash, spans, released, released_group


#: Buckets in one row (and file) of what a shard has learned, and files that the driver reads at once.
CHUNK, FILES = 1 << 17, 8


@dataclass(frozen=True)
class FtrlParams:
    """``sample_rows`` bounds the labelled rows used in training (the smallest id hashes are taken, an id once)."""

    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1
    shards: int = 4
    rounds: int = 4
    passes: int = 2
    sample_rows: int = 24_000
    skips: tuple[int, ...] = (2, 3)


def feature_buckets(buf: np.ndarray, offs: np.ndarray, params: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """Document index and bucket of each unigram, bigram, trigram and skip-gram, repeats included."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, offs, NOT_ALNUM)
    h = span_hash(prefix_hash(buf), starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shift = np.uint64(64 - params.bits)
    docs, keys = [doc], [h >> shift]
    for step, salt in [(1, 0x51), *((s, 0x60 + s) for s in params.skips)]:
        if len(h) > step:
            same = doc[step:] == doc[:-step]
            pair = mix(h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:] + np.uint64(salt))[same]
            docs.append(doc[:-step][same])
            keys.append(pair >> shift)
    if len(h) > 2:
        same = doc[2:] == doc[:-2]
        three = mix((h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:-1]) * np.uint64(0x165667B19E3779F9) + h[2:])[same]
        docs.append(doc[:-2][same])
        keys.append(three >> shift)
    return np.concatenate(docs), np.concatenate(keys).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Ascending int32 keys as the compressed byte planes of their gaps."""
    gaps = np.diff(keys, prepend=0).astype("<u4")
    return pa.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(keys) else b""


def unpacked(data: bytes, count: int) -> np.ndarray:
    """The ``count`` keys of :func:`packed`."""
    if not count:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int32)


def _weights(z: np.ndarray, n: np.ndarray, p: FtrlParams) -> np.ndarray:
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def ftrl_pass(rows: Iterable[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, p: FtrlParams) -> None:
    """One pass over the rows in their order; ``z`` and ``n`` change in place. The last coordinate is the bias."""
    bias = len(z) - 1
    for idx, y in zip(rows, labels, strict=True):
        zi, ni = z[idx], n[idx]
        w = _weights(zi, ni, p)
        wb = -z[bias] / ((p.beta + np.sqrt(n[bias])) / p.alpha)
        score = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
        g = score - y
        root = np.sqrt(ni + g * g)
        z[idx] = zi + g - (root - np.sqrt(ni)) / p.alpha * w
        n[idx] = ni + g * g
        sb = np.sqrt(n[bias] + g * g)
        z[bias] += g - (sb - np.sqrt(n[bias])) / p.alpha * wb
        n[bias] += g * g


def leading_numbers(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` partitions the least number that Spark's hash partitioning puts there."""
    numbers = spark.range(100 * parts).select(F.col("id").cast("int").alias("n"))
    found = numbers.groupBy(F.pmod(F.hash("n"), F.lit(parts)).alias("at")).agg(F.min("n").alias("n")).orderBy("at").collect()
    return [r["n"] for r in found]


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (buckets, values); bucket ``2**bits`` is the bias.

    Rows with a null id or label are left out; an id with several labels counts with its largest.  Without
    any labelled row the model is the bias 0.
    """
    spark = docs.sparkSession
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("double")).alias("__y"))
        .withColumn("__h", F.xxhash64("__id"))
        .orderBy("__h", "__id")
        .limit(params.sample_rows)
    )
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(picked), "__id").groupBy("__h", "__id", "__y").agg(F.min("__t").alias("__t"))
    # one partition a shard: a shard goes by a number whose hash leads there
    led = F.array(*map(F.lit, leading_numbers(spark, params.shards)))
    sample = sample.select(led[F.pmod("__h", F.lit(params.shards)).cast("int")].alias("shard"), "__h", "__id", "__y", "__t")

    def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, 4):
                doc, key = feature_buckets(buf, offs, params)
                both = np.unique(doc << 32 | key)
                cut = np.searchsorted(both >> 32, np.arange(len(offs)))
                flat = (both & 0xFFFFFFFF).astype(np.int32)
                x = pa.array([packed(flat[cut[k] : cut[k + 1]]) for k in range(len(offs) - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.diff(cut)), x], names=["shard", "h", "id", "y", "c", "x"])

    # kept by shard, so that a round deals no rows anew
    features = sample.mapInArrow(released(sample_features), "shard int, h long, id long, y double, c long, x binary").repartition(params.shards, "shard").persist(StorageLevel.DISK_ONLY)
    total = features.count()
    bias = 1 << params.bits
    z, n = np.zeros(bias + 1, np.float32), np.zeros(bias + 1, np.float32)
    for _ in range(params.rounds if total else 0):
        sent = spark.sparkContext.broadcast((z, n) if n.any() else None)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "id"])
            old_z, old_n = sent.value or (np.zeros(bias + 1, np.float32),) * 2
            z, n = old_z.astype(np.float64), old_n.astype(np.float64)
            for _ in range(params.passes):
                ftrl_pass(map(unpacked, pdf["x"], pdf["c"]), pdf["y"].to_numpy(), z, n, params)
            parts = []
            for first in range(0, bias + 1, CHUNK):
                k = first + np.flatnonzero(n[first : first + CHUNK] != old_n[first : first + CHUNK])
                if len(k):
                    parts.append((len(pdf), len(k), packed(k), *((new[k] - old[k]).astype(np.float32).tobytes() for new, old in ((z, old_z), (n, old_n)))))
            return pd.DataFrame(parts, columns=["rows", "c", "k", "z", "n"])

        # the driver adds up the shards' changes, a few files at a time; it holds two numbers for each of the 2**bits buckets, whatever the input
        changes = written(features.groupBy("shard").applyInPandas(released_group(fit), "rows long, c long, k binary, z binary, n binary"), "ftrl-changes", maxRecordsPerFile=1)
        files = sorted(changes.inputFiles())
        for k in range(0, len(files), FILES):
            for r in spark.read.schema(changes.schema).parquet(*files[k : k + FILES]).toLocalIterator():
                at = unpacked(r.k, r.c)
                z[at] += np.frombuffer(r.z, np.float32) * np.float32(r.rows / total)
                n[at] += np.frombuffer(r.n, np.float32) * np.float32(r.rows / total)
        discard(changes)
        sent.destroy()
    features.unpersist()
    kept = np.append(np.flatnonzero(np.abs(z[:-1]) > params.l1), bias)
    w = _weights(z[kept], n[kept], params)
    w[-1] = -z[-1] / ((params.beta + np.sqrt(n[-1])) / params.alpha)  # the bias has the largest key
    some = np.flatnonzero(w)
    return kept[some].astype(np.int32), w[some].astype(np.float32)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], params: FtrlParams = FtrlParams(), threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row; one Arrow pass, no shuffle.

    The score is the logistic of the bias plus the weights of the distinct buckets of the whole text; empty
    and null texts get the logistic of the bias.  Repeated rows are scored each, null ids stay null; a very long text is
    scored whole in one step; other columns, whatever their names, are ignored; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << params.bits) + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for part, buf, offs in slices(batch, 1):
                doc, key = feature_buckets(buf, offs, params)
                hit = dense[key] != 0
                both = np.unique(doc[hit] << 32 | key[hit])
                total = np.bincount(both >> 32, weights=dense[both & 0xFFFFFFFF], minlength=len(offs) - 1) + dense[-1]
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(released(run), "doc_id long, score double, predicted int")
