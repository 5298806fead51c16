"""Language ID (operator 8): segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary, learned by expectation maximisation from a
bounded sample of labelled rows.  A word's probability is the sum over all its segmentations into pieces (the
forward algorithm), a text's the product over its words.  Words are scored once per slice of text, all
languages and all words of one length at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayring.llm._io import discard, written
from wayring.llm._words import LOWER, _powers, _BYTE, kept, mix, prefix_hash, ragged, slices, span_hash, spans, released

#: Words are scored with a space in front; longer ones are cut into stretches of so many bytes.
STRETCH = 40
#: A task keeps the scores of this many words at most; then it forgets them and goes on.
CACHE_WORDS = 800_000
#: Numbers in one table of partial sums or of kept scores; with more languages fewer words share one.
CELLS = 1 << 23


@dataclass(frozen=True)
class LanguageParams:
    """``sample_rows`` bounds the labelled rows per language that training reads (about; the smallest id hashes)."""

    sample_rows: int = 1500
    rounds: int = 3
    floor: float = 1e-7
    most_languages: int = 1000


class Vocabulary:
    """The pieces of a sentencepiece vocabulary as bytes, the space mark as 0x20, and a hash lookup for them."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = {bytes([b]) for b in range(256)}
        for k in range(sp.get_piece_size()):
            if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)):
                pieces.add(sp.id_to_piece(k).replace("▁", " ").encode())
        self.pieces = sorted(p for p in pieces if len(p) <= STRETCH)
        self.longest = max(map(len, self.pieces))
        joined = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces])
        hashes = span_hash(prefix_hash(joined), ends - np.array([len(p) for p in self.pieces]), ends)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[hashes >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are pieces, and the pieces' numbers."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
        k = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[k] == hashes[at]
        return at[hit], self.order[k[hit]]


def vocabulary(model: str) -> Vocabulary:
    return kept(Vocabulary, model)


def _edges(words: np.ndarray, vocab: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of every piece that occurs in a matrix of words of one length, by end."""
    n = words.shape[1]
    pows, inv = _powers(n + 1)
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(_BYTE[words] * pows[:n], axis=1, out=sums[:, 1:])
    for end in range(1, n + 1):
        for start in range(max(0, end - vocab.longest), end):
            rows, pieces = vocab.find(mix((sums[:, end] - sums[:, start]) * inv[start]))
            if len(rows):
                yield start, end, rows, pieces


def forward(words: np.ndarray, probs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Log probability of each word (rows of bytes of one length) in each language, over all segmentations."""
    n = words.shape[1]
    alpha = np.zeros((n + 1, len(words), probs.shape[1]))
    alpha[0] = 1.0
    for start, end, rows, pieces in _edges(words, vocab):
        alpha[end, rows] += alpha[start, rows] * probs[pieces]
    return np.log(np.maximum(alpha[n], 1e-300))


def expected_counts(words: np.ndarray, counts: np.ndarray, langs: np.ndarray, probs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected piece counts per language over all segmentations (forward and backward sums)."""
    n = words.shape[1]
    alpha = np.zeros((n + 1, len(words)))
    beta = np.zeros((n + 1, len(words)))
    alpha[0] = beta[n] = 1.0
    edges = [(s, e, rows, pieces, probs[pieces, langs[rows]]) for s, e, rows, pieces in _edges(words, vocab)]
    for s, e, rows, _, p in edges:
        alpha[e, rows] += alpha[s, rows] * p
    for s, e, rows, _, p in sorted(edges, key=lambda x: -x[0]):
        beta[s, rows] += beta[e, rows] * p
    scale = counts / np.maximum(alpha[n], 1e-300)
    at = [np.zeros(0, np.int64), *(pieces * probs.shape[1] + langs[rows] for _, _, rows, pieces, _ in edges)]
    weights = [np.zeros(0), *(alpha[s, rows] * p * beta[e, rows] * scale[rows] for s, e, rows, _, p in edges)]
    return np.bincount(np.concatenate(at), weights=np.concatenate(weights), minlength=probs.size).reshape(probs.shape)


def _stretches(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, length and document of each word; long words in stretches."""
    starts, ends, first = spans(buf, offs)
    lengths = ends - starts
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    if len(lengths) and lengths.max() >= STRETCH:
        n = -(-lengths // (STRETCH - 1))
        part = ragged(np.zeros(len(n), np.int64), n)
        starts = np.repeat(starts, n) + part * (STRETCH - 1)
        ends = np.minimum(starts + STRETCH - 1, np.repeat(ends, n))
        lengths, doc = ends - starts, np.repeat(doc, n)
    return span_hash(prefix_hash(buf), starts, ends), starts, lengths, doc


def _matrix(buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.full((len(starts), n + 1), 32, np.uint8)
    out[:, 1:] = buf[starts[:, None] + np.arange(n)]
    return out


def train(docs: DataFrame, model: str, params: LanguageParams = LanguageParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces by languages), from rows with a non-null language.

    Null ids and texts are left out.  Without any labelled row there is no language.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    per_lang = known.groupBy("lang").count().limit(params.most_languages + 1).collect()
    if len(per_lang) > params.most_languages:
        raise ValueError(f"more than {params.most_languages} languages")
    langs = sorted(r.lang for r in per_lang)
    vocab = vocabulary(model)
    if not langs:
        return [], np.zeros((len(vocab.pieces), 0))
    share = F.broadcast(spark.createDataFrame([(r.lang, langs.index(r.lang), min(1.0, params.sample_rows / r["count"])) for r in per_lang], "lang string, k int, share double"))
    sample = known.join(share, "lang").where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # an id enters once, however often it is repeated
    sample = sample.groupBy("k", "id").agg(F.min("text").alias("text")).select("k", "text")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, 1):
                buf = LOWER[buf]
                h, starts, lengths, doc = _stretches(buf, offs)
                k = part.column(0).to_numpy()[doc].astype(np.uint64) if len(doc) else np.zeros(0, np.uint64)
                _, at, counts = np.unique(h * np.uint64(params.most_languages * 2 + 1) + k, return_index=True, return_counts=True)
                words = [buf[s : s + n].tobytes() for s, n in zip(starts[at], lengths[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k[at].astype(np.int32)), pa.array(words, pa.binary()), pa.array(counts.astype(np.int64))], names=["k", "word", "n"])

    words = written(sample.mapInArrow(released(words_of), "k int, word binary, n long").groupBy("k", "word").agg(F.sum("n").alias("n")), "lang-words")
    sizes = np.array([len(p) for p in vocab.pieces], float)
    probs = np.repeat((np.exp(-sizes) / np.exp(-sizes).sum())[:, None], len(langs), axis=1)
    for _ in range(params.rounds):
        sent = spark.sparkContext.broadcast(probs.astype(np.float32))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, p = vocabulary(model), sent.value.astype(float)
            total = np.zeros(p.shape)
            for pdf in batches:
                length = pdf["word"].str.len()
                for n, rows in pdf.groupby(length):
                    for at in range(0, len(rows), 20_000):
                        some = rows.iloc[at : at + 20_000]
                        m = np.full((len(some), n + 1), 32, np.uint8)
                        m[:, 1:] = np.frombuffer(b"".join(some["word"]), np.uint8).reshape(len(some), n)
                        total += expected_counts(m, some["n"].to_numpy(float), some["k"].to_numpy(), p, own)
            seen, k = np.nonzero(total)
            yield pd.DataFrame({"piece": seen.astype(np.int32), "k": k.astype(np.int32), "n": total[seen, k]})

        # at most one row for each piece and language comes back
        found = words.coalesce(max(8, len(langs), spark.sparkContext.defaultParallelism)).mapInPandas(released(count), "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(probs.shape)
        counts[found["piece"], found["k"]] = found["n"]
        probs = counts / np.maximum(counts.sum(0), 1e-300) * (1 - params.floor * len(counts)) + params.floor
        sent.unpersist()
    discard(words)
    return langs, probs.astype(np.float32)


def predict(docs: DataFrame, trained: tuple[list[str], np.ndarray], model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, with the columns of ``keep`` after them; no shuffle.

    The score is the predicted language's share of the likelihood.  ``und`` with score 0 is for null texts,
    texts without a letter, and any text if no language was learned.  Equal likelihoods go to the first language by
    name.  Repeated rows are predicted each, null ids stay null; a very long text is scored whole, word by word; columns
    other than those of ``keep``, whatever their names, are ignored; an empty table gives an empty table.
    """
    langs, probs = trained
    sent = docs.sparkSession.sparkContext.broadcast(probs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)))
    types = dict(source.dtypes)
    schema = "doc_id long, lang_pred string, score double" + "".join(f", k{n} {types[f'k{n}']}" for n in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = vocabulary(model), sent.value.astype(float)
        known, scores = np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)
        for batch in batches:
            for part, buf, offs in slices(batch, 1):
                buf = LOWER[buf]
                h, starts, lengths, doc = _stretches(buf, offs)
                distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                if len(known) + len(distinct) > min(CACHE_WORDS, CELLS // max(1, len(langs))):
                    known, scores = np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)
                at = np.searchsorted(known, distinct)
                new = np.ones(len(distinct), bool)
                if len(known):
                    new = known[np.minimum(at, len(known) - 1)] != distinct
                fresh = np.zeros((int(new.sum()), len(langs)), np.float32)
                size, place = lengths[first[new]], starts[first[new]]
                for n in np.unique(size):
                    same = np.flatnonzero(size == n)
                    block = max(1, min(20_000, CELLS // ((n + 2) * max(1, len(langs)))))
                    for a in range(0, len(same), block):
                        some = same[a : a + block]
                        fresh[some] = forward(_matrix(buf, place[some], n), p, vocab)
                known = np.insert(known, at[new], distinct[new])
                scores = np.insert(scores, at[new], fresh, axis=0)
                each = scores[np.searchsorted(known, distinct)][inverse]
                rows = len(offs) - 1
                total = np.stack([np.bincount(doc, weights=each[:, k], minlength=rows) for k in range(len(langs))], axis=1) if langs else np.zeros((rows, 0))
                letters = part.column(2).to_numpy(zero_copy_only=False)
                if langs:
                    best = total.argmax(1)
                    share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    names = np.where(letters, np.array(langs, object)[best], "und")
                    share = np.where(letters, share, 0.0)
                else:
                    names, share = np.full(rows, "und", object), np.zeros(rows)
                out = [part.column(0), pa.array(names, pa.string()), pa.array(share), *(part.column(3 + n) for n in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", *(f"k{n}" for n in range(len(keep)))])

    return source.mapInArrow(released(run), schema).withColumnsRenamed({f"k{n}": c for n, c in enumerate(keep)}) if keep else source.mapInArrow(released(run), schema)
