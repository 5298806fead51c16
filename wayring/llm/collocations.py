"""Phrase collocation mining (operator 13): position bitmaps per word, extended depth-first.

A task gathers texts into shards.  Within a shard every word has a compressed bitmap of its positions: the 64-bit
blocks that are not zero.  A phrase's bitmap marks where its last word stands; shifted by one place and combined by
AND with a word's bitmap it is that of the longer phrase, and its popcount is the phrase's count in the shard.
Pieces are one free place apart, so nothing is extended beyond a piece.  Spark sums the counts over shards.

Three passes read the texts: words, pairs of frequent words, and longer phrases all of whose pairs are frequent.
What is frequent reaches the tasks as a Bloom filter of bounded size, which never drops a frequent one; what it lets
through in excess is counted and found rare.  Words are named by 64-bit hashes of language and word, whose
distinctness is checked on the table of all words; should two ever share a name, another seed is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayring.llm._io import discard, written
from wayring.llm._words import LOWER, mix, ragged, released, slices, spans, word_hash

#: Bytes of text of a shard, but for longer texts without a piece's end.
SHARD_BYTES = 12 << 20
#: Positions of the words at which one descent starts; a descent needs memory for as many.
DESCENT_POSITIONS = 1 << 20
#: Bits of a filter at most (16 MB), and for each member up to there.
FILTER_BITS, MEMBER_BITS = 1 << 27, 16
#: Parts of a language in which the best phrases are found before they meet.
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True
_CHAIN, _TURN = np.uint64(0x9FB21C651E98DF25), np.uint64(0x2545F4914F6CDD1D)


def language_hash(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)


class Shard:
    """Words of some texts by position: ``code`` numbers the shard's words, -1 where nothing stands."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, langs: np.ndarray, name_bits: int = 64) -> None:
        """``langs`` holds the hash of each text's language; names are of ``name_bits`` bits."""
        buf = LOWER[buf]
        start, end, first = spans(buf, offs, _SEPARATOR)
        owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        name = mix(word_hash(buf, start, end) * _CHAIN ^ langs.view(np.uint64)[owner])
        word, self.names = pd.factorize(name >> np.uint64(64 - name_bits))
        breaks = np.cumsum(_BREAK[buf], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int64)
        same = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
        at = np.arange(len(word)) + np.concatenate([[0], np.cumsum(~same)])[: len(word)]
        self.code = np.full(int(at[-1]) + 2 if len(at) else 1, -1, np.int32)
        self.code[at] = word
        one = np.empty(len(self.names), np.int64)
        one[word[::-1]] = np.arange(len(word))[::-1]
        self.lang, self.owner = langs[owner[one]], owner[one]
        self.count = np.bincount(word, minlength=len(one))
        self._buf, self._start, self._end = buf, start[one], end[one]

    def words(self) -> pa.Array:
        size = self._end - self._start
        flat = self._buf[ragged(self._start, size)]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.string())


def bits_of(block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the entry and position of every bit that is set."""
    entry, found = np.arange(len(mask)), []
    while len(entry):
        low = mask & (~mask + np.uint64(1))
        found.append((entry, block[entry] * 64 + np.bitwise_count(low - np.uint64(1))))
        mask = mask ^ low
        left = mask != 0
        entry, mask = entry[left], mask[left]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Bitmaps:
    """Compressed bitmaps of many sets: entries in order of set and block, masks not zero."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, mask: np.ndarray) -> None:
        self.owner, self.block, self.mask = owner, block, mask

    @classmethod
    def of(cls, owner: np.ndarray, place: np.ndarray) -> tuple[Bitmaps, np.ndarray]:
        """Bitmaps of the places of each owner, and which entry holds each of the places given."""
        if not len(place):
            return cls(owner, place, np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        width = int(place.max()) // 64 + 1
        key = owner.astype(np.int64) * width + place // 64
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        mask = np.bitwise_or.reduceat(np.uint64(1) << (place[order] % 64).astype(np.uint64), np.flatnonzero(begin))
        entry = np.empty(len(place), np.int64)
        entry[order] = np.cumsum(begin) - 1
        return cls(key[begin] // width, key[begin] % width, mask), entry

    def shifted(self) -> Bitmaps:
        """All sets one place on; a block's last bit moves into the next block."""
        over = np.flatnonzero(self.mask >> np.uint64(63))
        stay = self.mask << np.uint64(1)
        kept = np.flatnonzero(stay)
        owner = np.concatenate([self.owner[kept], self.owner[over]])
        block = np.concatenate([self.block[kept], self.block[over] + 1])
        mask = np.concatenate([stay[kept], np.ones(len(over), np.uint64)])
        if not len(over):
            return Bitmaps(owner, block, mask)
        key = owner * (int(block.max()) + 1) + block
        order = np.argsort(key, kind="stable")  # two runs in order: one merge
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return Bitmaps(owner[order][heads], block[order][heads], np.bitwise_or.reduceat(mask[order], heads))


def mined(shard: Shard, frequent: np.ndarray, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, longest: int, shortest: int = 2, positions: int = DESCENT_POSITIONS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases (words by row) of ``shortest`` to ``longest`` words and their counts in the shard.

    ``frequent`` marks the words that may stand in phrases, ``pairs`` tells which two neighbours may.  Descents start at
    words whose bitmaps together hold about ``positions`` places, so memory is bounded by those and the longest bitmap.
    """
    code = np.where((shard.code >= 0) & frequent[shard.code], shard.code, -1) if len(frequent) else shard.code
    following = np.zeros(len(code), bool)  # places whose word may follow the one before
    following[1:] = (code[1:] >= 0) & (code[:-1] >= 0)
    if pairs is not None:
        at = np.flatnonzero(following)
        following[at] = pairs(shard.names[code[at - 1]], shard.names[code[at]])
    place = np.flatnonzero(code >= 0)
    words, entry = Bitmaps.of(code[place], place)
    entry_at = np.full(len(code), -1, np.int32)
    entry_at[place] = entry
    del place, entry
    size = np.bincount(code[code >= 0], minlength=len(frequent))
    total = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, total[first] - size[first] + positions, "right")))
        a, z = np.searchsorted(words.owner, [first, last])
        phrases = np.arange(first, last)[:, None]
        grown = Bitmaps(words.owner[a:z] - first, words.block[a:z], words.mask[a:z])
        for length in range(2, longest + 1):
            phrases, counts, grown = _extended(phrases, grown, words, entry_at, following)
            if not len(counts):
                break
            if length >= shortest:
                yield phrases, counts
        first = last


def _extended(phrases: np.ndarray, bitmaps: Bitmaps, words: Bitmaps, entry_at: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
    """All phrases one word longer, their counts and bitmaps: shift, AND with the words that stand there, popcount."""
    shifted = bitmaps.shifted()
    source, place = bits_of(shifted.block, shifted.mask)
    fine = following[place]
    source, entry = source[fine], entry_at[place[fine]].astype(np.int64)
    if not len(entry):
        return phrases[:0], np.zeros(0, np.int64), shifted
    # entries of words are in order of word and block, so that these are in order of phrase, word and block
    key = np.unique(shifted.owner[source] * len(words.mask) + entry)
    owner, entry = key // len(words.mask), key % len(words.mask)
    block = words.block[entry]
    height = int(shifted.block.max()) + 1
    own = np.searchsorted(shifted.owner * height + shifted.block, owner * height + block)
    mask = shifted.mask[own] & words.mask[entry]
    word = words.owner[entry]
    begin = np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])
    heads = np.flatnonzero(begin)
    counts = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), heads)
    longer = np.concatenate([phrases[owner[heads]], word[heads, None]], axis=1)
    return longer, counts, Bitmaps(np.cumsum(begin) - 1, block, mask)


class Filter:
    """A Bloom filter over 64-bit keys with four probes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, len(bits) * 64

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return np.stack([(keys + np.uint64(j) * step) & np.uint64(size - 1) for j in range(4)]).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys, self.size):
            found &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _TURN ^ right)


def filter_of(table: DataFrame, *names: str, most_bits: int = FILTER_BITS) -> Filter:
    """A filter of all rows' names or pairs of names; at most ``most_bits`` pass through the driver, whatever the rows."""
    size = 1 << min(max(table.count() * MEMBER_BITS, 1 << 12).bit_length(), most_bits.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy().view(np.uint64) for k in range(len(names))]
            at = np.unique(Filter.places(columns[0] if len(columns) == 1 else pair_key(*columns), size))
            block = at >> 6
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else at
            if len(heads):
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), heads)
                yield pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(mask.view(np.int64))], names=["block", "mask"])

    merged = table.select(*names).mapInArrow(released(run), "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[merged["block"].to_numpy(np.int64)] = merged["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(bits)


def _cut(data: np.ndarray, most: int) -> list[int]:
    """Offsets that cut a long text behind the ends of pieces."""
    cuts, at = [0], most
    while at < len(data):
        found = np.flatnonzero(_BREAK[data[at : at + most]])
        if len(found):
            cuts.append(at + int(found[0]) + 1)
        at = cuts[-1] + most if len(found) else at + most
    return [*cuts, len(data)]


def shards(batches: Iterator[pa.RecordBatch], seed: int, shard_bytes: int, name_bits: int) -> Iterator[tuple[Shard, list[str]]]:
    """Shards of about ``shard_bytes`` and the languages of their texts, from batches of language and text."""
    hashes: dict[str, int] = {}
    parts: list[np.ndarray] = []
    langs: list[str] = []

    def built() -> tuple[Shard, list[str]]:
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        out = Shard(np.concatenate(parts), offs, np.array([hashes[x] for x in langs], np.int64), name_bits), list(langs)
        parts.clear()
        langs.clear()
        return out

    size = 0
    for batch in batches:
        for part, buf, offs in slices(batch, 1, shard_bytes):
            for lang, a, z in zip(part.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                if lang not in hashes:
                    hashes[lang] = language_hash(lang, seed)
                cuts = _cut(buf[a:z], shard_bytes) if z - a > shard_bytes else [0, z - a]
                for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                    parts.append(buf[a + b : a + e])
                    langs.append(lang)
                    size += e - b + 64
                    if size >= shard_bytes:
                        yield built()
                        size = 0
    if parts:
        yield built()


def _counting(*how: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, langs in shards(batches, *how):
            words, known = shard.words(), pa.array(langs)
            for at in range(0, len(words), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [known.take(pa.array(shard.owner[part])), pa.array(shard.lang[part]), words[part], pa.array(shard.names[part].view(np.int64)), pa.array(shard.count[part])],
                    names=["lang", "lang_name", "word", "name", "n"],
                )

    return run


def _mining(how: tuple[int, int, int], words, pairs, shortest: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(words.value)
        fine = Filter(pairs.value) if pairs is not None else None
        for shard, _ in shards(batches, *how):
            allowed = known(shard.names)
            test = (lambda a, b: fine(pair_key(a, b))) if fine is not None else None
            names = shard.names.view(np.int64)
            for phrases, counts in mined(shard, allowed, test, longest, shortest):
                for at in range(0, len(counts), 100_000):
                    part = phrases[at : at + 100_000]
                    columns = [pa.array(names[part[:, k]]) if k < part.shape[1] else pa.nulls(len(part), pa.int64()) for k in range(longest)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(shard.lang[part[:, 0]]), pa.array(counts[at : at + 100_000])], names=[*(f"w{k + 1}" for k in range(longest)), "lang_name", "n"])

    return run


def _best(rows: DataFrame, keep: int, *order: Column, name: str, ties: bool) -> DataFrame:
    """The first ``keep`` rows of each language, with their ranks; found in parts of a language first, so that no task orders one whole."""
    number = F.rank() if ties else F.row_number()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    parts = salted.withColumn(name, number.over(Window.partitionBy("lang_name", "salt").orderBy(*order))).where(F.col(name) <= keep)
    return parts.drop(name, "salt").withColumn(name, number.over(Window.partitionBy("lang_name").orderBy(*order))).where(F.col(name) <= keep)


def scored(phrases: DataFrame, longest: int, least: int) -> DataFrame:
    """Candidates with ``a, l, r, score`` of their lowest cut, those inside a longer one with most of its count left out.

    ``phrases`` has every phrase of 1 to ``longest`` words with at least ``least`` occurrences: ``lang_name, words, f``.
    The parts of a candidate occur at least as often as it does, so they are there.  Products are decimals of 38 digits.
    """
    candidates = phrases.where((F.size("words") > 1) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang_name", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    parts = phrases.where(F.size("words") < longest)
    with_l = cuts.join(parts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
    with_r = with_l.join(parts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = with_r.withColumn("score", score).groupBy("lang_name", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = candidates.where(F.size("words") > 2).withColumn("size", F.explode(F.expr("sequence(2, size(words) - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, size(words) - size + 1)")))
    inside = inner.groupBy(F.slice("words", F.col("at"), F.col("size")).alias("words")).agg(F.max("a").alias("longer"))
    mostly = F.expr("cast(100 as decimal(3,0)) * cast(longer as decimal(19,0)) >= cast(80 as decimal(2,0)) * cast(a as decimal(19,0))")
    kept = lowest.join(inside, "words", "left").where(F.col("longer").isNull() | ~mostly)
    return kept.select("lang_name", "words", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))


def collocations(docs: DataFrame, least: int = 30, keep: int = 2000, longest: int = 4, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES, name_bits: int = 64) -> DataFrame:
    """The first ``keep`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null text counts as empty, a null language is ``und``; repeated rows count each; other columns are ignored; an
    empty table gives an empty table, and so do languages without candidates.  Ties are broken by count, then by the
    phrase's bytes.  Texts beyond a shard are cut behind the end of a piece; memory grows with the longest piece only.
    """
    # fewer bits of a name only serve to test what happens when two words share one
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seed = 0
    while True:
        counted = texts.mapInArrow(released(_counting(seed, shard_bytes, name_bits)), "lang string, lang_name long, word string, name long, n long")
        words = written(counted.groupBy("lang", "lang_name", "word", "name").agg(F.sum("n").alias("f")), "collocation-words")
        languages = words.groupBy("lang", "lang_name").agg(F.sum("f").alias("n"))
        shared = words.groupBy("name").count().where("count > 1").limit(1).count() or languages.groupBy("lang_name").count().where("count > 1").limit(1).count()
        if not shared:
            break
        discard(words)
        seed += 1
    frequent = words.where(F.col("f") >= least)
    known = spark.sparkContext.broadcast(filter_of(frequent, "name").bits)
    mine = lambda pairs, shortest, long: texts.mapInArrow(
        released(_mining((seed, shard_bytes, name_bits), known, pairs, shortest, long)), ", ".join(f"w{k + 1} long" for k in range(long)) + ", lang_name long, n long"
    )
    merged = lambda rows, long: rows.groupBy(*(f"w{k + 1}" for k in range(long))).agg(F.min("lang_name").alias("lang_name"), F.sum("n").alias("f")).where(F.col("f") >= least)
    twos = written(merged(mine(None, 2, 2), 2), "collocation-pairs")
    phrases = frequent.select("lang_name", F.array("name").alias("words"), "f").unionByName(twos.select("lang_name", F.array("w1", "w2").alias("words"), "f"))
    if longest > 2:
        fine = spark.sparkContext.broadcast(filter_of(twos, "w1", "w2").bits)
        names = [f"w{k + 1}" for k in range(longest)]
        longer = written(merged(mine(fine, 3, longest), longest), "collocation-phrases")
        phrases = phrases.unionByName(longer.select("lang_name", F.array_compact(F.array(*names)).alias("words"), "f"))
    # by score and count first, with all ties; only phrases that are left need their letters
    first = _best(scored(phrases, longest, least), keep, F.col("score").desc(), F.col("a").desc(), name="rank", ties=True).drop("rank")
    spelled = first.select("words", F.posexplode("words").alias("at", "name")).join(frequent.select("name", "word"), "name")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = _best(first.join(spelled, "words"), keep, F.col("score").desc(), F.col("a").desc(), F.col("phrase"), name="rank", ties=False)
    named = ranked.join(languages, "lang_name")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
