"""Packing (operator 9): hierarchical multi-length packing.

Token streams are cut into windows of several context sizes.  Texts beyond the longest window fill whole
windows; every rest goes to the smallest tier that holds it.  Tiers are packed from the longest down: a window
takes one text of its tier, then the largest texts of shorter tiers that fit its gap, then the head of a short
text for what remains.  Windows of one tier form step groups of equal tokens.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayring.llm._words import LOWER, SPACE, kept, ragged, released, slices, spans, word_hash

TIERS = (4096, 2048, 1024, 512)
#: Tokens packed together at most before the rest waits for the next texts of the task.
GROUP_TOKENS = 2_000_000
#: Tokens of a step group: so many windows of a tier as make this many tokens.
STEP_TOKENS = 32_768
#: Slots of the table of known units; it is emptied when half full.
TABLE_SLOTS = 1 << 21


def _tokenizer(path: str):
    return kept(_load_tokenizer, path)


def _load_tokenizer(path: str):
    # tasks share the cores already; a pool of threads in each would only cost time
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _word_ends(path: str) -> np.ndarray:
    return kept(_find_word_ends, path)


def _find_word_ends(path: str) -> np.ndarray:
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return out


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words in some order, and where each word's ids start and how many they are.

    Words of letters alone are encoded many to a text: each has exactly one id that ends a word, so the ids fall
    apart again at those.  Should their number differ in a text, and for all other words, each is encoded alone.
    """
    letters = np.fromiter(map(str.isalpha, words), bool, len(words))
    joined, alone = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
    encode, ends = _tokenizer(path).encode_batch_fast, _word_ends(path)
    groups = np.split(joined, range(1000, len(joined), 1000)) if len(joined) else []
    flat, order, sizes = [], [], []
    for at in range(0, len(groups), 16):
        some = groups[at : at + 16]
        for group, found in zip(some, encode([" ".join([words[k] for k in g]) for g in some], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cut = np.flatnonzero(ends[ids]) + 1
            if len(cut) == len(group):
                flat.append(ids)
                order.append(group)
                sizes.append(np.diff(cut, prepend=0))
            else:
                alone += group.tolist()
    if alone:
        found = [e.ids for e in encode([words[k] for k in alone], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        flat.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes[-1].sum())))
        order.append(np.array(alone))
    place, each = np.concatenate(order), np.concatenate(sizes)
    start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    start[place], size[place] = np.cumsum(each) - each, each
    return np.concatenate(flat), start, size


_PUNCTUATION, _LETTER, _DIGIT, _WHOLE = range(4)
_KINDS = np.array([_WHOLE if b > 127 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _PUNCTUATION for b in range(256)], np.uint8)


def units(buf: np.ndarray, offs: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts and ends of the units of all words, and the index of each text's first unit.

    Words are cut where the tokenizer always begins a new token: between letters, single digits and other signs,
    but not behind an apostrophe, which may begin a contraction.  Letters are those of ASCII and of U+00C0 to
    U+023F.  Words with other characters, or with a byte of ``special`` (which may begin an added token), are
    kept whole and as they are, since normalization may join or change their characters.
    """
    starts, ends, _ = spans(buf, offs)
    kinds = _KINDS[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC8))
    if len(lead):
        pair = buf[lead].astype(np.int32) << 8 | buf[lead + 1]
        latin = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]  # two signs, and a letter whose lower case ends in a mark
        kinds[latin] = kinds[latin + 1] = _LETTER
    odd = kinds == _WHOLE
    for b in special:
        odd |= buf == b
    low = LOWER[buf]
    at = np.flatnonzero(odd)
    if len(at):
        word = np.unique(np.searchsorted(starts, at, "right") - 1)
        whole = ragged(starts[word], ends[word] - starts[word])
        kinds[whole] = _WHOLE
        low[whole] = buf[whole]
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        left, right = kinds[:-1], kinds[1:]
        cut[1:-1] = ((left != right) | (left == _DIGIT)) & (left != _WHOLE) & (right != _WHOLE) & ~((buf[:-1] == 39) & (right == _LETTER))
    cut[:-1] &= ~SPACE[buf]
    last = cut.copy()
    cut[starts] = True
    last[starts] = False
    last[ends] = True
    begin = np.flatnonzero(cut)
    return low, begin, np.flatnonzero(last), np.searchsorted(begin, offs)


class WordEncoder:
    """Token ids of texts by way of the distinct units of their words (see :func:`units`).

    The tokenizer drops white space and merges within units only, so the ids of a text are those of its units
    in order; each distinct unit is encoded once and its ids are kept while memory allows.  Known units are
    found in a table with open addressing by their hash.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.special = bytes(sorted({t.content.encode()[0] for t in _tokenizer(path).get_added_tokens_decoder().values()}))
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.zeros(TABLE_SLOTS, np.uint64), np.zeros(TABLE_SLOTS, np.int32)
        self.start, self.size, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 18, np.uint16 if _tokenizer(self.path).get_vocab_size() <= 65_536 else np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not known."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h % np.uint64(TABLE_SLOTS)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) % TABLE_SLOTS
        return out

    def insert(self, h: np.ndarray, first: int) -> None:
        """Number distinct unknown hashes from ``first`` on."""
        left = np.arange(len(h))
        slot = (h % np.uint64(TABLE_SLOTS)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            mine = free & (self.keys[slot] == h[left])
            self.values[slot[mine]] = first + left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) % TABLE_SLOTS

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the offsets of each text's ids."""
        buf, starts, ends, first = units(buf, offs, self.special)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        inverse, distinct = pd.factorize(np.maximum(word_hash(buf, starts, ends), np.uint64(1)))
        if self.count + len(distinct) > TABLE_SLOTS // 2:
            self.forget()
        known = self.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[inverse] = np.arange(len(inverse))
            raw = buf.tobytes()
            flat, begin, sizes = encode_words(self.path, [raw[a:z].decode() for a, z in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.count + len(new) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[self.count : self.count + len(new)] = self.used + begin
            self.size[self.count : self.count + len(new)] = sizes
            self.insert(distinct[new], self.count)
            known[new] = self.count + np.arange(len(new))
            self.used += len(flat)
            self.count += len(new)
        k = known[inverse]
        size = self.size[k].astype(np.int64)
        ids = self.ids[ragged(self.start[k], size)].astype(np.uint32)
        return ids, np.concatenate([[0], np.cumsum(size)])[first]


def encode_documents(encoder: WordEncoder, buf: np.ndarray, offs: np.ndarray, end_id: int) -> list[np.ndarray]:
    ids, cut = encoder.encode(buf, offs)
    ids = np.insert(ids, cut[1:], end_id)
    cut = cut + np.arange(len(cut))
    return [ids[cut[k] : cut[k + 1]] for k in range(len(cut) - 1)]


def pack(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Pack pieces (document, start, length) into full windows; returns (window size, pieces) and the rest.

    Every returned window is full; the rest is less than one longest window of pieces.
    """
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    longest = tiers[0]
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, start, length in pieces:
        while length >= longest:
            windows.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        if length:
            pool.append((length, doc, start))
    pool.sort()
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while pool and pool[-1][0] > below:
            length, doc, start = pool.pop()
            window, gap = [(doc, start, length)], tier - length
            while gap and pool:
                k = bisect_right(pool, (gap, float("inf"), 0)) - 1
                if k >= 0:
                    length, doc, start = pool.pop(k)
                    window.append((doc, start, length))
                    gap -= length
                else:
                    length, doc, start = pool.pop(0)
                    window.append((doc, start, gap))
                    insort(pool, (length - gap, doc, start + gap))
                    gap = 0
            if gap:
                return windows, window
            windows.append((tier, window))
    return windows, []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each text, with its window; no shuffle.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_size, step_group``.
    Windows are full, so they need no padding, except the last one of each task, which is padded to the
    longest size unless its length is a power of two.  A null text is empty and has only the end id.  Repeated
    rows are packed each; a null id stays null; of equally long texts any may come first; a very long text fills windows
    of its own and is encoded whole; other columns are ignored; empty tables give empty tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        encoder = kept(WordEncoder, tokenizer)  # units known from one task of a worker serve the next
        sequence = 0
        steps: dict[int, int] = {}
        names: list[int | None] = []
        held: list[np.ndarray] = []
        rest: list[tuple[int, int, int]] = []
        tokens = 0

        def emit(windows):
            nonlocal sequence
            out = [[] for _ in range(9)]
            for size, window in windows:
                offset, made = 0, steps.get(size, 0)
                steps[size] = made + 1
                step = base + (tiers.index(size) << 32) + made // max(1, STEP_TOKENS // size)
                for doc, start, length in window:
                    row = (names[doc], start, length, zlib.crc32(held[doc][start : start + length].astype("<u4").tobytes()), len(held[doc]), base + sequence, offset, size, step)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=COLUMNS)

        def close():
            """Pack what is held; keep only what the rest still needs."""
            nonlocal rest, names, held, tokens, fresh
            windows, left = pack([*rest, *fresh], tiers)
            batch = emit(windows)
            docs_left = sorted({d for d, _, _ in left})
            place = {d: k for k, d in enumerate(docs_left)}
            rest = [(place[d], s, n) for d, s, n in left]
            names, held, fresh, tokens = [names[d] for d in docs_left], [held[d] for d in docs_left], [], 0
            return batch

        fresh: list[tuple[int, int, int]] = []
        for batch in batches:
            for part, buf, offs in slices(batch, 1):
                for name, ids in zip(part.column(0).to_pylist(), encode_documents(encoder, buf, offs, end_id), strict=True):
                    fresh.append((len(held), 0, len(ids)))
                    names.append(name)
                    held.append(ids)
                    tokens += len(ids)
                if tokens >= GROUP_TOKENS:
                    yield close()
        if fresh:
            yield close()
        if rest:
            yield emit([(tiers[0], rest)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(released(run), ", ".join(f"{c} long" for c in COLUMNS))


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_size", "step_group"]
