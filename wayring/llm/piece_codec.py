"""SentencePiece encoding and decoding (operator 11): vectorised merge rounds over flat symbol arrays.

Texts are cut into units that no merge can cross; each distinct unit is encoded once and its ids are kept.  New
units lie as segments in one flat array of symbols.  A round takes the least pair rank of each segment, merges all
its leftmost occurrences that do not overlap, at once, and compacts the array; segments without a pair leave.
Merging several occurrences at once equals merging them one by one unless a pair that comes up in between ranks
no worse than the one being merged; segments where that happens merge only the leftmost occurrence in that round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from wayring.llm._words import kept, ragged, released, slices, word_hash

#: The rank of no pair.
NONE = np.iinfo(np.int32).max
#: Units known at most before they are forgotten.
KNOWN_UNITS = 1 << 20
#: Symbols of one block of merge rounds, but for longer units.
BLOCK_SYMBOLS = 1 << 20
#: Bytes of text that are worked on at once; longer texts are cut between units.
PART_BYTES = 2 << 20
#: Ids that are decoded at once; longer rows are cut between pieces.
PART_IDS = 1 << 20

_SPACE = 0x20
_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: What the library writes for the unknown id and for a byte outside UTF-8.
_UNKNOWN_TEXT, _BAD_BYTE = " \u2047 ".encode(), "\ufffd".encode()


class PieceModel:
    """Tables of a BPE model with byte fallback and without normalization."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        pieces, kinds = [p.piece for p in proto.pieces], np.array([p.type for p in proto.pieces])
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not spec.treat_whitespace_as_suffix
        if spec.model_type != 2 or not spec.byte_fallback or not plain or not np.isin(kinds, (_NORMAL, _UNKNOWN, _CONTROL, _BYTE)).all():
            raise ValueError("encoding needs a BPE model with byte fallback, identity normalization and no pieces of a user's own")
        self.begin, self.end, self.unknown = spec.bos_id, spec.eos_id, spec.unk_id
        self.base = len(pieces) + 1  # one more symbol stands for characters without a piece
        normal = {p: k for k, p in enumerate(pieces) if kinds[k] == _NORMAL}
        scores = np.array([-p.score for p in proto.pieces])
        ranks = np.searchsorted(np.unique(scores), scores).astype(np.int32)
        self._tables(normal, ranks)
        self._texts(pieces, kinds)
        self._runs(normal, ranks)

    def _tables(self, normal: dict[str, int], ranks: np.ndarray) -> None:
        self.symbol = np.full(0x110000, self.base - 1, np.int32)
        inside = np.zeros((256, 256), bool)
        pairs = []
        for piece, k in normal.items():
            if len(piece) == 1:
                self.symbol[ord(" " if piece == _MARK else piece)] = k
            pairs += [(normal[piece[:i]] * self.base + normal[piece[i:]], k) for i in range(1, len(piece)) if piece[:i] in normal and piece[i:] in normal]
            raw = np.frombuffer(piece.replace(_MARK, " ").encode(), np.uint8)
            inside[raw[:-1], raw[1:]] = True
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.target = table[:, 0].copy(), table[:, 1].astype(np.int32)
        self.rank = ranks[self.target]
        # between these bytes no piece lies, so no merge; never within a character, always before white space
        self.cut = ~inside
        self.cut[:, 0x80:0xC0] = False
        self.cut[:, _SPACE] = True

    def _texts(self, pieces: list[str], kinds: np.ndarray) -> None:
        texts = [p.replace(_MARK, " ").encode() for p in pieces]
        self.bytes_of = np.full(256, -1, np.int64)
        for k in np.flatnonzero(kinds != _NORMAL).tolist():
            texts[k] = b"" if kinds[k] == _CONTROL else _UNKNOWN_TEXT
            if kinds[k] == _BYTE:
                value = int(pieces[k][3:5], 16)
                self.bytes_of[value], texts[k] = k, bytes([value])
        self.is_byte, self.is_control = kinds == _BYTE, kinds == _CONTROL
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.marked = np.array([p.startswith(_MARK) for p in pieces]) & (kinds == _NORMAL)

    def _runs(self, normal: dict[str, int], ranks: np.ndarray) -> None:
        """Ids of runs of lone space marks.

        Runs of marks rank behind all other pieces and merge with nothing else, so they are merged when all else is.
        They rank alike, so the leftmost pair always goes first: once a longest piece is complete, the rest of the run
        is merged like a run of its own.  Runs of up to four of the longest are merged by rounds, longer ones repeat.
        """
        runs = {p: k for p, k in normal.items() if not p.strip(_MARK)}
        others = [k for p, k in normal.items() if p.strip(_MARK)]
        alike = {int(ranks[k]) for p, k in runs.items() if len(p) > 1}
        if _MARK not in runs or len(alike) > 1 or any(_MARK in p.lstrip(_MARK) or p.startswith(2 * _MARK) for p in normal if p.strip(_MARK)):
            raise ValueError("space marks may only begin pieces or make up whole ones of one score")
        if alike and max(ranks[others]) > min(alike):
            raise ValueError("runs of space marks must rank behind other pieces")
        self.lone = runs[_MARK]
        self.longest = max(map(len, runs))
        sizes = np.arange(1, 4 * self.longest + 1)
        flat, first = self.merged(np.full(sizes.sum(), self.lone, np.int32), np.concatenate([[0], np.cumsum(sizes)]))
        self.run_ids, self.run_start, self.run_size = flat.astype(np.uint32), np.concatenate([[0], first[:-1]]), np.concatenate([[0], np.diff(first)])
        self.longest_id = runs[_MARK * self.longest]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NONE`` where no piece is made of it."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        there = self.pairs[at] == key
        return np.where(there, self.rank[at], NONE), self.target[at]

    def merged(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over segments ``sym[first[k]:first[k + 1]]``, none empty, until no pair is left; the same two arrays of the result."""
        word, start, size = np.arange(len(first) - 1), first[:-1].astype(np.int64), np.diff(first)
        sym = sym.copy()
        rank, target = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        rank[:-1], target[:-1] = self.pair(sym[:-1], sym[1:])
        rank[start + size - 1] = NONE
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            least = np.minimum.reduceat(rank, start)
            live = least < NONE
            if not live.all():
                stay = np.repeat(live, size)
                left.append((word[~live], size[~live], sym[~stay]))
                word, size, least, sym, rank, target = word[live], size[live], least[live], sym[stay], rank[stay], target[stay]
                start = np.cumsum(size) - size
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            begin = np.concatenate([[True], np.diff(at) > 1])
            in_run = at - at[begin][np.cumsum(begin) - 1]
            at = at[in_run % 2 == 0]
            owner = np.searchsorted(start, at, "right") - 1
            at, owner = self._in_order(sym, target, at, owner, start, size, least)
            sym[at] = target[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size = size - np.bincount(owner, minlength=len(size))
            start = np.cumsum(size) - size
            sym, rank, target = sym[keep], rank[keep], target[keep]
            at = at - np.arange(len(at))  # each merge before has taken one place
            anew = np.unique(np.concatenate([at, at[at > start[owner]] - 1]))
            last = start + size - 1
            inner = anew[anew < last[np.searchsorted(start, anew, "right") - 1]]
            rank[anew] = NONE
            rank[inner], target[inner] = self.pair(sym[inner], sym[inner + 1])
        words, sizes, symbols = (np.concatenate(x) for x in zip(*left, strict=True)) if left else (word, size, sym)
        back = np.argsort(words, kind="stable")
        begin = np.cumsum(sizes) - sizes
        return symbols[ragged(begin[back], sizes[back])], np.concatenate([[0], np.cumsum(sizes[back])])

    def _in_order(self, sym, target, at, owner, start, size, least) -> tuple[np.ndarray, np.ndarray]:  # noqa: PLR0913
        """The merges of a round: all of a segment, or only its first where a pair made by them would come before the next."""
        again = np.concatenate([[False], owner[1:] == owner[:-1]])
        several = again | np.concatenate([again[1:], [False]])
        k = np.flatnonzero(several)
        if not len(k):
            return at, owner
        p, w, new = at[k], owner[k], target[at[k]]
        joined = again[k] & (at[k] - at[k - 1] == 2)
        before = np.where(joined, target[at[k - 1]], sym[np.maximum(p - 1, 0)])
        early = np.where((p > start[w]), self.pair(before, new)[0], NONE) <= least[w]
        after = sym[np.minimum(p + 2, len(sym) - 1)]
        early |= np.where(p + 2 < start[w] + size[w], self.pair(new, after)[0], NONE) <= least[w]
        bad = np.zeros(len(start), bool)
        bad[w[early]] = True
        stay = ~(again & bad[owner])
        return at[stay], owner[stay]

    def units(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and the offsets of each one's."""
        ids, sizes = [], []
        at = 0
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        total = np.cumsum(lengths)
        while at < len(units):
            stop = max(at + 1, int(np.searchsorted(total, total[at] - lengths[at] + BLOCK_SYMBOLS, "right")))
            joined = "".join(units[at:stop])
            first = np.concatenate([[0], np.cumsum(lengths[at:stop])])
            sym = self.units(joined)
            flat, cuts = self.merged(sym, first)
            size = np.diff(cuts)
            odd = np.flatnonzero(flat == self.base - 1)
            if len(odd):  # characters without a piece, in order: one id a byte
                raw = [c.encode("utf-8", "surrogatepass") for c in np.array(list(joined), object)[sym == self.base - 1].tolist()]
                width = np.ones(len(flat), np.int64)
                width[odd] = [len(r) for r in raw]
                out = np.repeat(flat.astype(np.int64), width)
                out[ragged((np.cumsum(width) - width)[odd], width[odd])] = self.bytes_of[np.frombuffer(b"".join(raw), np.uint8)]
                size = np.add.reduceat(width, cuts[:-1])
                flat = out
            ids.append(flat.astype(np.uint32))
            sizes.append(size)
            at = stop
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class PieceEncoder:
    """Ids of texts by way of their distinct units, which are kept while memory allows."""

    def __init__(self, path: str) -> None:
        self.model = kept(PieceModel, path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _known(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit; units that are new are encoded first."""
        inverse, distinct = pd.factorize(word_hash(buf, start, end))
        if len(self.keys) + len(distinct) > KNOWN_UNITS:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        there = np.zeros(len(distinct), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        new = np.flatnonzero(~there)
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[inverse[::-1]] = np.arange(len(inverse))[::-1]
            raw = buf.tobytes()
            units = [raw[a:z].decode("utf-8", "replace") for a, z in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
            flat, offs = self.model.encode_units(units)
            order = np.argsort(distinct[new])
            where = at[new][order]
            self.keys = np.insert(self.keys, where, distinct[new][order])
            self.place = np.insert(self.place, where, (len(self.offs) - 1 + np.arange(len(new)))[order])
            self.ids, self.offs = np.concatenate([self.ids, flat]), np.concatenate([self.offs, self.offs[-1] + offs[1:]])
            at = np.searchsorted(self.keys, distinct)
        return self.place[at][inverse]

    def encode(self, buf: np.ndarray, offs: np.ndarray, prefixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts ``buf[offs[k]:offs[k + 1]]`` and each text's offsets; those ``prefixed`` get a space mark in front unless empty.

        Texts are UTF-8; space marks in them are spaces to the model.
        """
        mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
        if len(mark):
            stay = np.ones(len(buf), bool)
            stay[mark + 1] = stay[mark + 2] = False
            buf = buf.copy()
            buf[mark] = _SPACE
            buf, offs = buf[stay], np.concatenate([[0], np.cumsum(stay)])[offs]
        front = prefixed & (np.diff(offs) > 0)
        buf = np.insert(buf, offs[:-1][front], np.uint8(_SPACE))
        offs = offs + np.concatenate([[0], np.cumsum(front)])
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        begins = np.zeros(len(buf), bool)
        begins[1:] = self.model.cut[buf[:-1], buf[1:]]
        begins[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(begins)
        unit = self._known(buf, start, np.append(start[1:], len(buf)))
        size = self.offs[unit + 1] - self.offs[unit]
        ids = self.ids[ragged(self.offs[unit], size)]
        return self._with_runs(ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offs)])

    def _with_runs(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of lone space marks replaced by the pieces of such runs."""
        model = self.model
        at = np.flatnonzero(ids == model.lone)
        if len(at) < 2:
            return ids, offs
        first = np.zeros(len(ids) + 1, bool)
        first[offs] = True
        begin = np.concatenate([[True], np.diff(at) > 1]) | first[at]
        head = at[begin]
        length = np.diff(np.append(np.flatnonzero(begin), len(at)))
        head, length = head[length > 1], length[length > 1]
        if not len(head):
            return ids, offs
        whole = np.maximum(0, (length - 2 * model.longest) // model.longest)
        rest = length - whole * model.longest
        width = whole + model.run_size[rest]
        new = np.full(int(width.sum()), model.longest_id, np.uint32)
        new[ragged(np.cumsum(width) - model.run_size[rest], model.run_size[rest])] = model.run_ids[ragged(model.run_start[rest], model.run_size[rest])]
        take = np.ones(len(ids), np.int64)
        take[ragged(head, length)] = 0
        take[head] = width
        out = np.repeat(ids, take)
        end = np.concatenate([[0], np.cumsum(take)])
        out[ragged(end[head], width)] = new
        return out, end[offs]


def cut_places(model: PieceModel, data: np.ndarray, most: int) -> list[int]:
    """Offsets that cut a long text into parts of about ``most`` bytes, between units and not behind white space."""
    cuts, at = [0], most
    while at < len(data):
        window = data[at - 1 : at + most]
        # not behind a space or the end of a space mark, so that no run of marks is cut, nor before a space mark's bytes
        fine = np.flatnonzero(model.cut[window[:-1], window[1:]] & (window[:-1] != _SPACE) & (window[:-1] != 0x81) & (window[1:] != 0xE2))
        if len(fine):
            cuts.append(at + int(fine[0]))
            at = cuts[-1] + most
        else:
            at += most
    return [*cuts, len(data)]


def encode_texts(encoder: PieceEncoder, buf: np.ndarray, offs: np.ndarray, part_bytes: int = PART_BYTES) -> Iterator[np.ndarray]:
    """Ids of each text, with begin and end; texts of more than ``part_bytes`` are encoded part by part."""
    model = encoder.model
    edge = lambda parts: np.concatenate([np.array([model.begin], np.uint32), *parts, np.array([model.end], np.uint32)])
    if len(offs) == 2 and len(buf) > part_bytes:
        cuts = cut_places(model, buf, part_bytes)
        yield edge([encoder.encode(buf[a:z], np.array([0, z - a]), np.array([a == 0]))[0] for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
        return
    ids, where = encoder.encode(buf, offs, np.ones(len(offs) - 1, bool))
    for a, z in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
        yield edge([ids[a:z]])


def decode_ids(model: PieceModel, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """UTF-8 of each row ``ids[offs[k]:offs[k + 1]]`` as the library decodes it.

    Control ids are silent, one space mark that begins the text is dropped, bytes of byte pieces that form no
    character become U+FFFD each.
    """
    out: list[bytes] = []
    for k in range(0, len(offs) - 1):
        a, z = int(offs[k]), int(offs[k + 1])
        parts, begun = [], False
        while a < z:
            stop = min(a + PART_IDS, z)
            while stop < z and model.is_byte[ids[stop]]:
                stop += 1
            text, begun = _decoded(model, ids[a:stop], begun)
            parts.append(text)
            a = stop
        out.append(parts[0] if len(parts) == 1 else b"".join(parts))
    return out


def _decoded(model: PieceModel, ids: np.ndarray, begun: bool) -> tuple[bytes, bool]:
    start, size = model.start[ids], model.size[ids]
    if not begun:
        loud = np.flatnonzero(~model.is_control[ids])
        if len(loud):
            begun = True
            if model.marked[ids[loud[0]]]:
                start[loud[0]] += 1
                size[loud[0]] -= 1
    flat = model.text[ragged(start, size)]
    loose = np.flatnonzero(model.is_byte[ids] & (model.text[model.start[ids]] > 127))
    if not len(loose):
        return flat.tobytes(), begun
    # runs of byte pieces beyond ASCII: those that are no UTF-8 are replaced
    end = np.cumsum(size)
    heads = loose[np.concatenate([[True], np.diff(loose) > 1])].tolist()
    tails = loose[np.concatenate([np.diff(loose) > 1, [True]])].tolist()
    raw, pieces, done = flat.tobytes(), [], 0
    for head, tail in zip(heads, tails, strict=True):
        a, z = int(end[head] - 1), int(end[tail])
        run = raw[a:z]
        try:
            run.decode()
        except UnicodeDecodeError:
            pieces += [raw[done:a], _mended(run)]
            done = z
    return b"".join([*pieces, raw[done:]]), begun


def _mended(run: bytes) -> bytes:
    """The characters of a run of bytes, each byte that belongs to none replaced."""
    out, at = [], 0
    while at < len(run):
        width = 2 if run[at] >> 5 == 6 else 3 if run[at] >> 4 == 14 else 4 if run[at] >> 3 == 30 else 1
        one = run[at : at + width]
        try:
            one.decode()
            out.append(one)
            at += width
        except UnicodeDecodeError:
            out.append(_BAD_BYTE)
            at += 1
    return b"".join(out)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: ids with begin and end, as little-endian unsigned 32-bit integers; no shuffle.

    ``model`` is the path of a SentencePiece BPE model that every executor can read.  A null text counts as empty and
    has the begin and end ids alone; repeated rows are encoded each; a null id stays null; other columns are ignored;
    an empty table gives an empty table.  Texts beyond 2 MB are encoded in parts, cut where no merge can cross.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(PieceEncoder, model)
        for batch in batches:
            for part, buf, offs in slices(batch, 1, PART_BYTES):
                found = pa.array([ids.astype("<u4", copy=False).tobytes() for ids in encode_texts(encoder, buf, offs)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), found], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(released(run), "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text`` of rows of :func:`encode_pieces`; no shuffle.

    Null ids of a row give an empty text; ids outside the model or bytes that are no whole integers raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = kept(PieceModel, model)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = [np.frombuffer(x or b"", "<u4") for x in part.column(1).to_pylist()]
                offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                texts = decode_ids(tables, np.concatenate(rows), offs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id long, ids binary, text string")
