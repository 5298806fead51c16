"""Suffix-array dedup (operator 3): column-wise construction of a collection's Burrows-Wheeler transform.

Which bytes repeat is decided on strings of 50 bytes.  Every text is cut into overlapping segments: each string
is keyed by the least hash of its 32-byte substrings, and a maximal run of strings of one key is one segment.
Equal strings have equal keys.  The texts are dealt into buckets once; a segment's key is known to be in one
bucket only, and in one row of it, before any of its bytes is sent (:func:`_key_rows`, :func:`_shared_keys`).  The
other segments go to the part of their key, those of one bucket that are equal once, with their least id.

Within a part all segments form collections, equal ones being one string.  A collection's transform and its
common prefixes are built from the right, one symbol of every string per round: each round reads the files of
the last one in sequence, in blocks of bounded size, and writes its own.  Rows that follow each other with common
prefixes of 50 or more are the occurrences of one string; it repeats wherever its least id is smaller than the
segment's.  The spans go back to the buckets.  Hashes only route and leave out what cannot repeat; a collision
brings strings together that the suffix order then tells apart.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayring.llm._words import eights, forget, mix, ragged, released_group, released_pair, slices

#: Length of the strings that count as repeated.
LENGTH = 50
#: Length of the substrings whose least hash keys a string.
SEED = 32
#: Strings of a segment at most; longer runs are cut, which keeps their key.
RUN = 64
#: Text bytes of a bucket, about.
BUCKET_BYTES = 12 << 20
#: Bytes of distinct segments that are put in suffix order together; a key with more has a collection of its own.
COLLECTION_BYTES = 2 << 20
#: Rows of a block in which the column files are read and written; 2**23 is the limit.
BLOCK_ROWS = 1 << 17
#: Segments of a key from which on they are cut by a second key, so that no key's strings meet in one task alone.
HOT_SEGMENTS = 20_000
#: Text bytes that are cut into segments at once.
CUT_BYTES = 1 << 16


def segments(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, document and key of each segment; every string of ``length`` bytes of a text lies in one.

    Keys have 48 bits; ``seed`` is a multiple of 8.
    """
    n, width = len(buf), length - seed + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    least = _least_keys(buf, width, seed)
    sizes = np.diff(offs)
    first, last = offs[:-1][sizes >= length], offs[1:][sizes >= length] - length + 1
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    valid = np.cumsum(edge[:-1])[: len(least)] > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[first] = True
    starts = np.flatnonzero(fresh & valid)
    stops = np.append(np.flatnonzero(fresh | ~valid), len(least))
    ends = stops[np.searchsorted(stops, starts, "right")]
    pieces = -(-(ends - starts) // RUN)
    step = ragged(np.zeros(len(pieces), np.int64), pieces) * RUN
    begin = np.repeat(starts, pieces) + step
    count = np.minimum(np.repeat(ends, pieces) - begin, RUN)
    return begin, count + length - 1, np.searchsorted(offs, begin, "right") - 1, least[begin]


def _least_keys(buf: np.ndarray, width: int, seed: int, salt: int = 0) -> np.ndarray:
    """For each place the least hash (48 bits) of the ``width`` substrings of ``seed`` bytes from there on."""
    data = eights(buf)
    total = np.full(len(buf) - seed + 1, salt, np.uint64)
    for k in range(0, seed, 8):
        total ^= (data[k : k + len(total)] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 + (k << 33))
    least = mix(total) >> np.uint64(16)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return least


def cut_again(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments cut where a second key of their strings changes: starts, sizes, keys, and which segment each comes from.

    Equal strings have equal second keys, so they meet under the new keys as they did under the old one.
    """
    place = ragged(begin, size)
    least = _least_keys(buf[place], length - seed + 1, seed, 0x5851F42D4C957F2D)
    source = np.repeat(np.arange(len(begin)), size)
    first = np.cumsum(size) - size
    starts = ragged(first, size - length + 1)  # in the bytes of all segments, where a string begins
    second, owner = least[starts], source[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (second[1:] != second[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(starts)))
    own = owner[head]
    return begin[own] + starts[head] - first[own], count + length - 1, mix(key[own] * np.uint64(0x9FB21C651E98DF25) ^ second[head]) >> np.uint64(16), own


def _range_least(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(rows[low..high]) for each pair, from minima over powers of two of rows."""
    level = np.log2(np.maximum(high - low + 1, 1)).astype(np.int64)
    out = np.empty(len(low), rows.dtype)
    table, k = rows, 0
    for at in range(int(level.max()) + 1 if len(level) else 0):
        if at > k:
            half = 1 << (at - 1)
            table, k = np.minimum(table[:-half], table[half:]), at
        here = np.flatnonzero(level == at)
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << at) + 1])
    return out


class ColumnFiles:
    """The rows of a growing suffix order, read and written in sequence, block by block.

    A row is one number: what suffix it is, its common prefix with the row before, and the symbol before it.
    A round reads the file of the last round and writes the other one of two.  They lie in a scratch folder of
    the task and go with it; a lost task builds them anew.
    """

    def __init__(self, folder: str, block: int) -> None:
        self.block, self.turn, self.rows = block, 0, 0
        self.files = [open(f"{folder}/rows-{k}", "w+b") for k in range(2)]  # noqa: SIM115

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first row's number and the rows of each block."""
        file = self.files[self.turn]
        file.seek(0)
        for at in range(0, self.rows, self.block):
            yield at, np.fromfile(file, np.uint64, min(self.block, self.rows - at))

    def write(self, blocks: Iterator[np.ndarray]) -> None:
        """The next round's rows."""
        file, rows = self.files[1 - self.turn], 0
        file.seek(0)
        for x in blocks:
            rows += len(x)
            x.tofile(file)
        file.flush()
        self.turn, self.rows = 1 - self.turn, rows

    def close(self) -> None:
        for file in self.files:
            file.close()


def _rows(suffix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Rows without a common prefix."""
    return suffix.astype(np.uint64) << np.uint64(16) | symbol


class Places:
    """Where the next round's suffixes go, from the rows of this one as they pass by in sequence.

    ``found`` gathers, for the rows that the next round adds and those that follow one of them: place, common
    prefix, whether it is added, and the place of the row that it extends.
    """

    def __init__(self, at: np.ndarray, strings: int, counts: np.ndarray) -> None:
        self.at = at  # places of the rows that this round added
        self.base = strings + np.concatenate([[0, 0], np.cumsum(counts[1:-1])])
        # by symbol: rows so far, the least common prefix since the last one, and whether that one was added
        self.count, self.since, self.added = np.zeros(256, np.int64), np.full(256, 255, np.uint8), np.zeros(256, bool)
        self.found: list[tuple[np.ndarray, ...]] = []

    def seen(self, rows: np.ndarray, a: int) -> np.ndarray:
        """Take in a block that begins at row ``a``; the block is returned as it is."""
        columns = rows.view(np.uint8).reshape(-1, 8)
        common = columns[:, 1].copy()
        x, y = np.searchsorted(self.at, [a, a + len(rows)])
        # symbol, row and whether this round added it in one number, which sorts faster than rows by symbol
        order = columns[:, 0].astype(np.uint32) << np.uint32(24) | np.arange(0, 2 * len(rows), 2, dtype=np.uint32)
        order[self.at[x:y] - a] |= np.uint32(1)
        order.sort()
        heads = np.searchsorted(order, np.arange(1, 256, dtype=np.uint32) << np.uint32(24))
        since = np.minimum(self.since, common.min())
        order, heads = order[heads[0] :], np.append(heads, len(order)) - heads[0]
        if len(order):
            here = np.flatnonzero(heads[1:] != heads[:-1]) + 1
            head, tail = heads[here - 1], heads[here] - 1
            new = (order.view(np.uint8)[::4] & 1).view(bool)
            either = new.copy()
            either[1:] |= new[:-1]
            either[head] = new[head] | self.added[here]
            touched = np.flatnonzero(either)
            row_of = lambda k: ((order[k] & np.uint32((1 << 24) - 1)) >> np.uint32(1)).astype(np.int64)
            place, c = row_of(touched), (order[touched] >> np.uint32(24)).astype(np.int64)
            begin = heads[c - 1]
            leads = touched == begin
            least = _range_least(common, np.where(leads, 0, row_of(touched - 1) + 1), place)
            least = np.where(leads, np.minimum(least, self.since[c]), least).astype(np.int64)
            rank = self.count[c] + touched - begin
            value = np.where(rank == 0, 0, least + 1)  # the first row that begins with c has no such neighbour
            if len(touched):
                self.found.append((self.base[c] + rank, value.astype(np.uint8), new[touched], place + a))
            last = row_of(tail)
            by = np.argsort(last)
            ends = last[by] + 1
            inside = ends[ends < len(common)]
            rest = np.full(len(last), 255, np.uint8)
            if len(inside):
                rest[: len(inside)] = np.minimum.accumulate(np.minimum.reduceat(common, inside)[::-1])[::-1]
            since[here[by]] = rest
            self.added[here] = new[tail]
            self.count[here] += tail + 1 - head
        self.since = since
        return rows


def suffix_order(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, size and common prefix with its predecessor of every suffix of the strings, in suffix order.

    Round j inserts the suffix of size j of every string that has one.  Its place follows from the suffix that it
    extends: rows counted by the symbol before them, ties in row order, are the order after the round.  The
    common prefix of two neighbours that begin alike is one more than the least over the rows between the
    suffixes they extend.  One pass over the file merges the new rows, and finds on the way places and common
    prefixes of the next round's suffixes and of those that follow them.  Each string ends with a mark of its own that is
    less than any symbol.  Symbols are bytes plus one (0xFF is no UTF-8), 0 at a string's start; strings have at
    most 254 bytes.
    """
    m = len(starts)
    # every string behind a 0 and shifted by it, so that each suffix, the empty ones too, has a place of its own
    first = np.cumsum(sizes + 1) - sizes
    text = np.zeros(int(sizes.sum()) + m + 1, np.uint8)
    text[ragged(first, sizes)] = buf[ragged(starts, sizes)] + np.uint8(1)
    with tempfile.TemporaryDirectory(prefix="columns-") as folder, contextlib.closing(ColumnFiles(folder, block)) as files:
        at, row = np.arange(m), first + sizes  # rows of the last round: their places in the file, and what they are
        ahead = text[row - 1]
        counts = np.bincount(ahead, minlength=256)
        places = Places(at, m, counts)
        files.write(places.seen(_rows(row[a : a + block], ahead[a : a + block]), a) for a in range(0, m, block))
        while places.found:
            place, value, new, source = (np.concatenate(f) for f in zip(*places.found, strict=True))
            by = np.argsort(place)
            place, value, new, source = place[by], value[by], new[by], source[by]
            row = row[np.searchsorted(at, source[new])] - 1
            at = place[new]
            ahead = text[row - 1]
            counts += np.bincount(ahead, minlength=256)
            added, old_before = _rows(row, ahead), at - np.arange(len(at))
            places = Places(at, m, counts)

            def merged(old: np.ndarray, a: int) -> Iterator[np.ndarray]:
                stop = a + len(old)
                x, y = np.searchsorted(old_before, [a, stop if stop < files.rows else stop + 1])
                is_old = np.ones(len(old) + y - x, bool)
                is_old[at[x:y] - (a + x)] = False
                out = np.empty(len(is_old), np.uint64)
                out[is_old] = old
                out[at[x:y] - (a + x)] = added[x:y]
                u, v = np.searchsorted(place, [a + x, a + x + len(out)])
                out.view(np.uint8).reshape(-1, 8)[place[u:v] - (a + x), 1] = value[u:v]
                # many rows may be added behind one old one: they pass by in blocks, too
                for k in range(0, len(out), block):
                    yield places.seen(out[k : k + block], a + x + k)

            files.write(out for a, old in files.blocks() for out in merged(old, a))
        rows = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in files.blocks())])
    row = (rows >> np.uint64(16)).astype(np.int64)
    owner = np.searchsorted(first, row, "right") - 1
    return owner, (first + sizes)[owner] - row, (rows >> np.uint64(8)).astype(np.uint8).astype(np.int64)


def repeated_starts(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, position) of each string that also starts in a segment of a smaller id."""
    owner, size, common = suffix_order(buf, starts, sizes)
    group = np.flatnonzero(common < length)
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(ids[owner], group), np.diff(np.append(group, len(owner))))
    hit = (least < ids[owner]) & (size >= length)
    return owner[hit].astype(np.int64), sizes[owner[hit]] - size[hit]


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"", 1)


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _batch(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32() if n in ("bucket", "part", "kind") else pa.binary() for n in names]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class Bucket:
    """The texts of one bucket: their bytes, their segments, and the keys that several of its rows have."""

    def __init__(self, table: pa.Table, length: int) -> None:
        forget()
        ids, parts, sizes = [], [], []
        for batch in table.to_batches():
            for part, buf, offs in slices(batch, batch.schema.get_field_index("text")):
                ids.append(part.column("doc_id"))
                parts.append(buf)
                sizes.append(np.diff(offs))
        self.id = pa.chunked_array(ids, pa.int64()).combine_chunks()
        self.ids, self.named = self.id.fill_null(0).to_numpy(zero_copy_only=False), self.id.is_valid().to_numpy(zero_copy_only=False)
        self.buf, self.sizes = np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate([np.zeros(0, np.int64), *sizes])
        self.offs = np.concatenate([[0], np.cumsum(self.sizes)])
        # places fit 32 bits unless a text is very long
        found, k, place = [], 0, np.int32 if len(self.buf) < 1 << 31 else np.int64
        while k < len(self.sizes):
            z = max(k + 1, int(np.searchsorted(self.offs, self.offs[k] + CUT_BYTES, "right")) - 1)
            begin, size, doc, key = segments(self.buf[self.offs[k] : self.offs[z]], self.offs[k : z + 1] - self.offs[k], length)
            own = self.named[doc + k]
            found.append(((begin[own] + self.offs[k]).astype(place), size[own].astype(np.uint8), (doc[own] + k).astype(np.int32), key[own]))
            k = z
        kinds = (place, np.uint8, np.int32, np.uint64)
        self.begin, self.size, self.doc, self.key = (np.concatenate([np.zeros(0, t), *(f[n] for f in found)]) for n, t in enumerate(kinds))
        del found
        order = np.argsort(self.key)
        sorted_keys = self.key[order]
        fresh = np.concatenate([np.ones(min(len(order), 1), bool), sorted_keys[1:] != sorted_keys[:-1]])
        head = np.flatnonzero(fresh)
        self.number = np.empty(len(order), np.int32)  # of each segment's key
        self.number[order] = np.cumsum(fresh, dtype=np.int32) - 1
        self.keys = sorted_keys[head]
        self.several = np.zeros(len(head), bool)
        if len(head):
            docs = self.doc[order]
            self.several = np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)

    def by_part(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys in the order in which they are sent, and where each part's begin."""
        part = (self.keys % np.uint64(parts)).astype(np.int64)
        order = _by_part(part, parts)
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def repeated_keys(self) -> np.ndarray:
        """How many segments each key has here beyond its first."""
        return np.bincount(self.number, minlength=len(self.keys)) - 1

    def choose(self, answers: Iterator[tuple[int, bytes, bytes]], parts: int, length: int) -> None:
        """Keep the segments whose keys other rows have too, cut again under hot keys; equal ones are one, in a fixed order by part, key and bytes."""
        order, cut = self.by_part(parts)
        shared, hot = self.several.copy(), np.zeros(len(self.keys), bool)
        for part, bits, hot_keys in answers:
            own = order[cut[part] : cut[part + 1]]
            shared[own] |= np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8), count=len(own)).astype(bool)
            hot[own[_unpack(hot_keys, np.int32)]] = True
        number = self.number
        chosen = np.flatnonzero(shared[number])
        self.begin, self.size, self.doc = (x[chosen].astype(np.int64) for x in (self.begin, self.size, self.doc))
        self.key = self.key[chosen]
        crowded = hot[number[chosen]]
        if crowded.any():
            begin, size, key, source = cut_again(self.buf, self.begin[crowded], self.size[crowded], self.key[crowded], length)
            doc = self.doc[crowded][source]
            self.begin, self.size, self.doc, self.key = (np.concatenate([old[~crowded], new]) for old, new in ((self.begin, begin), (self.size, size), (self.doc, doc), (self.key, key)))
        part = (self.key % np.uint64(parts)).astype(np.int64)
        one, self.kind = distinct(self.buf, self.begin, self.size, self.key, part)
        self.one = one
        self.least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.kind, self.ids[self.doc])
        self.cut = np.searchsorted(part[one], np.arange(parts + 1))


def distinct(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of equal strings, ordered by ``before`` (the last first) and their bytes' hash, and each string's number.

    Strings of equal hash and size are compared byte by byte; should they differ, all are ordered by their bytes.
    """
    data, keep = eights(buf), np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    steps = range(0, int(size.max()) if len(size) else 0, 8)

    def eight(k: np.ndarray, at: int) -> np.ndarray:
        return data[np.minimum(begin[k] + at, len(buf))] & keep[np.clip(size[k] - at, 0, 8)]

    everyone = np.arange(len(begin))
    h = mix(size.astype(np.uint64))
    for at in steps:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) ^ eight(everyone, at))
    order = np.lexsort((h, *before))
    new = np.ones(len(order), bool)
    columns = [c[order] for c in (h, size, *before)]
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(order) else False
    again = np.flatnonzero(~new)
    one, two = order[again], order[again - 1]
    if any((eight(one, at) != eight(two, at)).any() for at in steps):
        width = int(size.max())
        rows = np.zeros((len(size), width), np.uint8)
        rows[np.arange(width)[None, :] < size[:, None]] = buf[ragged(begin, size)]
        order = np.lexsort((*rows.T[::-1], size, *before))
        columns = [c[order] for c in (rows, size, *before)]
        new[1:] = np.logical_or.reduce([(c[1:] != c[:-1]).reshape(len(c) - 1, -1).any(axis=1) for c in columns])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """The stable order by part; small numbers are sorted faster."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def _key_rows(table: pa.Table, parts: int, length: int) -> pa.Table:
    """(part, bucket, keys, more): the distinct keys of a bucket, dealt by key, and which have how many segments more than one."""
    number, bucket = table.column("bucket")[0].as_py(), Bucket(table, length)
    order, cut = bucket.by_part(parts)
    repeated = bucket.repeated_keys()[order]
    rows = []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        more = np.flatnonzero(repeated[cut[k] : cut[k + 1]])
        counts = np.stack([more, repeated[cut[k] + more]], axis=1).astype(np.int32).ravel()
        rows.append((k, number, _pack(np.diff(bucket.keys[order[cut[k] : cut[k + 1]]], prepend=np.uint64(0))), _pack(counts)))
    return _batch(["part", "bucket", "keys", "more"], rows)


def _shared_keys(table: pa.Table, most: int) -> pa.Table:
    """(bucket, part, bits, hot): which keys of each bucket's blob another bucket has too, and which have more than ``most`` segments in all."""
    part = table.column("part")[0].as_py()
    buckets, keys = table.column("bucket").to_pylist(), [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    shared = np.zeros(len(flat), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum([len(k) for k in keys])
    hot = np.zeros(len(flat), bool)
    more = [_unpack(b, np.int32).reshape(-1, 2) for b in table.column("more").to_pylist()]
    at = np.concatenate([m[:, 0] + z - len(k) for m, k, z in zip(more, keys, ends.tolist(), strict=True)])
    if len(flat) + sum(int(m[:, 1].sum()) for m in more) > most:
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        extra = np.zeros(len(flat), np.int64)
        extra[at] = np.concatenate([m[:, 1] for m in more])
        total = np.diff(np.append(heads, len(flat))) + np.add.reduceat(extra[order], heads)
        hot[order] = np.repeat(total > most, np.diff(np.append(heads, len(flat))))
    rows = []
    for b, k, z in zip(buckets, keys, ends.tolist(), strict=True):
        own = slice(z - len(k), z)
        if shared[own].any() or hot[own].any():
            rows.append((b, part, zstandard.compress(np.packbits(shared[own]).tobytes(), 3), _pack(np.flatnonzero(hot[own]).astype(np.int32))))
    return _batch(["bucket", "part", "bits", "hot"], rows)


def _answers(table: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
    return zip(*(table.column(c).to_pylist() for c in ("part", "bits", "hot")), strict=True)


def _segment_rows(texts: pa.Table, answers: pa.Table, parts: int, length: int) -> pa.Table:
    """(part, bucket, keys, sizes, ids, data): the chosen distinct segments of a bucket with their least ids."""
    rows, number, bucket = [], texts.column("bucket")[0].as_py(), Bucket(texts, length)
    bucket.choose(_answers(answers), parts, length)
    for k in np.flatnonzero(np.diff(bucket.cut)).tolist():
        a, z = bucket.cut[k], bucket.cut[k + 1]
        one = bucket.one[a:z]
        size = bucket.size[one]
        data = zstandard.compress(bucket.buf[ragged(bucket.begin[one], size)].tobytes(), 3)
        rows.append((k, number, _pack(np.diff(bucket.key[one], prepend=np.uint64(0))), _pack(size.astype(np.uint8)), _pack(bucket.least[a:z]), data))
    return _batch(["part", "bucket", "keys", "sizes", "ids", "data"], rows)


def _repeats(table: pa.Table, length: int) -> pa.Table:
    """(bucket, part, spans): of the segments of some keys, which strings also start in a text of a smaller id.

    A span names the segment's place in its bucket's blob and the first and last byte (plus one) that repeat.
    """
    part = table.column("part")[0].as_py()
    buckets = np.array(table.column("bucket").to_pylist())
    columns = {c: [_unpack(b, t) for b in table.column(c).to_pylist()] for c, t in (("keys", np.uint64), ("sizes", np.uint8), ("ids", np.int64))}
    each = np.array([len(x) for x in columns["sizes"]])
    key = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in columns["keys"]])
    size, ids = np.concatenate(columns["sizes"]).astype(np.int64), np.concatenate(columns["ids"])
    buf = np.frombuffer(b"".join(zstandard.decompress(b) for b in table.column("data").to_pylist()), np.uint8)
    begin = np.cumsum(size) - size
    home, place = np.repeat(np.arange(len(each)), each), ragged(np.zeros(len(each), np.int64), each)
    # equal segments of several buckets are one string of the collection, with the least of their ids
    one, kind = distinct(buf, begin, size, key)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    found = []  # string, first and last + 1 byte that repeat
    # a key with one string is a collection of one, in which nothing repeats; whole keys share a collection up to its size
    new_key = np.concatenate([[True], key[one][1:] != key[one][:-1]])
    several = np.flatnonzero(~(new_key & np.append(new_key[1:], True)))
    heads = np.append(np.flatnonzero(new_key[several]), len(several))
    bytes_before = np.concatenate([[0], np.cumsum(size[one[several]])])
    turn = 0
    while turn < len(heads) - 1:
        a = int(heads[turn])
        turn = max(turn + 1, int(np.searchsorted(bytes_before[heads], bytes_before[a] + COLLECTION_BYTES, "right")) - 1)
        strings = several[a : int(heads[turn])]
        own = one[strings]
        segment, at_byte = repeated_starts(buf, begin[own], size[own], least[strings], length)
        if len(segment):
            order = np.lexsort((at_byte, segment))
            segment, at_byte = segment[order], at_byte[order]
            head = np.ones(len(order), bool)
            head[1:] = (segment[1:] != segment[:-1]) | (at_byte[1:] != at_byte[:-1] + 1)
            x = np.flatnonzero(head)
            y = np.append(x[1:], len(order)) - 1
            found.append((strings[segment[x]], at_byte[x], at_byte[y] + length))
    # a copy of a larger id repeats whole; the others in the spans of their string
    later = np.flatnonzero(ids > least[kind])
    out = [(later, np.zeros(len(later), np.int64), size[later])]
    if found:
        string, x, y = (np.concatenate(f) for f in zip(*found, strict=True))
        count = np.bincount(string, minlength=len(one))
        start = np.cumsum(count) - count
        holders = np.flatnonzero((ids == least[kind]) & (count[kind] > 0))
        pick = ragged(start[kind[holders]], count[kind[holders]])
        order = np.argsort(string, kind="stable")
        out.append((np.repeat(holders, count[kind[holders]]), x[order][pick], y[order][pick]))
    segment, x, y = (np.concatenate(f) for f in zip(*out, strict=True))
    order = np.argsort(segment, kind="stable")
    segment, x, y = segment[order], x[order], y[order]
    cut = np.searchsorted(home[segment], np.arange(len(each) + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[k], cut[k + 1])
        rows.append((int(buckets[k]), part, _pack(np.stack([place[segment[s]], x[s], y[s]], axis=1).astype(np.int32))))
    return _batch(["bucket", "part", "spans"], rows)


def _without_repeats(texts: pa.Table, answers: pa.Table, parts: int, length: int, names: list[str]) -> pa.Table:
    """The rows of a bucket with what is left of their texts; ``answers`` holds shared keys and spans."""
    bucket = Bucket(texts, length)
    is_bits = answers.column("bits").is_valid()
    bucket.choose(_answers(answers.filter(is_bits)), parts, length)
    later = bucket.ids[bucket.doc] > bucket.least[bucket.kind]
    found = [(bucket.doc[later], bucket.begin[later], (bucket.begin + bucket.size)[later])]
    by = np.argsort(bucket.kind, kind="stable")
    count = np.bincount(bucket.kind, minlength=len(bucket.one))
    first = np.cumsum(count) - count
    spans = answers.filter(answers.column("spans").is_valid())
    for part, blob in zip(spans.column("part").to_pylist(), spans.column("spans").to_pylist(), strict=True):
        place, x, y = _unpack(blob, np.dtype((np.void, 12))).view(np.int32).reshape(-1, 3).T.astype(np.int64)
        kind = place + bucket.cut[part]
        copies = by[ragged(first[kind], count[kind])]
        found.append((bucket.doc[copies], bucket.begin[copies] + np.repeat(x, count[kind]), bucket.begin[copies] + np.repeat(y, count[kind])))
    # maximal runs: spans that overlap or touch within a document
    doc, x, y = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.argsort(x)
    doc, x, y = doc[order], x[order], y[order]
    reach = np.maximum.accumulate(y)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), (x[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]))
    doc, x, y = doc[first], x[first], reach[np.append(first[1:], len(x))[: len(first)] - 1]
    runs = np.bincount(doc, minlength=len(bucket.sizes))
    removed = np.bincount(doc, weights=y - x, minlength=len(bucket.sizes)).astype(np.int64)
    gone = np.zeros(len(bucket.buf), bool)
    gone[ragged(x, y - x)] = True
    digests, kept = [], []
    for a, z, n in zip(bucket.offs[:-1].tolist(), bucket.offs[1:].tolist(), removed.tolist(), strict=True):
        left = (bucket.buf[a:z][~gone[a:z]] if n else bucket.buf[a:z]).tobytes()
        digests.append(hashlib.sha256(left).hexdigest())
        kept.append(left.decode(errors="ignore").encode() if n else left)
    head = [bucket.id, pa.array(bucket.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
    rest = [texts.column(n).combine_chunks() for n in names]
    return pa.Table.from_arrays([*head, *rest], names=[*COLUMNS, *names])


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` of every row, with the columns of ``keep`` after them.

    A byte goes if a string of ``length`` bytes (32 to 190) that covers it also starts in a row of a smaller id.
    ``kept_text`` holds the remaining bytes, without code points that lost a part.  Null texts are empty; rows of
    one id do not count against each other; rows of a null id are left whole and count against none; a very long
    text lies whole in one bucket; segments of a key that more than ``hot_segments`` have are dealt by a second key,
    so that a phrase in very many texts burdens many tasks; other columns are ignored; empty tables give empty tables.  The texts are
    shuffled once, and that shuffle is read three times.
    """
    spark = docs.sparkSession
    names = [f"k{n}" for n in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / BUCKET_BYTES) + 1)
    texts = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartition(parts, "bucket")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string" + "".join(f", {n} {dict(rows.dtypes)[n]}" for n in names)

    keyed = texts.groupBy("bucket").applyInArrow(released_group(lambda t: _key_rows(t, parts, length)), "part int, bucket int, keys binary, more binary")
    shared = keyed.repartition(parts, "part").groupBy("part").applyInArrow(released_group(lambda t: _shared_keys(t, hot_segments)), "bucket int, part int, bits binary, hot binary")
    dealt = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(released_pair(lambda t, s: _segment_rows(t, s, parts, length)), "part int, bucket int, keys binary, sizes binary, ids binary, data binary")
    spans = dealt.repartition(parts, "part").groupBy("part").applyInArrow(released_group(lambda t: _repeats(t, length)), "bucket int, part int, spans binary")
    answers = shared.withColumn("spans", F.lit(None).cast("binary")).unionByName(spans.withColumns({"bits": F.lit(None).cast("binary"), "hot": F.lit(None).cast("binary")}))
    result = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(released_pair(lambda t, s: _without_repeats(t, s, parts, length, names)), schema)
    return result.withColumnsRenamed(dict(zip(names, keep, strict=True))) if keep else result
