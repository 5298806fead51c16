"""N-gram Jaccard join (operator 5): size-banded tiles, hashed bitmap signatures, exact intersection.

1. Every text becomes its set of distinct five-word shingles, as sorted 64-bit hashes.  Texts of equal sets are
   one class from here on, known by a hash of the set.
2. A pair that links shares k of the first ``n - ceil(0.75 n) + k`` shingles of both sets under any common order.  The order is by hash, with the shingles that many texts hold last.  Classes that share such a
   shingle within one size band or two neighbouring ones meet in a tile; a tile yields its members and a pivot.
3. A signature is a bitmap of parities, four to eight bits a shingle.  The bits in which two signatures
   differ bound the overlap from above; pairs that pass are verified on the sorted arrays.
4. One pivot link of each set is verified first, then those that would still join components.  Only tiles whose
   members lie in several components after that are compared among themselves, in blocks of bounded size.  Components follow by contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wayring.llm._io import discard, written
from wayring.llm._words import LOWER, mix, released, released_group, slices, spans, word_hash
from wayring.llm.components import components

#: A shingle that this share of the texts of some stretch of input holds goes to the end of the order.
FREQUENT = 0.001
#: At most so many of them, the most frequent; the order decides what is compared first, not what is found.
MOST_FREQUENT = 200_000
#: Texts of a stretch in which frequent shingles are looked for.
STRETCH_TEXTS = 5_000
#: Postings that one task gathers, about.
PART_POSTINGS = 1_500_000
#: Parts at least: a pair comes from each part that holds shingles of both, so the rows a pair should not depend on the input.
LEAST_PARTS = 64
#: Shared shingles asked of the first parts of two sets that link; each part is longer by as many, less one.
SHARED = 6
#: Text bytes whose postings are packed together.
PACK_BYTES = 8 << 20
#: Members of a block when a tile is compared with itself.
BLOCK = 2_048
#: Tasks over which the pairs of one pivot are spread when its row is joined to them.
SALTS = 32
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_BANDS = np.array([1.0 * (4 / 3) ** k for k in range(1, 62)])


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, offs)
    h = word_hash(buf, starts, ends)
    n = np.diff(first)
    run = h.copy()
    for j in range(1, width):
        if len(h) > j:
            run[:-j] = run[:-j] * _C + h[j:]
    full = mix(run)
    out: list[np.ndarray] = []
    for k, words in enumerate(n):
        at = first[k]
        if words >= width:
            x = np.sort(full[at : at + words - width + 1])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif words:
            v = np.full(1, words, np.uint64)
            for j in range(words):
                v = v * _C + h[at + j : at + j + 1]
            x = mix(v)
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out


def with_set_ids(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and ``set_id``, the name of the text's set of shingles, null for texts without any; no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, names.index(text_col)):
                ids = pa.array([set_id(x) if len(x) else None for x in shingle_sets(buf, offs)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, "set_id"])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField("set_id", LongType())]))


def needed(n: np.ndarray | int, percent: int = 75) -> np.ndarray | int:
    """The least overlap that a set of n shingles has with any set it links to."""
    return (percent * n + 99) // 100


def shared_needed(n: np.ndarray | int, percent: int = 75) -> np.ndarray | int:
    """How many of its first shingles a set of n shares with those of any set it links to, at least."""
    return np.minimum(SHARED, needed(n, percent))


def signature(x: np.ndarray) -> bytes:
    """Parities of the shingles over a power of two of bits, at least 64 and at least four per shingle."""
    bits = 64
    while bits < 4 * len(x):
        bits *= 2
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sig: bytes, size: int) -> np.ndarray:
    """The signature on fewer bits: parities of the upper half are added to the lower half."""
    x = np.frombuffer(sig, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def set_id(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def overlap_bound(na: np.ndarray, nb: np.ndarray, differing: np.ndarray) -> np.ndarray:
    return (na + nb - differing) // 2


def links(na: np.ndarray, nb: np.ndarray, overlap: np.ndarray, percent: int = 75) -> np.ndarray:
    """100 * intersection >= percent * union."""
    return 100 * overlap >= percent * (na + nb - overlap)


def _set_rows(docs: DataFrame) -> DataFrame:
    """Rows of kind 0 (one per text: id, n, set, signature) and kind 1 (shingles frequent in a stretch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "sid", "sig"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def frequent():
            if not held:
                return None
            x = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
            count = np.diff(np.append(at, len(x)))
            often = count >= max(4, FREQUENT * len(held))
            held.clear()
            seen.clear()
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array([1] * k, kinds[0]), pa.nulls(k, kinds[1]), pa.array(count[often].astype(np.int64)), pa.array(x[at[often]].view(np.int64)), pa.nulls(k, kinds[4])], names=names)

        for batch in batches:
            for part, buf, offs in slices(batch, 1):
                sets = shingle_sets(buf, offs)
                ids = [set_id(x) if len(x) else None for x in sets]
                for s, x in zip(ids, sets, strict=True):
                    if s is not None and s not in seen:
                        seen.add(s)
                        held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), kinds[0]), part.column(0), pa.array(list(map(len, sets)), kinds[2]), pa.array(ids, kinds[3]), pa.array([signature(x) if len(x) else None for x in sets], kinds[4])], names=names)
                if len(held) >= STRETCH_TEXTS and (rows := frequent()) is not None:
                    yield rows
        if (rows := frequent()) is not None:
            yield rows

    return docs.mapInArrow(released(run), "kind int, doc_id long, n long, sid long, sig binary")


def _postings(docs: DataFrame, frequent: np.ndarray, parts: int, percent: int) -> DataFrame:
    """(part, blob): the prefixes' shingles, dealt by shingle; each set once per task."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value  # sorted shingles; the later a shingle's rank the later it comes
        last, rank = order[0], order[1]
        maybe = np.zeros(1 << 20, bool)
        maybe[last >> np.uint64(44)] = True
        seen: set[int] = set()
        tokens, sids, sizes, lens = [], [], [], []

        def packed() -> pa.RecordBatch | None:
            if not sids:
                return None
            flat = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(sids), dtype=np.int32), lens)
            part = (flat % np.uint64(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            flat, owner, part = (flat // np.uint64(parts))[by], owner[by], part[by]
            sid, size = np.array(sids, np.int64), np.array(sizes, np.int32)
            cut = np.searchsorted(part, np.arange(parts + 1))
            ks = [k for k in range(parts) if cut[k + 1] > cut[k]]
            out = []
            for k in ks:
                own, at = np.unique(owner[cut[k] : cut[k + 1]], return_inverse=True)
                short = (flat[cut[k] : cut[k + 1]] & np.uint64(0xFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((sid[own].tobytes(), size[own].tobytes(), at.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes(), short.tobytes()))
            for held in (tokens, sids, sizes, lens):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], names=["part", "sid", "n", "owner", "token"])

        text = 0
        for batch in batches:
            for _, buf, offs in slices(batch, 1):
                for x in shingle_sets(buf, offs):
                    if not len(x) or (s := set_id(x)) in seen:
                        continue
                    seen.add(s)
                    p = len(x) - needed(len(x), percent) + int(shared_needed(len(x), percent))
                    at = np.flatnonzero(maybe[x >> np.uint64(44)])
                    if len(at):
                        k = np.minimum(np.searchsorted(last, x[at]), len(last) - 1)
                        hit = last[k] == x[at]
                        at, k = at[hit], k[hit]
                    if len(at):
                        rest = np.delete(x, at)
                        x = np.concatenate([rest, x[at[np.argsort(rank[k], kind="stable")]]])
                    tokens.append(x[:p])
                    sids.append(s)
                    sizes.append(len(x))
                    lens.append(p)
                text += len(buf)
                if text >= PACK_BYTES:
                    text = 0
                    if (rows := packed()) is not None:
                        yield rows
        if (rows := packed()) is not None:
            yield rows

    return docs.mapInArrow(released(run), "part int, sid binary, n binary, owner binary, token binary")


def _tile_edges(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of all postings of some shingles: for each shingle and band tile, its least set as pivot and the others.

    One row for each pair of pivot and other: whether three or more sets met in one of its tiles, how many shared
    shingles were seen, and how many are asked.
    """
    sid, size, token = [], [], []
    for s, n, o, t in zip(pdf["sid"], pdf["n"], pdf["owner"], pdf["token"], strict=True):
        raw = np.frombuffer(t, np.uint8).reshape(-1, 5)
        own = np.frombuffer(o, np.uint16 if len(o) == 2 * len(raw) else np.uint32)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        token.append(wide.view(np.uint64)[:, 0])
        sid.append(np.frombuffer(s, np.int64)[own])
        size.append(np.frombuffer(n, np.int32)[own])
    sid, size, token = np.concatenate(sid), np.concatenate(size), np.concatenate(token)
    order = np.argsort(token, kind="stable")
    token, sid, size = token[order], sid[order], size[order]
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    token, sid, size = token[shared], sid[shared], size[shared]
    band = np.searchsorted(_BANDS, size, "right").astype(np.uint64)
    # sets of one band or of neighbouring ones meet: each goes to the tile of its band and to the next
    tile = np.concatenate([band, band + np.uint64(1)])
    token, sid, size, band = (np.concatenate([v, v]) for v in (token, sid, size, band))
    key = token << np.uint64(7) | tile
    order = np.lexsort((sid, key))
    key, sid, size, band, tile = key[order], sid[order], size[order], band[order], tile[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    if not len(key):
        return pd.DataFrame({c: [] for c in ("p", "s", "big", "seen", "asked")})
    begin = np.flatnonzero(first)
    # an own set may come twice to a tile of equal shingles; tiles count distinct sets
    fresh = first.copy()
    fresh[1:] |= sid[1:] != sid[:-1]
    distinct = np.add.reduceat(fresh.astype(np.int64), begin)
    at = np.cumsum(first) - 1
    pivot, many = sid[begin][at], (distinct >= 3)[at]
    # a shingle counts for a pair in one tile only, that of the larger band
    seen = fresh & (np.maximum(band, band[begin][at]) == tile)
    asked = np.minimum(shared_needed(size, percent), shared_needed(size[begin][at], percent))
    # sets that meet their pivot alone matter as a pair only, which their sizes may rule out
    with_pivot = size[begin][at]
    other = (sid != pivot) & (many | (100 * np.minimum(size, with_pivot) >= percent * np.maximum(size, with_pivot)))
    return _merged_pairs(pivot[other], sid[other], many[other], seen[other], asked[other])


def _merged_pairs(p: np.ndarray, s: np.ndarray, big: np.ndarray, seen: np.ndarray, asked: np.ndarray) -> pd.DataFrame:
    """Distinct pairs: big if any repeat is, how many shared shingles were seen, and how many are asked."""
    if not len(p):
        return pd.DataFrame({"p": p, "s": s, "big": big, "seen": seen, "asked": asked})
    order = np.lexsort((s, p))
    p, s, big, seen, asked = (v[order] for v in (p, s, big, seen, asked))
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(head)
    return pd.DataFrame({"p": p[at], "s": s[at], "big": np.maximum.reduceat(big.astype(np.int8), at), "seen": np.add.reduceat(seen.astype(np.int32), at), "asked": np.minimum.reduceat(asked, at)})


def _edges(found: DataFrame) -> DataFrame:
    """The distinct pairs of all parts: ``p, s, big, pair``.

    Two sets that link share ``asked`` of their first shingles at least.  A pair of which so many were seen is
    verified as such; other edges matter only as members of larger tiles, which are compared whole later.
    """
    merged = found.groupBy("p", "s").agg(F.max("big").alias("big"), F.sum("seen").alias("seen"), F.min("asked").alias("asked"))
    return merged.select("p", "s", (F.col("big") > 0).alias("big"), (F.col("seen") >= F.col("asked")).alias("pair")).where("big or pair")


def _at_pivots(pairs: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``pairs`` with the row of ``table`` (keyed ``p``); a pivot's row goes to at most ``SALTS`` tasks and its pairs are spread over them."""
    salted = pairs.withColumn("z", F.pmod(F.xxhash64("s"), F.lit(SALTS)))
    heads = salted.select("p", "z").distinct().join(table, "p", how)
    return salted.join(heads, ["p", "z"]).drop("z")


def _bound_passes(n_a, sig_a, n_b, sig_b, percent: int) -> np.ndarray:
    keep = np.zeros(len(n_a), bool)
    for k, (na, a, nb, b) in enumerate(zip(n_a, sig_a, n_b, sig_b, strict=True)):
        if 100 * min(na, nb) < percent * max(na, nb):
            continue
        size = min(len(a), len(b))
        differing = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
        keep[k] = links(na, nb, overlap_bound(na, nb, differing), percent)
    return keep


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _bound_passes(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), percent)
            yield batch.select(["p", "s"]).filter(pa.array(keep))

    left = sets.select(F.col("sid").alias("p"), F.col("n").alias("np"), F.col("sig").alias("gp"))
    right = sets.select(F.col("sid").alias("s"), F.col("n").alias("ns"), F.col("sig").alias("gs"))
    return _at_pivots(pairs, left).join(right, "s").select("p", "s", "np", "gp", "ns", "gs").mapInArrow(released(run), "p long, s long")


def _arrays(docs: DataFrame, classes: DataFrame, pairs: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Sorted arrays (``sid, x``) of the sets in ``pairs`` that no table of ``known`` has; only their texts are read again."""
    wanted = pairs.select(F.col("p").alias("sid")).unionByName(pairs.select(F.col("s").alias("sid"))).distinct()
    for table in known:
        wanted = wanted.join(table.select("sid"), "sid", "left_anti")
    # written first, so that its size is known: a small list is sent to the texts, a large one joined by shuffle
    ids = written(wanted.join(classes, "sid").select(F.col("rep").alias("want")).distinct(), "jaccard-ids")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in slices(batch, 1):
                sets = [x for x in shingle_sets(buf, offs) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sid", "x"])

    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi").select("doc_id", "text")
    out = written(texts.mapInArrow(released(arrays), "sid long, x binary").dropDuplicates(["sid"]), "jaccard-arrays")
    discard(ids)
    return out


def _verified(pairs: DataFrame, arrays: list[DataFrame], percent: int) -> DataFrame:
    """Pairs that link, by exact intersection of the sorted arrays."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                keep.append(bool(links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent)))
            yield batch.select(["p", "s"]).filter(pa.array(keep, pa.bool_()))

    payload = arrays[0]
    for table in arrays[1:]:
        payload = payload.unionByName(table)
    left = payload.select(F.col("sid").alias("p"), F.col("x").alias("xp"))
    right = payload.select(F.col("sid").alias("s"), F.col("x").alias("xs"))
    return written(_at_pivots(pairs, left).join(right, "s").select("p", "s", "xp", "xs").mapInArrow(released(check), "p long, s long"), "jaccard-links")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    a = labels.select(F.col("node").alias("p"), F.col("label").alias("lp"))
    b = labels.select(F.col("node").alias("s"), F.col("label").alias("ls"))
    return _at_pivots(pairs, a, "left").join(b, "s", "left").where("coalesce(lp, p) <> coalesce(ls, s)").select("p", "s")


def _open_tiles(edges: DataFrame, labels: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """Candidate pairs within tiles whose members lie in several components, from signatures alone."""
    # a tile of two sets is its pivot's pair and has been verified; others may hold pairs without the pivot
    edges = edges.where("big")
    members = edges.select("p", "s").unionByName(edges.select("p", F.col("p").alias("s")).distinct())
    members = members.join(labels.select(F.col("node").alias("s"), "label"), "s", "left").select("p", "s", F.coalesce("label", "s").alias("c"))
    groups = members.groupBy("p").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 2 and lo <> hi").select("p", F.ceil(F.col("k") / BLOCK).cast("int").alias("nb"))
    placed = _at_pivots(members, groups).join(sets.select(F.col("sid").alias("s"), "n", "sig"), "s").withColumn("b", F.pmod(F.xxhash64("s"), F.col("nb")).cast("int"))
    tiles = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("p", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "s", "c", "n", "sig", "b")
    ordered = tiles.repartition(parts, "p", "bi", "bj").sortWithinPartitions("p", "bi", "bj", "s")

    def compare(rows: pd.DataFrame) -> tuple[list[int], list[int]]:
        n, c, s, b = (rows[x].to_numpy() for x in ("n", "c", "s", "b"))
        size = min(map(len, rows["sig"]))
        sig = np.stack([folded(g, size) for g in rows["sig"]]).view(np.uint64)
        across = len(np.unique(b)) > 1
        out_p, out_s = [], []
        for k in range(len(n) - 1):
            j = np.arange(k + 1, len(n))
            j = j[(c[j] != c[k]) & (100 * np.minimum(n[j], n[k]) >= percent * np.maximum(n[j], n[k]))]
            if across:
                j = j[b[j] != b[k]]
            if len(j):
                differing = np.bitwise_count(sig[j] ^ sig[k]).sum(axis=1).astype(np.int64)
                j = j[links(n[j], n[k], overlap_bound(n[j], n[k], differing), percent)]
                out_p += [int(s[k])] * len(j)
                out_s += s[j].tolist()
        return out_p, out_s

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in frames:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = rows[["p", "bi", "bj"]].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, int)
            ps, ss = [], []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if z - a > 1:
                    p, s = compare(rows.iloc[a:z])
                    ps += p
                    ss += s
            held = rows.iloc[cut[-1] :] if len(cut) else rows
            yield pd.DataFrame({"p": np.array(ps, np.int64), "s": np.array(ss, np.int64)})
        if held is not None and len(held) > 1:
            p, s = compare(held)
            yield pd.DataFrame({"p": np.array(p, np.int64), "s": np.array(s, np.int64)})

    return ordered.mapInPandas(released(run), "p long, s long").select(F.least("p", "s").alias("p"), F.greatest("p", "s").alias("s")).distinct()


def jaccard_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, set_id, group_id`` of every row.

    Two texts link when 100 * intersection >= percent * union of their shingle sets; the component id is the
    least id that links reach.  ``set_id`` names the row's set as :func:`with_set_ids` does, and ``group_id`` its
    component, also where rows of several components have one id; both are null without shingles.  Null and empty texts have no shingles, link with nothing and are their own
    component; null ids stay null and never become a component id while a named row is in the component.
    Repeated rows are rows of one class; a very long text is one row of its set and is read whole; other columns
    are ignored; an empty table gives an empty table.  The result is a table in the shared folder; all others
    made on the way are deleted.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(_set_rows(docs), "jaccard-sets")
    texts = rows.where("kind = 0")
    counts = texts.agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).first()
    often = rows.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, FREQUENT * counts.docs))
    often = often.orderBy(F.desc("n"), "sid").limit(MOST_FREQUENT).toPandas().sort_values(["n", "sid"])
    shingle = often["sid"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(shingle)
    frequent = (shingle[by], np.arange(len(shingle))[by])
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), int((counts.shingles or 0) * 0.26 / PART_POSTINGS))
    classes = written(texts.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "jaccard-classes")
    found = _postings(docs, frequent, parts, percent).groupBy("part").applyInPandas(released_group(lambda pdf: _tile_edges(pdf, percent)), "p long, s long, big byte, seen int, asked byte")
    edges = written(_edges(found), "jaccard-edges")
    candidates = written(_bounded(edges.where("pair").select("p", "s"), classes, percent), "jaccard-pairs")
    # one pivot for each set first: within a group of copies that already joins nearly all, and little is left to verify
    first = written(candidates.groupBy("s").agg(F.min("p").alias("p")).select("p", "s"), "jaccard-first")
    arrays, found_links, labels = [], [], components(first.limit(0).select(F.col("p").alias("a"), F.col("s").alias("b")))
    for step in range(3):
        if step == 0:
            pairs = first
        elif step == 1:
            pairs = written(_apart(candidates, labels), "jaccard-rest")
        else:
            pairs = written(_open_tiles(edges, labels, classes, parts, percent), "jaccard-open")
        if pairs.limit(1).count():
            arrays.append(_arrays(docs, classes, pairs, arrays))
            found_links.append(_verified(pairs, arrays, percent))
            all_links = found_links[0]
            for more in found_links[1:]:
                all_links = all_links.unionByName(more)
            discard(labels)
            labels = components(all_links.select(F.col("p").alias("a"), F.col("s").alias("b")))
        discard(pairs)
    group = classes.join(labels, classes.sid == labels.node, "left").select("sid", "rep", F.coalesce("label", "sid").alias("label"))
    least = group.groupBy("label").agg(F.min("rep").alias("component"))
    owner = group.join(least, "label").select(F.col("sid").alias("own"), "label", "component")
    result = texts.join(owner, texts.sid == owner.own, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("sid").alias("set_id"), F.col("label").alias("group_id"))
    result = written(result, "jaccard-components")
    discard(rows, classes, edges, candidates, labels, *arrays, *found_links)
    return result
