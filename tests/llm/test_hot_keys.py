"""One phrase in every document: its key is cut again and dealt to many parts, with the same result."""

import random

import numpy as np
import pytest

from test_corpus_operators import removed_by_brute_force
from wayring.llm import suffix_dedup


def phrase_rows(n, seed):
    rng = random.Random(seed)
    phrase = "this very phrase of thirty-two and more bytes is everywhere"
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    near = [word() for _ in range(6)]
    rows = []
    for k in range(n):
        around = lambda: " ".join(rng.choice([word(), rng.choice(near), rng.choice(near)]) for _ in range(rng.randint(0, 12)))
        rows.append((k * 7 % n, around() + " " + phrase + " " + around(), "en", "a", 0))
    return rows


def test_segments_cut_again_hold_the_same_strings():
    rows = phrase_rows(60, 1)
    data = [r[1].encode() for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    buf = np.frombuffer(b"".join(data), np.uint8)
    begin, size, _, key = suffix_dedup.segments(buf, offs)
    again, sizes, keys, source = suffix_dedup.cut_again(buf, begin, size, key)
    strings = lambda b, s: sorted(buf[x : x + 50].tobytes() for a, n in zip(b.tolist(), s.tolist(), strict=True) for x in range(a, a + n - 49))
    assert strings(again, sizes) == strings(begin, size) and (again >= begin[source]).all() and (again + sizes <= (begin + size)[source]).all()
    named = {}
    for a, n, k in zip(again.tolist(), sizes.tolist(), keys.tolist(), strict=True):
        for x in range(a, a + n - 49):
            assert named.setdefault(buf[x : x + 50].tobytes(), k) == k  # equal strings have one key
    assert len(set(keys.tolist())) > len(set(key.tolist()))


@pytest.mark.parametrize("hot_segments", [0, 3, 1 << 30])
def test_a_phrase_in_every_document(spark, hot_segments):
    rows = phrase_rows(150, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.n_bytes): [(r.n_removed, r.n_spans, r.kept_sha256)] for r in suffix_dedup.dedup_substrings(docs, hot_segments=hot_segments).collect()}
    assert got == removed_by_brute_force(rows)


def test_hot_keys_are_told_by_all_buckets_together():
    import pyarrow as pa

    def blob(keys):
        distinct, counts = np.unique(np.array(keys, np.uint64), return_counts=True)
        more = np.flatnonzero(counts > 1)
        return suffix_dedup._pack(np.diff(distinct, prepend=np.uint64(0))), suffix_dedup._pack(np.stack([more, counts[more] - 1], axis=1).astype(np.int32).ravel())

    buckets = [[5, 5, 5, 9], [5, 7, 9], [7]]
    keys, more = zip(*map(blob, buckets), strict=True)
    table = pa.table({"part": pa.array([0] * 3, pa.int32()), "bucket": pa.array([0, 1, 2], pa.int32()), "keys": pa.array(keys, pa.binary()), "more": pa.array(more, pa.binary())})
    for most, want in ((3, {0: [5], 1: [5]}), (1, {0: [5, 9], 1: [5, 7, 9], 2: [7]}), (4, {})):
        found = {}
        for row in suffix_dedup._shared_keys(table, most).to_pylist():
            own = sorted(set(buckets[row["bucket"]]))
            hot = [own[k] for k in suffix_dedup._unpack(row["hot"], np.int32).tolist()]
            if hot:
                found[row["bucket"]] = hot
        assert found == want
