"""SentencePiece coding, vector codes and collocations: against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import oracle as side_by_side
import pytest

from wayring.llm import collocations, oracle, piece_codec, queries, vector_codes

SF = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string"


@lru_cache
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encoded(texts, part_bytes=piece_codec.PART_BYTES):
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return [ids.tolist() for ids in piece_codec.encode_texts(piece_codec.PieceEncoder(MODEL), np.frombuffer(b"".join(data), np.uint8), offs, part_bytes)]


def odd_text(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("ab \n▁aaei.,1<>0xé中国日本の😀\x00\t") for _ in range(rng.randint(0, 60)))
    if kind < 0.6:
        return "".join(library().id_to_piece(rng.randint(259, 31_999)) for _ in range(rng.randint(0, 12))).replace("▁", " ")
    if kind < 0.7:
        return "".join(" " * rng.randint(0, 90) + rng.choice(["", "é", "a", "x y"]) for _ in range(3))
    if kind < 0.8:
        return rng.choice("abteno") * rng.randint(0, 200) + rng.choice(["", "ab" * 30, "aba" * 20])
    return "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 80)))


def test_encoding_and_decoding_equal_the_library():
    rng = random.Random(1)
    texts = [odd_text(rng) for _ in range(4000)] + ["", " ", "▁", "</s>", "<0x41>", " " * 5000, "a" * 3001]
    got, want = encoded(texts), library().encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert got == want
    offs = np.concatenate([[0], np.cumsum([len(g) for g in got])])
    decoded = piece_codec.decode_ids(piece_codec.PieceModel(MODEL), np.array(sum(got, []), np.uint32), offs)
    assert [d.decode() for d in decoded] == library().decode(want)


def test_decoding_of_any_ids_equals_the_library(monkeypatch):
    monkeypatch.setattr(piece_codec, "PART_IDS", 3)
    rng = random.Random(2)
    lone = piece_codec.PieceModel(MODEL).lone
    rows = [[rng.choice([rng.randint(0, 31_999), rng.randint(3, 258), rng.randint(0, 3), lone, 259, 260]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    decoded = piece_codec.decode_ids(piece_codec.PieceModel(MODEL), np.array(sum(rows, []), np.uint32), offs)
    assert [d.decode() for d in decoded] == library().decode(rows)


def test_long_texts_are_cut_where_no_merge_crosses():
    rng = random.Random(3)
    text = "".join(odd_text(rng) for _ in range(1500)) + "é" * 5000 + " " * 3000 + "a" * 3000
    for part in (50, 777):
        assert encoded([text], part) == [library().encode(text, add_bos=True, add_eos=True)]


def test_merge_rounds_equal_merging_one_by_one():
    # merging both pairs of abab at once would miss "aba", which comes up after the first of them and ranks before it
    model = piece_codec.PieceModel(MODEL)
    model.base, scores = 1000, {"ab": -2.0, "aba": -1.0, "bab": -3.0, "cab": -2.0, "ca": -4.0, "abab": -2.0, "aa": -2.0, "aaa": -2.0}
    number = {c: k for k, c in enumerate(["a", "b", "c", *scores])}
    ranks = np.searchsorted(np.unique([-s for s in scores.values()]), [-s for s in scores.values()])
    table = sorted((number[p[:i]] * 1000 + number[p[i:]], number[p], int(ranks[number[p] - 3])) for p in scores for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
    model.pairs, model.target, model.rank = (np.array(x, t) for x, t in zip(zip(*table, strict=True), (np.int64, np.int32, np.int32), strict=True))
    spelled = {v: k for k, v in number.items()}

    def one_by_one(word):
        parts = list(word)
        while found := [(-scores[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in scores]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    rng = random.Random(4)
    words = ["".join(rng.choice("abc" if rng.random() < 0.5 else "ab") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    flat, first = model.merged(np.array([number[c] for w in words for c in w], np.int32), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    for k, word in enumerate(words):
        assert [spelled[s] for s in flat[first[k] : first[k + 1]].tolist()] == one_by_one(word)


def test_piece_codec_query(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (None, "x y", None), (4, "Aé 中 </s> word", "fr"), (4, "Aé 中 </s> word", "fr"), (5, "a\n\nb  c\t" * 40_000, "de")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as ids", "2 as n_tokens", "'x' as decoded")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_piece_codec(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = library().encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library().decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_piece_codec(spark, f"{tmp_path}/none").collect() == []


def test_whole_tables_equal_their_sql(spark):
    con = side_by_side.connect(SF)
    for name, sql in oracle.ORACLE_SQL.items():
        assert side_by_side.differences(spark, con, name, queries.QUERIES[name], sql, SF) == []


def codes_by_brute_force(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    best = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, best(cut(v, p), p)[1]].append(cut(v, p))
        for (p, k), found in members.items():
            books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = []
    for i, v, label in kept:
        found = [best(cut(v, p), p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = Counter()
    for *_, error, label in out:
        sums[label] += error
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], sha) for i, code, error, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed, scale=1.0):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(k * 7 % 300, [f32(scale * rng.choice([rng.gauss(0, 0.2), -0.5, 0.25])) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(250)]
    rows += [rows[0], rows[3], (None, rows[5][1], 9), (301, None, 1), (302, [], 1), (303, [1.0] * 7 + [None], 1), (304, [1.0] * 7 + [float("nan")], 2), (305, [1.0] * 7 + [float("-inf")], 2)]
    return rows


@pytest.mark.parametrize(("scale", "entries"), [(1.0, 16), (1.0, 256), (2.0**19, 16), (0.0, 4)])
def test_vector_codes_equal_brute_force(spark, scale, entries):
    rows = vector_rows(5, scale)
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as of", "2 as code", "3 as salt", "4 as v").repartition(5)
    got = sorted(map(tuple, vector_codes.vector_codes(table, entries=entries).collect()), key=repr)
    assert got == codes_by_brute_force(rows, 4, entries, 4)


def test_label_errors_without_broadcast(spark):
    rows = vector_rows(6)
    table = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.train(table, entries=16)
    coded = vector_codes.encode_vectors(table, books).cache()
    plain, salted = (sorted(map(tuple, vector_codes.with_label_errors(coded, most).select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) for most in (100, 0))
    assert plain == salted and len(plain) == len(rows) - 5


def test_vectors_without_a_codebook(spark):
    table = spark.createDataFrame(vector_rows(5), VECTORS)
    for some in (table.where("false"), table.where("vec_id > 300")):
        found = vector_codes.vector_codes(some)
        assert found.collect() == [] and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="no 3 equal parts"):
        vector_codes.train(table, parts=3)
    with pytest.raises(Exception, match="different sizes"):
        vector_codes.train(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0] * 8, 1)], VECTORS))


def test_distances_beyond_64_bits_are_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(2**55), 2**55, (20, 4)), rng.integers(-(2**55), 2**55, (9, 4))
    index, error = vector_codes.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(c)) for r in x]
    assert list(zip(error.tolist(), index.tolist())) == want


def phrases_by_brute_force(rows, least=30, keep=2000):
    counts, total = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            counts.update((lang, words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    longest = {}
    for (lang, words), f in counts.items():
        if f >= least:
            for k in range(2, len(words)):
                for i in range(len(words) - k + 1):
                    at = (lang, words[i : i + k])
                    longest[at] = max(longest.get(at, 0), f)
    found = defaultdict(list)
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= least and not 100 * longest.get((lang, words), 0) >= 80 * a:
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, len(words)) for x, y in [(counts[lang, words[:k]], counts[lang, words[k:]])])
            found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, x, y, total[lang], -s) for lang, some in found.items() for k, (s, a, p, x, y) in enumerate(sorted(some)[:keep]))


def phrase_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "of", "to", "zu", "é", "x\x00y", "中", "Ä"] + [f"w{k}" for k in range(30)]
    passage = "one Passage that is in many texts, cut here and there"
    rows = []
    for k in range(n):
        parts = [rng.choice(words) if rng.random() > 0.4 else rng.choice(words[:3]) for _ in range(rng.choice([0, 1, 2, 60]))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]) for p in parts)
        rows.append((k, text + passage * (rng.random() < 0.2), rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return [*rows, (None, None, "en"), (7, "", None), (8, "to to to to to to " * 200, "en"), (9, "a b. " * 5000, "fr"), (9, "a b. " * 5000, "fr")]


@pytest.mark.parametrize(("least", "keep", "shard_bytes"), [(30, 2000, 1 << 24), (3, 25, 1000), (5, 40, 20_000)])
def test_collocations_equal_brute_force(spark, least, keep, shard_bytes):
    rows = phrase_rows(least)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as word", "2 as n", "3 as name", "4 as words", "5 as f").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, least, keep, shard_bytes=shard_bytes).collect()))
    want = phrases_by_brute_force(rows, least, keep)
    assert want and got == want
    assert collocations.collocations(docs.where("false")).collect() == []


def test_collocations_when_names_collide(spark):
    """The most bits of a name with which words share one under the first seed: others are tried until all are distinct."""
    rows = phrase_rows(9, 60)
    texts = [(r[1] or "").encode() for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    langs = np.array([collocations.language_hash("und" if r[2] is None else r[2], 0) for r in rows])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    distinct = [len(collocations.Shard(buf, offs, langs, bits).names) for bits in range(65)]
    bits = max(b for b in range(65) if distinct[b] < distinct[64])
    assert 8 < bits < 32
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, DOCS), 3, 50, name_bits=bits).collect())) == phrases_by_brute_force(rows, 3, 50)


def test_descents_bounded_by_positions():
    rng = random.Random(11)
    text = " ".join(rng.choice(["a", "b", "c", "dd"]) + rng.choice(["", "", "", "."]) for _ in range(3000)).encode()
    shard = collocations.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([5]))
    found = []
    for positions in (1, 100, 1 << 20):
        counts = {}
        for phrases, n in collocations.mined(shard, np.ones(len(shard.names), bool), None, 4, positions=positions):
            counts |= dict(zip(map(tuple, phrases.tolist()), n.tolist(), strict=True))
        found.append(counts)
    assert found[0] == found[1] == found[2]
    assert sum(n for p, n in found[0].items() if len(p) == 2) == sum(max(len(x.split()) - 1, 0) for x in text.decode().split("."))


def test_filters_never_drop_a_member(spark):
    names = spark.range(5000).selectExpr("xxhash64(id) as name", "xxhash64(id, 1) as w2")
    keys = np.array([r.name for r in names.collect()], np.int64).view(np.uint64)
    for most in (1 << 12, 1 << 27):
        assert collocations.filter_of(names, "name", most_bits=most)(keys).all()
    found = collocations.filter_of(names, "name")
    assert found(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.02
    second = np.array([r.w2 for r in names.collect()], np.int64).view(np.uint64)
    assert collocations.filter_of(names, "name", "w2")(collocations.pair_key(keys, second)).all()
