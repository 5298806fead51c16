"""Token counts, toxicity, fingerprints, language ID: against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayring.llm import fingerprint, language_id, queries, token_count, toxicity
from wayring.llm._words import prefix_hash, slices, span_hash, spans, word_hash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "x y", None, "a", 3), (4, "Aé 中 </s> ▁▁ word", "fr", "b", 5), (4, "Aé 中 </s> ▁▁ word", "fr", "b", 5), (5, "a\n\nb  c\t" * 9000, "de", "a", 1)]


def table(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as n_tokens", "2 as score", "3 as fingerprint") if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    texts = ["ab  cd", "", "ab", " x ", "ab cd"]
    part, buf, offs = next(slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0))
    starts, ends, first = spans(buf, offs)
    words = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == "ab cd ab x ab cd".split() and np.diff(first).tolist() == [2, 0, 1, 1, 2]
    h = span_hash(prefix_hash(buf), starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3


def regular(n):
    """The two words of n letters a and b in which a letter follows the parity of its place's binary digits."""
    word = bytes(97 + bin(k).count("1") % 2 for k in range(n))
    return word.decode(), bytes(195 - b for b in word).decode()


def test_structured_words_have_different_hashes():
    for n in [1, 7, 8, 9, 63, 64, 65, 256, 1024, 2048, 4096]:
        a, b = (w.encode() for w in regular(n))
        buf = np.frombuffer(b"." + a + b + a, np.uint8)
        h = word_hash(buf, np.array([1, 1 + n, 1 + 2 * n]), np.array([1 + n, 1 + 2 * n, 1 + 3 * n]))
        assert h[0] != h[1] and h[0] == h[2]


def test_split_texts_count_like_whole_ones():
    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp, rng = token_count._pieces(path), random.Random(3)
    parts = ["the ", "a", " ", "  ", "▁", "\n", "\t", "Foo", "é", "中", "</s>", "<s>", " ▁x", " "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert token_count.encoded_lengths([text], path, split_chars=rng.choice([1, 3, 7])) == [len(sp.encode(text))]


def test_token_counts(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = token_count.token_counts(table(spark), path).collect()
    sp = token_count._pieces(path)
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in ODD)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert {r.doc_id: r.over_limit for r in rows}[5] is True
    assert token_count.token_counts(empty(spark), path).count() == 0


def toxic_corpus(spark, n=600):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad = k % 5 == 0
        if bad:
            for w in ("vile", "scum", "rotten"):
                text.insert(rng.randrange(60), w)
        rows.append((k, " ".join(text), "en", "a", 0))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_planted_words(spark):
    docs, labels = toxic_corpus(spark)
    params = toxicity.FtrlParams(bits=16, shards=2)
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"), params)
    got = {r.doc_id: r for r in toxicity.score(docs, model, params).collect()}
    held = [k for k in range(600) if k % 3 == 1]
    assert np.mean([got[k].predicted == (k % 5 == 0) for k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_learns_rare_words_whatever_their_shards(spark):
    """A word in twelve texts, three of them in each of the four shards."""
    rng, words = random.Random(6), [f"w{k}" for k in range(300)]
    shard = {r.id: r.shard for r in spark.range(400).selectExpr("id", "pmod(xxhash64(id), 4) as shard").collect()}
    bad = {k for s in range(4) for k in [k for k in range(400) if shard[k] == s][:3]}
    texts = [[rng.choice(words) for _ in range(40)] for _ in range(400)]
    docs = spark.createDataFrame([(k, " ".join([*t, "vile"] if k in bad else t), "en", "a", 0) for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(400)], "doc_id long, toxic int")
    params = toxicity.FtrlParams(bits=18)
    model = toxicity.train(docs, labels, params)
    new = spark.createDataFrame([(1, "some new text", "en", "a", 0), (2, "some vile new text", "en", "a", 0)], DOCS)
    clean, vile = (r.score for r in toxicity.score(new, model, params).orderBy("doc_id").collect())
    assert vile > clean + 0.2


def test_ftrl_against_plain_python():
    rng, p = random.Random(8), toxicity.FtrlParams(bits=5, l1=0.3)
    rows = [sorted(rng.sample(range(32), rng.randrange(0, 9))) for _ in range(60)]
    labels = [float(3 in r or rng.random() < 0.2) for r in rows]
    z, n = np.zeros(33), np.zeros(33)
    for _ in range(2):
        toxicity.ftrl_pass([np.array(r, int) for r in rows], np.array(labels), z, n, p)
    pz, pn = [0.0] * 33, [0.0] * 33

    def weight(i):
        if i == 32:  # the bias is not regularised
            return -pz[i] / ((p.beta + pn[i] ** 0.5) / p.alpha)
        if abs(pz[i]) <= p.l1:
            return 0.0
        return -(pz[i] - (p.l1 if pz[i] > 0 else -p.l1)) / ((p.beta + pn[i] ** 0.5) / p.alpha + p.l2)

    for row, y in [*zip(rows, labels, strict=True)] * 2:
        w = {i: weight(i) for i in [*row, 32]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i, x in w.items():
            sigma = ((pn[i] + g * g) ** 0.5 - pn[i] ** 0.5) / p.alpha
            pz[i], pn[i] = pz[i] + g - sigma * x, pn[i] + g * g
    assert np.allclose(z, pz) and np.allclose(n, pn) and (np.abs(z[:-1]) <= p.l1).any()


def test_features_against_plain_python():
    texts = ["The cat sat on the cat", "", "a b", "x", "THE cat, sat! on the mat; the cat sat on a é word1"]
    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    doc, key = toxicity.feature_buckets(np.frombuffer(b"".join(data), np.uint8), offs, toxicity.FtrlParams(bits=60))
    want, seen = [], {}
    for d, t in enumerate(data):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.lower())
        grams = [("1", x) for x in w] + [(f"s{s}", w[k], w[k + s]) for s in (1, 2, 3) for k in range(len(w) - s)] + [("3", *w[k : k + 3]) for k in range(len(w) - 2)]
        want += [(d, seen.setdefault(g, len(seen))) for g in grams]
    assert sorted(Counter(doc.tolist()).items()) == sorted(Counter(d for d, _ in want).items())
    profile = lambda pairs: Counter(tuple(sorted(Counter(d for d, k in pairs if k == one).items())) for one in {k for _, k in pairs})
    assert profile(list(zip(doc.tolist(), key.tolist(), strict=True))) == profile(want)


def test_packed_keys():
    for keys in ([], [0], [3, 4, 70_000, (1 << 22)]):
        data = toxicity.packed(np.array(keys, np.int32))
        assert toxicity.unpacked(data, len(keys)).tolist() == keys


def test_toxicity_odd_rows(spark):
    docs, labels = toxic_corpus(spark, 100)
    params = toxicity.FtrlParams(bits=12, shards=2, rounds=1)
    none = toxicity.train(docs, labels.limit(0), params)
    assert {r.score for r in toxicity.score(table(spark), none, params).collect()} == {0.5}
    model = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")), params)
    rows = toxicity.score(table(spark), model, params).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(empty(spark), model, params).count() == 0


def test_multiset_hash_is_order_free_and_incremental():
    a, b, c = "one two three", "four five six", "seven"
    whole = fingerprint.paragraph_sum([a, b, c])
    assert (whole == fingerprint.paragraph_sum([c, a, b])).all()
    assert (fingerprint.edited_sum(whole, [a, b, c], [c, b]) == fingerprint.paragraph_sum([b, c])).all()
    assert (fingerprint.paragraph_sum([a, a]) != fingerprint.paragraph_sum([a])).any()


def plain_state(text):
    """One paragraph at a time, by the same two hashes of a paragraph."""
    vector, lanes = np.zeros(1024, np.uint16), np.zeros(256, np.int64)
    for p in text.split("\n"):
        if p:
            vector = vector + fingerprint.paragraph_sum([p])
            lanes = lanes + fingerprint.likeness_vectors([p])[0]
    return fingerprint.packed_state(vector, lanes)


def test_stored_fingerprints_are_updated_without_their_texts(spark):
    rows = [(1, "one two three four\nfive six seven\n\nlast", "en", "s", 0), (2, None, "en", "s", 0)]
    stored = fingerprint.fingerprints(table(spark, rows), states=True)
    changes = stored.selectExpr("doc_id", "state", "if(doc_id = 1, array('five six seven'), null) as removed", "array('new words come here', '', null) as added", "1 as fingerprint")
    got = {r.doc_id: r for r in fingerprint.update_fingerprints(changes).collect()}
    want = {1: "one two three four\nlast\nnew words come here", 2: "new words come here"}
    for k, text in want.items():
        assert got[k].state == plain_state(text) and got[k].fingerprint == fingerprint.digest(plain_state(text))


def test_likeness_of_very_repetitive_texts():
    many, few, other = fingerprint.likeness_vectors(["x y z\n" * 65_536, "x y z\n" * 20_000, "a b c\n" * 40_000])
    near = fingerprint.likeness(np.array([many, many, many * 0]), np.array([few, other, other]))
    assert near[0] == 1.0 and near[1] < 0.2 and near[2] == 0.0


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(rng.choice(["uno", "dos", "tres", "é", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))) or None, "en", "s", 0) for k in range(0, 90, 2)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(table(spark, rows), bucket_bytes=500, states=True).collect()}
    order = sorted(rows, reverse=True)
    for k, row in enumerate(order):
        text, following = row[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edit = text[: len(text) - n] + following[:n]
        r = got[row[0]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        states = [plain_state(t) for t in (text, edit, following)]
        assert (r.fingerprint, r.edited_fingerprint, r.state) == (fingerprint.digest(states[0]), fingerprint.digest(states[1]), states[0])
        a, b, c = (np.frombuffer(x, "<i8", offset=2048).astype(float) for x in states)
        for got_near, other, same in ((r.near_edited, b, text == edit), (r.near_next, c, False)):
            size = np.sqrt((a @ a) * (other @ other))
            assert got_near == pytest.approx(1.0 if same or not (a.any() or other.any()) else max(0.0, a @ other / size) if size else 0.0)
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    assert fingerprint.fingerprints(table(spark)).count() == len(ODD)
    lone = fingerprint.fingerprints(table(spark, ODD[3:4])).first()
    assert lone.near_next == 1.0


def all_segmentations(word, probs):
    if not word:
        return 1.0
    return sum(probs[p] * all_segmentations(word[len(p) :], probs) for p in probs if word.startswith(p))


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    probs = rng.random((len(vocab.pieces), 2))
    probs /= probs.sum(0)
    for word in (b" the", b" ing", b" abab", b" " + "é".encode()):
        m = np.frombuffer(word, np.uint8).reshape(1, -1)
        got = np.exp(language_id.forward(m, probs, vocab))[0]
        inside = {p: k for k, p in enumerate(vocab.pieces) if p in word}
        for lang in (0, 1):
            assert got[lang] == pytest.approx(all_segmentations(word, {p: probs[k, lang] for p, k in inside.items()}))
        counts = language_id.expected_counts(m, np.array([2.0]), np.array([1]), probs, vocab)
        assert (counts[:, 1] @ np.array([len(p) for p in vocab.pieces])) == pytest.approx(2.0 * len(word)) and counts[:, 0].sum() == 0


def segmentations(word, pieces):
    if not word:
        return [()]
    return [(p, *rest) for p in pieces if word.startswith(p) for rest in segmentations(word[len(p) :], pieces)]


def test_expected_counts_against_all_segmentations():
    vocab = language_id.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    probs = np.random.default_rng(3).random((len(vocab.pieces), 2))
    words, counts, langs = [b" the", b" ing", b" the"], np.array([2.0, 5.0, 1.0]), np.array([1, 0, 0])
    got = language_id.expected_counts(np.frombuffer(b"".join(words), np.uint8).reshape(3, -1), counts, langs, probs, vocab)
    want = np.zeros(probs.shape)
    for word, n, k in zip(words, counts, langs, strict=True):
        inside = {p: at for at, p in enumerate(vocab.pieces) if p in word}
        ways = [[inside[p] for p in way] for way in segmentations(word, inside)]
        share = np.array([probs[way, k].prod() for way in ways])
        for way, part in zip(ways, share / share.sum(), strict=True):
            for at in way:
                want[at, k] += n * part
    assert np.allclose(got, want)


def test_language_id_in_small_blocks(spark, monkeypatch):
    model = queries.tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, [(1, "das ist gut und das ist schlecht", "de", "a", 0), (2, "this is good and that is bad", "en", "a", 0)])
    trained = language_id.train(docs, model)
    whole = sorted(language_id.predict(docs, trained, model).collect())
    monkeypatch.setattr(language_id, "CELLS", 50)
    assert sorted(language_id.predict(docs, trained, model).collect()) == whole


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_id_odd_rows(spark):
    model = queries.tokenizer_path("piece_bpe_32k.model")
    train = table(spark, [(1, "das ist gut und das ist schlecht", "de", "a", 0), (2, "this is good and that is bad", "en", "a", 0), (None, "x", "en", "a", 0), (3, None, "en", "a", 0)])
    trained = language_id.train(train, model)
    rows = language_id.predict(table(spark, [*ODD, (9, "123 !!", "en", "a", 0), (10, "this and that", None, "a", 0)]), trained, model).collect()
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (1, 2, 9)] == ["und"] * 3 and by[10].lang_pred == "en" and len(rows) == len(ODD) + 2
    none = language_id.train(empty(spark), model)
    assert {r.lang_pred for r in language_id.predict(table(spark), none, model).collect()} == {"und"}
