"""Bounds of memory and of work: many short lines, awkward budgets, one shard a partition, rows added in blocks."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from wayring.llm import fingerprint, mixing, suffix_dedup, token_count, toxicity


def naive_paragraph_sum(parts):
    total = np.zeros(fingerprint.LANES, np.uint16)
    for p in parts:
        total = total + np.frombuffer(hashlib.shake_128(p.encode()).digest(2 * fingerprint.LANES), "<u2")
    return total


def test_paragraph_sums_of_repeated_lines():
    rng = random.Random(1)
    for n in (0, 1, 700, 3000):
        parts = [f"line {rng.randrange(900)}" for _ in range(n)] + ["x"] * (70_000 if n == 700 else 0)
        assert (fingerprint.paragraph_sum(parts) == naive_paragraph_sum(parts)).all()


@pytest.mark.parametrize("distinct", [26, 60_000])
def test_a_text_of_a_million_short_lines_needs_little_memory(distinct):
    text = "\n".join(f"{k % distinct:x}" for k in range(1_000_000))
    tracemalloc.start()
    fingerprint.paragraph_sum(fingerprint.paragraphs(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_budgets_are_fitted_as_by_the_plain_knapsack():
    """Where no documents are shared out in proportion, the fit is the largest sum that the budget holds, or one document more."""
    rng = random.Random(2)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(2, 40, rng.choice([1, 2, 3])), 5)))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, min(4 * int(lengths[-1]), int((lengths * counts).sum()) - 1))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(budget - int((lengths * taken).sum())) <= budget - max(sums)


def test_an_odd_budget_of_even_lengths_needs_little_memory():
    lengths = np.arange(2, 16_002, 2)
    tracemalloc.start()
    taken = mixing.fit_counts(lengths, np.ones(len(lengths), np.int64), 64_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20 and abs(64_001 - int((lengths * taken).sum())) == 1


def test_rows_added_behind_one_pass_in_blocks(monkeypatch):
    """In the first round every new row follows the last old one; no more than a block may pass at once."""
    passed = []
    plain = suffix_dedup.Places.seen
    monkeypatch.setattr(suffix_dedup.Places, "seen", lambda self, rows, a: passed.append(len(rows)) or plain(self, rows, a))
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    size = np.array([len(s) for s in strings])
    owner, length, _ = suffix_dedup.suffix_order(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, block=16)
    assert max(passed) <= 16
    want = sorted((tuple(b + 1000 for b in s[len(s) - k :]) + (i,), i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert list(zip(owner.tolist(), length.tolist(), strict=True)) == [(i, k) for _, i, k in want]


def test_batches_of_the_tokenizer_go_by_bytes(monkeypatch):
    sizes = []

    class Counting:
        def encode(self, texts, num_threads):
            sizes.append(sum(len(t.encode()) for t in texts))
            return [[0] * len(t) for t in texts]

    monkeypatch.setattr(token_count, "_pieces", lambda model: Counting())
    texts = ["中文字" * 50, "plain text " * 20, "é" * 100] * 60
    assert token_count.encoded_lengths(texts, "x.model", batch_bytes=2000) == [len(t) for t in texts]
    assert max(sizes) < 2000 + max(len(t.encode()) for t in texts)


def test_each_shard_has_a_partition_of_its_own(spark):
    for parts in (1, 2, 4, 7):
        numbers = toxicity.leading_numbers(spark, parts)
        rows = spark.createDataFrame([(n,) for n in numbers for _ in range(5)], "shard int").repartition(parts, "shard")
        assert len(numbers) == parts and [len(set(p)) for p in rows.rdd.glom().collect()] == [1] * parts


def test_repeated_ids_enter_the_sample_once(spark):
    rows = [(k % 40, ("bad word here" if k % 2 else "fine text there") + f" {k % 40}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    params = toxicity.FtrlParams(bits=12, shards=2)
    once, often = toxicity.train(docs.dropDuplicates(["doc_id"]), labels, params), toxicity.train(docs, labels, params)
    assert (once[0] == often[0]).all() and (once[1] == often[1]).all()
