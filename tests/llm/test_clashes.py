"""Every operator on a table whose further columns bear the names that operators use inside, with odd rows."""

import pytest
from pyspark.sql import functions as F

from wayring.llm import fingerprint, jaccard, language_id, media, mixing, packing, piece_codec, queries, sharding, suffix_dedup, token_count, toxicity

NAMES = (
    "id size h k band bucket ghost state part key n word words name share shard offset digest sid set_id group_id label node score doc_tokens window_size virtual_slot text_crc32 crc payload media_bytes feature"
    " letters k0 __id __y __t __h run slot target taken base extra quota source_size lang_pred predicted held_out ids fingerprint n_bytes n_tokens n_removed kept_sha256 start length sequence_id"
).split()
LONG = "ein langer Text ohne Ende " * 40_000
ROWS = [(1, None, "de", "a"), (2, "", None, None), (None, "kein Name", "de", "a"), (4, "gleich und gleich gesellt sich gern", "de", "b"), (4, "gleich und gleich gesellt sich gern", "de", "b"), (5, LONG, "de", "a"), (6, "the same words again and again", "en", "a")]

PIECES, WORDS = queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("word_bpe_49k.json")


def predicted(docs):
    return language_id.predict(docs, language_id.train(docs, PIECES), PIECES)


def scored(docs):
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    params = toxicity.FtrlParams(bits=12, shards=2)
    return toxicity.score(docs, toxicity.train(docs, labels, params), params)


OPERATORS = {
    "token_counts": lambda docs: token_count.token_counts(docs, PIECES),
    "toxicity": scored,
    "suffix_dedup": suffix_dedup.dedup_substrings,
    "fingerprints": fingerprint.fingerprints,
    "jaccard": jaccard.jaccard_components,
    "mixing": mixing.mix_sources,
    "sharding": lambda docs: sharding.shard_records(docs, shards=3),
    "language_id": predicted,
    "packing": lambda docs: packing.pack_documents(docs, WORDS),
    "media": lambda docs: media.media_columns(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"),  # shards have names of their own
    "piece_codec": lambda docs: piece_codec.decode_pieces(piece_codec.encode_pieces(docs, PIECES), PIECES),
}


def rows_of(found):
    return sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, name):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").coalesce(1)
    crowded = plain.select("*", *(F.lit(f"other {n}").alias(n) for n in NAMES))
    got = OPERATORS[name](crowded)
    assert rows_of(got) == rows_of(OPERATORS[name](plain))
    if name != "packing":  # which has a row per piece
        assert got.count() == len(ROWS)
    assert OPERATORS[name](crowded.where("false")).collect() == []
