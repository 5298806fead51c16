"""The corpus pipeline: language ID, near-duplicate removal, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.llm import jaccard, language_id, mixing, packing, suffix_dedup
from wayring.llm._io import bounded_batches, discard, written
from wayring.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those without letters or with less than half of the likelihood.

    Null and empty texts go, rows of a null id stay if their text does; repeated rows are judged each; other
    columns are dropped; an empty table gives an empty table.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    model = tokenizer_path("piece_bpe_32k.model")
    known = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    trained = language_id.train(known, model)
    predicted = language_id.predict(docs, trained, model, keep=("text", "lang", "source", "n_chars"))
    return predicted.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each Jaccard component: of the smallest id (null ids last), then of the smallest set name.

    Rows without shingles (null texts and those without words) link with nothing and all stay.  Repeated rows are
    of one component, so one of them stays; rows of one id in several components stay each.  Other columns are
    dropped; an empty table gives an empty table.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = jaccard.jaccard_components(docs).where("group_id is not null")
    rows = groups.groupBy("group_id", "doc_id", "set_id").agg(F.count("*").alias("n"))
    # one least row of each component; the count tells whether that row is there more than once
    least = rows.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "set_id", "n")).alias("least"))
    kept = written(least.select(F.col("least.doc_id").alias("kept_id"), F.col("least.set_id").alias("kept_set"), F.col("least.n").alias("rows")), "pipeline-kept")
    named = jaccard.with_set_ids(docs)
    joined = named.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("set_id") == F.col("kept_set")), "left")
    once = joined.where("set_id is null or rows = 1").select(*COLUMNS)
    if not kept.where("rows > 1").limit(1).count():
        return once
    return once.unionByName(joined.where("rows > 1").dropDuplicates(["doc_id", "set_id"]).select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove bytes whose 50-byte strings occur in a document of a smaller id; a code point that is cut goes whole.

    Every row stays, if only with an empty text; null texts become empty; rows of one id do not count against each
    other, rows of a null id are left whole; other columns are dropped; an empty table gives an empty table.
    """
    bounded_batches(spark)
    cut = suffix_dedup.dedup_substrings(docs, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of one id are taken as often as the one taken most.

    Rows without words have no size and are not taken; a null source is a source; other columns are dropped; an
    empty table gives an empty table.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    taken = mixing.mix_sources(docs).where("taken > 0")
    mixed = taken.groupBy(F.col("doc_id").alias("mix_id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    joined = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col("mix_id")))
    return joined.where(F.regexp_count("text", F.lit(mixing.WORD)) > 0).withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every row into sequences of at most 4,096 tokens; null and empty texts, repeated rows and null ids are packed too."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_to_weights),
    ("packing", pack_sequences),
]

#: Trained models, hashing and tokenizers take part, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
