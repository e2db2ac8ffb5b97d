"""From documents to token ids: language, exact copies, near copies, mixture, tokens.

Each stage takes the whole table that its predecessor kept, and is written as Parquet in the shared
folder before the next one reads it, so a lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, sentencepiece_bpe, shingle_join, source_mix
from tidemark.llm.shared import write_table

#: The first stage's language and the last stage's ids are out of reach of SQL.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID gives a language; those it rejects as ``und`` go: texts that are null, empty or without a
    letter, and all texts if no document has a language to learn from. Rows are kept as they are, repeated ones too."""
    return language_id.with_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group connected by similar word shingles."""
    return shingle_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Null is a source of its own; rows of no words are never taken; ties of the
    order go by id, then size; rows that repeat an id are told apart by their texts."""
    return source_mix.repeat_by_mix(docs, source_mix.quality_weights(_table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of every row of the mixture. Null ids and sources are passed on,
    repeated rows each get their own result, a null text counts as empty, and an empty table gives no rows."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    done = sentencepiece_bpe.encode_decode(keyed, path, "key", outputs=False)
    return done.select("doc_id.doc_id", "doc_id.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", keep_known_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table to the rows of the last stage."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
