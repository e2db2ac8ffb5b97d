"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, mpeg_audio, secret_scan, sentencepiece_bpe, shared, shingle_join, source_mix, token_files, toxicity, warc_derive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document. Null and empty texts get the score of a text without words; a null id is held out of learning and has held_out null; repeated rows score alike; an empty table gives none."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on every row. Null text counts as empty, a null id loses to any other, of rows that repeat the winning id one is kept; an empty table gives none."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction for every row. Texts that are null or have no letter give ``und`` and 0, ties go to the language that sorts first, a null id has held_out null; an empty table gives none."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as digests. Null text counts as empty; ids are passed on, null and repeated ones too; an empty table gives none."""
    return sentencepiece_bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), outputs=False)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through a written media column. Null text counts as empty; equal texts give equal values; ids are passed on; an empty table gives none."""
    media = shared.write_table(mpeg_audio.to_media(_table(spark, sf_dir, "documents")), "media")
    return mpeg_audio.from_media(media)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row. Null text has size 0, null is a source of its own, rows that repeat an id are ordered by size; an empty table gives none."""
    weights = source_mix.quality_weights(_table(spark, sf_dir, "labels"))
    mixed = source_mix.mix(_table(spark, sf_dir, "documents"), weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every row, read back from files. Null text has the end id alone, null ids come first, rows that repeat an id stay next to each other; an empty table gives none."""
    files = token_files.write_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return token_files.document_digests(files)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every row. Null text counts as empty and has none; repeated rows and null ids each get their own result; an empty table gives none."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion and metadata records of every page. Null url and html count as empty, pages that repeat an id give equal records; an empty table gives none."""
    return warc_derive.derivatives(warc_derive.responses(_table(spark, sf_dir, "pages"))).drop("record")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every row. Texts that are null or without words have none but their own id, a null id takes part, rows that repeat an id are documents of their own; an empty table gives none."""
    return shingle_join.jaccard_components(_table(spark, sf_dir, "documents")).drop("class_id")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express: the base spans."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express: the payload as it is read back."""
    return op5_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_source_mix": op6_source_mix,
    "op7_huffman_ids": op7_huffman_ids,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_jaccard_join": op10_jaccard_join,
    "secret_base": secret_base,
    "media_payload": media_payload,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op6_source_mix": source_mix.ORACLE,
    "op10_jaccard_join": shingle_join.ORACLE,
    "secret_base": secret_scan.ORACLE,
    "media_payload": mpeg_audio.ORACLE,
}
