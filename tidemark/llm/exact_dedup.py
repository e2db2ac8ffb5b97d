"""Exact duplicate removal that survives groups holding a large share of all rows.

A first pass keeps of every row its id, the digest of its normalised text and a salt, and no text. Rows whose digest
occurs once can have no equal, so only the others' texts move. They are combined in three stages, each of which
groups by the whole normalised text and not by a digest alone: map-side within a task, then per
(digest, salt), then over the salts of a digest. The decision travels back over the same (digest, salt) pairs, so the
rows of one hot text are spread over as many tasks as there are salts in both directions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import maybe_among, split_by, write_table

SALTS = 64  # one bit each of a long


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _bits_to_salts(bits: str) -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> ({bits} & shiftleft(1L, s)) != 0)")).alias("_salt")


def _decided(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The decision on every row, and the hashes (xxhash64) of the texts of all rows that have an equal or may have one."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_mark"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("_salt")

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_body", normalised(F.col("_text"))).withColumn("_digest", digest(F.col("_body"))).select("_id", "_mark", "_body", "_digest", salt)

    sha = F.unhex(F.sha2("_body", 256)).alias("_sha")
    rows = write_table(keyed(texts).select("_id", "_mark", "_digest", "_salt", sha, F.length("_body").alias("_len")), "exact-dedup-rows")
    bit = F.expr("shiftleft(1L, _salt)")
    counts = rows.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("_n")).groupBy("_digest")
    repeated = counts.agg(F.sum("_n").alias("_n"), F.bit_or(bit).alias("_salts")).where("_n > 1").select("_digest", _bits_to_salts("_salts"))
    marks = write_table(rows.join(repeated, ["_digest", "_salt"], "left_semi").select("_mark").distinct(), "exact-dedup-marks")

    moved = keyed(maybe_among(texts, F.col("_mark"), marks))
    salted = moved.groupBy("_digest", "_salt", "_body").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = salted.groupBy("_digest", "_body").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.bit_or(bit).alias("_salts"))
    winners = write_table(groups.select("_digest", "_keep", "_n", "_salts"), "exact-dedup-winners")
    shared = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_digest")
    collided = not shared.isEmpty()

    members = rows.select("_id", "_digest", "_salt", "_sha", "_len")
    if collided:  # texts of one digest differ: these rows are grouped and joined by their content alone
        mixed = moved.join(shared, "_digest", "left_semi")
        by_text = mixed.groupBy("_digest", "_body").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        again = mixed.join(by_text, ["_digest", "_body"]).select("_id", "_digest", "_salt", sha, F.length("_body").alias("_len"), "_keep", "_n")
        members, winners = members.join(shared, "_digest", "left_anti"), winners.join(shared, "_digest", "left_anti")
    routed = winners.select("_digest", "_keep", "_n", _bits_to_salts("_salts"))
    alone = F.col("_n").isNull()
    decided = members.join(routed, ["_digest", "_salt"], "left").withColumn("_keep", F.when(alone, F.col("_id")).otherwise(F.col("_keep")))
    decided = decided.withColumn("_n", F.coalesce("_n", F.lit(1).cast("long")))
    if collided:
        decided = decided.select(again.columns).unionByName(again)
    copy = F.row_number().over(Window.partitionBy("_digest", "_salt", "_sha", "_id").orderBy("_len"))
    return decided.withColumn("_copy", copy), marks


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars_normalised.

    Null text counts as empty. A null id loses to any other id; a group of null ids only keeps
    one of them. Of rows that repeat the winning id, exactly one is kept. An empty table gives
    an empty result. Other columns of ``docs`` are not read, so their names cannot clash.
    ``digest`` only routes rows: texts of equal digest are still told apart by their content.
    """
    return _decided(docs, id_col, text_col, digest)[0].select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_len").cast("long").alias("n_chars_normalised"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever these are called.

    Rows are matched by id and by the digest of their normalised text, and of rows that are equal in
    both one stays. Null texts, null ids and empty tables are as in ``exact_dedup``. Only rows whose text occurs more than once are moved.
    """
    decided, marks = _decided(docs, id_col, text_col, sha256_digest)
    kept = decided.where(F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", "_sha").distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    hit, rest = split_by(whole, F.col("mark"), marks)
    hit = hit.select("row", "id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    rank = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.lit(1)))
    one = hit.join(kept, same, "left_semi").withColumn("rank", rank).where("rank = 1")
    return rest.select("row.*").unionByName(one.select("row.*"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept,
       sha256(body) AS text_sha256,
       CAST(length(body) AS BIGINT) AS n_chars_normalised
FROM n
"""
