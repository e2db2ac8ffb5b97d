"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target comes from the sizes alone. Complete passes over the source are taken first; what is
left of the target is filled with documents in ascending order of -ln(u) / w, where u is a
uniform hash of the id and w the quality weight, until the words are used up. The last document gives
only the words that are still wanted.

The order is never sorted in one piece. A key's place in (0, 1), 1 - exp(-key), is cut into
``BINS`` equal parts; sums by (source, part) give every part its offset, and each part is sorted alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_table

BINS = 4096
WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
SHARE = 1.5  # of all sizes
MOST = 2  # times a source's own size
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(id_: Column, seed: str = SEED) -> Column:
    """Strictly between 0 and 1, from 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds the target to (skey, source, source_size), one row for each source.

    Targets share ``SHARE`` of all sizes by weight, up to ``MOST`` times the own size; what that cuts
    off goes to the others by weight, and so on. That comes to target = min(most, level * weight)
    for one level, which is found from sums in order of most / weight. The windows hold a row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MOST))
    ranked = ranked.withColumn("level", F.col("most") / F.col("weight"))
    upto = Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * SHARE
    below, above = F.sum("most").over(upto), F.sum("weight").over(whole) - F.sum("weight").over(upto)
    capped = ranked.withColumn("capped", below + F.col("level") * above <= total).withColumn("total", total)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.try_divide(F.col("weight") * left, free))
    return capped.select("skey", "source", "source_size", target.alias("target"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight): 2 for documents labelled as good, 1/2 as bad; a good label wins over a bad one."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    return known.select("doc_id", F.when(F.col("q") >= 1, 2.0).otherwise(0.5).alias("quality_weight"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``.

    ``weights`` has a positive quality_weight for some doc_ids, each at most once; others weigh 1. Null text
    has size 0 and nothing is taken of it. Null is a source of its own and comes last. Rows that repeat an id
    have the same key and are ordered by size. Reruns give the same rows. An empty table gives no rows.
    """
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
    )
    if weights is not None:
        rows = rows.join(weights.select(F.col("doc_id"), F.col("quality_weight")), "doc_id", "left")
        weight = F.coalesce(F.col("quality_weight"), F.lit(1.0))
    else:
        weight = F.lit(1.0)
    keyed = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / weight)
    part = F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int")
    rows = write_table(keyed.select("doc_id", "source", "skey", "size", "key", part.alias("part")), "mix-rows")

    parts = rows.groupBy("skey", "source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("skey", "source", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset"), "part_size")
    targets = source_targets(parts.groupBy("skey", "source").agg(F.sum("part_size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = targets.withColumn("passes", passes).withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    placed = parts.select("skey", "part", "offset").join(budget.select("skey", "source_size", "target", "passes", "rest"), "skey")

    inside = Window.partitionBy("skey", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = rows.withColumn("upto", F.sum("size").over(inside)).join(placed, ["skey", "part"])
    first = F.col("offset") + F.col("upto") - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - first))
    return ordered.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"))


def repeat_by_mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` as the mix takes them, with all their columns, whatever these are called: each row as often as its
    size goes into what is taken of it.

    The one document of each source that is taken in part counts if at least half of it is. Rows
    with the same id and size get the same number of copies only if the mix takes as much of each, so
    they are told apart by their rank among their likes. A null id is an id like any other; null and empty texts are taken never.
    An empty table gives no rows.
    """
    like = Window.partitionBy("id", "source", "size").orderBy(F.col("taken").desc())
    copies = mix(docs, weights).where("taken > 0").select(
        F.col("doc_id").alias("id"), "source", "size", "taken", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")
    )
    copies = copies.withColumn("place", F.row_number().over(like)).where("copies > 0").drop("taken")
    twins = Window.partitionBy("own_id", "own_source", "own_size").orderBy("own_mark")
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("own_id"),
        F.col("source").cast("string").alias("own_source"),
        word_count(F.col("text")).alias("own_size"),
        F.xxhash64("text").alias("own_mark"),
    )
    keyed = keyed.withColumn("own_place", F.row_number().over(twins))
    same = (
        F.col("own_id").eqNullSafe(F.col("id"))
        & F.col("own_source").eqNullSafe(F.col("source"))
        & (F.col("own_size") == F.col("size"))
        & (F.col("own_place") == F.col("place"))
    )
    taken = keyed.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select("row.*")


ORACLE = r"""
WITH q AS (
  SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
r AS (
  SELECT d.doc_id, d.source,
         CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5)
             / 4503599627370496::DOUBLE) / coalesce(q.w, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_value(5.0, 2.0, 1.0)[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM r GROUP BY source),
l AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS level FROM s),
c AS (
  SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total,
         sum(most) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING)
         + level * ((SELECT sum(weight) FROM s) - sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING))
         <= (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS capped
  FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN most
              ELSE weight * (total - (SELECT coalesce(sum(most), 0) FROM c WHERE capped)) / (SELECT sum(weight) FROM c WHERE NOT capped)
         END AS target
  FROM c),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
o AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, b.passes,
         CAST(round(b.target) AS BIGINT) - b.passes * b.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS first
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - first)) AS BIGINT) AS taken
FROM o
"""
