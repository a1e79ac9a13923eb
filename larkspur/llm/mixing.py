"""Mixing sources to target weights by repetition rates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import GAP, fresh_name, table

WEIGHTS = (5, 2, 1)
MOST = 3


def words(text: Column) -> Column:
    """Number of words in a text; 0 for null, empty and blank texts."""
    return F.when(text.isNull() | (F.length(F.regexp_replace(text, GAP, "")) == 0), F.lit(0)).otherwise(F.size(F.filter(F.split(text, GAP, -1), lambda w: w != ""))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rate`` of each source of rows with ``source`` and ``size``.

    Sources by code point, null last, weigh ``weights``, repeating. The sources share the sum of all sizes by weight; no
    target exceeds ``most`` times its source's size; what that cuts off is shared again by weight until none is above.
    In closed form: in the order of size by weight, the first sources are held at their limits, until the share left for
    each unit of weight lifts none of the others above its own. A source without words has target and rate 0. Sources are
    put in one order, in one task, a row of some tens of bytes each: some ten millions of them are its bound.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    # One row per source from here on; sizes and weights are whole numbers, so every engine gets the same figures.
    up = Window.orderBy((F.col("source_size") * F.lit(most)).cast("double") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "source", "source_size", "weight", F.row_number().over(up).alias("at"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).alias("left_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    fits = F.col("left_size") * F.col("weight") <= F.col("source_size") * most * F.col("left_weight")
    first = F.min(F.when(fits, F.struct("at", "left_size", "left_weight"))).over(Window.partitionBy())
    totals = totals.withColumn("f", first)
    target = F.when(F.col("at") < F.col("f.at"), (F.col("source_size") * most).cast("double")).otherwise(F.col("f.left_size").cast("double") / F.col("f.left_weight") * F.col("weight"))
    return totals.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def chance(doc_id: Column, seed: str) -> Column:
    """A number on [0, 1) from a hash of seed and id, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``copies`` for every row of ``docs`` (doc_id, text, source).

    Each document is taken floor(rate) times and once more if a hash of seed and id, uniform on [0, 1), is below the
    fraction; so reruns agree, and no document is taken more than ``most`` times. Repeated rows are taken alike. A null id
    hashes as the empty text; null texts have size 0; null sources form one source; an empty table gives no rows. Only
    the sizes are shuffled or joined, never the texts.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "of")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    copies = F.floor("rate") + (chance(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``mix`` takes them, numbered from 1 in a column ``copy`` (or ``copy_``, if that is taken).

    Rates are of each row's source; the sizes alone are gathered for them, and rows stay where they are but for the join
    with the sources, a row for each.
    """
    sized = docs.select("source", words(F.col("text")).alias("size"))
    of, rate, times = (fresh_name(x, docs.columns) for x in ("_of", "_rate", "_copies"))
    targets = source_targets(sized, weights, most).select(F.col("source").alias(of), F.col("rate").alias(rate))
    copies = F.floor(rate) + (chance(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate)).cast("long")
    rows = docs.join(targets, F.col("source").eqNullSafe(F.col(of))).withColumn(times, copies.cast("int")).filter(F.col(times) > 0)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(fresh_name("copy", docs.columns)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents, with the words that it takes of each."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS pos FROM w),
a AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_size,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_weight FROM o),
f AS (SELECT * FROM a WHERE left_size * weight <= source_size * 3 * left_weight ORDER BY pos LIMIT 1),
t AS (SELECT a.source, a.source_size, CASE WHEN a.pos < f.pos THEN CAST(3 * a.source_size AS DOUBLE) ELSE CAST(f.left_size AS DOUBLE) / f.left_weight * a.weight END AS target FROM a, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
