"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from twinlake.session import written

#: Rows of a range of keys that are sorted together.
RANGE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Words of a text between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes (source, size) with target: the sum of all sizes shared by weight, none above cap times its size.

    Sources take the weights in turn, by code point, null last. What a cap
    leaves over goes to the others by weight until none is above: in order of
    cap by weight, a source is capped as long as its cap is no more than its
    share of what those before it left. One row a source, so the windows without
    partitions sort as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", turn.cast("long")).withColumn("cap", F.col("size") * cap)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = w.withColumns(
        {
            "rest": F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    ).withColumn("capped", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest"))
    loose = left.withColumns(
        {
            "open": F.sum("size").over(everything) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything),
            "open_w": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything),
        }
    )
    share = F.col("w") * F.col("open").cast("double") / F.col("open_w")
    return loose.select("source", "size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(
    documents: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: str = "",
    digits: int | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each document, and carried, a struct of the columns in carry.

    Each document gets a hash-random key, of its doc_id and text. Within a
    source, keys are cut into 16**digits ranges, by default as many as leave some
    RANGE_ROWS rows to a range even where one source has them all; sums of the
    ranges give each range its offset, and only inside a range are keys sorted,
    equal ones as one with their number, so no task holds a source or all copies
    of a row. The result is the same for any digits. The words before
    a document then tell how much of it falls into the budget: whole epochs
    first, then documents in order of key, the last one cut at the exact word.

    Null sources form a source of their own, the last. Null and empty texts have
    size 0 and are taken 0 times. A source without words has target 0. Rows
    that repeat a doc_id and text have equal keys and are told apart in no way,
    so which of them is cut does not show. Null doc_ids are keyed as an empty
    string, with their text. Only the columns named are read. An
    empty table gives an empty table. Reruns agree, whatever the partitions.
    """
    name = F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    key = F.md5(name.cast("binary"))
    more = [F.struct(*carry).alias("carried")] if carry else []
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"), *more
    ).withColumn("part", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    # equal rows may be any number: each part of the table numbers its own
    rows = written(rows.withColumn("shard", F.spark_partition_id()), "mix-rows")
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, rows.count()) / RANGE_ROWS, 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    alike = ["part", "range", "key", "shard"]
    groups = rows.groupBy("source", *alike).agg(F.max("size").alias("each"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.withColumn("sum", F.col("each") * F.col("n")), "mix-groups")
    sums = written(groups.groupBy("part", "source", "range").agg(F.sum("sum").alias("sum")), "mix-ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("sum").alias("size")), weights, cap)
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("part"), F.col("size").alias("source_size"), "target"
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda w: F.coalesce(F.sum("sum").over(before(w)), F.lit(0))
    ranges = sums.select("part", "range", sum_before(Window.partitionBy("part").orderBy("range")).alias("ahead")).join(targets, "part")
    inside = Window.partitionBy("part", "range").orderBy("key", "shard")
    places = groups.select(*alike, sum_before(inside).alias("inside")).join(ranges, ["part", "range"])
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("doc_id")) - 1
    out = rows.withColumn("upto", place * F.col("size")).join(places, alike).withColumn("upto", F.col("upto") + F.col("inside") + F.col("size"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    out = out.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least("size", F.col("rest") - (F.col("ahead") + F.col("upto") - F.col("size"))))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        *["carried"] * bool(carry),
    )


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).drop("source")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size) AS size, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * size AS cap,
         sum(size) OVER () - coalesce(sum(3 * size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM s WINDOW before AS (ORDER BY 3 * size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * rest_w <= w * rest AS capped FROM o),
t AS (
  SELECT source, size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
           w * CAST(sum(size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE)
             / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
  FROM c),
r AS (
  SELECT d.doc_id, d.size, t.size AS source_size, t.target,
         CASE WHEN t.size > 0 THEN floor(floor(t.target) / t.size) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - (upto - size))) AS BIGINT) AS taken
FROM r
"""
