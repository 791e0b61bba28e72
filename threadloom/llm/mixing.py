"""Mixing sources to target weights.

Sizes are summed per source (map-side combine: a hot source costs one row per task). Targets follow
from the weights by filling up: shares of the budget by weight, a source never above twice its size,
the excess going to the others by weight. The level at which that ends has a closed form over the
sources sorted by 2 * size / weight, so it is one window over one row per source. A document of a
source with repetition rate r is emitted floor(r) times and once more with probability r - floor(r),
decided by a hash of its id, so reruns agree whatever the partitions.

Cases: null source is a source of its own, last in order. Null or empty text: size 0. A source without
words has target 0 and takes nothing. Rows that repeat a doc_id share a decision; rows with a null one share it when
they share the text.
Empty input: no rows. Extra columns are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm import common

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("k", (F.row_number().over(order) - 1) % len(weights))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") + 1).cast("int")).cast("double"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    per = per.withColumns({"ratio": most * F.col("source_size") / F.col("w"), "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"capped": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "gone_w": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    # The level if exactly the sources before this one are at their limit; it holds from the first source whose limit is not below it.
    per = per.withColumn("level", (budget * F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("gone_w")))
    per = per.withColumn("cut", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every))
    target = F.when(F.col("ratio") < F.col("cut.ratio"), most * F.col("source_size")).otherwise(F.least(F.col("cut.level") * F.col("w"), most * F.col("source_size")))
    per = per.withColumn("target", F.coalesce(target, most * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def mix_key() -> F.Column:
    """What decides a document's draw: its id, or where that is null its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.col("text").cast("binary"))), F.lit("null")).alias("mix_key")


def draw(seed: str = "mix") -> F.Column:
    """A number in [0, 1) from the document's key, the same in every run and in other SQL engines."""
    key = F.concat(F.lit(f"{seed}:"), F.col("mix_key"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """sized (source, size, mix_key and more) with source_size, target and copies.

    The per-source table has one row per source; it is joined by Spark's own choice, which broadcasts
    it only below the session's size limit.
    """
    per = rates(sized, weights, budget).withColumnRenamed("source", "mix_source")
    joined = sized.join(per, sized["source"].eqNullSafe(per["mix_source"])).drop("mix_source")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (draw() < F.col("rate") - whole).cast("int")).cast("int")).drop("rate", "mix_key")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The mixed rows, each document as often as it is taken, columns as in docs."""
    made = copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", mix_key(), word_count().alias("size")), weights, budget)
    return made.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, size, source_size, target, taken. Sizes are counted once and written."""
    sized = common.written(common.table(spark, sf_dir, "documents").select("doc_id", "source", mix_key(), word_count().alias("size")), "mix-sizes")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(k % 3) + 1] AS DOUBLE) AS w FROM per),
ratios AS (SELECT *, 2 * source_size / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM weighed),
filled AS (SELECT *, (1.5 * total - coalesce(sum(2 * source_size) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level FROM ratios
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(ratio) AS ratio, arg_min(level, ratio) AS level FROM filled WHERE level <= ratio),
targets AS (SELECT f.source, f.source_size, CAST(CASE WHEN cut.ratio IS NULL OR f.ratio < cut.ratio THEN 2 * f.source_size ELSE least(cut.level * f.w, 2 * f.source_size) END AS DOUBLE) AS target FROM filled f, cut),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(r.rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 8)) AS UBIGINT) / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
