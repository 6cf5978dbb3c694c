"""Mixing sources to target weights by nested hash thresholds; DataFrame and SQL functions only.

Every document has a size (its words) and a fixed 32-bit hash of its id. A source whose target is k + f
times its size (0 <= f < 1) gives each document k times, and once more those documents whose hash lies
below the source's threshold. The threshold comes from histograms, not from a sort: sizes are summed by
(source, leading hash bits) with map-side combination; the bucket in which the budget runs out is the
only one that is opened again, by the next bits, until all 32 are used. Thus no task ever holds a
source's rows, and a source with a third of the corpus costs as much as any other.

Defined results: null or wordless text has size 0; a null source is a source of its own, last in order;
empty input gives no rows; a repeated row is a further document of its own, taken like its twin (same
id, same hash). A source's target never exceeds `cap` times its size; what is cut goes to the others by
weight. taken is size * k or size * (k + 1), so never above cap * size. Columns other than doc_id, text
and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS, LEVELS = 8, 4
#: One row per source: broadcast up to so many sources (some 10 MB), joined by a shuffle beyond.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def id_hash() -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): h is the first 32 bits of md5 of the id's decimal text."""
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        id_hash().alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target) from sized(): water-filling in closed form over the sources' totals.

    Sources sorted by the level cap * size / weight at which they fill up; the j first are full if the
    rest's level is at least theirs. All sums are of whole numbers, so the result is the same to the bit
    on any partitioning. The table has one row per source, which is what the single window runs over.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    by = by.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(rest).alias("open_weight"),
    )
    # Not full: this source's cap is at least its share of what the fuller ones leave over.
    is_open = F.col("source_size") * cap * F.col("open_weight") >= (F.col("total") - cap * F.col("full")) * F.col("weight")
    by = by.withColumn("open_", is_open)
    by = by.withColumn("left", F.coalesce(F.max(F.when(F.col("open_"), F.col("total") - cap * F.col("full"))).over(everything), F.lit(0)))
    by = by.withColumn("shared", F.coalesce(F.max(F.when(F.col("open_"), F.col("open_weight"))).over(everything), F.lit(1)))
    return by.select(
        "source", "source_size",
        F.when(F.col("open_"), (F.col("left") * F.col("weight")).cast("double") / F.col("shared").cast("double")).otherwise((F.col("source_size") * cap).cast("double")).alias("target"),
    )


def thresholds(sizes: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """(source, source_size, target, times, threshold): hashes below the threshold are taken once more."""
    k = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("times", k)
    state = state.withColumn("budget", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    state = state.withColumn("threshold", F.lit(0).cast("long"))
    for level in range(LEVELS):
        width = 1 << (32 - BITS * (level + 1))  # hashes in a bucket of this level
        if level == 0:
            inside = sizes
        else:
            at = common.if_small(state.select(F.col("source").alias("s_"), F.col("threshold").alias("t_")), SOURCES)
            inside = sizes.join(at, F.col("source").eqNullSafe(F.col("s_")) & (F.col("h") >= F.col("t_")) & (F.col("h") < F.col("t_") + width * (1 << BITS))).drop("s_", "t_")
        histogram = inside.groupBy("source", F.floor(F.col("h") / width).cast("long").alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("tokens").over(running))
        spent = histogram.select(F.col("source").alias("s_"), "bucket", "tokens", "upto")
        joined = state.join(spent, F.col("source").eqNullSafe(F.col("s_")), "left")
        # The first bucket that doesn't fit whole is the boundary; none: all fits.
        over = F.col("upto") > F.col("budget")
        state = joined.groupBy("source", "source_size", "target", "times", "budget", "threshold").agg(
            F.min(F.when(over, F.col("bucket"))).alias("cut"),
            F.coalesce(F.min(F.when(over, F.col("upto") - F.col("tokens"))), F.max("upto"), F.lit(0)).alias("fits"),
        )
        last = F.col("threshold") + width * (1 << BITS) if level else F.lit(1 << 32).cast("long")
        state = state.select(
            "source", "source_size", "target", "times", (F.col("budget") - F.col("fits")).alias("budget"),
            F.coalesce(F.col("cut") * width, last).cast("long").alias("threshold"),
        )
        state = common.durable(state)
    return state.drop("budget")


def _with_times(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows (with source, h) and from thresholds(): source_size, target and times, once more below the threshold."""
    state = common.if_small(state.select(F.col("source").alias("s_"), "source_size", "target", F.col("times").alias("k_"), F.col("threshold").alias("t_")), SOURCES)
    joined = rows.join(state, F.col("source").eqNullSafe(F.col("s_")))
    return joined.withColumn("times", F.col("k_") + (F.col("h") < F.col("t_")).cast("long")).drop("s_", "k_", "t_")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, times): how often the mix takes each document."""
    sizes = common.durable(sized(docs))
    state = thresholds(sizes, common.durable(targets(sizes, weights, cap)), cap)
    return _with_times(sizes, state).select("doc_id", "source", "size", "source_size", "target", "times")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. Texts are not shuffled."""
    sizes = common.durable(sized(docs))
    state = thresholds(sizes, common.durable(targets(sizes, weights, cap)), cap)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", id_hash().alias("h"))
    taken = _with_times(rows, state).where("times > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size,
             CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
      FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
g AS (SELECT *, source_size * 3 * open_weight >= (total - 3 * full_) * weight AS open_ FROM f),
l AS (SELECT max(total - 3 * full_) FILTER (WHERE open_) AS left_, max(open_weight) FILTER (WHERE open_) AS shared FROM g),
t AS (SELECT source, source_size,
             CASE WHEN open_ THEN (left_ * weight)::DOUBLE / shared::DOUBLE ELSE (source_size * 3)::DOUBLE END AS target
      FROM g, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS times FROM t),
c AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.times,
             floor(k.target - k.times * k.source_size)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN upto <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
