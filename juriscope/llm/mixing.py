"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source (combined before the shuffle, so a source with a third of all rows
costs no more than another), targets are filled like water up to each source's cap, and each
document is then emitted floor(rate) times plus one Bernoulli copy whose hash-seeded draw is below
the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import NOT_SPACES, SPACES, materialise

#: More sources than this are joined by a shuffle instead of a broadcast (about 64 bytes a source).
MOST_BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: one row for each source, nulls being a source of their own.

    With w the weights, targets are min(cap * size, level * w), where the level makes them sum to
    share * all sizes (or to cap * all sizes, if that is less). For sources in order of
    cap * size / w the level that treats the first i as full is (total - their caps) / (weights
    left); the true level is the largest of these.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("nth", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy(F.lit(1))
    upward = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("nth"))
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    full = F.coalesce(F.sum("cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - full) / left)
    levels = levels.withColumn("level", F.max("level").over(whole))
    return levels.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def draw(seed: str) -> Column:
    """A number in [0, 1) from md5(seed, doc_id): 13 hex digits. Rows without doc_id draw by their row hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("fallback")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_rates(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """of (the source), source_size, target and rate; broadcast where the count of sources is proven small."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    goal = materialise(targets(sized, weights, share, cap).select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate")), "targets")
    return F.broadcast(goal) if goal.count() <= MOST_BROADCAST_SOURCES else goal


def taken_copies(seed: str) -> Column:
    """floor(rate) and one more where the row's draw is below the fraction."""
    return (F.floor("rate") + F.when(draw(seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs.

    Null texts have size 0; null sources are one source, last in order; a source without words has
    target 0 and no copies; rows that repeat a doc_id decide alike; an empty table gives an empty
    result; of other columns none is read. No document is emitted more than ceil(cap) times.
    """
    fallback = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    sized = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size"), fallback.alias("fallback")), "sized")
    goal = with_rates(sized, weights, share, cap)
    joined = sized.join(goal, sized["source"].eqNullSafe(goal["of"]))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken_copies(seed).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every column of docs, each row as often as the mix takes it.

    Defined as ``copies`` is; rows are repeated as they stand, so a repeated document keeps its id.
    """
    fallback = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), fallback.alias("fallback"))
    goal = with_rates(rows.select("source", "size"), weights, share, cap)
    joined = rows.join(goal, rows["source"].eqNullSafe(goal["of"]))
    taken = joined.withColumn("times", taken_copies(seed)).filter("times > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op5_mix(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{NOT_SPACES}')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS nth FROM sums
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), goal AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5('mix:' || CAST(s.doc_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
