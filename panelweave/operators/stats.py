"""Grouped statistics with an exact median that does not gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.blocks import spread_join

STATS = ["mean", "median", "min", "max"]
#: Rank error of the sketch is 1/ACCURACY. The bracket around the median reaches ten times that, and at least ten ranks,
#: to each side, rounded up to the next of MARGINS; the sketch cannot miss a bracket that wide.
ACCURACY = 20_000
MARGINS = [10 / ACCURACY, 0.002, 0.008, 0.032, 0.128, 0.5]


def _long(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])
    return (df.select(*keys, F.inline(cells)).filter(F.col("v").isNotNull() & ~F.isnan("v")))


def describe(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean, median, min and max of every measure per group, as columns ``<measure>_<stat>``.

    The built-in exact median keeps every distinct value of a group in one task. Here a first pass takes the
    plain statistics and a quantile sketch that brackets the median; the second pass counts what lies below the
    bracket and ranks only the distinct values inside it. A small group's bracket reaches its extremes.
    """
    long = _long(df, keys, measures)
    group = [*keys, "measure"]
    shares = [0.5 - m for m in MARGINS] + [0.5 + m for m in MARGINS]
    near = F.percentile_approx("v", F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY))
    plain = long.groupBy(*group).agg(
        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"),
        near.alias("_near"))
    needed = F.greatest(F.lit(10 / ACCURACY), 10 / F.col("n"))
    wide = F.least(F.size(F.filter(F.array(*[F.lit(m) for m in MARGINS]), lambda m: m < needed)), F.lit(len(MARGINS) - 1))
    facts = plain.withColumn("_lo", F.get("_near", wide)).withColumn("_hi", F.get("_near", wide + len(MARGINS)))
    # Equal values collapse before any exchange, so a value that fills a group is one row from here on.
    distinct = long.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    # NULL stands for "below the bracket" and sorts first.
    counted = (spread_join(distinct, facts.select(*group, "n", "_lo", "_hi"), group, spread=("v",))
               .filter(F.col("v") <= F.col("_hi"))
               .select(*group, "n", F.when(F.col("v") >= F.col("_lo"), F.col("v")).alias("v"), "c")
               .groupBy(*group, "n", "v").agg(F.sum("c").alias("c")))
    w = Window.partitionBy(*group).orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lower_rank, upper_rank = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    prior = F.col("_upto") - F.col("c")

    def at(rank):
        return F.min(F.when((prior < rank) & (rank <= F.col("_upto")), F.col("v")))

    median = ranked.groupBy(*group).agg(at(lower_rank).alias("_a"), at(upper_rank).alias("_b")).withColumn(
        "median", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("median outside its bracket")))
        .otherwise((F.col("_a") + F.col("_b")) / 2))
    both = facts.drop("_near", "_lo", "_hi", "n").join(median.drop("_a", "_b"), group)
    wide = [F.max(F.when(F.col("measure") == m, F.col(s))).alias(f"{m}_{s}") for m in measures for s in STATS]
    return both.groupBy(*keys).agg(*wide)


def exact_mean(measure: str) -> Column:
    """Mean that does not depend on the order of the rows: summed as decimals and rounded, so that ties stay ties."""
    return F.round(F.sum(F.col(measure).cast("decimal(30,12)")).cast("double") / F.count(measure), 9)


def best_rows(df: DataFrame, keys: Sequence[str], measure: str, label: str) -> DataFrame:
    """Per group the ``label`` with the smallest ``measure``; missing scores come last, ties go to the smaller label."""
    missing = F.col(measure).isNull()
    order = F.struct(missing, F.col(measure), F.col(label))
    best = F.min_by(F.struct(label, measure), order)
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, f"_best.{label}", f"_best.{measure}")
