"""Summaries that are kept by part and add up: moments by day (A19, A20) and sketches by season.

Neither needs the rows again. Any division into training and holdout days is a sum over moments; a new season
adds its sketches to those that are there. Least squares and shares of variance are exact; the sketches state their bounds.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingmill.sources.shared import exists, replace_partitions

MOMENTS = ("n", "x", "y", "xx", "xy", "yy")
#: Logarithm of the registers of a distinct count, and size of a quantile sketch.
HLL_BITS, KLL_K = 12, 200
#: Errors that an estimate keeps to with near certainty: of a distinct count relative (four standard errors of 1.04 / sqrt(2^12)), and of a
#: quantile by rank (two-sided, at this size, with room).
HLL_ERROR, KLL_ERROR = 0.065, 0.03


def daily_moments(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Count, sums and sums of products of ``x`` and ``y`` for each ``by``; rows that lack either count for nothing."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    on = df.where(a.isNotNull() & b.isNotNull())
    return on.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"), F.sum(b * b).alias("yy"))


def add_moments(kept: DataFrame, new: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Moments of both, day by day."""
    return kept.unionByName(new).groupBy(*by).agg(*[F.sum(c).alias(c) for c in MOMENTS])


def fit_moments(moments: DataFrame, train: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The line of ``y`` on ``x`` over the moments where ``train`` holds, with its share of variance there and
    on the other moments; null where there are no rows or no spread."""
    part = lambda on, c: F.sum(F.when(on, F.col(c))).alias(c)
    sums = moments.groupBy(*by).agg(F.struct(*[part(train, c) for c in MOMENTS]).alias("t"), F.struct(*[part(~train, c) for c in MOMENTS]).alias("h"))
    t = {c: F.col(f"t.{c}") for c in MOMENTS}
    slope = F.try_divide(t["xy"] - t["x"] * t["y"] / t["n"], t["xx"] - t["x"] * t["x"] / t["n"])
    line = sums.withColumn("slope", slope).withColumn("intercept", (t["y"] - F.col("slope") * t["x"]) / t["n"])

    def share(s: str) -> Column:
        m, a, b = {c: F.col(f"{s}.{c}") for c in MOMENTS}, F.col("intercept"), F.col("slope")
        off = m["yy"] - 2 * a * m["y"] - 2 * b * m["xy"] + m["n"] * a * a + 2 * a * b * m["x"] + b * b * m["xx"]
        return 1 - F.try_divide(off, m["yy"] - m["y"] * m["y"] / m["n"])

    return line.select(*by, "slope", "intercept", share("t").alias("train_r2"), F.coalesce("t.n", F.lit(0)).alias("train_n"), share("h").alias("holdout_r2"), F.coalesce("h.n", F.lit(0)).alias("holdout_n"))


def season_sketches(df: DataFrame, season: Column, entity: str, value: str) -> DataFrame:
    """For each season a sketch of the different ``entity`` values and one of the distribution of ``value``."""
    return df.groupBy(season.cast("long").alias("season")).agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg(entity, HLL_BITS).alias("entities"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("spread"),
    )


def keep_sketches(new: DataFrame, path: str) -> None:
    """Sketches of some seasons take the place of those in the table at ``path``; other seasons are not read."""
    replace_partitions(new, path, ["season"])


def kept_sketches(like: DataFrame, path: str) -> DataFrame:
    spark = like.sparkSession
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else like.limit(0)


def merged(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row over all seasons: ``rows``, the estimated number of ``entities``, and the ``quantiles`` (an array)."""
    on = sketches.agg(F.sum("rows").alias("rows"), F.hll_union_agg("entities").alias("e"), F.kll_merge_agg_double("spread").alias("s"))
    return on.select("rows", F.hll_sketch_estimate("e").alias("entities"), F.array(*[F.kll_sketch_get_quantile_double("s", F.lit(q)) for q in quantiles]).alias("quantiles"))


def before(day: date) -> Column:
    return F.col("date") < F.lit(day)
