"""Scores that hold results against their expectation: residual z by key, halves of the same data, decile occupancy, agreement of maps of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.reads import uniform


def residual_z(rows: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """keys, n, mean, sd, z: the mean of residuals over its standard error, for keys with ``least`` rows."""
    per = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where(F.col("n") >= least)
    return per.withColumn("z", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))


def half_z(rows: DataFrame, keys: list[str], value: str, seed: int, *ids: str) -> DataFrame:
    """keys, n, difference, z: the mean of one half, by hash, less that of the other, over its standard error: what no effect looks like."""
    half = uniform(seed, *ids) < 0.5
    of = lambda side, f: f(F.when(half if side else ~half, F.col(value)))
    per = rows.groupBy(*keys).agg(of(True, F.count).alias("a"), of(False, F.count).alias("b"), of(True, F.avg).alias("ma"), of(False, F.avg).alias("mb"), of(True, F.var_samp).alias("va"), of(False, F.var_samp).alias("vb"))
    se = F.sqrt(F.col("va") / F.col("a") + F.col("vb") / F.col("b"))
    return per.select(*keys, (F.col("a") + F.col("b")).alias("n"), (F.col("ma") - F.col("mb")).alias("difference"), F.when(se > 0, (F.col("ma") - F.col("mb")) / se).alias("z"))


def occupancy_z(values: DataFrame, u: str, bins: int = 10) -> DataFrame:
    """bin, n, expected, z: how many values of [0, 1) fall into equal bins, against an even spread."""
    n = values.agg(F.count(u).alias("_all"))
    at = F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)).alias("bin")
    per = values.where(F.col(u).isNotNull()).groupBy(at).agg(F.count("*").alias("n")).join(F.broadcast(n))
    mean = F.col("_all") / bins
    return per.select("bin", "n", mean.alias("expected"), ((F.col("n") - mean) / F.sqrt(mean * (1 - 1 / bins))).alias("z"))


def height_cdf(h, birth: float, death: float, rho: float, height: float):
    """The distribution of a branching height under ``likelihood.tree_prior``."""
    import math

    r, k = birth - death, birth * (1 - rho) - death
    whole = -math.expm1(-r * height) / (birth * rho + k * math.exp(-r * height))
    return (1 - F.exp(-r * h)) / (birth * rho + k * F.exp(-r * h)) / whole


def same_events(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """both, only_a, only_b: how many events two ways of attribution share."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    met = x.join(y, keys, "full")
    return met.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
