"""Counts, coverage, scores, profiles and baseline checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.scalar import safe_ratio, within

from .schema import SCORE_WEIGHTS


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def profile(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, avg, min, max and population deviation; zeros where there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), zero(F.avg(value)).alias("avg"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"), zero(F.stddev_pop(value)).alias("std")
    )


def density(rows: DataFrame, owner: list[str], keys: list[str]) -> DataFrame:
    """Average and most rows an owner, by keys."""
    each = rows.groupBy(*keys, *owner).agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.avg("n").alias("avg_n"), F.max("n").alias("max_n"))


def relation_coverage(counts: DataFrame) -> DataFrame:
    """counts: relation, expected, actual.  Mean of the clamped ratios where something is expected."""
    used = counts.where("expected > 0")
    return used.agg(
        F.coalesce(F.avg(safe_ratio(F.col("actual"), F.col("expected"))), F.lit(1.0)).alias("coverage"),
        F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("actual"), F.lit(0)).alias("actual"),
    )


def overall(node: Column, relation: Column, prop: Column) -> Column:
    w = SCORE_WEIGHTS
    return F.bround((node * w["node"] + relation * w["relation"] + prop * w["property"]) * 100, 2)


def candidate_pairs(rooms: DataFrame) -> Column:
    """Directed candidates of a room with f furniture, b boundaries and o openings that have boxes."""
    f, b, o = F.col("f"), F.col("b"), F.col("o")
    return f * b * 2 + f * o * 2 + f * (f - 1)


def check_baseline(actual: DataFrame, baseline: DataFrame) -> DataFrame:
    """actual: metric, value; baseline: metric, least, most.  Missing metrics count as -1."""
    joined = baseline.join(actual, "metric", "left").withColumn("value", F.coalesce("value", F.lit(-1.0)))
    return joined.withColumn("ok", within(F.col("value"), F.col("least"), F.col("most")))


def verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(F.when(F.coalesce(F.bool_and("ok"), F.lit(True)), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"), F.count_if(~F.col("ok")).alias("n_failed"))
