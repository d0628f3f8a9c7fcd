"""Boxes, room-scoped pairs and inferred spatial relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import boxes
from plinth.functions.boxes import AXES, Thresholds

BOX = [f"{side}_{axis}" for axis in AXES for side in ("min", "max")]


def box_of(low: list[Column], high: list[Column] | None = None) -> list[Column]:
    """The aggregates of a box; points without finite coordinates do not count."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return [f(finite(c)).alias(f"{n}_{a}") for a, lo, hi in zip(AXES, low, high or low) for n, f, c in (("min", F.min, lo), ("max", F.max, hi))]


def extract_bbox(points: DataFrame, key: list[str], low: list[Column], high: list[Column] | None = None) -> DataFrame:
    """One box a key; points without finite coordinates do not count."""
    return points.groupBy(*key).agg(*box_of(low, high))


def _side(objects: DataFrame, prefix: str, block: list[str]) -> DataFrame:
    return objects.select(*block, *[F.col(c).alias(f"{prefix}{c}") for c in objects.columns if c not in block])


def pairs(objects: DataFrame, block: list[str], eligible: Column | None = None) -> DataFrame:
    """Directed pairs of different objects of a block (a room), columns prefixed a_ and b_."""
    joined = _side(objects, "a_", block).join(_side(objects, "b_", block), block)
    joined = joined.where("a_id <> b_id")
    return joined if eligible is None else joined.where(eligible)


def _both_ways(joined: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of a seed (a_) and an object (b_), and mirrored where that is no seed itself."""
    names = [c[2:] for c in joined.columns if c.startswith("a_") and c != "a_seed_"]
    way = lambda a, b: F.struct(*[F.col(f"{a}{c}").alias(f"a_{c}") for c in names], *[F.col(f"{b}{c}").alias(f"b_{c}") for c in names])
    ways = F.when(F.col("b_seed_"), F.array(way("a_", "b_"))).otherwise(F.array(way("a_", "b_"), way("b_", "a_")))
    return joined.select(*block, F.explode(ways).alias("p")).select(*block, "p.*")


def seeded_pairs(objects: DataFrame, block: list[str], seed: Column) -> DataFrame:
    """Directed pairs of different objects of a block with a seed (furniture) on one side: the others are never paired."""
    rows = objects.withColumn("seed_", F.coalesce(seed, F.lit(False)))
    joined = _side(rows.where("seed_"), "a_", block).join(_side(rows, "b_", block), block).where("a_id <> b_id")
    return _both_ways(joined, block)


def near_pairs(objects: DataFrame, block: list[str], reach: float, cell: float, seed: Column | None = None) -> DataFrame:
    """The pairs of a block within ``reach`` on x and y, over grids of several levels; with a seed on one side if one is given.

    A box belongs to the level whose cells are as wide as it is, ``cell`` times a power
    of four, so it covers few of them.  It is dealt to the cells of its own level and of
    every coarser one in use; a pair meets on the coarser level of the two, in the first
    cell that both share, so once.
    """
    rows = objects.withColumn("seed_", F.lit(True) if seed is None else F.coalesce(seed, F.lit(False)))
    wide = F.greatest(*[F.col(f"max_{k}") - F.col(f"min_{k}") for k in ("x", "y")], F.lit(0.0))
    rows = rows.withColumn("level_", F.least(F.greatest(F.ceil(F.log2(F.greatest(wide / cell, F.lit(1.0))) / 2), F.lit(0)), F.lit(40)).cast("int"))
    levels = sorted(r[0] for r in rows.select("level_").distinct().collect())  # 41 at most

    def dealt(part: DataFrame, prefix: str, widen: float) -> DataFrame:
        on = F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("level_")))
        part = part.withColumn("grid_", on if levels else F.col("level_")).withColumn("width_", F.lit(cell) * F.pow(F.lit(4.0), "grid_"))
        for axis in ("x", "y"):
            at = lambda c: F.floor(c / F.col("width_")).cast("long")
            part = part.withColumn(f"first_{axis}", at(F.col(f"min_{axis}") - widen))
            part = part.withColumn(f"cell_{axis}", F.explode(F.sequence(f"first_{axis}", at(F.col(f"max_{axis}") + widen))))
        return _side(part.drop("width_"), prefix, [*block, "grid_", "cell_x", "cell_y"])

    once = (F.col("cell_x") == F.greatest("a_first_x", "b_first_x")) & (F.col("cell_y") == F.greatest("a_first_y", "b_first_y")) & (F.col("grid_") == F.greatest("a_level_", "b_level_"))
    joined = dealt(rows.where("seed_"), "a_", reach).join(dealt(rows, "b_", 0.0), [*block, "grid_", "cell_x", "cell_y"]).where(once & (F.col("a_id") != F.col("b_id")))
    joined = joined.drop("cell_x", "cell_y", "grid_", *[f"{p}{c}" for p in ("a_", "b_") for c in ("first_x", "first_y", "level_")])
    return _both_ways(joined, block)


def infer(candidates: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Candidates with relation (null: none), distance and confidence."""
    return (
        candidates.withColumn("relation", boxes.relation("a_", "b_", t))
        .withColumn("distance", boxes.distance("a_", "b_"))
        .withColumn("confidence", boxes.confidence(F.col("relation")))
    )


def metadata(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The properties that an inferred edge carries."""
    return rows.select(
        "*",
        F.lit("aabb").alias("method"),
        F.lit(t.touch).alias("epsilon_touch"),
        F.lit(t.adjacent).alias("epsilon_adjacent"),
        F.lit(t.intersection).alias("epsilon_intersection"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("computed_at"),
    )


def strongest(edges: DataFrame, source: list[str], target: str = "target_id", order: str = "ord") -> DataFrame:
    """Per directed pair the strongest inferred relation, the first of equals; others pass."""
    rank = boxes.strength(F.col("relation"))
    best = F.row_number().over(Window.partitionBy(*source, target, rank.isNull()).orderBy(F.desc_nulls_last(rank), order))
    return edges.withColumn("rank_", rank).withColumn("place_", best).where("rank_ is null or place_ = 1").drop("rank_", "place_")
