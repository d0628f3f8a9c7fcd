"""Column functions on axis-aligned boxes, min_x .. max_z, with an optional prefix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Thresholds:
    # Defaults of the distance classes.
    touch: float = 0.05
    adjacent: float = 0.50
    intersection: float = 1e-6


def lo(prefix: str, axis: str) -> Column:
    return F.col(f"{prefix}min_{axis}")


def hi(prefix: str, axis: str) -> Column:
    return F.col(f"{prefix}max_{axis}")


def _all(parts) -> Column:
    return reduce(lambda x, y: x & y, parts)


def axis_gap(a: str, b: str, axis: str) -> Column:
    return F.greatest(lo(b, axis) - hi(a, axis), lo(a, axis) - hi(b, axis), F.lit(0.0))


def axis_overlap(a: str, b: str, axis: str) -> Column:
    return F.least(hi(a, axis), hi(b, axis)) - F.greatest(lo(a, axis), lo(b, axis))


def distance(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, (axis_gap(a, b, k) * axis_gap(a, b, k) for k in AXES)))


def intersects(a: str, b: str, epsilon: float) -> Column:
    """Overlap above epsilon on every axis: flat boxes never intersect."""
    return _all(axis_overlap(a, b, k) > epsilon for k in AXES)


def contains(a: str, b: str) -> Column:
    return F.coalesce(_all((lo(a, k) <= lo(b, k)) & (hi(b, k) <= hi(a, k)) for k in AXES), F.lit(False))


def touches_closed(a: str, b: str) -> Column:
    """Closed overlap on every axis."""
    return _all((lo(a, k) <= hi(b, k)) & (lo(b, k) <= hi(a, k)) for k in AXES)


def centroid(prefix: str = "") -> Column:
    return F.struct(*[((lo(prefix, k) + hi(prefix, k)) / 2).alias(k) for k in AXES])


def relation(a: str, b: str, t: Thresholds = Thresholds()) -> Column:
    """INTERSECTS, else TOUCHES, else ADJACENT_TO, else null; distances are compared unrounded."""
    d = distance(a, b)
    return F.when(intersects(a, b, t.intersection), F.lit("INTERSECTS")).when(d <= t.touch, F.lit("TOUCHES")).when(d <= t.adjacent, F.lit("ADJACENT_TO"))


def confidence(rel: Column) -> Column:
    # Confidence of each inferred relation.
    return F.when(rel == "INTERSECTS", F.lit(0.95)).when(rel == "TOUCHES", F.lit(0.90)).when(rel == "ADJACENT_TO", F.lit(0.80))


def strength(rel: Column) -> Column:
    """Rank of an inferred relation, strongest highest; null for any other."""
    return F.when(rel == "INTERSECTS", F.lit(3)).when(rel == "TOUCHES", F.lit(2)).when(rel == "ADJACENT_TO", F.lit(1))


def pair_family(a_type: Column, a_tag: Column, b_type: Column, b_tag: Column) -> Column:
    """Family of an unordered pair of nodes; openings are doors and windows only."""
    furniture = F.lit("BuildingFurniture")
    opening = lambda kind, tag: (kind == "Opening") & tag.isin("Door", "Window")
    one = lambda test: ((a_type == furniture) & test(b_type, b_tag)) | ((b_type == furniture) & test(a_type, a_tag))
    return (
        F.when((a_type == furniture) & (b_type == furniture), F.lit("furniture_furniture"))
        .when(one(lambda kind, tag: kind == "BoundarySurface"), F.lit("furniture_boundary_surface"))
        .when(one(opening), F.lit("furniture_opening"))
    )
