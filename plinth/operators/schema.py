"""Node types, relations, tags and rules, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Node types, relations, tags and the triples that a graph may hold.
OBJECT_TYPES = ["CityObjectMember", "CityObjectGroup", "Building", "BuildingPart", "Room", "BuildingInstallation", "IntBuildingInstallation", "BoundarySurface", "Opening", "BuildingFurniture"]
SEMANTIC_TYPES = OBJECT_TYPES + ["Address", "Appearance", "SurfaceData"]
GEOMETRY_TYPES = ["Geometry", "ImplicitGeometry", "Solid", "MultiSurface", "MultiCurve", "Polygon", "LinearRing", "Position"]
BOUNDARY_TAGS = ["WallSurface", "RoofSurface", "GroundSurface", "InteriorWallSurface", "FloorSurface", "CeilingSurface", "ClosureSurface", "OuterCeilingSurface", "OuterFloorSurface"]
OPENING_TAGS = ["Door", "Window"]
SPATIAL = ["ADJACENT_TO", "TOUCHES", "INTERSECTS"]
HIERARCHY = ["CONTAINS", "CONSISTS_OF_BUILDING_PART", "INTERIOR_ROOM", "OUTER_BUILDING_INSTALLATION", "INTERIOR_BUILDING_INSTALLATION", "ROOM_INSTALLATION", "INTERIOR_FURNITURE"]
GEOMETRY_RELATIONS = ["HAS_LOD_GEOMETRY", "HAS_GEOMETRY_COMPONENT", "HAS_GEOMETRY_MEMBER", "HAS_GEOMETRY", "HAS_RING", "HAS_POS"]
GENERIC_TAGS = ["stringAttribute", "intAttribute", "doubleAttribute", "measureAttribute", "uriAttribute", "dateAttribute"]
SPATIAL_METADATA = ["method", "distance", "epsilon_touch", "epsilon_adjacent", "epsilon_intersection", "confidence", "computed_at"]
SCORE_WEIGHTS = {"node": 0.40, "relation": 0.30, "property": 0.30}

#: Tag of an object's element, and its node type.
TAG_TYPES: dict[str, str] = (
    {"cityObjectMember": "CityObjectMember"}
    | {t: t for t in ["CityObjectGroup", "Building", "BuildingPart", "Room", "BuildingInstallation", "IntBuildingInstallation", "BuildingFurniture", "Address"]}
    | {t: "BoundarySurface" for t in BOUNDARY_TAGS}
    | {t: "Opening" for t in OPENING_TAGS}
)

_MEMBERS = [t for t in OBJECT_TYPES if t != "CityObjectMember"] + ["Address"]
_BLOCKS = ["Building", "BuildingPart"]
_PAIRED = ["BoundarySurface", "Opening"]
#: Relation, source types, target types.
_LEGAL: list[tuple[str, list[str], list[str]]] = [
    ("HAS_CITY_OBJECT", ["CityObjectMember"], _MEMBERS),
    ("HAS_GROUP_MEMBER", ["CityObjectGroup"], _MEMBERS),
    ("CONTAINS", _BLOCKS, ["BuildingPart", "Room", "BuildingInstallation", "IntBuildingInstallation"]),
    ("CONTAINS", ["Room"], ["IntBuildingInstallation", "BuildingFurniture"]),
    ("CONSISTS_OF_BUILDING_PART", _BLOCKS, ["BuildingPart"]),
    ("INTERIOR_ROOM", _BLOCKS, ["Room"]),
    ("OUTER_BUILDING_INSTALLATION", _BLOCKS, ["BuildingInstallation"]),
    ("INTERIOR_BUILDING_INSTALLATION", _BLOCKS, ["IntBuildingInstallation"]),
    ("ROOM_INSTALLATION", ["Room"], ["IntBuildingInstallation"]),
    ("INTERIOR_FURNITURE", ["Room"], ["BuildingFurniture"]),
    ("HAS_ADDRESS", _BLOCKS, ["Address"]),
    ("BOUNDED_BY", [*_BLOCKS, "Room", "BuildingInstallation", "IntBuildingInstallation"], ["BoundarySurface"]),
    ("HAS_SURFACE_TYPE", ["BoundarySurface"], ["BoundarySurfaceType"]),
    ("HAS_OPENING", ["BoundarySurface"], ["Opening"]),
    ("CONNECTS", ["Opening"], ["Room"]),
    ("INSIDE", ["BuildingFurniture"], ["Room"]),
    *[(r, ["BuildingFurniture"], [*_PAIRED, "BuildingFurniture"]) for r in SPATIAL],
    *[(r, _PAIRED, ["BuildingFurniture"]) for r in SPATIAL],
    ("HAS_SURFACE_DATA", ["Appearance"], ["SurfaceData"]),
    ("APPLIES_TO", ["SurfaceData"], ["Polygon", "BoundarySurface", "Solid", "MultiSurface", "MultiCurve", "Geometry", "ImplicitGeometry", "LinearRing", "Position"]),
    ("HAS_GEOMETRY_COMPONENT", ["Geometry"], ["Solid", "MultiSurface", "MultiCurve"]),
    ("HAS_GEOMETRY_MEMBER", ["Solid", "MultiSurface"], ["Polygon"]),
    ("HAS_RING", ["Polygon"], ["LinearRing"]),
    ("HAS_POS", ["LinearRing"], ["Position"]),
    ("HAS_GEOMETRY", OBJECT_TYPES, ["Polygon"]),
    ("HAS_APPEARANCE", OBJECT_TYPES, ["Appearance"]),
    ("HAS_LOD_GEOMETRY", OBJECT_TYPES, ["Geometry", "ImplicitGeometry"]),
]
TRIPLES: list[tuple[str, str, str]] = sorted({(s, r, t) for r, sources, targets in _LEGAL for s in sources for t in targets})

#: Semantic edges: child type, ancestor types, tag of the direct parent (None: any; a list: none of these), relation, child is the source.
EDGE_RULES: list[tuple[str, list[str], str | list[str] | None, str, bool]] = [
    ("BuildingPart", _BLOCKS, "consistsOfBuildingPart", "CONSISTS_OF_BUILDING_PART", False),
    ("BuildingPart", _BLOCKS, ["consistsOfBuildingPart"], "CONTAINS", False),
    ("Room", _BLOCKS, "interiorRoom", "INTERIOR_ROOM", False),
    ("Room", _BLOCKS, ["interiorRoom"], "CONTAINS", False),
    ("BuildingInstallation", _BLOCKS, "outerBuildingInstallation", "OUTER_BUILDING_INSTALLATION", False),
    ("BuildingInstallation", _BLOCKS, ["outerBuildingInstallation"], "CONTAINS", False),
    ("IntBuildingInstallation", [*_BLOCKS, "Room"], "interiorBuildingInstallation", "INTERIOR_BUILDING_INSTALLATION", False),
    ("IntBuildingInstallation", [*_BLOCKS, "Room"], "roomInstallation", "ROOM_INSTALLATION", False),
    ("IntBuildingInstallation", [*_BLOCKS, "Room"], ["interiorBuildingInstallation", "roomInstallation"], "CONTAINS", False),
    ("BoundarySurface", [*_BLOCKS, "Room", "BuildingInstallation", "IntBuildingInstallation"], None, "BOUNDED_BY", False),
    ("Opening", ["BoundarySurface"], None, "HAS_OPENING", False),
    ("Opening", ["Room"], None, "CONNECTS", True),
    ("BuildingFurniture", ["Room"], None, "INSIDE", True),
    ("BuildingFurniture", ["Room"], "interiorFurniture", "INTERIOR_FURNITURE", False),
    ("BuildingFurniture", ["Room"], ["interiorFurniture"], "CONTAINS", False),
    ("Address", _BLOCKS, None, "HAS_ADDRESS", False),
]


def allowed_triples(spark: SparkSession) -> DataFrame:
    """source_type, relation, target_type; some 120 rows, for a broadcast."""
    return spark.createDataFrame(TRIPLES, "source_type string, relation string, target_type string")
