"""Extraction scorecard: what the elements promise against what the graph holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import boxes, scalar

from . import construct, graph, schema, summary, tree
from .construct import CONTAINERS, Built

#: Property channels: key, and the tag whose presence promises it.
CHANNELS = [
    ("gml_name", "name"), ("gml_description", "description"), ("creation_date", "creationDate"), ("relative_to_terrain", "relativeToTerrain"), ("class_code", "class"), ("function_code", "function"),
    ("usage_code", "usage"), ("year_of_construction", "yearOfConstruction"), ("roof_type_code", "roofType"), ("measured_height", "measuredHeight"), ("storeys_above_ground", "storeysAboveGround"), ("storeys_below_ground", "storeysBelowGround"),
]


#: Tags of the elements that a relation is expected of; a child of surfaceDataMember may have any.
EXPECTING = [*schema.TAG_TYPES, *CONTAINERS, "ImplicitGeometry", "Polygon", "LinearRing", "pos", "posList", "Appearance", "target", "targetUri"]


def expected_relations(elements: DataFrame, targets: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """doc_id, relation, expected: every rule counted on the elements, in one pass and without moving one.

    targets: the target elements, where a table of them is at hand; counted: a row of elements stands for n with one tag and
    one line of ancestors (local.counted), and targets are given.
    """
    tag, anc = F.col("tag"), F.col("anc")
    parent = tree.direct_parent_tag(anc)
    under = lambda *tags: F.exists(anc, lambda a: a["tag"].isin(*tags))
    semantic = tag.isin(*schema.TAG_TYPES)
    owned = under(*schema.TAG_TYPES)
    block = ("Building", "BuildingPart")
    is_, via = (lambda t: tag == t), (lambda p: F.coalesce(parent == p, F.lit(False)))
    inner = ("interiorBuildingInstallation", "roomInstallation")
    boundary, opening = tag.isin(*schema.BOUNDARY_TAGS), tag.isin(*schema.OPENING_TAGS)
    tests: dict[str, Column] = {
        "HAS_CITY_OBJECT": semantic & via("cityObjectMember"),
        "HAS_GROUP_MEMBER": semantic & via("groupMember") & under("CityObjectGroup"),
        "CONSISTS_OF_BUILDING_PART": is_("BuildingPart") & via("consistsOfBuildingPart") & under(*block),
        "INTERIOR_ROOM": is_("Room") & via("interiorRoom") & under(*block),
        "INTERIOR_FURNITURE": is_("BuildingFurniture") & via("interiorFurniture") & under("Room"),
        "OUTER_BUILDING_INSTALLATION": is_("BuildingInstallation") & via("outerBuildingInstallation") & under(*block),
        "INTERIOR_BUILDING_INSTALLATION": is_("IntBuildingInstallation") & via(inner[0]) & under(*block),
        "ROOM_INSTALLATION": is_("IntBuildingInstallation") & via(inner[1]) & under("Room"),
        "CONTAINS": (is_("BuildingPart") & ~via("consistsOfBuildingPart") & under(*block)) | (is_("Room") & ~via("interiorRoom") & under(*block))
        | (is_("BuildingFurniture") & ~via("interiorFurniture") & under("Room")) | (is_("BuildingInstallation") & ~via("outerBuildingInstallation") & under(*block))
        | (is_("IntBuildingInstallation") & ~via(inner[0]) & ~via(inner[1]) & under(*block, "Room")),
        "INSIDE": is_("BuildingFurniture") & under("Room"),
        "HAS_ADDRESS": is_("Address") & under(*block),
        "BOUNDED_BY": boundary & under(*block, "Room", "BuildingInstallation", "IntBuildingInstallation"),
        "HAS_SURFACE_TYPE": boundary,
        "HAS_OPENING": opening & under(*schema.BOUNDARY_TAGS),
        "CONNECTS": opening & under("Room"),
        "HAS_LOD_GEOMETRY": tag.isin(*CONTAINERS, "ImplicitGeometry") & owned,
        "HAS_GEOMETRY_COMPONENT": tag.isin(*CONTAINERS) & owned,
        "HAS_GEOMETRY": is_("Polygon") & owned,
        "HAS_SURFACE_DATA": via("surfaceDataMember") & (F.get(anc, F.size(anc) - 2)["tag"] == "Appearance"),
    }
    up = lambda k: F.get(anc, F.size(anc) - k)
    ring = is_("LinearRing") & up(1)["tag"].isin("exterior", "interior") & (up(2)["tag"] == "Polygon") & owned
    tests["HAS_RING"] = ring
    # polygons below a container that has an owner
    members = F.when(is_("Polygon") & owned, F.size(F.filter(anc, lambda a: a["tag"].isin("Solid", "MultiSurface")))).otherwise(0)
    # a position list is the child of a ring, whose place its own ancestors tell
    placed = via("LinearRing") & up(2)["tag"].isin("exterior", "interior") & (up(3)["tag"] == "Polygon") & owned
    held = F.when(tag.isin("pos", "posList") & placed, F.col("held") if counted else construct.held()).otherwise(0)
    n = F.col("n") if counted else F.lit(1)
    count = lambda test: F.sum(F.when(test, n).otherwise(0)) if counted else F.count_if(F.coalesce(test, F.lit(False)))
    # an appearance without an owner above falls to an object of the document, if there is one
    look = count(is_("Appearance") & owned) + F.when(count(semantic & (tag != "Address")) > 0, count(is_("Appearance") & ~owned)).otherwise(0)
    counted = elements.groupBy("doc_id").agg(*[count(t).alias(k) for k, t in tests.items()], look.alias("HAS_APPEARANCE"), F.sum(members * n).alias("HAS_GEOMETRY_MEMBER"), F.sum(held).cast("long").alias("HAS_POS"))
    sd = F.get(F.filter(F.transform(anc, lambda a, i: F.struct(a["eid"].alias("eid"), (F.get(anc, i - 1)["tag"] == "surfaceDataMember").alias("hit"))), lambda a: a["hit"]), F.lit(0))["eid"]
    refs = (elements if targets is None else targets).where(tag.isin("target", "targetUri")).select("doc_id", sd.alias("sd"), F.explode(scalar.target_refs(F.col("text"))).alias("ref")).where("sd is not null").distinct()
    applies = refs.groupBy("doc_id").agg(F.count("*").alias("APPLIES_TO"))
    wide = counted.join(applies, "doc_id", "left")
    names = [*tests, "HAS_APPEARANCE", "HAS_GEOMETRY_MEMBER", "HAS_POS", "APPLIES_TO"]
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("relation"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("expected")) for n in names]))
    return wide.select("doc_id", entries.alias("e")).select("doc_id", "e.*")


def property_counts(built: Built) -> DataFrame:
    """doc_id, channel, expected, actual."""
    return kept_properties(built.elements, built.records, built.graph.nodes)


def kept_properties(elements: DataFrame, records: DataFrame, nodes: DataFrame) -> DataFrame:
    """property_counts of these elements, the documents of records and nodes."""
    parent = tree.direct_parent_tag(F.col("anc"))
    below = elements.where(parent.isin(*schema.TAG_TYPES) & F.col("tag").isin(*[t for _, t in CHANNELS], *schema.GENERIC_TAGS))
    generic = F.col("tag").isin(*schema.GENERIC_TAGS)
    # an object counts once a channel, however many children promise it
    once = below.groupBy("doc_id", "parent_eid").agg(*[F.max((F.col("tag") == t).cast("int")).alias(k) for k, t in CHANNELS], F.count_if(generic).alias("generic_attributes"))
    sums = once.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in [*[k for k, _ in CHANNELS], "generic_attributes"]])
    expected = _long(records.select("doc_id").distinct().join(sums, "doc_id", "left").na.fill(0), "expected")
    nodes = nodes.withColumn("semantic", F.col("node_type").isin(*schema.SEMANTIC_TYPES))
    has = [F.count_if(F.col("semantic") & F.map_contains_key(F.col("props"), F.lit(k))).alias(k) for k, _ in CHANNELS]
    keys = F.filter(F.map_keys("props"), lambda k: k.startswith("attr_") & ~k.endswith("_uom"))
    actual = _long(nodes.groupBy("doc_id").agg(*has, F.sum(F.size(keys)).alias("generic_attributes")), "actual")
    return expected.join(actual, ["doc_id", "channel"])


def _long(wide: DataFrame, name: str) -> DataFrame:
    channels = [c for c in wide.columns if c != "doc_id"]
    return wide.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("long").alias(name)) for c in channels])).alias("e")).select("doc_id", "e.*")


def spatial_scores(built: Built) -> DataFrame:
    """doc_id, inferred, expected, metadata_valid, schema_valid, pairs, single, spatial_coverage, spatial_sanity."""
    rooms = built.room_objects.groupBy("doc_id", "room").agg(*[F.count_if(F.col("flag") == k).alias(n) for k, n in (("F", "f"), ("B", "b"), ("O", "o"))])
    expected = rooms.groupBy("doc_id").agg(F.sum(summary.candidate_pairs(rooms)).alias("expected"))
    typed = graph.typed_edges(built.graph.edges.where(F.col("relation").isin(*schema.SPATIAL)), built.graph.nodes)
    complete = F.forall(F.array(*[F.lit(k) for k in schema.SPATIAL_METADATA]), lambda k: F.map_contains_key(F.col("props"), k))
    sure = F.col("props")["confidence"].try_cast("double").between(0, 1)
    triples = F.broadcast(schema.allowed_triples(built.graph.edges.sparkSession).withColumn("legal", F.lit(True)))
    typed = typed.join(triples, ["source_type", "relation", "target_type"], "left")
    pair = typed.groupBy("doc_id", "source_id", "target_id").agg(F.count("legal").alias("legal"), F.count("*").alias("n"), F.count_distinct("relation").alias("kinds"), F.count_if(F.coalesce(complete & sure, F.lit(False))).alias("valid"))
    found = pair.groupBy("doc_id").agg(F.sum("n").alias("inferred"), F.sum("valid").alias("metadata_valid"), F.sum("legal").alias("schema_valid"), F.count("*").alias("pairs"), F.count_if(F.col("kinds") <= 1).alias("single"))
    docs = built.elements.select("doc_id").distinct()
    rows = docs.join(expected, "doc_id", "left").join(found, "doc_id", "left").na.fill(0)
    ratio = scalar.safe_ratio
    sanity = (ratio(F.col("metadata_valid"), F.col("inferred")) + ratio(F.col("schema_valid"), F.col("inferred")) + ratio(F.col("single"), F.col("pairs"))) / 3
    return rows.select("*", F.bround(ratio(F.col("inferred"), F.col("expected")) * 100, 2).alias("spatial_coverage"), F.bround(sanity * 100, 2).alias("spatial_sanity"))


def scorecard(built: Built) -> DataFrame:
    """One row a document: totals and scores."""
    return cards(built).join(spatial_scores(built), "doc_id", "left")


def cards(built: Built) -> DataFrame:
    """The scorecard without inferred relations, which need not be built for it."""
    nodes, edges = built.graph.nodes, built.graph.edges
    actual = edges.groupBy("doc_id", "relation").agg(F.count("*").alias("actual"))
    semantic = built.records.groupBy("doc_id").agg(F.count("*").alias("semantic_expected"))
    held = nodes.where(F.col("node_type").isin(*schema.SEMANTIC_TYPES, *schema.GEOMETRY_TYPES)).groupBy("doc_id").agg(F.count("*").alias("node_actual"))
    return scores(graph.cut(expected_relations(built.elements)), actual, semantic, held, property_counts(built))


def scores(expected: DataFrame, actual: DataFrame, semantic: DataFrame, held: DataFrame, properties: DataFrame) -> DataFrame:
    """Totals and scores by document from doc_id, relation, expected; relation, actual; semantic_expected; node_actual; and property_counts."""
    relations = expected.join(actual, ["doc_id", "relation"], "left").na.fill(0, ["actual"])
    ratio = scalar.safe_ratio(F.col("actual"), F.col("expected"))
    relation = relations.groupBy("doc_id").agg(
        F.coalesce(F.avg(F.when(F.col("expected") > 0, ratio)), F.lit(1.0)).alias("relation_ratio"), F.sum("actual").alias("relation_actual"), F.sum("expected").alias("relation_expected")
    )
    geometry = F.col("relation").isin("HAS_LOD_GEOMETRY", "HAS_GEOMETRY_COMPONENT", "HAS_GEOMETRY", "HAS_RING", "HAS_POS")
    promised = expected.where(geometry).groupBy("doc_id").agg(F.sum("expected").alias("geometry_expected"))
    props = properties.groupBy("doc_id").agg(F.sum("actual").alias("property_actual"), F.sum("expected").alias("property_expected"))
    rows = relation.join(promised, "doc_id", "left").join(semantic, "doc_id", "left").join(held, "doc_id", "left").join(props, "doc_id", "left").na.fill(0)
    rows = rows.withColumn("node_expected", F.col("semantic_expected") + F.col("geometry_expected")).drop("semantic_expected", "geometry_expected")
    node, prop = (scalar.safe_ratio(F.col(f"{k}_actual"), F.col(f"{k}_expected")) for k in ("node", "property"))
    rows = rows.withColumn("overall", summary.overall(node, F.col("relation_ratio"), prop))
    percent = lambda c: F.bround(c * 100, 2)
    return rows.withColumn("node_score", percent(node)).withColumn("property_score", percent(prop)).withColumn("relation_score", percent(F.col("relation_ratio"))).drop("relation_ratio")


def appearance_coverage(built: Built) -> DataFrame:
    """doc_id, total, linked, unresolved, coverage of appearances."""
    rows = built.graph.nodes.where("node_type = 'Appearance'").select("doc_id", "id", F.col("props")["owner_resolution"].alias("how"))
    linked = built.graph.edges.where("relation = 'HAS_APPEARANCE'").select("doc_id", F.col("target_id").alias("id"), F.lit(1).alias("linked")).distinct()
    joined = rows.join(linked, ["doc_id", "id"], "left")
    out = joined.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("linked").alias("linked"), F.count_if(F.col("how") == '"unresolved"').alias("unresolved"))
    return out.withColumn("coverage", scalar.safe_ratio(F.col("linked"), F.col("total")) * 100)


def building_breakdown(built: Built) -> DataFrame:
    """root (document and id of a building) and, over everything below it, distinct nodes by type."""
    nodes, edges = built.graph.nodes, built.graph.edges
    key = lambda c: F.concat_ws("\x1f", "doc_id", c)
    steps = edges.where(F.col("relation").isin(*schema.HIERARCHY, "BOUNDED_BY", "HAS_OPENING", "HAS_ADDRESS")).select(key("source_id").alias("source_id"), key("target_id").alias("target_id"))
    starts = nodes.where("node_type = 'Building'").select(key("id").alias("start"))
    found = graph.closure(steps, starts)
    kinds = nodes.select(key("id").alias("node"), "node_type")
    return found.join(kinds, "node").groupBy("start").pivot("node_type", schema.SEMANTIC_TYPES).agg(F.count_distinct("node")).na.fill(0).withColumnRenamed("start", "root")


def theme_coverage(g: graph.SceneGraph) -> DataFrame:
    """doc_id, present: how many of five families of a document's graph are not empty, and families."""
    semantic, geometric = F.col("node_type").isin(*schema.SEMANTIC_TYPES), F.col("node_type").isin(*schema.GEOMETRY_TYPES)
    nodes = g.nodes.groupBy("doc_id").agg(F.count_if(semantic).alias("a"), F.count_if(geometric).alias("b"))
    shape = F.col("relation").isin(*schema.GEOMETRY_RELATIONS)
    near = F.col("relation").isin(*schema.SPATIAL)
    edges = g.edges.groupBy("doc_id").agg(F.count_if(~shape & ~near).alias("c"), F.count_if(near).alias("d"), F.count_if(shape).alias("e"))
    rows = nodes.join(edges, "doc_id", "left").na.fill(0)
    present = sum(((F.col(k) > 0).cast("long") for k in "abcde"), F.lit(0).cast("long"))
    return rows.select("doc_id", present.alias("present"), F.lit(5).cast("long").alias("families"))


def enrichment(nodes: DataFrame) -> DataFrame:
    """doc_id, semantic nodes, those with a name and with generic attributes, their shares, and attributes a node that has any."""
    rows = nodes.where(F.col("node_type").isin(*schema.SEMANTIC_TYPES))
    keys = F.size(F.filter(F.map_keys("props"), lambda k: k.startswith("attr_") & ~k.endswith("_uom")))
    named = F.col("props")["gml_name"].isNotNull()
    out = rows.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(named).alias("named"), F.count_if(keys > 0).alias("attributed"), F.sum(keys).alias("attributes"))
    percent = lambda c: scalar.safe_ratio(F.col(c), F.col("nodes")) * 100
    each = F.when(F.col("attributed") > 0, F.col("attributes") / F.col("attributed")).otherwise(0.0)
    return out.withColumn("named_percent", percent("named")).withColumn("attributed_percent", percent("attributed")).withColumn("attributes_each", each)


def geometry_density(edges: DataFrame) -> DataFrame:
    """doc_id, measure, avg_n, max_n: rings a polygon and positions a ring."""
    one = lambda relation, name: summary.density(edges.where(F.col("relation") == relation), ["source_id"], ["doc_id"]).select("doc_id", F.lit(name).alias("measure"), "avg_n", "max_n")
    return one("HAS_RING", "rings a polygon").unionByName(one("HAS_POS", "positions a ring"))


def pair_stats(built: Built) -> DataFrame:
    """family, inferred and its split over the relations, of all documents' furniture pairs."""
    g = built.graph
    kind = g.nodes.select("doc_id", "id", F.regexp_replace(F.coalesce(F.col("props")["opening_type"], F.col("props")["source_tag"]), '"', "").alias("tag"))
    rows = graph.typed_edges(g.edges.where(F.col("relation").isin(*schema.SPATIAL)), g.nodes)
    for side in ("source", "target"):
        rows = rows.join(kind.select("doc_id", F.col("id").alias(f"{side}_id"), F.col("tag").alias(f"{side}_tag")), ["doc_id", f"{side}_id"])
    family = boxes.pair_family(F.col("source_type"), F.col("source_tag"), F.col("target_type"), F.col("target_tag"))
    return rows.groupBy(family.alias("family")).agg(F.count("*").alias("inferred"), *[F.count_if(F.col("relation") == r).alias(r) for r in schema.SPATIAL])
