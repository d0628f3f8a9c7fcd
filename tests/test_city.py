"""The building documents of the star tables: elements by tag, and queries that keep nothing on disk."""

import os

import pytest

from plinth.functions import scalar
from plinth.operators import schema
from plinth.plans import city, star

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

#: Queries that run from the tables to the result without a checkpoint.
LAZY = ["city_addresses", "city_fallback_ids", "city_generic_attributes", "city_records", "city_appearance_owners", "city_appearance_coverage", "city_enrichment", "city_building_properties", "city_property_counts", "city_expected_relations", "city_geometry_edges", "city_ring_positions", "city_subtree_sizes", "city_gml_id_index", "city_geometry_nodes", "city_geometry_density", "city_validate_graph", "city_room_edges", "city_room_boxes"]


def files(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names}


@pytest.mark.parametrize("name", LAZY)
def test_nothing_is_kept_on_disk(spark, name):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = files(folder)
    city._KEPT.clear()
    star.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert files(folder) <= before


@pytest.mark.parametrize("tags", [["Address", "LocalityName"], ["WallSurface", "Room", "boundedBy", "opening"], ["Polygon", "posList", "target"], ["Door", "part", "value"]])
def test_elements_by_tag(spark, tags):
    columns = [c if c != "attrs" else "to_json(attrs)" for c in city.ELEMENT]
    whole = city.elements(spark, FOLDER).where(city.F.col("tag").isin(*tags)).selectExpr(*columns)
    some = city.elements(spark, FOLDER, tags).selectExpr(*columns)
    assert some.count() == whole.count() > 0 and some.exceptAll(whole).isEmpty()


def test_bare_elements_have_the_same_places(spark):
    whole, bare = (city.elements(spark, FOLDER, bare=b).select("doc_id", "eid", "tag", "anc") for b in (False, True))
    assert bare.count() == whole.count() and bare.exceptAll(whole).isEmpty()


def test_subtree_sizes_are_those_of_descendants(spark):
    found, roots = city.elements(spark, FOLDER, ["Building", "BuildingPart", "Address", "LocalityName"]), city.records(spark, FOLDER, ["Building", "BuildingPart"])
    got = city.tree.subtree_sizes(found, roots, ["Building", "BuildingPart"])
    want = city.tree.descendants(found, roots).groupBy("doc_id", "root_eid").agg(city.F.count("*").alias("n"))
    assert got.count() == want.count() > 0 and got.select(*want.columns).exceptAll(want).isEmpty()


def test_position_lists_are_counted_as_they_are_read(spark):
    texts = ["1 2 3 4 5 6", "1 2 3 4", "1 2 3 4 5", "1", "", "  ", "1 x 3", None, "1 2 3 4 5 6 7", "nan 1 2"]
    rows = spark.createDataFrame([(t, d) for t in texts for d in ("3", "2", "1", "x", None)], "t string, d string")
    sizes = rows.select(scalar.pos_list_size(city.F.col("t"), city.F.col("d")).alias("a"), city.F.size(scalar.parse_pos_list(city.F.col("t"), city.F.col("d"))).alias("b"), "t", "d").collect()
    assert all(r.a == r.b for r in sizes), [r for r in sizes if r.a != r.b]


def test_records_by_type(spark):
    whole = city.construct.records(city.elements(spark, FOLDER)).select("doc_id", "eid", "id", "node_type")
    assert city.records(spark, FOLDER).select(*whole.columns).exceptAll(whole).isEmpty() and city.records(spark, FOLDER).count() == whole.count()
    assert set(schema.TAG_TYPES.values()) >= {r.node_type for r in whole.select("node_type").distinct().collect()}


@pytest.fixture(scope="module")
def repeated(spark):
    """Elements in which two documents have ids that repeat: of rooms and of surfaces and openings, of polygons; and what they are picked by."""
    F = city.F
    found = city.elements(spark, FOLDER).where("doc_id in ('nation_1', 'nation_2', 'nation_3', 'nation_4')")
    same = F.when((F.col("doc_id") == "nation_1") & F.col("tag").isin("Room", "FloorSurface", "Window"), F.concat("tag", F.col("eid") % 2))
    same = F.coalesce(same, F.when((F.col("doc_id") == "nation_2") & (F.col("tag") == "Polygon"), F.concat(F.lit("same_"), F.col("eid") % 3)))
    found = city.graph.cut(found.withColumn("attrs", F.when(same.isNotNull(), F.create_map(F.lit(city.ID), same)).otherwise(F.col("attrs"))))

    def pick(tags=None, bare=False, home=False):
        rows = found if tags is None else found.where(F.col("tag").isin(*tags))
        return rows.withColumn("home", F.xxhash64("doc_id")) if home else rows

    return found, pick, city.construct.build(found, city.T)


GENERAL = {
    "geometry_node_counts": (city.local.SHAPES, lambda b: city.summary.count_by(b.graph.nodes.where("node_type in ('Polygon', 'LinearRing', 'Position')"), "doc_id", "node_type")),
    "geometry_density": (city.local.SHAPES, lambda b: city.score.geometry_density(b.graph.edges)),
    "building_breakdown": (city.local.SEMANTIC, city.score.building_breakdown),
    "room_counts": (city.local.SEMANTIC, lambda b: city.room_edges(b.graph)),
}


@pytest.mark.parametrize("name", list(GENERAL))
def test_documents_whose_ids_repeat_are_built(spark, repeated, name):
    found, pick, built = repeated
    need, general = GENERAL[name]
    odd = {r.doc_id for r in city.local.repeating(pick(need)).collect()}
    assert odd == ({"nation_1"} if need is city.local.SEMANTIC else {"nation_2"})
    fn = getattr(city.local, name)
    one = (lambda p: fn(p, city.construct.records(p(["Room"])))) if name == "room_counts" else fn
    got = city.local.told(pick, need, one, lambda rest: general(city.construct.build(rest, city.T)))
    want = general(built).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 3
    # without the check the documents would be wrong (one ring a polygon either way)
    assert name == "geometry_density" or sorted(map(str, one(pick).select(*got.columns).collect())) != sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["city_applies_to", "city_rejected_edges", "city_building_breakdown", "city_theme_coverage"])
def test_no_graph_is_built(spark, name, monkeypatch):
    monkeypatch.setattr(city.construct, "build", lambda *a: pytest.fail("a graph is built"))
    city._KEPT.clear()
    assert star.queries()[name](spark, FOLDER).count() > 0 and not city._KEPT


def test_references_that_need_the_graph(spark):
    refs = spark.createDataFrame([("a", "p_1_0"), ("b", "polygon_3"), ("c", "p_ring_0"), ("d", "polygon:p_1"), ("e", "wall_7"), ("f", "buildingpart_x")], "doc_id string, ref string")
    assert {r.doc_id for r in city.local.strange(refs).collect()} == {"b", "c", "d"}


def test_boxes_of_documents_whose_ids_do_not_repeat(spark, repeated):
    found, pick, built = repeated
    rows = city.local.room_objects(pick, given=scalar.gml_id(city.F.col("attrs"))).where("doc_id in ('nation_3', 'nation_4')").select("doc_id", city.F.col("given").alias("id"), *city.spatial.BOX)
    want = built.room_objects.where("doc_id in ('nation_3', 'nation_4')").select(*rows.columns)
    assert want.count() == rows.count() > 0 and want.exceptAll(rows).isEmpty()


@pytest.mark.parametrize("room", [256, 2])
def test_documents_with_near_objects(spark, repeated, monkeypatch, room):
    found, pick, built = repeated
    monkeypatch.setattr(city.local, "ROOM", room)
    got = {r.doc_id for r in city.local.near_documents(pick, city.T).collect()} - {"nation_1"}
    near = built.graph.edges.where(city.F.col("relation").isin(*schema.SPATIAL)).select("doc_id").distinct()
    assert got == {r.doc_id for r in near.collect()} - {"nation_1"} and got


def test_a_scorecard_without_the_graph(spark, monkeypatch):
    monkeypatch.setattr(city.construct, "build", lambda *a: pytest.fail("a graph is built"))
    city._KEPT.clear()
    assert star.queries()["city_scorecard"](spark, FOLDER).count() == 25 and not city._KEPT


CARD = ["doc_id", "node_score", "property_score", "relation_score", "overall", "node_expected", "node_actual", "property_expected", "property_actual", "relation_expected", "relation_actual"]


def card_rows(cards):
    return sorted(map(str, cards.select(*CARD).collect()))


def near_cards(found, tags):
    """Cards from the elements alone, properties from nodes that are not merged."""
    recs = city.construct.records(found)
    properties = city.score.kept_properties(found, recs, city.construct.semantic_nodes(found, recs))
    return lambda pick: city.local.cards(pick, tags, *city.local.appearances(pick, None, recs), properties)


def test_cards_of_documents_whose_ids_repeat(spark, repeated):
    found, pick, built = repeated
    near = near_cards(found, [*city.score.EXPECTING, "X3DMaterial"])
    got = city.local.told(pick, [*city.local.SEMANTIC, *city.local.SHAPES], near, lambda rest: city.score.cards(city.construct.build(rest, city.T, False)))
    want = card_rows(city.score.scorecard(built))
    assert card_rows(got) == want and len(want) == 4
    # without the check the documents would be wrong
    wrong = {r.split("'")[1] for r in set(card_rows(near(pick))) ^ set(want)}
    assert wrong == {"nation_1", "nation_2"}


def test_cards_of_other_paths(spark):
    """Containers within and without an owner, implicit geometries, objects below an address, rings and lists out of place, positions that cannot be read."""
    F = city.F
    shape = "Polygon exterior LinearRing posList"
    lines = [  # path, id, text
        ("cityObjectMember", None, None), ("cityObjectMember Building", "b", None), ("cityObjectMember Building name", None, "house"), ("cityObjectMember Building name", None, "home"), ("cityObjectMember Building class", None, None),
        ("cityObjectMember Building lod1Solid Solid", "s", None), ("cityObjectMember Building lod1Solid Solid surfaceMember " + shape, "", "1 2 3 4 5 6"), ("cityObjectMember Building lod1Solid Solid surfaceMember Polygon interior LinearRing pos", None, "1 2 3"),
        ("cityObjectMember Building lod1Solid Solid x MultiSurface", None, None), ("cityObjectMember Building lod1Solid Solid x MultiSurface y " + shape, "", "1 2 3 4 5"), ("cityObjectMember Building lod1Solid Solid x MultiSurface y Polygon LinearRing pos", None, "1 2 3"),
        ("MultiSurface", None, None), ("MultiSurface cityObjectMember Room " + shape, "", "7 8 9"), ("MultiSurface cityObjectMember Room Polygon exterior LinearRing pos", None, "seven"), ("Solid " + shape, "", "1 2 3"),
        ("cityObjectMember Building lod2 ImplicitGeometry", "i", None), ("ImplicitGeometry", None, None), ("Address", None, None), ("Address MultiCurve", None, None), ("Address " + shape, "", "1 2 3"), ("cityObjectMember Door", None, None),
        ("cityObjectMember Building boundedBy WallSurface", "w", None), ("cityObjectMember Building boundedBy WallSurface opening Window", None, None), ("cityObjectMember Building boundedBy WallSurface opening Window address Address", None, None),
        ("cityObjectMember Building interiorRoom Room", "r", None), ("cityObjectMember Building interiorRoom Room stuff BuildingFurniture", None, None), ("cityObjectMember Building interiorRoom Room interiorBuildingInstallation IntBuildingInstallation", None, None),
        ("cityObjectMember Building appearance Appearance", None, None), ("cityObjectMember Building appearance Appearance surfaceDataMember Sheen", "m", None), ("cityObjectMember Building appearance Appearance surfaceDataMember Sheen target", None, "#s #w #b #gone"),
        ("Appearance", None, None), ("Appearance surfaceDataMember X3DMaterial", None, None), ("Appearance surfaceDataMember X3DMaterial target", None, "#i #r"),
    ]
    rows, known = [], {}

    def place(path, id_, text, again):
        """The element of a path, its last ancestors first where they are not there yet."""
        tags = tuple(path.split())
        if len(tags) > 1 and tags[:-1] not in known:
            place(" ".join(tags[:-1]), None, None, False)
        anc = [*known[tags[:-1]][1], (known[tags[:-1]][0], tags[-2])] if len(tags) > 1 else []
        if again or tags not in known:
            eid = len(rows)
            # what lies below a new element is new as well
            for t in [t for t in known if t[: len(tags)] == tags]:
                del known[t]
            known[tags] = (eid, anc)
            rows.append(("d", eid, eid, anc[-1][0] if anc else None, len(anc), tags[-1], None, text, {city.ID: id_} if id_ else {}, anc))

    for path, id_, text in lines:
        place(path, id_, text, True)
    kinds = ", ".join(f"{n} {k}" for n, k in zip(city.ELEMENT, city._KINDS))
    found = city.graph.cut(spark.createDataFrame(rows, kinds))
    pick = lambda tags=None, bare=False, home=False: found if tags is None else found.where(F.col("tag").isin(*tags))
    built = city.construct.build(found, city.T)
    assert city.local.repeating(pick(city.local.SEMANTIC + city.local.SHAPES)) is None and {r.relation for r in built.graph.edges.collect()} >= {"HAS_LOD_GEOMETRY", "HAS_GEOMETRY_MEMBER", "HAS_GEOMETRY_COMPONENT", "APPLIES_TO", "HAS_POS"}
    got, want = card_rows(near_cards(found, [*city.score.EXPECTING, "X3DMaterial", "Sheen"])(pick)), card_rows(city.score.scorecard(built))
    assert got == want and len(want) == 1
    counts = built.graph.edges.where(~F.col("relation").isin(*schema.SPATIAL)).groupBy("relation").count()
    assert counts.where("relation = 'HAS_GEOMETRY_MEMBER'").head()["count"] == 3


def test_tables_are_left_out_by_their_tags(spark, monkeypatch):
    """What a table is left out by are all the tags that its rows can have."""
    seen = {}
    monkeypatch.setattr(city, "_exploded", lambda rows, found, only, bare, home: seen.setdefault(home, {t for e in found for t in e.tags}) and [])
    city._parts(spark, FOLDER)
    seen.pop("nk")
    assert seen == {"c_custkey": set(city._CUSTOMERS), "o_orderkey": set(city._ROOMS), "l_orderkey": set(city._THINGS), "s_suppkey": set(city._SUPPLIERS)}
    for home, tags in list(seen.items()):
        seen.clear()
        city._parts(spark, FOLDER, [*tags][:1])
        assert home in seen and ("l_orderkey" in seen) == (home == "l_orderkey" or bool({*tags} & set(city._THINGS) and [*tags][0] in city._THINGS))


@pytest.mark.parametrize("name, general", [("city_enrichment", lambda b: city.score.enrichment(b.graph.nodes)), ("city_property_counts", city.score.property_counts)])
def test_properties_without_appearances(spark, name, general):
    got = star.queries()[name](spark, FOLDER)
    assert not any("supplier" in f for f in got.inputFiles())
    want = general(city.described(spark, FOLDER, city.HOLDERS)).select(*got.columns)
    if "expected" in got.columns:
        want = want.where("expected > 0 or actual > 0 or channel = 'generic_attributes'")
    assert sorted(got.collect()) == sorted(want.collect()) and not got.isEmpty()
