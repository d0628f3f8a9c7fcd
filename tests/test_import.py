import json

import pytest

from plinth.operators import construct, graph, schema, score
from plinth.plans import importer
from plinth.sources.citygml import read_elements, register
from plinth.sources.store import GraphStore
from tests import fixtures


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gml")
    for name in ("INDOOR", "SPATIAL", "MIXED"):
        (folder / f"{name}.gml").write_text(getattr(fixtures, name), encoding="utf-8")
    elements = graph.cut(read_elements(spark, f"{folder}/*.gml"))
    found = construct.build(elements)
    found.folder = folder
    return found


def of(df, name):
    return df.where(f"doc_id like '%{name}.gml'")


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def props(built, name, node_id):
    return {k: json.loads(v) for k, v in of(built.graph.nodes, name).where(f"id = '{node_id}'").head().props.items()}


def test_triples():
    assert len(schema.TRIPLES) == 123


def test_elements_are_in_document_order(spark, built):
    rows = of(built.elements, "INDOOR").orderBy("eid").collect()
    assert [r.eid for r in rows] == list(range(len(rows)))
    window = next(r for r in rows if r.tag == "Window")
    assert [a.tag for a in window.anc] == ["CityModel", "cityObjectMember", "Building", "interiorRoom", "Room", "boundedBy", "RoofSurface", "opening"]
    assert window.parent_eid == window.anc[-1].eid and rows[0].end_eid == len(rows) - 1


def test_data_source_reads_the_same(spark, built):
    register(spark)
    rows = spark.read.format("citygml").option("files", f"{built.folder}/INDOOR.gml").load()
    assert rows.count() == of(built.elements, "INDOOR").count()


def test_indoor_document(built):
    assert of(built.graph.nodes, "INDOOR").count() == 10  # eight objects, two surface types
    once = ["HAS_CITY_OBJECT", "INTERIOR_ROOM", "HAS_OPENING", "CONNECTS"]
    twice = ["BOUNDED_BY", "HAS_SURFACE_TYPE", "INSIDE", "INTERIOR_FURNITURE"]
    assert counts(of(built.graph.edges, "INDOOR"), "relation") == dict.fromkeys(once, 1) | dict.fromkeys(twice, 2)
    got = props(built, "INDOOR", "loom")
    assert (got["class"], got["function"], got["usage"], got["class_code"]) == ("machine", ["weave", "spin"], ["cloth"], "machine")


def test_spatial_document(built):
    n = len(fixtures.WORKSHOP)
    # member, building, room, a surface type; a polygon, a ring and four positions an object
    assert of(built.graph.nodes, "SPATIAL").count() == n + 4 + 6 * n
    want = fixtures.workshop_relations()
    edges = of(built.graph.edges, "SPATIAL")
    assert {(r.source_id, r.target_id): r.relation for r in edges.where(edges.relation.isin(*schema.SPATIAL)).collect()} == want
    assert set(want.values()) == set(schema.SPATIAL) and not any("cart" in pair for pair in want)
    kind = {k: v[0] for k, v in fixtures.WORKSHOP.items()}
    number = lambda relation, targets: sum(r == relation and kind[a] == "BuildingFurniture" and kind[b] in targets for (a, b), r in want.items())
    opening = ("Door", "Window")
    touching = {a for (a, b), r in want.items() if r == "TOUCHES" and kind[a] == "BuildingFurniture" and kind[b] in opening}
    suite = importer.count_suite(type(built.graph)(of(built.graph.nodes, "SPATIAL"), edges))
    assert list(suite.values()) == [number("INTERSECTS", ("BuildingFurniture",)) // 2, number("TOUCHES", opening), number("ADJACENT_TO", ("WallSurface",)), 2, len(touching)]
    assert min(suite["q1_furniture_furniture_intersects"], suite["q2_furniture_opening_touches"]) > 0


def test_mixed_document(built):
    got = props(built, "MIXED", "building_1")
    assert got["gml_name"] == "Mill" and got["gml_name_all"] == ["Mill", "Old mill"] and got["lod"] == "LoD2solid"
    assert got["attr_floor_space"] == 73.25 and got["attr_floor_space_uom"] == "m2" and got["attr_levels"] == "three"
    assert got["year_of_construction"] == 1890 and got["measured_height"] == 11.4 and got["measured_height_uom"] == "m"
    assert props(built, "MIXED", "address_1")["address_locality"] == "Ghent"
    implicit = props(built, "MIXED", "implicit_geometry:implicitgeometry_1")
    assert implicit["transformation_matrix"] == "1 0 0 1" and implicit["relative_geometry_href"] == "#S" and implicit["reference_point"] == [5.0, 6.0, 7.0] and implicit["lod"] == "LoD1"
    ids = {r.id for r in of(built.graph.nodes, "MIXED").collect()}
    assert {"ring:P_ring_0", "ring:P_ring_1", "pos:P_ring_0:3", "solid:S", "geometry:solid:S"} <= ids and "pos:P_ring_0:4" not in ids
    assert props(built, "MIXED", "pos:P_ring_0:1")["coordinates"] == [1.0, 0.0, 0.0]
    material = props(built, "MIXED", "surface_data:surfacedata_1")
    assert material["is_front"] is True and material["diffuse_color"] == [0.5, 0.5, 1.0] and material["target_count"] == 3 and material["unmatched_targets"] == ["gone"]
    assert props(built, "MIXED", "appearance:appearance_1")["owner_resolution"] == "fallback:CityObjectMember"
    edges = {(r.source_id, r.relation, r.target_id) for r in of(built.graph.edges, "MIXED").collect()}
    assert ("surface_data:surfacedata_1", "APPLIES_TO", "polygon:P") in edges and ("building_1", "CONSISTS_OF_BUILDING_PART", "part") in edges
    assert ("building_1", "CONTAINS", "part") not in edges and ("solid:S", "HAS_GEOMETRY_MEMBER", "polygon:P") in edges
    # a part may not be a target of a material: judged, not dropped in silence
    assert of(built.rejected, "MIXED").where("relation = 'APPLIES_TO' and target_id = 'part'").count() == 1


def test_scorecard(built):
    cards = {r.doc_id.rsplit("/", 1)[1]: r for r in score.scorecard(built).collect()}
    assert cards["INDOOR.gml"].overall == 100.0 and cards["INDOOR.gml"].spatial_coverage == 100.0
    card = cards["SPATIAL.gml"]
    # five pieces of furniture, two walls, two openings: both ways
    expected, inferred = 5 * 2 * 2 + 5 * 2 * 2 + 5 * 4, len(fixtures.workshop_relations())
    assert (card.expected, card.inferred, card.spatial_coverage, card.spatial_sanity) == (expected, inferred, round(100 * inferred / expected, 2), 100.0)
    assert cards["MIXED.gml"].node_score == 100.0


def test_breakdown_and_coverage(built):
    rows = {r.root.rsplit("/", 1)[1]: r for r in score.building_breakdown(built).collect()}
    assert rows["INDOOR.gml\x1fmill"].BuildingFurniture == 2 and rows["SPATIAL.gml\x1fyard"].Opening == 2
    assert [r.coverage for r in score.appearance_coverage(built).collect()] == [100.0]


def test_run_and_store(spark, built, tmp_path):
    status, summary = importer.run_import(spark, f"{built.folder}/INDOOR.gml", f"{tmp_path}/out", store=f"{tmp_path}/store")
    assert status == 0 and summary["node_count"] == 10 and summary["edge_count"] == 12 and "overall 100.00" in importer.report(summary)
    assert all(title in importer.report(summary) for title in ("Property enrichment", "Appearance coverage", "Geometry density", "Building breakdown", "Checklist", "Timeline"))
    assert summary["appearance_coverage"][0]["coverage"] == 100.0 and summary["property_enrichment"][0]["nodes"] == 8 and summary["criteria"] and summary["spatial_pair_stats"] == []
    assert spark.read.json(f"{tmp_path}/out/scorecard").count() == 1 and spark.read.json(f"{tmp_path}/out/building_breakdown").count() == 1
    store = GraphStore(spark, f"{tmp_path}/store")
    again = store.save(store.load())
    assert again == {"node_count": 10, "edge_count": 12}
    assert importer.run_import(spark, f"{tmp_path}/absent.gml", f"{tmp_path}/out")[0] == 2


def test_pair_families(built):
    rows = {r.family: r for r in score.pair_stats(built).collect()}
    kind = {k: v[0] for k, v in fixtures.WORKSHOP.items()}
    want = {}
    for (a, b), r in fixtures.workshop_relations().items():
        other = [kind[x] for x in (a, b) if kind[x] != "BuildingFurniture"]
        family = "furniture_furniture" if not other else "furniture_boundary_surface" if other[0] == "WallSurface" else "furniture_opening"
        want.setdefault(family, []).append(r)
    assert {k: r.inferred for k, r in rows.items()} == {k: len(v) for k, v in want.items()}
    assert {k: r.TOUCHES for k, r in rows.items()} == {k: v.count("TOUCHES") for k, v in want.items()}


def test_without_relations(built):
    plain = construct.build(of(built.elements, "SPATIAL"), relations=False)
    assert plain.graph.edges.where(plain.graph.edges.relation.isin(*schema.SPATIAL)).count() == 0 and plain.graph.nodes.count() == of(built.graph.nodes, "SPATIAL").count()


def test_stored_graphs_on_the_command_line(spark, built, tmp_path, capsys):
    from plinth import cli

    GraphStore(spark, f"{tmp_path}/store").save(type(built.graph)(of(built.graph.nodes, "INDOOR"), of(built.graph.edges, "INDOOR")))
    assert cli.main(["relations", "--store", f"{tmp_path}/store", "--relation", "INSIDE"]) == 0 and "INSIDE BuildingFurniture -> Room: 2" in capsys.readouterr().out
    assert cli.main(["export", "--store", f"{tmp_path}/store", "--output", f"{tmp_path}/out", "--format", "parquet"]) == 0 and spark.read.parquet(f"{tmp_path}/out/nodes").count() == 10
    assert cli.main(["export", "--store", f"{tmp_path}/none", "--output", f"{tmp_path}/out"]) == 2
