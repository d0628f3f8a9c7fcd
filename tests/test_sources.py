import json

from pyspark.sql import functions as F

from plinth import cli
from plinth.operators.graph import SceneGraph
from plinth.plans import importer
from plinth.sources.cityjson import geometry, read_cityjson
from plinth.sources.store import GraphStore, chunks, merge_properties, repeated_ids
from plinth.streaming.ingest import ingest
from tests import fixtures


def test_cityjson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"CityObjects": {"b": {"type": "Building", "geometry": [{"type": "Solid"}]}, "c": {}}}))
    doc = read_cityjson(spark, f"{tmp_path}/a.json")
    pick = lambda k: geometry(F.try_variant_get("document", f"$.CityObjects.{k}", "variant"))
    row = doc.select(pick("b").alias("b"), pick("c").alias("c")).select("b.type", F.to_json("b.geometry").alias("g"), F.col("c.type").alias("c")).head()
    assert (row.type, json.loads(row.g), row.c) == ("Building", [{"type": "Solid"}], "Unknown")


def test_merge_and_chunks(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, x string, y double")
    new = spark.createDataFrame([(2, None, 3.0, "z"), (3, "c", None, "w")], "id int, x string, y double, v string")
    got = sorted(map(tuple, merge_properties(old, new, ["id"]).select("id", "x", "y", "v").collect()))
    assert got == [(1, "a", 1.0, None), (2, "b", 3.0, "z"), (3, "c", None, "w")]
    rows = spark.createDataFrame([("l", i) for i in range(5)], "label string, i int")
    assert [r.batch for r in chunks(rows, ["label"], ["i"], 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert {r.batch for r in chunks(rows, ["label"], ["i"], 0).collect()} == {0}


def test_maps_merge_entry_by_entry(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, id string, node_type string, props map<string,string>")
    old = rows(("d", "a", "Room", {"x": "1", "y": "2"}), ("d", "b", "Room", None), ("d", "c", "Room", {"z": "1"}))
    new = rows(("d", "a", "Room", {"y": "3", "x": None, "w": "4"}), ("d", "b", "Room", {"q": "5"}), ("d", "e", None, {}))
    got = {r.id: (r.node_type, r.props) for r in merge_properties(old, new, ["doc_id", "id"]).collect()}
    assert got == {"a": ("Room", {"x": "1", "y": "3", "w": "4"}), "b": ("Room", {"q": "5"}), "c": ("Room", {"z": "1"}), "e": (None, {})}


def test_store_of_documents(spark, tmp_path):
    """No edges at first; other documents' buckets stay where they are; old versions go."""
    store = GraphStore(spark, f"{tmp_path}/store", buckets=4)
    nodes = lambda *r: spark.createDataFrame(list(r), "doc_id string, id string, node_type string, ord long, gml_id string, props map<string,string>")
    edges = lambda *r: spark.createDataFrame(list(r), "doc_id string, source_id string, target_id string, relation string, ord long, props map<string,string>")
    docs = [f"d{k}" for k in range(12)]
    first = SceneGraph(nodes(*[(d, "a", "Room", 0, None, {"x": "1", "y": "2"}) for d in docs]), edges())
    for _ in range(2):
        assert store.save(first) == {"node_count": 12, "edge_count": 0}
    before = store._manifest()["buckets"]
    second = SceneGraph(nodes(("d0", "a", "Room", 0, None, {"y": "3"}), ("d0", "b", "Opening", 1, None, {})), edges(("d0", "b", "a", "CONNECTS", 0, None), ("d0", "b", "gone", "CONNECTS", 1, None)))
    assert store.save(second) == {"node_count": 13, "edge_count": 1}
    after = store._manifest()["buckets"]
    assert sum(after[b] != before[b] for b in before) == 1 and len(before) > 1
    assert store.load().nodes.where("doc_id = 'd0' and id = 'a'").head().props == {"x": "1", "y": "3"}
    store.save(second)
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v-")]) <= 3 and store.load().nodes.count() == 13


def test_a_label_of_most_rows_is_spread(spark):
    rows = spark.createDataFrame([("l" if i % 10 else None, i) for i in range(500)], "label string, i int")
    got = {r.i: (r.label, r.batch) for r in chunks(rows, ["label"], ["i"], 7, ranges=9).collect()}
    big, small = [i for i in range(500) if i % 10], [i for i in range(500) if not i % 10]
    assert got == {i: ("l", k // 7) for k, i in enumerate(big)} | {i: (None, k // 7) for k, i in enumerate(small)}


def test_stream_into_a_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gml").write_text(fixtures.INDOOR, encoding="utf-8")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/progress").awaitTermination()
    g = GraphStore(spark, f"{tmp_path}/store").load()
    assert g.nodes.count() == 10 and g.edges.count() == 12 and repeated_ids(g.nodes).count() == 0
    assert importer.count_one(g, "q4_opening_connects_room") == 1
    assert cli.main(["benchmark", "--store", f"{tmp_path}/store", "--repeat", "1", "--warmup", "0", "--output", f"{tmp_path}/b.json"]) == 0
    assert json.loads((tmp_path / "b.json").read_text())["queries"]["q4_opening_connects_room"]["count"] == 1
    assert cli.main(["benchmark", "--store", f"{tmp_path}/none"]) == 2 and cli.main(["benchmark", "--store", f"{tmp_path}/store", "--repeat", "0"]) == 2
