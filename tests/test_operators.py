import math
import random

from pyspark.sql import functions as F

from plinth import cli
from plinth.functions import boxes, scalar
from plinth.functions.boxes import Thresholds
from plinth.operators import graph, spatial, summary
from plinth.sources import config


def one(spark, column):
    return spark.range(1).select(column.alias("c")).head().c


def test_numbers(spark):
    parse = lambda t: tuple(one(spark, scalar.parse_numeric(F.lit(t))))
    assert parse(" 12 ") == (12, None, None) and parse("1_000") == (1000, None, None)
    assert parse("1.5") == (None, 1.5, None) and parse("1.5f") == (None, None, "1.5f") and parse("x y") == (None, None, "x y")
    assert math.isnan(parse("nan")[1]) and parse("-inf")[1] == -math.inf


def test_positions(spark):
    pos = lambda t: one(spark, scalar.parse_pos(F.lit(t)))
    assert pos("1") == [1.0, 0.0, 0.0] and pos("1 2") == [1.0, 2.0, 0.0] and pos("1 2 3 4") == [1.0, 2.0, 3.0]
    assert pos("1 x") is None and pos("") is None
    lists = lambda t, d: one(spark, scalar.parse_pos_list(F.lit(t), F.lit(d)))
    assert lists("1 2 3 4", "2") == [[1, 2, 0], [3, 4, 0]] and lists("1 2 3", "2") == [[1, 2, 3]]
    assert lists("1 2 3 4", None) == [[1, 2, 3]] and lists("1 2 3 4 5", None) == [[1, 2, 3], [4, 5, 0]] and lists("1 b 3", None) == [] and lists("1 2 3 4", "x") == [[1, 2, 3]]


def test_texts(spark):
    key = lambda t: one(spark, scalar.sanitize_key(F.lit(t)))
    assert key("  Ground  area (m2) ") == "ground_area_m2" and key("__") == "unnamed" and key("é") == "unnamed"
    assert one(spark, scalar.target_refs(F.lit("a#b #c  d # "))) == ["b", "c", "d"]
    assert one(spark, scalar.safe_label(F.lit("3d-x"))) == "N_3d_x" and one(spark, scalar.safe_label(F.lit(""))) == "UnknownType"
    assert one(spark, scalar.local_name(F.lit("{ns}a"))) == "a" and one(spark, scalar.resolve_xlink(F.lit("##a"))) == "a"
    assert one(spark, scalar.furniture_errors(F.lit(False), F.lit(""), F.lit("r"))) == ["geometry", "gml_id"]
    assert one(spark, scalar.read_path(F.lit('{"a": {"b": 2}}'), "a.b")) == 2.0 and one(spark, scalar.read_path(F.lit("{"), "a")) == 0.0


def test_precedence(spark):
    rows = [("a", "b", "TOUCHES", 0), ("a", "b", "ADJACENT_TO", 1), ("a", "b", "INTERSECTS", 2), ("b", "a", "TOUCHES", 3), ("a", "r", "INSIDE", 4), ("a", "r", "INSIDE", 5)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, relation string, ord int")
    got = sorted((r.source_id, r.target_id, r.relation) for r in spatial.strongest(edges, ["source_id"]).collect())
    assert got == [("a", "b", "INTERSECTS"), ("a", "r", "INSIDE"), ("a", "r", "INSIDE"), ("b", "a", "TOUCHES")]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "source_id string, target_id string")
    got = sorted(map(tuple, graph.closure(edges, spark.createDataFrame([("a",), ("x",), ("z",)], "start string")).collect()))
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")]


def test_edges_are_judged(spark):
    nodes = spark.createDataFrame([("d", "f", "BuildingFurniture"), ("d", "r", "Room")], "doc_id string, id string, node_type string")
    edges = spark.createDataFrame([("d", "f", "r", "INSIDE", 1), ("d", "f", "r", "INSIDE", 0), ("d", "r", "f", "INSIDE", 2), ("d", "f", "q", "INSIDE", 3)], "doc_id string, source_id string, target_id string, relation string, ord int")
    kept, rejected = graph.add_edges(edges, nodes)
    assert [(r.source_id, r.ord) for r in kept.collect()] == [("f", 0)]
    assert sorted(r.reason for r in rejected.collect()) == ["illegal triple", "missing target"]
    assert sorted(r.problem for r in graph.validate(nodes, edges).collect()) == ["missing target", "repeated edge"]


def test_pairs_like_brute_force(spark):
    rng = random.Random(3)
    t = Thresholds(adjacent=1.5)
    rows = []
    for i in range(150):
        low = [rng.uniform(-9, 9) for _ in range(3)]
        rows.append((f"o{i}", i % 3, *[v for a in low for v in (a, a + rng.choice([0.0, 0.5, 3.0, 3.0, 40.0]))]))
    df = spark.createDataFrame(rows, "id string, room int, " + ", ".join(f"{c} double" for c in spatial.BOX))
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[1] == b[1]:
                over = [min(a[3 + 2 * k], b[3 + 2 * k]) - max(a[2 + 2 * k], b[2 + 2 * k]) for k in range(3)]
                d = math.sqrt(sum(max(-o, 0) ** 2 for o in over))
                rel = "INTERSECTS" if min(over) > t.intersection else "TOUCHES" if d <= t.touch else "ADJACENT_TO" if d <= t.adjacent else None
                if rel:
                    want[a[0], b[0]] = rel
    for pairs in (spatial.pairs(df, ["room"]), spatial.near_pairs(df, ["room"], t.adjacent, 2.0)):
        found = spatial.infer(pairs, t).where("relation is not null").collect()
        assert len(found) == len(want) and {(r.a_id, r.b_id): r.relation for r in found} == want
    # with a seed on one side
    seed = F.col("id").rlike("[05]$")
    some = {k: v for k, v in want.items() if any(x[-1] in "05" for x in k)}
    for pairs in (spatial.seeded_pairs(df, ["room"], seed), spatial.near_pairs(df, ["room"], t.adjacent, 2.0, seed)):
        found = spatial.infer(pairs, t).where("relation is not null").collect()
        assert len(found) == len(some) and {(r.a_id, r.b_id): r.relation for r in found} == some
    # far objects are no candidates of the grid
    assert spatial.near_pairs(df.where("id in ('o0', 'o3')").withColumn("min_x", F.when(F.col("id") == "o0", 1e6).otherwise(F.col("min_x"))).withColumn("max_x", F.greatest("min_x", "max_x")), ["room"], 1.0, 2.0).count() == 0


def test_a_wide_box_covers_few_cells(spark):
    rows = [("wide", 0, -1e9, 1e9, 0.0, 0.1, 0.0, 1.0)] + [(f"o{k}", 0, float(k), k + 0.5, 0.0, 0.2, 0.0, 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "id string, room int, " + ", ".join(f"{c} double" for c in spatial.BOX))
    found = spatial.near_pairs(df, ["room"], 0.1, 1.0).collect()
    assert len([r for r in found if r.a_id == "wide"]) == 50 and len({(r.a_id, r.b_id) for r in found}) == len(found) < 300


def test_last_and_first_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, ord int, v string")
    assert sorted((r.id, r.v, r.first_ord) for r in graph.last_wins(rows, ["id"], ["ord"]).collect()) == [("a", "y", 1), ("b", "z", 3)]
    assert sorted((r.id, r.v) for r in graph.first_wins(rows, ["id"], ["ord"]).collect()) == [("a", "x"), ("b", "z")]


def test_profile_and_check(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r.avg, r.std) for r in summary.profile(rows, ["k"], "v").collect()}
    assert got == {"a": (2, 2.0, 1.0), "b": (0, 0.0, 0.0)}
    assert cli.stats([1.0, 3.0]) == {"avg": 2.0, "min": 1.0, "max": 3.0, "std": 1.0} and cli.stats([])["avg"] == 0.0
    lines = cli.check({"a.b": {"min": 1}, "c": {"equals": 2}, "d": {"max": 5}}, {"a": {"b": 1}, "c": 3})
    assert [ok for ok, _ in lines] == [True, False, True]


def test_boxes_helpers(spark):
    assert one(spark, boxes.pair_family(F.lit("Opening"), F.lit("Hatch"), F.lit("BuildingFurniture"), F.lit(""))) is None
    assert one(spark, scalar.safe_ratio(F.lit(3), F.lit(0))) == 1.0 and one(spark, scalar.safe_ratio(F.lit(3), F.lit(2))) == 1.0


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("project: {name: x, citygml_version: '9'}\nspatial: {touch_epsilon: oops}\n")
    c = config.load(str(path))
    assert (c.name, c.version, c.thresholds) == ("x", "2.0", Thresholds())


def test_furniture_and_dispatch(spark):
    from plinth.operators import construct

    raw = F.create_map(*[F.lit(x) for x in ("gml_id", "f1", "class", " seat ", "function", "sit, rest,", "gml_name", "")])
    piece = spark.range(1).select(scalar.furniture_of(raw).alias("p")).select("p", scalar.furniture_properties(F.col("p")).alias("m")).head()
    assert piece.p.gml_id == "f1" and piece.p["class"] == "seat" and piece.p.function == ["sit", "rest"] and piece.p.usage == [] and piece.p.gml_name is None and not piece.p.has_geometry
    assert piece.m == {"gml_id": "f1", "class": "seat", "function": '["sit","rest"]'}
    rows = spark.createDataFrame([("Door",), ("Room",), ("other",)], "tag string").select("tag", construct.dispatch(F.col("tag"), {"Opening": F.lower("tag")}).alias("d"))
    assert {r.tag: tuple(r.d) for r in rows.collect()} == {"Door": ("handled", "door"), "Room": ("unhandled", None), "other": ("unhandled", None)}
    assert one(spark, scalar.bar(F.lit(3), F.lit(0), 4)) == "----" and one(spark, scalar.bar(F.lit(3.0), F.lit(4.0), 4)) == "###-"
