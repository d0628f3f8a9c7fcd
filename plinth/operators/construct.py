"""From element tables to a property graph.

Node properties are a map from key to JSON text, so that numbers, texts and lists
keep their kinds.  ``ord`` is the place at which a node or edge enters: a stage,
then the element, then a number within it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import boxes, scalar
from plinth.functions.boxes import Thresholds

from . import graph, schema, spatial, tree

HREF = "{http://www.w3.org/1999/xlink}href"
OWNER_TAGS = [t for t, kind in schema.TAG_TYPES.items() if kind != "Address"]
CONTAINERS = ["Solid", "MultiSurface", "MultiCurve"]
NODE = ["doc_id", "id", "node_type", "ord", "gml_id", "props"]
EDGE = ["doc_id", "source_id", "target_id", "relation", "ord", "props"]
_NO_PROPS = "map<string,string>"


def js(text: Column) -> Column:
    """A text as JSON; null stays null."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def js_number(text: Column) -> Column:
    v = scalar.parse_numeric(text)
    return F.when(text.isNotNull(), F.coalesce(v["v_int"].cast("string"), v["v_dbl"].cast("string"), js(v["v_str"])))


def props(pairs: dict[str, Column]) -> Column:
    """A map of the entries that are not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def place(stage: int, eid: Column, sub: Column | int = 0) -> Column:
    return F.lit(stage << 56) + F.shiftleft(eid.cast("long"), 24) + (sub if isinstance(sub, Column) else F.lit(sub)).cast("long")


def kind_of(tag: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in schema.TAG_TYPES.items() for x in kv])[tag]


def dispatch(tag: Column, handlers: dict[str, Column]) -> Column:
    """struct(status, result): what the handler of a tag's node type makes of a row, or ``unhandled``."""
    kind = kind_of(tag)
    result = F.coalesce(*[F.when(kind == k, v.cast("string")) for k, v in handlers.items()], F.lit(None).cast("string"))
    return F.struct(F.when(kind.isin(*handlers), F.lit("handled")).otherwise(F.lit("unhandled")).alias("status"), result.alias("result"))


class Children:
    """Column functions on an array of child structs (eid, tag, text, attrs) in document order."""

    def __init__(self, column: Column):
        self.column = F.coalesce(column, F.array().cast("array<struct<eid:long,tag:string,text:string,attrs:map<string,string>>>"))

    def named(self, name: str, exact: bool = False) -> Column:
        return F.filter(self.column, lambda c: (c["tag"] == name) if exact else (F.lower(c["tag"]) == name.lower()))

    def texts(self, name: str, exact: bool = False) -> Column:
        return F.filter(F.transform(self.named(name, exact), lambda c: scalar.strip(c["text"])), lambda t: t.isNotNull() & (t != ""))

    def text(self, name: str, exact: bool = False) -> Column:
        return F.get(self.texts(name, exact), F.lit(0))

    def attribute(self, name: str, attr: str) -> Column:
        return scalar.filled(F.get(self.named(name), F.lit(0))["attrs"][attr])


#: Children whose texts, first text and attributes are looked up.
_COMMON = ["name", "description", "creationDate", "relativeToTerrain", "class", "function", "usage", "roofType", "yearOfConstruction", "storeysAboveGround", "storeysBelowGround", "measuredHeight"]
_DATA = ["isFront", "diffuseColor", "specularColor", "emissiveColor", "ambientIntensity", "shininess", "transparency", "imageURI"]


def _staged(c: Children, names: list[str], exact: bool = False) -> list[Column]:
    """Columns with what is looked up among the children, so that later expressions stay small."""
    first = lambda n: F.get(c.named(n, exact), F.lit(0))
    return [col for n in names for col in (c.texts(n, exact).alias(f"t_{n}"), scalar.filled(scalar.strip(first(n)["text"])).alias(f"f_{n}"), first(n)["attrs"].alias(f"a_{n}"))]


class _Staged:
    """Children's interface over the columns of _staged."""

    def texts(self, name: str) -> Column:
        return F.col(f"t_{name}")

    def text(self, name: str, exact: bool = False) -> Column:
        return F.get(self.texts(name), F.lit(0))

    def first(self, name: str) -> Column:
        return F.col(f"f_{name}")

    def attribute(self, name: str, attr: str) -> Column:
        return scalar.filled(F.col(f"a_{name}")[attr])


def held() -> Column:
    """The number of positions in the text of a pos or posList, 0 for others."""
    text = F.col("text")
    size = F.when(F.col("tag") == "pos", F.when(scalar.parse_pos(text).isNotNull(), 1).otherwise(0)).when(F.col("tag") == "posList", scalar.pos_list_size(text, F.col("attrs")["srsDimension"]))
    return size.otherwise(0).cast("long")


def with_children(elements: DataFrame, of: DataFrame) -> DataFrame:
    """of (doc_id, eid, ...) with its children as an array."""
    child = F.struct("eid", "tag", "text", "attrs")
    grouped = elements.where("parent_eid is not null").select("doc_id", F.col("parent_eid").alias("eid"), child.alias("c"))
    # a map cannot be compared, so the order comes from the element number alone
    grouped = grouped.join(of.select("doc_id", "eid"), ["doc_id", "eid"], "left_semi").groupBy("doc_id", "eid").agg(F.collect_list("c").alias("children"))
    by_eid = lambda a, b: F.when(a["eid"] < b["eid"], -1).when(a["eid"] > b["eid"], 1).otherwise(0)
    return of.join(grouped.withColumn("children", F.array_sort("children", by_eid)), ["doc_id", "eid"], "left")


def records(elements: DataFrame, named: bool = False) -> DataFrame:
    """Semantic elements with node_type and id; named: the source gives each an id, so none is counted (and a missing one is an error)."""
    rows = elements.where(F.col("tag").isin(*schema.TAG_TYPES)).withColumn("node_type", kind_of(F.col("tag"))).withColumn("given", scalar.gml_id(F.col("attrs")))
    if named:
        return rows.withColumn("id", F.when(F.trim("given") != "", F.col("given")).otherwise(F.raise_error(F.lit("an element without an id in a source that names all"))))
    return graph.fallback_ids(rows, "node_type", ["eid"], "given", ["doc_id"])


def generic_attributes(elements: DataFrame, of: DataFrame) -> DataFrame:
    """doc_id, eid, generic: the attr_ entries of each record; the last of a name wins."""
    attrs = elements.where(F.col("tag").isin(*schema.GENERIC_TAGS)).select("doc_id", F.col("parent_eid").alias("owner_eid"), "eid", F.col("tag").alias("kind"), scalar.filled(F.col("attrs")["name"]).alias("name"))
    values = elements.where(F.lower("tag") == "value").select("doc_id", F.col("parent_eid").alias("eid"), F.col("eid").alias("value_eid"), "text", F.col("attrs")["uom"].alias("uom"))
    first = values.groupBy("doc_id", "eid").agg(F.min_by(F.struct("text", "uom"), "value_eid").alias("v"))
    found = attrs.where("name is not null").join(first, ["doc_id", "eid"]).withColumn("raw", scalar.filled(scalar.strip(F.col("v.text")))).where("raw is not null")
    key = F.concat(F.lit("attr_"), scalar.sanitize_key(F.col("name")))
    value = F.when(F.col("kind").isin("intAttribute", "doubleAttribute", "measureAttribute"), js_number(F.col("raw"))).otherwise(js(F.col("raw")))
    rows = found.select("doc_id", "owner_eid", "eid", key.alias("key"), value.alias("value"), F.lit(0).alias("sub"))
    unit = F.when(F.col("kind") == "measureAttribute", scalar.filled(F.col("v.uom")))
    units = found.withColumn("unit", unit).where("unit is not null").select("doc_id", "owner_eid", "eid", F.concat(key, F.lit("_uom")).alias("key"), js(F.col("unit")).alias("value"), F.lit(1).alias("sub"))
    last = rows.unionByName(units).groupBy("doc_id", "owner_eid", "key").agg(F.max_by("value", F.struct("eid", "sub")).alias("value"))
    return last.groupBy("doc_id", F.col("owner_eid").alias("eid")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("generic"))


def semantic_nodes(elements: DataFrame, recs: DataFrame) -> DataFrame:
    rows = with_children(elements, recs)
    lod_up = F.filter(F.concat("anc", F.array(F.struct(F.col("eid"), F.col("tag")))), lambda a: a["tag"].isin(*schema.TAG_TYPES))
    lods = elements.where("lower(tag) like 'lod%'").select("doc_id", F.col("tag").alias("lod_tag"), F.col("eid").alias("lod_eid"), F.explode(lod_up).alias("up"))
    lods = lods.groupBy("doc_id", F.col("up.eid").alias("eid")).agg(F.replace(F.lower(F.min_by("lod_tag", "lod_eid")), F.lit("lod"), F.lit("LoD")).alias("lod"))
    address = {"LocalityName": "locality", "ThoroughfareName": "street_name", "ThoroughfareNumber": "street_number", "PostalCodeNumber": "postal_code"}
    places = tree.first_text(elements, recs.where("node_type = 'Address'"), address)
    rows = rows.join(lods, ["doc_id", "eid"], "left").join(places, ["doc_id", "eid"], "left").join(generic_attributes(elements, recs), ["doc_id", "eid"], "left")
    rows, c, kind = rows.select("*", *_staged(Children(F.col("children")), _COMMON)), _Staged(), F.col("node_type")
    common = kind != "Address"
    many = lambda name: F.when(common & (F.size(c.texts(name)) > 1), F.to_json(c.texts(name)))
    if_ = lambda test, value: F.when(test, value)
    pairs: dict[str, Column] = {
        "gml_id": js(F.col("id")), "source_tag": js(F.col("tag")), "object_type": js(kind), "lod": if_(common, js(F.col("lod"))),
        "gml_name": if_(common, js(c.text("name"))), "gml_name_all": if_(common & (F.size(c.texts("name")) > 0), F.to_json(c.texts("name"))),
        "gml_description": if_(common, js(c.text("description"))), "creation_date": if_(common, js(c.text("creationDate"))), "relative_to_terrain": if_(common, js(c.text("relativeToTerrain"))),
    }
    for key, name in (("class", "class"), ("function", "function"), ("usage", "usage"), ("roof_type", "roofType")):
        pairs |= {f"{key}_code": if_(common, js(c.text(name))), f"{key}_code_all": many(name), f"{key}_code_space": if_(common, js(c.attribute(name, "codeSpace")))}
    for key, name in (("year_of_construction", "yearOfConstruction"), ("storeys_above_ground", "storeysAboveGround"), ("storeys_below_ground", "storeysBelowGround")):
        pairs[key] = if_(common, js_number(c.text(name)))
    pairs |= {"measured_height": if_(common, js_number(c.first("measuredHeight"))), "measured_height_uom": if_(common, js(c.attribute("measuredHeight", "uom")))}
    furniture = kind == "BuildingFurniture"
    pairs |= {"class": if_(furniture, js(c.text("class"))), "function": if_(furniture, F.to_json(c.texts("function"))), "usage": if_(furniture, F.to_json(c.texts("usage")))}
    pairs |= {k: if_(kind == t, js(F.col("tag"))) for k, t in (("surface_type", "BoundarySurface"), ("opening_type", "Opening"))}
    pairs["installation_type"] = if_(kind.isin("BuildingInstallation", "IntBuildingInstallation"), js(F.col("tag")))
    pairs |= {f"address_{k}": if_(~common, js(F.col(k))) for k in address.values()}
    generic = F.coalesce(F.when(common, F.col("generic")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    # a generic entry may have the name of another: it wins
    rows = rows.withColumn("own", props(pairs)).withColumn("generic", generic)
    merged = F.map_concat(F.map_filter("own", lambda k, _: ~F.map_contains_key(F.col("generic"), k)), F.col("generic"))
    return rows.select("doc_id", "id", "node_type", place(1, F.col("eid")).alias("ord"), F.col("id").alias("gml_id"), merged.alias("props"))


def _owner(rows: DataFrame, recs: DataFrame, tags: list[str], out: str = "owner_id", how: str = "inner") -> DataFrame:
    """rows with the id of their nearest ancestor record with one of the tags."""
    near = rows.withColumn("owner_eid", tree.nearest(F.col("anc"), tags)["eid"])
    ids = recs.select("doc_id", F.col("eid").alias("owner_eid"), F.col("id").alias(out))
    return near.join(ids, ["doc_id", "owner_eid"], how).drop("owner_eid")


def _edge(rows: DataFrame, source: Column, target: Column, relation: Column | str, ord_: Column, properties: Column | None = None) -> DataFrame:
    rel = F.lit(relation) if isinstance(relation, str) else relation
    return rows.select("doc_id", source.alias("source_id"), target.alias("target_id"), rel.alias("relation"), ord_.alias("ord"), (F.lit(None).cast(_NO_PROPS) if properties is None else properties).alias("props"))


def owners(recs: DataFrame) -> DataFrame:
    """recs by the rule table with ``rule``: for each child the nearest ancestor of the rule's types (eid and tag), tested on the parent's tag."""
    parent = tree.direct_parent_tag(F.col("anc"))
    tags_of = lambda kinds: [t for t, k in schema.TAG_TYPES.items() if k in kinds]
    rules: list[Column] = []
    up = lambda kinds: [tree.nearest(F.col("anc"), tags_of(kinds))[k].alias(f"owner_{k}") for k in ("eid", "tag")]
    member = lambda tag, kind, relation, n: F.when(parent == tag, F.struct(*up([kind]), F.lit(relation).alias("relation"), F.lit(False).alias("child_first"), F.lit(True).alias("no_self"), F.lit(n).alias("n")))
    rules += [F.when(F.col("node_type") != "CityObjectMember", member("cityObjectMember", "CityObjectMember", "HAS_CITY_OBJECT", 0)), member("groupMember", "CityObjectGroup", "HAS_GROUP_MEMBER", 1)]
    for n, (child, kinds, tag, relation, child_first) in enumerate(schema.EDGE_RULES, 2):
        test = F.col("node_type") == child
        if isinstance(tag, str):
            test = test & F.coalesce(parent == tag, F.lit(False))
        elif tag:
            test = test & ~F.coalesce(parent.isin(*tag), F.lit(False))
        rules.append(F.when(test, F.struct(*up(kinds), F.lit(relation).alias("relation"), F.lit(child_first).alias("child_first"), F.lit(False).alias("no_self"), F.lit(n).alias("n"))))
    return recs.withColumn("rule", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull()))).where("rule.owner_eid is not null")


def semantic_edges(recs: DataFrame) -> DataFrame:
    """The edges of owners, with the ids of their ends."""
    rows = owners(recs).select("doc_id", "id", "eid", "rule.*")
    rows = rows.join(recs.select("doc_id", F.col("eid").alias("owner_eid"), F.col("id").alias("owner_id")), ["doc_id", "owner_eid"]).where("not (no_self and id = owner_id)")
    source, target = (F.when(F.col("child_first"), F.col(a)).otherwise(F.col(b)) for a, b in (("id", "owner_id"), ("owner_id", "id")))
    return _edge(rows, source, target, F.col("relation"), place(2, F.col("eid"), F.col("n")))


def surface_types(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node a surface type, and an edge from every boundary surface."""
    rows = recs.where("node_type = 'BoundarySurface'").withColumn("kind", scalar.surface_type(F.col("tag")))
    target = scalar.type_node_id(F.col("kind"))
    kinds = rows.select("doc_id", "kind").distinct()
    nodes = kinds.select("doc_id", target.alias("id"), F.lit("BoundarySurfaceType").alias("node_type"), place(2, F.lit(0)).alias("ord"), F.lit(None).cast("string").alias("gml_id"), props({"surface_type": js(F.col("kind")), "source_tag": js(F.lit("BoundarySurfaceType"))}).alias("props"))
    return nodes, _edge(rows, F.col("id"), target, "HAS_SURFACE_TYPE", place(2, F.col("eid"), 60))


def _lod(rows: DataFrame) -> DataFrame:
    tag = tree.nearest_matching(F.concat("anc", F.array(F.struct(F.col("eid"), F.col("tag")))), r"(?i)^lod\d")["tag"]
    return rows.withColumn("lod_tag", tag).withColumn("lod", F.concat(F.lit("LoD"), F.regexp_extract("lod_tag", r"(?i)^lod(\d)", 1)))


@dataclass
class Geometry:
    nodes: DataFrame
    edges: DataFrame
    rings: DataFrame  # doc_id, id, ord, positions


def polygons(pick: Callable[[list[str]], DataFrame], recs: DataFrame) -> DataFrame:
    """Polygons with the object they belong to, raw_id and polygon_id; pick: from tags to their elements."""
    rows = _owner(pick(["Polygon"]).withColumn("given", scalar.gml_id(F.col("attrs"))), recs, OWNER_TAGS)
    return graph.fallback_ids(rows, "tag", ["eid"], "given", ["doc_id"], "raw_id").withColumn("polygon_id", F.concat(F.lit("polygon:"), "raw_id"))


def polygon_nodes(rows: DataFrame) -> DataFrame:
    pairs = {"gml_id": js(F.col("raw_id")), "source_tag": js(F.lit("Polygon"))}
    return rows.select("doc_id", F.col("polygon_id").alias("id"), F.lit("Polygon").alias("node_type"), place(5, F.col("eid")).alias("ord"), F.col("raw_id").alias("gml_id"), props(pairs).alias("props"))


def geometry(elements: DataFrame, recs: DataFrame, pick: Callable[[list[str]], DataFrame] | None = None) -> Geometry:
    """Containers, implicit geometries, polygons, rings and positions with their edges.

    pick: from tags to their elements, where a source can leave out the others; nothing is checkpointed then.
    """
    keep = graph.cut if pick is None else lambda rows: rows
    pick = pick or (lambda tags: elements.where(F.col("tag").isin(*tags)))
    given = lambda rows: rows.withColumn("given", scalar.gml_id(F.col("attrs")))
    found = _lod(_owner(given(pick(CONTAINERS)), recs, OWNER_TAGS))
    found = graph.fallback_ids(found, "tag", ["eid"], "given", ["doc_id"], "raw_id")
    found = found.withColumn("concrete_id", F.concat(F.lower("tag"), F.lit(":"), "raw_id")).withColumn("geometry_id", F.concat(F.lit("geometry:"), F.lower("tag"), F.lit(":"), "raw_id"))
    lod = {"lod": js(F.col("lod")), "lod_source_tag": js(F.col("lod_tag"))}
    gid = {"gml_id": js(F.col("raw_id"))}
    node = lambda rows, id_, kind, ord_, pairs, gml: rows.select("doc_id", id_.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("node_type"), ord_.alias("ord"), gml.alias("gml_id"), props(pairs).alias("props"))
    eid, raw = F.col("eid"), F.col("raw_id")
    nodes = [
        node(found, F.col("concrete_id"), F.col("tag"), place(3, eid), gid | {"source_tag": js(F.col("tag"))} | lod, raw),
        node(found, F.col("geometry_id"), "Geometry", place(3, eid, 1), gid | {"source_tag": js(F.lit("Geometry")), "geometry_type": js(F.col("tag"))} | lod, raw),
    ]
    edges = [_edge(found, F.col("owner_id"), F.col("geometry_id"), "HAS_LOD_GEOMETRY", place(3, eid), props(lod)), _edge(found, F.col("geometry_id"), F.col("concrete_id"), "HAS_GEOMETRY_COMPONENT", place(3, eid, 1), props(lod))]

    implicit = _lod(_owner(given(pick(["ImplicitGeometry"])), recs, OWNER_TAGS))
    implicit = graph.fallback_ids(implicit.withColumn("kind", F.lit("ImplicitGeometry")), "kind", ["eid"], "given", ["doc_id"], "raw_id")
    # the counter's name is the type's value in lower case
    below = tree.descendants(elements, implicit)
    first = lambda tag, value: F.min_by(value, F.when((F.col("tag") == tag) & value.isNotNull(), F.col("eid")))
    href = F.coalesce(scalar.filled(F.col("attrs")[HREF]), scalar.filled(F.col("attrs")["href"]))
    inner = below.groupBy("doc_id", F.col("root_eid").alias("eid")).agg(
        first("transformationMatrix", scalar.filled(scalar.strip(F.col("text")))).alias("matrix"), first("relativeGMLGeometry", href).alias("href"), first("pos", scalar.parse_pos(F.col("text"))).alias("point")
    )
    implicit = implicit.join(inner, ["doc_id", "eid"], "left").withColumn("node_id", F.concat(F.lit("implicit_geometry:"), "raw_id"))
    extra = {"transformation_matrix": js(F.col("matrix")), "relative_geometry_href": js(F.col("href")), "reference_point": F.to_json("point")}
    nodes.append(node(implicit, F.col("node_id"), "ImplicitGeometry", place(4, eid), gid | {"source_tag": js(F.lit("ImplicitGeometry"))} | lod | extra, raw))
    edges.append(_edge(implicit, F.col("owner_id"), F.col("node_id"), "HAS_LOD_GEOMETRY", place(4, eid), props(lod)))

    faces = polygons(pick, recs)
    nodes.append(polygon_nodes(faces))
    edges.append(_edge(faces, F.col("owner_id"), F.col("polygon_id"), "HAS_GEOMETRY", place(5, eid)))
    inside = faces.withColumn("up", F.explode(F.filter("anc", lambda a: a["tag"].isin("Solid", "MultiSurface")))).withColumn("container_eid", F.col("up.eid"))
    inside = inside.join(found.select("doc_id", F.col("eid").alias("container_eid"), "concrete_id"), ["doc_id", "container_eid"])
    edges.append(_edge(inside, F.col("concrete_id"), F.col("polygon_id"), "HAS_GEOMETRY_MEMBER", place(5, eid, 1)))

    up = lambda k: F.get("anc", F.size("anc") - k)
    rings = given(pick(["LinearRing"])).where(up(1)["tag"].isin("exterior", "interior") & (up(2)["tag"] == "Polygon")).withColumn("ring_type", up(1)["tag"]).withColumn("polygon_eid", up(2)["eid"])
    rings = rings.join(faces.select("doc_id", F.col("eid").alias("polygon_eid"), "polygon_id", F.col("raw_id").alias("polygon_raw")), ["doc_id", "polygon_eid"])
    # the sequence counts the rings that have no id of their own as well as those that have
    seq = F.row_number().over(Window.partitionBy("doc_id", "polygon_eid").orderBy("eid")) - 1
    rings = rings.withColumn("raw_id", F.coalesce("given", F.concat("polygon_raw", F.lit("_ring_"), seq))).withColumn("ring_id", F.concat(F.lit("ring:"), "raw_id"))
    kind = {"ring_type": js(F.col("ring_type"))}
    nodes.append(node(rings, F.col("ring_id"), "LinearRing", place(6, eid), gid | kind | {"source_tag": js(F.lit("LinearRing"))}, raw))
    edges.append(_edge(rings, F.col("polygon_id"), F.col("ring_id"), "HAS_RING", place(6, eid), props(kind)))

    one = lambda c: F.when(c["tag"] == "pos", F.filter(F.array(scalar.parse_pos(c["text"])), lambda p: p.isNotNull())).when(c["tag"] == "posList", scalar.parse_pos_list(c["text"], c["attrs"]["srsDimension"])).otherwise(F.array().cast("array<array<double>>"))
    with_pos = with_children(pick(["pos", "posList"]), rings).withColumn("positions", F.flatten(F.transform(Children(F.col("children")).column, one)))
    lists = keep(with_pos.select("doc_id", "eid", "ring_id", F.col("raw_id"), "positions"))
    at = lists.select("doc_id", "eid", "ring_id", "raw_id", F.posexplode("positions").alias("order", "p")).withColumn("pos_id", F.concat(F.lit("pos:"), "raw_id", F.lit(":"), "order"))
    coordinates = {"x": F.col("p")[0].cast("string"), "y": F.col("p")[1].cast("string"), "z": F.col("p")[2].cast("string"), "coordinates": F.to_json("p"), "order": F.col("order").cast("string")}
    nodes.append(node(at, F.col("pos_id"), "Position", place(7, eid, F.col("order")), coordinates, F.lit(None).cast("string")))
    edges.append(_edge(at, F.col("ring_id"), F.col("pos_id"), "HAS_POS", place(7, eid, F.col("order")), props({"order": F.col("order").cast("string")})))
    return Geometry(union(nodes), union(edges), lists.select("doc_id", F.col("ring_id").alias("id"), "eid", "positions"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def appearance(elements: DataFrame, recs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appearance and surface-data nodes and edges; nodes: all nodes so far, whose gml ids are targets."""
    given = lambda rows: rows.withColumn("given", scalar.gml_id(F.col("attrs")))
    rank = F.array_position(F.array(*[F.lit(t) for t in schema.OBJECT_TYPES]), F.col("node_type"))
    fallback = recs.where(F.col("node_type").isin(*schema.OBJECT_TYPES)).groupBy("doc_id").agg(F.min_by(F.struct("id", "node_type"), F.struct(rank, "eid")).alias("fallback"))
    rows = graph.fallback_ids(given(elements.where("tag = 'Appearance'")), "tag", ["eid"], "given", ["doc_id"], "raw_id")
    rows = _owner(rows, recs, OWNER_TAGS, how="left").join(fallback, "doc_id", "left").withColumn("node_id", F.concat(F.lit("appearance:"), "raw_id"))
    resolution = F.when(F.col("owner_id").isNotNull(), F.lit("ancestor")).when(F.col("fallback").isNotNull(), F.concat(F.lit("fallback:"), "fallback.node_type")).otherwise(F.lit("unresolved"))
    rows = with_children(elements, rows).withColumn("resolution", resolution).withColumn("owner", F.coalesce("owner_id", "fallback.id"))
    eid = F.col("eid")
    top = rows.select("doc_id", F.col("node_id").alias("id"), F.lit("Appearance").alias("node_type"), place(8, eid).alias("ord"), F.col("raw_id").alias("gml_id"),
        props({"gml_id": js(F.col("raw_id")), "source_tag": js(F.lit("Appearance")), "owner_resolution": js(F.col("resolution")), "theme": js(Children(F.col("children")).text("theme", True))}).alias("props"))
    edges = [_edge(rows.where("owner is not null"), F.col("owner"), F.col("node_id"), "HAS_APPEARANCE", place(8, eid))]

    up = lambda k: F.get("anc", F.size("anc") - k)
    data = given(elements.where((up(1)["tag"] == "surfaceDataMember") & (up(2)["tag"] == "Appearance"))).withColumn("appearance_eid", up(2)["eid"]).withColumn("kind", F.lit("SurfaceData"))
    data = graph.fallback_ids(data, "kind", ["eid"], "given", ["doc_id"], "raw_id").withColumn("node_id", F.concat(F.lit("surface_data:"), "raw_id"))
    data = data.join(rows.select("doc_id", F.col("eid").alias("appearance_eid"), F.col("node_id").alias("appearance_id")), ["doc_id", "appearance_eid"])
    edges.append(_edge(data, F.col("appearance_id"), F.col("node_id"), "HAS_SURFACE_DATA", place(9, eid)))

    below = tree.descendants(elements, data).where(F.col("tag").isin("target", "targetUri", "surfaceGeometry", "surfaceGeometryRef"))
    href = F.coalesce(scalar.filled(F.col("attrs")[HREF]), scalar.filled(F.col("attrs")["href"]))
    raw_ref = F.when(F.col("tag").isin("target", "targetUri"), F.col("text")).otherwise(href)
    refs = below.select("doc_id", F.col("root_eid").alias("eid"), F.explode(scalar.target_refs(raw_ref)).alias("ref")).distinct()
    ids = nodes.where("trim(gml_id) <> ''").select("doc_id", scalar.strip(F.col("gml_id")).alias("ref"), F.col("id").alias("target_id"))
    named = refs.join(data.select("doc_id", "eid", "node_id"), ["doc_id", "eid"])
    hits = named.join(ids, ["doc_id", "ref"])
    edges.append(_edge(hits, F.col("node_id"), F.col("target_id"), "APPLIES_TO", place(10, eid), props({"target_ref": js(F.col("ref"))})))
    missed = named.join(ids, ["doc_id", "ref"], "left_anti").groupBy("doc_id", "eid").agg(F.sort_array(F.collect_set("ref")).alias("missed"))
    wanted = refs.groupBy("doc_id", "eid").agg(F.sort_array(F.collect_set("ref")).alias("refs"))
    full = with_children(elements, data).join(wanted, ["doc_id", "eid"], "left").join(missed, ["doc_id", "eid"], "left")
    full, c = full.select("*", *_staged(Children(F.col("children")), _DATA, True)), _Staged()

    def either(value: Column, number: str) -> Column:
        x = value[number]
        return F.coalesce(F.to_json(x) if number == "numbers" else x.cast("string"), js(value["raw"]))

    pairs = {"gml_id": js(F.col("raw_id")), "source_tag": js(F.col("tag")), "surface_data_type": js(F.col("tag"))}
    pairs["is_front"] = scalar.is_front(c.text("isFront", True)).cast("string")
    pairs |= {k: F.when(c.text(n, True).isNotNull(), either(scalar.numbers_or_text(c.text(n, True)), "numbers")) for k, n in (("diffuse_color", "diffuseColor"), ("specular_color", "specularColor"), ("emissive_color", "emissiveColor"))}
    pairs |= {k: F.when(c.text(n, True).isNotNull(), either(scalar.number_or_text(c.text(n, True)), "number")) for k, n in (("ambient_intensity", "ambientIntensity"), ("shininess", "shininess"), ("transparency", "transparency"))}
    count = lambda name: F.when(F.col(name).isNotNull(), F.size(name).cast("string"))
    pairs |= {"image_uri": js(c.text("imageURI", True)), "target_count": count("refs"), "target_refs": F.to_json("refs"), "unmatched_target_count": count("missed"), "unmatched_targets": F.to_json("missed")}
    second = full.select("doc_id", F.col("node_id").alias("id"), F.lit("SurfaceData").alias("node_type"), place(9, eid).alias("ord"), F.col("raw_id").alias("gml_id"), props(pairs).alias("props"))
    return top.unionByName(second), union(edges)


def room_objects(g: graph.SceneGraph, rings: DataFrame) -> DataFrame:
    """doc_id, room, id, flag (F, O, B) and the box of everything that belongs to a room."""
    typed = g.match("BuildingFurniture", "INSIDE", "Room").select("doc_id", F.col("target_id").alias("room"), F.col("source_id").alias("id"), F.lit("F").alias("flag"))
    kind = g.nodes.select("doc_id", F.col("id"), F.coalesce(F.nullif(F.col("props")["opening_type"], F.lit('""')), F.col("props")["source_tag"]).alias("tag"))
    openings = g.match("Opening", "CONNECTS", "Room").select("doc_id", F.col("target_id").alias("room"), F.col("source_id").alias("id"), F.lit("O").alias("flag"))
    openings = openings.join(kind, ["doc_id", "id"]).where(F.col("tag").isin('"Door"', '"Window"')).drop("tag")
    surfaces = g.match("Room", "BOUNDED_BY", "BoundarySurface").select("doc_id", F.col("source_id").alias("room"), F.col("target_id").alias("id"), F.lit("B").alias("flag"))
    members = typed.unionByName(openings).unionByName(surfaces).distinct()
    polygon = g.edges.where("relation = 'HAS_GEOMETRY'").select("doc_id", F.col("source_id").alias("id"), F.col("target_id").alias("polygon_id"))
    ring = g.edges.where("relation = 'HAS_RING'").select("doc_id", F.col("source_id").alias("polygon_id"), F.col("target_id").alias("ring_id"))
    last = rings.groupBy("doc_id", F.col("id").alias("ring_id")).agg(F.max_by("positions", "eid").alias("positions"))
    at = polygon.join(ring, ["doc_id", "polygon_id"]).join(last, ["doc_id", "ring_id"]).select("doc_id", "id", F.explode("positions").alias("p"))
    box = spatial.extract_bbox(at, ["doc_id", "id"], [F.col("p")[k] for k in range(3)]).where("min_x is not null and min_y is not null and min_z is not null")
    return members.join(box, ["doc_id", "id"])


def spatial_edges(objects: DataFrame, t: Thresholds) -> DataFrame:
    """Inferred edges of a room's furniture with its boundaries, openings and other furniture, both ways."""
    reach = max(t.touch, t.adjacent)
    pairs = spatial.near_pairs(objects, ["doc_id", "room"], reach, max(1.0, 4 * reach), F.col("flag") == "F")
    found = spatial.metadata(spatial.infer(pairs, t), t).where("relation is not null").withColumn("distance", F.bround("distance", 6))
    numbers = {k: F.col(k).cast("string") for k in ("distance", "epsilon_touch", "epsilon_adjacent", "epsilon_intersection", "confidence")}
    properties = props({"method": js(F.col("method")), "computed_at": js(F.col("computed_at"))} | numbers)
    return _edge(found, F.col("a_id"), F.col("b_id"), F.col("relation"), place(11, F.lit(0)), properties)


@dataclass
class Built:
    graph: graph.SceneGraph
    rejected: DataFrame
    elements: DataFrame
    records: DataFrame
    room_objects: DataFrame


def build(elements: DataFrame, t: Thresholds = Thresholds(), relations: bool = True) -> Built:
    """The whole graph of all documents of an element table; without inferred relations if they are switched off.

    Each stage is cut, since later ones read it several times; cut the elements first.
    """
    recs = graph.cut(records(elements))
    type_nodes, type_edges = surface_types(recs)
    geo = geometry(elements, recs)
    base = union([f.select(*NODE) for f in (semantic_nodes(elements, recs), type_nodes, geo.nodes)])
    base = graph.cut(graph.last_wins(base, ["doc_id", "id"], ["ord"]).drop("first_ord"))
    more, more_edges = appearance(elements, recs, base)
    nodes = graph.cut(graph.last_wins(base.unionByName(more.select(*NODE)), ["doc_id", "id"], ["ord"]).drop("first_ord"))
    judged = graph.cut(union([semantic_edges(recs), type_edges, geo.edges, more_edges]).select(*EDGE))
    edges, rejected = graph.add_edges(judged, nodes)
    edges = graph.cut(edges.select(*EDGE))
    objects = graph.cut(room_objects(graph.SceneGraph(nodes, edges), geo.rings))
    if not relations:
        return Built(graph.SceneGraph(nodes, edges), rejected, elements, recs, objects)
    inferred, bad = graph.add_edges(spatial_edges(objects, t), nodes)
    strong = graph.cut(spatial.strongest(inferred, ["doc_id", "source_id"]).select(*EDGE))
    return Built(graph.SceneGraph(nodes, edges.unionByName(strong)), rejected.unionByName(bad), elements, recs, objects)
