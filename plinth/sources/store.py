"""A Parquet property-graph store with keyed, property-merging upserts, and JSON output."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StructField, StructType

from plinth.operators.graph import SceneGraph, cut, numbered

#: Parts of a store that are rewritten each for itself; documents are dealt to them by a hash.
BUCKETS = 64
NODE_KEY, EDGE_KEY = ["doc_id", "id"], ["doc_id", "source_id", "relation", "target_id"]


def merge_properties(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: each property is the newest that is not null.  Maps are merged entry by entry in the same way."""
    both = old.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "age_"]
    maps = [c for c in rest if isinstance(both.schema[c].dataType, MapType)]
    newest = lambda c, test=F.lit(True): F.max_by(c, F.when(F.col(c).isNotNull() & test, F.col("age_")))
    sides = [newest(c, F.col("age_") == age).alias(f"{c}_{age}_") for c in maps for age in (0, 1)]
    merged = both.groupBy(*key).agg(*[newest(c).alias(c) for c in rest if c not in maps], *sides)

    def entries(c: str):
        one, two = F.col(f"{c}_0_"), F.col(f"{c}_1_")
        return F.coalesce(F.map_zip_with(one, two, lambda _, a, b: F.coalesce(b, a)), two, one)

    return merged.select(*key, *[(entries(c) if c in maps else F.col(c)).alias(c) for c in rest])


def chunks(rows: DataFrame, label: list[str], order: list[str], size: int, ranges: int | None = None) -> DataFrame:
    """rows with ``batch``, fixed-size slices of each label in order; one slice if size is not positive."""
    if size <= 0:
        return rows.withColumn("batch", F.lit(0).cast("long"))
    placed = numbered(rows, label, order, "batch", ranges)
    return placed.withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Ids that break uniqueness."""
    return nodes.groupBy("doc_id", "id").count().where("count > 1")


class GraphStore:
    """nodes partitioned by bucket and node_type and edges by bucket and relation, below one folder.

    A save rewrites the buckets of the documents that it brings, beside the old ones, and
    then moves the pointer, so a reader never sees half a save and a failed one leaves
    the old state.  Versions that neither the new nor the last pointer names are deleted.
    """

    def __init__(self, spark, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        """buckets: version of each bucket; schemas of nodes and edges; number of buckets."""
        path = self._path("CURRENT")
        if not self._fs(path).exists(path):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(str(path)).collect()))  # one short file

    def _read(self, manifest: dict, part: str, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schemas"][part])
        out = self.spark.createDataFrame([], schema)
        by_version: dict[str, list[int]] = {}
        for bucket, version in manifest["buckets"].items():
            if only is None or int(bucket) in only:
                by_version.setdefault(version, []).append(int(bucket))
        for version, buckets in sorted(by_version.items()):
            found = self.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.folder}/{version}/{part}")
            out = out.unionByName(found.where(F.col("bucket").isin(buckets)).drop("bucket"))
        return out

    def load(self) -> SceneGraph | None:
        manifest = self._manifest()
        if manifest is None:
            return None
        return SceneGraph(self._read(manifest, "nodes"), self._read(manifest, "edges"))

    def _with_bucket(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))

    def save(self, graph: SceneGraph) -> dict[str, int]:
        """Upsert: nodes merge by (doc_id, id), edges by (doc_id, source, relation, target); edges without ends are dropped."""
        manifest = self._manifest()
        n = manifest["n_buckets"] if manifest else self.buckets
        nodes, edges = graph.nodes, graph.edges
        # at most n rows
        touched = {r.bucket for r in self._with_bucket(nodes.select("doc_id").unionByName(edges.select("doc_id")).distinct(), n).select("bucket").distinct().collect()}
        if manifest:
            nodes = merge_properties(self._read(manifest, "nodes", touched), nodes, NODE_KEY)
            edges = merge_properties(self._read(manifest, "edges", touched), edges, EDGE_KEY)
        nodes = cut(nodes)
        for side in ("source", "target"):
            edges = edges.join(nodes.select("doc_id", F.col("id").alias(f"{side}_id")), ["doc_id", f"{side}_id"], "left_semi")
        version = f"v-{uuid.uuid4().hex}"
        for part, rows, kind in (("nodes", nodes, "node_type"), ("edges", edges, "relation")):
            self._with_bucket(rows, n).write.partitionBy("bucket", kind).parquet(f"{self.folder}/{version}/{part}")
        schemas = {"nodes": json.loads(nodes.schema.json()), "edges": json.loads(edges.schema.json())}
        buckets = (manifest["buckets"] if manifest else {}) | {str(b): version for b in touched}
        self._point({"n_buckets": n, "schemas": schemas, "buckets": buckets}, manifest)
        saved = self.load()
        return {"node_count": saved.nodes.count(), "edge_count": saved.edges.count()}

    def _point(self, manifest: dict, last: dict | None) -> None:
        current = self._path("CURRENT")
        fs = self._fs(current)
        out = fs.create(current, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        live = set(manifest["buckets"].values()) | set((last or {"buckets": {}})["buckets"].values())
        for status in fs.listStatus(self._path(".")) if last else []:
            name = status.getPath().getName()
            if name.startswith("v-") and name not in live:
                fs.delete(status.getPath(), True)


def write_json(graph: SceneGraph, folder: str) -> None:
    """nodes and edges as JSON lines."""
    graph.nodes.write.mode("overwrite").json(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").json(f"{folder}/edges")
