"""CityGML documents as element tables.

``citygml`` is a Python data source: one partition a file, streamed with
``iterparse``, elements emitted as they end, so memory holds one path of the tree
and not the document.  Files are listed by Spark's file system, so any store that
Spark reads will do.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ELEMENTS = (
    "doc_id string, eid long, end_eid long, parent_eid long, depth int, tag string, ns string, text string, "
    "attrs map<string,string>, anc array<struct<eid:long,tag:string>>"
)


def parse(doc_id: str, stream) -> Iterator[tuple]:
    """Element rows of one document, in the order in which elements end; eid is the pre-order number."""
    from xml.etree.ElementTree import iterparse

    path: list[tuple] = []
    n = 0
    for event, e in iterparse(stream, events=("start", "end")):
        if event == "start":
            if not isinstance(e.tag, str):
                continue
            ns, _, tag = e.tag[1:].rpartition("}") if e.tag.startswith("{") else ("", "", e.tag)
            path.append((n, tag, ns or None, e))
            n += 1
        else:
            eid, tag, ns, _ = path.pop()
            anc = [{"eid": p[0], "tag": p[1]} for p in path]
            yield doc_id, eid, n - 1, path[-1][0] if path else None, len(path), tag, ns, e.text, dict(e.attrib), anc
            e.clear()
            if path:
                path[-1][3].remove(e)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("files", "").split("\n") if p] or [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
            yield from parse(path, f)


class CityGmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "citygml"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all files at a path, a folder or a glob, in any store that Spark reads."""
    return elements_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def elements_of(files: DataFrame) -> DataFrame:
    """Elements of files given as path and content."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS))
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc_id, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows: list[dict] = []
                for row in parse(doc_id, io.BytesIO(content)):
                    rows.append(dict(zip(names, row)) | {"attrs": list(row[8].items())})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, ELEMENTS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CityGmlSource)
