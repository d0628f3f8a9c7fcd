"""A folder of arriving documents, kept up to date in a graph store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.functions.boxes import Thresholds
from plinth.operators import construct, graph
from plinth.sources.citygml import elements_of
from plinth.sources.store import GraphStore


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, thresholds: Thresholds = Thresholds(), max_files: int = 100):
    """A streaming query that upserts every new file's graph; the upsert is keyed, so a repeated batch changes nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(folder)

    def save(batch: DataFrame, _: int) -> None:
        built = construct.build(graph.cut(elements_of(batch.select("path", "content"))), thresholds)
        GraphStore(batch.sparkSession, store).save(built.graph)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
