"""CityJSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cityjson(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, document: each file as one variant."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.parse_json("value").alias("document"))


def geometry(obj: Column) -> Column:
    """struct(type, geometry) of an object given as a variant."""
    kind = F.coalesce(F.try_variant_get(obj, "$.type", "string"), F.lit("Unknown"))
    return F.struct(kind.alias("type"), F.try_variant_get(obj, "$.geometry", "variant").alias("geometry"))
