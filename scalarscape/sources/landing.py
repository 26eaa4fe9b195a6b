"""Sinks and the landing of decoded files: Parquet tables by dataset, JSON snapshots, listings and stale files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarscape.sources import tdv

TABLES = ("datasets", "variables", "zones", "points", "fields", "cells")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, extension, size, modified) of the files in a folder, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stale(files: DataFrame, landed: DataFrame) -> DataFrame:
    """Files that have no landed copy (name, landed_at) or one older than themselves."""
    joined = files.join(landed, "name", "left")
    return joined.where(F.col("landed_at").isNull() | (F.col("landed_at") < F.col("modified"))).select(*files.columns)


def land(spark: SparkSession, folder: str, target: str, tables: tuple[str, ...] = TABLES) -> None:
    """Decode all files of a folder into Parquet tables partitioned by dataset."""
    tdv.register(spark)
    for name in tables:
        spark.read.format("tdv").option("table", name).load(folder).write.mode("overwrite").partitionBy("dataset").parquet(f"{target}/{name}")


def to_snapshot_json(snapshots: DataFrame) -> DataFrame:
    """(name, value): each snapshot as one JSON text with sorted sections, named <stem>_atom<N>_params.json."""
    stem = F.regexp_extract(F.regexp_replace("context.plt_path", r"\\", "/"), r"([^/]+?)(\.[^./]*)?$", 1)
    name = F.concat(F.coalesce(stem, F.lit("snapshot")), F.lit("_atom"), F.coalesce(F.col("context.atom_number"), F.lit(1)).cast("string"), F.lit("_params.json"))
    body = F.to_json(F.struct("camera", "context", "derived_metrics", "params", "schema_version", "selection", "timestamp_utc", "tool"))
    return snapshots.select("snapshot_id", name.alias("name"), body.alias("value"))
