"""The queries of this subpackage: (spark, folder of the tables) to DataFrame, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarscape.llm import components, mixture, mojibake, splitting, tokenizer
from scalarscape.session import table


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_items(table(spark, sf_dir, "snapshots"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("snapshot_id", F.col("item_pos").cast("int").alias("item_pos"), "slot")


def p1_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.recovery(table(spark, sf_dir, "snapshots"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.groups(table(spark, sf_dir, "clusters"), table(spark, sf_dir, "bridge_links"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whether decoding the ids gives the text again; null stands as the empty text."""
    documents = table(spark, sf_dir, "documents")
    decoded = tokenizer.decode(tokenizer.encode(documents, "doc_id", "text"), "doc_id", "ids")
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was"))
    back = decoded.select("doc_id", F.xxhash64("text").alias("is"))
    return texts.join(back, "doc_id").select("doc_id", (F.col("was") == F.col("is")).alias("same"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.deviations(*_mix(spark, sf_dir))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_limits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_restored, p1_recovery, p3_found, p6_ids, p6_roundtrip, p7_mixture, p7_shares, p7_deviation, p8_pieces)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": r"""
            WITH RECURSIVE nodes AS (SELECT DISTINCT cluster_id, lower(trim(cluster_id, E' \t\n\r')) AS k FROM clusters WHERE cluster_id IS NOT NULL),
            one AS (SELECT DISTINCT lower(trim(cluster_a, E' \t\n\r')) AS a, lower(trim(cluster_b, E' \t\n\r')) AS b FROM bridge_links
                    WHERE is_linked AND cluster_a IS NOT NULL AND cluster_b IS NOT NULL),
            edges AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
            reach(k, r) AS (SELECT k, k FROM nodes UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.k),
            roots AS (SELECT k, min(r) AS r FROM reach GROUP BY k)
            SELECT min(cluster_id) OVER (PARTITION BY r) AS group_id, cluster_id FROM nodes JOIN roots USING (k)""",
        "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    }
