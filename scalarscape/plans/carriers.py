"""Meshes, fields and rings that Spark derives from the given tables, with the same derivations in SQL.

The dense part keys are the vertices of a sphere of poles and rings of 18 vertices;
prices, quantities and mean line prices are its fields. Hours of the day are the
samples of closed rings, one for each type of event.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarscape.session import table

SEGMENTS = 18
OFFSET = (1.261797, -0.00009, -0.000193)  # centre of the shifted copy of the sphere


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex_id"))
    last = parts.agg(F.max("vertex_id")).first()[0] or 0
    return parts.select("vertex_id", F.lit(last).cast("bigint").alias("last"), F.lit((last - 1) // SEGMENTS).alias("rings"))


def part_vertices(spark: SparkSession, sf_dir: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    ring, seg = F.floor((F.col("vertex_id") - 1) / SEGMENTS), (F.col("vertex_id") - 1) % SEGMENTS
    theta = F.when(F.col("vertex_id") == 0, 0.0).when(F.col("vertex_id") == F.col("last"), pi).otherwise(pi * (ring + 1) / (F.col("rings") + 1))
    phi = 2 * pi * seg / SEGMENTS
    return _keyed(spark, sf_dir).select(
        F.lit("part").alias("mesh_id"),
        "vertex_id",
        (F.sin(theta) * F.cos(phi) + offset[0]).alias("x"),
        (F.sin(theta) * F.sin(phi) + offset[1]).alias("y"),
        (F.cos(theta) + offset[2]).alias("z"),
    )


def part_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, last = F.col("vertex_id"), F.col("last")
    ring = F.floor((v - 1) / SEGMENTS)
    east = ring * SEGMENTS + 1 + (v % SEGMENTS)
    cell = lambda k, a, b, c: F.struct((4 * v + k).alias("tri_id"), a.alias("a"), b.alias("b"), c.alias("c"))
    zero = F.lit(0).cast("bigint")
    cells = F.array_compact(
        F.array(
            F.when(ring == 0, cell(0, zero, v, east)),
            F.when(ring < F.col("rings") - 1, cell(1, v, v + SEGMENTS, east)),
            F.when(ring < F.col("rings") - 1, cell(2, east, v + SEGMENTS, east + SEGMENTS)),
            F.when(ring == F.col("rings") - 1, cell(3, last, east, v)),
        )
    )
    return _keyed(spark, sf_dir).where((v > 0) & (v < last)).select(F.lit("part").alias("mesh_id"), F.inline(cells))


def part_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex_id"), F.col("p_retailprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("vertex_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 6).alias("line_price")
    )
    wide = prices.join(lines.hint("merge"), "vertex_id", "left")
    names = ("price", "quantity", "line_price")
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])
    return wide.select(F.lit("part").alias("mesh_id"), "vertex_id", F.inline(rows)).where("value is not null")


VERTICES_SQL = f"""
    SELECT 'part' AS mesh_id, v AS vertex_id, sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z FROM (
        SELECT p_partkey AS v, CASE WHEN p_partkey = 0 THEN 0.0 WHEN p_partkey = last THEN pi()
            ELSE pi() * ((p_partkey - 1) // {SEGMENTS} + 1) / ((last - 1) // {SEGMENTS} + 1) END AS theta,
            2 * pi() * ((p_partkey - 1) % {SEGMENTS}) / {SEGMENTS} AS phi
        FROM part, (SELECT max(p_partkey) AS last FROM part))"""

TRIANGLES_SQL = f"""
    SELECT 'part' AS mesh_id, 4 * v + k AS tri_id, a, b, c FROM (
        SELECT v, unnest([0, 1, 2, 3]) AS k, unnest([0, v, east, last]) AS a, unnest([v, v + {SEGMENTS}, v + {SEGMENTS}, east]) AS b,
               unnest([east, east, east + {SEGMENTS}, v]) AS c, unnest([ring = 0, ring < rings - 1, ring < rings - 1, ring = rings - 1]) AS keep
        FROM (SELECT p_partkey AS v, last, (last - 1) // {SEGMENTS} AS rings, (p_partkey - 1) // {SEGMENTS} AS ring,
              ((p_partkey - 1) // {SEGMENTS}) * {SEGMENTS} + 1 + p_partkey % {SEGMENTS} AS east
              FROM part, (SELECT max(p_partkey) AS last FROM part) WHERE p_partkey > 0 AND p_partkey < last)) WHERE keep"""

FIELDS_SQL = """
    SELECT 'part' AS mesh_id, vertex_id, field, value FROM (
        SELECT p_partkey AS vertex_id, unnest(['price', 'quantity', 'line_price']) AS field, unnest([p_retailprice, quantity, line_price]) AS value
        FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 6) AS line_price FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
    WHERE value IS NOT NULL"""

MESH_SQL = f"vertices AS ({VERTICES_SQL}), triangles AS ({TRIANGLES_SQL}), fields AS ({FIELDS_SQL})"


def event_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ring_id, k, n, phi, value): for each type of event 24 samples, the mean value of each hour."""
    events = table(spark, sf_dir, "events").where("value is not null and event_type is not null")
    hours = events.groupBy(F.col("event_type").alias("ring_id"), F.hour("ts").alias("k")).agg(F.round(F.avg("value"), 6).alias("value"))
    return hours.select("ring_id", "k", F.lit(24).alias("n"), (2 * pi * F.col("k") / 24).alias("phi"), "value")


RINGS_SQL = """rings AS (SELECT event_type AS ring_id, hour(ts)::INT AS k, 24 AS n, 2 * pi() * hour(ts) / 24 AS phi, round(avg(value), 6) AS value
    FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type, hour(ts))"""
