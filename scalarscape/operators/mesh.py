"""Geometry of triangulated surfaces held as tables.

``vertices``: mesh_id, vertex_id, x, y, z; ``triangles``: mesh_id, tri_id, a, b, c;
``fields``: mesh_id, field, vertex_id, value. All functions take many meshes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarscape.functions import vector as V
from scalarscape.operators.windows import running_number
from scalarscape.session import cut_lineage


def atom_frame(vertices: DataFrame) -> DataFrame:
    """(mesh_id, cx, cy, cz, radius): centroid, then mean distance to it. Meshes of radius 0 and null coordinates are left out."""
    centres = vertices.groupBy("mesh_id").agg(*[F.avg(n).alias(f"c{n}") for n in "xyz"])
    offset = V.minus(V.vec(""), V.vec("c"))
    return (
        vertices.join(centres, "mesh_id")
        .groupBy("mesh_id")
        .agg(*[F.first(f"c{n}").alias(f"c{n}") for n in "xyz"], F.avg(V.norm(offset)).alias("radius"))
        .where("radius > 0")
    )


def to_local(vertices: DataFrame, frame: DataFrame) -> DataFrame:
    """Vertices in the algorithm's frame as lx, ly, lz: the centre of each mesh at the origin."""
    return vertices.join(frame, "mesh_id").select(
        "mesh_id", "vertex_id", *[(F.col(n) - F.col(f"c{n}")).alias(f"l{n}") for n in "xyz"]
    )


def to_world(local: DataFrame, frame: DataFrame, factor: float = 1.0) -> DataFrame:
    """The way back, as wx, wy, wz; ``factor`` moves points outward first."""
    return local.join(frame, "mesh_id").select(
        "mesh_id", "vertex_id", *[(F.col(f"l{n}") * factor + F.col(f"c{n}")).alias(f"w{n}") for n in "xyz"]
    )


def sphere_radius(vertices: DataFrame) -> DataFrame:
    """(mesh_id, radius): mean distance from the origin of centred vertices."""
    return vertices.groupBy("mesh_id").agg(F.avg(V.norm(V.vec(""))).alias("radius"))


def unique_edges(triangles: DataFrame) -> DataFrame:
    """(mesh_id, u, v, n_triangles), u < v: each edge once, with the number of triangles that use it; degenerate sides are left out."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return (
        triangles.select("mesh_id", F.inline(sides)).where("u <> v").groupBy("mesh_id", "u", "v").agg(F.count(F.lit(1)).alias("n_triangles"))
    )


def edge_lengths(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with their length; ends that ``vertices`` lack are left out."""
    p = vertices.select("mesh_id", F.col("vertex_id").alias("u"), *[F.col(n).alias(f"p{n}") for n in "xyz"])
    q = vertices.select("mesh_id", F.col("vertex_id").alias("v"), *[F.col(n).alias(f"q{n}") for n in "xyz"])
    joined = edges.join(p, ["mesh_id", "u"]).join(q, ["mesh_id", "v"])
    return joined.select("mesh_id", "u", "v", V.norm(V.minus(V.vec("p"), V.vec("q"))).alias("length"))


def mesh_geometry(vertices: DataFrame, triangles: DataFrame, radius: DataFrame | None = None) -> DataFrame:
    """(mesh_id, n_vertices, n_edges, n_triangles, euler, radius, mean_edge, pitch_rad, pitch_deg).

    ``radius`` (mesh_id, radius) overrides the fitted radius, which then drives the
    pitch only. An empty mesh has no row.
    """
    edges = unique_edges(triangles)
    lengths = edge_lengths(edges, vertices).groupBy("mesh_id").agg(F.avg("length").alias("mean_edge"))
    counts = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.avg(V.norm(V.vec(""))).alias("radius"))
    if radius is not None:
        counts = counts.drop("radius").join(radius, "mesh_id")
    n_edges = edges.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_edges"))
    n_triangles = triangles.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_triangles"))
    joined = counts.join(n_edges, "mesh_id").join(n_triangles, "mesh_id").join(lengths, "mesh_id")
    pitch = V.pitch(F.col("mean_edge"), F.col("radius"))
    return joined.select(
        "mesh_id",
        "n_vertices",
        "n_edges",
        "n_triangles",
        (F.col("n_vertices") - F.col("n_edges") + F.col("n_triangles")).alias("euler"),
        "radius",
        "mean_edge",
        pitch.alias("pitch_rad"),
        F.degrees(pitch).alias("pitch_deg"),
    )


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """Edges that exactly one triangle uses: with an apex they make the wedge of an open patch."""
    return unique_edges(triangles).where("n_triangles = 1").drop("n_triangles")


def wedge_triangles(triangles: DataFrame, apex: int = -1) -> DataFrame:
    """(mesh_id, a, b, c): the triangles from the boundary edges of each patch to an apex vertex."""
    return boundary_edges(triangles).select("mesh_id", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(apex).cast("bigint").alias("c"))


def corners(triangles: DataFrame, fields: DataFrame) -> DataFrame:
    """(mesh_id, field, tri_id, p: array of three (vertex, value)), corner order kept; triangles that lack a value are left out."""
    each = triangles.select("mesh_id", "tri_id", F.posexplode(F.array("a", "b", "c")).alias("k", "vertex_id"))
    with_value = each.join(fields, ["mesh_id", "vertex_id"])
    gathered = with_value.groupBy("mesh_id", "field", "tri_id").agg(
        F.array_sort(F.collect_list(F.struct("k", F.col("vertex_id").alias("vertex"), "value"))).alias("p")
    )
    return gathered.where(F.size("p") == 3)


def values_by_vertex(fields: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, own: map of field to value); nulls and fields that a vertex has twice are left out."""
    listed = fields.where("field is not null and value is not null").groupBy("mesh_id", "vertex_id").agg(F.collect_list(F.struct("field", "value")).alias("all"))
    once = F.filter("all", lambda x: F.size(F.filter("all", lambda y: y["field"] == x["field"])) == 1)
    return listed.select("mesh_id", "vertex_id", F.map_from_entries(once).alias("own"))


def level_crossings(triangles: DataFrame, fields: DataFrame, levels: DataFrame) -> DataFrame:
    """(mesh_id, field, level, u, v, t): where each contour level crosses an edge, ``t`` of the way from u to v (u < v).

    ``levels``: mesh_id, field, level. A vertex at the level counts as above it, so a
    triangle is crossed on two edges or none, and every crossing occurs once.
    """
    tri = corners(triangles, fields)
    pairs = F.flatten(
        F.array(
            *[
                F.array(
                    F.struct(
                        F.when(F.col("p")[i]["vertex"] < F.col("p")[j]["vertex"], F.col("p")[i]).otherwise(F.col("p")[j]).alias("s"),
                        F.when(F.col("p")[i]["vertex"] < F.col("p")[j]["vertex"], F.col("p")[j]).otherwise(F.col("p")[i]).alias("e"),
                    )
                )
                for i, j in ((0, 1), (1, 2), (2, 0))
            ]
        )
    )
    edges = tri.select("mesh_id", "field", F.inline(pairs)).select(
        "mesh_id", "field", F.col("s.vertex").alias("u"), F.col("s.value").alias("fu"), F.col("e.vertex").alias("v"), F.col("e.value").alias("fv")
    ).where("u <> v").dropDuplicates(["mesh_id", "field", "u", "v"])
    crossed = edges.join(levels, ["mesh_id", "field"]).where("(fu >= level) <> (fv >= level)")
    return crossed.select("mesh_id", "field", "level", "u", "v", ((F.col("level") - F.col("fu")) / (F.col("fv") - F.col("fu"))).alias("t"))


def robust_bounds(fields: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(mesh_id, field, lo, hi): linearly interpolated percentiles of the finite values; the full range where they coincide, (0, 1) where there are none."""
    key = ["mesh_id", "field"]
    finite = fields.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).select(*key, "vertex_id", "value")
    ranked = cut_lineage(running_number(finite, key, ["value", "vertex_id"], "_rank"))  # sorted in pieces, as a field may be of any size
    sizes = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    at = [(q, F.lit(q) * (F.col("n") - 1)) for q in (low, high)]
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), (f(pos) + 1).cast("int").alias("_rank")) for i, (_, pos) in enumerate(at) for f in (F.floor, F.ceil)])
    picked = sizes.select(*key, "n", F.inline(wanted)).distinct().join(ranked.select(*key, "_rank", "value"), [*key, "_rank"])

    def quantile(i: int) -> Column:
        pos = at[i][1]
        v = lambda f: F.max(F.when((F.col("q") == i) & (F.col("_rank") == f(pos) + 1), F.col("value")))
        return v(F.floor) + (v(F.ceil) - v(F.floor)) * (F.first(pos) - F.floor(F.first(pos)))

    quantiles = picked.groupBy(*key).agg(quantile(0).alias("lo"), quantile(1).alias("hi"))
    every = fields.select(*key).distinct().join(sizes, key, "left").join(quantiles, key, "left")
    narrow = F.col("hi") <= F.col("lo")
    return every.select(
        *key,
        F.coalesce(F.when(narrow, F.col("least")).otherwise(F.col("lo")), F.lit(0.0)).alias("lo"),
        F.coalesce(F.when(narrow, F.col("most")).otherwise(F.col("hi")), F.lit(1.0)).alias("hi"),
    )


def contour_levels(bounds: DataFrame, n: int = 15, logarithmic: bool = False) -> DataFrame:
    """(mesh_id, field, k, level): ``n`` (at least 2) evenly spaced levels from lo to hi; logarithmic ones start at 1e-4 or higher and span a decade or more."""
    n = max(2, n)
    step = F.col("k") / (n - 1)
    spread = bounds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if not logarithmic:
        return spread.select("mesh_id", "field", "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * step).alias("level"))
    lo = F.log10(F.greatest(F.col("lo"), F.lit(1e-4)))
    hi = F.greatest(F.log10(F.greatest(F.col("hi"), F.lit(1e-4))), lo + 1)
    return spread.select("mesh_id", "field", "k", F.pow(F.lit(10.0), lo + (hi - lo) * step).alias("level"))
