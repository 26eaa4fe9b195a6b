"""Critical points to clusters, clusters to strings, and both to what replaces them.

``points``: mesh_id, field, vertex_id, cp_type (maximum, minimum, saddle), value,
multiplicity, x, y, z about the mesh's centre. Every function takes many meshes and
fields at once; a vertex that a field has twice counts once.
"""

from __future__ import annotations

from math import acos, pi, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarscape.functions import vector as V
from scalarscape.operators import spherical
from scalarscape.operators.graph import connected_groups
from scalarscape.operators.rings import named
from scalarscape.operators.windows import running_total
from scalarscape.session import cut_lineage, written

KEY = ["mesh_id", "field"]
FLAT = 1e-16  # variance below which a direction has no extent
MOST_ASPECT = 999.0  # aspect of groups without extent across their axis


def placed_points(points: DataFrame, side: float) -> DataFrame:
    """(mesh_id, field, vertex_id, ux, uy, uz, i, j, l): unit directions and their cells of ``side`` in space; points without a direction are left out."""
    units = points.select(*KEY, "vertex_id", *named(V.unit(V.vec("")), "u")).where("ux is not null")
    return units.select("*", *[F.floor(F.col(f"u{m}") / side).alias(n) for m, n in zip("xyz", "ijl", strict=True)])


def linked_cells(placed: DataFrame, reach: float) -> DataFrame:
    """(a, b): the least vertices (mesh_id, field, vertex_id) of each two cells that hold points at most ``reach`` radians apart, a cell of one vertex or more with itself too.

    ``placed`` as from placed_points with cells so small that all their points are linked.
    Cells up to two apart are compared: by their extreme points first, and where none of
    those are near enough by all.
    """
    cell = [*KEY, "i", "j", "l"]
    limit = 2 * sin(min(reach, pi) / 2) * (1 + 1e-9)
    point = F.struct("ux", "uy", "uz")
    held = written(placed.groupBy(*cell).agg(
        F.min("vertex_id").alias("at"), *[f(f"u{m}").alias(f"{n}{m}") for f, n in ((F.min, "lo"), (F.max, "hi")) for m in "xyz"],
        F.array_distinct(F.array(*[f(point, f"u{m}") for f in (F.min_by, F.max_by) for m in "xyz"])).alias("ends"), *[F.collect_list(f"u{m}").alias(f"all{m}") for m in "xyz"],
    ))
    span = range(-2, 3)
    beside = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(k).alias("dl")) for i in span for j in span for k in span if (i, j, k) > (0, 0, 0)])
    looks = held.select(*KEY, F.col("at").alias("a"), "i", "j", "l", F.inline(beside)).select(*KEY, "a", *[(F.col(n) + F.col(f"d{n}")).alias(n) for n in "ijl"])
    met = looks.join(held.select(*cell, F.col("at").alias("b")).hint("merge"), cell).select(*KEY, "a", "b")
    what = ["ends", *[f"{n}{m}" for n in ("lo", "hi") for m in "xyz"]]
    side = lambda p, names: held.select(*KEY, F.col("at").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in names]).hint("merge")
    near = met.join(side("a", what), [*KEY, "a"]).join(side("b", what), [*KEY, "b"])
    apart = [F.greatest(F.col(f"a_lo{m}") - F.col(f"b_hi{m}"), F.col(f"b_lo{m}") - F.col(f"a_hi{m}"), F.lit(0.0)) for m in "xyz"]
    near = near.where(V.norm(apart) <= limit)
    part = lambda p: tuple(p[f"u{m}"] for m in "xyz")
    quick = F.exists("a_ends", lambda p: F.exists("b_ends", lambda q: V.angle(part(p), part(q)) <= reach))
    judged = written(near.select(*KEY, "a", "b", quick.alias("quick")))
    every = [f"all{m}" for m in "xyz"]
    open_ = judged.where("not quick").join(side("a", every), [*KEY, "a"]).join(side("b", every), [*KEY, "b"])

    @F.pandas_udf("boolean")
    def linked(ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series) -> pd.Series:
        return pd.Series([nearest_angle(*r) <= reach for r in zip(ax, ay, az, bx, by, bz, strict=True)])

    late = open_.where(linked(*[F.col(f"{p}_{c}") for p in "ab" for c in every]))
    node = lambda c: F.struct(*KEY, F.col(c).alias("vertex_id")).alias(c)
    return judged.where("quick").select(node("a"), node("b")).unionByName(late.select(node("a"), node("b")))


def nearest_angle(ax, ay, az, bx, by, bz) -> float:
    """The least angle between a direction of one set and one of another, in pieces of bounded size."""
    step = max(1, (1 << 20) // len(bx))
    most = max(float((ax[k : k + step, None] * bx + ay[k : k + step, None] * by + az[k : k + step, None] * bz).max()) for k in range(0, len(ax), step))
    return acos(max(-1.0, min(1.0, most)))


def memberships(points: DataFrame, reach: float) -> DataFrame:
    """(mesh_id, field, vertex_id, root): each point and the smallest vertex of its cluster, points linked by steps of at most ``reach`` radians.

    Points lie in cells whose diagonal is the reach, so all of a cell are linked and only
    cells are nodes of the graph: its size does not grow with the points that lie close.
    """
    side = max(2 * sin(min(reach, pi) / 2), 1e-9) / sqrt(3) * (1 - 1e-9)
    placed = written(placed_points(points, side))
    groups = connected_groups(linked_cells(placed, reach))
    cell = [*KEY, "i", "j", "l"]
    firsts = placed.groupBy(*cell).agg(F.min("vertex_id").alias("at"))
    roots = firsts.join(groups.select("node.mesh_id", "node.field", F.col("node.vertex_id").alias("at"), F.col("root.vertex_id").alias("root")), [*KEY, "at"], "left")
    grouped = placed.join(roots.select(*cell, F.coalesce("root", "at").alias("root")), cell).groupBy(*KEY, "vertex_id").agg(F.min("root").alias("root"))
    own = points.select(*KEY, "vertex_id").distinct()
    return own.join(grouped, [*KEY, "vertex_id"], "left").select(*KEY, "vertex_id", F.coalesce("root", "vertex_id").alias("root"))


def pooled_geometry(members: DataFrame, group: list[str]) -> DataFrame:
    """Counts, values and shape of the points of each ``group``, a vertex once.

    n_members, n_maxima, n_minima, n_saddles, total_saddle_index, local_euler_index,
    value_max, value_min; the centre ux, uy, uz (normalised mean direction, the least
    vertex's where that vanishes); max_theta from it; and, in the tangent plane there,
    with directions mapped along great circles, the principal axis px, py, pz,
    aspect_ratio (1 for a single point, at most 999), max_major and max_minor: the
    farthest projections about the mean.
    """
    own = members.select(*group, "vertex_id", "cp_type", "value", "multiplicity", *named(V.unit(V.vec("")), "u")).dropDuplicates([*group, "vertex_id"])
    is_a = lambda kind: F.col("cp_type") == kind
    sums = own.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_members"),
        *[F.count_if(is_a(kind)).alias(f"n_{name}") for kind, name in (("maximum", "maxima"), ("minimum", "minima"), ("saddle", "saddles"))],
        F.coalesce(F.sum(F.when(is_a("saddle"), F.col("multiplicity"))), F.lit(0)).alias("total_saddle_index"),
        F.max("value").alias("value_max"), F.min("value").alias("value_min"),
        *[F.avg(f"u{m}").alias(f"m{m}") for m in "xyz"], F.min_by(F.struct("ux", "uy", "uz"), "vertex_id").alias("_first"),
    )
    mean = V.unit(V.vec("m"), 1e-8)
    centred = sums.select(*group, *[F.coalesce(c, F.col(f"_first.u{m}")).alias(f"c{m}") for c, m in zip(mean, "xyz", strict=True)])
    t1, _ = V.tangent_basis(V.vec("c"))
    based = centred.select("*", *named(t1, "s"))
    based = based.select("*", *named(V.cross(V.vec("c"), V.vec("s")), "t"))
    at = own.join(based, group)
    theta = V.angle(V.vec("u"), V.vec("c"))
    flat = V.unit(V.tangent_project(V.vec("u"), V.vec("c")), 1e-12)
    mapped = at.select(
        *group, theta.alias("theta"),
        *[F.when(theta > 1e-12, F.coalesce(theta * V.dot(flat, V.vec(axis)), F.lit(0.0))).otherwise(0.0).alias(name) for axis, name in (("s", "p"), ("t", "q"))],
    )
    spread = mapped.groupBy(*group).agg(
        F.max("theta").alias("max_theta"), F.avg("p").alias("mp"), F.avg("q").alias("mq"), F.var_pop("p").alias("pp"), F.var_pop("q").alias("qq"), F.covar_pop("p", "q").alias("pq")
    )
    half, root = (F.col("pp") + F.col("qq")) / 2, F.sqrt(F.pow((F.col("pp") - F.col("qq")) / 2, 2) + F.pow("pq", 2))
    turn = F.when((F.abs(F.col("pp") - F.col("qq")) <= FLAT) & (F.abs("pq") <= FLAT), 0.0).otherwise(F.atan2(2 * F.col("pq"), F.col("pp") - F.col("qq")) / 2)
    shape = spread.select(*group, "max_theta", "mp", "mq", turn.alias("turn"), F.sqrt(F.greatest(half + root, F.lit(FLAT)) / F.greatest(half - root, F.lit(FLAT))).alias("aspect"))
    p, q = F.col("p") - F.col("mp"), F.col("q") - F.col("mq")
    extent = mapped.join(shape, group).groupBy(*group).agg(
        F.max(F.abs(p * F.cos("turn") + q * F.sin("turn"))).alias("max_major"), F.max(F.abs(q * F.cos("turn") - p * F.sin("turn"))).alias("max_minor")
    )
    axis = V.plus(V.scaled(V.vec("s"), F.cos("turn")), V.scaled(V.vec("t"), F.sin("turn")))
    sign = F.when(F.abs(axis[0]) > 1e-6, F.signum(axis[0])).when(F.abs(axis[1]) > 1e-6, F.signum(axis[1])).otherwise(F.signum(axis[2]))
    axis = V.scaled(axis, sign)  # an axis has no direction: its first component that is not nil is positive
    whole = sums.drop("mx", "my", "mz", "_first").join(based, group).join(shape.drop("mp", "mq"), group).join(extent, group)
    return whole.select(
        *group, "n_members", "n_maxima", "n_minima", "n_saddles", "total_saddle_index",
        (F.col("n_maxima") + F.col("n_minima") - F.col("total_saddle_index")).alias("local_euler_index"),
        "value_max", "value_min", *[F.col(f"c{m}").alias(f"u{m}") for m in "xyz"], "max_theta",
        F.when(F.col("n_members") < 2, 1.0).otherwise(F.least(F.col("aspect"), F.lit(MOST_ASPECT))).alias("aspect_ratio"),
        *named(axis, "p"), "max_major", "max_minor",
    )


def micro_clusters(points: DataFrame, pitch: float, k_pitch: float = 2.0, margin_deg: float = 1.5, least_aspect: float = 2.0, groups: DataFrame | None = None) -> DataFrame:
    """One row for each cluster of critical points linked by steps of at most ``k_pitch`` pitches.

    cluster_id is MC and a number within the mesh and field, the largest clusters first,
    then by least vertex (``root``). Clusters of several points whose aspect reaches
    ``least_aspect`` are strings: their half axes are the farthest projections and the
    margin. The others are compact, with the angle to the farthest member and the margin
    as radius. No half axis is below half the linking distance. Columns: mesh_id, field,
    cluster_id, root, those of pooled_geometry, is_multi_cp, morphology,
    angular_radius_rad, semi_major_rad, semi_minor_rad. No points, no rows. ``groups``:
    the points' memberships at that distance, where they are known.
    """
    if pitch <= 0 or k_pitch <= 0 or least_aspect < 1:
        raise ValueError("pitch and k_pitch must be positive, least_aspect at least 1")
    reach, margin = k_pitch * pitch, margin_deg * pi / 180
    groups = cut_lineage(memberships(points, reach)) if groups is None else groups
    shapes = pooled_geometry(points.join(groups, [*KEY, "vertex_id"]), [*KEY, "root"])
    return numbered(with_axes(cut_lineage(shapes), margin, reach / 2, reach / 2, least_aspect))


def with_axes(shapes: DataFrame, margin: float, least_major: float, least_minor: float, least_aspect: float) -> DataFrame:
    """``shapes`` with is_multi_cp, morphology, angular_radius_rad and the half axes of their fitted boundary."""
    string = (F.col("n_members") > 1) & (F.col("aspect_ratio") >= least_aspect)
    radius = F.greatest(F.col("max_theta") + margin, F.lit(least_major))
    return shapes.select(
        "*", (F.col("n_members") > 1).alias("is_multi_cp"), F.when(string, "string").otherwise("compact").alias("morphology"), radius.alias("angular_radius_rad"),
        F.when(string, F.greatest(F.col("max_major") + margin, F.lit(least_major))).otherwise(radius).alias("semi_major_rad"),
        F.when(string, F.greatest(F.col("max_minor") + margin, F.lit(least_minor))).otherwise(radius).alias("semi_minor_rad"),
    )


def numbered(clusters: DataFrame) -> DataFrame:
    """``clusters`` with cluster_id, numbered per mesh and field by size, then by root; counted in pieces, so that one field may hold most of them."""
    rows = clusters.withColumn("_one", F.lit(1)).withColumn("_piece", F.struct((-F.col("n_members")).alias("n"), F.floor(F.col("root") / 4096).alias("at")))
    counted = running_total(rows, KEY, "_piece", ["root"], "_one", "_before")
    return counted.select(*KEY, F.concat(F.lit("MC"), (F.col("_before") + 1).cast("string")).alias("cluster_id"), *[c for c in clusters.columns if c not in KEY])


def boundary_centres(clusters: DataFrame) -> DataFrame:
    """Clusters as centres of rings.ring_samples: their fitted boundary about ux, uy, uz with half axes a and b along the principal axis."""
    return clusters.select(
        *KEY, F.col("cluster_id").alias("ring_id"), "ux", "uy", "uz", "px", "py", "pz",
        F.col("semi_major_rad").alias("a"), F.col("semi_minor_rad").alias("b"), F.lit(1.0).alias("sphere_radius"),
    )


def string_units(points: DataFrame, groups: DataFrame, clusters: DataFrame, pitch: float, k_bridge: float = 3.0, least_aspect: float = 2.0, margin_deg: float = 1.5) -> DataFrame:
    """Units of reduction: corridors of bridged clusters that pass the gate, and every other cluster by itself.

    ``groups`` as from memberships and ``clusters`` as from micro_clusters, both of
    ``points``. Clusters bridged within ``k_bridge`` pitches with like axes make a
    component. One of several clusters is a string if it has three points or more (two
    have no shape) and its pooled aspect reaches ``least_aspect``; a cluster that is a
    string alone is one. A component that fails is given up as a whole, and its clusters
    stand alone. Columns: mesh_id, field, unit_id, kind (string, cluster), n_clusters,
    those of pooled_geometry, angular_radius_rad, semi_major_rad, semi_minor_rad. Every
    cluster is in one unit, so the sum of indices is kept.
    """
    name = F.concat_ws("|", "mesh_id", "field", "root")
    links = spherical.bridge_links(clusters.withColumn("cluster_id", name), pitch, k_bridge).where("is_linked")
    parts = connected_groups(links.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b")))
    placed = clusters.select(*KEY, "root", "cluster_id", "morphology", name.alias("node")).join(parts.withColumnRenamed("root", "corridor"), "node", "left")
    placed = cut_lineage(placed.select(*KEY, "root", "cluster_id", "morphology", F.coalesce("corridor", "node").alias("corridor")))
    sizes = placed.groupBy("corridor").agg(F.count(F.lit(1)).alias("n_clusters"), F.bool_and(F.col("morphology") == "string").alias("_strings"))
    sizes = cut_lineage(sizes.where("n_clusters > 1 or _strings"))
    in_corridor = placed.select(*KEY, "root", "corridor").join(sizes, "corridor")
    shaped = pooled_columns(clusters)
    lone = in_corridor.where("n_clusters = 1").join(clusters.select(*KEY, "root", *shaped), [*KEY, "root"])  # pooled alone a cluster is what it was
    bridged = cut_lineage(in_corridor.where("n_clusters > 1").select(*KEY, "root", "corridor"))
    of_point = points.join(groups.join(bridged, [*KEY, "root"]), [*KEY, "vertex_id"])
    shapes = pooled_geometry(of_point, [*KEY, "corridor"]).join(sizes, "corridor").where((F.col("n_members") >= 3) & (F.col("aspect_ratio") >= least_aspect))
    columns = [*KEY, "corridor", "n_clusters", *shaped]
    strings = cut_lineage(shapes.select(*columns).unionByName(lone.select(*columns)))
    margin = margin_deg * pi / 180
    as_string = strings.select(
        *KEY, F.concat(F.lit("MS:"), "corridor").alias("unit_id"), F.lit("string").alias("kind"), "n_clusters", *shaped,
        F.greatest(F.col("max_major") + margin, F.lit(pitch)).alias("angular_radius_rad"),
        F.greatest(F.col("max_major") + margin, F.lit(pitch)).alias("semi_major_rad"), F.greatest(F.col("max_minor") + margin, F.lit(pitch / 2)).alias("semi_minor_rad"),
    )
    alone = placed.join(strings.select("corridor"), "corridor", "left_anti").select(*KEY, "root").join(clusters, [*KEY, "root"])
    as_cluster = alone.select(*KEY, F.col("cluster_id").alias("unit_id"), F.lit("cluster").alias("kind"), F.lit(1).cast("bigint").alias("n_clusters"), *shaped, "angular_radius_rad", "semi_major_rad", "semi_minor_rad")
    return as_string.unionByName(as_cluster)


def pooled_columns(df: DataFrame) -> list[str]:
    """The columns of pooled_geometry among those of ``df``."""
    own = ["n_members", "n_maxima", "n_minima", "n_saddles", "total_saddle_index", "local_euler_index", "value_max", "value_min", "ux", "uy", "uz", "max_theta", "aspect_ratio", "px", "py", "pz", "max_major", "max_minor"]
    return [c for c in df.columns if c in own]


def polarity(units: DataFrame, vertices: DataFrame, fields: DataFrame, pitch: float, unit: str = "cluster_id") -> DataFrame:
    """(mesh_id, field, unit, polarity, effective_value, slope, confidence) of every unit, by how its field changes outward.

    A field that falls outward makes a maximum (E-MAX, with the members' largest value),
    one that rises a minimum (E-MIN, the smallest). A flat slope, or none, leaves it to
    whether maxima outnumber minima, at confidence 0.5. Slopes are taken to seven decimals,
    so that rounding decides no sign.
    """
    centres = units.select(*KEY, F.col(unit).alias("entity_id"), "ux", "uy", "uz", F.col("angular_radius_rad").alias("radius"))
    slopes = spherical.radial_slope(centres, vertices, fields, pitch).select(*KEY, F.col("entity_id").alias(unit), (F.round("slope", 7) + 0.0).alias("slope"), "confidence")
    both = units.join(slopes, [*KEY, unit], "left")
    kind = spherical.slope_polarity(F.col("slope"), F.col("n_maxima"), F.col("n_minima"))
    steep = F.coalesce(F.abs("slope") > 1e-12, F.lit(False))
    return both.select(
        *KEY, unit, kind.alias("polarity"), F.when(kind == "E-MAX", F.col("value_max")).otherwise(F.col("value_min")).alias("effective_value"),
        F.coalesce("slope", F.lit(0.0)).alias("slope"), F.when(steep, F.col("confidence")).otherwise(0.5).alias("confidence"),
    )


def reduced_units(units: DataFrame, polarities: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(mesh_id, field, unit, decision, effective_value, fold_order, n_hidden, shown_index) of the units.

    Units of one point stay (SINGLE). The others are decided by their index: 0 leaves
    nothing (E-NONE), 1 an extremum of their polarity, below 0 a saddle of fold 1 - index
    with the largest value, and above 1 they stay expanded (IRREDUCIBLE).
    """
    both = units.join(polarities.select(*KEY, unit, "polarity", F.col("effective_value").alias("_value")), [*KEY, unit], "left")
    index = F.col("local_euler_index")
    decision = F.when(F.col("n_members") < 2, "SINGLE").otherwise(spherical.reduction_decision(index, F.col("polarity")))
    rows = both.withColumn("decision", decision)
    gone = ~F.col("decision").isin("SINGLE", "IRREDUCIBLE")
    return rows.select(
        *KEY, unit, "decision", F.when(F.col("decision") == "E-SAD", F.col("value_max")).when(F.col("decision").isin("E-MAX", "E-MIN"), F.col("_value")).alias("effective_value"),
        F.when(F.col("decision") == "E-SAD", 1 - index).otherwise(0).cast("int").alias("fold_order"), F.when(gone, F.col("n_members")).otherwise(0).alias("n_hidden"), index.alias("shown_index"),
    )


def stage_summary(units: DataFrame, reduced: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(mesh_id, field, n_units, n_reduced, n_annihilated, n_irreducible, n_hidden, maxima, minima, saddles, euler): the field after reduction; euler is what it was before."""
    both = units.join(reduced.select(*KEY, unit, "decision", "n_hidden"), [*KEY, unit])
    whole = F.col("decision").isin("SINGLE", "IRREDUCIBLE")
    shown = lambda n, kind: F.sum(F.when(whole, F.col(n)).otherwise((F.col("decision") == kind).cast("int")))
    return both.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("decision").isin("E-MAX", "E-MIN", "E-SAD")).alias("n_reduced"),
        F.count_if(F.col("decision") == "E-NONE").alias("n_annihilated"), F.count_if(F.col("decision") == "IRREDUCIBLE").alias("n_irreducible"), F.sum("n_hidden").alias("n_hidden"),
        shown("n_maxima", "E-MAX").alias("maxima"), shown("n_minima", "E-MIN").alias("minima"), shown("n_saddles", "E-SAD").alias("saddles"), F.sum("local_euler_index").alias("euler"),
    )


def hidden_counts(units: DataFrame, unit: str = "cluster_id") -> DataFrame:
    """(mesh_id, field, unit, n_hidden) as in reduced_units. A polarity only tells which extremum replaces a unit of index 1, so none is needed."""
    gone = (F.col("n_members") >= 2) & (F.col("local_euler_index") < 2)
    return units.select(*KEY, unit, F.when(gone, F.col("n_members")).otherwise(0).alias("n_hidden"))


def hidden_vertices(groups: DataFrame, clusters: DataFrame, reduced: DataFrame) -> DataFrame:
    """(mesh_id, field, vertex_id): the points of clusters that one effective point or none replaces."""
    gone = reduced.where("n_hidden > 0").select(*KEY, "cluster_id").join(clusters.select(*KEY, "cluster_id", "root"), [*KEY, "cluster_id"])
    return groups.join(gone.select(*KEY, "root"), [*KEY, "root"]).select(*KEY, "vertex_id")
