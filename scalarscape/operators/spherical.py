"""Clusters of critical points on a sphere: proximity, corridors, clearances, polarity.

``clusters`` follow the table of that name: identity (mesh_id, field, cluster_id),
unit centroid (ux, uy, uz), principal axis (px, py, pz), half axes (semi_major_rad,
semi_minor_rad), counts by type and members. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarscape.functions import vector as V
from scalarscape.session import cut_lineage, written

CELL = 0.25  # side of the cells that block near pairs, on the unit sphere
KEY = ["mesh_id", "field"]


def distinct_clusters(clusters: DataFrame) -> DataFrame:
    """One row for each cluster_id with centroid, the latest recorded."""
    state = F.struct("recorded_at", *[c for c in clusters.columns if c not in ("cluster_id", "recorded_at")])
    newest = clusters.where("cluster_id is not null and ux is not null").groupBy("cluster_id").agg(F.max_by(state, "recorded_at").alias("s"))
    return newest.select("cluster_id", "s.*")


def composition(n_max: Column, n_sad: Column, n_min: Column, index: Column) -> Column:
    """'2 Max, 1 Sad (mult 2), 1 Min'; '0 CPs' for none."""
    sad = F.concat(n_sad.cast("string"), F.lit(" Sad"), F.when(index > n_sad, F.concat(F.lit(" (mult "), index.cast("string"), F.lit(")"))).otherwise(""))
    parts = F.concat_ws(
        ", ",
        F.when(n_max > 0, F.concat(n_max.cast("string"), F.lit(" Max"))),
        F.when(n_sad > 0, sad),
        F.when(n_min > 0, F.concat(n_min.cast("string"), F.lit(" Min"))),
    )
    return F.when(parts == "", "0 CPs").otherwise(parts)


def covered_cells(reach: Column, cell: float = CELL) -> Column:
    """The cells of a grid in space that the cap of angular radius ``reach`` about (ux, uy, uz) may touch."""
    spans = [F.sequence(F.floor((F.col(f"u{n}") - reach) / cell), F.floor((F.col(f"u{n}") + reach) / cell)) for n in "xyz"]
    return F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))


def near_pairs(clusters: DataFrame, gap: float) -> DataFrame:
    """Pairs of one mesh and field whose fitted boundaries lie at most ``gap`` radians apart, with the columns of both as a_ and b_.

    Each cluster is put into the cells its boundary, widened by half the gap, touches;
    two boundaries within the gap share a cell. So near pairs meet by an equi-join and
    the distant ones, nearly all of a mesh, are never formed. a_cluster_id < b_cluster_id.
    The index and the compositions are given where ``clusters`` have the columns.
    """
    counts = ["n_maxima", "n_saddles", "n_minima", "total_saddle_index"]
    keep = ["cluster_id", "ux", "uy", "uz", "px", "py", "pz", "semi_major_rad", "semi_minor_rad", "morphology"]
    keep += [c for c in ("local_euler_index", *counts) if c in clusters.columns]
    reach = F.greatest("semi_major_rad", "semi_minor_rad", F.lit(0.0)) + gap / 2 + 1e-9
    one = clusters.select(*KEY, *keep, reach.alias("reach"))
    one = one.select("*", *[F.floor((F.col(f"u{m}") - F.col("reach")) / CELL).alias(f"lo{m}") for m in "xyz"])
    placed = one.withColumn("cell", F.explode(covered_cells(F.col("reach"))))
    side = lambda p: placed.select(*KEY, "cell", *[F.col(c).alias(f"{p}_{c}") for c in (*keep, "reach", "lox", "loy", "loz")])
    joined = side("a").join(side("b"), [*KEY, "cell"]).where("a_cluster_id < b_cluster_id")
    for axis, n in zip("xyz", "ijk", strict=True):  # of the cells that two clusters share, their pair is met in the first
        joined = joined.where(F.col(f"cell.{n}") == F.greatest(F.col(f"a_lo{axis}"), F.col(f"b_lo{axis}")))
    ua, ub = V.vec("a_u"), V.vec("b_u")
    near = joined.withColumn("centroid_rad", V.angle(ua, ub)).where(F.col("centroid_rad") <= F.col("a_reach") + F.col("b_reach"))
    near = written(near)  # in one stage with what follows the generated code would grow too long; a cluster's columns repeat in its pairs, so the files are small
    reach_a = V.support_radius(ua, V.vec("a_p"), F.col("a_semi_major_rad"), F.col("a_semi_minor_rad"), ub)
    reach_b = V.support_radius(ub, V.vec("b_p"), F.col("b_semi_major_rad"), F.col("b_semi_minor_rad"), ua)
    measured = near.withColumn("gap_rad", F.col("centroid_rad") - reach_a - reach_b).where(F.col("gap_rad") <= gap)
    whole = set(counts) <= set(keep)
    named = [composition(*[F.col(f"{p}_{c}") for c in ("n_maxima", "n_saddles", "n_minima", "total_saddle_index")]).alias(f"{p}_composition") for p in "ab" if whole]
    return measured.select("*", *named).drop("cell", *[f"{p}_{c}" for p in "ab" for c in ("reach", "lox", "loy", "loz", *counts)])


def bridge_links(clusters: DataFrame, pitch: float, k_bridge: float = 3.0, axis_tolerance_deg: float = 30.0, bridge_all: bool = True) -> DataFrame:
    """(mesh_id, field, cluster_a, cluster_b, gap_rad, axis_angle_deg, is_linked, reason) of the pairs within the bridging gap.

    Linked: the gap between the boundaries is at most ``k_bridge`` pitches and, where both
    are strings, their axes are within the tolerance. Without ``bridge_all`` the gap is
    that between the centres, and one of the two must be a string. ``reason`` is ``linked``
    or the rule that failed. Pairs beyond the gap are not linked and have no row.
    """
    if pitch <= 0 or k_bridge <= 0:
        raise ValueError("pitch and k_bridge must be positive")
    a_string, b_string = F.col("a_morphology") == "string", F.col("b_morphology") == "string"
    if bridge_all:
        axis = F.when(a_string & b_string, V.folded_angle_deg(V.vec("a_p"), V.vec("b_p")))
        linked = axis.isNull() | (axis <= axis_tolerance_deg)
        reason = F.when(linked, "linked").otherwise(F.format_string(f"axis angle %.2f deg exceeds tolerance {axis_tolerance_deg:.2f} deg", axis))
    else:
        clusters = clusters.withColumn("semi_major_rad", F.lit(0.0)).withColumn("semi_minor_rad", F.lit(0.0))
        axis, linked = F.lit(None).cast("double"), F.coalesce(a_string | b_string, F.lit(False))
        reason = F.when(linked, "linked").otherwise("legacy rule: not linked")
    return near_pairs(clusters, k_bridge * pitch).select(
        *KEY,
        F.col("a_cluster_id").alias("cluster_a"),
        F.col("b_cluster_id").alias("cluster_b"),
        "gap_rad",
        axis.alias("axis_angle_deg"),
        linked.alias("is_linked"),
        reason.alias("reason"),
    )


def clearances(clusters: DataFrame, pitch: float, most: float = 12.0) -> DataFrame:
    """Pairs with a clearance below ``most`` pitches: separation, clearance, bearing of b from a's axis (-1: undefined), summed Euler index."""
    pairs = near_pairs(clusters, most * pitch)
    ua, ub = V.vec("a_u"), V.vec("b_u")
    bearing = V.folded_angle_deg(V.tangent_project(ub, ua), V.tangent_project(V.vec("a_p"), ua))
    return pairs.where(F.col("gap_rad") < most * pitch).select(
        *KEY,
        F.col("a_cluster_id").alias("id_a"),
        F.col("b_cluster_id").alias("id_b"),
        F.col("a_composition").alias("composition_a"),
        F.col("b_composition").alias("composition_b"),
        "centroid_rad",
        (F.col("gap_rad") / pitch).alias("gap_dtheta"),
        F.coalesce(bearing, F.lit(-1.0)).alias("bearing_a_deg"),
        (F.col("a_local_euler_index") + F.col("b_local_euler_index")).alias("chi_sum"),
    )


def clearance_histogram(clusters: DataFrame, pitch: float, width: float = 0.5, most: float = 12.0) -> DataFrame:
    """(mesh_id, field, bin, low, high, zone, n): all pairs by clearance in pitches; bin -1 below 0, the last from ``most`` on.

    The last bin is what is left of n (n - 1) / 2 pairs, so distant pairs are counted
    without being formed. Zones: overlap, intra (< 2.5), meso (< 6), macro, by the bin's centre.
    """
    n_bins = -(-int(most * 1000) // int(width * 1000))
    clusters = cut_lineage(clusters.drop("members", "ring"))  # read twice
    inside = cut_lineage(near_pairs(clusters, n_bins * width * pitch).select(*KEY, (F.col("gap_rad") / pitch).alias("gap_dtheta"))).where(F.col("gap_dtheta") < n_bins * width)
    counted = inside.groupBy(*KEY, F.when(F.col("gap_dtheta") < 0, -1).otherwise(F.floor(F.col("gap_dtheta") / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = clusters.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    frame = groups.withColumn("bin", F.explode(F.sequence(F.lit(-1), F.lit(n_bins))))
    filled = frame.join(counted, [*KEY, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = counted.groupBy(*KEY).agg(F.sum("n").alias("_known"))
    whole = filled.join(known, KEY, "left")
    rest = F.col("_n") * (F.col("_n") - 1) / 2 - F.coalesce("_known", F.lit(0))
    low, high = F.when(F.col("bin") >= 0, F.col("bin") * width), F.when(F.col("bin") < 0, 0.0).when(F.col("bin") < n_bins, (F.col("bin") + 1) * width)
    centre = F.coalesce((low + high) / 2, low)
    zone = F.when(F.col("bin") < 0, "overlap").when(centre < 2.5, "intra").when(centre < 6.0, "meso").otherwise("macro")
    return whole.select(*KEY, "bin", low.alias("low"), high.alias("high"), zone.alias("zone"), F.when(F.col("bin") == n_bins, rest).otherwise(F.col("n")).cast("bigint").alias("n"))


def group_geometry(clusters: DataFrame, group: list[str], radius: float = 1.0) -> DataFrame:
    """Geometry of clusters pooled by ``group``: members deduplicated by vertex, counts, Euler index, tangent PCA and morphology.

    The tangent plane stands at the normalised mean direction; directions are mapped to it
    along great circles, and population covariance gives the half axes (largest projections
    about the mean) and the aspect. Groups of fewer than two members have aspect 1.
    """
    members = clusters.select(*group, F.explode("members").alias("m")).select(*group, "m.*").dropDuplicates([*group, "vertex_id"])
    unit = V.unit(V.vec(""))
    units = members.select(*group, "vertex_id", "cp_type", "multiplicity", *[c.alias(f"u{n}") for c, n in zip(unit, "xyz", strict=True)])
    centre = units.groupBy(*group).agg(*[F.avg(f"u{n}").alias(f"m{n}") for n in "xyz"])
    c = V.unit(V.vec("m"))
    centre = centre.select(*group, *[x.alias(f"c{n}") for x, n in zip(c, "xyz", strict=True)])
    t1, t2 = V.tangent_basis(V.vec("c"))
    joined = units.join(centre, group).select(
        "*", *[x.alias(f"s{n}") for x, n in zip(t1, "xyz", strict=True)], *[x.alias(f"t{n}") for x, n in zip(t2, "xyz", strict=True)]
    )
    theta = V.angle(V.vec("u"), V.vec("c"))
    flat = V.unit(V.tangent_project(V.vec("u"), V.vec("c")), 1e-12)
    mapped = joined.select(
        *group, "cp_type", "multiplicity", theta.alias("theta"),
        F.coalesce(theta * V.dot(flat, V.vec("s")), F.lit(0.0)).alias("p"),
        F.coalesce(theta * V.dot(flat, V.vec("t")), F.lit(0.0)).alias("q"),
    )
    sums = mapped.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.count_if(F.col("cp_type") == "maximum").alias("n_maxima"),
        F.count_if(F.col("cp_type") == "minimum").alias("n_minima"),
        F.coalesce(F.sum(F.when(F.col("cp_type") == "saddle", F.col("multiplicity"))), F.lit(0)).alias("saddle_index"),
        F.max("theta").alias("max_theta"),
        F.var_pop("p").alias("spp"), F.var_pop("q").alias("sqq"), F.covar_pop("p", "q").alias("spq"),
    )
    half, root = (F.col("spp") + F.col("sqq")) / 2, F.sqrt(F.pow((F.col("spp") - F.col("sqq")) / 2, 2) + F.pow("spq", 2))
    aspect = F.when(F.col("n_members") < 2, 1.0).otherwise(F.sqrt((half + root) / F.greatest(half - root, F.lit(1e-16))))
    return sums.select(
        *group, "n_members", "n_maxima", "n_minima", "saddle_index",
        (F.col("n_maxima") + F.col("n_minima") - F.col("saddle_index")).alias("euler_index"),
        (F.col("max_theta") * radius).alias("reach"),
        F.least(aspect, F.lit(999.0)).alias("aspect_ratio"),
        F.when(F.col("n_members") < 2, "point").when(aspect >= 2.0, "string").otherwise("compact").alias("morphology"),
    )


def reduction_decision(euler: Column, polarity: Column) -> Column:
    """What replaces a cluster: nothing at index 0, an extremum of its polarity at 1, a saddle below, and none above."""
    return (
        F.when(euler == 0, "E-NONE").when(euler == 1, polarity).when(euler <= -1, "E-SAD").when(euler >= 2, "IRREDUCIBLE")
    )


def count_polarity(n_max: Column, n_min: Column) -> Column:
    return F.when(n_max > n_min, "E-MAX").otherwise("E-MIN")


def slope_polarity(slope: Column, n_max: Column, n_min: Column) -> Column:
    """A field that falls outward makes a maximum, one that rises a minimum; a flat or unknown slope leaves it to the counts."""
    return F.when(slope < -1e-12, "E-MAX").when((slope > 1e-12) & ~F.isnan(slope), "E-MIN").otherwise(count_polarity(n_max, n_min))


def reduction(clusters: DataFrame, slopes: DataFrame | None = None) -> DataFrame:
    """(mesh_id, field, cluster_id, decision, effective_value, n_hidden, shown_index): clusters of several points reduced to at most one.

    ``slopes``: mesh_id, field, cluster_id, slope, one row for each cluster at most, as from
    cluster_slopes; they decide the polarity at index 1, the counts only where a slope is
    flat or absent. The value of a maximum or a saddle is the largest of the members', that of a minimum
    the smallest. One-member clusters stay. Hidden members are those of clusters that are
    reduced; the index shown is preserved.
    """
    values = F.transform("members", lambda m: m["value"])
    polarity = count_polarity(F.col("n_maxima"), F.col("n_minima"))
    if slopes is not None:
        clusters = clusters.drop("_slope").join(slopes.select(*KEY, "cluster_id", F.col("slope").alias("_slope")), [*KEY, "cluster_id"], "left")
        polarity = slope_polarity(F.col("_slope"), F.col("n_maxima"), F.col("n_minima"))
    decision = F.when(F.size("members") < 2, "SINGLE").otherwise(reduction_decision(F.col("local_euler_index"), polarity))
    rows = clusters.withColumn("decision", decision)
    reduced = F.col("decision").isin("E-NONE", "E-MAX", "E-MIN", "E-SAD")
    return rows.select(
        *KEY, "cluster_id", "decision",
        F.when(F.col("decision").isin("E-MAX", "E-SAD"), F.array_max(values)).when(F.col("decision") == "E-MIN", F.array_min(values)).alias("effective_value"),
        F.when(reduced, F.size("members")).otherwise(0).alias("n_hidden"),
        F.col("local_euler_index").alias("shown_index"),
    )


def radial_slope(centres: DataFrame, vertices: DataFrame, fields: DataFrame, pitch: float, cell: float = CELL) -> DataFrame:
    """(mesh_id, field, entity_id, n, slope, confidence): how a field changes outward of each centre.

    ``centres``: mesh_id, field, entity_id, ux, uy, uz, radius. The annulus runs from
    max(radius, pitch) over two pitches; where it holds fewer than three vertices, all
    within max(1.5 outer, inner + 0.05) count. slope = sample covariance of value and
    angle over the population variance of the angle. confidence 0.95 if the outer half's
    mean less the inner half's agrees in sign, 0.5 if the slope is nil, else 0.7; 0.8 if
    a half is empty; fewer than two vertices give (0, 0). Vertices meet centres by cells.
    """
    placed = annulus(centres, pitch)
    spread = placed.withColumn("cell", F.explode(covered_cells(F.col("broad") + 1e-9, cell)))
    unit = V.unit(V.vec(""))
    points = vertices.select("mesh_id", "vertex_id", *[u.alias(f"v{n}") for u, n in zip(unit, "xyz", strict=True)])
    points = points.withColumn("cell", F.struct(*[F.floor(F.col(f"v{n}") / cell).alias(k) for n, k in zip("xyz", "ijk", strict=True)]))
    near = spread.join(points.hint("merge"), ["mesh_id", "cell"]).withColumn("theta", V.angle(V.vec("u"), V.vec("v"))).where("theta <= broad")
    valued = near.join(fields.hint("merge"), ["mesh_id", "field", "vertex_id"]).withColumn("ring", F.col("theta").between(F.col("inner"), F.col("outer")))
    who = ["mesh_id", "field", "entity_id"]
    enough = valued.groupBy(*who).agg((F.count_if("ring") >= 3).alias("narrow"))
    used = valued.join(enough, who).where("ring or not narrow")
    middle = used.groupBy(*who).agg(F.percentile("theta", F.lit(0.5)).alias("middle"))
    got = used.join(middle, who).groupBy(*who).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp("value", "theta").alias("cov"),
        F.var_pop("theta").alias("var"),
        F.avg(F.when(F.col("theta") <= F.col("middle") + 1e-9, F.col("value"))).alias("a"),
        F.avg(F.when(F.col("theta") > F.col("middle") + 1e-9, F.col("value"))).alias("b"),
    )
    return slope_columns(got, who)


def annulus(centres: DataFrame, pitch: float) -> DataFrame:
    """``centres`` with the radii between which their slope is taken, and the broad one where there are too few vertices."""
    placed = centres.withColumn("inner", F.greatest(F.col("radius"), F.lit(pitch))).withColumn("outer", F.col("inner") + 2 * pitch)
    return placed.withColumn("broad", F.greatest(F.col("outer") * 1.5, F.col("inner") + 0.05))


def slope_columns(got: DataFrame, who: list[str]) -> DataFrame:
    """(who, n, slope, confidence) of n, the sample covariance, the population variance and the means of the inner and the outer half."""
    slope = F.when(F.col("n") < 2, 0.0).when(F.col("var") < 1e-12, 0.0).otherwise(F.col("cov") / F.col("var"))
    diff = F.col("b") - F.col("a")
    confidence = (
        F.when(F.col("n") < 2, 0.0)
        .when(diff.isNull(), 0.8)
        .when(F.abs(slope) < 1e-9, 0.5)  # first, so that rounding decides no sign
        .when(((diff > 0) & (slope > 0)) | ((diff < 0) & (slope < 0)), 0.95)
        .otherwise(0.7)
    )
    return got.select(*who, "n", slope.alias("slope"), confidence.alias("confidence"))


def cluster_slopes(clusters: DataFrame, vertices: DataFrame, fields: DataFrame, pitch: float) -> DataFrame:
    """(mesh_id, field, cluster_id, n, slope, confidence): radial_slope outward of the clusters of index 1 and several members, the only ones whose polarity is asked."""
    asked = clusters.where("local_euler_index = 1 and size(members) >= 2")
    centres = asked.select(*KEY, F.col("cluster_id").alias("entity_id"), "ux", "uy", "uz", F.col("angular_radius_rad").alias("radius"))
    return radial_slope(centres, vertices, fields, pitch).withColumnRenamed("entity_id", "cluster_id")


def display_counts(clusters: DataFrame, slopes: DataFrame | None = None) -> DataFrame:
    """(mesh_id, field, maxima, minima, saddles, euler): what is shown after reduction, with its ``slopes``.

    Clusters that stay whole show their members, reduced ones their effective point; the
    Euler index is the sum of the clusters' own, so reduction preserves it.
    """
    rows = clusters.join(reduction(clusters, slopes).select("cluster_id", "decision"), "cluster_id")
    whole = F.col("decision").isin("SINGLE", "IRREDUCIBLE")
    shown = lambda n, effective: F.sum(F.when(whole, F.col(n)).otherwise((F.col("decision") == effective).cast("int")))
    return rows.groupBy(*KEY).agg(
        shown("n_maxima", "E-MAX").alias("maxima"), shown("n_minima", "E-MIN").alias("minima"), shown("n_saddles", "E-SAD").alias("saddles"),
        F.sum("local_euler_index").alias("euler"),
    )


def nearest_cluster(points: DataFrame, clusters: DataFrame, within: float) -> DataFrame:
    """(point_id, cluster_id, theta): the cluster of the point's mesh and field nearest to it, if one lies within ``within`` radians.

    ``points``: mesh_id, field, point_id, ux, uy, uz. Ties go to the smaller cluster_id.
    """
    p = points.withColumn("cell", F.explode(covered_cells(F.lit(within))))
    c = clusters.select(*KEY, "cluster_id", *[F.col(f"u{n}").alias(f"c{n}") for n in "xyz"])
    c = c.withColumn("cell", F.struct(*[F.floor(F.col(f"c{n}") / CELL).alias(k) for n, k in zip("xyz", "ijk", strict=True)]))
    near = p.join(c, [*KEY, "cell"]).withColumn("theta", V.angle(V.vec("u"), V.vec("c"))).where(F.col("theta") <= within)
    best = near.groupBy("point_id").agg(F.min(F.struct("theta", "cluster_id")).alias("b"))
    return best.select("point_id", "b.cluster_id", "b.theta")
