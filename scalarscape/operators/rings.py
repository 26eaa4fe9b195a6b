"""Closed profiles: rings of samples around a centre, their ports, crossings and harmonics.

``rings``: ring_id, k (0..n-1), n, phi, value. A ring is at most a few hundred samples,
so windows by ring_id are small; parallelism is over rings.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scalarscape.functions import vector as V
from scalarscape.operators.nearest import nearest


def in_order() -> WindowSpec:
    return Window.partitionBy("ring_id").orderBy("k")


def whole_ring() -> WindowSpec:
    return Window.partitionBy("ring_id")


def named(v: V.Vec, prefix: str) -> list[Column]:
    """A vector as the columns ``<prefix>x``, ``<prefix>y``, ``<prefix>z``."""
    return [c.alias(f"{prefix}{n}") for c, n in zip(v, "xyz", strict=True)]


def _around(name: str, by: int) -> Column:
    """The value ``by`` samples on (negative: back), across the seam of the ring."""
    near = F.lead(name, by).over(in_order()) if by > 0 else F.lag(name, -by).over(in_order())
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrapped = F.nth_value(name, by).over(whole) if by > 0 else F.first(name).over(Window.partitionBy("ring_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(near, wrapped)


def ring_samples(centres: DataFrame, n: int, legacy: bool = False) -> DataFrame:
    """(mesh_id and field where given, ring_id, k, n, phi, x, y, z): ``n`` samples of the circle or ellipse about each unit centre.

    ``centres``: ring_id, ux, uy, uz, a, b (half axes in radians), sphere_radius. With
    a = b it is a circle in the tangent basis at the centre. With px, py, pz the half
    axis a lies along that vector's tangent part.
    """
    c = V.vec("u")
    t1, _ = V.tangent_basis(c, legacy)
    if "px" in centres.columns:
        t1 = tuple(F.coalesce(x, y) for x, y in zip(V.unit(V.tangent_project(V.vec("p"), c), 1e-9), t1, strict=True))
    based = centres.select("*", *named(t1, "s"))
    based = based.select("*", *named(V.cross(c, V.vec("s")), "t"))
    spread = based.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("phi", 2 * pi * F.col("k") / n)
    spread = spread.withColumn("_r", V.ellipse_radius(F.col("a"), F.col("b"), F.col("phi")))
    ring = V.plus(V.scaled(V.vec("s"), F.cos("phi")), V.scaled(V.vec("t"), F.sin("phi")))
    p = V.plus(V.scaled(c, F.cos("_r")), V.scaled(ring, F.sin("_r")))
    keep = [c for c in ("mesh_id", "field") if c in centres.columns]
    return spread.select(*keep, "ring_id", "k", F.lit(n).alias("n"), "phi", *[(x * F.col("sphere_radius")).alias(m) for x, m in zip(p, "xyz", strict=True)])


def ring_frame(ring: DataFrame) -> DataFrame:
    """(mesh_id and field where given, ring_id, n, cx, cy, cz, angular_radius) of rings of four samples or more: normalised mean direction and mean angle to it. A ring's samples are added up where they are made."""
    u = V.unit(V.vec(""))
    key = [c for c in ("mesh_id", "field", "ring_id") if c in ring.columns]
    units = ring.select(*key, *[x.alias(f"u{m}") for x, m in zip(u, "xyz", strict=True)])
    mean = units.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"u{m}").alias(f"m{m}") for m in "xyz"]).where("n >= 4")
    c = V.unit(V.vec("m"))
    cosine = V.dot(V.vec("m"), c)  # the mean of the products with the centre is the mean's own
    return mean.select(*key, "n", *named(c, "c"), F.acos(V.clipped(cosine)).alias("angular_radius"))


def nearest_vertices(samples: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(mesh_id, field where given, ring_id, k, vertex_id, theta, rank): the ``k`` mesh vertices nearest to each sample, all where a mesh has fewer; ties (within 1e-9) go to the smaller vertex_id."""
    key = [c for c in ("mesh_id", "field", "ring_id", "k") if c in samples.columns]
    ranked = nearest(samples, vertices, k).select(*key, F.posexplode("best").alias("rank", "b"))
    return ranked.select(*key, "b.vertex_id", "b.theta", (F.col("rank") + 1).alias("rank"))


def interpolate(samples: DataFrame, vertices: DataFrame, fields: DataFrame, k: int = 4, power: float = 2.0, snap: float = 1e-7) -> DataFrame:
    """(mesh_id, field, ring_id, k, value): inverse-distance weights of the k nearest vertices; a vertex within ``snap`` gives its value.

    Samples with a field take its values, those without one the values of every field.
    """
    if "field" not in samples.columns:
        samples = samples.join(fields.select("mesh_id", "field").distinct(), "mesh_id")
    near = nearest(samples, vertices, k, fields).withColumn("best", F.filter("best", lambda b: b["value"].isNotNull())).where("size(best) > 0")
    weight = lambda b: 1 / F.pow(F.greatest(b["theta"], F.lit(snap)), power)
    total = lambda f: F.aggregate(F.transform("best", f), F.lit(0.0), lambda a, x: a + x)
    least, mean = F.array_min(F.transform("best", lambda b: b["theta"])), total(lambda b: weight(b) * b["value"]) / total(weight)
    return near.select("mesh_id", "field", "ring_id", "k", F.when(least < snap, F.col("best")[0]["value"]).otherwise(mean).alias("value"))


def smoothed(rings: DataFrame, window: int = 3) -> DataFrame:
    """Rings with ``smooth``: the periodic mean of an odd ``window`` of samples; rings no longer than the window stay as they are."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    terms = [F.col("value")] + [_around("value", s * d) for d in range(1, half + 1) for s in (1, -1)]
    total = sum(terms[1:], terms[0])
    return rings.withColumn("smooth", F.when(F.col("n") > window, total / window).otherwise(F.col("value")))


def extrema(rings: DataFrame) -> DataFrame:
    """Smoothed rings with ``kind``: valley (below the sample before, not above the next), ridge (the reverse) or null; plateaus count at their first sample."""
    s = rings.withColumn("_before", _around("smooth", -1)).withColumn("_after", _around("smooth", 1))
    kind = F.when((F.col("smooth") < F.col("_before")) & (F.col("smooth") <= F.col("_after")), "valley").when(
        (F.col("smooth") > F.col("_before")) & (F.col("smooth") >= F.col("_after")), "ridge"
    )
    return s.withColumn("kind", kind)


def ports(rings: DataFrame, window: int = 3, prominence: float = 0.05) -> DataFrame:
    """(ring_id, port_id, kind, k, phi, phi_refined, value) of the prominent extrema of rings of four samples or more.

    A valley's height is measured to the ring's highest ridge, a ridge's to its lowest
    valley; it must reach ``prominence`` of the ring's span. phi_refined lies at the vertex
    of the parabola through the three samples, at most one sample off. Ids count along phi.
    """
    e = extrema(smoothed(rings.where("n >= 4"), window))
    span = F.max("value").over(whole_ring()) - F.min("value").over(whole_ring())
    top = F.max(F.when(F.col("kind") == "ridge", F.col("smooth"))).over(whole_ring())
    floor = F.min(F.when(F.col("kind") == "valley", F.col("smooth"))).over(whole_ring())
    least = F.greatest(span * prominence, F.lit(1e-12))
    height = F.when(F.col("kind") == "valley", top - F.col("smooth")).otherwise(F.col("smooth") - floor)
    kept = e.withColumn("_keep", height.isNull() | (height >= least) | (span < 1e-12)).where("kind is not null and _keep")
    step = 2 * pi / F.col("n")
    den = F.col("_before") - 2 * F.col("smooth") + F.col("_after")
    shift = F.when(F.abs(den) < 1e-300, 0.0).otherwise(0.5 * step * (F.col("_before") - F.col("_after")) / den)
    shift = F.greatest(-step, F.least(step, shift))
    number = F.row_number().over(Window.partitionBy("ring_id", "kind").orderBy("k"))
    prefix = F.when(F.col("kind") == "valley", "VPORT_").otherwise("RPORT_")
    return kept.select("ring_id", F.concat(prefix, number.cast("string")).alias("port_id"), "kind", "k", "phi", (F.col("phi") + shift).alias("phi_refined"), "value")


def boundary_balance(rings: DataFrame, found: DataFrame) -> DataFrame:
    """(ring_id, n_valleys, n_ridges, balanced, fold, euler): balanced if equal and positive; fold k then, else the larger; euler = 1 - fold, 1 without ports."""
    counts = found.groupBy("ring_id").agg(F.count_if(F.col("kind") == "valley").alias("v"), F.count_if(F.col("kind") == "ridge").alias("r"))
    got = rings.select("ring_id").distinct().join(counts, "ring_id", "left")
    v, r = F.coalesce("v", F.lit(0)), F.coalesce("r", F.lit(0))
    fold = F.greatest(v, r)
    return got.select("ring_id", v.alias("n_valleys"), r.alias("n_ridges"), ((v == r) & (v > 0)).alias("balanced"), fold.alias("fold"), F.when(fold > 0, 1 - fold).otherwise(1).alias("euler"))


def alternates(found: DataFrame) -> DataFrame:
    """(ring_id, n_ports, alternating): whether valleys and ridges strictly alternate around the ring."""
    order = Window.partitionBy("ring_id").orderBy("k")
    whole = Window.partitionBy("ring_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("kind").over(order), F.first("kind").over(whole))
    return found.withColumn("_before", before).groupBy("ring_id").agg(F.count(F.lit(1)).alias("n_ports"), F.bool_and(F.col("kind") != F.col("_before")).alias("alternating"))


def level_crossings(rings: DataFrame, level: Column) -> DataFrame:
    """(ring_id, k, phi): where the profile crosses ``level`` between sample k and the next, linearly; values at the level count as above."""
    s = rings.withColumn("_level", level).withColumn("_next", _around("value", 1))
    above, after = F.col("value") >= F.col("_level"), F.col("_next") >= F.col("_level")
    t = (F.col("_level") - F.col("value")) / (F.col("_next") - F.col("value"))
    return s.where(above != after).select("ring_id", "k", V.azimuth(F.col("phi") + t * 2 * pi / F.col("n")).alias("phi"))


def sector_means(rings: DataFrame, found: DataFrame, crossings: DataFrame) -> DataFrame:
    """(ring_id, port_id, lo, hi, mean): the sector between the crossings beside each port, and the mean of the samples in it."""
    c = crossings.select("ring_id", F.col("phi").alias("c"))
    arcs = found.join(c, "ring_id").select(
        "ring_id", "port_id", F.col("phi").alias("p"), V.azimuth(F.col("c") - F.col("phi")).alias("ahead"), V.azimuth(F.col("phi") - F.col("c")).alias("behind")
    )
    bounds = arcs.groupBy("ring_id", "port_id", "p").agg(F.min("ahead").alias("hi"), F.min("behind").alias("lo"))
    inside = bounds.join(rings.select("ring_id", F.col("phi").alias("s"), "value"), "ring_id")
    inside = inside.where((V.azimuth(F.col("s") - F.col("p")) <= F.col("hi")) | (V.azimuth(F.col("p") - F.col("s")) <= F.col("lo")))
    return inside.groupBy("ring_id", "port_id").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.avg("value").alias("mean"))


def harmonic_power(rings: DataFrame, most: int) -> DataFrame:
    """(ring_id, bin, power) for the bins 1..``most`` of the one-sided spectrum: squared modulus of the discrete Fourier sum."""
    spread = rings.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(most)))).where("bin <= n / 2")
    arg = 2 * pi * F.col("bin") * F.col("k") / F.col("n")
    got = spread.groupBy("ring_id", "bin").agg(F.sum(F.col("value") * F.cos(arg)).alias("re"), F.sum(F.col("value") * F.sin(arg)).alias("im"))
    return got.select("ring_id", "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def symmetry_energy(rings: DataFrame, fold: int) -> DataFrame:
    """(ring_id, energy): 1 - power of bin ``fold`` over the power of all bins but 0, at least 0; the variance for fold 0 or beyond the spectrum, 0 for a constant ring."""
    stats = rings.groupBy("ring_id").agg(F.var_pop("value").alias("variance"), F.first("n").alias("n"))
    most = rings.agg(F.max("n")).first()[0] or 2
    power = harmonic_power(rings, most // 2).groupBy("ring_id").agg(F.sum("power").alias("total"), F.sum(F.when(F.col("bin") == fold, F.col("power"))).alias("own"))
    got = stats.join(power, "ring_id", "left")
    energy = (
        F.when((F.lit(fold) == 0) | (F.lit(fold) > F.col("n") / 2), F.col("variance"))
        .when(F.col("total") <= 1e-12, 0.0)
        .otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("own", F.lit(0.0)) / F.col("total")))
    )
    return got.select("ring_id", energy.alias("energy"))


def port_spacing_energy(found: DataFrame, ideal_deg: float = 60.0) -> DataFrame:
    """(ring_id, energy): summed squared deviation of the gaps between successive ports from the ideal, 1e6 where they do not alternate or their number is not 360 / ideal."""
    order = Window.partitionBy("ring_id").orderBy("k")
    first = F.first("phi").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.degrees(V.azimuth(F.coalesce(F.lead("phi").over(order), first) - F.col("phi")))
    sums = found.withColumn("gap", gap).groupBy("ring_id").agg(F.sum(F.pow(F.col("gap") - ideal_deg, 2)).alias("e"), F.count(F.lit(1)).alias("n"))
    both = sums.join(alternates(found).select("ring_id", "alternating"), "ring_id")
    return both.select("ring_id", F.when((F.col("n") != round(360 / ideal_deg)) | ~F.col("alternating"), 1e6).otherwise(F.col("e")).alias("energy"))


def perfected_ports(found: DataFrame, fold: int) -> DataFrame:
    """Ports moved to equal spacing: per ring and kind with exactly ``fold`` (>= 2) ports, at the circular mean phase; ids get _PERF."""
    group = Window.partitionBy("ring_id", "kind")
    s, c = F.sum(F.sin(fold * F.col("phi"))).over(group), F.sum(F.cos(fold * F.col("phi"))).over(group)
    number = F.row_number().over(group.orderBy("phi")) - 1
    own = F.count(F.lit(1)).over(group) == fold if fold >= 2 else F.lit(False)
    phase = V.azimuth(F.atan2(s, c)) / fold
    return found.select(
        "ring_id", "kind",
        F.when(own, F.concat("port_id", F.lit("_PERF"))).otherwise(F.col("port_id")).alias("port_id"),
        F.when(own, V.azimuth(phase + 2 * pi * number / fold)).otherwise(F.col("phi")).alias("phi"),
    )
