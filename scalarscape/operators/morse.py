"""Discrete Morse classification of fields on triangulated surfaces, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarscape.operators.mesh import unique_edges, values_by_vertex
from scalarscape.operators.windows import running_number

KEY = ["mesh_id", "field"]


def _below(tie: str, f: Column, i: Column, g: Column, j: Column, span: Column | None = None) -> Column:
    """Whether the vertex i with value f lies below the vertex j with value g.

    ``rank``: equal values are ordered by vertex. ``none``: equal values lie on neither
    side. ``literal``: v * max(span, 1) * 1e-15 is added to each value first.
    """
    if tie == "rank":
        return (f < g) | ((f == g) & (i < j))
    if tie == "none":
        return f < g
    if tie == "literal":
        e = F.greatest(span, F.lit(1.0)) * 1e-15
        return (f + i * e) < (g + j * e)
    raise ValueError(f"unknown tie mode: {tie}")


def critical_points(triangles: DataFrame, fields: DataFrame, tie: str = "rank") -> DataFrame:
    """(mesh_id, field, vertex_id, value, cp_type, multiplicity) of each minimum, maximum and saddle.

    The components of the lower and the upper part of a vertex's link decide: on each
    side they are its vertices less its edges, or one where the side is the whole link.
    Minimum: 0 below, 1 above; maximum the reverse; a saddle of multiplicity n - 1 has
    n >= 2 below; all others are regular. Link edges count once however often they
    occur, degenerate triangles and triangles with a null value are left out. Links are
    gathered once for all fields; each vertex sends its values of all fields to its
    neighbours, so a corner of a triangle is shuffled twice however many fields there are.
    """
    at = ["mesh_id", "vertex_id"]
    turns = F.array(*[F.struct(F.col(v).alias("vertex_id"), F.least(u, w).alias("u"), F.greatest(u, w).alias("w")) for v, u, w in ("abc", "bca", "cab")])
    whole = triangles.where("a <> b and b <> c and c <> a").select("mesh_id", F.inline(turns))
    links = whole.groupBy(*at).agg(F.collect_set(F.struct("u", "w")).alias("link"))
    own = values_by_vertex(fields)
    beside = F.array_distinct(F.flatten(F.transform("link", lambda e: F.array(e["u"], e["w"]))))
    sent = links.join(own.hint("merge"), at).select("mesh_id", F.col("vertex_id").alias("n"), "own", F.explode(beside).alias("vertex_id"))
    around = sent.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("n", "own"))).alias("around"))
    known = links.join(own.hint("merge"), at).join(around.hint("merge"), at)
    each = known.select(*at, "own", "around", F.inline("link")).select(*at, F.explode("own").alias("field", "value"), "u", "w", F.col("around")[F.col("u")].alias("_u"), F.col("around")[F.col("w")].alias("_w"))
    link = each.select(*KEY, "vertex_id", "value", F.col("u").alias("ui"), F.col("_u")[F.col("field")].alias("uf"), F.col("w").alias("wi"), F.col("_w")[F.col("field")].alias("wf")).where("uf is not null and wf is not null")
    span = None
    if tie == "literal":
        spans = fields.groupBy(*KEY).agg((F.max("value") - F.min("value")).alias("_span"))
        link, span = link.join(F.broadcast(spans), KEY), F.col("_span")  # a row for each field
    v, f = F.col("vertex_id"), F.col("value")
    low = {n: _below(tie, F.col(f"{n}f"), F.col(f"{n}i"), f, v, span) for n in "uw"}
    high = {n: _below(tie, f, v, F.col(f"{n}f"), F.col(f"{n}i"), span) for n in "uw"}
    ends = [F.struct(F.col(f"{n}i").alias("n"), low[n].alias("lo"), high[n].alias("hi")) for n in "uw"]
    arc = F.struct(F.lit(None).cast("bigint").alias("n"), (low["u"] & low["w"]).alias("lo"), (high["u"] & high["w"]).alias("hi"))
    who = [*KEY, "vertex_id", "value"]
    seen = link.select(*who, F.inline(F.array(*ends, arc))).groupBy(*who, "n").agg(F.count_if("lo").alias("lo"), F.count_if("hi").alias("hi"))
    node = F.col("n").isNotNull()
    counted = seen.groupBy(*who).agg(
        F.count_if(node & (F.col("lo") > 0)).alias("vl"), F.count_if(node & (F.col("hi") > 0)).alias("vh"),
        F.coalesce(F.sum(F.when(~node, F.col("lo"))), F.lit(0)).alias("el"), F.coalesce(F.sum(F.when(~node, F.col("hi"))), F.lit(0)).alias("eh"),
    )
    parts = lambda n, e: F.when((F.col(n) > 0) & (F.col(n) == F.col(e)), 1).otherwise(F.col(n) - F.col(e))
    sides = counted.select(*KEY, "vertex_id", "value", parts("vl", "el").alias("lower"), parts("vh", "eh").alias("upper"))
    kind = (
        F.when((F.col("lower") == 0) & (F.col("upper") == 1), "minimum")
        .when((F.col("upper") == 0) & (F.col("lower") == 1), "maximum")
        .when(F.col("lower") >= 2, "saddle")
    )
    return (
        sides.withColumn("cp_type", kind)
        .where("cp_type is not null")
        .select(*KEY, "vertex_id", "value", "cp_type", F.when(F.col("cp_type") == "saddle", F.col("lower") - 1).otherwise(1).cast("int").alias("multiplicity"))
    )


def summary(cps: DataFrame) -> DataFrame:
    """(mesh_id, field, n_maxima, n_minima, n_saddles, saddle_index, euler): euler = maxima + minima - summed multiplicities."""
    count = lambda kind: F.count_if(F.col("cp_type") == kind)
    index = F.coalesce(F.sum(F.when(F.col("cp_type") == "saddle", F.col("multiplicity"))), F.lit(0))
    return cps.groupBy(*KEY).agg(
        count("maximum").alias("n_maxima"),
        count("minimum").alias("n_minima"),
        count("saddle").alias("n_saddles"),
        index.alias("saddle_index"),
        (count("maximum") + count("minimum") - index).alias("euler"),
    )


def labels(cps: DataFrame) -> DataFrame:
    """Critical points with rank labels MAX1.., MIN1.., SAD1..: maxima by falling value, minima and saddles by rising value, ties by vertex."""
    order = F.when(F.col("cp_type") == "maximum", -F.col("value")).otherwise(F.col("value"))
    ranked = running_number(cps.withColumn("_order", order), [*KEY, "cp_type"], ["_order", "vertex_id"], "_rank")
    return ranked.select(*cps.columns, F.concat(F.upper(F.substring("cp_type", 1, 3)), F.col("_rank").cast("string")).alias("label"))


def adjacent_extrema(cps: DataFrame, triangles: DataFrame) -> DataFrame:
    """(mesh_id, field, cp_type, u, v): extrema of one kind that share a mesh edge, for all fields at once."""
    one = cps.where("cp_type <> 'saddle'").select(*KEY, F.col("cp_type"), F.col("vertex_id"))
    edges = unique_edges(triangles).select("mesh_id", "u", "v")
    left = one.withColumnRenamed("vertex_id", "u")
    right = one.withColumnRenamed("vertex_id", "v")
    return left.join(edges, ["mesh_id", "u"]).join(right, [*KEY, "cp_type", "v"]).select(*KEY, "cp_type", "u", "v")


def basin_centers(cps: DataFrame) -> DataFrame:
    """Extrema as basin centres, by falling value: (mesh_id, field, rank, vertex_id, polarity, value)."""
    extrema = cps.where("cp_type <> 'saddle'").withColumn("_order", -F.col("value"))
    ranked = running_number(extrema, KEY, ["_order", "vertex_id"], "rank")
    return ranked.select(*KEY, "rank", "vertex_id", F.col("cp_type").alias("polarity"), "value")
