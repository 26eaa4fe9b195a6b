"""Higher-order saddles: pairs and stars of saddles that stand for one, and the search for their rings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, asin, cos, degrees, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from scalarscape.functions import vector as V
from scalarscape.operators import around, rings
from scalarscape.operators.graph import greedy_matching
from scalarscape.operators.spherical import CELL, covered_cells
from scalarscape.session import cut_lineage, discard, written

KEY = ["mesh_id", "field"]
CLIMBING, NUDGED = 2048, 256  # centres whose samples are held at once
AT_ONCE = 100_000  # cores of a mesh and field that one task works through
PAIR_PITCHES, PAIR_FLOOR_DEG, CORE_RATIO, MIDPOINT_MARGIN_DEG = 5.0, 16.0, 1.8, 1.5


def _cells(df: DataFrame, reach: float) -> DataFrame:
    return df.withColumn("cell", F.explode(covered_cells(F.lit(reach))))


def saddle_pair_candidates(points: DataFrame, spans: DataFrame, pitch_deg: float, barrier_tolerance: float = 0.005) -> DataFrame:
    """(mesh_id, field, a, b, separation_deg, barrier): saddles near each other with nothing between.

    ``points``: mesh_id, field, vertex_id, cp_type, value, ux, uy, uz. The separation is
    at most max(5 pitches, 16 degrees), the difference of values at most the tolerance
    times the field's span; no extremum lies within half the separation and 1.5 degrees
    of the midpoint; the nearest extremum of either is at least 1.8 separations away.
    Points meet by cells, so distant pairs are never formed.
    """
    limit = max(PAIR_PITCHES * pitch_deg, PAIR_FLOOR_DEG)
    reach = limit * pi / 180
    extrema = points.where("cp_type <> 'saddle'").select(*KEY, F.col("ux").alias("ex"), F.col("uy").alias("ey"), F.col("uz").alias("ez"))
    saddles = points.where("cp_type = 'saddle'").select(*KEY, "vertex_id", "value", "ux", "uy", "uz")
    nearest = nearest_extremum(saddles, extrema, CORE_RATIO * limit).hint("merge")
    saddles = saddles.join(nearest, [*KEY, "vertex_id"], "left").join(spans.select(*KEY, "span"), KEY)
    most = F.least(F.lit(limit), F.coalesce(F.col("nearest") / CORE_RATIO, F.lit(limit)) + 1e-6)  # degrees to the farthest saddle that it may be paired with
    half, wide = F.radians(most) / 2 + 1e-9, 2 * reach  # most saddles lie in one or two such cells
    lows = [F.floor((F.col(f"u{n}") - half) / wide).alias(f"lo{n}") for n in "xyz"]
    cells = saddles.select(*KEY, "vertex_id", "value", "span", "nearest", "ux", "uy", "uz", *lows, F.explode(covered_cells(half, wide)).alias("cell"))
    side = lambda p: cells.select(*KEY, "cell", *[F.col(c).alias(f"{p}_{c}") for c in ("vertex_id", "value", "span", "nearest", "ux", "uy", "uz", "lox", "loy", "loz")])
    met = side("a").join(side("b").hint("merge"), [*KEY, "cell"]).where("a_vertex_id < b_vertex_id")
    for axis, n in zip("xyz", "ijk", strict=True):  # of the cells that two saddles share, they meet in the first
        met = met.where(F.col(f"cell.{n}") == F.greatest(F.col(f"a_lo{axis}"), F.col(f"b_lo{axis}")))
    barrier = F.abs(F.col("a_value") - F.col("b_value")) / F.greatest("a_span", "b_span", F.lit(1e-12))
    met = met.withColumn("barrier", barrier).where(F.col("barrier") <= barrier_tolerance)
    met = met.withColumn("separation_deg", V.separation_deg(V.vec("a_u"), V.vec("b_u"))).where(F.col("separation_deg").between(1e-9, limit))
    near = met.where(~F.coalesce(F.least("a_nearest", "b_nearest") < CORE_RATIO * F.col("separation_deg"), F.lit(False)))
    near = written(near.select(*KEY, "a_vertex_id", "b_vertex_id", "separation_deg", "barrier", *[f"{p}_u{n}" for p in "ab" for n in "xyz"]))
    # an extremum that is 1.8 separations from both lies between them only where the margin is the greater part
    close = near.where(F.col("separation_deg") <= MIDPOINT_MARGIN_DEG / (CORE_RATIO - 1) + 1e-6)
    close = close.select(*KEY, "a_vertex_id", "b_vertex_id", "separation_deg", *rings.named(V.unit(V.plus(V.vec("a_u"), V.vec("b_u"))), "u"))
    wide = (MIDPOINT_MARGIN_DEG / (CORE_RATIO - 1) / 2 + MIDPOINT_MARGIN_DEG) * pi / 180 + 1e-6
    at = extrema.withColumn("cell", F.struct(*[F.floor(F.col(f"e{n}") / CELL).alias(k) for n, k in zip("xyz", "ijk", strict=True)]))
    between = V.separation_deg(V.vec("u"), V.vec("e")) < F.col("separation_deg") / 2 + MIDPOINT_MARGIN_DEG
    blocked = _cells(close, wide).join(at.hint("merge"), [*KEY, "cell"]).where(between).select(*KEY, "a_vertex_id", "b_vertex_id").distinct()
    free = near.join(blocked, [*KEY, "a_vertex_id", "b_vertex_id"], "left_anti").dropDuplicates([*KEY, "a_vertex_id", "b_vertex_id"])
    return free.select(*KEY, F.col("a_vertex_id").alias("a"), F.col("b_vertex_id").alias("b"), "separation_deg", "barrier")


def nearest_extremum(saddles: DataFrame, extrema: DataFrame, limit_deg: float) -> DataFrame:
    """(mesh_id, field, vertex_id, nearest): degrees from each saddle to the nearest extremum of its mesh and field; saddles without one within ``limit_deg`` have no row.

    Saddles look nearby first and only those that find none look as far as the limit, so
    a dense mesh is not measured against all its extrema.
    """
    left = saddles.select(*KEY, "vertex_id", "ux", "uy", "uz")
    furthest = 2 * sin(min(limit_deg * pi / 180, pi) / 2) * (1 + 1e-9)
    found = []
    for radius in (furthest / 32, furthest):
        side = 8 * radius  # most of the balls lie in one cell
        at = extrema.select("*", F.struct(*[F.floor(F.col(f"e{n}") / side).alias(k) for n, k in zip("xyz", "ijk", strict=True)]).alias("cell"))
        met = left.withColumn("cell", F.explode(covered_cells(F.lit(radius), side))).join(at.hint("merge"), [*KEY, "cell"])
        reached = 2 * degrees(asin(min(1.0, radius / 2)))
        got = written(met.groupBy(*KEY, "vertex_id").agg(F.min(V.separation_deg(V.vec("u"), V.vec("e"))).alias("nearest")).where(F.col("nearest") <= reached))
        found.append(got)
        left = left.join(got.hint("merge"), [*KEY, "vertex_id"], "left_anti")
    return reduce(DataFrame.unionByName, found)


def saddle_pairs(candidates: DataFrame) -> DataFrame:
    """(mesh_id, field, a, b, separation_deg): candidates taken tightest first, each saddle once."""
    node = lambda c: F.struct("mesh_id", "field", F.col(c).alias("v")).alias(c)
    taken = greedy_matching(candidates.select(node("a"), node("b"), F.col("separation_deg").alias("w")))
    return taken.select("a.mesh_id", "a.field", F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.col("w").alias("separation_deg"))


def launch_requests(saddles: DataFrame, hidden: DataFrame, effective: DataFrame, pitch: float, k_pitch: float = 2.0) -> DataFrame:
    """(mesh_id, field, entity_id, ux, uy, uz, expected, a0): every saddle that is shown, with the fold its ring should have and the radius to begin with.

    ``saddles``: mesh_id, field, vertex_id, multiplicity, ux, uy, uz; those in ``hidden``
    (mesh_id, field, vertex_id) have been replaced. ``effective``: mesh_id, field, unit_id,
    fold_order, ux, uy, uz, angular_radius_rad of the effective saddles, which begin at their
    own radius. The others begin at 1.5 degrees or half the clustering distance.
    """
    lone = max(1.5 * pi / 180, k_pitch * pitch / 2)
    shown = saddles.join(hidden, [*KEY, "vertex_id"], "left_anti")
    raw = shown.select(*KEY, F.concat(F.lit("SAD_"), F.col("vertex_id").cast("string")).alias("entity_id"), "ux", "uy", "uz", (F.col("multiplicity") + 1).cast("int").alias("expected"), F.lit(lone).alias("a0"))
    whole = effective.select(*KEY, F.concat(F.lit("E-SAD_"), "unit_id").alias("entity_id"), "ux", "uy", "uz", F.col("fold_order").cast("int").alias("expected"), F.coalesce("angular_radius_rad", F.lit(lone)).alias("a0"))
    return raw.unionByName(whole)


def ring_search(centres: DataFrame, vertices: DataFrame, fields: DataFrame, pitch: float, samples: int = 16, step_pitches: float = 0.5, most_pitches: float = 16.0) -> tuple[DataFrame, DataFrame]:
    """Outcomes (mesh_id, field, entity_id, status, radius, fold, n_tried) and branches (mesh_id, field, entity_id, port_id, kind, phi, value) of the search for each centre's ring.

    ``centres``: mesh_id, field, entity_id, ux, uy, uz, expected, a0. Radii rise from a0, a
    quarter pitch at least, by ``step_pitches`` up to ``most_pitches``; the first balanced
    ring of the expected fold ends a centre's search: ``converged_at_a0`` at the first
    radius, ``expanded`` later. Else the tightest balanced ring of another fold stands
    (``k_mismatch``) or there is none (``unbalanced``, the last radius). An expected fold
    below 2 has ``no_ring``. Branches are the ports of the ring that stands. A centre climbs
    its ladder within one task, so a ring's samples are never rows.
    """
    who = [*KEY, "entity_id"]
    start = F.greatest(F.col("a0"), F.lit(pitch / 4))
    n = F.greatest(F.lit(1), F.floor((most_pitches * pitch - start) / (step_pitches * pitch) + 1e-9).cast("int") + 1)
    step = step_pitches * pitch
    asked = centres.where("expected >= 2").select(*who, "ux", "uy", "uz", "expected", start.alias("start"), n.alias("n"))
    asked = cut_lineage(asked.withColumn("extent", F.col("start") + (F.col("n") - 1) * step))
    somewhere = F.coalesce(~F.isnan(F.col("ux") + F.col("uy") + F.col("uz")), F.lit(False))

    def climb(own: dict[str, np.ndarray], value) -> tuple[np.ndarray, list]:
        at, total = np.column_stack([own[f"u{m}"] for m in "xyz"]), len(own["n"])
        status, fold, tried = np.full(total, "unbalanced", dtype=object), np.zeros(total, dtype=np.int64), own["n"].astype(np.int64)
        radius, branches = own["start"] + (own["n"] - 1) * step, [[] for _ in range(total)]
        low, searching = 0, np.arange(total)
        while len(searching):
            r = own["start"][searching] + low * step
            right = np.zeros(len(searching), dtype=bool)
            for i in range(0, len(searching), CLIMBING):
                some = searching[i : i + CLIMBING]
                sampled = value(np.repeat(some, samples), around.circles(at[some], r[i : i + CLIMBING], samples)).reshape(-1, samples)
                for rows, values, k in around.profiles(sampled):
                    kind, phi = around.ports(values, k, samples)
                    valleys, ridges = (kind == 1).sum(axis=1), (kind == -1).sum(axis=1)
                    hit = (valleys == ridges) & (valleys == own["expected"][some[rows]])
                    right[i + rows[hit]] = True
                    for m in np.flatnonzero(hit | (valleys == ridges) & (valleys >= 2) & (fold[some[rows]] == 0)):
                        c = some[rows[m]]
                        status[c] = "k_mismatch" if not hit[m] else "expanded" if low else "converged_at_a0"
                        fold[c], radius[c] = valleys[m], r[i + rows[m]]
                        branches[c] = _listed(kind[m], phi[m], values[m])
            tried[searching[right]] = low + 1
            low += 1
            searching = searching[~right & (own["n"][searching] > low)]
        return np.arange(total), [status, radius, fold, tried, branches]

    port = StructType([StructField("port_id", StringType()), StructField("kind", StringType()), StructField("phi", DoubleType()), StructField("value", DoubleType())])
    out = [StructField("status", StringType()), StructField("radius", DoubleType()), StructField("fold", IntegerType()), StructField("n_tried", LongType()), StructField("ports", ArrayType(port))]
    got = around.about(asked.where(somewhere), vertices, fields, samples * 8, out, climb)  # most settle in a few rings
    lost = asked.where(~somewhere).select(*who, F.lit("unbalanced").alias("status"), F.col("extent").alias("radius"), F.lit(0).alias("fold"), F.col("n").cast("bigint").alias("n_tried"))
    none = centres.where("expected < 2 or expected is null").select(*who, F.lit("no_ring").alias("status"), F.lit(0.0).alias("radius"), F.lit(0).alias("fold"), F.lit(0).cast("bigint").alias("n_tried"))
    return got.drop("ports").unionByName(lost).unionByName(none), got.select(*who, F.inline("ports"))


def _listed(kind: np.ndarray, phi: np.ndarray, value: np.ndarray) -> list[dict]:
    """A ring's ports, numbered by kind along phi."""
    found = []
    for sign, name, prefix in ((1, "valley", "VPORT_"), (-1, "ridge", "RPORT_")):
        found += [{"port_id": f"{prefix}{i + 1}", "kind": name, "phi": float(phi[k]), "value": float(value[k])} for i, k in enumerate(np.flatnonzero(kind == sign))]
    return found


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """(mesh_id, field, status, n, mean_radius)."""
    return outcomes.groupBy("mesh_id", "field", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("radius").alias("mean_radius"))


def launch_branches(triangles: DataFrame, vertices: DataFrame, fields: DataFrame, saddles: DataFrame) -> DataFrame:
    """(mesh_id, field, vertex_id, branch, sign, neighbour, delta): the sectors of each saddle's link, rising and falling.

    Link vertices are ordered by azimuth in the tangent plane; a run of one sign of the
    value's difference (ties count as rising) is a branch, launched toward the neighbour of the greatest
    difference. Fewer than three neighbours or four runs give no branches.
    """
    from pyspark.sql import Window

    from scalarscape.operators.mesh import unique_edges

    edges = unique_edges(triangles).select("mesh_id", "u", "v")
    both = edges.select("mesh_id", F.col("u").alias("vertex_id"), F.col("v").alias("nb")).unionByName(edges.select("mesh_id", F.col("v").alias("vertex_id"), F.col("u").alias("nb")))
    at = vertices.select("mesh_id", "vertex_id", "x", "y", "z")
    here = at.select("mesh_id", "vertex_id", *rings.named(V.unit(V.vec("")), "c"))
    there = at.select("mesh_id", F.col("vertex_id").alias("nb"), *rings.named(V.unit(V.vec("")), "o"))
    own = saddles.select(*KEY, "vertex_id", F.col("value").alias("f0")).join(both, ["mesh_id", "vertex_id"])
    own = own.join(here, ["mesh_id", "vertex_id"]).join(there, ["mesh_id", "nb"])
    own = own.join(fields.withColumnRenamed("vertex_id", "nb").withColumnRenamed("value", "f1"), [*KEY, "nb"])
    t1, _ = V.tangent_basis(V.vec("c"))
    own = own.select("*", *rings.named(t1, "s"))
    own = own.select("*", *rings.named(V.cross(V.vec("c"), V.vec("s")), "t"))
    phi = F.atan2(V.dot(V.vec("o"), V.vec("t")), V.dot(V.vec("o"), V.vec("s")))
    own = own.select(*KEY, "vertex_id", "nb", phi.alias("phi"), (F.col("f1") - F.col("f0")).alias("delta"))
    who = [*KEY, "vertex_id"]
    order = Window.partitionBy(*who).orderBy("phi", "nb")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("sign", F.when(F.col("delta") >= 0, 1).otherwise(-1))
    own = own.withColumn("last", F.last("sign").over(whole)).withColumn("turn", (F.col("sign") != F.coalesce(F.lag("sign").over(order), F.col("last"))).cast("int"))
    own = own.withColumn("run", F.sum("turn").over(order)).withColumn("runs", F.sum("turn").over(Window.partitionBy(*who))).withColumn("nn", F.count(F.lit(1)).over(Window.partitionBy(*who)))
    kept = own.where("nn >= 3 and runs >= 4").withColumn("branch", F.when(F.col("run") == 0, F.col("runs")).otherwise(F.col("run")))
    best = kept.groupBy(*who, "branch", "sign").agg(F.max_by(F.struct("nb", "delta"), F.struct(F.abs("delta"), -F.col("nb"))).alias("b"))
    return best.select(*who, F.col("branch").cast("int").alias("branch"), "sign", F.col("b.nb").alias("neighbour"), F.col("b.delta").alias("delta"))


def flanking_saddles(cores: DataFrame, saddles: DataFrame, least: float, most: float) -> DataFrame:
    """(mesh_id, field, core_id, saddle_id, theta, phi, core_value, value, sx, sy, sz): saddles between ``least`` and ``most`` radians of each core, with their azimuth about it.

    Both sides: mesh_id, field, id, value, ux, uy, uz. They meet by cells.
    """
    c = cores.select(*KEY, F.col("id").alias("core_id"), F.col("value").alias("core_value"), "ux", "uy", "uz")
    c = _cells(c, most)
    s = saddles.select(*KEY, F.col("id").alias("saddle_id"), "value", *[F.col(f"u{n}").alias(f"s{n}") for n in "xyz"])
    s = s.withColumn("cell", F.struct(*[F.floor(F.col(f"s{n}") / 0.25).alias(k) for n, k in zip("xyz", "ijk", strict=True)]))
    near = c.join(s.hint("merge"), [*KEY, "cell"]).withColumn("theta", V.angle(V.vec("u"), V.vec("s"))).where(F.col("theta").between(least, most))
    t1, _ = V.tangent_basis(V.vec("u"))
    near = near.select("*", *rings.named(t1, "t"))
    near = near.select("*", *rings.named(V.cross(V.vec("u"), V.vec("t")), "w"))
    phi = V.azimuth(F.atan2(V.dot(V.vec("s"), V.vec("w")), V.dot(V.vec("s"), V.vec("t"))))
    return near.select(*KEY, "core_id", "saddle_id", "theta", phi.alias("phi"), "core_value", "value", "sx", "sy", "sz")


def star_metrics(flanks: DataFrame, spans: DataFrame, fold: int) -> DataFrame:
    """(mesh_id, field, core_id, span_deg, barrier, relative_barrier, gap_deviation_deg) of each core with its ``fold`` nearest flanking saddles.

    span: the greatest angle between two of the members; barrier: their range of values,
    relative to the field's span; gap deviation: the mean of abs(gap - 360 / fold) over the
    cyclic gaps of the azimuths. Cores with fewer flanks have no row.
    """
    from pyspark.sql import Window

    who = [*KEY, "core_id"]
    rank = F.row_number().over(Window.partitionBy(*who).orderBy("theta", "saddle_id"))
    near = flanks.withColumn("rank", rank).where(F.col("rank") <= fold)
    order = Window.partitionBy(*who).orderBy("phi", "saddle_id")
    first = F.first("phi").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.degrees(F.coalesce(F.lead("phi").over(order), first + 2 * pi) - F.col("phi"))
    near = written(near.withColumn("deviation", F.abs(gap - 360.0 / fold)))  # read three times
    arms = near.groupBy(*who).agg(
        F.count(F.lit(1)).alias("n"), F.avg("deviation").alias("gap_deviation_deg"), F.max("theta").alias("reach"),
        F.greatest(F.max("value"), F.first("core_value")).alias("hi"), F.least(F.min("value"), F.first("core_value")).alias("lo"),
    ).where(F.col("n") == fold)
    side = lambda p: near.select(*who, F.col("rank").alias(f"{p}rank"), *[F.col(f"s{n}").alias(f"{p}{n}") for n in "xyz"])
    between = side("a").join(side("b").hint("merge"), who).where("arank < brank")  # at most fold (fold - 1) / 2 pairs of a core
    widest = between.groupBy(*who).agg(F.max(V.angle(V.vec("a"), V.vec("b"))).alias("widest"))
    got = arms.join(widest.hint("merge"), who, "left").join(spans, KEY)
    barrier = F.col("hi") - F.col("lo")
    return got.select(
        *who, F.degrees(F.greatest("reach", F.coalesce("widest", F.lit(0.0)))).alias("span_deg"), barrier.alias("barrier"),
        (barrier / F.greatest(F.col("span"), F.lit(1e-12))).alias("relative_barrier"), "gap_deviation_deg",
    )


def nudged(centres: DataFrame, vertices: DataFrame, fields: DataFrame, radius: float, fold: int, reach: float, steps: int = 3, samples: int = 16) -> DataFrame:
    """(mesh_id, field, entity_id, ux, uy, uz, energy, moved): each centre at the point of a tangent grid whose ring is most symmetric.

    The grid has 2 * ``steps`` + 1 points a side within ``reach`` radians, cut to a disc;
    the symmetry energy of the ring of ``radius`` about each is found for all at once, ties
    go to the nearest point.
    """
    offsets = [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if i * i + j * j <= steps * steps]
    offsets.sort(key=lambda o: (o[0] ** 2 + o[1] ** 2, f"{o[0]}|{o[1]}"))
    h, grid = reach / steps, np.array(offsets, dtype=float)
    turn = np.outer(np.arange(samples), np.arange(1, samples // 2 + 1)) * 2 * pi / samples
    waves = np.hstack([np.cos(turn), np.sin(turn)])

    def best(own: dict[str, np.ndarray], value) -> tuple[np.ndarray, list]:
        u = np.column_stack([own[f"u{m}"] for m in "xyz"])
        which, found = [], []
        for i in range(0, len(u), NUDGED):
            c = u[i : i + NUDGED]
            s, t = around.tangents(c)
            moved = c[:, None, :] + s[:, None, :] * (grid[:, :1] * h) + t[:, None, :] * (grid[:, 1:] * h)
            moved = moved / np.sqrt((moved**2).sum(axis=2, keepdims=True))
            ring = around.circles(moved.reshape(-1, 3), np.full(len(c) * len(grid), radius), samples)
            got = value(i + np.repeat(np.arange(len(c)), len(grid) * samples), ring).reshape(-1, samples)
            there = ~np.isnan(got)
            sums = np.where(there, got, 0.0) @ waves
            power = sums[:, : samples // 2] ** 2 + sums[:, samples // 2 :] ** 2
            total = power.sum(axis=1)
            part = power[:, fold - 1] / np.where(total > 0, total, 1.0) if 1 <= fold <= samples // 2 else np.full(len(got), np.nan)
            energy = np.where(total > 0, 1 - part, 0.0).reshape(len(c), -1)
            place = np.where(there.any(axis=1).reshape(len(c), -1), np.nan_to_num(np.round(energy, 9), nan=0.0), np.inf)
            first = place.argmin(axis=1)
            some = np.flatnonzero(np.isfinite(place.min(axis=1)))
            which.append(i + some)
            found.append(np.column_stack([moved[some, first[some]], energy[some, first[some]], first[some]]))
        p = np.concatenate(found) if found else np.zeros((0, 5))
        energies = np.ma.masked_invalid(p[:, 3])
        return np.concatenate(which) if which else np.zeros(0, dtype=int), [*p[:, :3].T, energies.filled(0.0) if not energies.mask.any() else [None if m else e for e, m in zip(energies.data.tolist(), np.ma.getmaskarray(energies), strict=True)], p[:, 4] > 0]

    asked = centres.select(*KEY, "entity_id", "ux", "uy", "uz").where("not isnan(ux + uy + uz)")
    asked = asked.withColumn("extent", F.lit(radius + reach))
    out = [*[StructField(c, DoubleType()) for c in ("ux", "uy", "uz", "energy")], StructField("moved", BooleanType())]
    return around.about(asked, vertices, fields, samples * len(offsets), out, best)


# --- catastrophes: a core with its ring of simple saddles, or a pair of saddles without one ---------------------------------

def quad_is_two_pairs(saddles: list[tuple[float, float, float]], most_pair_deg: float, ratio: float) -> bool:
    """Whether four unit directions are two close pairs far apart rather than one ring of four.

    Of the three ways to pair them the one of least summed angle counts: both its pairs
    lie within ``most_pair_deg``, and the nearest two of different pairs are ``ratio`` times
    as far apart as the wider pair.
    """
    apart = [[_apart(a, b) for b in saddles] for a in saddles]
    (i, j), (k, l) = min((((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))), key=lambda p: sum(apart[a][b] for a, b in p))
    inner = max(apart[i][j], apart[k][l])
    return inner <= most_pair_deg and min(apart[a][b] for a in (i, j) for b in (k, l)) >= ratio * inner


def _apart(a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
    return degrees(acos(max(-1.0, min(1.0, a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))))


def tightest_ring(core: tuple[float, float, float], around: list[tuple[str, float, tuple[float, float, float]]], fold: int, refuse) -> list[str] | None:
    """Ids of the ``fold`` saddles that with the core span the least angle and that ``refuse`` does not turn down; ``around``: (id, degrees from the core, direction), nearest first.

    A ring's span is at least its farthest member's distance from the core, so saddles
    farther than the best span found cannot be in a tighter ring and end the search, and
    none of two members farther apart than that is looked at.
    """
    best, chosen, known = None, None, {}

    def far(i: int, j: int) -> float:
        if (i, j) not in known:
            known[i, j] = _apart(around[i][2], around[j][2])
        return known[i, j]

    def grow(ring: tuple[int, ...], start: int, span: float, last: int) -> None:
        """Rings in the order of ``combinations``."""
        nonlocal best, chosen
        if len(ring) == fold - 1:
            if not refuse([around[m][2] for m in (*ring, last)]):
                best, chosen = span, [around[m][0] for m in (*ring, last)]
            return
        for i in range(start, last):
            wide = max(span, around[i][1], far(i, last), *[far(m, i) for m in ring])
            if best is None or wide < best:
                grow((*ring, i), i + 1, wide, last)
            if best is not None and best <= span:
                return

    for last in range(fold - 1, len(around)):
        if best is not None and around[last][1] >= best:
            break
        grow((), 0, around[last][1], last)
    return chosen


def constellations(cores: DataFrame, saddles: DataFrame, pairs: DataFrame, pitch: float, least_pitches: float = 1.0, most_pitches: float = 12.0, bimodal_ratio: float = 2.5) -> DataFrame:
    """(mesh_id, field, core_id, fold, members): every saddle pair (core_id null, fold 3) and every core with a ring of simple saddles, each cluster in one at most.

    ``cores`` and ``saddles``: mesh_id, field, id, value, ux, uy, uz, cores with
    local_euler_index; saddles are simple, of index -1. ``pairs``: mesh_id, field, a, b, as
    claimed before. A core sees the free saddles from ``least_pitches`` to ``most_pitches``
    away. It takes the tightest four that bring its index to -3 and are not two pairs, else
    the tightest three that bring it to -2. Cores go in the order of the mean distance of
    their three nearest saddles, ties by id. Only cores of index 1 can take a ring. A mesh
    and field of at most AT_ONCE of them is worked through by one task, core after core; of
    larger ones all cores that share no saddle with an earlier undecided one decide in the
    same round.
    """
    taken = pairs.select(*KEY, F.explode(F.array("a", "b")).alias("id"))
    able = cut_lineage(cores.where("local_euler_index = 1").join(taken.hint("merge"), [*KEY, "id"], "left_anti"))
    large = written(able.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > AT_ONCE).select(*KEY))
    least, most, most_pair = least_pitches * pitch, most_pitches * pitch, max(PAIR_PITCHES * pitch * 180 / pi, PAIR_FLOOR_DEG)
    found = [pairs.select(*KEY, F.lit(None).cast("string").alias("core_id"), F.lit(3).alias("fold"), F.array("a", "b").alias("members"))]
    if large.isEmpty():
        found.append(_stars_at_once(able, saddles, taken, least, most, most_pair, bimodal_ratio))
    else:
        few = F.broadcast(large)  # each stands for more than AT_ONCE cores
        found.append(_stars_at_once(able.join(few, KEY, "left_anti"), saddles, taken, least, most, most_pair, bimodal_ratio))
        found += _stars_in_rounds(able.join(few, KEY, "left_semi"), saddles, taken, least, most, most_pair, bimodal_ratio)
    return reduce(DataFrame.unionByName, found)


def star_of(chi: int, core: tuple[float, float, float], around: list[tuple[str, float, tuple[float, float, float]]], most_pair: float, ratio: float) -> tuple[int, list[str]] | None:
    """The fold and the members that a core takes of the free saddles around it."""
    for fold, target, refuse in ((4, -3, lambda ring: quad_is_two_pairs(ring, most_pair, ratio)), (3, -2, lambda ring: False)):
        if chi - fold == target and (members := tightest_ring(core, around, fold, refuse)):
            return fold, members
    return None


def _stars_at_once(cores: DataFrame, saddles: DataFrame, taken: DataFrame, least: float, most: float, most_pair: float, ratio: float) -> DataFrame:
    """(mesh_id, field, core_id, fold, members) of the cores with a ring, by one task a mesh and field; pairs of cores and saddles are no rows."""
    gone = taken.select(*KEY, "id", F.lit(True).alias("_gone")).distinct()
    at = [*KEY, "id", "ux", "uy", "uz"]
    seen = saddles.select(*at).join(gone.hint("merge"), [*KEY, "id"], "left").select(*at, F.lit(0).alias("chi"), F.coalesce("_gone", F.lit(False)).alias("gone"))
    rows = cores.select(*at, F.col("local_euler_index").cast("int").alias("chi"), F.lit(False).alias("gone")).unionByName(seen)
    whole = " and ".join(f"{c} is not null" for c in at)

    def work(group: pa.Table) -> pa.Table:
        chi, u = group.column("chi").to_numpy(), np.column_stack([group.column(f"u{n}").to_numpy() for n in "xyz"])
        ids, gone = np.array(group.column("id").to_pylist(), dtype=object), group.column("gone").to_numpy()
        own, other = np.flatnonzero(chi), np.flatnonzero(chi == 0)
        got = list(_in_turn(ids[own], u[own], chi[own], ids[other], u[other], ~gone[other], least, most, most_pair, ratio))
        key = [[group.column(c)[0].as_py()] * len(got) for c in KEY] if group.num_rows else [[], []]
        columns = [*key, *([g[i] for g in got] for i in range(3))]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    to = pa.schema([*[(c, pa.string()) for c in KEY], ("core_id", pa.string()), ("fold", pa.int32()), ("members", pa.list_(pa.string()))])
    return rows.where(whole).groupBy(*KEY).applyInArrow(work, "mesh_id string, field string, core_id string, fold int, members array<string>")


def _in_turn(cores: np.ndarray, at: np.ndarray, chi: np.ndarray, saddles: np.ndarray, where: np.ndarray, free: np.ndarray, least: float, most: float, most_pair: float, ratio: float) -> Iterator[tuple[str, int, list[str]]]:
    """(core, fold, members) of the cores of one mesh and field that take a ring; changes ``free``."""

    def flanks(i: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(where @ at[i] >= cos(min(most, pi)) - 1e-9)
        theta = np.arccos(np.clip(at[i, 0] * where[near, 0] + at[i, 1] * where[near, 1] + at[i, 2] * where[near, 2], -1.0, 1.0))
        inside = (theta >= least) & (theta <= most)
        return near[inside], theta[inside]

    order = []
    for i in range(len(cores)):
        near, theta = flanks(i)
        if free[near].sum() >= 3:
            first = np.sort(theta)[:3].tolist()
            order.append(((first[0] + first[1] + first[2]) / 3, cores[i], i))
    for _, core, i in sorted(order):
        near, theta = flanks(i)
        near, theta = near[free[near]], theta[free[near]]
        if len(near) < 3:
            continue
        ranked = sorted(zip(np.round(theta, 12).tolist(), saddles[near].tolist(), near.tolist(), theta.tolist(), strict=True))
        around = [(k, degrees(t), tuple(where[k].tolist())) for _, _, k, t in ranked]
        if star := star_of(int(chi[i]), tuple(at[i].tolist()), around, most_pair, ratio):
            free[star[1]] = False
            yield core, star[0], saddles[star[1]].tolist()


def _stars_in_rounds(cores: DataFrame, saddles: DataFrame, taken: DataFrame, least: float, most: float, most_pair: float, ratio: float) -> list[DataFrame]:
    """The same, a table for each round."""
    free = written(flanking_saddles(cores, saddles, least, most))
    near = free.groupBy(*KEY, "core_id").agg(F.slice(F.array_sort(F.collect_list("theta")), 1, 3).alias("t"))
    order = near.select(*KEY, "core_id", F.struct((F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t")).alias("near"), "core_id").alias("_order"))
    index = cores.select(*KEY, F.col("id").alias("core_id"), "local_euler_index", F.col("ux").alias("cx"), F.col("uy").alias("cy"), F.col("uz").alias("cz"))
    waiting = written(free.join(order.hint("merge"), [*KEY, "core_id"]).join(index.hint("merge"), [*KEY, "core_id"]))
    gone = written(taken)

    @F.udf("struct<fold: int, members: array<string>>")
    def ring(chi, cx, cy, cz, around):
        return star_of(chi, (cx, cy, cz), [(s["id"], degrees(s["theta"]), (s["ux"], s["uy"], s["uz"])) for s in around], most_pair, ratio)

    found = []
    while not waiting.isEmpty():
        first = waiting.groupBy(*KEY, "saddle_id").agg(F.min("_order").alias("_first"))
        blocked = waiting.join(first.hint("merge"), [*KEY, "saddle_id"]).where(F.col("_order") > F.col("_first")).select(*KEY, "core_id").distinct()
        ready = waiting.join(blocked.hint("merge"), [*KEY, "core_id"], "left_anti")
        open_saddles = ready.join(gone.withColumnRenamed("id", "saddle_id").hint("merge"), [*KEY, "saddle_id"], "left_anti")
        around = F.array_sort(F.collect_list(F.struct(F.round("theta", 12).alias("at"), F.col("saddle_id").alias("id"), "theta", F.col("sx").alias("ux"), F.col("sy").alias("uy"), F.col("sz").alias("uz"))))
        stars = open_saddles.groupBy(*KEY, "core_id", "local_euler_index", "cx", "cy", "cz").agg(around.alias("around"))
        claimed = written(stars.select(*KEY, "core_id", ring("local_euler_index", "cx", "cy", "cz", "around").alias("r")).where("r is not null").select(*KEY, "core_id", "r.fold", "r.members"))
        found.append(claimed)
        newly = claimed.select(*KEY, F.explode("members").alias("id"))
        gone, before = written(gone.unionByName(newly)), gone
        decided = ready.select(*KEY, "core_id").distinct()
        waiting, old = written(waiting.join(decided.hint("merge"), [*KEY, "core_id"], "left_anti").join(newly.withColumnRenamed("id", "saddle_id").hint("merge"), [*KEY, "saddle_id"], "left_anti")), waiting
        discard(before, old)
    return found


def classified(stars: DataFrame, points: DataFrame, centres: DataFrame, spans: DataFrame, pitch: float, barrier_tolerance: float = 0.005, tolerance_pitches: float = 4.0) -> DataFrame:
    """Each constellation with its kind and scores.

    ``points``: mesh_id, field, id, value, ux, uy, uz, local_euler_index of the clusters'
    members (a cluster's index repeated); ``centres``: mesh_id, field, id, ux, uy, uz,
    local_euler_index of the clusters. Columns: mesh_id, field, star_id (its core or first
    saddle), fold, kind (E-MSAD, E-4SAD), classification (spurious_unfolding where the
    barrier lies below the tolerance or the span below ``tolerance_pitches``, else
    physical_symmetry_breaking), net_euler_index, span_deg, barrier, relative_barrier, score
    (mean of barrier and span over twice their tolerances, each at most 1), radius_rad.
    """
    star_id = F.coalesce("core_id", F.array_min("members"))
    named_stars = stars.select(*KEY, star_id.alias("star_id"), "fold", F.explode(F.concat(F.array_compact(F.array("core_id")), "members")).alias("id"))
    who = [*KEY, "star_id"]
    values = named_stars.join(points.select(*KEY, "id", "value").hint("merge"), [*KEY, "id"]).groupBy(*who, "fold").agg((F.max("value") - F.min("value")).alias("barrier"))
    at = named_stars.join(centres.hint("merge"), [*KEY, "id"])
    side = lambda p: at.select(*who, F.col("id").alias(f"{p}id"), *[F.col(f"u{n}").alias(f"{p}{n}") for n in "xyz"])
    widest = side("a").join(side("b").hint("merge"), who).where("aid < bid").groupBy(*who).agg(F.max(V.angle(V.vec("a"), V.vec("b"))).alias("span"))  # at most ten pairs of a star
    net = at.groupBy(*who).agg(F.sum("local_euler_index").alias("net_euler_index"))
    both = values.join(widest.hint("merge"), who).join(net.hint("merge"), who).join(spans, KEY)
    relative, tolerance = F.col("barrier") / F.greatest(F.col("field_span"), F.lit(1e-12)), tolerance_pitches * pitch
    spurious = (relative < barrier_tolerance) | (F.col("span") < tolerance)
    score = 0.5 * F.least(F.lit(1.0), relative / max(2 * barrier_tolerance, 1e-6)) + 0.5 * F.least(F.lit(1.0), F.col("span") / max(2 * tolerance, 1e-6))
    return both.select(
        *who, "fold", F.when(F.col("fold") == 3, "E-MSAD").otherwise("E-4SAD").alias("kind"), F.when(spurious, "spurious_unfolding").otherwise("physical_symmetry_breaking").alias("classification"),
        "net_euler_index", F.degrees("span").alias("span_deg"), "barrier", relative.alias("relative_barrier"), score.alias("score"), (F.col("span") / 2 + pitch).alias("radius_rad"),
    )
