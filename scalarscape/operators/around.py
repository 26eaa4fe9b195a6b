"""Values on rings about many centres, each centre settled by one task that holds the vertices around it.

A ring's samples are made, interpolated and judged where the vertices are, so neither
samples nor their neighbours are ever rows; a centre brings in one row and takes out one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from scalarscape.functions import vector as V
from scalarscape.operators.mesh import values_by_vertex
from scalarscape.operators.nearest import BATCH, SLACK, Tree, best, boxes_of, field_values, parts_of, placed
from scalarscape.session import cut_lineage, partitions_for, written

KEY = ["mesh_id", "field"]
PART = 50_000  # vertices of a part
PIECE = 200_000  # samples that share a mesh's vertices, ten times as many those around a part
MARGIN = 0.2  # radians beyond the samples' reach in which vertices are held at first; four times as far for centres that need more

Values = Callable[[np.ndarray, np.ndarray], np.ndarray]


def about(centres: DataFrame, vertices: DataFrame, fields: DataFrame, per: int, out: list[StructField], work: Callable[[dict[str, np.ndarray], Values], tuple[np.ndarray, list]]) -> DataFrame:
    """(mesh_id, field, entity_id, *out) of the ``centres`` that ``work`` settles.

    ``centres``: mesh_id, field, entity_id, ux, uy, uz, extent (radians from the centre to
    its farthest sample) and other numbers; ``per``: about how many samples each takes.
    ``work`` gets some centres' columns and a function of their numbers and of directions
    that gives the value there of the centre's field, NaN where the four nearest vertices
    have none; it returns the numbers of the centres that it settles and the columns of
    ``out``. A centre whose samples' nearest vertices may lie beyond the parts that its task
    holds goes again with more of them.
    """
    u = [x.alias(f"u{m}") for x, m in zip(V.unit(V.vec("")), "xyz", strict=True)]
    points = cut_lineage(vertices.select("mesh_id", "vertex_id", *u).where("not isnan(ux + uy + uz)"))
    trees = parts_of(points, PART)
    points = placed(points, trees)
    boxes = {}
    if trees:
        points = cut_lineage(points)
        boxes = boxes_of(points, trees)
    points = points.join(values_by_vertex(fields).hint("merge"), ["mesh_id", "vertex_id"], "left")
    left, done, margin = written(placed(centres, trees)), [], MARGIN
    while True:
        found = written(_settled(left, points, boxes, margin, per, out, work))
        done.append(found.where("_sure").drop("_sure"))
        again = found.where("not _sure").select(*KEY, "entity_id") if trees else found.limit(0)
        if again.isEmpty():
            break
        left, margin = written(left.join(again.hint("merge"), [*KEY, "entity_id"], "left_semi")), 4 * margin
    got = done[0]
    for more in done[1:]:
        got = got.unionByName(more)
    return got.where("_settled").drop("_settled")


def _settled(centres: DataFrame, points: DataFrame, boxes: dict[str, list], margin: float, per: int, out: list[StructField], work: Callable) -> DataFrame:
    spark, at = centres.sparkSession, ["mesh_id", "part"]
    asked = centres.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.max("extent").alias("extent"), *[f(f"u{m}") for f in (F.min, F.max) for m in "xyz"])
    pieces, holds, beyond = [], [], {}
    for mesh, home, n, extent, *ends in asked.toLocalIterator():  # a row for each part
        count = max(1, -(-n * per // (PIECE * (10 if mesh in boxes else 1))))
        pieces.append((mesh, home, count))
        low, high = np.array(ends[:3]), np.array(ends[3:])
        reach = 2 * np.sin(min(extent + margin, np.pi) / 2)
        parts, rest = [home], []
        for part, *box in boxes.get(mesh, ()):
            if part != home:
                near = np.linalg.norm(np.maximum(np.maximum(np.array(box[:3]) - high, low - np.array(box[3:])), 0.0)) <= reach
                parts, rest = (parts + [part], rest) if near else (parts, rest + [box])
        holds += [(mesh, p, home, i) for p in parts for i in range(count)]
        beyond[mesh, home] = np.array(rest).reshape(-1, 2, 3)
    if not pieces:
        return centres.limit(0).select(*KEY, "entity_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in out], F.lit(True).alias("_settled"), F.lit(True).alias("_sure"))
    group, n = ["mesh_id", "home", "piece"], partitions_for(spark)
    shares = F.broadcast(spark.createDataFrame(pieces, "mesh_id string, part int, pieces int"))  # a row for each part
    held = F.broadcast(spark.createDataFrame(holds, "mesh_id string, part int, home int, piece int"))  # a row for each two parts near each other
    s = centres.join(shares, at).withColumn("piece", F.pmod(F.xxhash64(*KEY, "entity_id"), F.col("pieces")).cast("int")).withColumnRenamed("part", "home").drop("pieces")
    p = points.join(held, at).select(*group, "vertex_id", *[F.col(f"u{m}").alias(f"v{m}") for m in "xyz"], "own")
    types = [*centres.select(*KEY, "entity_id").schema, *out, StructField("_settled", BooleanType()), StructField("_sure", BooleanType())]
    to = StructType([StructField(f.name, f.dataType, True) for f in types])
    numbers = [c for c in centres.columns if c not in (*KEY, "entity_id", "part")]

    def seek(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        asked, held = asked.combine_chunks(), held.combine_chunks()
        own = {c: asked.column(c).to_numpy() for c in numbers}
        value, reach = _values(asked, held)
        which, columns = work(own, value)
        settled = np.zeros(asked.num_rows, dtype=bool)
        settled[which] = True
        where = np.zeros(asked.num_rows, dtype=np.int64)
        where[which] = np.arange(len(which))
        full = [pa.array(c, type=arrow.field(f.name).type).take(pa.array(where, mask=~settled)) for c, f in zip(columns, out, strict=True)]
        rest = beyond[asked.column("mesh_id")[0].as_py(), asked.column("home")[0].as_py()]
        u = np.column_stack([own[f"u{m}"] for m in "xyz"])
        far = np.full(len(u), np.inf)  # to the nearest vertex that is not held
        for low, high in rest:
            far = np.minimum(far, np.sqrt((np.maximum(np.maximum(low - u, u - high), 0.0) ** 2).sum(axis=1)))
        sure = np.isinf(far) | (2 * np.sin(np.minimum(own["extent"] + reach, np.pi) / 2) + SLACK < far)
        return pa.table([*[asked.column(c) for c in (*KEY, "entity_id")], *full, pa.array(settled), pa.array(sure)], names=to.names).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(to)
    return s.repartition(n, *group).groupBy(*group).cogroup(p.repartition(n, *group).groupBy(*group)).applyInArrow(seek, to)


def _values(asked: pa.Table, held: pa.Table, k: int = 4, snap: float = 1e-7) -> tuple[Values, np.ndarray]:
    """The function that interpolates, as ``rings.interpolate`` does, and how far the k-th vertex of any sample of each centre was."""
    reach = np.zeros(asked.num_rows)
    if not held.num_rows:
        return lambda who, p: np.full(len(p), np.nan), reach
    ids, tree = held.column("vertex_id").to_numpy(), Tree(np.column_stack([held.column(f"v{m}").to_numpy() for m in "xyz"]))
    names, has, values = field_values(held.column("own").combine_chunks())
    fields = asked.column("field").combine_chunks().dictionary_encode()
    to = np.array([names.index(f) if f in names else len(names) for f in fields.dictionary.to_pylist()] + [len(names)])
    of = to[fields.indices.fill_null(len(to) - 1).to_numpy(zero_copy_only=False)]

    def value(who: np.ndarray, p: np.ndarray) -> np.ndarray:
        got = np.empty(len(p))
        for i in range(0, len(p), BATCH):
            q, c = p[i : i + BATCH], who[i : i + BATCH]
            _, found, theta, _ = best(tree, ids, q, k, np.full(len(q), np.inf))
            found, theta = found.reshape(len(q), -1), theta.reshape(len(q), -1)
            np.maximum.at(reach, c, theta.max(axis=1) if found.shape[1] == k else np.pi)
            f = of[c][:, None]
            ok, v = has[f, found], values[f, found]
            weight = np.where(ok, 1 / np.maximum(theta, snap) ** 2, 0.0)
            top, total = np.zeros(len(q)), np.zeros(len(q))
            for j in range(found.shape[1]):
                top, total = top + weight[:, j] * v[:, j], total + weight[:, j]
            first = v[np.arange(len(q)), ok.argmax(axis=1)]
            snapped = np.where(ok, theta, np.inf).min(axis=1) < snap
            got[i : i + BATCH] = np.where(total > 0, np.where(snapped, first, top / np.where(total > 0, total, 1.0)), np.nan)
        return got

    return value, reach


def tangents(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``vector.tangent_basis`` of directions (n, 3)."""
    polar = np.abs(c[:, 2]) >= 0.9
    s = _unit(np.cross(c, np.column_stack([polar, np.zeros(len(c)), ~polar]).astype(float)))
    return s, np.cross(c, s)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(v[..., :1] * v[..., :1] + v[..., 1:2] * v[..., 1:2] + v[..., 2:] * v[..., 2:])


def circles(c: np.ndarray, radius: np.ndarray, n: int) -> np.ndarray:
    """(len(c) * n, 3): ``n`` directions on the circle of each ``radius`` about each of ``c``, as ``rings.ring_samples`` lays them."""
    s, t = tangents(c)
    phi = 2 * np.pi * np.arange(n) / n
    a = radius[:, None]
    r = np.sqrt((a * np.cos(phi)) ** 2 + (a * np.sin(phi)) ** 2)[:, :, None]
    ring = s[:, None, :] * np.cos(phi)[None, :, None] + t[:, None, :] * np.sin(phi)[None, :, None]
    return _unit(c[:, None, :] * np.cos(r) + ring * np.sin(r)).reshape(-1, 3)


def ports(values: np.ndarray, at: np.ndarray, n: int, prominence: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """``rings.ports`` of rings (m, samples) of ``n`` samples, of which those of the numbers ``at`` (m, samples) are there: 1 for a valley, -1 for a ridge, else 0, and phi_refined."""
    after, before = (lambda x: np.roll(x, -1, axis=1)), (lambda x: np.roll(x, 1, axis=1))
    smooth = (values + after(values) + before(values)) / 3 if n > 3 else values
    a, b = after(smooth), before(smooth)
    valley, ridge = (smooth < b) & (smooth <= a), (smooth > b) & (smooth >= a)
    span = (values.max(axis=1) - values.min(axis=1))[:, None]
    top, floor = np.where(ridge, smooth, -np.inf).max(axis=1)[:, None], np.where(valley, smooth, np.inf).min(axis=1)[:, None]
    height = np.where(valley, top - smooth, smooth - floor)
    kept = ~np.isfinite(height) | (height >= np.maximum(span * prominence, 1e-12)) | (span < 1e-12)
    kind = np.where(valley & kept, 1, np.where(ridge & kept, -1, 0)) if n >= 4 else np.zeros(values.shape, dtype=int)
    step, den = 2 * np.pi / n, b - 2 * smooth + a
    flat = np.abs(den) < 1e-300
    shift = np.where(flat, 0.0, 0.5 * step * (b - a) / np.where(flat, 1.0, den))
    return kind, 2 * np.pi * at / n + np.clip(shift, -step, step)


def profiles(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rings (m, n), NaN where a sample is missing, as (their numbers, the samples that are there, those samples' numbers), by how many there are."""
    there = ~np.isnan(values)
    many = there.sum(axis=1)
    got = []
    for m in np.unique(many[many > 0]):
        rows = np.flatnonzero(many == m)
        at = np.nonzero(there[rows])[1].reshape(len(rows), m)
        got.append((rows, np.take_along_axis(values[rows], at, axis=1), at))
    return got
