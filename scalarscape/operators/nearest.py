"""The vertices nearest to points of a sphere, by k-d trees over parts of its mesh.

A mesh is cut into parts of bounded size, each point is sought in the part that holds
it, and in others only where its k-th vertex lies farther than their boxes. A part's
tree is built where its points are, so pairs of points and vertices are never rows.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from scalarscape.functions import vector as V
from scalarscape.operators.mesh import values_by_vertex
from scalarscape.session import cut_lineage, partitions_for

PART = 200_000  # vertices of a part
PIECE = 20_000  # points that share a tree, besides half as many as it has vertices
LEAF = 12  # vertices of a leaf
BATCH = 8_192  # points that are sought at once
SLACK = 1e-7  # of angles: what rounding may hide
GRID = 32  # cells a unit length in which vertices are counted for the cuts


class Tree:
    """Balanced k-d tree of directions (n, 3), built level by level; short leaves hold index n."""

    def __init__(self, at: np.ndarray):
        n = len(at)
        self.levels = max(0, ceil(log2(max(n, 1) / LEAF)))
        width = -(-n // (1 << self.levels))
        order = np.minimum(np.arange(width << self.levels), n - 1)
        index = np.arange(width << self.levels)
        for level in range(self.levels):
            nodes = at[order].reshape(1 << level, -1, 3)
            axis = np.argmax(nodes.max(axis=1) - nodes.min(axis=1), axis=1)
            key = np.take_along_axis(nodes, axis[:, None, None], axis=2)[:, :, 0]
            to = np.argpartition(key, key.shape[1] // 2 - 1, axis=1)
            order = np.take_along_axis(order.reshape(key.shape), to, axis=1).ravel()
            index = np.take_along_axis(index.reshape(key.shape), to, axis=1).ravel()
        self.n, self.leaves = n, np.minimum(np.where(index < n, order, n), n).reshape(1 << self.levels, width)
        self.at = np.concatenate([at, np.full((1, 3), np.inf)])  # the missing vertex is infinitely far
        held = at[order].reshape(1 << self.levels, width, 3)
        boxes = [(held.min(axis=1), held.max(axis=1))]
        for _ in range(self.levels):
            low, high = boxes[0]
            boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        self.boxes = [(np.asfortranarray(low), np.asfortranarray(high)) for low, high in boxes]
        self.at = np.asfortranarray(self.at)
        self.counts = [(self.leaves < n).sum(axis=1)]
        for _ in range(self.levels):
            self.counts.insert(0, self.counts[0][::2] + self.counts[0][1::2])

    def search(self, p: np.ndarray, k: int, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``p`` and vertices: the k nearest at most ``cap`` away, those as far in all that rounding may hide, and a few more.

        All rows go down the tree together, each with the nodes it may reach: it needs none
        that is farther than the farthest corner of one with k vertices.
        """
        row, node, bound = np.arange(len(p)), np.zeros(len(p), dtype=np.int64), cap.copy()
        for level in range(self.levels + 1):
            if level:
                row, node = np.repeat(row, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            near, far = np.zeros(len(row)), np.zeros(len(row))
            for axis in range(3):  # by columns, as sums along a short axis are slow
                q = p[:, axis][row]
                low, high = self.boxes[level][0][:, axis][node] - q, q - self.boxes[level][1][:, axis][node]
                near += np.maximum(np.maximum(low, high), 0.0) ** 2
                far += np.minimum(low, high) ** 2  # to the farther side
            near, far = np.sqrt(near), np.sqrt(far) + SLACK
            far[self.counts[level][node] < k] = np.inf
            row, node, near = _pruned(row, node, near, far, bound)
        if self.leaves.shape[1] >= k and len(row):  # the nearest leaf tells more than its corners
            first = np.lexsort((near, row))[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])]
            d = ((self.at[self.leaves[node[first]]] - p[row[first]][:, None, :]) ** 2).sum(axis=2)
            bound[row[first]] = np.minimum(bound[row[first]], np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1]) + SLACK)
            kept = near <= bound[row]
            row, node = row[kept], node[kept]
        found = self.leaves[node]
        row = np.repeat(row, found.shape[1])
        found = found.ravel()
        d = sum((self.at[:, axis][found] - p[:, axis][row]) ** 2 for axis in range(3))
        kept = (found < self.n) & (d <= bound[row] ** 2)
        return row[kept], found[kept]


def _pruned(row: np.ndarray, node: np.ndarray, near: np.ndarray, far: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nodes that their rows may reach; lowers ``bound``."""
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        bound[row[starts]] = np.minimum(bound[row[starts]], np.minimum.reduceat(far, starts))
    kept = near <= bound[row]
    return row[kept], node[kept], near[kept]


def best(tree: Tree, ids: np.ndarray, p: np.ndarray, k: int, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, vertices, angles and rounded angles of the first ``k`` of each row that are at most ``cap`` away, by rounded angle and then by id."""
    row, found = tree.search(p, k, cap)
    u, v = p[row], tree.at[found]
    theta = np.arccos(np.clip(u[:, 0] * v[:, 0] + u[:, 1] * v[:, 1] + u[:, 2] * v[:, 2], -1.0, 1.0))
    at = np.round(theta, 9)
    order = np.lexsort((ids[found], at, row))
    row, found, theta, at = row[order], found[order], theta[order], at[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return tuple(x[rank < k] for x in (row, found, theta, at))


def cuts(cells: dict[tuple[int, int, int], int], size: int | None = None) -> list:
    """Nested (axis, bound, below, above) or a part's number: the cells' vertices cut at the middle of the wider side until a part has at most ``size``, PART if that is not given."""
    size = size or PART
    parts = []

    def cut(at: np.ndarray, n: np.ndarray):
        axis = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
        places, back = np.unique(at[:, axis], return_inverse=True)
        if n.sum() <= size or len(places) == 1:
            parts.append(len(parts))
            return parts[-1]
        upto = np.cumsum(np.bincount(back, weights=n))
        middle = min(int(np.searchsorted(upto, upto[-1] / 2)), len(places) - 2)
        below = at[:, axis] <= places[middle]
        return axis, float(places[middle] + 1) / GRID, cut(at[below], n[below]), cut(at[~below], n[~below])

    return cut(np.array([*cells]), np.array([*cells.values()]))


def part_of(tree, p: np.ndarray) -> np.ndarray:
    """The part that holds each of ``p``."""
    got, todo = np.zeros(len(p), dtype=np.int32), [(tree, np.arange(len(p)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, tuple):
            low = p[rows, node[0]] < node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
        else:
            got[rows] = node
    return got


def placed(df: DataFrame, trees: dict) -> DataFrame:
    """``df`` with the part of (mesh_id, ux, uy, uz)."""
    if not trees:
        return df.withColumn("part", F.lit(0))

    @F.pandas_udf("int")
    def part(mesh: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        got, p = pd.Series(0, index=mesh.index, dtype="int32"), np.column_stack([x, y, z])
        for m, tree in trees.items():
            own = (mesh == m).to_numpy()
            got[own] = part_of(tree, p[own])
        return got

    return df.withColumn("part", part("mesh_id", "ux", "uy", "uz"))


def parts_of(points: DataFrame, size: int) -> dict:
    """The cuts of the meshes of more than ``size`` vertices; ``points``: mesh_id, ux, uy, uz."""
    large = points.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("mesh_id")
    cell = [F.floor(F.col(f"u{m}") * GRID).alias(n) for m, n in zip("xyz", "ijl", strict=True)]
    counted: dict[str, dict] = {}
    for r in points.join(large, "mesh_id", "left_semi").groupBy("mesh_id", *cell).count().toLocalIterator():  # the cells of a sphere, at most some 20,000 of a mesh
        counted.setdefault(r[0], {})[tuple(r[1:4])] = r[4]
    return {m: cuts(cells, size) for m, cells in counted.items()}


def boxes_of(points: DataFrame, trees: dict) -> dict[str, list]:
    """(part, least x, y, z, greatest x, y, z) of the parts of each mesh that is cut; ``points`` with their part."""
    boxes: dict[str, list] = {}
    ends = points.where(F.col("mesh_id").isin([*trees])).groupBy("mesh_id", "part").agg(*[f(f"u{m}") for f in (F.min, F.max) for m in "xyz"])
    for r in ends.collect():  # a row for each part
        boxes.setdefault(r[0], []).append(tuple(r[1:]))
    return boxes


def nearest(samples: DataFrame, vertices: DataFrame, k: int, fields: DataFrame | None = None) -> DataFrame:
    """The keys of ``samples`` (mesh_id, field where given, ring_id, k) with ``best``: its ``k`` nearest vertices, all where a mesh has fewer, as an array of (at, vertex_id, theta), with the value of the sample's field where ``fields`` are given.

    Ties (angles ``at``, equal in nine decimals) go to the smaller vertex_id. Samples and
    vertices without a direction are left out.
    """
    u = [x.alias(f"u{m}") for x, m in zip(V.unit(V.vec("")), "xyz", strict=True)]
    key = [c for c in ("mesh_id", "field", "ring_id", "k") if c in samples.columns]
    points = cut_lineage(vertices.select("mesh_id", "vertex_id", *u).where("not isnan(ux + uy + uz)"))
    trees = parts_of(points, PART)
    points = placed(points, trees)
    boxes: dict[str, list] = {}
    if trees:
        points = cut_lineage(points)
        boxes = boxes_of(points, trees)
    if fields is not None:
        points = points.join(values_by_vertex(fields).hint("merge"), ["mesh_id", "vertex_id"], "left")
    raw = cut_lineage(samples.select(*key, "x", "y", "z"))  # so that their expressions are not worked out again in each part of the direction
    home = placed(raw.select(*key, *u).where("not isnan(ux + uy + uz)").withColumn("reach", F.lit(None).cast("double")), trees)
    home = cut_lineage(home) if trees else home
    found = _sought(home, points, key, k, boxes)
    if not trees:
        return found.select(*key, "best")
    found = cut_lineage(found)
    further = found.where("size(others) > 0").select(*key, "ux", "uy", "uz", "reach", F.explode("others").alias("part"))
    more = found.where("size(others) > 0").select(*key, "best").unionByName(_sought(further, points, key, k, {}).select(*key, "best"))
    merged = more.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return found.where("size(others) = 0").select(*key, "best").unionByName(merged)


def _sought(samples: DataFrame, points: DataFrame, key: list[str], k: int, boxes: dict[str, list]) -> DataFrame:
    """``samples`` with ``best`` of their part, what they reach if it was not given, and the ``others`` of the parts whose boxes they reach."""
    spark, at = samples.sparkSession, ["mesh_id", "part"]
    held = points.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    pieces = samples.groupBy(*at).agg(F.count(F.lit(1)).alias("asked")).join(held.hint("merge"), at).select(*at, F.ceil(F.col("asked") / (PIECE + F.col("n") / 2)).cast("int").alias("pieces"))
    group, n = [*at, "piece"], partitions_for(spark)
    s = samples.join(pieces.hint("merge"), at).withColumn("piece", F.pmod(F.xxhash64(*[c for c in key if c != "k"]), F.col("pieces")).cast("int")).drop("pieces")
    p = points.join(pieces.hint("merge"), at).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    p = p.select(*group, "vertex_id", *[F.col(f"u{m}").alias(f"v{m}") for m in "xyz"], *[c for c in points.columns if c == "own"])
    valued = "own" in p.columns
    what = [StructField("at", DoubleType()), p.schema["vertex_id"], StructField("theta", DoubleType()), *[StructField("value", DoubleType())] * valued]
    out = StructType([*samples.select(*key, "ux", "uy", "uz", "reach").schema, StructField("best", ArrayType(StructType(what))), StructField("others", ArrayType(IntegerType()))])
    out = StructType([StructField(f.name, f.dataType, True) for f in out])
    kept = [f.name for f in out][:-2]

    def seek(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):
            return pa.Table.from_batches([], schema=to)
        asked, held = asked.combine_chunks(), held.combine_chunks()
        rows = lambda t, c: np.column_stack([t.column(f"{c}{m}").to_numpy() for m in "xyz"])
        ids, q, tree = held.column("vertex_id").to_numpy(), rows(asked, "u"), Tree(rows(held, "v"))
        given, mesh, part = asked.column("reach").null_count == 0, asked.column("mesh_id")[0].as_py(), asked.column("part")[0].as_py()
        reach, parts = asked.column("reach").to_numpy().copy() if given else np.full(len(q), np.inf), []
        for i in range(0, len(q), BATCH):
            row, *rest = best(tree, ids, q[i : i + BATCH], k, reach[i : i + BATCH])
            parts.append((row + i, *rest))
        row, found, theta, near = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not given and len(ids) >= k:
            reach = 2 * np.sin(np.maximum.reduceat(theta, np.arange(0, len(theta), k)) / 2) + SLACK
        columns = [pa.array(near), pa.array(ids[found]), pa.array(theta)]
        if valued:
            columns.append(_values(held.column("own").combine_chunks(), asked.column("field"), row, found))
        listed = lambda row, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)), values)
        crossed = np.zeros((0, 2), dtype=np.int64)
        if others := [b for b in boxes.get(mesh, ()) if b[0] != part]:
            low, high = (np.array([b[1 + 3 * j : 4 + 3 * j] for b in others]) for j in (0, 1))
            far = np.column_stack([(np.maximum(np.maximum(lo - q, q - hi), 0.0) ** 2).sum(axis=1) for lo, hi in zip(low, high, strict=True)])
            crossed = np.argwhere(far <= reach[:, None] ** 2)
        more = pa.array(np.array([b[0] for b in others], dtype=np.int32)[crossed[:, 1]] if len(crossed) else np.zeros(0, dtype=np.int32))
        best_ = listed(row, pa.StructArray.from_arrays(columns, [f.name for f in what]))
        named = [asked.column(c) if c != "reach" else pa.array(reach) for c in kept]
        return pa.table([*named, best_, listed(crossed[:, 0], more)], names=[f.name for f in out]).cast(to)

    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(out)
    return s.repartition(n, *group).groupBy(*group).cogroup(p.repartition(n, *group).groupBy(*group)).applyInArrow(seek, out)


def field_values(own: pa.MapArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The fields of a column of maps; by field and row whether a map has it, and its value. One more field, the last, is in no map."""
    flat = lambda x: x.to_numpy(zero_copy_only=False)
    starts, keys = flat(own.offsets), own.keys.dictionary_encode()
    names, entries = keys.dictionary.to_pylist(), slice(starts[0], starts[-1])
    code, row = flat(keys.indices)[entries], np.repeat(np.arange(len(own)), np.diff(starts))
    held, value = np.zeros((len(names) + 1, len(own)), dtype=bool), np.zeros((len(names) + 1, len(own)))
    held[code, row] = True
    value[code, row] = flat(own.items.cast(pa.float64()))[entries]
    return names, held, value


def _values(own: pa.MapArray, fields: pa.ChunkedArray, row: np.ndarray, found: np.ndarray) -> pa.Array:
    """The values of each row's field at the vertices found, null where ``own`` lacks them."""
    names, held, value = field_values(own)
    asked = fields.combine_chunks().dictionary_encode()
    to = np.array([names.index(f) if f in names else len(names) for f in asked.dictionary.to_pylist()] + [len(names)])
    at = to[asked.indices.fill_null(len(to) - 1).to_numpy(zero_copy_only=False)][row]
    return pa.array(value[at, found], mask=~held[at, found])
