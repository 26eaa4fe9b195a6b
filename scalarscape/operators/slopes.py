"""Radial slopes about many centres: the vertices about a cell of centres are brought there once, and pairs are never rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from scalarscape.functions import vector as V
from scalarscape.operators.mesh import values_by_vertex
from scalarscape.operators.nearest import field_values
from scalarscape.operators.spherical import CELL, annulus, slope_columns
from scalarscape.session import cut_lineage, partitions_for


def dense_radial_slope(centres: DataFrame, vertices: DataFrame, fields: DataFrame, pitch: float) -> DataFrame:
    """What spherical.radial_slope gives, for many centres of moderate reach: work and memory of a task grow with the vertices about a cell of centres, so those of a wide reach are better left to it."""
    who, at = ["mesh_id", "field", "entity_id"], ["mesh_id", "i", "j", "l"]
    cell = lambda p: [F.floor(F.col(f"{p}{m}") / CELL).cast("int").alias(n) for m, n in zip("xyz", "ijl", strict=True)]
    placed = cut_lineage(annulus(centres, pitch).select(*who, "ux", "uy", "uz", "inner", "outer", "broad", *cell("u")))
    unit = V.unit(V.vec(""))
    points = vertices.select("mesh_id", "vertex_id", *[u.alias(f"v{m}") for u, m in zip(unit, "xyz", strict=True)]).where("vx is not null")
    points = points.join(values_by_vertex(fields).hint("merge"), ["mesh_id", "vertex_id"])
    reach = F.col("broad") + 1e-9
    spans = [F.sequence(F.floor(F.col(n) - reach / CELL).cast("int"), F.floor(F.col(n) + 1 + reach / CELL).cast("int")) for n in "ijl"]
    groups = placed.groupBy(*at).agg(F.max("broad").alias("broad"))
    for n, span in zip("ijl", spans, strict=True):  # the cells of vertices that the group's centres may reach
        groups = groups.withColumn(f"v{n}", F.explode(span))
    beyond = [F.greatest(F.col(n) * CELL - F.col(f"v{m}"), F.col(f"v{m}") - (F.col(n) + 1) * CELL, F.lit(0.0)) for n, m in zip("ijl", "xyz", strict=True)]
    seen = points.select("*", *[c.alias(f"v{n}") for c, n in zip(cell("v"), "ijl", strict=True)]).hint("merge")
    about = groups.join(seen, ["mesh_id", "vi", "vj", "vl"]).where(V.norm(beyond) <= reach).select(*[F.col(c).alias(f"of_{c}") for c in at], "vx", "vy", "vz", "own")
    out = StructType([*placed.select(*who).schema, StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("cov", "var", "a", "b")]])
    out = StructType([StructField(f.name, f.dataType, True) for f in out])

    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(out)

    def measure(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):
            return pa.Table.from_batches([], schema=to)
        p = [held.column(f"v{m}").to_numpy() for m in "xyz"]
        names, known, value = field_values(held.column("own").combine_chunks())
        by = {f: (*[x[known[i]] for x in p], value[i][known[i]]) for i, f in enumerate(names)}
        c = [asked.column(n).to_numpy() for n in ("ux", "uy", "uz", "inner", "outer", "broad")]
        got, rows = [], []
        for row, f in enumerate(asked.column("field").to_pylist()):
            if f in by and (r := _fit(*by[f], *[x[row] for x in c])):
                rows.append(row)
                got.append(r)
        own = asked.select(who).take(pa.array(rows, type=pa.int64()))
        return pa.table([*own.columns, *[pa.array(x, type=to.field(f).type) for x, f in zip(zip(*got) if got else [()] * 5, ("n", "cov", "var", "a", "b"), strict=True)]], schema=to)

    n = partitions_for(centres.sparkSession)
    asked = placed.repartition(n, *at).groupBy(*at)
    of = [f"of_{c}" for c in at]
    return slope_columns(asked.cogroup(about.repartition(n, *of).groupBy(*of)).applyInArrow(measure, out), who)


def _fit(x, y, z, value, ux, uy, uz, inner, outer, broad) -> tuple | None:
    """n, sample covariance, population variance and both halves' means of the vertices that a centre takes; None where it has none."""
    theta = np.arccos(np.clip(ux * x + uy * y + uz * z, -1.0, 1.0))
    near = theta <= broad
    theta, value = theta[near], value[near]
    ring = (theta >= inner) & (theta <= outer)
    if np.count_nonzero(ring) >= 3:
        theta, value = theta[ring], value[ring]
    n = len(theta)
    if not n:
        return None
    apart = theta - theta.mean()
    low = theta <= np.median(theta) + 1e-9
    cov = float((apart * (value - value.mean())).sum() / (n - 1)) if n > 1 else None
    return n, cov, float((apart**2).mean()), float(value[low].mean()), None if low.all() else float(value[~low].mean())
