"""Persistence pairs of scalar fields on meshes by distributed elder-rule merging.

Every vertex follows its steepest descent to a minimum (pointer doubling). The lowest
pass between each two basins makes a graph of minima. A minimum whose lowest pass
leads to an older one dies there: nothing that happens elsewhere can change that. All
such minima are merged at once, and the next round looks at the remaining ones.
Maxima are the minima of the negated field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarscape.operators.graph import flat_pointers
from scalarscape.operators.mesh import unique_edges
from scalarscape.session import written

KEY = ["mesh_id", "field"]


def _minima_pairs(triangles: DataFrame, fields: DataFrame) -> DataFrame:
    edges = unique_edges(triangles).select("mesh_id", "u", "v")
    both = edges.unionByName(edges.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
    height = fields.where("value is not null").select(*KEY, "vertex_id", F.struct(F.col("value").alias("f"), F.col("vertex_id").alias("i")).alias("h"))
    near = both.join(height.withColumnRenamed("vertex_id", "u").withColumnRenamed("h", "hu").hint("merge"), ["mesh_id", "u"])
    near = written(near.join(height.withColumnRenamed("vertex_id", "v").withColumnRenamed("h", "hv").hint("merge"), [*KEY, "v"]))
    node = lambda c: F.struct("mesh_id", "field", c.alias("h"))
    down = near.groupBy(*KEY, "hu").agg(F.min("hv").alias("hv")).select(node(F.col("hu")).alias("node"), node(F.least("hu", "hv")).alias("up"))
    basin = flat_pointers(down)
    at = lambda c: basin.select(F.col("node.mesh_id"), F.col("node.field"), F.col("node.h").alias(f"h{c}"), F.col("root.h").alias(f"m{c}"))
    passes = near.where("hu < hv").join(at("u").hint("merge"), [*KEY, "hu"]).join(at("v").hint("merge"), [*KEY, "hv"]).where("mu <> mv")
    graph = passes.select(*KEY, F.least("mu", "mv").alias("a"), F.greatest("mu", "mv").alias("b"), F.col("hv").alias("w"))
    graph = written(graph.groupBy(*KEY, "a", "b").agg(F.min("w").alias("w")))
    minima = written(basin.select("root.mesh_id", "root.field", F.col("root.h").alias("m")).distinct())
    dead = minima.select(*KEY, "m", F.col("m").alias("w")).limit(0)
    while graph.limit(1).count():
        ends = graph.select(*KEY, F.col("a").alias("m"), F.struct("w", F.col("b").alias("o")).alias("e")).unionByName(
            graph.select(*KEY, F.col("b").alias("m"), F.struct("w", F.col("a").alias("o")).alias("e"))
        )
        lowest = ends.groupBy(*KEY, "m").agg(F.min("e").alias("e"))
        die = written(lowest.where(F.col("e.o") < F.col("m")).select(*KEY, "m", F.col("e.w").alias("w"), F.col("e.o").alias("o")))
        dead = written(dead.unionByName(die.select(*KEY, "m", "w")))
        into = flat_pointers(die.select(node(F.col("m")).alias("node"), node(F.col("o")).alias("up")))
        heir = lambda c: into.select("node.mesh_id", "node.field", F.col("node.h").alias(c), F.col("root.h").alias(f"n{c}"))
        moved = graph.join(heir("a").hint("merge"), [*KEY, "a"], "left").join(heir("b").hint("merge"), [*KEY, "b"], "left")
        moved = moved.select(*KEY, F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "w").where("a <> b")
        graph = written(moved.groupBy(*KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
    return minima.join(dead.hint("merge"), [*KEY, "m"], "left").select(*KEY, "m", "w")


def persistence_pairs(triangles: DataFrame, fields: DataFrame) -> DataFrame:
    """(mesh_id, field, kind, vertex_id, saddle_id, birth, death, persistence) of each minimum and maximum.

    Equal values are ordered by vertex (reversed for maxima's descent). The global
    extremum of a component of the mesh has no saddle and the field's span as
    persistence. Isolated vertices have no row; null values count as absent.
    """
    spans = fields.groupBy(*KEY).agg((F.max("value") - F.min("value")).alias("span"))
    flipped = lambda df, *names: df.withColumns({**{n: -F.col(n) for n in names}, "mesh_id": F.concat(F.lit("-"), F.col("mesh_id"))})
    kept = lambda df: df.withColumn("mesh_id", F.concat(F.lit("+"), F.col("mesh_id")))
    cells = triangles.select("mesh_id", "tri_id", "a", "b", "c")
    values = fields.select(*KEY, "vertex_id", "value")
    both = _minima_pairs(
        kept(cells).unionByName(flipped(cells, "a", "b", "c")), kept(values).unionByName(flipped(values, "vertex_id", "value"))
    )
    up = F.col("mesh_id").startswith("+")
    rows = both.select(
        F.substring("mesh_id", 2, 1 << 30).alias("mesh_id"), "field", "m", "w",
        F.when(up, "minimum").otherwise("maximum").alias("kind"), F.when(up, 1).otherwise(-1).alias("s"),
    ).join(spans, KEY)
    birth, death = F.col("m.f") * F.col("s"), F.col("w.f") * F.col("s")
    return rows.select(
        *KEY, "kind", (F.col("m.i") * F.col("s")).alias("vertex_id"), (F.col("w.i") * F.col("s")).alias("saddle_id"),
        birth.alias("birth"), death.alias("death"), F.coalesce(F.abs(death - birth), F.col("span")).alias("persistence"),
    )


def persistence_filter(cps: DataFrame, pairs: DataFrame, percent: float) -> DataFrame:
    """Critical points with ``persistence`` of at least ``percent`` of the span.

    An extremum has its own; a saddle the greatest of the pairs that it ends; saddles that
    end none stay only at percent 0.
    """
    own = pairs.select(*KEY, F.col("kind").alias("cp_type"), "vertex_id", "persistence")
    saddles = pairs.where("saddle_id is not null").groupBy(*KEY, F.col("saddle_id").alias("vertex_id")).agg(F.max("persistence").alias("persistence"))
    spans = pairs.groupBy(*KEY).agg(F.max("persistence").alias("span"))
    known = own.unionByName(saddles.withColumn("cp_type", F.lit("saddle")))
    joined = cps.join(known.hint("merge"), [*KEY, "cp_type", "vertex_id"], "left").join(spans, KEY)
    return joined.where((F.coalesce("persistence", F.lit(0.0)) >= percent / 100 * F.col("span")) | F.lit(percent == 0)).drop("span")
