"""Structured grids and periodic cells: classification, cuts, Wigner-Seitz planes and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalarscape.functions import vector as V

TOLERANCE = 1e-4


def grid_classes(grid: DataFrame) -> DataFrame:
    """(dataset, axis, n, origin, spacing, orthogonal, uniform) of grids (dataset, i, j, k, x, y, z).

    An axis is orthogonal if its coordinate depends on its own index only, within 1e-4;
    uniform if its steps are all positive with a deviation below 1e-4 of their mean.
    """
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(i).alias("at"), F.col(a).alias("pos")) for a, i in zip("xyz", "ijk", strict=True)])
    long = grid.select("dataset", F.inline(axes))
    per = long.groupBy("dataset", "axis", "at").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy("dataset", "axis").orderBy("at")  # one row for each index of an axis
    steps = per.withColumn("step", F.lead("lo").over(order) - F.col("lo"))
    got = steps.groupBy("dataset", "axis").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("lo", "at").alias("origin"), F.avg("step").alias("spacing"),
        (F.max(F.col("hi") - F.col("lo")) <= TOLERANCE).alias("orthogonal"),
        F.min("step").alias("least"), F.stddev_pop("step").alias("dev"),
    )
    uniform = F.coalesce((F.col("least") > 0) & (F.col("dev") < TOLERANCE * F.col("spacing")), F.lit(False))
    return got.select("dataset", "axis", "n", "origin", "spacing", "orthogonal", uniform.alias("uniform"))


def cut_plane(grid: DataFrame, at: float) -> DataFrame:
    """(dataset, i, j, x, y, value): the field on the plane z = ``at``, linear between the two layers that enclose it.

    ``grid`` has value and z rising with k. Each column of the grid meets its own two
    neighbours through one aggregation; planes outside give no rows.
    """
    below, above = F.col("z") <= at, F.col("z") >= at
    node = F.struct("z", "value")
    got = grid.groupBy("dataset", "i", "j").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), F.max_by(node, F.when(below, F.col("z"))).alias("a"), F.min_by(node, F.when(above, F.col("z"))).alias("b")
    ).where("a is not null and b is not null")
    t = F.when(F.col("b.z") > F.col("a.z"), (at - F.col("a.z")) / (F.col("b.z") - F.col("a.z"))).otherwise(0.0)
    return got.select("dataset", "i", "j", "x", "y", (F.col("a.value") + t * (F.col("b.value") - F.col("a.value"))).alias("value"))


def cropped(grid: DataFrame, boxes: DataFrame, margin: float = 2.0) -> DataFrame:
    """Rows of the grid within ``margin`` of the box (dataset, lx, hx, ly, hy, lz, hz) of its dataset."""
    inside = F.lit(True)
    for n in "xyz":
        inside = inside & F.col(n).between(F.col(f"l{n}") - margin, F.col(f"h{n}") + margin)
    return grid.join(boxes, "dataset").where(inside).select(*grid.columns)


def wigner_seitz_planes(lattices: DataFrame) -> DataFrame:
    """(lattice_id, n1, n2, n3, nx, ny, nz, offset): bisecting planes of the 26 nearest translations, the far ones (d2 > 2.25 least d2) left out.

    ``lattices``: lattice_id and vectors ax..cz. The cell is where n . p <= offset for all
    planes. Degenerate lattices (a translation of no length) have no planes.
    """
    shifts = F.array(*[F.struct(*[F.lit(v).alias(f"n{i + 1}") for i, v in enumerate((p, q, r))]) for p in (-1, 0, 1) for q in (-1, 0, 1) for r in (-1, 0, 1) if (p, q, r) != (0, 0, 0)])
    moved = lattices.select("*", F.inline(shifts))
    t = [F.col("n1") * F.col(f"a{n}") + F.col("n2") * F.col(f"b{n}") + F.col("n3") * F.col(f"c{n}") for n in "xyz"]
    moved = moved.select("lattice_id", "n1", "n2", "n3", *[c.alias(f"t{n}") for c, n in zip(t, "xyz", strict=True)])
    moved = moved.withColumn("d2", V.dot(V.vec("t"), V.vec("t")))
    least = moved.groupBy("lattice_id").agg(F.min("d2").alias("least")).where("least > 1e-12")
    near = moved.join(least, "lattice_id").where("d2 <= 2.25 * least")
    d = F.sqrt("d2")
    return near.select("lattice_id", "n1", "n2", "n3", *[(F.col(f"t{n}") / d).alias(f"n{n}") for n in "xyz"], (d / 2).alias("offset"))


def inside_cell(points: DataFrame, planes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(lattice_id, point_id, inside): whether no plane of the point's lattice is violated by more than the tolerance."""
    beyond = V.dot(V.vec("n"), (F.col("x"), F.col("y"), F.col("z"))) - F.col("offset")
    return points.join(planes, "lattice_id").groupBy("lattice_id", "point_id").agg((F.max(beyond) <= tolerance).alias("inside"))


def parse_lattice(lines: DataFrame, angstrom: float = 1.88972612462577) -> DataFrame:
    """(path, ax..cz) in Bohr from the text lines (path, line_no, value) of run files.

    The block from a line ``lattice`` to ``end`` holds three vectors of three numbers, in
    the order of lines; files with another number of vectors have no row.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    word = F.lower(F.trim("value"))
    begun = F.sum((word == "lattice").cast("int")).over(order)
    marked = lines.withColumn("begun", begun).withColumn("ended", F.sum(((word == "end") & (begun > 0)).cast("int")).over(order))
    parts = F.transform(F.slice(F.split(F.trim("value"), r"\s+"), 1, 3), lambda s: s.try_cast("double") * angstrom)
    rows = marked.where((F.col("begun") == 1) & (F.col("ended") == 0) & (word != "lattice")).select("path", "line_no", parts.alias("v")).where("size(v) = 3 and forall(v, x -> x is not null)")
    got = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "v"))).alias("r")).where("size(r) = 3")  # a lattice block has three lines
    return got.select("path", *[F.col("r")[i]["v"][j].alias(f"{m}{n}") for i, m in enumerate("abc") for j, n in enumerate("xyz")])
