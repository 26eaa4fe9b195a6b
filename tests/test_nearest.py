"""Nearest vertices by trees over parts of a mesh, against brute force."""

from math import acos

import pytest

from scalarscape.operators import catastrophe, graph, nearest, persistence, rings, slopes, spherical


def sphere(spark, n, mesh="part"):
    df = spark.range(n).selectExpr(f"'{mesh}' mesh_id", "id vertex_id", f"pi() * (floor(id / 6) + 1) / ({n} / 6 + 2) as th", "2 * pi() * (id % 6) / 6 as ph")
    return df.selectExpr("mesh_id", "vertex_id", "2 * sin(th) * cos(ph) x", "2 * sin(th) * sin(ph) y", "2 * cos(th) z")


@pytest.mark.parametrize("part, piece", [(200_000, 20_000), (60, 7)])
def test_parts_of_a_mesh_find_what_the_whole_holds(spark, monkeypatch, part, piece):
    monkeypatch.setattr(nearest, "PART", part)
    monkeypatch.setattr(nearest, "PIECE", piece)
    points = sphere(spark, 500).unionByName(sphere(spark, 3, "few"))
    samples = spark.range(90).selectExpr("if(id % 9 = 0, 'few', 'part') mesh_id", "if(id % 2 = 0, 'f', 'g') field", "id ring_id", "0 k", "sin(id) x", "cos(3 * id) y", "if(id % 5 = 0, 0, sin(2 * id)) z")
    samples = samples.unionByName(points.selectExpr("mesh_id", "'f' field", "vertex_id + 1000 ring_id", "0 k", "x", "y", "z"))
    unit = lambda r: [c / (r.x**2 + r.y**2 + r.z**2) ** 0.5 for c in (r.x, r.y, r.z)]
    held = [(r.mesh_id, r.vertex_id, unit(r)) for r in points.collect()]
    want = {}
    for r in samples.collect():
        u = unit(r)
        near = sorted((round(acos(max(-1, min(1, sum(a * b for a, b in zip(u, v))))), 9), i) for m, i, v in held if m == r.mesh_id)[:4]
        want[r.mesh_id, r.field, r.ring_id] = [i for _, i in near]
    got = {(r.mesh_id, r.field, r.ring_id): [b.vertex_id for b in r.best] for r in nearest.nearest(samples, points, 4).collect()}
    assert got == want
    fields = points.selectExpr("mesh_id", "explode(array('f', 'g')) field", "vertex_id", "if(vertex_id % 7 = 0, null, vertex_id * 1.0) value")
    valued = {(r.mesh_id, r.field, r.ring_id): [(b.vertex_id, b.value) for b in r.best] for r in nearest.nearest(samples, points, 4, fields).collect()}
    assert valued == {key: [(i, None if i % 7 == 0 else float(i)) for i in ids] for key, ids in want.items()}


def test_pairs_of_samples_and_vertices_are_no_rows(spark):
    points = sphere(spark, 500)
    samples = spark.range(90).selectExpr("'part' mesh_id", "'f' field", "id ring_id", "0 k", "sin(id) x", "cos(3 * id) y", "sin(2 * id) z")
    got = rings.interpolate(samples, points, points.selectExpr("mesh_id", "'f' field", "vertex_id", "1.0D value"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(cells" not in plan
    assert got.count() == 90 and got.where("abs(value - 1) > 1e-12").count() == 0


def test_dense_slopes_are_the_slopes_of_every_pair(spark):
    points = sphere(spark, 400)
    fields = points.selectExpr("mesh_id", "explode(array('f', 'g')) field", "vertex_id", "if(vertex_id % 7 = 0, null, sin(vertex_id)) value").where("value is not null")
    centres = points.selectExpr("mesh_id", "if(vertex_id % 2 = 0, 'f', 'g') field", "vertex_id entity_id", "x / 2 ux", "y / 2 uy", "z / 2 uz", "0.1D + vertex_id % 3 * 0.05D radius")
    rows = lambda df: {r.entity_id: tuple(r) for r in df.collect()}
    want, got = (rows(f(centres, points, fields, 0.1)) for f in (spherical.radial_slope, slopes.dense_radial_slope))
    assert want.keys() == got.keys() and len(want) > 300
    for key, r in want.items():
        assert got[key][:4] == r[:4] and got[key][4] == pytest.approx(r[4], abs=1e-9, rel=1e-9) and got[key][5] == r[5]
    plan = slopes.dense_radial_slope(centres, points, fields, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_nudged_centres_sum_bins_side_by_side(spark):
    points = sphere(spark, 400)
    fields = points.selectExpr("mesh_id", "'f' field", "vertex_id", "x * x - y * y + 0.3 * x value")
    centres = spark.createDataFrame([("part", "f", 1, 0.6, 0.0, 0.8)], "mesh_id string, field string, entity_id long, ux double, uy double, uz double")
    got = catastrophe.nudged(centres, points, fields, 0.2, 2, 0.1)
    assert "explode(sequence(1, 8" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 1 and 0 <= got.first().energy <= 1


def test_pointers_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, write = [], graph.written

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "written", seen)
    monkeypatch.setattr(persistence, "written", seen)
    faces = [(4, 0, 2), (4, 2, 1), (4, 1, 3), (4, 3, 0), (5, 2, 0), (5, 1, 2), (5, 3, 1), (5, 0, 3)]
    triangles = spark.createDataFrame([("m", i, *f) for i, f in enumerate(faces)], "mesh_id string, tri_id long, a long, b long, c long")
    fields = spark.createDataFrame([("m", "f", i, float(v)) for i, v in enumerate([3, 3, 0, 1, 2, 2])], "mesh_id string, field string, vertex_id long, value double")
    assert persistence.persistence_pairs(triangles, fields).count() == 4
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_stars_find_their_nearest_flanks_once(spark, monkeypatch):
    tables, write = [], catastrophe.written
    monkeypatch.setattr(catastrophe, "written", lambda df: tables.append(write(df)) or tables[-1])
    flanks = spark.createDataFrame([("m", "f", "c", f"s{i}", 0.1, 2.0 * i, 5.0, 4.0 + i, 0.1 * i, 0.0, 1.0) for i in range(3)], "mesh_id string, field string, core_id string, saddle_id string, theta double, phi double, core_value double, value double, sx double, sy double, sz double")
    spans = spark.createDataFrame([("m", "f", 10.0)], "mesh_id string, field string, span double")
    got = catastrophe.star_metrics(flanks, spans, 3)
    assert len(tables) == 1 and "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.core_id, r.barrier) for r in got.collect()] == [("c", 2.0)]


def test_constellations_meet_their_members_by_merge(spark, tmp_path):
    star = spark.createDataFrame([("m", "f", "c", 3, ["x", "y", "z"])], "mesh_id string, field string, core_id string, fold int, members array<string>")
    rows = [("m", "f", n, float(i), 0.1 * i, 0.0, 1.0, -1) for i, n in enumerate("cxyz")]
    spark.createDataFrame(rows, "mesh_id string, field string, id string, value double, ux double, uy double, uz double, local_euler_index int").write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    spans = spark.createDataFrame([("m", "f", 10.0)], "mesh_id string, field string, field_span double")
    got = catastrophe.classified(star, points, points, spans, 0.02)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()  # a file's size says little about its rows
    assert [(r.star_id, r.barrier) for r in got.collect()] == [("c", 3.0)]
