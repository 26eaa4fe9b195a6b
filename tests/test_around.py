"""Rings about centres that are settled where the vertices are."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scalarscape.operators import around, catastrophe, rings


def sphere(spark, n):
    spiral = [(i, math.acos(1 - 2 * (i + 0.5) / n), i * math.pi * (3 - math.sqrt(5))) for i in range(n)]
    return spark.createDataFrame([("m", i, math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t)) for i, t, p in spiral], "mesh_id string, vertex_id long, x double, y double, z double")


@pytest.fixture
def scene(spark, monkeypatch):
    """A mesh cut into many parts, with a field that lacks values; samples may not become rows."""
    points = sphere(spark, 1500)
    fields = points.selectExpr("mesh_id", "inline(array(struct('f' as field, vertex_id, sin(9 * x) + cos(7 * y) + z * x as value), struct('holes' as field, vertex_id, if(z > 0.2, null, sin(9 * x)) as value)))").where("value is not null")
    centres = points.where("vertex_id % 25 = 0").selectExpr("mesh_id", "inline(array(struct('f' as field), struct('holes' as field)))", "cast(vertex_id as string) entity_id", "x ux", "y uy", "z uz", "2 expected", "cast(0.02 as double) a0")
    centres = spark.createDataFrame(centres.collect(), centres.schema)

    def as_rows(*_, **__):
        raise AssertionError("samples as rows")

    monkeypatch.setattr(around, "PART", 100)
    monkeypatch.setattr(around, "MARGIN", 0.02)
    return points.cache(), fields.cache(), centres.cache(), lambda: monkeypatch.setattr(rings, "interpolate", as_rows)


def test_search_makes_no_rows_of_samples(spark, scene, rows):
    points, fields, centres, forbid = scene
    spread = centres.withColumn("ring_id", F.concat_ws("|", "field", "entity_id")).select("*", F.lit(0.1).alias("a"), F.lit(0.1).alias("b"), F.lit(1.0).alias("sphere_radius"))
    values = rings.interpolate(rings.ring_samples(spread, 16), points, fields)
    profile = values.select("ring_id", "k", F.lit(16).alias("n"), (2 * math.pi * F.col("k") / 16).alias("phi"), "value").cache()
    want = {(r.ring_id, r.port_id): (r.kind, r.k, r.phi_refined, r.value) for r in rings.ports(profile).collect()}
    balance = {r.ring_id: (r.fold if r.balanced and r.fold >= 2 else 0) for r in rings.boundary_balance(profile, rings.ports(profile)).collect()}
    forbid()
    one = centres.drop("a0").withColumn("a0", F.lit(0.1))  # one radius only
    outcomes, branches = catastrophe.ring_search(one, points, fields, 0.01, 16, 0.5, 10.0)
    got = {f"{r.field}|{r.entity_id}": r for r in outcomes.collect()}
    assert len(got) == 120 and all(r.fold == balance.get(k, 0) and r.n_tried == 1 and r.radius == pytest.approx(0.1) for k, r in got.items())
    ports = {(f"{r.field}|{r.entity_id}", r.port_id): r for r in branches.collect()}
    assert ports.keys() == {k for k in want if balance[k[0]]} and len({k for k, _ in ports}) > 10
    assert all(r.kind == want[k][0] and (r.phi, r.value) == pytest.approx((want[k][2], want[k][3])) for k, r in ports.items())
    ladder = {k: r for k, r in ((r.entity_id, r) for r in catastrophe.ring_search(centres, points, fields, 0.05)[0].where("field = 'f'").collect())}
    assert {r.status for r in ladder.values()} >= {"expanded"} and all((r.n_tried > 1) == (r.status != "converged_at_a0") for r in ladder.values())


def test_nudged_makes_no_rows_of_samples(spark, scene):
    points, fields, centres, forbid = scene
    forbid()
    got = catastrophe.nudged(centres.where("field = 'f'"), points, fields, 0.2, 2, 0.1).collect()
    assert len(got) == 60 and any(r.moved for r in got)
    at = spark.createDataFrame([("m", "f", r.entity_id, r.ux, r.uy, r.uz) for r in got], "mesh_id string, field string, ring_id string, ux double, uy double, uz double")
    samples = rings.ring_samples(at.select("*", F.lit(0.2).alias("a"), F.lit(0.2).alias("b"), F.lit(1.0).alias("sphere_radius")), 16).cache()
    xyz = {(r.vertex_id): (r.x, r.y, r.z) for r in points.collect()}
    value = {r.vertex_id: r.value for r in fields.where("field = 'f'").collect()}
    p, v = np.array([xyz[i] for i in sorted(xyz)]), np.array([value[i] for i in sorted(xyz)])
    ring = {}
    for r in samples.collect():
        theta = np.arccos(np.clip(p @ np.array([r.x, r.y, r.z]), -1, 1))
        four = np.argsort(theta)[:4]
        w = 1 / np.maximum(theta[four], 1e-7) ** 2
        ring.setdefault(r.ring_id, {})[r.k] = v[four[0]] if theta[four[0]] < 1e-7 else (w * v[four]).sum() / w.sum()
    for r in got:
        power = np.abs(np.fft.rfft([ring[r.entity_id][k] for k in range(16)])) ** 2
        assert r.energy == pytest.approx(1 - power[2] / power[1:].sum(), abs=1e-6)
