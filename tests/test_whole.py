"""The registered queries over the whole of their operators' job."""

import glob
import json
import math
import os

import pytest

import __spark_entry__ as entry
from scalarscape.operators import snapshots, spherical
from test_entry import DATA, plain
from test_topology import CLUSTER, at, cluster, field, vertices

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def sql_rows(name, columns):
    """The rows of a query's SQL."""
    c = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    return sorted((tuple(plain(r[names.index(n)]) for n in columns) for r in got.fetchall()), key=repr)


def spark_rows(df):
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)


def test_list_leaves_match_by_element(spark):
    pairs = [
        ("[1.0, 2.0]", "[1.0000000001,2]", True),
        ("[1.0, 2.0]", "[1.0, 2.1]", False),
        ("[1.0]", "[1.0, 2.0]", False),
        ('["a", null, true]', '["a",null,true]', True),
        ("[]", "[]", True),
        ("[1.0]", "1.0", False),
        ("[1.0]", None, False),
        ("[open", "[open", True),
        (None, None, True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.same for r in df.select("i", snapshots.leaf_matches(df.a, df.b).alias("same")).collect()}
    assert got == {i: same for i, (*_, same) in enumerate(pairs)}


@needs_tables
def test_metric_leaves_are_all_leaves(spark):
    rows = snapshots.distinct_snapshots(spark.read.parquet(f"{DATA}/snapshots.parquet")).where("derived_metrics is not null").collect()
    want = {(r.snapshot_id, f"{section}.{k}") for r in rows for section, leaves in json.loads(r.derived_metrics).items() for k in leaves or {}}
    df = entry.queries()["metric_leaves"](spark, DATA)
    assert sorted((r.snapshot_id, r.path) for r in df.collect()) == sorted(want)
    assert any(path == "geom_info.center" for _, path in want)
    assert spark_rows(df) == sql_rows("metric_leaves", df.columns)


def test_metric_leaves_keep_lists_and_nulls(spark, tmp_path):
    rows = [(1, "d", 1, '{"g": {"c": [1.0, 2.0], "n": null, "x": 3}}'), (2, "d", 2, '{"g": {"c": [1.0, 2.5], "n": null, "x": 3}}')]
    df = spark.createDataFrame(rows, "snapshot_id long, dataset string, received_at int, derived_metrics string")
    df.write.parquet(str(tmp_path / "snapshots.parquet"))
    q = entry.queries()
    assert {(r.path, r.value) for r in q["metric_leaves"](spark, str(tmp_path)).where("snapshot_id = 1").collect()} == {("g.c", "[1.0,2.0]"), ("g.n", None), ("g.x", "3")}
    moved = spark.createDataFrame(rows, df.schema).selectExpr("snapshot_id", "dataset", "received_at", "replace(derived_metrics, '\"g\"', '\"geom_info\"') derived_metrics")
    moved = moved.selectExpr("snapshot_id", "dataset", "received_at", "replace(derived_metrics, '\"c\"', '\"center\"') derived_metrics")
    moved.write.parquet(str(tmp_path / "moved" / "snapshots.parquet"))
    got = {r.path: r.matches for r in q["metric_diff"](spark, str(tmp_path / "moved")).collect()}
    assert got == {"geom_info.center": False, "geom_info.n": True, "geom_info.x": True}


@needs_tables
def test_metric_diff_reports_moved_centres(spark):
    df = entry.queries()["metric_diff"](spark, DATA)
    centres = df.where("path = 'geom_info.center'").collect()
    assert centres
    for r in centres:
        a, b = json.loads(r.saved), r.computed and json.loads(r.computed)
        assert r.matches == (b is not None and len(a) == len(b) and all(abs(x - y) <= 1e-12 + 1e-6 * abs(y) for x, y in zip(a, b)))
    assert spark_rows(df) == sql_rows("metric_diff", df.columns)


@pytest.mark.parametrize("outward, decision, value, shown", [(-1, "E-MAX", 2.0, (1, 0)), (1, "E-MIN", 0.5, (0, 1)), (0, "E-MIN", 0.5, (0, 1))])
def test_slope_decides_polarity_against_counts(spark, outward, decision, value, shown):
    members = [(i, cp, v, 1, *at(0.005 * i)) for i, (cp, v) in enumerate([("minimum", 0.5), ("saddle", 2.0), ("minimum", 1.0)])]
    data = spark.createDataFrame([cluster("A", at(0.0), n=(0, 2, 1), members=members)], CLUSTER).selectExpr("*", "0.01 as angular_radius_rad")
    pts = [at(0.03), at(0.035), at(0.045), at(0.05)]
    slopes = spherical.cluster_slopes(data, vertices(spark, pts), field(spark, [outward * k for k in range(4)]), 0.02)
    got = spherical.reduction(data, slopes).first()
    assert (got.decision, got.effective_value, got.n_hidden) == (decision, value, 3)
    counts = spherical.display_counts(data, slopes).first()
    assert (counts.maxima, counts.minima, counts.saddles, counts.euler) == (*shown, 0, 1)
    assert spherical.reduction(data, slopes.limit(0)).first().decision == "E-MIN" == spherical.reduction(data).first().decision


FIELDS = {"price", "quantity", "line_price"}


@needs_tables
@pytest.mark.parametrize("name", ["ring_samples", "ring_idw", "radial_slopes"])
def test_rings_of_every_field(spark, name):
    df = entry.queries()[name](spark, DATA).cache()
    assert {r.field for r in df.select("field").distinct().collect()} == FIELDS
    ids = [c for c in ("field", "ring_id", "entity_id", "k") if c in df.columns]
    assert df.count() == df.select(*ids).distinct().count()
    own = df
    assert spark_rows(own) == sql_rows(name, own.columns)


@needs_tables
@pytest.mark.parametrize("name", ["ring_frames", "nudged_saddles", "excision_radius_search"])
def test_centres_of_every_field(spark, name):
    df = entry.queries()[name](spark, DATA).cache()
    cps = entry.queries()["morse_critical_points"](spark, DATA)
    cps = cps if name == "ring_frames" else cps.where("cp_type = 'saddle'")
    want = {(r.field, r.vertex_id) for r in cps.collect()}
    got = [(r.field, r.ring_id if name == "ring_frames" else int(str(r.entity_id).removeprefix("SAD_"))) for r in df.collect()]
    assert {f for f, _ in got} >= FIELDS - {"price"}  # the smallest price field has no saddle
    assert len(got) == len(set(got)) and set(got) == want


def test_leaves_are_not_sent_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, "d", i, '{"g": {"c": 1, "x": 2}}') for i in range(3)], "snapshot_id long, dataset string, received_at int, derived_metrics string").write.parquet(str(tmp_path / "s"))
    leaves = snapshots.metric_leaves(spark.read.parquet(str(tmp_path / "s")))
    diff = snapshots.metric_diff(leaves, leaves.withColumnRenamed("value", "v").withColumnRenamed("v", "value"), "snapshot_id")
    assert "Broadcast" not in diff._jdf.queryExecution().executedPlan().toString()  # a file's size says little about its leaves
    assert diff.count() == 6 and diff.where("not matches").count() == 0
