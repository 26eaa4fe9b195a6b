import json
from datetime import datetime as dt

import pytest

from scalarscape.operators import drift, flatten, reconcile
from scalarscape.operators.windows import carry_forward, running_total
from scalarscape.plans.problems import COUNT_RULES
from pyspark.sql import functions as F

MAIN = "snapshot_id long, field_no int, maxima int, minima int, valid boolean, recorded_at timestamp"
MIRROR = "snapshot_id long, field_no int, maxima string, minima string, valid string, recorded_at timestamp"
T1, T2 = dt(2025, 1, 1), dt(2025, 1, 2)


def diff(spark, a, b):
    left, right = spark.createDataFrame(a, MAIN), spark.createDataFrame(b, MIRROR)
    got = reconcile.reconcile(left, right, ["snapshot_id", "field_no"], COUNT_RULES, "recorded_at")
    return sorted(tuple(r) for r in got.collect())


def test_reconcile_spellings_are_no_difference(spark):
    a = [(1, i, 7, 0, True, T1) for i in range(6)]
    b = [(1, i, m, z, v, T1) for i, (m, z, v) in enumerate([("7", "0", "true"), (" 007", "+0", "T"), ("7.0", "0.00", "yes"), ("7e0", "0e+00", "1"), ("+7 ", "000", "Y"), ("7.00\t", "-0", " TRUE")])]
    assert diff(spark, a, b) == []


def test_reconcile_missing_newest_and_sides(spark):
    a = [(1, 0, None, 2, None, T1), (1, 1, 5, 5, True, T1), (1, 1, 6, 5, True, T2), (1, 1, 6, 5, True, T2), (2, 0, 1, 1, True, T1), (4, 0, 1, 1, True, T1)]
    b = [(1, 0, "n/a", "", "NULL", T1), (1, 1, "6", "5", "f", T1), (1, 1, "9", "x", "no", T1), (3, 0, "1", "1", "t", T1), (4, 0, "1", "1", "t", None)]
    got = diff(spark, a, b)
    assert (1, 0, "minima", "differs") in got and (1, 0, "maxima", "differs") not in got
    assert [g for g in got if g[2] == "row"] == [(2, 0, "row", "only_main"), (3, 0, "row", "only_mirror")]
    assert {g[2] for g in got if g[:2] == (1, 1)} == {"maxima", "minima", "valid"}  # at the tie the greater values count


def test_reconcile_empty_null_keys_and_hot_key(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [(None, 0, 1, 1, True, T1)], [(None, 0, "1", "1", "1", T1)]) == []
    a = [(7, 7, i, 0, True, dt(2025, 1, 1, 0, 0, i % 60)) for i in range(500)]
    assert {g[2] for g in diff(spark, a, [(7, 7, "-1", "0", "1", T1)])} == {"maxima"}


def test_reconcile_ignores_clashing_columns(spark):
    a = spark.createDataFrame([(1, 0, 1, 1, True, T1, "x", 3)], MAIN + ", item string, _side int")
    b = spark.createDataFrame([(1, 0, "2", "1", "1", T1)], MIRROR)
    got = reconcile.reconcile(a, b, ["snapshot_id", "field_no"], COUNT_RULES, "recorded_at").collect()
    assert [tuple(r) for r in got] == [(1, 0, "maxima", "differs")]


def test_reconcile_against_brute_force(spark):
    import random

    rng = random.Random(4)
    a = [(rng.randrange(60), rng.randrange(3), rng.randrange(3), 1, True, dt(2025, 1, 1, rng.randrange(24), rng.randrange(60), i % 60)) for i in range(300)]
    b = [(rng.randrange(60), rng.randrange(3), str(rng.randrange(3)), "1.0", "t", dt(2025, 1, 1, rng.randrange(24), rng.randrange(60), i % 60)) for i in range(300)]
    newest = lambda rows: {r[:2]: max(x for x in rows if x[:2] == r[:2])[5] for r in rows}
    na, nb = newest(a), newest(b)
    va = {k: max(r[2] for r in a if r[:2] == k and r[5] == max(x[5] for x in a if x[:2] == k)) for k in na}
    vb = {k: max(int(r[2]) for r in b if r[:2] == k and r[5] == max(x[5] for x in b if x[:2] == k)) for k in nb}
    want = sorted([(*k, "row", "only_main") for k in va if k not in vb] + [(*k, "row", "only_mirror") for k in vb if k not in va] + [(*k, "maxima", "differs") for k in va if k in vb and va[k] != vb[k]])
    assert diff(spark, a, b) == want


def files(spark, bodies, schema="file_id long, series string, file_seq int, body string"):
    return spark.createDataFrame([(i, s, q, b if isinstance(b, str) or b is None else json.dumps(b)) for i, s, q, b in bodies], schema)


def test_drift_events(spark, rows):
    euler = lambda v, key="euler": {"derived_metrics": {"display_counts": {key: v}, "morse_counts": {"euler": 2}}}
    got = drift.drift_events(files(spark, [
        (1, "a", 1, euler(2)), (2, "a", 3, euler("2", "chi")), (3, "a", 4, euler(None, "chi")), (4, "a", 5, euler(3, "chi")),
        (5, "a", 6, '{"cut'), (6, "a", 7, {"derived_metrics": {"display_euler": [3]}}), (7, "a", 8, {"derived_metrics": {}}),
        (8, "a", 2000, {"derived_metrics": {"display_euler": {"value": 3}}}), (9, "b", 1, euler(2)), (9, "b", 1, euler(2)), (10, None, 1, None),
    ]))
    assert rows(got.select("file_id", "drift")) == [(2, "renamed"), (2, "retyped"), (4, "retyped"), (6, "renamed"), (6, "retyped"), (7, "removed"), (8, "added")]


def test_drift_table_casts_every_form(spark):
    forms = [(60, 60.0), ("60 deg", 60.0), ({"deg": 60}, 60.0), ([60], 60.0), (None, None), ("wide", None)]
    got = drift.read_drifting(files(spark, [(i, "a", i, {"view_angle_deg": v}) for i, (v, _) in enumerate(forms)]))
    assert {r.file_id: r.view_angle for r in got.collect()} == {i: want for i, (_, want) in enumerate(forms)}
    paths = [("/a/b.plt", "/a/b.plt"), (["/a/b.plt"], "/a/b.plt"), ({"dir": "/a", "name": "b.plt"}, "/a/b.plt"), ({"dir": "C:\\x", "name": "b"}, "C:\\x\\b")]
    got = drift.read_drifting(files(spark, [(i, "a", i, {"origin": v}) for i, (v, _) in enumerate(paths)]))
    assert {r.file_id: r.plt_path for r in got.collect()} == {i: want for i, (_, want) in enumerate(paths)}


def test_drift_empty_and_extra_columns(spark):
    empty = files(spark, [])
    assert drift.drift_events(empty).count() == 0 and drift.schema_versions(empty).count() == 0
    extra = files(spark, [(1, "a", 1, {"origin": "x"}), (2, "a", 2, {})]).withColumn("fingerprint", F.lit(1)).withColumn("_doc", F.lit(2))
    assert [r.drift for r in drift.drift_events(extra).collect()] == ["removed"]
    steps = drift.schema_versions(extra).where("array_contains(steps, 'rename $.origin -> plt_path')")
    assert steps.count() == 1


def test_drift_registry_versions_and_unknown_keys(spark):
    d = files(spark, [(1, "a", 1, {"origin": "x"}), (2, "a", 2, {"context": {"file_of_plt": "x"}}), (3, "b", 1, {"origin": "y"}), (4, "b", 5, {"origin": "z"})])
    book = {r.version: r for r in drift.schema_versions(d).collect()}
    assert sorted(book) == [1, 2] and book[1].n_files == 3 and book[1].unmapped == [] and book[2].unmapped == ["$.context.file_of_plt"]
    (gone,) = drift.drift_events(d).collect()
    assert (gone.file_id, gone.drift, gone.old_version, gone.new_version, gone.new_keys) == (2, "removed", 1, 2, ["$.context.file_of_plt"])


def test_drift_salted_routing_gives_the_same(spark, rows, monkeypatch):
    d = files(spark, [(i, "a", i, {"origin": "x"} if i % 3 else {"context": {"plt_path": ["x"]}}) for i in range(12)])
    want = rows(drift.drift_events(d))
    monkeypatch.setattr(drift, "BROADCAST_ROWS", 0)
    assert rows(drift.drift_events(d)) == want and len(want) > 8


def test_leaves(spark, rows):
    item = lambda **k: {"title": "t", "aliases": [{"value": "no"}], **k}
    payload = {"snapshots": [
        None,
        {"context": {"field_items": [item(value=""), None, item(), item(value=None), item(value=0), item(value={"a": 1})]}, "derived_metrics": json.dumps({"display_counts": {"saddles": "3"}, "morse_counts": {"saddles": 9}})},
        {"context": {"field_items": item(value="x")}, "derived_metrics": {"geom_info": {"avg_edge_length": 0}, "display_counts": None}},
    ]}
    df = spark.createDataFrame([(1, json.dumps(payload)), (1, json.dumps(payload)), (2, json.dumps({"snapshots": payload["snapshots"][2]})), (3, None), (4, ""), (5, "{"), (6, '{"snapshots": 5}')], "export_id long, payload string").withColumn("snapshots", F.lit(1))
    assert rows(flatten.leaves(df).drop("value")) == sorted(
        [(1, 1, "field_item", 0), (1, 1, "field_item", 4), (1, 1, "field_item", 5), (1, 1, "display_counts", -1), (1, 2, "field_item", 0), (1, 2, "geom_info", -1), (2, 0, "field_item", 0), (2, 0, "geom_info", -1)], key=repr
    )
    assert rows(flatten.flat_snapshots(df).select("export_id", "snap_pos")) == [(1, 1), (1, 2), (2, 0)]
    assert rows(flatten.flat_metrics(df)) == [(1, 1, "3", None), (1, 2, None, "0"), (2, 0, None, "0")]
    assert flatten.flat_field_items(df).count() == 7
    assert flatten.leaves(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 100])
def test_carry_forward_is_independent_of_blocks(spark, rows, size):
    data = [(k, i, None if (i * 7 + k) % 3 else i) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(data, "k int, i int, v int")
    got = carry_forward(df, ["k"], "i", F.floor(F.col("i") / size), {"last": F.col("v")})
    for k, i, _, last in rows(got):
        assert last == max((j for kk, j, v in data if kk == k and j < i and v is not None), default=None)


def test_running_total(spark):
    df = spark.createDataFrame([("a", i % 4, i, i) for i in range(20)] + [("b", 0, 1, None)], "s string, b int, o int, v int")
    got = {(r.s, r.b, r.o): r.t for r in running_total(df, ["s"], "b", ["o"], "v", "t").collect()}
    want, total = {}, 0
    for _, b, o, v in sorted((("a", i % 4, i, i) for i in range(20)), key=lambda r: r[1:3]):
        want["a", b, o] = total
        total += v
    assert got == {**want, ("b", 0, 1): 0}
