"""Micro-clusters, strings, reduction and catastrophes against brute force and planted cases."""

import math
import random
from itertools import combinations

import pytest

from scalarscape.operators import catastrophe, clustering

POINTS = "mesh_id string, field string, vertex_id long, cp_type string, value double, multiplicity int, x double, y double, z double"


def at(theta, phi=0.0):
    return math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta)


def apart(a, b):
    return math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)))))


def points(spark, rows):
    return spark.createDataFrame([("m", f, v, kind, float(value), 1, *p) for f, v, kind, value, p in rows], POINTS)


def test_micro_clusters_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("f", i, rng.choice(["maximum", "minimum", "saddle"]), rng.random(), at(math.acos(rng.uniform(-1, 1)), rng.uniform(0, 6.28))) for i in range(120)]
    reach, parent = 0.2, list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (_, i, _, _, p), (_, j, _, _, q) in combinations(rows, 2):
        if apart(p, q) <= reach:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    df = points(spark, rows + rows[:5])  # repeated rows count once
    got = {r.vertex_id: r.root for r in clustering.memberships(df, reach).collect()}
    assert got == {i: find(i) for i in range(120)}
    clusters = clustering.micro_clusters(df, reach / 2).collect()
    sizes = {}
    for i in range(120):
        sizes.setdefault(find(i), []).append(i)
    want = sorted(sizes, key=lambda r: (-len(sizes[r]), r))
    assert [(c.cluster_id, c.root, c.n_members) for c in sorted(clusters, key=lambda c: int(c.cluster_id[2:]))] == [(f"MC{n}", r, len(sizes[r])) for n, r in enumerate(want, 1)]
    for c in clusters:
        centre = (c.ux, c.uy, c.uz)
        assert c.max_theta == pytest.approx(max(apart(centre, rows[i][4]) for i in sizes[c.root]), abs=1e-7)
        assert c.local_euler_index == sum(-1 if rows[i][2] == "saddle" else 1 for i in sizes[c.root])


def test_micro_clusters_of_nothing_and_wrong_parameters(spark):
    empty = points(spark, [("f", 1, "saddle", 0, at(1))]).limit(0)
    assert clustering.micro_clusters(empty, 0.1).count() == 0
    with pytest.raises(ValueError):
        clustering.micro_clusters(empty, 0.0)


def test_line_of_points_is_a_string_and_a_ball_is_compact(spark):
    line = [("line", i, "saddle", i, at(0.05 * i, 0.3)) for i in range(6)]
    ball = [("ball", i, "minimum", i, at(0.05, i * math.pi / 2)) for i in range(4)]
    got = {c.field: c for c in clustering.micro_clusters(points(spark, line + ball), 0.05).collect()}
    assert got["line"].morphology == "string" and got["line"].aspect_ratio > 100 and got["line"].semi_major_rad == pytest.approx(0.125 + math.radians(1.5), abs=1e-6)
    assert got["ball"].morphology == "compact" and got["ball"].aspect_ratio == pytest.approx(1.0) and got["ball"].semi_major_rad == got["ball"].semi_minor_rad
    assert (got["line"].local_euler_index, got["ball"].local_euler_index) == (-6, 4)


def test_units_keep_the_index_and_gate_corridors(spark):
    chain = [("f", 10 * c + i, "saddle" if i else "maximum", i, at(0.05 * i + 0.35 * c, 0.0)) for c in range(3) for i in range(4)]
    lone = [("f", 100, "maximum", 1, at(2.5, 2.0)), ("f", 101, "minimum", 1, at(2.5, 2.3))]
    df = points(spark, chain + lone)
    groups = clustering.memberships(df, 0.1)
    clusters = clustering.micro_clusters(df, 0.05, groups=groups)
    units = clustering.string_units(df, groups, clusters, 0.05).collect()
    assert sum(u.local_euler_index for u in units) == sum(c.local_euler_index for c in clusters.collect()) == 3 - 9 + 2
    strings = [u for u in units if u.kind == "string"]
    assert len(strings) == 1 and strings[0].n_clusters == 3 and strings[0].n_members == 12
    assert {u.n_members for u in units if u.kind == "cluster"} == {1}


CORE = "mesh_id string, field string, id string, value double, ux double, uy double, uz double, local_euler_index int"


def stars(spark, cores, saddles, pairs=()):
    frame = lambda rows, index: spark.createDataFrame([("m", "f", i, 0.0, *p, index) for i, p in rows], CORE)
    taken = spark.createDataFrame([("m", "f", a, b) for a, b in pairs], "mesh_id string, field string, a string, b string")
    got = catastrophe.constellations(frame(cores, 1), frame(saddles, -1), taken, 0.02, 1.0, 12.0)
    return {r.core_id: (r.fold, sorted(r.members)) for r in got.collect()}


def ring(names, theta, start=0.0):
    return [(n, at(theta, start + 2 * math.pi * k / len(names))) for k, n in enumerate(names)]


def test_stars_of_three_and_four(spark):
    assert stars(spark, [("c", at(0.0))], ring("xyz", 0.1)) == {"c": (3, ["x", "y", "z"])}
    assert stars(spark, [("c", at(0.0))], ring("wxyz", 0.1)) == {"c": (4, ["w", "x", "y", "z"])}
    assert stars(spark, [("c", at(0.0))], ring("xy", 0.1)) == {}
    assert stars(spark, [("c", at(0.0))], ring("xyz", 0.1), [("x", "y")]) == {None: (3, ["x", "y"])}


def test_four_saddles_in_two_pairs_are_no_ring_of_four(spark):
    two = [("a", at(0.15, 0.0)), ("b", at(0.15, 0.2)), ("d", at(0.15, math.pi)), ("e", at(0.15, math.pi + 0.2))]
    assert catastrophe.quad_is_two_pairs([p for _, p in two], 16.0, 2.5) and not catastrophe.quad_is_two_pairs([p for _, p in ring("wxyz", 0.15)], 16.0, 2.5)
    assert stars(spark, [("c", at(0.0))], two)["c"][0] == 3


def test_tightest_ring_wins_and_nearer_cores_go_first(spark):
    near, far = ring("xyz", 0.08), ring("uvw", 0.2, 0.5)
    both = stars(spark, [("c", at(0.0)), ("d", at(0.12, 0.1))], near)
    assert both == {"c": (3, ["x", "y", "z"])}
    around = sorted(((n, math.degrees(apart(at(0.0), p)), p) for n, p in near + far), key=lambda m: m[1])
    for fold in (3, 4):
        brute = min((max(apart(a, b) for a, b in combinations([*[p for _, p in m], at(0.0)], 2)), sorted(n for n, _ in m)) for m in combinations(near + far, fold))
        found = catastrophe.tightest_ring(at(0.0), around, fold, lambda r: False)
        own = [p for n, p in near + far if n in found] + [at(0.0)]
        assert max(apart(a, b) for a, b in combinations(own, 2)) == pytest.approx(brute[0])


def test_classified_by_barrier_and_span(spark):
    star = spark.createDataFrame([("m", "f", "c", 3, ["x", "y", "z"])], "mesh_id string, field string, core_id string, fold int, members array<string>")
    places = [("c", at(0.0)), *ring("xyz", 0.2)]
    frame = lambda value: spark.createDataFrame([("m", "f", n, value * (n == "c"), *p, 1 if n == "c" else -1) for n, p in places], CORE)
    spans = spark.createDataFrame([("m", "f", 1.0)], "mesh_id string, field string, field_span double")
    for value, kind in ((0.001, "spurious_unfolding"), (0.5, "physical_symmetry_breaking")):
        (r,) = catastrophe.classified(star, frame(value), frame(value), spans, 0.02).collect()
        assert (r.kind, r.classification, r.net_euler_index) == ("E-MSAD", kind, -2)
        assert r.span_deg == pytest.approx(math.degrees(apart(places[1][1], places[2][1]))) and r.relative_barrier == pytest.approx(value)


def test_ring_search_finds_the_radius_of_the_expected_fold(spark):
    n = 3000
    places = [(i, at(math.acos(1 - 2 * (i + 0.5) / n), i * math.pi * (3 - math.sqrt(5)))) for i in range(n)]
    vertices = spark.createDataFrame([("m", i, *p) for i, p in places], "mesh_id string, vertex_id long, x double, y double, z double")

    def field(fold, inner):
        def value(p):
            theta, phi = math.acos(p[2]), math.atan2(p[1], p[0])
            return theta * math.cos((fold if theta > inner else 5) * phi)

        return value

    fields = {"three": field(3, 0.0), "later": field(3, 0.35), "flat": lambda p: 1.0}
    rows = spark.createDataFrame([("m", f, i, v(p)) for f, v in fields.items() for i, p in places], "mesh_id string, field string, vertex_id long, value double")
    centres = spark.createDataFrame(
        [("m", "three", "a", *at(0.0), 3, 0.2), ("m", "three", "b", *at(0.0), 2, 0.2), ("m", "three", "c", *at(0.0), 1, 0.2), ("m", "later", "d", *at(0.0), 3, 0.25), ("m", "flat", "e", *at(0.0), 2, 0.2)],
        "mesh_id string, field string, entity_id string, ux double, uy double, uz double, expected int, a0 double",
    )
    outcomes, branches = catastrophe.ring_search(centres, vertices, rows, 0.05, 32)
    got = {r.entity_id: r for r in outcomes.collect()}
    assert (got["a"].status, got["a"].fold, got["a"].radius, got["a"].n_tried) == ("converged_at_a0", 3, 0.2, 1)
    assert (got["b"].status, got["b"].fold) == ("k_mismatch", 3) and got["c"].status == "no_ring" and got["e"].status == "unbalanced"
    assert (got["d"].status, got["d"].fold) == ("expanded", 3) and 0.3 < got["d"].radius < 0.5
    ports = [r for r in branches.collect() if r.entity_id == "a"]
    assert sorted(r.kind for r in ports) == ["ridge"] * 3 + ["valley"] * 3


@pytest.mark.parametrize("reach", [0.02, 0.3, 1.5, 4.0])
def test_linked_cells_join_what_near_points_join(spark, reach):
    rng = random.Random(int(reach * 100))
    points = [tuple(rng.gauss(0, 1) for _ in range(3)) for _ in range(60)]
    points += [(1.0, 0.01 * rng.random(), 0.01 * rng.random()) for _ in range(200)] + [(0.0, 0.0, 0.0)]
    unit = [tuple(c / math.sqrt(sum(x * x for x in p)) for c in p) for p in points[:-1]]
    root = list(range(len(points)))
    for a in range(len(unit)):
        for b in range(a):
            if math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(unit[a], unit[b]))))) <= reach and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([("m", "f", i, *map(float, p)) for i, p in enumerate(points)], "mesh_id string, field string, vertex_id long, x double, y double, z double")
    assert {r.vertex_id: r.root for r in clustering.memberships(df, reach).collect()} == dict(enumerate(root))
    side = 2 * math.sin(min(reach, math.pi) / 2) / math.sqrt(3)
    links = clustering.linked_cells(clustering.placed_points(df, side * (1 - 1e-9)), reach)
    assert links.count() < 2000  # the 200 points that lie close have 19,900 near pairs


def test_a_part_sphere_s_points_are_not_sent_through_the_driver(spark, tmp_path):
    from scalarscape.plans import clusters as plans

    spark.createDataFrame([(i, float(i * 7 % 11)) for i in range(400)], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i, 1.0, float(i * 5 % 13)) for i in range(400)], "l_partkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    whole, plans.cut_lineage = plans.cut_lineage, lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    try:
        plans._points(spark, str(tmp_path))
    finally:
        plans.cut_lineage = whole
    assert "strategy=merge" in seen[0].splitlines()[1] + seen[0].splitlines()[0]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_saddle_pairs_meet_extrema_without_a_wide_search(spark, monkeypatch, offset):
    rng = random.Random(3)
    place = lambda spread: tuple(c / math.sqrt(sum(x * x for x in p)) for p in [(1.0, rng.gauss(0, spread), rng.gauss(0, spread))] for c in p)
    pts = [(i, "saddle" if i % 4 else "maximum", offset + rng.random(), *place(0.02 if i < 60 else 0.4)) for i in range(150)]
    reaches = []
    cells = catastrophe._cells
    monkeypatch.setattr(catastrophe, "_cells", lambda df, reach: reaches.append(reach) or cells(df, reach))
    points = spark.createDataFrame([("m", "f", *p) for p in pts], "mesh_id string, field string, vertex_id long, cp_type string, value double, ux double, uy double, uz double")
    spans = spark.createDataFrame([("m", "f", 1.0)], "mesh_id string, field string, span double")
    got = {(r.a, r.b) for r in catastrophe.saddle_pair_candidates(points, spans, 1.0, 0.2).collect()}
    deg = lambda p, q: math.degrees(apart(p, q))
    want = set()
    for p, q in combinations([p for p in pts if p[1] == "saddle"], 2):
        sep = deg(p[3:], q[3:])
        mid = [x + y for x, y in zip(p[3:], q[3:])]
        mid = tuple(x / math.sqrt(sum(y * y for y in mid)) for x in mid)
        free = all(min(deg(p[3:], e[3:]), deg(q[3:], e[3:])) >= 1.8 * sep and deg(mid, e[3:]) >= sep / 2 + 1.5 for e in pts if e[1] != "saddle")
        if 1e-9 <= sep <= 16 and abs(p[2] - q[2]) <= 0.2 and free:
            want.add((p[0], q[0]))
    assert got == want and want
    assert max(reaches) < 0.2  # radians: no pair is put into the hundreds of cells about it


def test_launch_requests_find_the_points_once(spark, tmp_path, monkeypatch):
    from scalarscape.plans import clusters as plans

    spark.createDataFrame([(i, float(i * 7 % 11)) for i in range(100)], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i, 1.0, float(i * 5 % 13)) for i in range(100)], "l_partkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    calls, points = [], plans._points
    monkeypatch.setattr(plans, "_points", lambda s, d: calls.append(d) or points(s, d))
    assert plans.launch_requests(spark, str(tmp_path)).count() > 0
    assert len(calls) == 1


def part_tables(spark, folder, n):
    spark.createDataFrame([(i, float(i * 7 % 11)) for i in range(n)], "p_partkey long, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, 1.0, float(i * 5 % 13)) for i in range(n)], "l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_only_bridged_clusters_are_pooled_again(spark, monkeypatch):
    chain = [("f", 10 * c + i, "saddle" if i else "maximum", i, at(0.05 * i + 0.35 * c, 0.0)) for c in range(2) for i in range(4)]
    lone = [("f", 100 + i, "saddle", i, at(2.0 + 0.05 * i, 2.0)) for i in range(5)]
    df = points(spark, chain + lone)
    groups = clustering.memberships(df, 0.1)
    clusters = clustering.micro_clusters(df, 0.05, groups=groups)
    pooled, whole = [], clustering.pooled_geometry
    monkeypatch.setattr(clustering, "pooled_geometry", lambda members, group: pooled.append({r.vertex_id for r in members.collect()}) or whole(members, group))
    units = {u.n_members: u for u in clustering.string_units(df, groups, clusters, 0.05).collect()}
    assert pooled == [{v for _, v, *_ in chain}]
    assert (units[8].kind, units[8].n_clusters, units[5].kind, units[5].n_clusters) == ("string", 2, "string", 1)
    alone = next(c for c in clusters.collect() if c.n_members == 5)
    assert (units[5].aspect_ratio, units[5].max_theta, units[5].local_euler_index) == (alone.aspect_ratio, alone.max_theta, -5)


def test_hidden_points_need_no_polarity(spark, tmp_path, monkeypatch):
    from scalarscape.plans import clusters as plans

    folder = part_tables(spark, tmp_path, 1500)
    reduced = plans._reduced(spark, folder)
    want = {tuple(r) for r in clustering.hidden_vertices(*reduced).collect()}
    monkeypatch.setattr(plans, "_polarity", None)
    assert {tuple(r) for r in plans.hidden_points(spark, folder).collect()} == want and want
    assert sorted(clustering.hidden_counts(reduced[1]).collect()) == sorted(reduced[2].select("mesh_id", "field", "cluster_id", "n_hidden").collect())


def test_stage_reduction_asks_for_the_polarity_that_decides(spark, tmp_path, monkeypatch):
    from scalarscape.plans import clusters as plans

    folder = part_tables(spark, tmp_path, 1500)
    units = plans._units(spark, folder)
    want = clustering.stage_summary(units, clustering.reduced_units(units, plans._polarity(spark, folder, units, "unit_id"))).collect()
    asked, polarity = [], plans._polarity
    monkeypatch.setattr(plans, "_polarity", lambda s, d, u, unit: asked.extend(u.collect()) or polarity(s, d, u, unit))
    assert sorted(plans.stage_reduction(spark, folder).collect()) == sorted(want)
    assert all(u.local_euler_index == 1 and u.n_members > 1 for u in asked)
    assert len(asked) == units.where("local_euler_index = 1 and n_members > 1").count() < units.count()


def test_untied_points_are_not_sent_through_the_driver(spark, tmp_path):
    from scalarscape.plans import topology

    plan = topology.morse_critical_points_untied(spark, part_tables(spark, tmp_path, 100))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # neither corners nor the sums of the lines, however small their files are


def test_chains_of_stars_are_settled_without_rounds(spark, monkeypatch):
    import random

    deal = random.Random(5)
    place = lambda: at(0.9 * deal.random() ** 0.5, 2 * math.pi * deal.random())
    cores, saddles = [(f"c{i}", place()) for i in range(40)], [(f"s{i}", place()) for i in range(60)]
    tables, write = [], catastrophe.written
    monkeypatch.setattr(catastrophe, "written", lambda df: tables.append(write(df)) or tables[-1])
    at_once = stars(spark, cores, saddles, [("s0", "s1")])
    assert len(tables) <= 2 and len(at_once) > 5  # it took three tables a round
    monkeypatch.setattr(catastrophe, "AT_ONCE", 1)
    assert stars(spark, cores, saddles, [("s0", "s1")]) == at_once
    for m in range(3, 9):  # the same ring as by trying all in their order
        around = sorted(((n, math.degrees(apart(at(0.0), p)), p) for n, p in saddles), key=lambda x: x[1])[: m + 3]
        refuse = lambda ring: round(1000 * ring[0][0]) % 3 == 0
        tried = [(max([x[1] for x in r] + [catastrophe._apart(a[2], b[2]) for a, b in combinations(r, 2)]), [x[0] for x in r]) for n in range(3, len(around)) for r in ((*o, around[n]) for o in combinations(around[:n], 3)) if not refuse([x[2] for x in r])]
        assert catastrophe.tightest_ring(at(0.0), around, 4, refuse) == (min(tried, key=lambda x: x[0])[1] if tried else None)
