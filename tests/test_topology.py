import math
import random

import pytest
from pyspark.sql import functions as F

from scalarscape.functions import naming
from scalarscape.operators import catastrophe, graph, grid, mesh, metadata, morse, persistence, rings, snapshots, spherical

OCTA = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
FACES = [(4, 0, 2), (4, 2, 1), (4, 1, 3), (4, 3, 0), (5, 2, 0), (5, 1, 2), (5, 3, 1), (5, 0, 3)]
CENTRE = (1.261797, -0.00009, -0.000193)


def vertices(spark, points, shift=(0, 0, 0), scale=1.0):
    return spark.createDataFrame([("m", i, *[float(c) * scale + s for c, s in zip(p, shift)]) for i, p in enumerate(points)], "mesh_id string, vertex_id long, x double, y double, z double")


def triangles(spark, faces):
    return spark.createDataFrame([("m", i, *f) for i, f in enumerate(faces)], "mesh_id string, tri_id long, a long, b long, c long")


def field(spark, values, name="f"):
    return spark.createDataFrame([("m", name, i, None if v is None else float(v)) for i, v in enumerate(values)], "mesh_id string, field string, vertex_id long, value double")


def classes(cps):
    return {(r.vertex_id, r.cp_type, r.multiplicity) for r in cps.collect()}


@pytest.mark.parametrize("tie", ["rank", "none", "literal"])
def test_octahedron_height_and_quadrupole(spark, tie):
    t = triangles(spark, FACES)
    height = morse.critical_points(t, field(spark, [0.01, -0.01, 0.02, -0.02, 1, -1]), tie)
    assert classes(height) == {(4, "maximum", 1), (5, "minimum", 1)}
    quad = morse.critical_points(t, field(spark, [1, 1.01, -1, -1.01, 0, 0.001]), tie)
    assert {(v, c) for v, c, _ in classes(quad)} == {(0, "maximum"), (1, "maximum"), (2, "minimum"), (3, "minimum"), (4, "saddle"), (5, "saddle")}
    assert morse.summary(quad).first().euler == 2


def test_bipyramid_monkey_saddles(spark):
    n = 6
    faces = [(6, i, (i + 1) % n) for i in range(n)] + [(7, (i + 1) % n, i) for i in range(n)]
    values = [(-1) ** i for i in range(n)] + [0, 0.001]
    cps = morse.critical_points(triangles(spark, faces + faces[:2] + [(6, 6, 0)]), field(spark, values))
    assert (6, "saddle", 2) in classes(cps) and (7, "saddle", 2) in classes(cps)
    assert morse.summary(cps).first().euler == 2
    ring = [(math.cos(math.pi * i / 3), math.sin(math.pi * i / 3), 0) for i in range(n)] + [(0, 0, 1), (0, 0, -1)]
    branches = catastrophe.launch_branches(triangles(spark, faces), vertices(spark, ring), field(spark, values), cps.where("cp_type = 'saddle'"))
    assert sorted((r.vertex_id, r.sign) for r in branches.collect()) == sorted([(v, s) for v in (6, 7) for s in (1, -1)] * 3)


def test_constant_null_and_empty_fields(spark):
    t = triangles(spark, FACES)
    assert morse.critical_points(t, field(spark, [1] * 6), "none").count() == 0
    assert morse.summary(morse.critical_points(t, field(spark, [1] * 6))).first().euler == 2
    assert morse.critical_points(t, field(spark, [None] * 6)).count() == 0
    assert morse.critical_points(t.limit(0), field(spark, [1] * 6)).count() == 0


def test_frames_need_no_second_look_at_the_samples(spark):
    centres = spark.createDataFrame([("m", "f", i, *CENTRES, a, a, 2.0) for i, (CENTRES, a) in enumerate([((0.0, 0.6, 0.8), 0.3), ((1.0, 0.0, 0.0), 1.2)])], "mesh_id string, field string, ring_id long, ux double, uy double, uz double, a double, b double, sphere_radius double")
    frames = rings.ring_frame(rings.ring_samples(centres, 16))
    assert [(r.n, round(r.angular_radius, 9)) for r in frames.orderBy("ring_id").collect()] == [(16, 0.3), (16, 1.2)]
    assert "Join" not in frames._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tie", ["rank", "none"])
def test_fields_of_one_mesh_are_gathered_once(spark, tmp_path, tie):
    two = field(spark, [0.01, -0.01, 0.02, -0.02, 1, -1]).unionByName(field(spark, [1, 1.01, -1, -1.01, 0, 0.001], "g")).unionByName(field(spark, [1, 2, 3, 4, None, 5], "h"))
    for name, df in (("t", triangles(spark, FACES)), ("f", two)):
        df.write.parquet(str(tmp_path / name))
    t, two = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "f"))
    cps = morse.critical_points(t, two, tie)
    plan = cps._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # corners are many times their file's size: none go through the driver, however small that is
    apart = [morse.critical_points(t, two.where(two.field == n), tie) for n in "fgh"]
    assert sorted(map(tuple, cps.collect())) == sorted(tuple(r) for df in apart for r in df.collect())


def test_geometry_and_frame(spark):
    v, t = vertices(spark, OCTA), triangles(spark, FACES)
    g = mesh.mesh_geometry(v, t).first()
    assert (g.n_vertices, g.n_edges, g.n_triangles, g.euler) == (6, 12, 8, 2)
    assert g.mean_edge == pytest.approx(math.sqrt(2)) and g.pitch_deg == pytest.approx(90)
    wide = mesh.mesh_geometry(v, t, spark.createDataFrame([("m", 2.0)], "mesh_id string, radius double")).first()
    assert wide.mean_edge == pytest.approx(math.sqrt(2)) and wide.pitch_deg == pytest.approx(math.degrees(2 * math.asin(math.sqrt(2) / 4)))
    shifted = vertices(spark, OCTA, CENTRE, 0.412733)
    frame = mesh.atom_frame(shifted)
    assert [frame.first()[c] for c in ("cx", "cy", "cz")] == pytest.approx(CENTRE) and frame.first().radius == pytest.approx(0.412733)
    back = mesh.to_world(mesh.to_local(shifted, frame), frame)
    moved = back.join(shifted, ["mesh_id", "vertex_id"]).select(F.max(F.abs(F.col("wx") - F.col("x")) + F.abs(F.col("wz") - F.col("z")))).first()[0]
    assert moved < 1e-12
    assert mesh.wedge_triangles(triangles(spark, FACES[:4])).count() == 4 and mesh.boundary_edges(t).count() == 0


def test_persistence_and_filter(spark):
    values = [1, 0.9, -1, -0.8, 0.1, 0.2]
    t, f = triangles(spark, FACES), field(spark, values)
    pairs = {(r.kind, r.vertex_id): (r.saddle_id, r.persistence) for r in persistence.persistence_pairs(t, f).collect()}
    assert pairs["minimum", 2] == (None, 2.0) and pairs["maximum", 0] == (None, 2.0)
    assert pairs["minimum", 3] == (4, pytest.approx(0.9)) and pairs["maximum", 1] == (5, pytest.approx(0.7))
    kept = persistence.persistence_filter(morse.critical_points(t, f), persistence.persistence_pairs(t, f), 40)
    assert {r.vertex_id for r in kept.collect()} == {0, 2, 3, 4}


def profile(spark, f, n, ring="r"):
    return spark.createDataFrame([(ring, k, n, 2 * math.pi * k / n, float(f(2 * math.pi * k / n))) for k in range(n)], "ring_id string, k int, n int, phi double, value double")


@pytest.mark.parametrize(("fold", "n"), [(2, 72), (3, 72), (4, 96)])
def test_ports_of_cosines(spark, fold, n):
    r = profile(spark, lambda p: math.cos(fold * p), n)
    ports = rings.ports(r)
    balance = rings.boundary_balance(r, ports).first()
    assert (balance.n_valleys, balance.n_ridges, balance.balanced, balance.euler) == (fold, fold, True, 1 - fold)
    assert rings.alternates(ports).first().alternating
    ridge = min(ports.where("kind = 'ridge'").collect(), key=lambda p: p.k)
    assert ridge.phi_refined == pytest.approx(0, abs=1e-9)
    assert rings.symmetry_energy(r, fold).first().energy == pytest.approx(0, abs=1e-9)
    spread = sorted(p.phi for p in rings.perfected_ports(ports, fold).where("kind = 'valley'").collect())
    assert [b - a for a, b in zip(spread, spread[1:])] == pytest.approx([2 * math.pi / fold] * (fold - 1))
    assert rings.level_crossings(r, F.lit(0.001)).count() == 2 * fold


def test_ports_of_flat_and_short_rings(spark):
    flat = profile(spark, lambda p: 1, 12)
    assert rings.ports(flat).count() == 0 and rings.boundary_balance(flat, rings.ports(flat)).first().euler == 1
    assert rings.ports(profile(spark, math.cos, 3)).count() == 0
    with pytest.raises(ValueError):
        rings.smoothed(flat, 2)


def test_ring_frame_inverts_samples(spark):
    c = [x / 3 for x in (1.0, 2.0, 2.0)]
    centres = spark.createDataFrame([("r", *c, 0.2, 0.2, 1.5)], "ring_id string, ux double, uy double, uz double, a double, b double, sphere_radius double")
    got = rings.ring_frame(rings.ring_samples(centres, 48)).first()
    assert [got.cx, got.cy, got.cz] == pytest.approx(c) and got.angular_radius == pytest.approx(0.2)


def test_interpolation_matches_brute_force(spark):
    n = 400
    golden = math.pi * (3 - math.sqrt(5))
    pts = [(math.sin(a) * math.cos(golden * i), math.sin(a) * math.sin(golden * i), math.cos(a)) for i in range(n) for a in [math.acos(1 - 2 * (i + 0.5) / n)]]
    f = [p[0] ** 2 - p[1] ** 2 for p in pts]
    samples = spark.createDataFrame([("m", "r", k, *pts[k * 7]) for k in range(3)] + [("m", "r", 3, 0.0, 0.6, 0.8)], "mesh_id string, ring_id string, k int, x double, y double, z double")
    got = {r.k: r.value for r in rings.interpolate(samples, vertices(spark, pts), field(spark, f)).collect()}
    assert [got[k] for k in range(3)] == pytest.approx([f[7 * k] for k in range(3)])
    near = sorted((math.acos(min(1, 0.6 * p[1] + 0.8 * p[2])), i) for i, p in enumerate(pts))[:4]
    w = [1 / d**2 for d, _ in near]
    assert got[3] == pytest.approx(sum(a * f[i] for a, (_, i) in zip(w, near)) / sum(w))


def cluster(cid, u, axis=(0, 0, 1), a=0.05, b=0.02, morphology="string", n=(1, 0, 1), members=None):
    return ("m", "f", cid, members or [(1, "maximum", 1.0, 1, *u)], *u, *map(float, axis), a, b, morphology, n[0], n[1], n[2], n[2], n[0] + n[1] - n[2])


CLUSTER = "mesh_id string, field string, cluster_id string, members array<struct<vertex_id:long,cp_type:string,value:double,multiplicity:int,x:double,y:double,z:double>>, ux double, uy double, uz double, px double, py double, pz double, semi_major_rad double, semi_minor_rad double, morphology string, n_maxima int, n_minima int, n_saddles int, total_saddle_index int, local_euler_index int"


def at(lat, lon=0.0):
    return (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))


def test_bridge_links_follow_axis(spark):
    data = [cluster("A", at(0)), cluster("B", at(0.12)), cluster("C", at(0.12, 0.12)), cluster("D", at(0.0, 0.11), axis=(0, 1, 0), a=0.1)]
    got = {(r.cluster_a, r.cluster_b): (round(r.gap_rad, 6), r.is_linked) for r in spherical.bridge_links(spark.createDataFrame(data, CLUSTER), 0.02).collect()}
    assert got["A", "B"] == (0.02, True)  # tip to tip along the axis
    assert got["A", "D"][1] is False  # crossing axes
    assert ("A", "C") not in got
    hist = spherical.clearance_histogram(spark.createDataFrame(data, CLUSTER), 0.02)
    assert hist.agg(F.sum("n")).first()[0] == 6
    assert spherical.bridge_links(spark.createDataFrame([], CLUSTER), 0.02).count() == 0
    with pytest.raises(ValueError):
        spherical.bridge_links(spark.createDataFrame(data, CLUSTER), 0)


def test_reduction_and_composition(spark):
    members = [(i, "saddle" if i else "maximum", float(i), 3 if i else 1, *at(0.01 * i)) for i in range(2)]
    df = spark.createDataFrame([cluster("A", at(0), n=(1, 0, 1), members=members), cluster("B", at(0), n=(0, 1, 0))], CLUSTER)
    got = {r.cluster_id: (r.decision, r.n_hidden) for r in spherical.reduction(df).collect()}
    assert got == {"A": ("E-NONE", 2), "B": ("SINGLE", 0)}
    shown = spark.range(1).select(spherical.composition(F.lit(4), F.lit(1), F.lit(0), F.lit(3)).alias("a"), spherical.composition(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("b")).first()
    assert tuple(shown) == ("4 Max, 1 Sad (mult 3)", "0 CPs")
    geometry = {r.cluster_id: r for r in spherical.group_geometry(df, ["cluster_id"]).collect()}
    assert geometry["A"].saddle_index == 3 and geometry["A"].euler_index == -2 and geometry["B"].morphology == "point"


def test_radial_slope_uses_sample_over_population(spark):
    pts = [at(0.11), at(0.12), at(0.14)]
    f = [1.0, 2.0, 4.0]
    centre = spark.createDataFrame([("m", "f", "e", 1.0, 0.0, 0.0, 0.1)], "mesh_id string, field string, entity_id string, ux double, uy double, uz double, radius double")
    got = spherical.radial_slope(centre, vertices(spark, pts), field(spark, f), 0.05).first()
    assert got.slope == pytest.approx(100 * 1.5) and got.confidence == 0.95 and got.n == 3


def test_graph_operators(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80), rng.random()) for _ in range(60)] + [(i, i + 1, 0.5) for i in range(100, 130)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {r.node: r.root for r in graph.connected_groups(df).collect()} == {x: find(x) for x in parent}
    used, want = set(), set()
    for _, a, b in sorted((w, a, b) for a, b, w in edges if a != b):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in graph.greedy_matching(df.where("a <> b")).collect()} == want
    colour = {r.node: r.colour for r in graph.colours(df).collect()}
    assert all(colour[a] != colour[b] for a, b, _ in edges if a != b)
    assert graph.connected_groups(df.limit(0)).count() == 0


def rounds_of_colours(edges, n_colours):
    """The greedy colouring, node after node."""
    beside = {}
    for a, b in edges:
        if a != b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    colour = {}
    for n in sorted(beside, key=lambda n: (-len(beside[n]), n)):
        taken = [colour[m] for m in beside[n] if m in colour]
        colour[n] = min(range(n_colours), key=lambda c: (taken.count(c), c))
    return colour


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_colours_take_few_rounds_however_long_the_order_of_the_nodes(spark, monkeypatch, block):
    rng = random.Random(5)
    edges = [(f"m{i % 3}", f"{i % 3}n{rng.randrange(40)}", f"{i % 3}n{rng.randrange(40)}") for i in range(500)]
    edges += [("path", f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [("m0", "0n1", None)]
    df = spark.createDataFrame(edges, "mesh string, a string, b string")
    monkeypatch.setattr(graph, "BLOCK", block)
    tables, whole = [], graph.written
    monkeypatch.setattr(graph, "written", lambda t: tables.append(1) or whole(t))
    want = rounds_of_colours([(a, b) for _, a, b in edges if b], 5)
    assert {r.node: r.colour for r in graph.colours(df, 5, ["mesh"]).collect()} == want
    assert len(tables) < 20  # the path alone has 119 nodes that wait for one another
    if block > 50:
        assert {r.node: r.colour for r in graph.colours(df, 5).collect()} == want
        assert graph.colours(df.limit(0), 5, ["mesh"]).count() == 0


def test_metadata(spark):
    zones = spark.createDataFrame(
        [("d", 0, "s", "FETRIANGLE", 5, 6, None, {"ZoneType": "AtomSphereData", "AtomNumber": "1", "AtomType": "H", "SphereRadius": "x"}),
         ("d", 0, "s", "FETRIANGLE", 5, 6, None, {"ZoneType": "AtomSphereData", "AtomNumber": "1", "AtomType": "H", "SphereRadius": "x"}),
         ("d", 1, "s", "FETRIANGLE", 5, 6, None, {"ZoneType": "AtomSphereData", "AtomNumber": "2", "AtomType": "C", "SphereRadius": "0.5"}),
         ("d", 2, "s", "FETRIANGLE", 5, 6, None, {"ZoneType": "AtomSphereData", "AtomNumber": "3", "AtomType": "H", "SphereRadius": "-1"}),
         ("d", 3, "b", "FETRIANGLE", 5, 6, None, {"IntegratedFunctionNames": "a, b,c", "IntegratedFunctionTotals": "1.5,none"}),
         ("d", 4, "p", "ORDERED", 7, 1, 1, None)],
        "dataset string, zone_id int, name string, zone_type string, imax int, jmax int, kmax int, aux map<string,string>",
    )
    z = metadata.distinct_zones(zones)
    assert z.count() == 5
    assert metadata.formulas(z).first().formula == "CH2"
    assert {r.atom_number: r.radius for r in metadata.atom_spheres(z).collect()} == {1: None, 2: 0.5, 3: None}
    assert [(r.name, r.value) for r in metadata.integrated_totals(z).orderBy("pos").collect()] == [("a", 1.5), ("b", None)]
    shown = spark.createDataFrame([(4.7311,), (0.00001,), (12345.6,), (0.234567891,)], "v double").select(naming.six_digits(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["4.7311", "1.0000e-05", "1.2346e+04", "0.234568"]


def test_grid_and_lattice(spark):
    data = [("d", i, j, k, float(i), j * 0.5, k * k * 1.0, float(i + k)) for i in range(3) for j in range(2) for k in range(4)]
    g = spark.createDataFrame(data, "dataset string, i int, j int, k int, x double, y double, z double, value double")
    got = {r.axis: (r.n, r.orthogonal, r.uniform) for r in grid.grid_classes(g).collect()}
    assert got == {"x": (3, True, True), "y": (2, True, True), "z": (4, True, False)}
    cut = {(r.i, r.j): r.value for r in grid.cut_plane(g, 2.5).collect()}
    assert cut[1, 0] == pytest.approx(1 + 1 + 0.5) and grid.cut_plane(g, 99.0).count() == 0
    cubic = spark.createDataFrame([("c", 2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0)], "lattice_id string, " + ", ".join(f"{m}{n} double" for m in "abc" for n in "xyz"))
    planes = grid.wigner_seitz_planes(cubic)
    assert planes.count() == 18  # faces and edge neighbours lie within 2.25 times the least square
    points = spark.createDataFrame([("c", 0, 0.9, 0.9, 0.9), ("c", 1, 1.1, 0.0, 0.0)], "lattice_id string, point_id int, x double, y double, z double")
    assert {r.point_id: r.inside for r in grid.inside_cell(points, planes).collect()} == {0: True, 1: False}
    lines = ["title", "lattice", "1 0 0", " 0 2 0", "0 0 3 extra", "end", "atoms", "1 1 1", "end"]
    text = spark.createDataFrame([("p", i, s) for i, s in enumerate(lines)], "path string, line_no int, value string")
    assert grid.parse_lattice(text, 1.0).first()[1:] == (1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 3.0)


def test_snapshot_rules(spark):
    with pytest.raises(ValueError):
        snapshots.with_overrides(spark.range(1), ["k_unknown=1"])
    leaves = lambda rows: spark.createDataFrame(rows, "snapshot_id int, path string, value string")
    saved = leaves([(1, "a.x", "2"), (1, "a.y", "true"), (1, "b.z", "1"), (1, "a.w", "5")])
    got = {r.path: r.matches for r in snapshots.metric_diff(saved, leaves([(1, "a.x", "2.0000000001"), (1, "a.y", "false"), (1, "a.q", "1")]), "snapshot_id").collect()}
    assert got == {"a.x": True, "a.y": False, "a.w": False}


def test_star_of_three_saddles(spark):
    schema = "mesh_id string, field string, id string, value double, ux double, uy double, uz double"
    ring = [(math.sin(0.1) * math.cos(2 * math.pi * i / 3 + 0.3), math.sin(0.1) * math.sin(2 * math.pi * i / 3 + 0.3), math.cos(0.1)) for i in range(3)]
    core = spark.createDataFrame([("m", "f", "core", 5.0, 0.0, 0.0, 1.0), ("m", "f", "far", 5.0, 0.0, 0.0, -1.0)], schema)
    saddles = spark.createDataFrame([("m", "f", f"s{i}", 4.9, *p) for i, p in enumerate(ring)] + [("m", "f", "off", 1.0, 1.0, 0.0, 0.0)], schema)
    flanks = catastrophe.flanking_saddles(core, saddles, 0.04, 0.24)
    assert {(r.core_id, r.saddle_id) for r in flanks.collect()} == {("core", f"s{i}") for i in range(3)}
    spans = spark.createDataFrame([("m", "f", 10.0)], "mesh_id string, field string, span double")
    got = catastrophe.star_metrics(flanks, spans, 3).collect()
    assert len(got) == 1 and got[0].gap_deviation_deg == pytest.approx(0, abs=1e-6) and got[0].relative_barrier == pytest.approx(0.01)
    chord = math.acos(sum(a * b for a, b in zip(ring[0], ring[1])))
    assert got[0].span_deg == pytest.approx(math.degrees(chord))
    assert catastrophe.star_metrics(flanks, spans, 4).count() == 0


def test_display_counts_preserve_index(spark):
    members = [(0, "maximum", 1.0, 1, *at(0.0)), (1, "saddle", 0.9, 1, *at(0.05)), (2, "maximum", 0.8, 1, *at(0.1))]
    data = [cluster("A", at(0.05), n=(2, 0, 1), members=members), cluster("B", at(1.0), n=(0, 1, 0)), cluster("C", at(-1.0), n=(0, 0, 1))]
    got = spherical.display_counts(spark.createDataFrame(data, CLUSTER)).first()
    assert (got.maxima, got.minima, got.saddles, got.euler) == (1, 1, 1, 1)


def test_names(spark):
    names = ["Laplacian (condensed)", "ρ Laplacian", "W", "W #7", " Rho  Charge (raw)"]
    df = spark.createDataFrame([(n,) for n in names], "field string")
    got = [tuple(r) for r in df.select(naming.normalised(F.col("field")), naming.slug(F.col("field"))).collect()]
    assert got[0] == ("laplacian", "laplacian_condensed") and got[1] == ("laplacian", "laplacian") and got[4] == ("charge (raw)", "rho_charge_raw")
    titles = ["ρ", "Rho mean curvature (3D)", "kinetic energy density", "ELF of Î± (sca)", None, "mean curvature sign change"]
    shown = spark.createDataFrame([(t,) for t in titles], "field string").select(naming.display_title(F.col("field"))).collect()
    assert [r[0] for r in shown] == ["Electron Density (ρ)", "Mean Curvature (H)", "Kinetic Energy Density (τ)", "ELF Of α", "", "Mean Curvature Sign Change"]
    sliders = spark.createDataFrame([("Shape Index", -5.0, 5.0), (" v ", 0.0, 9.0), ("vorticity", -500.0, 20.0), ("flat", 1.0, 1.0)], "f string, lo double, hi double")
    ranges = [tuple(r.s) for r in sliders.select(naming.slider(F.col("f"), F.col("lo"), F.col("hi")).alias("s")).collect()]
    assert ranges == [(0.0, 1.0, 0.7, 0.01), (0.0, 1.0, 0.5, 0.01), (-100.0, 20.0, -88.0, 1.2), (0.0, 1.0, 0.5, 0.01)]
    pair = spark.range(1).select(naming.matches(F.lit(names[0]), F.lit(names[1])), naming.matches(F.lit("a"), F.lit("b"))).first()
    assert tuple(pair) == (True, False)
    assert {(r.field, r.pattern_no) for r in naming.select_fields(df, ["w", "lap"]).collect()} == {("W", 0), (names[0], 1), (names[1], 1)}
