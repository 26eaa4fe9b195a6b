"""Queries of the mesh, Morse, ring and cluster operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarscape.operators import mesh, morse, rings, slopes, spherical
from scalarscape.plans import carriers as C
from scalarscape.session import table

PITCH = 0.02  # mesh pitch of the meshes that `clusters` were found on
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_EDGES = "edges AS (SELECT u, v, count(*) AS n_triangles FROM (SELECT least(a, b) AS u, greatest(a, b) AS v FROM triangles UNION ALL SELECT least(b, c), greatest(b, c) FROM triangles UNION ALL SELECT least(c, a), greatest(c, a) FROM triangles) GROUP BY 1, 2)"


@query(f"WITH {C.MESH_SQL}, {_EDGES} SELECT 'part' AS mesh_id, u, v, n_triangles FROM edges")
def mesh_unique_edges(s, d):
    return mesh.unique_edges(C.part_triangles(s, d))


@query(f"""WITH {C.MESH_SQL}, {_EDGES}, l AS (SELECT avg(sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)) AS m FROM edges JOIN vertices p ON p.vertex_id = u JOIN vertices q ON q.vertex_id = v),
    n AS (SELECT count(*) AS nv, avg(sqrt(x*x+y*y+z*z)) AS r FROM vertices)
    SELECT 'part' AS mesh_id, nv AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM triangles) AS n_triangles,
    nv - (SELECT count(*) FROM edges) + (SELECT count(*) FROM triangles) AS euler, round(r, 6) AS radius, round(m, 6) AS mean_edge,
    round(2 * asin(m / (2 * r)), 6) AS pitch_rad, round(degrees(2 * asin(m / (2 * r))), 6) AS pitch_deg FROM n, l""")
def mesh_geometry(s, d):
    return rounded(mesh.mesh_geometry(C.part_vertices(s, d), C.part_triangles(s, d)))


@query(f"""WITH {C.MESH_SQL}, w AS (SELECT x + {C.OFFSET[0]} AS x, y + {C.OFFSET[1]} AS y, z + {C.OFFSET[2]} AS z FROM vertices), c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM w)
    SELECT 'part' AS mesh_id, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, round(avg(sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2)), 6) AS radius FROM w, c""")
def atom_frame_centred(s, d):
    return rounded(mesh.atom_frame(C.part_vertices(s, d, C.OFFSET)))


@query(f"""WITH {C.MESH_SQL}, w AS (SELECT vertex_id, x + {C.OFFSET[0]} AS x, y + {C.OFFSET[1]} AS y, z + {C.OFFSET[2]} AS z FROM vertices), c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM w)
    SELECT 'part' AS mesh_id, vertex_id, round((x-cx)*1.5+cx, 5) AS wx, round((y-cy)*1.5+cy, 5) AS wy, round((z-cz)*1.5+cz, 5) AS wz FROM w, c""")
def radial_offset_world(s, d):
    v = C.part_vertices(s, d, C.OFFSET)
    frame = mesh.atom_frame(v)
    return rounded(mesh.to_world(mesh.to_local(v, frame), frame, 1.5), 5)


def _morse_sql(tie: str) -> str:
    e = "(SELECT greatest(max(value) - min(value), 1.0) * 1e-15 FROM fields x WHERE x.field = g.field)"
    low = {"rank": "f < fv OR (f = fv AND n < v)", "none": "f < fv", "literal": f"f + n * {e} < g.value + v * {e}"}[tie].replace("fv", "g.value")
    high = {"rank": "f > fv OR (f = fv AND n > v)", "none": "f > fv", "literal": f"f + n * {e} > g.value + v * {e}"}[tie].replace("fv", "g.value")
    return f"""{C.MESH_SQL}, turns AS (SELECT a AS v, b AS u, c AS w FROM triangles UNION ALL SELECT b, c, a FROM triangles UNION ALL SELECT c, a, b FROM triangles),
    link AS (SELECT DISTINCT v, least(u, w) AS u, greatest(u, w) AS w FROM turns),
    ends AS (SELECT v, u, w, u AS n FROM link UNION ALL SELECT v, u, w, w FROM link),
    seen AS (SELECT g.field, e.v, e.u, e.w, e.n, g.value AS fv, ({low}) AS lo, ({high}) AS hi FROM (SELECT field, vertex_id, value FROM fields) g
        JOIN ends e ON e.v = g.vertex_id JOIN (SELECT field AS ff, vertex_id AS nn, value AS f FROM fields) h ON h.ff = g.field AND h.nn = e.n),
    nodes AS (SELECT field, v, fv, count(DISTINCT n) FILTER (lo) AS vl, count(DISTINCT n) FILTER (hi) AS vh FROM seen GROUP BY ALL),
    pairs AS (SELECT field, v, u, w, bool_and(lo) AS l, bool_and(hi) AS h FROM seen GROUP BY ALL),
    arcs AS (SELECT field, v, count(*) FILTER (l) AS el, count(*) FILTER (h) AS eh FROM pairs GROUP BY ALL),
    sides AS (SELECT field, v, fv, CASE WHEN vl > 0 AND vl = el THEN 1 ELSE vl - el END AS lower, CASE WHEN vh > 0 AND vh = eh THEN 1 ELSE vh - eh END AS upper FROM nodes JOIN arcs USING (field, v)),
    cps AS (SELECT 'part' AS mesh_id, field, v AS vertex_id, fv AS value, CASE WHEN lower = 0 AND upper = 1 THEN 'minimum' WHEN upper = 0 AND lower = 1 THEN 'maximum' WHEN lower >= 2 THEN 'saddle' END AS cp_type,
        (CASE WHEN lower >= 2 AND NOT (upper = 0 AND lower = 1) THEN lower - 1 ELSE 1 END)::INT AS multiplicity FROM sides WHERE (lower = 0 AND upper = 1) OR (upper = 0 AND lower = 1) OR lower >= 2)"""


def _cps(s, d, tie: str = "rank") -> DataFrame:
    return morse.critical_points(C.part_triangles(s, d), C.part_fields(s, d), tie)


@query(f"WITH {_morse_sql('rank')} SELECT * FROM cps")
def morse_critical_points(s, d):
    return _cps(s, d)


@query(f"WITH {_morse_sql('none')} SELECT * FROM cps")
def morse_critical_points_untied(s, d):
    return _cps(s, d, "none")


@query(f"WITH {_morse_sql('literal')} SELECT * FROM cps")
def morse_critical_points_perturbed(s, d):
    return _cps(s, d, "literal")


@query(f"""WITH {_morse_sql('rank')} SELECT mesh_id, field, count(*) FILTER (cp_type = 'maximum') AS n_maxima, count(*) FILTER (cp_type = 'minimum') AS n_minima, count(*) FILTER (cp_type = 'saddle') AS n_saddles,
    coalesce(sum(multiplicity) FILTER (cp_type = 'saddle'), 0)::BIGINT AS saddle_index, (count(*) FILTER (cp_type <> 'saddle') - coalesce(sum(multiplicity) FILTER (cp_type = 'saddle'), 0))::BIGINT AS euler FROM cps GROUP BY 1, 2""")
def morse_summary_by_field(s, d):
    return morse.summary(_cps(s, d))


@query(f"WITH {_morse_sql('rank')} SELECT *, upper(substr(cp_type, 1, 3)) || row_number() OVER (PARTITION BY field, cp_type ORDER BY CASE WHEN cp_type = 'maximum' THEN -value ELSE value END, vertex_id) AS label FROM cps")
def critical_point_labels(s, d):
    return morse.labels(_cps(s, d))


@query(f"WITH {_morse_sql('none')}, {_EDGES} SELECT p.mesh_id, p.field, p.cp_type, u, v FROM edges JOIN cps p ON p.vertex_id = u JOIN cps q ON q.vertex_id = v AND q.field = p.field AND q.cp_type = p.cp_type WHERE p.cp_type <> 'saddle'")
def adjacent_same_type_extrema(s, d):
    return morse.adjacent_extrema(_cps(s, d, "none"), C.part_triangles(s, d))


@query(f"WITH {_morse_sql('rank')} SELECT mesh_id, field, row_number() OVER (PARTITION BY field ORDER BY value DESC, vertex_id)::INT AS rank, vertex_id, cp_type AS polarity, value FROM cps WHERE cp_type <> 'saddle'")
def basin_centers(s, d):
    return morse.basin_centers(_cps(s, d))


_BOUNDS = "bounds AS (SELECT mesh_id, field, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM fields GROUP BY 1, 2)"


@query(f"WITH {C.MESH_SQL}, {_BOUNDS} SELECT mesh_id, field, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bounds")
def robust_bounds(s, d):
    return rounded(mesh.robust_bounds(C.part_fields(s, d)))


@query(f"WITH {C.MESH_SQL}, {_BOUNDS} SELECT mesh_id, field, k::INT AS k, round(lo + (hi - lo) * k / 14, 6) AS level FROM bounds, range(15) r(k)")
def contour_levels(s, d):
    return rounded(mesh.contour_levels(mesh.robust_bounds(C.part_fields(s, d)), 15))


@query(f"WITH {C.MESH_SQL}, {_BOUNDS}, g AS (SELECT mesh_id, field, log10(greatest(lo, 1e-4)) AS a, greatest(log10(greatest(hi, 1e-4)), log10(greatest(lo, 1e-4)) + 1) AS b FROM bounds) SELECT mesh_id, field, k::INT AS k, round(pow(10, a + (b - a) * k / 7), 4) AS level FROM g, range(8) r(k)")
def contour_levels_log(s, d):
    return rounded(mesh.contour_levels(mesh.robust_bounds(C.part_fields(s, d)), 8, logarithmic=True), 4)


@query(f"""WITH {C.MESH_SQL}, {_EDGES}, {_BOUNDS}, levels AS (SELECT mesh_id, field, round(lo + (hi - lo) * k / 5, 6) AS level FROM bounds, range(6) r(k))
    SELECT l.mesh_id, l.field, level, u, v, round((level - p.value) / (q.value - p.value), 6) AS t FROM edges JOIN fields p ON p.vertex_id = u JOIN fields q ON q.vertex_id = v AND q.field = p.field
    JOIN levels l ON l.field = p.field WHERE (p.value >= level) <> (q.value >= level)""")
def triangle_level_set(s, d):
    fields = C.part_fields(s, d)
    levels = rounded(mesh.contour_levels(mesh.robust_bounds(fields), 6)).drop("k")
    return rounded(mesh.level_crossings(C.part_triangles(s, d), fields, levels))


@query(f"""WITH {C.MESH_SQL}, patches AS (SELECT 'part/' || (a // 512) AS mesh_id, a, b, c FROM triangles), sides AS (SELECT mesh_id, least(a, b) AS u, greatest(a, b) AS v FROM patches UNION ALL SELECT mesh_id, least(b, c), greatest(b, c) FROM patches UNION ALL SELECT mesh_id, least(c, a), greatest(c, a) FROM patches)
    SELECT mesh_id, u AS a, v AS b, -1::BIGINT AS c FROM sides GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def boundary_edges_wedge(s, d):
    """The wedge of every patch; the sphere's triangles are cut into patches by the key of their first corner."""
    patch = F.concat(F.lit("part/"), F.floor(F.col("a") / 512).cast("string"))
    return mesh.wedge_triangles(C.part_triangles(s, d).withColumn("mesh_id", patch))


_SMOOTH = f"""{C.RINGS_SQL}, sm AS (SELECT *, (value + coalesce(lag(value) OVER w, last_value(value) OVER a) + coalesce(lead(value) OVER w, first_value(value) OVER a)) / 3 AS smooth
    FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY k), a AS (PARTITION BY ring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    nb AS (SELECT *, coalesce(lag(smooth) OVER w, last_value(smooth) OVER a) AS pv, coalesce(lead(smooth) OVER w, first_value(smooth) OVER a) AS nx
    FROM sm WINDOW w AS (PARTITION BY ring_id ORDER BY k), a AS (PARTITION BY ring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    ex AS (SELECT *, CASE WHEN smooth < pv AND smooth <= nx THEN 'valley' WHEN smooth > pv AND smooth >= nx THEN 'ridge' END AS kind FROM nb),
    st AS (SELECT ring_id, max(value) - min(value) AS span, max(smooth) FILTER (kind = 'ridge') AS top, min(smooth) FILTER (kind = 'valley') AS low FROM ex GROUP BY 1),
    ports AS (SELECT ex.ring_id, kind, k, phi, value, phi + greatest(-2 * pi() / n, least(2 * pi() / n, CASE WHEN abs(pv - 2 * smooth + nx) < 1e-300 THEN 0 ELSE 0.5 * 2 * pi() / n * (pv - nx) / (pv - 2 * smooth + nx) END)) AS phi_refined
    FROM ex JOIN st USING (ring_id) WHERE kind IS NOT NULL AND coalesce(CASE WHEN kind = 'valley' THEN top - smooth ELSE smooth - low END >= greatest(0.05 * span, 1e-12) OR span < 1e-12, true)),
    named AS (SELECT *, CASE kind WHEN 'valley' THEN 'VPORT_' ELSE 'RPORT_' END || row_number() OVER (PARTITION BY ring_id, kind ORDER BY k) AS port_id FROM ports)"""


@query(f"WITH {_SMOOTH} SELECT ring_id, k, round(smooth, 6) AS smooth, kind FROM ex")
def ring_local_extrema(s, d):
    return rounded(rings.extrema(rings.smoothed(C.event_rings(s, d))).select("ring_id", "k", "smooth", "kind"))


@query(f"WITH {_SMOOTH} SELECT ring_id, port_id, kind, k, round(phi, 6) AS phi, round(phi_refined, 6) AS phi_refined, value FROM named")
def ring_ports(s, d):
    return rounded(rings.ports(C.event_rings(s, d)))


@query(f"WITH {_SMOOTH}, c AS (SELECT r.ring_id, count(*) FILTER (kind = 'valley') AS v, count(*) FILTER (kind = 'ridge') AS r FROM (SELECT DISTINCT ring_id FROM rings) r LEFT JOIN named USING (ring_id) GROUP BY 1) SELECT ring_id, v AS n_valleys, r AS n_ridges, v = r AND v > 0 AS balanced, greatest(v, r) AS fold, CASE WHEN greatest(v, r) > 0 THEN 1 - greatest(v, r) ELSE 1 END AS euler FROM c")
def ring_balance(s, d):
    r = C.event_rings(s, d)
    return rings.boundary_balance(r, rings.ports(r))


@query(f"WITH {_SMOOTH}, g AS (SELECT ring_id, kind, coalesce(lag(kind) OVER (PARTITION BY ring_id ORDER BY k), first_value(kind) OVER (PARTITION BY ring_id ORDER BY k DESC)) AS before FROM named) SELECT ring_id, count(*) AS n_ports, bool_and(kind <> before) AS alternating FROM g GROUP BY 1")
def ring_alternation(s, d):
    return rings.alternates(rings.ports(C.event_rings(s, d)))


_CROSS = f"""{_SMOOTH}, lv AS (SELECT *, avg(value) OVER (PARTITION BY ring_id) AS level, coalesce(lead(value) OVER (PARTITION BY ring_id ORDER BY k), first_value(value) OVER (PARTITION BY ring_id ORDER BY k)) AS nxv FROM rings),
    crossings AS (SELECT ring_id, k, CASE WHEN p >= 2 * pi() THEN p - 2 * pi() ELSE p END AS phi FROM (SELECT *, phi + (level - value) / (nxv - value) * 2 * pi() / n AS p FROM lv WHERE (value >= level) <> (nxv >= level)))"""


def _crossings(r: DataFrame) -> DataFrame:
    return rings.level_crossings(r, F.avg("value").over(rings.whole_ring()))


@query(f"WITH {_CROSS} SELECT ring_id, k, round(phi, 6) AS phi FROM crossings")
def ring_level_crossings(s, d):
    return rounded(_crossings(C.event_rings(s, d)))


@query(f"""WITH {_CROSS}, arcs AS (SELECT ring_id, port_id, p.phi AS p, min((c.phi - p.phi) - floor((c.phi - p.phi) / (2 * pi())) * 2 * pi()) AS hi, min((p.phi - c.phi) - floor((p.phi - c.phi) / (2 * pi())) * 2 * pi()) AS lo FROM named p JOIN crossings c USING (ring_id) GROUP BY 1, 2, 3)
    SELECT ring_id, port_id, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, round(avg(value), 6) AS mean FROM arcs JOIN rings USING (ring_id)
    WHERE (phi - p) - floor((phi - p) / (2 * pi())) * 2 * pi() <= hi OR (p - phi) - floor((p - phi) / (2 * pi())) * 2 * pi() <= lo GROUP BY 1, 2""")
def ring_sector_means(s, d):
    r = C.event_rings(s, d)
    return rounded(rings.sector_means(r, rings.ports(r), _crossings(r)))


_POWER = f"{C.RINGS_SQL}, power AS (SELECT ring_id, bin::INT AS bin, sum(value * cos(2 * pi() * bin * k / n))**2 + sum(value * sin(2 * pi() * bin * k / n))**2 AS power FROM rings, range(1, 13) r(bin) GROUP BY 1, 2)"


@query(f"WITH {_POWER} SELECT ring_id, bin, round(power, 4) AS power FROM power")
def ring_harmonic_power(s, d):
    return rounded(rings.harmonic_power(C.event_rings(s, d), 12), 4)


@query(f"WITH {_POWER} SELECT ring_id, round(greatest(0, 1 - sum(power) FILTER (bin = 3) / sum(power)), 6) AS energy FROM power GROUP BY 1")
def ring_symmetry_energy(s, d):
    return rounded(rings.symmetry_energy(C.event_rings(s, d), 3))


_GAPS = f"""{_SMOOTH}, gaps AS (SELECT ring_id, kind, coalesce(lead(phi) OVER w, first_value(phi) OVER w) - phi AS g, coalesce(lag(kind) OVER w, last_value(kind) OVER (PARTITION BY ring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before
    FROM named WINDOW w AS (PARTITION BY ring_id ORDER BY k))"""


@query(f"WITH {_GAPS} SELECT ring_id, round(CASE WHEN count(*) <> 6 OR NOT bool_and(kind <> before) THEN 1e6 ELSE sum((degrees(g - floor(g / (2 * pi())) * 2 * pi()) - 60)**2) END, 6)::DOUBLE AS energy FROM gaps GROUP BY 1")
def ring_spacing_energy(s, d):
    return rounded(rings.port_spacing_energy(rings.ports(C.event_rings(s, d))))


@query(f"""WITH {_SMOOTH}, ph AS (SELECT *, count(*) OVER g = 3 AS own, atan2(sum(sin(3 * phi)) OVER g, sum(cos(3 * phi)) OVER g) AS a, row_number() OVER (PARTITION BY ring_id, kind ORDER BY phi) - 1 AS nr FROM named WINDOW g AS (PARTITION BY ring_id, kind)),
    mv AS (SELECT *, (a - floor(a / (2 * pi())) * 2 * pi()) / 3 + 2 * pi() * nr / 3 AS p FROM ph)
    SELECT ring_id, kind, CASE WHEN own THEN port_id || '_PERF' ELSE port_id END AS port_id, round(CASE WHEN own THEN p - floor(p / (2 * pi())) * 2 * pi() ELSE phi END, 6) AS phi FROM mv""")
def ring_perfected_ports(s, d):
    return rounded(rings.perfected_ports(rings.ports(C.event_rings(s, d)), 3))


def _centres(s, d) -> DataFrame:
    cps = _cps(s, d).join(C.part_vertices(s, d).hint("merge"), ["mesh_id", "vertex_id"])
    return cps.select("mesh_id", "field", F.col("vertex_id").alias("ring_id"), *[F.col(n).alias(f"u{n}") for n in "xyz"], F.lit(0.3).alias("a"), F.lit(0.2).alias("b"), F.lit(1.0).alias("sphere_radius"))


_RING_SAMPLES = f"""{_morse_sql('rank')}, ctr AS (SELECT field, vertex_id AS ring_id, x AS ux, y AS uy, z AS uz FROM cps JOIN vertices USING (vertex_id)),
    h AS (SELECT *, CASE WHEN abs(uz) >= 0.9 THEN 1.0 ELSE 0.0 END AS hx, CASE WHEN abs(uz) >= 0.9 THEN 0.0 ELSE 1.0 END AS hz FROM ctr),
    c1 AS (SELECT *, uy * hz AS ax, uz * hx - ux * hz AS ay, -uy * hx AS az FROM h),
    t1 AS (SELECT field, ring_id, ux, uy, uz, ax / sqrt(ax*ax+ay*ay+az*az) AS sx, ay / sqrt(ax*ax+ay*ay+az*az) AS sy, az / sqrt(ax*ax+ay*ay+az*az) AS sz FROM c1),
    t2 AS (SELECT *, uy*sz - uz*sy AS tx, uz*sx - ux*sz AS ty, ux*sy - uy*sx AS tz FROM t1),
    smp AS (SELECT t2.*, g.k::INT AS k, 2 * pi() * g.k / 16 AS phi, sqrt((0.3 * cos(2 * pi() * g.k / 16))**2 + (0.2 * sin(2 * pi() * g.k / 16))**2) AS r FROM t2, range(16) g(k)),
    samples AS (SELECT field, ring_id, k, phi, cos(r)*ux + sin(r)*(cos(phi)*sx + sin(phi)*tx) AS x, cos(r)*uy + sin(r)*(cos(phi)*sy + sin(phi)*ty) AS y, cos(r)*uz + sin(r)*(cos(phi)*sz + sin(phi)*tz) AS z FROM smp)"""


@query(_RING_SAMPLES.join(["WITH ", " SELECT field, ring_id, k, 16 AS n, round(phi, 6) AS phi, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM samples"]))
def ring_samples(s, d):
    return rounded(rings.ring_samples(_centres(s, d), 16).drop("mesh_id"))


@query(_RING_SAMPLES.replace("(0.2 *", "(0.3 *").join(["WITH ", """, mn AS (SELECT field, ring_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM samples GROUP BY 1, 2), cn AS (SELECT *, sqrt(mx*mx+my*my+mz*mz) AS l FROM mn)
    SELECT 'part' AS mesh_id, field, ring_id, any_value(n) AS n, round(any_value(mx / l), 6) + 0.0 AS cx, round(any_value(my / l), 6) + 0.0 AS cy, round(any_value(mz / l), 6) + 0.0 AS cz, round(acos(avg((x*mx+y*my+z*mz) / l)), 6) AS angular_radius FROM samples JOIN cn USING (field, ring_id) GROUP BY field, ring_id"""]))
def ring_frames(s, d):
    """Centres and radii recovered from circular rings."""
    circles = _centres(s, d).withColumn("b", F.col("a"))
    return rounded(rings.ring_frame(rings.ring_samples(circles, 16)))


@query(f"""WITH {_RING_SAMPLES}, kn AS (SELECT s.field, ring_id, k, vertex_id, acos(greatest(-1.0, least(1.0, s.x*v.x+s.y*v.y+s.z*v.z))) AS th FROM samples s JOIN vertices v ON true),
    rk AS (SELECT *, row_number() OVER (PARTITION BY field, ring_id, k ORDER BY round(th, 9), vertex_id) AS r FROM kn), u AS (SELECT rk.field, ring_id, k, greatest(th, 1e-7) AS th, r, value FROM rk JOIN fields f ON f.vertex_id = rk.vertex_id AND f.field = rk.field WHERE r <= 4)
    SELECT 'part' AS mesh_id, field, ring_id, k, round(CASE WHEN min(th) <= 1e-7 THEN arg_min(value, r) ELSE sum(value / th**2) / sum(1 / th**2) END, 3) AS value FROM u GROUP BY field, ring_id, k""")
def ring_idw(s, d):
    samples = rings.ring_samples(_centres(s, d), 16)
    return rounded(rings.interpolate(samples, C.part_vertices(s, d), C.part_fields(s, d)), 3).withColumn("ring_id", F.col("ring_id").cast("bigint"))


@query(f"""WITH {_morse_sql('rank')}, ctr AS (SELECT field, vertex_id AS entity_id, x AS cx, y AS cy, z AS cz FROM cps JOIN vertices USING (vertex_id)),
    near AS (SELECT c.field, entity_id, value, acos(greatest(-1.0, least(1.0, cx*x+cy*y+cz*z))) AS th FROM ctr c JOIN vertices v ON cx*x+cy*y+cz*z >= cos(0.46) JOIN fields f ON f.vertex_id = v.vertex_id AND f.field = c.field),
    ok AS (SELECT *, th BETWEEN 0.1 AND 0.30000000000000004 AS ring FROM near WHERE th <= 0.45000000000000007), e AS (SELECT field, entity_id, count(*) FILTER (ring) >= 3 AS narrow FROM ok GROUP BY 1, 2), us AS (SELECT ok.* FROM ok JOIN e USING (field, entity_id) WHERE ring OR NOT narrow),
    md AS (SELECT field, entity_id, quantile_cont(th, 0.5) AS m FROM us GROUP BY 1, 2), g AS (SELECT field, entity_id, count(*) AS n, CASE WHEN var_pop(th) < 1e-12 THEN 0.0 ELSE covar_samp(value, th) / var_pop(th) END AS sl, avg(value) FILTER (th > m + 1e-9) - avg(value) FILTER (th <= m + 1e-9) AS df FROM us JOIN md USING (field, entity_id) GROUP BY 1, 2)
    SELECT 'part' AS mesh_id, field, entity_id, n, round(sl, 1) AS slope, CASE WHEN df IS NULL THEN 0.8 WHEN abs(sl) < 1e-9 THEN 0.5 WHEN (df > 0 AND sl > 0) OR (df < 0 AND sl < 0) THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM g""")
def radial_slopes(s, d):
    centres = _centres(s, d).select("mesh_id", "field", F.col("ring_id").alias("entity_id"), "ux", "uy", "uz", F.lit(0.1).alias("radius"))
    return slopes.dense_radial_slope(centres, C.part_vertices(s, d), C.part_fields(s, d), 0.1).withColumn("slope", F.round("slope", 1) + 0.0)


def _clusters(s, d) -> DataFrame:
    return spherical.distinct_clusters(table(s, d, "clusters"))


_CL = "cl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY recorded_at DESC) AS rn FROM clusters WHERE ux IS NOT NULL) WHERE rn = 1)"


def _reach(p: str, q: str) -> str:
    b = [f"({q}.u{n} - dt * {p}.u{n})" for n in "xyz"]
    ax = [f"({p}.p{n} - ({p}.px*{p}.ux+{p}.py*{p}.uy+{p}.pz*{p}.uz) * {p}.u{n})" for n in "xyz"]
    nb, nl = f"sqrt({b[0]}**2+{b[1]}**2+{b[2]}**2)", f"sqrt({ax[0]}**2+{ax[1]}**2+{ax[2]}**2)"
    cos2 = f"least(1.0, (({b[0]}*{ax[0]}+{b[1]}*{ax[1]}+{b[2]}*{ax[2]}) / ({nb} * {nl}))**2)"
    a, m = f"{p}.semi_major_rad", f"{p}.semi_minor_rad"
    return f"CASE WHEN {a} <= 0 THEN 0 WHEN {m} <= 0 OR abs({a} - {m}) <= 1e-12 OR {nb} < 1e-12 OR {nl} < 1e-9 THEN {a} ELSE sqrt({a}*{a}*{cos2} + {m}*{m}*greatest(0.0, 1 - {cos2})) END"


_PAIRS = f"""{_CL}, dots AS (SELECT p.mesh_id, p.field, p AS p, q AS q, p.ux*q.ux+p.uy*q.uy+p.uz*q.uz AS dt FROM cl p JOIN cl q ON p.mesh_id = q.mesh_id AND p.field = q.field AND p.cluster_id < q.cluster_id),
    pairs AS (SELECT *, acos(greatest(-1.0, least(1.0, dt))) AS ang, acos(greatest(-1.0, least(1.0, dt))) - ({_reach('p', 'q')}) - ({_reach('q', 'p')}) AS gap FROM dots)"""
_AXIS = "CASE WHEN p.morphology = 'string' AND q.morphology = 'string' THEN degrees(acos(least(1.0, abs(p.px*q.px+p.py*q.py+p.pz*q.pz) / (sqrt(p.px**2+p.py**2+p.pz**2) * sqrt(q.px**2+q.py**2+q.pz**2))))) END"


@query(f"WITH {_PAIRS}, j AS (SELECT mesh_id, field, p.cluster_id AS cluster_a, q.cluster_id AS cluster_b, round(gap, 5) AS gap_rad, {_AXIS} AS ax FROM pairs WHERE gap <= {3.0 * PITCH}) SELECT mesh_id, field, cluster_a, cluster_b, gap_rad, round(ax, 3) AS axis_angle_deg, ax IS NULL OR ax <= 30 AS is_linked, CASE WHEN ax IS NULL OR ax <= 30 THEN 'linked' ELSE printf('axis angle %.2f deg exceeds tolerance 30.00 deg', ax) END AS reason FROM j")
def bridge_links(s, d):
    links = spherical.bridge_links(_clusters(s, d), PITCH)
    return links.select("mesh_id", "field", "cluster_a", "cluster_b", F.round("gap_rad", 5).alias("gap_rad"), F.round("axis_angle_deg", 3).alias("axis_angle_deg"), "is_linked", "reason")


@query(f"""WITH {_CL}, lg AS (SELECT p.mesh_id, p.field, p.cluster_id AS cluster_a, q.cluster_id AS cluster_b, acos(greatest(-1.0, least(1.0, p.ux*q.ux+p.uy*q.uy+p.uz*q.uz))) AS ang, coalesce(p.morphology = 'string' OR q.morphology = 'string', false) AS ok FROM cl p JOIN cl q ON p.mesh_id = q.mesh_id AND p.field = q.field AND p.cluster_id < q.cluster_id)
    SELECT mesh_id, field, cluster_a, cluster_b, round(ang, 5) AS gap_rad, ok AS is_linked, CASE WHEN ok THEN 'linked' ELSE 'legacy rule: not linked' END AS reason FROM lg WHERE ang <= {6.0 * PITCH}""")
def bridge_links_legacy(s, d):
    """Links by the older rule: centres within the gap, here six pitches, one of the two a string."""
    links = spherical.bridge_links(_clusters(s, d), PITCH, 6.0, bridge_all=False)
    return links.select("mesh_id", "field", "cluster_a", "cluster_b", F.round("gap_rad", 5).alias("gap_rad"), "is_linked", "reason")


_TB, _TA = [f"(q.u{n} - dt * p.u{n})" for n in "xyz"], [f"(p.p{n} - (p.px*p.ux+p.py*p.uy+p.pz*p.uz) * p.u{n})" for n in "xyz"]
_NB, _NA = (f"sqrt({v[0]}**2 + {v[1]}**2 + {v[2]}**2)" for v in (_TB, _TA))
_BEARING = f"CASE WHEN {_NB} >= 1e-9 AND {_NA} >= 1e-9 THEN degrees(acos(least(1.0, abs(({_TB[0]}*{_TA[0]}+{_TB[1]}*{_TA[1]}+{_TB[2]}*{_TA[2]}) / ({_NB} * {_NA}))))) END"


def _composition(p: str) -> str:
    sad = f"CASE WHEN {p}.n_saddles > 0 THEN {p}.n_saddles || ' Sad' || CASE WHEN {p}.total_saddle_index > {p}.n_saddles THEN ' (mult ' || {p}.total_saddle_index || ')' ELSE '' END END"
    whole = f"concat_ws(', ', CASE WHEN {p}.n_maxima > 0 THEN {p}.n_maxima || ' Max' END, {sad}, CASE WHEN {p}.n_minima > 0 THEN {p}.n_minima || ' Min' END)"
    return f"CASE WHEN {whole} = '' THEN '0 CPs' ELSE {whole} END"


@query(f"WITH {_PAIRS} SELECT mesh_id, field, p.cluster_id AS id_a, q.cluster_id AS id_b, {_composition('p')} AS composition_a, {_composition('q')} AS composition_b, round(ang, 5) AS centroid_rad, round(gap / {PITCH}, 3) AS gap_dtheta, CASE WHEN {_BEARING} IS NULL THEN -1.0 ELSE round({_BEARING}, 2) END::DOUBLE AS bearing_a_deg, p.local_euler_index + q.local_euler_index AS chi_sum FROM pairs WHERE gap < {12 * PITCH}")
def pair_clearances(s, d):
    return spherical.clearances(_clusters(s, d), PITCH).select(
        "mesh_id", "field", "id_a", "id_b", "composition_a", "composition_b",
        F.round("centroid_rad", 5).alias("centroid_rad"), F.round("gap_dtheta", 3).alias("gap_dtheta"), F.round("bearing_a_deg", 2).alias("bearing_a_deg"), "chi_sum",
    )


@query(f"""WITH {_PAIRS}, b AS (SELECT mesh_id, field, CASE WHEN gap < 0 THEN -1 ELSE least(24, floor(gap / {PITCH} / 0.5))::INT END AS bin, count(*) AS n FROM pairs GROUP BY 1, 2, 3),
    frame AS (SELECT mesh_id, field, r.bin::INT AS bin FROM (SELECT DISTINCT mesh_id, field FROM cl), range(-1, 25) r(bin))
    SELECT mesh_id, field, bin, CASE WHEN bin >= 0 THEN bin * 0.5 END::DOUBLE AS low, (CASE WHEN bin < 0 THEN 0 WHEN bin < 24 THEN (bin + 1) * 0.5 END)::DOUBLE AS high,
    CASE WHEN bin < 0 THEN 'overlap' WHEN bin * 0.5 + 0.25 < 2.5 THEN 'intra' WHEN bin * 0.5 + 0.25 < 6 THEN 'meso' ELSE 'macro' END AS zone, coalesce(n, 0) AS n FROM frame LEFT JOIN b USING (mesh_id, field, bin)""")
def pair_histogram(s, d):
    return spherical.clearance_histogram(_clusters(s, d), PITCH)


@query(f"WITH {_CL}, r AS (SELECT *, list_transform(members, lambda m: m.value) AS vals, CASE WHEN len(members) < 2 THEN 'SINGLE' WHEN local_euler_index = 0 THEN 'E-NONE' WHEN local_euler_index = 1 THEN CASE WHEN n_maxima > n_minima THEN 'E-MAX' ELSE 'E-MIN' END WHEN local_euler_index < 0 THEN 'E-SAD' ELSE 'IRREDUCIBLE' END AS decision FROM cl) SELECT mesh_id, field, cluster_id, decision, CASE WHEN decision IN ('E-MAX', 'E-SAD') THEN list_max(vals) WHEN decision = 'E-MIN' THEN list_min(vals) END AS effective_value, (CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN 0 ELSE len(members) END)::INT AS n_hidden, local_euler_index AS shown_index FROM r")
def reduction_decisions(s, d):
    return spherical.reduction(_clusters(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
