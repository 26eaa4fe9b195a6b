"""Queries from critical points to clusters, strings and what replaces them, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from math import degrees, radians

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarscape.operators import catastrophe, clustering, rings
from scalarscape.plans import carriers as C
from scalarscape.plans.topology import _CL, PITCH, _clusters, _cps, _morse_sql, _reach, rounded
from scalarscape.session import cut_lineage

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MARGIN = radians(1.5)


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def geometry_sql(source: str, group: str, p: str) -> str:
    """CTEs ``<p>shape``: the pooled geometry of the points of ``source`` (group columns, vertex_id, cp_type, value, multiplicity, x, y, z; a vertex once a group)."""
    dot = lambda a, b: "(" + "+".join(f"{a}{m}*{b}{m}" for m in "xyz") + ")"
    cos = f"greatest(-1.0, least(1.0, {dot('u', 'c')}))"
    flat = [f"(u{m} - {dot('u', 'c')} * c{m})" for m in "xyz"]
    length = f"sqrt({'+'.join(f'{x}**2' for x in flat)})"
    part = lambda axis: f"CASE WHEN acos({cos}) > 1e-12 AND {length} > 1e-12 THEN acos({cos}) * ({'+'.join(f'{x}*{axis}{m}' for x, m in zip(flat, 'xyz', strict=True))}) / {length} ELSE 0.0 END"
    big, small = "(pp + qq) / 2 + sqrt(((pp - qq) / 2)**2 + pq**2)", "(pp + qq) / 2 - sqrt(((pp - qq) / 2)**2 + pq**2)"
    return f"""{p}u AS (SELECT {group}, vertex_id, cp_type, value, multiplicity, x / n AS ux, y / n AS uy, z / n AS uz FROM (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM {source})),
    {p}s AS (SELECT {group}, count(*) AS n_members, count(*) FILTER (cp_type = 'maximum') AS n_maxima, count(*) FILTER (cp_type = 'minimum') AS n_minima, count(*) FILTER (cp_type = 'saddle') AS n_saddles,
        coalesce(sum(multiplicity) FILTER (cp_type = 'saddle'), 0)::BIGINT AS total_saddle_index, max(value) AS value_max, min(value) AS value_min, avg(ux) AS mx, avg(uy) AS my, avg(uz) AS mz, arg_min(ux, vertex_id) AS fx, arg_min(uy, vertex_id) AS fy, arg_min(uz, vertex_id) AS fz FROM {p}u GROUP BY {group}),
    {p}n AS (SELECT *, sqrt(mx*mx+my*my+mz*mz) AS nm FROM {p}s),
    {p}c AS (SELECT *, CASE WHEN nm > 1e-8 THEN mx / nm ELSE fx END AS cx, CASE WHEN nm > 1e-8 THEN my / nm ELSE fy END AS cy, CASE WHEN nm > 1e-8 THEN mz / nm ELSE fz END AS cz FROM {p}n),
    {p}h AS (SELECT *, CASE WHEN abs(cz) >= 0.9 THEN 0.0 ELSE cy END AS hx, CASE WHEN abs(cz) >= 0.9 THEN cz ELSE -cx END AS hy, CASE WHEN abs(cz) >= 0.9 THEN -cy ELSE 0.0 END AS hz FROM {p}c),
    {p}t AS (SELECT *, hx / sqrt(hx*hx+hy*hy+hz*hz) AS sx, hy / sqrt(hx*hx+hy*hy+hz*hz) AS sy, hz / sqrt(hx*hx+hy*hy+hz*hz) AS sz FROM {p}h),
    {p}b AS (SELECT *, cy*sz - cz*sy AS tx, cz*sx - cx*sz AS ty, cx*sy - cy*sx AS tz FROM {p}t),
    {p}m AS (SELECT {group}, acos({cos}) AS theta, {part('s')} AS p, {part('t')} AS q FROM {p}u JOIN {p}b USING ({group})),
    {p}v AS (SELECT {group}, max(theta) AS max_theta, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq FROM {p}m GROUP BY {group}),
    {p}a AS (SELECT *, CASE WHEN abs(pp - qq) <= 1e-16 AND abs(pq) <= 1e-16 THEN 0.0 ELSE atan2(2 * pq, pp - qq) / 2 END AS turn, sqrt(greatest({big}, 1e-16) / greatest({small}, 1e-16)) AS aspect FROM {p}v),
    {p}e AS (SELECT {group}, max(abs((p - mp) * cos(turn) + (q - mq) * sin(turn))) AS max_major, max(abs((q - mq) * cos(turn) - (p - mp) * sin(turn))) AS max_minor FROM {p}m JOIN {p}a USING ({group}) GROUP BY {group}),
    {p}shape AS (SELECT {group}, n_members, n_maxima, n_minima, n_saddles, total_saddle_index, (n_maxima + n_minima - total_saddle_index)::BIGINT AS local_euler_index, value_max, value_min, cx AS ux, cy AS uy, cz AS uz, max_theta,
        CASE WHEN n_members < 2 THEN 1.0 ELSE least(aspect, 999.0) END AS aspect_ratio, wx * sg AS px, wy * sg AS py, wz * sg AS pz, max_major, max_minor
        FROM (SELECT *, CASE WHEN abs(wx) > 1e-6 THEN sign(wx) WHEN abs(wy) > 1e-6 THEN sign(wy) ELSE sign(wz) END AS sg FROM (SELECT *, sx*cos(turn)+tx*sin(turn) AS wx, sy*cos(turn)+ty*sin(turn) AS wy, sz*cos(turn)+tz*sin(turn) AS wz FROM {p}b JOIN {p}a USING ({group}) JOIN {p}e USING ({group}))))"""


_SHAPE = "n_members, n_maxima, n_minima, n_saddles, total_saddle_index, local_euler_index, value_max, value_min, ux, uy, uz, max_theta, aspect_ratio, px, py, pz, max_major, max_minor"
_ROUND = ", ".join(f"round({c}, 4) + 0.0 AS {c}" if c in ("ux", "uy", "uz", "max_theta", "px", "py", "pz", "max_major", "max_minor") else f"round({c}, 2) AS {c}" if c == "aspect_ratio" else c for c in _SHAPE.split(", "))


def shown(df: DataFrame) -> DataFrame:
    """Geometry rounded: angles to 4 digits, the aspect, a quotient, to 2."""
    return df.select(*[(F.round(c, 2 if c == "aspect_ratio" else 4) + 0.0).alias(c) if t == "double" and not c.startswith("value_") else F.col(c) for c, t in df.dtypes])


# --- clusters of the critical points of the part sphere ---------------------------------------------------------------

REACH = 2.0 * PITCH
_MICRO = f"""{_morse_sql('rank').replace('vertices AS (', 'vertices AS MATERIALIZED (', 1)}, pts AS MATERIALIZED (SELECT c.mesh_id, c.field, c.vertex_id, cp_type, value, multiplicity, x, y, z FROM cps c JOIN vertices v ON v.vertex_id = c.vertex_id),
    near AS MATERIALIZED (SELECT p.field, p.vertex_id AS a, q.vertex_id AS b FROM pts p JOIN pts q ON p.field = q.field AND p.vertex_id <> q.vertex_id AND abs(p.z - q.z) <= {REACH} AND acos(greatest(-1.0, least(1.0, p.x*q.x+p.y*q.y+p.z*q.z))) <= {REACH}),
    reach(field, v, r) AS (SELECT field, vertex_id, vertex_id FROM pts UNION SELECT n.field, n.b, reach.r FROM reach JOIN near n ON n.field = reach.field AND n.a = reach.v),
    grp AS (SELECT field, v AS vertex_id, min(r) AS root FROM reach GROUP BY 1, 2), src AS (SELECT pts.*, root FROM pts JOIN grp USING (field, vertex_id)),
    {geometry_sql('src', 'mesh_id, field, root', 'g')},
    micro AS (SELECT mesh_id, field, 'MC' || row_number() OVER (PARTITION BY mesh_id, field ORDER BY n_members DESC, root) AS cluster_id, root, {_SHAPE}, n_members > 1 AS is_multi_cp, CASE WHEN n_members > 1 AND aspect_ratio >= 2 THEN 'string' ELSE 'compact' END AS morphology,
        greatest(max_theta + {MARGIN}, {REACH / 2}) AS angular_radius_rad FROM gshape),
    mc AS (SELECT *, CASE WHEN morphology = 'string' THEN greatest(max_major + {MARGIN}, {REACH / 2}) ELSE angular_radius_rad END AS semi_major_rad, CASE WHEN morphology = 'string' THEN greatest(max_minor + {MARGIN}, {REACH / 2}) ELSE angular_radius_rad END AS semi_minor_rad FROM micro)"""


def _points(s, d) -> DataFrame:
    return cut_lineage(_cps(s, d).join(C.part_vertices(s, d).hint("merge"), ["mesh_id", "vertex_id"]))


def _micro(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, memberships and clusters, each worked out once."""
    points = _points(s, d)
    groups = cut_lineage(clustering.memberships(points, REACH))
    return points, groups, cut_lineage(clustering.micro_clusters(points, PITCH, groups=groups))


@query(f"WITH RECURSIVE {_MICRO} SELECT mesh_id, field, vertex_id, root FROM src")
def micro_memberships(s, d):
    return clustering.memberships(_points(s, d), REACH)


@query(f"WITH RECURSIVE {_MICRO} SELECT mesh_id, field, cluster_id, root, {_ROUND}, is_multi_cp, morphology, round(angular_radius_rad, 4) AS angular_radius_rad, round(semi_major_rad, 4) AS semi_major_rad, round(semi_minor_rad, 4) AS semi_minor_rad FROM mc")
def micro_clusters(s, d):
    return shown(_micro(s, d)[2])


@query()
def micro_boundaries(s, d):
    """48 samples of the fitted boundary of each cluster."""
    return rounded(rings.ring_samples(clustering.boundary_centres(_micro(s, d)[2]), 48))


_SLOPES = f"""ctr AS (SELECT field, cluster_id, ux AS ax, uy AS ay, uz AS az, greatest(angular_radius_rad, {PITCH}) AS inn FROM mc),
    nr AS (SELECT c.field, cluster_id, f.value, inn, acos(greatest(-1.0, least(1.0, ax*x+ay*y+az*z))) AS th FROM ctr c JOIN vertices v ON abs(az - z) <= greatest((inn + {2 * PITCH}) * 1.5, inn + 0.05) JOIN fields f ON f.vertex_id = v.vertex_id AND f.field = c.field),
    ok AS (SELECT *, th BETWEEN inn AND inn + {2 * PITCH} AS ring FROM nr WHERE th <= greatest((inn + {2 * PITCH}) * 1.5, inn + 0.05)), en AS (SELECT field, cluster_id, count(*) FILTER (ring) >= 3 AS narrow FROM ok GROUP BY 1, 2),
    us AS (SELECT ok.* FROM ok JOIN en USING (field, cluster_id) WHERE ring OR NOT narrow), md AS (SELECT field, cluster_id, quantile_cont(th, 0.5) AS m FROM us GROUP BY 1, 2),
    sl AS (SELECT field, cluster_id, round(CASE WHEN count(*) < 2 OR var_pop(th) < 1e-12 THEN 0.0 ELSE covar_samp(value, th) / var_pop(th) END, 7) + 0.0 AS slope, count(*) AS n, avg(value) FILTER (th > m + 1e-9) - avg(value) FILTER (th <= m + 1e-9) AS df FROM us JOIN md USING (field, cluster_id) GROUP BY 1, 2),
    pol AS (SELECT mc.*, coalesce(slope, 0.0) AS slope, CASE WHEN slope < -1e-12 THEN 'E-MAX' WHEN slope > 1e-12 THEN 'E-MIN' WHEN n_maxima > n_minima THEN 'E-MAX' ELSE 'E-MIN' END AS polarity,
        CASE WHEN NOT coalesce(abs(slope) > 1e-12, false) THEN 0.5 WHEN n < 2 THEN 0.0 WHEN df IS NULL THEN 0.8 WHEN abs(slope) < 1e-9 THEN 0.5 WHEN (df > 0 AND slope > 0) OR (df < 0 AND slope < 0) THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM mc LEFT JOIN sl USING (field, cluster_id))"""


def _polarity(s, d, units: DataFrame, unit: str) -> DataFrame:
    return clustering.polarity(units, C.part_vertices(s, d), C.part_fields(s, d), PITCH, unit)


@query(f"WITH RECURSIVE {_MICRO}, {_SLOPES} SELECT mesh_id, field, cluster_id, polarity, CASE WHEN polarity = 'E-MAX' THEN value_max ELSE value_min END AS effective_value, round(slope, 1) AS slope, confidence FROM pol")
def cluster_polarity(s, d):
    return _polarity(s, d, _micro(s, d)[2], "cluster_id").withColumn("slope", F.round("slope", 1))


_DECIDED = """de AS (SELECT *, CASE WHEN n_members < 2 THEN 'SINGLE' WHEN local_euler_index = 0 THEN 'E-NONE' WHEN local_euler_index = 1 THEN polarity WHEN local_euler_index < 0 THEN 'E-SAD' ELSE 'IRREDUCIBLE' END AS decision FROM pol)"""


def _reduced(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, groups, units = _micro(s, d)
    return groups, units, clustering.reduced_units(units, _polarity(s, d, units, "cluster_id"), "cluster_id")


@query(f"""WITH RECURSIVE {_MICRO}, {_SLOPES}, {_DECIDED} SELECT mesh_id, field, cluster_id, decision, CASE WHEN decision = 'E-SAD' OR decision = 'E-MAX' THEN value_max WHEN decision = 'E-MIN' THEN value_min END AS effective_value,
    (CASE WHEN decision = 'E-SAD' THEN 1 - local_euler_index ELSE 0 END)::INT AS fold_order, CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN 0 ELSE n_members END AS n_hidden, local_euler_index AS shown_index FROM de""")
def micro_reduction(s, d):
    return _reduced(s, d)[2]


@query(f"""WITH RECURSIVE {_MICRO}, {_SLOPES}, {_DECIDED} SELECT mesh_id, field, count(*) AS n_units, count(*) FILTER (decision IN ('E-MAX', 'E-MIN', 'E-SAD')) AS n_reduced, count(*) FILTER (decision = 'E-NONE') AS n_annihilated, count(*) FILTER (decision = 'IRREDUCIBLE') AS n_irreducible,
    sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN 0 ELSE n_members END)::BIGINT AS n_hidden, sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN n_maxima WHEN decision = 'E-MAX' THEN 1 ELSE 0 END)::BIGINT AS maxima,
    sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN n_minima WHEN decision = 'E-MIN' THEN 1 ELSE 0 END)::BIGINT AS minima, sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN n_saddles WHEN decision = 'E-SAD' THEN 1 ELSE 0 END)::BIGINT AS saddles,
    sum(local_euler_index)::BIGINT AS euler FROM de GROUP BY 1, 2""")
def micro_stage_reduction(s, d):
    return clustering.stage_summary(*_reduced(s, d)[1:], "cluster_id")


@query(f"WITH RECURSIVE {_MICRO}, {_SLOPES}, {_DECIDED} SELECT src.mesh_id, src.field, src.vertex_id FROM src JOIN de USING (field, root) WHERE decision NOT IN ('SINGLE', 'IRREDUCIBLE')")
def hidden_points(s, d):
    """Critical points that the reduction of their cluster hides."""
    _, groups, units = _micro(s, d)
    return clustering.hidden_vertices(groups, units, clustering.hidden_counts(units))


# --- corridors of those clusters ----------------------------------------------------------------------------------------

_DOT = "p.ux*q.ux+p.uy*q.uy+p.uz*q.uz"
_LINK_AXIS = "(p.morphology <> 'string' OR q.morphology <> 'string' OR degrees(acos(least(1.0, abs(p.px*q.px+p.py*q.py+p.pz*q.pz)))) <= 30)"
_STRINGS = f"""{_MICRO}, br AS MATERIALIZED (SELECT p.field, p.root AS a, q.root AS b FROM (SELECT p.field, p AS p, q AS q, {_DOT} AS dt FROM mc p JOIN mc q ON p.field = q.field AND p.root <> q.root)
        WHERE acos(greatest(-1.0, least(1.0, dt))) - ({_reach('p', 'q')}) - ({_reach('q', 'p')}) <= {3 * PITCH} AND {_LINK_AXIS}),
    cor(field, v, r) AS (SELECT field, root, root FROM mc UNION SELECT br.field, br.b, cor.r FROM cor JOIN br ON br.field = cor.field AND br.a = cor.v),
    cg AS (SELECT cor.field, v AS root, arg_min(r, 'part|' || cor.field || '|' || r) AS corridor FROM cor GROUP BY 1, 2),
    cs AS (SELECT src.mesh_id, src.field, corridor, vertex_id, cp_type, value, multiplicity, x, y, z FROM src JOIN cg USING (field, root)), {geometry_sql('cs', 'mesh_id, field, corridor', 'k')},
    cz AS (SELECT field, corridor, count(*) AS n_clusters, bool_and(morphology = 'string') AS strings FROM cg JOIN mc USING (field, root) GROUP BY 1, 2),
    st AS (SELECT k.*, n_clusters FROM kshape k JOIN cz USING (field, corridor) WHERE (n_clusters > 1 AND n_members >= 3 AND aspect_ratio >= 2) OR (n_clusters = 1 AND strings)),
    un AS (SELECT mesh_id, field, 'MS:part|' || field || '|' || corridor AS unit_id, 'string' AS kind, n_clusters, {_SHAPE}, greatest(max_major + {MARGIN}, {PITCH}) AS angular_radius_rad, greatest(max_major + {MARGIN}, {PITCH}) AS semi_major_rad, greatest(max_minor + {MARGIN}, {PITCH / 2}) AS semi_minor_rad FROM st
        UNION ALL SELECT mc.mesh_id, mc.field, cluster_id, 'cluster', 1, {', '.join('mc.' + c for c in _SHAPE.split(', '))}, angular_radius_rad, semi_major_rad, semi_minor_rad FROM mc JOIN cg USING (field, root) LEFT JOIN st USING (field, corridor) WHERE st.n_clusters IS NULL)"""


def _units(s, d) -> DataFrame:
    return cut_lineage(clustering.string_units(*_micro(s, d), PITCH))


@query(f"WITH RECURSIVE {_STRINGS} SELECT mesh_id, field, unit_id, kind, n_clusters, {_ROUND}, round(angular_radius_rad, 4) AS angular_radius_rad, round(semi_major_rad, 4) AS semi_major_rad, round(semi_minor_rad, 4) AS semi_minor_rad FROM un")
def reduction_units(s, d):
    return shown(_units(s, d))


_UNIT_SLOPES = _SLOPES.replace("cluster_id", "unit_id").replace("FROM mc", "FROM un").replace("mc.*", "un.*").replace("FROM mc LEFT", "FROM un LEFT")


@query(f"""WITH RECURSIVE {_STRINGS}, {_UNIT_SLOPES}, {_DECIDED} SELECT mesh_id, field, count(*) AS n_units, count(*) FILTER (decision IN ('E-MAX', 'E-MIN', 'E-SAD')) AS n_reduced, count(*) FILTER (decision = 'E-NONE') AS n_annihilated, count(*) FILTER (decision = 'IRREDUCIBLE') AS n_irreducible,
    sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN 0 ELSE n_members END)::BIGINT AS n_hidden, sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN n_maxima WHEN decision = 'E-MAX' THEN 1 ELSE 0 END)::BIGINT AS maxima,
    sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN n_minima WHEN decision = 'E-MIN' THEN 1 ELSE 0 END)::BIGINT AS minima, sum(CASE WHEN decision IN ('SINGLE', 'IRREDUCIBLE') THEN n_saddles WHEN decision = 'E-SAD' THEN 1 ELSE 0 END)::BIGINT AS saddles,
    sum(local_euler_index)::BIGINT AS euler FROM de GROUP BY 1, 2""")
def stage_reduction(s, d):
    """The part sphere's fields after their corridors and clusters are reduced."""
    units = _units(s, d)
    asked = units.where("local_euler_index = 1 and n_members >= 2")  # no other unit's polarity is asked
    return clustering.stage_summary(units, clustering.reduced_units(units, _polarity(s, d, asked, "unit_id")))


# --- the given clusters -------------------------------------------------------------------------------------------------

_MEMBERS = f"{_CL}, mem AS (SELECT DISTINCT ON (mesh_id, field, GROUP, m.vertex_id) mesh_id, field, GROUP, m.vertex_id AS vertex_id, m.cp_type AS cp_type, m.value AS value, m.multiplicity AS multiplicity, m.x AS x, m.y AS y, m.z AS z FROM (SELECT mesh_id, field, GROUP, unnest(members) AS m FROM SOURCE))"


def _given_members(clusters: DataFrame, group: str) -> DataFrame:
    return clusters.select("mesh_id", "field", group, F.explode("members").alias("m")).select("mesh_id", "field", group, "m.*")


@query(f"WITH {_MEMBERS.replace('GROUP', 'cluster_id').replace('SOURCE', 'cl')}, {geometry_sql('mem', 'mesh_id, field, cluster_id', 'g')} SELECT mesh_id, field, cluster_id, {_ROUND} FROM gshape")
def cluster_geometry(s, d):
    return shown(clustering.pooled_geometry(_given_members(_clusters(s, d), "cluster_id"), ["mesh_id", "field", "cluster_id"]))


# --- launch seeds of the part sphere's saddles ------------------------------------------------------------------------------

_RAW = f"""rq AS (SELECT c.mesh_id, c.field, 'SAD_' || c.vertex_id AS entity_id, x AS ux, y AS uy, z AS uz, (multiplicity + 1)::INT AS expected, {max(MARGIN, PITCH)} AS a0 FROM cps c JOIN vertices v ON v.vertex_id = c.vertex_id WHERE cp_type = 'saddle')"""


def _raw_requests(s, d) -> DataFrame:
    """All raw saddles, none of them hidden."""
    saddles = _points(s, d).where("cp_type = 'saddle'").select("mesh_id", "field", "vertex_id", "multiplicity", *[F.col(n).alias(f"u{n}") for n in "xyz"])
    nothing = saddles.select("mesh_id", "field", F.col("vertex_id").cast("string").alias("unit_id"), F.lit(0).alias("fold_order"), "ux", "uy", "uz", F.lit(0.0).alias("angular_radius_rad")).limit(0)
    return catastrophe.launch_requests(saddles, saddles.select("mesh_id", "field", "vertex_id").limit(0), nothing, PITCH)


def _seeds(s, d) -> tuple[DataFrame, DataFrame]:
    return catastrophe.ring_search(_raw_requests(s, d), C.part_vertices(s, d), C.part_fields(s, d), PITCH)


@query()
def excision_radius_search(s, d):
    return rounded(_seeds(s, d)[0])


@query()
def excision_summary(s, d):
    return rounded(catastrophe.outcome_summary(_seeds(s, d)[0]))


@query()
def excision_branches(s, d):
    """Ports of the ring that stands for each saddle: where its separatrices leave."""
    return rounded(_seeds(s, d)[1])


@query(f"""WITH RECURSIVE {_MICRO}, {_SLOPES}, {_DECIDED}, hid AS (SELECT src.field, src.vertex_id FROM src JOIN de USING (field, root) WHERE decision NOT IN ('SINGLE', 'IRREDUCIBLE')),
    raw AS (SELECT mesh_id, field, 'SAD_' || vertex_id AS entity_id, round(x, 4) + 0.0 AS ux, round(y, 4) + 0.0 AS uy, round(z, 4) + 0.0 AS uz, (multiplicity + 1)::INT AS expected, round({max(MARGIN, PITCH)}, 4) AS a0 FROM pts WHERE cp_type = 'saddle' AND NOT EXISTS (SELECT 1 FROM hid WHERE hid.field = pts.field AND hid.vertex_id = pts.vertex_id))
    SELECT * FROM raw UNION ALL SELECT mesh_id, field, 'E-SAD_' || cluster_id, round(ux, 4) + 0.0, round(uy, 4) + 0.0, round(uz, 4) + 0.0, (1 - local_euler_index)::INT, round(angular_radius_rad, 4) FROM de WHERE decision = 'E-SAD'""")
def launch_requests(s, d):
    """Saddles that are shown after the reduction of clusters, effective ones included."""
    points, groups, units = _micro(s, d)
    reduced = clustering.reduced_units(units, _polarity(s, d, units, "cluster_id"), "cluster_id")
    hidden = cut_lineage(clustering.hidden_vertices(groups, units, reduced))
    saddles = points.where("cp_type = 'saddle'").select("mesh_id", "field", "vertex_id", "multiplicity", *[F.col(n).alias(f"u{n}") for n in "xyz"])
    whole = reduced.where("decision = 'E-SAD'").join(units, ["mesh_id", "field", "cluster_id"]).withColumnRenamed("cluster_id", "unit_id")
    return rounded(catastrophe.launch_requests(saddles, hidden, whole, PITCH), 4)


# --- catastrophes of the given clusters -----------------------------------------------------------------------------------


def _catastrophes(s, d) -> DataFrame:
    """Coreless pairs first, then cores with their rings; as the given meshes are coarse, the rings reach as far as 24 pitches."""
    c = cut_lineage(_clusters(s, d))
    values = F.transform("members", lambda m: m["value"])
    own = c.select("mesh_id", "field", F.col("cluster_id").alias("id"), F.array_max(values).alias("value"), "ux", "uy", "uz", "local_euler_index", "n_maxima", "n_minima", "n_saddles")
    simple = own.where("n_saddles > 0 and n_maxima + n_minima = 0 and local_euler_index = -1")
    points = _given_members(c, "cluster_id").withColumnRenamed("cluster_id", "id")
    spans = points.groupBy("mesh_id", "field").agg((F.max("value") - F.min("value")).alias("field_span"))
    kinds = simple.withColumn("cp_type", F.lit("saddle")).unionByName(own.where("n_maxima + n_minima > 0").withColumn("cp_type", F.lit("extremum")))
    candidates = catastrophe.saddle_pair_candidates(kinds.withColumnRenamed("id", "vertex_id"), spans.withColumnRenamed("field_span", "span"), degrees(PITCH), 0.05)
    pairs = cut_lineage(catastrophe.saddle_pairs(candidates).select("mesh_id", "field", "a", "b"))
    stars = cut_lineage(catastrophe.constellations(own.where("local_euler_index > 0"), simple, pairs, PITCH, 2.0, 24.0))
    return catastrophe.classified(stars, points, own, spans, PITCH)


@query()
def catastrophes(s, d):
    return rounded(_catastrophes(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
