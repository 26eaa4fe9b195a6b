"""Queries over the domain's own tables (zones, clusters, snapshots) and derived grids and lattices, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarscape.functions import naming
from scalarscape.operators import catastrophe, graph, grid, metadata, morse, persistence, snapshots, spherical
from scalarscape.plans import carriers as C
from scalarscape.plans.topology import PITCH, _CL, _PAIRS, _AXIS, _cps, _clusters, rounded
from scalarscape.session import ensure_checkpoint_dir, table
from scalarscape.sources import tdv

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_Z = """z AS (SELECT * FROM (SELECT dataset, zone_id, name, zone_type, imax, jmax, kmax, aux, row_number() OVER (PARTITION BY dataset, zone_id ORDER BY name DESC) AS rn FROM zones) WHERE rn = 1)"""
_ATOM = "coalesce(TRY_CAST(trim(aux['AtomNumber']) AS INT), 1)"


def _zones(s, d) -> DataFrame:
    return metadata.distinct_zones(table(s, d, "zones"))


@query(f"""WITH {_Z} SELECT dataset, zone_type, coalesce(aux['ZoneType'], CASE WHEN zone_type = 'ORDERED' AND coalesce(jmax, 1) = 1 AND coalesce(kmax, 1) = 1 THEN 'line' WHEN zone_type = 'ORDERED' THEN 'volume' ELSE 'surface' END) AS zone_class,
    count(*) AS n_zones, sum(CASE WHEN zone_type = 'ORDERED' THEN imax::BIGINT * coalesce(jmax, 1) * coalesce(kmax, 1) ELSE imax END)::BIGINT AS n_points FROM z GROUP BY 1, 2, 3""")
def zone_rollup(s, d):
    return metadata.zone_rollup(_zones(s, d))


_SPHERES = f"spheres AS (SELECT dataset, {_ATOM} AS atom_number, arg_min(zone_id, zone_id) AS zone_id, arg_min(struct_pack(v := aux['AtomType']), zone_id).v AS symbol, arg_min(struct_pack(v := CASE WHEN TRY_CAST(trim(aux['SphereRadius']) AS DOUBLE) > 0 THEN TRY_CAST(trim(aux['SphereRadius']) AS DOUBLE) END), zone_id).v AS radius, arg_min(struct_pack(v := imax), zone_id).v AS n_vertices, arg_min(struct_pack(v := jmax), zone_id).v AS n_triangles FROM z WHERE aux['ZoneType'] = 'AtomSphereData' GROUP BY 1, 2)"


@query(f"WITH {_Z}, {_SPHERES} SELECT * FROM spheres")
def atom_spheres(s, d):
    return metadata.atom_spheres(_zones(s, d))


@query(f"WITH {_Z}, {_SPHERES}, c AS (SELECT dataset, symbol, count(*) AS n FROM spheres WHERE symbol IS NOT NULL GROUP BY 1, 2) SELECT dataset, string_agg(symbol || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY CASE symbol WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, symbol) AS formula FROM c GROUP BY 1")
def formulas(s, d):
    return metadata.formulas(_zones(s, d))


_TOTALS = f"""{_Z}, lists AS (SELECT dataset, zone_id, string_split(aux['IntegratedFunctionNames'], ',') AS names, string_split(aux['IntegratedFunctionTotals'], ',') AS totals FROM z),
    totals AS (SELECT dataset, zone_id, (i - 1)::INT AS pos, trim(names[i]) AS name, TRY_CAST(trim(totals[i]) AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, least(len(names), len(totals)) + 1)) AS i FROM lists WHERE names IS NOT NULL AND totals IS NOT NULL))"""


@query(f"WITH {_TOTALS} SELECT dataset, zone_id, pos, name, value FROM totals")
def integrated_totals(s, d):
    return metadata.integrated_totals(_zones(s, d)).drop("shown")


@query(f"""WITH {_TOTALS}, dg AS (SELECT *, abs(value) AS size, CASE WHEN abs(value) > 0 THEN (5 - floor(log10(abs(value))))::INT END AS places FROM totals)
    SELECT dataset, zone_id, pos, CASE WHEN size > 1e-4 AND size < 1e4 THEN rtrim(rtrim(printf('%.12f', round(value * pow(10.0, places)) / pow(10.0, places)), '0'), '.') ELSE printf('%.4e', value) END AS shown FROM dg""")
def integrated_totals_shown(s, d):
    return metadata.integrated_totals(_zones(s, d)).select("dataset", "zone_id", "pos", "shown")


@query(f"WITH {_TOTALS} SELECT dataset, name, count(*) AS n_zones, min(zone_id) AS first_zone FROM totals GROUP BY 1, 2")
def field_inventory(s, d):
    return metadata.field_inventory(_zones(s, d))


@query(f"""WITH {_Z}, b AS (SELECT dataset, {_ATOM} AS atom, aux['BasinIndex'] AS basin, aux['RegionType'] AS region, zone_id, aux['ZoneType'] AS kind FROM z)
    SELECT p.dataset, p.zone_id AS sphere_zone, min(q.zone_id) AS surface_zone FROM b p LEFT JOIN b q ON q.kind = 'CondensedBasinSurface' AND q.dataset = p.dataset AND q.atom = p.atom AND q.basin = p.basin AND q.region = p.region
    WHERE p.kind = 'CondensedBasinSphere' AND p.basin IS NOT NULL AND p.region IS NOT NULL GROUP BY 1, 2""")
def basin_links(s, d):
    return metadata.basin_links(_zones(s, d))


@query(f"WITH {_Z} SELECT dataset, zone_id, coalesce(aux['ZoneType'], zone_type) AS zone_class, row_number() OVER (PARTITION BY dataset, coalesce(aux['ZoneType'], zone_type) ORDER BY zone_id)::INT AS number FROM z")
def zone_numbers(s, d):
    return metadata.numbered(_zones(s, d))


def _text(value: str) -> str:
    """A text as an SQL literal, control characters by their code."""
    return "(" + " || ".join(f"chr({ord(c)})" if c < " " or "\x7f" <= c <= "\x9f" else f"'{c}'" for c in value) + ")"


def _sql_repaired(c: str) -> str:
    for wrong, right in naming.MISREAD:
        c = f"replace({c}, {_text(wrong)}, '{right}')"
    return c


def _sql_normalised(c: str) -> str:
    text = f"lower(trim({_sql_repaired(f"coalesce({c}, '')")}))"
    for q in naming.QUALIFIERS:
        text = f"replace({text}, '{q}', '')"
    return f"trim(regexp_replace(trim({text}), '^({'|'.join(naming.DENSITY_PREFIXES)})', ''))"


def _sql_title(c: str) -> str:
    words = "|".join(q.strip("()") for q in naming.QUALIFIERS)
    clean = f"trim(regexp_replace({_sql_repaired(f"trim(coalesce({c}, ''))")}, '\\s*\\(\\s*({words})\\s*\\)', '', 'gi'))"
    clean = f"CASE WHEN lower({clean}) IN ('ρ', 'rho') THEN 'Electron Density' ELSE trim(regexp_replace({clean}, '^(ρ|rho) ', '', 'i')) END"
    cased = f"array_to_string(list_transform(list_filter(regexp_split_to_array({clean}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^[^\\x00-\\x7f]') OR regexp_matches(w[2:], '\\p{{Lu}}') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
    return cased


_SUFFIX = "CASE " + " ".join(f"WHEN contains(lower(t), '{k}') THEN '{v}'" for k, v in naming.SUFFIXES) + " ELSE '' END"
_SECONDARY = "(" + " OR ".join(f"contains(lower({{0}}), '{k}')" for k in naming.SECONDARY) + ")"


@query(f"WITH f AS (SELECT DISTINCT mesh_id, field FROM clusters) SELECT mesh_id, field, row_number() OVER (PARTITION BY mesh_id ORDER BY {_SECONDARY.format('field')}, field)::INT AS position FROM f")
def field_display_order(s, d):
    """Fields of each mesh, by name within the primary and the secondary ones, as `clusters` has no order of its own."""
    return naming.display_order(table(s, d, "clusters").select("mesh_id", "field").distinct(), "mesh_id", "field", "field")


def _slider_sql(i: int) -> str:
    whole = "trim(l) = 'v' OR l IN ('î±', 'α') OR contains(l, 'alpha') OR contains(l, 'trajectory')"
    named = " ".join(f"WHEN contains(l, '{k}') THEN {v[i]}" for k, *v in naming.SLIDERS)
    own = ["lo", "hi", "lo + (hi - lo) * 0.10", "(hi - lo) / 100.0"][i]
    return f"(CASE WHEN {whole} THEN {naming.WHOLE_NAME_SLIDER[i]} {named} WHEN most > least THEN round({own}, 4) ELSE {naming.WHOLE_NAME_SLIDER[i]} END)::DOUBLE"


@query(f"""WITH r AS (SELECT field, lower(field) AS l, min(m.value) AS least, max(m.value) AS most FROM (SELECT field, unnest(members) AS m FROM clusters) GROUP BY 1, 2),
    f AS (SELECT *, greatest(least, -100.0) AS lo, least(most, 100.0) AS hi, {_sql_title('field')} AS t FROM r)
    SELECT field, {_sql_normalised('field')} AS plain, t || {_SUFFIX} AS title, trim(regexp_replace(lower(regexp_replace(field, '[^\x00-\x7f]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')[1:48] AS slug,
    {_slider_sql(0)} AS low, {_slider_sql(1)} AS high, {_slider_sql(2)} AS first, {_slider_sql(3)} AS step FROM f""")
def field_names(s, d):
    m = table(s, d, "clusters").select("field", F.explode("members").alias("m"))
    f = m.groupBy("field").agg(F.min("m.value").alias("least"), F.max("m.value").alias("most"))
    f = f.withColumn("s", naming.slider(F.col("field"), F.col("least"), F.col("most")))
    name = F.col("field")
    return f.select("field", naming.normalised(name).alias("plain"), naming.display_title(name).alias("title"), naming.slug(name).alias("slug"), "s.low", "s.high", "s.first", "s.step")


@query("""WITH f AS (SELECT DISTINCT field, lower(field) AS l, regexp_replace(replace(lower(field), '(condensed)', ''), '[^a-z0-9]', '', 'g') AS base FROM clusters)
    SELECT field, (CASE WHEN contains(l, 'charge') THEN 0 WHEN contains(l, 'basin') THEN 1 ELSE 2 END)::INT AS pattern_no FROM f WHERE contains(l, 'charge') OR contains(l, 'basin') OR base = 'w'""")
def field_selection(s, d):
    return naming.select_fields(table(s, d, "clusters"), ["charge", "basin", "w"])


def _snapshots(s, d) -> DataFrame:
    return snapshots.distinct_snapshots(table(s, d, "snapshots"))


_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY received_at) AS rn FROM snapshots) WHERE rn = 1)"
_LEAVES = f"{_S}, sec AS (SELECT snapshot_id, dataset, received_at, unnest(json_keys(derived_metrics::JSON)) AS section, derived_metrics::JSON AS j FROM s WHERE derived_metrics IS NOT NULL), leaves AS (SELECT snapshot_id, section || '.' || k AS path, section, json_extract_string(j, '$.' || section || '.' || k) AS value FROM (SELECT *, unnest(json_keys(j, '$.' || section)) AS k FROM sec))"


_ITEMS = "it AS (SELECT snapshot_id, (i - 1)::INT AS item_pos, context.field_items[i].title AS title, context.field_items[i].value AS value, params.strings['selected_field'] AS sel FROM (SELECT *, unnest(range(1, len(context.field_items) + 1)) AS i FROM s WHERE context.field_items IS NOT NULL))"


def _items(s, d) -> DataFrame:
    rows = _snapshots(s, d).select("snapshot_id", F.col("params.strings")["selected_field"].alias("sel"), F.posexplode("context.field_items").alias("item_pos", "i"))
    return rows.select("snapshot_id", "item_pos", "sel", "i.title", "i.value")


@query(f"WITH {_S}, {_ITEMS} SELECT snapshot_id, item_pos, value, row_number() OVER (PARTITION BY snapshot_id ORDER BY coalesce({_SECONDARY.format('value')}, false), item_pos)::INT AS position FROM it")
def snapshot_field_order(s, d):
    """Primary fields of each snapshot first, each kind in the order in which they were listed."""
    return naming.display_order(_items(s, d).select("snapshot_id", "item_pos", "value"), "snapshot_id", "value", "item_pos")


@query(f"WITH {_S}, {_ITEMS}, f AS (SELECT *, {_sql_title('value')} AS t FROM it) SELECT snapshot_id, item_pos, t || {_SUFFIX} AS title FROM f")
def snapshot_field_titles(s, d):
    return _items(s, d).select("snapshot_id", "item_pos", naming.display_title(F.col("value")).alias("title"))


def _sql_matches(a: str, b: str) -> str:
    names = lambda v: ", ".join(f"'{x}'" for x in v)
    mean = lambda c: f"(contains({c}, 'mean curvature') AND NOT contains({c}, 'positive') AND NOT contains({c}, 'negative') AND NOT contains({c}, 'sign change'))"
    rules = [f"ns IN ({names([*naming.DENSITY_NAMES, ''])})", f"ns IN ({names(naming.VOLUME_NAMES)})", "contains(ns, 'kinetic')"]
    tests = [f"nt IN ({names(naming.DENSITY_NAMES)})", f"nt IN ({names(naming.VOLUME_NAMES)})", "contains(nt, 'kinetic')"]
    tests.append("contains(nt, 'sign change')")
    rules.append("contains(ns, 'sign change') AND contains(nt, 'arc fraction') = contains(ns, 'arc fraction')")
    for sign, short in (("positive", "h+"), ("negative", "h-")):
        tests.append(f"contains(nt, '{sign} mean curvature')")
        rules.append(f"contains(ns, '{sign} mean curvature') OR ns = '{short}'")
    tests.append(mean("nt"))
    rules.append(mean("ns"))
    for word in naming.SHARED_WORDS:
        tests.append(f"contains(nt, '{word}')")
        rules.append(f"contains(ns, '{word}')")
    alias = "CASE " + " ".join(f"WHEN {t} THEN {r}" for t, r in zip(tests, rules, strict=True)) + " ELSE false END"
    return f"coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' AND coalesce(trim({a}) = trim({b}) OR (ns = nt AND ns <> '') OR {alias}, false)"


@query(f"WITH {_S}, {_ITEMS}, n AS (SELECT *, {_sql_normalised('value')} AS ns, {_sql_normalised('sel')} AS nt FROM it) SELECT snapshot_id, item_pos, {_sql_matches('value', 'sel')} AS same FROM n")
def snapshot_field_matches(s, d):
    """Whether each listed field means the one that the snapshot selects."""
    return _items(s, d).select("snapshot_id", "item_pos", naming.matches(F.col("value"), F.col("sel")).alias("same"))


_WANTED = {"bools": list(snapshots.DEFAULT_BOOLS), "floats": list(snapshots.DEFAULT_FLOATS), "strings": snapshots.STRINGS}


def _sql_controls(test: str) -> str:
    lists = [f"list_filter([{', '.join(repr(k) for k in keys)}], lambda k: coalesce({test.replace('SECTION', f'params.{n}')}, {'true' if 'NOT' in test else 'false'}))" for n, keys in _WANTED.items()]
    return f"list_sort(list_concat({lists[0]}, list_concat({lists[1]}, {lists[2]})))"


@query(f"""WITH {_S}, r AS (SELECT *, {_sql_controls('NOT list_contains(map_keys(SECTION), k)')} AS m, {_sql_controls('list_contains(map_keys(SECTION), k) AND SECTION[k] IS NULL')} AS bad FROM s)
    SELECT snapshot_id, CASE WHEN coalesce(schema_version <> 2, true) THEN 'wrong version' WHEN params IS NULL THEN 'no params' WHEN params.bools IS NULL OR params.floats IS NULL OR params.strings IS NULL THEN 'no section' WHEN len(m) > 0 THEN 'missing controls' WHEN len(bad) > 0 THEN 'bad values'
    WHEN camera IS NOT NULL AND NOT coalesce(len(camera.position) = 3 AND len(camera.focal_point) = 3 AND len(camera.view_up) = 3 AND camera.parallel_scale > 0 AND camera.view_angle > 0 AND camera.view_angle < 180 AND camera.parallel_projection IN (0, 1), false) THEN 'bad camera' ELSE 'ok' END AS status,
    array_to_string(m, ',') AS missing, array_to_string(bad, ',') AS bad, (coalesce(cardinality(params.bools), 0) + coalesce(cardinality(params.floats), 0) + coalesce(cardinality(params.strings), 0))::INT AS n_values FROM r""")
def snapshot_load_report(s, d):
    return snapshots.load_report(_snapshots(s, d))


_DEFAULTS = ", ".join(
    [f"{{'control': '{k}', 'kind': 'bool', 'value': coalesce(params.bools['{k}'], {str(v).lower()})::VARCHAR}}" for k, v in snapshots.DEFAULT_BOOLS.items()]
    + [f"{{'control': '{k}', 'kind': 'float', 'value': coalesce(params.floats['{k}'], {v})::VARCHAR}}" for k, v in snapshots.DEFAULT_FLOATS.items()]
    + [f"{{'control': '{k}', 'kind': 'string', 'value': params.strings['{k}']}}" for k in snapshots.STRINGS]
)


@query(f"WITH {_S}, c AS (SELECT snapshot_id, unnest([{_DEFAULTS}]) AS c FROM s) SELECT snapshot_id, c.control AS control, c.kind AS kind, c.value AS value FROM c")
def snapshot_controls(s, d):
    """Every control of each snapshot, defaults for those it lacks."""
    return snapshots.restored_controls(_snapshots(s, d))


@query(f"WITH {_S}, r AS (SELECT snapshot_id, params.floats AS f FROM s) SELECT snapshot_id, k AS control, CASE WHEN k = 'k_bridge' THEN 3.25 ELSE f[k] END AS value FROM (SELECT *, unnest(map_keys(f)) AS k FROM r)")
def snapshot_overrides(s, d):
    return snapshots.with_overrides(_snapshots(s, d), ["k_bridge=3.25"])


_CAMERA = "len(camera.position) = 3 AND len(camera.focal_point) = 3 AND len(camera.view_up) = 3 AND camera.parallel_scale > 0 AND camera.view_angle > 0 AND camera.view_angle < 180 AND camera.parallel_projection IN (0, 1)"


@query(f"WITH {_S} SELECT snapshot_id, " + ", ".join(f"round(camera.{v}[{i + 1}] - coalesce(camera.atom_center[{i + 1}], 0), 6) AS {p}{n}" for v, p in (("position", "p"), ("focal_point", "f")) for i, n in enumerate("xyz")) + f" FROM s WHERE {_CAMERA}")
def snapshot_cameras(s, d):
    return rounded(snapshots.rebased_camera(_snapshots(s, d)))


@query(f"""WITH {_S}, r AS (SELECT snapshot_id, params.strings['selected_field'] AS w, list_transform(context.field_items, lambda i: i.value) AS l FROM s)
    SELECT snapshot_id, CASE WHEN coalesce(list_contains(l, w), false) THEN w ELSE list_filter(l, lambda v: v IS NOT NULL)[1] END AS field, NOT coalesce(list_contains(l, w), false) AS fallback FROM r""")
def snapshot_restore(s, d):
    return snapshots.restore_plan(_snapshots(s, d))


@query(f"WITH {_LEAVES} SELECT snapshot_id, path, value FROM leaves")
def metric_leaves(s, d):
    return snapshots.metric_leaves(_snapshots(s, d))


_CLOSE = "CASE WHEN TRY_CAST({0} AS DOUBLE) IS NOT NULL AND TRY_CAST({1} AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST({0} AS DOUBLE) - TRY_CAST({1} AS DOUBLE)) <= 1e-12 + 1e-6 * abs(TRY_CAST({1} AS DOUBLE)) ELSE {0} IS NOT DISTINCT FROM {1} END"


@query(f"""WITH {_LEAVES}, prev AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY dataset ORDER BY received_at, snapshot_id) AS p FROM s),
    saved AS (SELECT prev.snapshot_id, section, path, value FROM prev JOIN leaves ON leaves.snapshot_id = p), have AS (SELECT DISTINCT snapshot_id, section FROM leaves)
    SELECT a.snapshot_id, a.path, a.value AS saved, b.value AS computed, CASE WHEN a.value LIKE '[%' AND b.value LIKE '[%' THEN len(a.value::JSON::VARCHAR[]) = len(b.value::JSON::VARCHAR[]) AND
        coalesce(list_bool_and(list_transform(list_zip(a.value::JSON::VARCHAR[], b.value::JSON::VARCHAR[]), lambda e: {_CLOSE.format('e[1]', 'e[2]')})), true) ELSE {_CLOSE.format('a.value', 'b.value')} END AS matches
    FROM saved a JOIN have USING (snapshot_id, section) LEFT JOIN leaves b ON b.snapshot_id = a.snapshot_id AND b.path = a.path""")
def metric_diff(s, d):
    return snapshots.drift_against_previous(_snapshots(s, d))


def _written_files(s, d) -> str:
    """A folder of binary files in shared storage: the part sphere, a file for every 4,096 keys, written by tasks."""
    folder = f"{ensure_checkpoint_dir(s)}/tdv-{uuid.uuid4().hex}"
    place = s._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(s._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    points = C.part_vertices(s, d).join(C.part_fields(s, d).where("field = 'price'").select("vertex_id", F.col("value").alias("price")), "vertex_id")
    points = points.withColumn("bucket", F.floor(F.col("vertex_id") / 4096))

    def write(rows):
        rows = rows.sort_values("vertex_id")
        arrays = {n.upper() if n in "xyz" else n: rows[n].to_numpy() for n in ("x", "y", "z", "vertex_id", "price")}
        zone = {"name": "part", "zone_type": "ORDERED", "size": (len(rows), 1, 1), "arrays": arrays}
        again = {"name": "halved", "zone_type": "ORDERED", "size": (len(rows), 1, 1), "arrays": {**dict.fromkeys(("X", "Y", "Z", "vertex_id"), 0), "price": arrays["price"] / 2}}
        tdv.write_file(f"{folder}/part{rows['bucket'].iloc[0]}.plt", "parts", list(arrays), [zone, again])
        return rows[["bucket"]].head(1)

    points.groupBy("bucket").applyInPandas(write, "bucket bigint").write.format("noop").mode("overwrite").save()
    return folder


@query("""SELECT 'part' || (p_partkey // 4096) AS dataset, zone_id, p_partkey::DOUBLE AS vertex_id, p_retailprice / (zone_id + 1) AS price FROM part, (SELECT unnest([0, 1])::INT AS zone_id)""")
def tdv_round_trip(s, d):
    """Keys and prices written to binary files, each with a zone and another that shares its keys, and read back by the data source."""
    tdv.register(s)
    fields = s.read.format("tdv").option("table", "fields").load(_written_files(s, d))
    side = lambda name, out: fields.where(F.col("field") == name).select("dataset", "zone_id", F.col("vertex_id").alias("at"), F.col("value").alias(out))
    return side("vertex_id", "vertex_id").join(side("price", "price"), ["dataset", "zone_id", "at"]).drop("at")


@query()
def persistence_pairs(s, d):
    return persistence.persistence_pairs(C.part_triangles(s, d), C.part_fields(s, d))


@query()
def persistence_filter(s, d):
    pairs = persistence.persistence_pairs(C.part_triangles(s, d), C.part_fields(s, d))
    return persistence.persistence_filter(_cps(s, d), pairs, 10.0)


_LINKED = f"WITH RECURSIVE {_PAIRS}, l AS (SELECT p.cluster_id AS a, q.cluster_id AS b FROM pairs WHERE gap <= {3.0 * PITCH} AND coalesce({_AXIS} <= 30, true)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(k, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.k)"


def _corridors(s, d) -> DataFrame:
    links = spherical.bridge_links(_clusters(s, d), PITCH).where("is_linked")
    return graph.connected_groups(links.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b")))


@query(f"{_LINKED} SELECT k AS node, min(r) AS root FROM reach GROUP BY 1")
def corridors(s, d):
    return _corridors(s, d)


@query()
def macro_strings(s, d):
    """Clusters pooled by corridor; those in no link stand alone."""
    clusters = _clusters(s, d).join(_corridors(s, d).withColumnRenamed("node", "cluster_id"), "cluster_id", "left")
    return rounded(spherical.group_geometry(clusters.withColumn("string_id", F.coalesce("root", "cluster_id")), ["mesh_id", "field", "string_id"]))


@query()
def corridor_colours(s, d):
    told = table(s, d, "clusters").select("cluster_id", "mesh_id", "field", "ux", "uy", "uz", "px", "py", "pz", "semi_major_rad", "semi_minor_rad", "morphology", "recorded_at")
    links = spherical.bridge_links(spherical.distinct_clusters(told), PITCH)
    return graph.colours(links.select("mesh_id", "field", F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b")), apart=["mesh_id", "field"])


def _member_points(s, d) -> DataFrame:
    told = table(s, d, "clusters").select("cluster_id", "mesh_id", "field", "ux", "members", "recorded_at")
    m = spherical.distinct_clusters(told).select("mesh_id", "field", F.explode("members").alias("m")).select("mesh_id", "field", "m.*")
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return m.select("mesh_id", "field", "vertex_id", "cp_type", "value", *[(F.col(c) / n).alias(f"u{c}") for c in "xyz"]).dropDuplicates(["mesh_id", "field", "vertex_id"])


def _pair_candidates(s, d) -> DataFrame:
    points = _member_points(s, d)
    spans = points.groupBy("mesh_id", "field").agg((F.max("value") - F.min("value")).alias("span"))
    return catastrophe.saddle_pair_candidates(points, spans, degrees_of(PITCH), 0.05)


def degrees_of(rad: float) -> float:
    return rad * 180 / pi


_SEP = "degrees(acos(greatest(-1.0, least(1.0, {0}.ux*{1}.ux+{0}.uy*{1}.uy+{0}.uz*{1}.uz))))"


@query(f"""WITH {_CL}, pt AS (SELECT DISTINCT ON (mesh_id, field, m.vertex_id) mesh_id, field, m.vertex_id AS vertex_id, m.cp_type AS cp_type, m.value AS value, m.x / sqrt(m.x**2+m.y**2+m.z**2) AS ux, m.y / sqrt(m.x**2+m.y**2+m.z**2) AS uy, m.z / sqrt(m.x**2+m.y**2+m.z**2) AS uz FROM (SELECT mesh_id, field, unnest(members) AS m FROM cl)),
    span AS (SELECT mesh_id, field, max(value) - min(value) AS span FROM pt GROUP BY 1, 2),
    c AS (SELECT a.mesh_id, a.field, a, b, {_SEP.format('a', 'b')} AS sep, abs(a.value - b.value) / greatest(span, 1e-12) AS barrier FROM pt a JOIN pt b ON a.mesh_id = b.mesh_id AND a.field = b.field AND a.vertex_id < b.vertex_id JOIN span ON span.mesh_id = a.mesh_id AND span.field = a.field WHERE a.cp_type = 'saddle' AND b.cp_type = 'saddle'),
    k AS (SELECT *, (a.ux + b.ux) AS mx, (a.uy + b.uy) AS my, (a.uz + b.uz) AS mz FROM c WHERE sep BETWEEN 1e-9 AND 16 AND barrier <= 0.05),
    bad AS (SELECT DISTINCT k.mesh_id, k.field, a.vertex_id AS a, b.vertex_id AS b FROM k JOIN pt e ON e.mesh_id = k.mesh_id AND e.field = k.field AND e.cp_type <> 'saddle'
        WHERE degrees(acos(greatest(-1.0, least(1.0, (mx*e.ux+my*e.uy+mz*e.uz) / sqrt(mx*mx+my*my+mz*mz))))) < sep / 2 + 1.5 OR least({_SEP.format('a', 'e')}, {_SEP.format('b', 'e')}) < 1.8 * sep)
    SELECT k.mesh_id, k.field, k.a.vertex_id AS a, k.b.vertex_id AS b, round(sep, 4) AS separation_deg, round(barrier, 6) AS barrier FROM k LEFT JOIN bad ON bad.mesh_id = k.mesh_id AND bad.field = k.field AND bad.a = k.a.vertex_id AND bad.b = k.b.vertex_id WHERE bad.a IS NULL""")
def saddle_pair_candidates(s, d):
    c = _pair_candidates(s, d)
    return c.withColumn("separation_deg", F.round("separation_deg", 4)).withColumn("barrier", F.round("barrier", 6))


@query()
def saddle_pairs(s, d):
    return rounded(catastrophe.saddle_pairs(_pair_candidates(s, d)), 4)


@query()
def launch_branches(s, d):
    f = C.part_fields(s, d)
    return catastrophe.launch_branches(C.part_triangles(s, d), C.part_vertices(s, d), f, _cps(s, d).where("cp_type = 'saddle'"))


def _grid(s, d) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("value"))
    i, j, k = (F.col("v") % 10).cast("int"), (F.floor(F.col("v") / 10) % 10).cast("int"), F.floor(F.col("v") / 100).cast("int")
    return p.select(F.lit("part").alias("dataset"), i.alias("i"), j.alias("j"), k.alias("k"), (i * 0.5 - 1).alias("x"), (j * 0.25).alias("y"), (k * k * 0.1).alias("z"), "value")


_GRID = "g AS (SELECT (p_partkey % 10)::INT AS i, ((p_partkey // 10) % 10)::INT AS j, (p_partkey // 100)::INT AS k, (p_partkey % 10) * 0.5 - 1 AS x, ((p_partkey // 10) % 10) * 0.25 AS y, ((p_partkey // 100) * (p_partkey // 100)) * 0.1 AS z, p_retailprice AS value FROM part)"


@query(f"""WITH {_GRID}, l AS (SELECT 'x' AS axis, i AS ix, x::DOUBLE AS pos FROM g UNION ALL SELECT 'y', j, y FROM g UNION ALL SELECT 'z', k, z FROM g), p AS (SELECT axis, ix, min(pos) AS lo, max(pos) AS hi FROM l GROUP BY 1, 2),
    st AS (SELECT *, lead(lo) OVER (PARTITION BY axis ORDER BY ix) - lo AS step FROM p) SELECT 'part' AS dataset, axis, count(*) AS n, arg_min(lo, ix) AS origin, round(avg(step), 6) AS spacing, max(hi - lo) <= 1e-4 AS orthogonal, min(step) > 0 AND stddev_pop(step) < 1e-4 * avg(step) AS uniform FROM st GROUP BY axis""")
def grid_classes(s, d):
    return rounded(grid.grid_classes(_grid(s, d)))


@query(f"""WITH {_GRID}, a AS (SELECT i, j, x, y, max(z) FILTER (z <= 0.25) AS za, min(z) FILTER (z >= 0.25) AS zb FROM g GROUP BY ALL) SELECT 'part' AS dataset, a.i, a.j, a.x::DOUBLE AS x, a.y::DOUBLE AS y, round(p.value + CASE WHEN zb > za THEN (0.25 - za) / (zb - za) ELSE 0 END * (q.value - p.value), 6) AS value
    FROM a JOIN g p ON p.i = a.i AND p.j = a.j AND p.z = za JOIN g q ON q.i = a.i AND q.j = a.j AND q.z = zb""")
def grid_cutplane(s, d):
    return rounded(grid.cut_plane(_grid(s, d), 0.25))


def _lattices(s, d) -> DataFrame:
    c = _snapshots(s, d).where(snapshots.camera_valid(F.col("camera")))
    cols = [F.col(f"camera.{v}")[i].alias(f"{m}{n}") for v, m in (("position", "a"), ("focal_point", "b"), ("view_up", "c")) for i, n in enumerate("xyz")]
    return c.select(F.col("snapshot_id").alias("lattice_id"), *cols)


_LATTICE = f"""{_S}, lat AS (SELECT snapshot_id AS lattice_id, camera.position AS a, camera.focal_point AS b, camera.view_up AS c, camera.atom_center AS p FROM s WHERE len(camera.position) = 3 AND len(camera.focal_point) = 3 AND len(camera.view_up) = 3 AND camera.parallel_scale > 0 AND camera.view_angle > 0 AND camera.view_angle < 180 AND camera.parallel_projection IN (0, 1)),
    sh AS (SELECT n1.n1 AS n1, n2.n2 AS n2, n3.n3 AS n3 FROM range(-1, 2) n1(n1), range(-1, 2) n2(n2), range(-1, 2) n3(n3) WHERE NOT (n1.n1 = 0 AND n2.n2 = 0 AND n3.n3 = 0)),
    tr AS (SELECT lattice_id, p, n1::INT AS n1, n2::INT AS n2, n3::INT AS n3, n1*a[1]+n2*b[1]+n3*c[1] AS tx, n1*a[2]+n2*b[2]+n3*c[2] AS ty, n1*a[3]+n2*b[3]+n3*c[3] AS tz FROM lat, sh),
    d AS (SELECT *, tx*tx+ty*ty+tz*tz AS d2, min(tx*tx+ty*ty+tz*tz) OVER (PARTITION BY lattice_id) AS least FROM tr),
    planes AS (SELECT lattice_id, p, n1, n2, n3, tx / sqrt(d2) AS nx, ty / sqrt(d2) AS ny, tz / sqrt(d2) AS nz, sqrt(d2) / 2 AS off FROM d WHERE least > 1e-12 AND d2 <= 2.25 * least)"""


@query(f"WITH {_LATTICE} SELECT lattice_id, n1, n2, n3, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(off, 6) AS \"offset\" FROM planes")
def wigner_seitz_planes(s, d):
    return rounded(grid.wigner_seitz_planes(_lattices(s, d)))


@query(f"WITH {_LATTICE} SELECT lattice_id, 0 AS point_id, max(nx*p[1]+ny*p[2]+nz*p[3] - off) <= 1e-4 AS inside FROM planes WHERE len(p) = 3 GROUP BY 1")
def inside_cell(s, d):
    points = _snapshots(s, d).where("size(camera.atom_center) = 3").select(
        F.col("snapshot_id").alias("lattice_id"), F.lit(0).alias("point_id"), *[F.col("camera.atom_center")[i].alias(n) for i, n in enumerate("xyz")]
    )
    return grid.inside_cell(points, grid.wigner_seitz_planes(_lattices(s, d)))


@query(f"""WITH {_CL}, r AS (SELECT *, CASE WHEN len(members) < 2 THEN 'SINGLE' WHEN local_euler_index = 0 THEN 'E-NONE' WHEN local_euler_index = 1 THEN CASE WHEN n_maxima > n_minima THEN 'E-MAX' ELSE 'E-MIN' END WHEN local_euler_index < 0 THEN 'E-SAD' ELSE 'IRREDUCIBLE' END AS de FROM cl)
    SELECT mesh_id, field, sum(CASE WHEN de IN ('SINGLE', 'IRREDUCIBLE') THEN n_maxima WHEN de = 'E-MAX' THEN 1 ELSE 0 END)::BIGINT AS maxima, sum(CASE WHEN de IN ('SINGLE', 'IRREDUCIBLE') THEN n_minima WHEN de = 'E-MIN' THEN 1 ELSE 0 END)::BIGINT AS minima,
    sum(CASE WHEN de IN ('SINGLE', 'IRREDUCIBLE') THEN n_saddles WHEN de = 'E-SAD' THEN 1 ELSE 0 END)::BIGINT AS saddles, sum(local_euler_index)::BIGINT AS euler FROM r GROUP BY 1, 2""")
def display_counts(s, d):
    return spherical.display_counts(_clusters(s, d))


@query(f"""WITH {_CL}, f AS (SELECT p.cluster_id AS point_id, q.cluster_id, acos(greatest(-1.0, least(1.0, p.ux*q.ux+p.uy*q.uy+p.uz*q.uz))) AS theta FROM cl p JOIN cl q ON p.mesh_id = q.mesh_id AND p.field = q.field WHERE p.n_saddles > 0 AND p.n_maxima + p.n_minima = 0 AND q.n_maxima > 0)
    SELECT point_id, arg_min(cluster_id, theta) AS cluster_id, round(min(theta), 5) AS theta FROM f WHERE theta <= 0.4 GROUP BY 1""")
def nearest_maximum(s, d):
    """For each lone saddle the nearest cluster that holds a maximum."""
    c = _clusters(s, d)
    points = c.where("n_saddles > 0 and n_maxima + n_minima = 0").select("mesh_id", "field", F.col("cluster_id").alias("point_id"), "ux", "uy", "uz")
    return rounded(spherical.nearest_cluster(points, c.where("n_maxima > 0"), 0.4), 5)


def _flanks(s, d) -> DataFrame:
    c = _clusters(s, d).withColumn("value", F.aggregate("members", F.lit(0.0), lambda a, m: a + m["value"]) / F.size("members"))
    side = lambda where: c.where(where).select("mesh_id", "field", F.col("cluster_id").alias("id"), "value", "ux", "uy", "uz")
    return catastrophe.flanking_saddles(side("n_maxima + n_minima > 0"), side("n_saddles > 0 and n_maxima + n_minima = 0 and local_euler_index = -1"), 2 * PITCH, 12 * PITCH)


@query(f"""WITH {_CL}, k AS (SELECT p.mesh_id, p.field, p.cluster_id AS core_id, q.cluster_id AS saddle_id, acos(greatest(-1.0, least(1.0, p.ux*q.ux+p.uy*q.uy+p.uz*q.uz))) AS theta FROM cl p JOIN cl q ON p.mesh_id = q.mesh_id AND p.field = q.field
    WHERE p.n_maxima + p.n_minima > 0 AND q.n_saddles > 0 AND q.n_maxima + q.n_minima = 0 AND q.local_euler_index = -1) SELECT mesh_id, field, core_id, saddle_id, round(theta, 5) AS theta FROM k WHERE theta BETWEEN {2 * PITCH} AND {12 * PITCH}""")
def flanking_saddles(s, d):
    return rounded(_flanks(s, d).select("mesh_id", "field", "core_id", "saddle_id", "theta"), 5)


@query()
def star_metrics(s, d):
    spans = _member_points(s, d).groupBy("mesh_id", "field").agg((F.max("value") - F.min("value")).alias("span"))
    return rounded(catastrophe.star_metrics(_flanks(s, d), spans, 3))


@query()
def nudged_saddles(s, d):
    field = C.part_fields(s, d)
    saddles = morse.critical_points(C.part_triangles(s, d), field).where("cp_type = 'saddle'")
    centres = saddles.join(C.part_vertices(s, d), ["mesh_id", "vertex_id"]).select("mesh_id", "field", F.col("vertex_id").alias("entity_id"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("z").alias("uz"))
    return rounded(catastrophe.nudged(centres, C.part_vertices(s, d), field, 0.2, 2, 0.1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
