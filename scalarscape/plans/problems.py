"""Queries of the general data-processing operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scalarscape.operators import drift, flatten, reconcile
from scalarscape.session import table

COUNT_RULES = [
    reconcile.FieldRule("maxima", reconcile.canonical_number),
    reconcile.FieldRule("minima", reconcile.canonical_number),
    reconcile.FieldRule("valid", reconcile.canonical_boolean),
]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(
        table(spark, sf_dir, "counts_main"),
        table(spark, sf_dir, "counts_mirror"),
        ["snapshot_id", "field_no"],
        COUNT_RULES,
        "recorded_at",
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_events(table(spark, sf_dir, "snapshot_files"), with_keys=False).select("file_id", "field", "drift")


def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_events(table(spark, sf_dir, "snapshot_files"), with_keys=False).select("file_id", "field", "drift", "old", "new")


def p4_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with the versions of the schemas and, for removals, the keys where an unknown name may stand."""
    return drift.drift_events(table(spark, sf_dir, "snapshot_files"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.read_drifting(table(spark, sf_dir, "snapshot_files")).select(
        "file_id", "series", "file_seq", "plt_path", "euler", "view_angle"
    )


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_versions(table(spark, sf_dir, "snapshot_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.leaves(table(spark, sf_dir, "session_exports")).select("export_id", "snap_pos", "leaf", "item_pos")


def p5_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flat_snapshots(table(spark, sf_dir, "session_exports"))


def p5_field_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flat_field_items(table(spark, sf_dir, "session_exports"))


def p5_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flat_metrics(table(spark, sf_dir, "session_exports"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p2_found, p4_found, p4_changes, p4_trace, p4_table, p4_versions, p5_found, p5_snapshots, p5_field_items, p5_metrics)
    }


_MISSING = ", ".join(f"'{m}'" for m in reconcile.MISSING)
_TRUE = ", ".join(f"'{m}'" for m in reconcile.TRUE)
_FALSE = ", ".join(f"'{m}'" for m in reconcile.FALSE)


def _plain(c: str) -> str:
    return rf"lower(trim({c}::VARCHAR, E' \t\n\r'))"


def _number(c: str) -> str:
    return f"CASE WHEN {_plain(c)} IN ({_MISSING}) THEN NULL ELSE coalesce(CAST(TRY_CAST({_plain(c)} AS DOUBLE) AS VARCHAR), {_plain(c)}) END"


def _boolean(c: str) -> str:
    p = _plain(c)
    return f"CASE WHEN {p} IN ({_MISSING}) THEN NULL WHEN {p} IN ({_TRUE}) THEN 'true' WHEN {p} IN ({_FALSE}) THEN 'false' ELSE {p} END"


def _side(name: str) -> str:
    values = f"{_number('maxima')} AS maxima, {_number('minima')} AS minima, {_boolean('valid')} AS valid"
    return (
        f"(SELECT * FROM (SELECT snapshot_id, field_no, {values}, row_number() OVER (PARTITION BY snapshot_id, field_no "
        f"ORDER BY recorded_at DESC) AS rn FROM {name}) WHERE rn = 1)"
    )


def _p2_sql() -> str:
    parts = [
        "SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(a.field_no, b.field_no) AS field_no, 'row' AS item, "
        "CASE WHEN b.rn IS NULL THEN 'only_main' ELSE 'only_mirror' END AS finding FROM a FULL JOIN b "
        "ON a.snapshot_id = b.snapshot_id AND a.field_no = b.field_no WHERE a.rn IS NULL OR b.rn IS NULL"
    ]
    parts += [
        f"SELECT a.snapshot_id, a.field_no, '{f}', 'differs' FROM a JOIN b ON a.snapshot_id = b.snapshot_id AND a.field_no = b.field_no "
        f"WHERE a.{f} IS DISTINCT FROM b.{f}"
        for f in ("maxima", "minima", "valid")
    ]
    return f"WITH a AS {_side('counts_main')}, b AS {_side('counts_mirror')} " + " UNION ALL ".join(parts)


def _p4_read() -> str:
    """The place (index, -1 for none), value and JSON type of each quantity in each valid file."""
    ctes = []
    for q in drift.SNAPSHOT_QUANTITIES:
        at = [f"WHEN json_exists(j, '{p}') THEN {i}" for i, p in enumerate(q.places)]
        got = [f"WHEN json_exists(j, '{p}') THEN json_extract(j, '{p}')" for p in q.places]
        ctes.append(f"coalesce(CASE {' '.join(at)} END, -1) AS p_{q.name}, CASE {' '.join(got)} END AS v_{q.name}")
    kinds = ", ".join(
        f"CASE json_type(v_{q.name}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' "
        f"WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' END AS t_{q.name}"
        for q in drift.SNAPSHOT_QUANTITIES
    )
    return (
        "files AS (SELECT DISTINCT file_id, series, file_seq, CASE WHEN json_valid(body) THEN body::JSON END AS j "
        f"FROM snapshot_files WHERE json_valid(body)), places AS (SELECT file_id, series, file_seq, {', '.join(ctes)} FROM files), "
        f"read AS (SELECT *, {kinds} FROM places)"
    )


def _p4_sql(details: bool = False) -> str:
    events = []
    for q in drift.SNAPSHOT_QUANTITIES:
        was, now, had, has = f"w_{q.name}", f"p_{q.name}", f"h_{q.name}", f"t_{q.name}"
        names = "[" + ", ".join(f"'{p}'" for p in q.places) + "]"
        old, new = f"{names}[{was} + 1]", f"{names}[{now} + 1]"
        for when, what, before, after in (
            (f"{was} < 0 AND {now} >= 0", "added", "NULL", new),
            (f"{was} >= 0 AND {now} < 0", "removed", old, "NULL"),
            (f"{was} >= 0 AND {now} >= 0 AND {was} <> {now}", "renamed", old, new),
            (f"{was} >= 0 AND {now} >= 0 AND {has} <> {had}", "retyped", had, has),
        ):
            more = f", {before} AS old, {after} AS new" if details else ""
            events.append(f"SELECT file_id, '{q.name}' AS field, '{what}' AS drift{more} FROM held WHERE {when}")
    lagged = ", ".join(
        f"lag(p_{q.name}) OVER w AS w_{q.name}, last_value(t_{q.name} IGNORE NULLS) OVER "
        f"(PARTITION BY series ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h_{q.name}"
        for q in drift.SNAPSHOT_QUANTITIES
    )
    return f"WITH {_p4_read()}, held AS (SELECT *, {lagged} FROM read WINDOW w AS (PARTITION BY series ORDER BY file_seq)) " + " UNION ALL ".join(events)


def _p4_table_sql() -> str:
    def scalar(q: drift.Quantity, v: str) -> str:
        text = f"json_extract_string({v}, '$')"
        if q.sql_type == "string":
            return text
        if q.unit:
            text = f"regexp_replace({text}, '\\s*{q.unit}\\s*$', '', 'i')"
        number = f"TRY_CAST(trim({text}) AS DOUBLE)"
        return number if q.sql_type == "double" else f"CASE WHEN {number} = floor({number}) THEN {number}::BIGINT END"

    values = []
    for q in drift.SNAPSHOT_QUANTITIES:
        v = f"v_{q.name}"
        if len(q.parts) > 1:
            d, n = (f"json_extract_string({v}, '$.{p}')" for p in q.parts)
            whole = f"CASE WHEN {d} IS NULL OR {n} IS NULL THEN coalesce({d}, {n}) ELSE {d} || CASE WHEN contains({d}, '\\') THEN '\\' ELSE '{q.joiner}' END || {n} END"
        else:
            whole = scalar(q, f"json_extract({v}, '$.{q.parts[0]}')")
        first = scalar(q, f"json_extract({v}, '$[0]')")
        values.append(f"CASE t_{q.name} WHEN 'object' THEN {whole} WHEN 'array' THEN {first} ELSE {scalar(q, v)} END AS {q.name}")
    return f"WITH {_p4_read()} SELECT file_id, series, file_seq, {', '.join(values)} FROM read"


_P5_PARTS = """
WITH docs AS (SELECT DISTINCT export_id, payload::JSON AS j FROM session_exports WHERE json_valid(payload)),
lists AS (SELECT export_id, CASE json_type(j, '$.snapshots') WHEN 'ARRAY' THEN json_extract(j, '$.snapshots[*]')
          WHEN 'OBJECT' THEN [json_extract(j, '$.snapshots')] ELSE [] END AS l FROM docs),
snaps AS (SELECT export_id, i - 1 AS snap_pos, l[i] AS s FROM (SELECT export_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),
metrics AS (SELECT export_id, snap_pos, CASE json_type(s, '$.derived_metrics') WHEN 'VARCHAR'
            THEN json_extract_string(s, '$.derived_metrics')::JSON ELSE json_extract(s, '$.derived_metrics') END AS m FROM snaps),
items AS (SELECT export_id, snap_pos, CASE json_type(s, '$.context.field_items') WHEN 'ARRAY' THEN json_extract(s, '$.context.field_items[*]')
          WHEN 'OBJECT' THEN [json_extract(s, '$.context.field_items')] ELSE [] END AS l FROM snaps),
item AS (SELECT export_id, snap_pos, i - 1 AS item_pos, l[i] AS v FROM (SELECT export_id, snap_pos, l, unnest(range(1, len(l) + 1)) AS i FROM items))"""

_P5_SQL = _P5_PARTS + """
SELECT export_id, snap_pos::INT AS snap_pos, 'field_item' AS leaf, item_pos::INT AS item_pos FROM item WHERE json_type(v, '$.value') <> 'NULL'
UNION ALL SELECT export_id, snap_pos::INT, 'display_counts', -1 FROM metrics WHERE json_type(m, '$.display_counts.saddles') <> 'NULL'
UNION ALL SELECT export_id, snap_pos::INT, 'geom_info', -1 FROM metrics WHERE json_type(m, '$.geom_info.avg_edge_length') <> 'NULL'
"""


_P5_FLAT = {
    "p5_metrics": "SELECT export_id, snap_pos::INT AS snap_pos, json_extract_string(m, '$.display_counts.saddles') AS saddles, json_extract_string(m, '$.geom_info.avg_edge_length') AS avg_edge_length FROM metrics "
    "WHERE coalesce(json_extract_string(m, '$.display_counts.saddles'), json_extract_string(m, '$.geom_info.avg_edge_length')) IS NOT NULL",
    "p5_snapshots": "SELECT export_id, snap_pos::INT AS snap_pos, json_extract_string(s, '$.context.plt_path') AS plt_path FROM snaps WHERE json_type(s) = 'OBJECT'",
    "p5_field_items": "SELECT export_id, snap_pos::INT AS snap_pos, item_pos::INT AS item_pos, json_extract_string(v, '$.title') AS title, json_extract_string(v, '$.value') AS value FROM item "
    "WHERE json_extract_string(v, '$.title') IS NOT NULL OR json_extract_string(v, '$.value') IS NOT NULL",
}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _p2_sql(), "p4_found": _p4_sql(), "p4_changes": _p4_sql(details=True), "p4_table": _p4_table_sql(), "p5_found": _P5_SQL} | {k: f"{_P5_PARTS} {v}" for k, v in _P5_FLAT.items()}
