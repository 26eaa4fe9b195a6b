"""Parameter snapshots: strict checks, overrides, camera rules, and differences of metrics by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarscape.functions import vector as V
from scalarscape.operators.windows import carry_forward

SCHEMA_VERSION = 2

#: The controls of a snapshot by type, numbers and switches with their defaults.
DEFAULT_FLOATS = {"num_contours": 15.0, "cp_glyph_scale": 1.0, "k_pitch": 2.0, "k_bridge": 3.0, "cat_barrier_tol": 0.005, "cat_angular_tol_mult": 4.0, "nudge_max_pitch": 1.5}
DEFAULT_BOOLS = {
    "show_flood": True, "show_contours": True, "show_sphere_wire": False, "show_cps": True, "show_maxima": True, "show_minima": True, "show_saddles": True,
    "show_rings": True, "aggregate_strings": False, "show_catastrophes": True, "show_ports": True, "reduce_catastrophes": False,
    "reduce_multi_clusters": False, "nudge_cp_positions": False, "perfect_port_angles": False, "show_launch_seeds": False,
}
STRINGS = ["selected_field"]


def distinct_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row for each snapshot_id: the one received first."""
    return snapshots.where("snapshot_id is not null").withColumn(
        "_n", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("received_at"))
    ).where("_n = 1").drop("_n")


def vec3_valid(v: Column) -> Column:
    """Three finite components."""
    return F.coalesce((F.size(v) == 3) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def camera_valid(c: Column) -> Column:
    """Three finite vectors, scale above 0, angle between 0 and 180, projection 0 or 1."""
    return F.coalesce(
        vec3_valid(c["position"]) & vec3_valid(c["focal_point"]) & vec3_valid(c["view_up"])
        & (c["parallel_scale"] > 0) & (c["view_angle"] > 0) & (c["view_angle"] < 180) & c["parallel_projection"].isin(0, 1),
        F.lit(False),
    )


def load_report(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, status, missing, bad, n_values): ``ok`` or what keeps a snapshot from loading, the first of the following.

    ``wrong version``; ``no params``; ``no section`` (bools, floats or strings is null);
    ``missing controls``, their names in order; ``bad values``, the controls that are
    null where a switch, number or text belongs; ``bad camera``. Unknown controls are
    tolerated, and a snapshot without a camera may still load.
    """
    wanted = {"bools": list(DEFAULT_BOOLS), "floats": list(DEFAULT_FLOATS), "strings": STRINGS}
    sections = {name: F.col(f"params.{name}") for name in wanted}
    nothing = F.array().cast("array<string>")
    missing = F.array_sort(F.concat(*[F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.map_keys(sections[n]), nothing)) for n, keys in wanted.items()]))
    empty = lambda n, keys: F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.coalesce(F.map_contains_key(sections[n], k) & F.element_at(sections[n], k).isNull(), F.lit(False)))
    bad = F.array_sort(F.concat(*[empty(n, keys) for n, keys in wanted.items()]))
    status = (
        F.when(F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), "wrong version")
        .when(F.col("params").isNull(), "no params")
        .when(sections["bools"].isNull() | sections["floats"].isNull() | sections["strings"].isNull(), "no section")
        .when(F.size(missing) > 0, "missing controls")
        .when(F.size(bad) > 0, "bad values")
        .when(F.col("camera").isNotNull() & ~camera_valid(F.col("camera")), "bad camera")
        .otherwise("ok")
    )
    n = sum((F.coalesce(F.size(F.map_keys(c)), F.lit(0)) for c in sections.values()), F.lit(0))
    return snapshots.select("snapshot_id", status.alias("status"), F.array_join(missing, ",").alias("missing"), F.array_join(bad, ",").alias("bad"), n.alias("n_values"))


def restored_controls(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, control, kind, value): every control of a snapshot as text, the default where the snapshot lacks it; kinds are bool, float and string."""
    rows = [(k, "bool", F.coalesce(F.col("params.bools")[k], F.lit(v)).cast("string")) for k, v in DEFAULT_BOOLS.items()]
    rows += [(k, "float", F.coalesce(F.col("params.floats")[k], F.lit(v)).cast("string")) for k, v in DEFAULT_FLOATS.items()]
    rows += [(k, "string", F.col("params.strings")[k]) for k in STRINGS]
    return snapshots.select("snapshot_id", F.inline(F.array(*[F.struct(F.lit(k).alias("control"), F.lit(kind).alias("kind"), v.alias("value")) for k, kind, v in rows])))


def with_overrides(snapshots: DataFrame, overrides: list[str]) -> DataFrame:
    """(snapshot_id, control, value): float controls after ``key=value`` overrides; an unknown key or a value that is no number raises."""
    given = {}
    for text in overrides:
        key, eq, value = text.partition("=")
        if not eq or key not in DEFAULT_FLOATS:
            raise ValueError(f"unknown override: {text}")
        given[key] = float(value)
    rows = snapshots.select("snapshot_id", F.explode("params.floats").alias("control", "value"))
    value = F.col("value")
    for key, new in given.items():
        value = F.when(F.col("control") == key, F.lit(new)).otherwise(value)
    return rows.select("snapshot_id", "control", value.alias("value"))


def rebased_camera(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, px, py, pz, fx, fy, fz): valid cameras moved so that the atom's centre is the origin."""
    c = F.col("camera")
    moved = lambda v, i: c[v][i] - F.coalesce(c["atom_center"][i], F.lit(0.0))
    return snapshots.where(camera_valid(c)).select(
        "snapshot_id", *[moved("position", i).alias(f"p{n}") for i, n in enumerate("xyz")], *[moved("focal_point", i).alias(f"f{n}") for i, n in enumerate("xyz")]
    )


def restore_plan(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, field, fallback): the selected field if the snapshot lists it, else the first one listed."""
    wish = F.col("params.strings")["selected_field"]
    listed = F.transform("context.field_items", lambda i: i["value"])
    have = F.coalesce(F.array_contains(listed, wish), F.lit(False))
    first = F.get(F.filter(listed, lambda v: v.isNotNull()), F.lit(0))
    return snapshots.select("snapshot_id", F.when(have, wish).otherwise(first).alias("field"), (~have).alias("fallback"))


def metric_leaves(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, path, value): the leaves of derived_metrics by dotted path, as JSON text."""
    sections = snapshots.select("snapshot_id", F.explode(F.from_json("derived_metrics", "map<string,map<string,string>>")).alias("section", "entries"))
    return sections.select("snapshot_id", "section", F.explode("entries").alias("k", "value")).select(
        "snapshot_id", F.concat_ws(".", "section", "k").alias("path"), "value"
    )


def scalar_matches(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-12) -> Column:
    """Numbers within tolerance, other values by equality; null meets null."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= atol + rtol * F.abs(y)).otherwise(a.eqNullSafe(b))


def leaf_matches(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-12) -> Column:
    """Lists of one length element by element, other leaves whole, each by scalar_matches."""
    listed = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>"))
    x, y = listed(a), listed(b)
    each = F.forall(F.zip_with(x, y, lambda p, q: scalar_matches(p, q, rtol, atol)), lambda same: same)
    return F.when(x.isNotNull() & y.isNotNull(), (F.size(x) == F.size(y)) & each).otherwise(scalar_matches(a, b, rtol, atol))


def metric_diff(saved: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """(key, path, saved, computed, matches): every saved leaf beside the computed one of the same key and path.

    Sections that the computed side lacks altogether are passed over; a leaf missing in a
    section that it has compares to null.
    """
    section = F.substring_index("path", ".", 1)
    have = computed.select(key, section.alias("section")).distinct()
    left = saved.withColumn("section", section).join(have.hint("merge"), [key, "section"], "left_semi").select(key, "path", F.col("value").alias("saved"))
    both = left.join(computed.select(key, "path", F.col("value").alias("computed")).hint("merge"), [key, "path"], "left")
    return both.withColumn("matches", leaf_matches(F.col("saved"), F.col("computed")))


def drift_against_previous(snapshots: DataFrame) -> DataFrame:
    """metric_diff of each snapshot against the one received before it in its dataset; (snapshot_id, path, saved, computed, matches)."""
    at = snapshots.select("snapshot_id", "dataset", F.struct("received_at", "snapshot_id").alias("_at"), F.date_trunc("day", F.col("received_at").cast("timestamp")).alias("_day"))
    pairs = carry_forward(at, ["dataset"], "_at", F.col("_day"), {"previous": F.col("snapshot_id")}).select("snapshot_id", "previous").where("previous is not null")
    leaves = metric_leaves(snapshots)
    earlier = pairs.join(leaves.withColumnRenamed("snapshot_id", "previous").hint("merge"), "previous").select("snapshot_id", "path", "value")
    return metric_diff(earlier, leaves, "snapshot_id")


def field_span(camera: Column) -> Column:
    """Distance from a camera to its focal point."""
    d = V.minus(tuple(camera["position"][i] for i in range(3)), tuple(camera["focal_point"][i] for i in range(3)))
    return V.norm(d)
