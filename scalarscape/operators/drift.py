"""One consistent table from JSON files whose schema drifts, and a record of every change.

Every file gets a schema fingerprint (a hash of its whole shape, values left out).
A registry holds each fingerprint once, with a version and the chain of migration
steps that its files go through: rename from a known place to the canonical name,
default where the quantity is absent, cast from its JSON type. The chain is worked
out on one document of a fingerprint; every file is routed to it by its fingerprint,
its values are read by the chain's steps, and what the chain says of a quantity's
presence, place and type is held against the chain of the file before it in its
series. Keys that no step takes are reported with the registry and beside removals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarscape.operators.windows import carry_forward, running_total
from scalarscape.session import cut_lineage

BLOCK = 512  # files of a series that one window task handles at once
DEPTH = 5  # levels of objects whose keys the registry lists
BROADCAST_ROWS = 50_000  # fingerprints up to which a narrow registry is broadcast; beyond it files meet it by salted shuffle
SALTS = 16


@dataclass(frozen=True)
class Quantity:
    """A quantity of the canonical table.

    ``places``: its known JSON paths, canonical first, each a rename step onto it.
    ``parts``: members of an object form, joined by ``joiner``. ``unit``: a suffix
    that text forms may carry. ``sql_type``: the canonical type.
    """

    name: str
    places: tuple[str, ...]
    sql_type: str
    parts: tuple[str, ...] = ()
    joiner: str = "/"
    unit: str = ""
    default: str | None = None


#: Names and places under which the exporting stations write the three quantities.
SNAPSHOT_QUANTITIES = (
    Quantity(
        "plt_path",
        (
            "$.context.plt_path",
            "$.context.pltPath",
            "$.context.PLT_PATH",
            "$.context.plt_file",
            "$.context.source_plt",
            "$.context.input.plt",
            "$.dataset.path",
            "$.origin",
        ),
        "string",
        parts=("dir", "name"),
    ),
    Quantity(
        "euler",
        (
            "$.derived_metrics.display_counts.euler",
            "$.derived_metrics.display_counts.eulerIndex",
            "$.derived_metrics.display_counts.euler_characteristic",
            "$.derived_metrics.display_counts.chi",
            "$.derived_metrics.displayCounts.euler",
            "$.derived_metrics.display_euler",
        ),
        "bigint",
        parts=("value",),
    ),
    Quantity(
        "view_angle",
        (
            "$.camera.view_angle",
            "$.camera.viewAngle",
            "$.camera.fov_deg",
            "$.camera.field_of_view",
            "$.camera.lens.view_angle",
            "$.view.camera.angle",
            "$.view_angle_deg",
        ),
        "double",
        parts=("deg",),
        unit="deg",
    ),
)


def _json_type(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", None)
        .when(v.isNotNull(), "number")
    )


def _scalar(v: Column, q: Quantity) -> Column:
    """Cast step of a scalar form."""
    text = F.try_variant_get(v, "$", "string")
    if q.sql_type == "string":
        return text
    if q.unit:
        text = F.regexp_replace(text, rf"(?i)\s*{q.unit}\s*$", "")
    number = F.trim(text).try_cast("double")
    return number if q.sql_type == "double" else F.when(number == F.floor(number), number.cast("bigint"))


def _cast(v: Column, kind: Column, q: Quantity) -> Column:
    """Cast steps by JSON type: a wrapped value is unwrapped, a split one is joined, text is read as the canonical type."""
    if len(q.parts) > 1:
        pieces = [F.try_variant_get(v, f"$.{p}", "string") for p in q.parts]
        joiner = F.when(pieces[0].contains("\\"), "\\").otherwise(q.joiner)
        whole = F.when(F.coalesce(*pieces).isNotNull(), F.concat_ws("", *_between(pieces, joiner)))
    else:
        whole = _scalar(F.try_variant_get(v, f"$.{q.parts[0]}", "variant"), q)
    wrapped = _scalar(F.try_variant_get(v, "$[0]", "variant"), q)
    return F.when(kind == "object", whole).when(kind == "array", wrapped).otherwise(_scalar(v, q))


def _between(pieces: list[Column], joiner: Column) -> list[Column]:
    out = [pieces[0]]
    for p in pieces[1:]:
        out += [F.when(pieces[0].isNotNull() & p.isNotNull(), joiner), p]
    return out


def _parsed(files: DataFrame) -> DataFrame:
    """(file_id, series, file_seq, fingerprint, _doc) of the valid bodies. Kinds of number are one type in a fingerprint."""
    docs = files.select("file_id", "series", "file_seq", F.try_parse_json("body").alias("_doc")).where(F.col("_doc").isNotNull())
    shape = F.regexp_replace(F.schema_of_variant("_doc"), r"BIGINT|DOUBLE|DECIMAL\([0-9,]+\)", "NUMBER")
    return docs.select("file_id", "series", "file_seq", F.sha2(shape, 256).alias("fingerprint"), "_doc")


def fingerprints(files: DataFrame) -> DataFrame:
    """(file_id, series, file_seq, fingerprint), each valid file once."""
    return cut_lineage(_parsed(files).drop("_doc").dropDuplicates(["file_id"]))


def _keys(v: Column, before: Column, depth: int) -> Column:
    """Paths of all keys of a variant's objects, down to ``depth`` levels."""
    members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

    def of_member(e: Column) -> Column:
        path = F.concat(before, e["key"])
        own = F.array(path)
        return F.concat(own, _keys(e["value"], F.concat(path, F.lit(".")), depth - 1)) if depth > 1 else own

    return F.coalesce(F.flatten(F.transform(members, of_member)), F.array().cast("array<string>"))


def _chain(q: Quantity) -> Column:
    """What a document's fingerprint says of a quantity: its first known place (index and path) and JSON type, null where it has none."""
    at = [F.try_variant_get("_doc", place, "variant") for place in q.places]
    index = F.coalesce(*[F.when(v.isNotNull(), F.lit(i)) for i, v in enumerate(at)])
    return F.struct(index.alias("place"), F.get(F.array(*[F.lit(p) for p in q.places]), index).alias("path"), _json_type(F.coalesce(*at)).alias("type"))


def _steps(q: Quantity) -> Column:
    """The ordered migration steps of a quantity, as text."""
    c = F.col(q.name)
    return F.array_compact(
        F.array(
            F.when(c["place"] > 0, F.concat(F.lit("rename "), c["path"], F.lit(f" -> {q.name}"))),
            F.when(c["place"].isNull() | c["type"].isNull(), F.lit(f"default {q.name} {q.default or 'null'}")),
            F.when(c["type"].isNotNull(), F.concat(F.lit(f"cast {q.name} "), c["type"], F.lit(f" -> {q.sql_type}"))),
        )
    )


def registry(files: DataFrame, printed: DataFrame, quantities: tuple[Quantity, ...] = SNAPSHOT_QUANTITIES, with_keys: bool = True) -> DataFrame:
    """One row for each fingerprint of ``printed`` (as from ``fingerprints``): version, n_files, series, first_seq, the chain (place, path, type) of each quantity under its name, steps, keys and unmapped.

    Versions count from 1 in the order of (first_seq, fingerprint) and are unique.
    ``keys`` are the paths of all keys, ``unmapped`` those that neither are a known place
    nor lead to one; both are null without ``with_keys``. ``series`` is the least one that has the fingerprint at first_seq.
    """
    seen = printed.groupBy("fingerprint").agg(
        F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n_files"), F.min(F.struct("file_seq", "series")).alias("_first")
    )
    bucket = F.concat(F.lpad(F.coalesce("_first.file_seq", F.lit(0)).cast("string"), 12, "0"), F.substring("fingerprint", 1, 2))
    numbered = running_total(seen.withColumn("_bucket", bucket).withColumn("_one", F.lit(1)), [], "_bucket", ["fingerprint"], "_one", "_before")
    one = _parsed(files.join(numbered.select("file_id"), "file_id", "left_semi"))
    docs = one.join(numbered.select("fingerprint", "n_files", "_first", "_before"), "fingerprint")
    chained = docs.select(
        "fingerprint", (F.col("_before") + 1).alias("version"), "n_files", F.col("_first.series").alias("series"), F.col("_first.file_seq").alias("first_seq"),
        (_keys(F.col("_doc"), F.lit("$."), DEPTH) if with_keys else F.lit(None).cast("array<string>")).alias("keys"), *[_chain(q).alias(q.name) for q in quantities],
    ).dropDuplicates(["fingerprint"])
    known = {p[: len(p) - len(tail)].rstrip(".") for q in quantities for p in q.places for tail in ["", *[".".join(p.split(".")[i:]) for i in range(2, p.count(".") + 1)]]}
    return cut_lineage(
        chained.select("*", F.flatten(F.array(*[_steps(q) for q in quantities])).alias("steps"), F.array_except("keys", F.array(*[F.lit(k) for k in sorted(known)])).alias("unmapped"))
    )


def _routed(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows with the registry's columns of their fingerprint: by broadcast up to BROADCAST_ROWS fingerprints, else by a salted join, as one of them may be that of a third of all files."""
    if chains.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(chains), "fingerprint")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)))
    spread = chains.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(spread, ["fingerprint", "_salt"]).drop("_salt")


def read_drifting(files: DataFrame, quantities: tuple[Quantity, ...] = SNAPSHOT_QUANTITIES) -> DataFrame:
    """One row per file: file_id, series, file_seq, fingerprint, version, and for each quantity q ``q``, its value by the steps of the file's chain.

    ``files`` needs file_id, series, file_seq and body. A file sent again counts
    once; a body that is null or not valid JSON gives no row; a key with value null
    is present and has no type. Where a document holds several places of one
    quantity the canonical-most counts. Values that cannot be cast and absent ones are
    the default, null; further columns of ``files`` are ignored.
    """
    chains = registry(files, fingerprints(files), quantities, with_keys=False).select("fingerprint", "version", *[F.col(q.name).alias(f"_{q.name}") for q in quantities])
    routed = _routed(_parsed(files), chains)
    values = []
    for q in quantities:
        chain = F.col(f"_{q.name}")
        found = F.try_variant_get("_doc", F.coalesce(chain["path"], F.lit("$")), "variant")  # rename
        value = F.when(chain["type"].isNotNull(), _cast(found, chain["type"], q).cast(q.sql_type))  # cast
        values.append(F.coalesce(value, F.lit(q.default).cast(q.sql_type)).alias(q.name))  # default
    return routed.select("file_id", "series", "file_seq", "fingerprint", "version", *values).dropDuplicates(["file_id"])


def drift_events(files: DataFrame, quantities: tuple[Quantity, ...] = SNAPSHOT_QUANTITIES, with_keys: bool = True) -> DataFrame:
    """Rows (file_id, field, drift, old, new, old_version, new_version, new_keys) for each change of a quantity against the file before it in its series.

    ``drift``: added or removed (the quantity appears or vanishes), renamed (it
    stands at another place), retyped (its JSON type is not the last one it had; an
    added quantity is not retyped too). ``old`` and ``new`` are the places or types,
    the versions those of the two files' fingerprints. ``new_keys``, of a removal: the
    keys no step takes that the file before lacked, where an unknown name may stand;
    left out without ``with_keys``. A series' first valid file has no rows, gaps in
    file_seq are passed over, and ties in file_seq are ordered by file_id. Series with a
    null name form one series. An empty table gives no rows.
    """
    printed = fingerprints(files)
    book = registry(files, printed, quantities, with_keys)
    chains = book.select("fingerprint", "version", *[F.col(q.name).alias(f"_{q.name}") for q in quantities])
    rows = _routed(printed, chains).select(
        "file_id",
        F.coalesce("series", F.lit("")).alias("series"),
        F.struct("file_seq", "file_id").alias("_at"),
        "file_seq",
        "version",
        *[F.coalesce(F.col(f"_{q.name}")["place"], F.lit(-1)).alias(f"{q.name}_place") for q in quantities],
        *[F.col(f"_{q.name}")["type"].alias(f"{q.name}_type") for q in quantities],
    )
    states = {"_version": F.col("version")}
    for q in quantities:
        states[f"_p_{q.name}"] = F.col(f"{q.name}_place")
        states[f"_t_{q.name}"] = F.col(f"{q.name}_type")
    held = carry_forward(rows, ["series"], "_at", F.floor(F.coalesce("file_seq", F.lit(-1)) / BLOCK), states)
    events = []
    for q in quantities:
        place, kind = F.col(f"{q.name}_place"), F.col(f"{q.name}_type")
        was, had = F.col(f"_p_{q.name}"), F.col(f"_t_{q.name}")
        names = F.array(*[F.lit(p) for p in q.places])
        name_of = lambda c: F.when(c >= 0, F.get(names, c))

        def event(when: Column, drift: str, old: Column, new: Column, f: str = q.name) -> Column:
            return F.when(
                when, F.struct(F.lit(f).alias("field"), F.lit(drift).alias("drift"), old.alias("old"), new.alias("new"))
            )

        nothing = F.lit(None).cast("string")
        events += [
            event((was < 0) & (place >= 0), "added", nothing, name_of(place)),
            event((was >= 0) & (place < 0), "removed", name_of(was), nothing),
            event((was >= 0) & (place >= 0) & (was != place), "renamed", name_of(was), name_of(place)),
            event((was >= 0) & (place >= 0) & (kind != had), "retyped", had, kind),
        ]
    found = held.where("_version is not null").select("file_id", F.col("_version").alias("old_version"), F.col("version").alias("new_version"), F.explode(F.array_compact(F.array(*events))).alias("e"))
    found = found.select("file_id", "e.field", "e.drift", "e.old", "e.new", "old_version", "new_version")
    if not with_keys:
        return found
    gone = found.where("drift = 'removed'")
    pairs = gone.select("old_version", "new_version").distinct()
    keys = book.select("version", "unmapped")
    fresh = pairs.join(keys.select(F.col("version").alias("old_version"), F.col("unmapped").alias("_old")), "old_version")
    fresh = fresh.join(keys.select(F.col("version").alias("new_version"), F.col("unmapped").alias("_new")), "new_version")
    fresh = fresh.select("old_version", "new_version", F.array_sort(F.array_except("_new", "_old")).alias("new_keys"))
    return found.join(fresh.withColumn("drift", F.lit("removed")), ["old_version", "new_version", "drift"], "left").select(
        "file_id", "field", "drift", "old", "new", "old_version", "new_version", "new_keys"
    )


def schema_versions(files: DataFrame, quantities: tuple[Quantity, ...] = SNAPSHOT_QUANTITIES) -> DataFrame:
    """The registry as a report: fingerprint, version, steps, n_files, series, first_seq and unmapped, one row per fingerprint.

    Steps are named ``rename <place> -> <quantity>``, ``default <quantity> <value>`` and
    ``cast <quantity> <type> -> <sql type>``, in order. An empty table gives no rows.
    """
    return registry(files, fingerprints(files), quantities).select("fingerprint", "version", "steps", "n_files", "series", "first_seq", F.array_sort("unmapped").alias("unmapped"))
