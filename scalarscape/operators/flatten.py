"""Nested JSON exports as related flat tables with parent-child links.

Nested ``transform`` calls attach the ancestors' keys and positions inside one
expression, ``flatten`` brings the arrays to one level, and one ``inline`` per
target table emits its rows. Containers of unexpected form are settled first: a
single object where a list belongs is a list of one, a text that holds an object
or a list is that object or list, anything else is no container.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ITEM = -1  # item_pos of leaves that stand outside a list


def _let(v: Column, body) -> Column:
    """``body(v)`` with ``v`` computed once."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


def _text(v: Column) -> Column:
    """Text of a value that is present and not JSON null; numbers and containers keep their JSON spelling."""
    return F.try_variant_get(v, "$", "string")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    """The members of an object or of a text that holds one, else null."""
    members = "map<string,variant>"
    return F.coalesce(
        F.try_variant_get(v, "$", members), F.try_variant_get(F.try_parse_json(_text(v)), "$", members)
    )


def _list(v: Column) -> Column:
    """An array of variants; null elements keep their place."""

    def plain(x: Column) -> Column:
        return F.coalesce(_array(x), F.when(F.try_variant_get(x, "$", "map<string,variant>").isNotNull(), F.array(x)))

    return F.coalesce(
        plain(v), _let(F.try_parse_json(_text(v)), plain), F.array().cast("array<variant>")
    )


def nested(exports: DataFrame) -> DataFrame:
    """export_id and ``snapshots``: an array of structs with position, plt_path, items, saddles and avg_edge_length.

    ``exports`` needs export_id and payload. A null or unreadable payload gives an empty array.
    """
    doc = exports.select("export_id", _object(F.try_parse_json("payload"))["snapshots"].alias("_snapshots"))

    def item(v: Column, i: Column) -> Column:
        return _let(
            _object(v),
            lambda o: F.struct(
                i.cast("int").alias("item_pos"), _text(o["title"]).alias("title"), _text(o["value"]).alias("value")
            ),
        )

    def snapshot(v: Column, i: Column) -> Column:
        def of_members(o: Column) -> Column:
            def of_sections(s: Column) -> Column:
                return F.struct(
                    i.cast("int").alias("snap_pos"),
                    o.isNotNull().alias("present"),
                    _text(s["context"]["plt_path"]).alias("plt_path"),
                    F.transform(_list(s["context"]["field_items"]), item).alias("items"),
                    _text(_object(s["metrics"]["display_counts"])["saddles"]).alias("saddles"),
                    _text(_object(s["metrics"]["geom_info"])["avg_edge_length"]).alias("avg_edge_length"),
                )

            sections = F.struct(
                _object(o["context"]).alias("context"), _object(o["derived_metrics"]).alias("metrics")
            )
            return _let(sections, of_sections)

        return _let(_object(v), of_members)

    return doc.select("export_id", F.transform(_list(F.col("_snapshots")), snapshot).alias("snapshots"))


def flat_snapshots(exports: DataFrame) -> DataFrame:
    """Parent table: export_id, snap_pos, plt_path; one row for each snapshot object, an export sent again counts once."""
    rows = nested(exports).select(
        F.inline(F.transform("snapshots", lambda s: F.struct(F.col("export_id"), s.snap_pos.alias("snap_pos"), s.present.alias("present"), s.plt_path.alias("plt_path"))))
    )
    return rows.where("present").drop("present").distinct()


def flat_field_items(exports: DataFrame) -> DataFrame:
    """Child table: export_id, snap_pos, item_pos, title, value; one row for each item that has a title or a value."""
    rows = nested(exports).select(
        F.inline(
            F.flatten(
                F.transform(
                    "snapshots",
                    lambda s: F.transform(
                        s["items"],
                        lambda i: F.struct(
                            F.col("export_id"),
                            s.snap_pos.alias("snap_pos"),
                            i.item_pos.alias("item_pos"),
                            i.title.alias("title"),
                            i.value.alias("value"),
                        ),
                    ),
                )
            )
        )
    )
    return rows.where("title is not null or value is not null").distinct()


def flat_metrics(exports: DataFrame) -> DataFrame:
    """Child table: export_id, snap_pos, saddles, avg_edge_length; one row for each snapshot with either."""
    rows = nested(exports).select(
        F.inline(
            F.transform(
                "snapshots",
                lambda s: F.struct(
                    F.col("export_id"),
                    s.snap_pos.alias("snap_pos"),
                    s.saddles.alias("saddles"),
                    s.avg_edge_length.alias("avg_edge_length"),
                ),
            )
        )
    )
    return rows.where("saddles is not null or avg_edge_length is not null").distinct()


def leaves(exports: DataFrame) -> DataFrame:
    """Rows (export_id, snap_pos, leaf, item_pos, value) of all leaves that are present and not null.

    ``leaf`` is field_item (its own value), display_counts (saddles) or geom_info
    (avg_edge_length); item_pos is -1 for the latter two. Positions count from 0 and
    null elements keep their place. Empty texts, zeros and values of another type
    are leaves. An export sent again counts once; null, empty and unreadable payloads
    and an empty table give no rows; further columns are ignored.
    """

    def row(s: Column, leaf: str, pos: Column, value: Column) -> Column:
        return F.struct(
            F.col("export_id").alias("export_id"),
            s.snap_pos.alias("snap_pos"),
            F.lit(leaf).alias("leaf"),
            pos.alias("item_pos"),
            value.alias("value"),
        )

    def of_snapshot(s: Column) -> Column:
        items = F.transform(s["items"], lambda i: row(s, "field_item", i.item_pos, i.value))
        singles = F.array(
            row(s, "display_counts", F.lit(NO_ITEM), s.saddles), row(s, "geom_info", F.lit(NO_ITEM), s.avg_edge_length)
        )
        return F.concat(items, singles)

    rows = nested(exports).select(F.inline(F.flatten(F.transform("snapshots", of_snapshot))))
    return rows.where("value is not null").distinct()
