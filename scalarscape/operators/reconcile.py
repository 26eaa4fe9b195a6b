"""Differences between two copies of one table, key by key and field by field.

Both copies are reduced to the newest row of each key (partial aggregation, so
a key with a third of all rows never meets one task), put under one set of
range split points, sorted inside the partitions and streamed through a
two-pointer merge that emits missing keys and unequal fields.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a missing value, of true and of false, after trimming and lower-casing.
MISSING = ["", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "<na>"]
TRUE = ["1", "1.0", "on", "t", "true", "y", "yes"]
FALSE = ["0", "0.0", "f", "false", "n", "no", "off"]

MISS = "\x00"  # stands for a missing value inside the merge


def _plain(col: Column) -> Column:
    return F.lower(F.regexp_replace(col.cast("string"), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def canonical_number(col: Column) -> Column:
    """One spelling per number: ``' 7'``, ``'007'``, ``'+7'``, ``'7.0'`` and ``'7e0'`` become ``'7'``; missing markers become null; other text stays, trimmed and lower-cased."""
    text = _plain(col)
    number = text.try_cast("decimal(38,10)")
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"0+$", ""), r"\.$", "")
    shown = F.when(number == 0, F.lit("0")).otherwise(shown)
    return F.when(text.isin(MISSING), None).otherwise(F.coalesce(shown, text))


def canonical_boolean(col: Column) -> Column:
    """``'true'`` or ``'false'`` for their usual spellings; missing markers become null; other text stays, trimmed and lower-cased."""
    text = _plain(col)
    return (
        F.when(text.isin(MISSING), None)
        .when(text.isin(TRUE), "true")
        .when(text.isin(FALSE), "false")
        .otherwise(text)
    )


@dataclass(frozen=True)
class FieldRule:
    """A field that both copies hold, and the function that gives one spelling to equal values."""

    name: str
    canonical: callable


def _newest(df: DataFrame, keys: list[str], rules: list[FieldRule], version: str, side: int) -> DataFrame:
    values = [F.coalesce(rule.canonical(F.col(rule.name)), F.lit(MISS)).alias(rule.name) for rule in rules]
    narrow = df.select(*keys, F.col(version).alias("_version"), *values)
    state = F.struct("_version", *[rule.name for rule in rules])
    newest = narrow.groupBy(*keys).agg(F.max(state).alias("_s"))
    return newest.select(
        *keys, F.lit(side).cast("int").alias("_side"), *[F.col(f"_s.{rule.name}").alias(rule.name) for rule in rules]
    )


def _merge(keys: list[str], fields: list[str], names: tuple[str, str]):
    """The merge of one partition: sorted by key and side, at most one row per key and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: pa.Table | None = None

        def emit(rows: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table | None]:
            n = rows.num_rows
            same = np.ones(max(n - 1, 0), dtype=bool)
            for k in keys:
                col = rows.column(k).combine_chunks()
                codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy()
                same &= codes[1:] == codes[:-1]
            pair = np.append(same, False)  # row i meets row i + 1
            second = np.insert(same, 0, False)
            keep_back = 0 if last or n == 0 or second[n - 1] else 1  # the last row may meet the next batch
            upto = n - keep_back
            out = []
            alone = np.flatnonzero(~pair & ~second)
            alone = alone[alone < upto]
            if len(alone):
                side = rows.column("_side").to_numpy()[alone]
                piece = rows.take(pa.array(alone)).select(keys)
                out.append(
                    piece.append_column("item", pa.array(["row"] * len(alone), pa.string())).append_column(
                        "finding", pa.array(np.where(side == 0, names[0], names[1]), pa.string())
                    )
                )
            left = np.flatnonzero(pair)
            left = left[left < upto]
            if len(left):
                for f in fields:
                    col = rows.column(f).combine_chunks()
                    codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy()
                    bad = left[codes[left] != codes[left + 1]]
                    if len(bad):
                        piece = rows.take(pa.array(bad)).select(keys)
                        out.append(
                            piece.append_column("item", pa.array([f] * len(bad), pa.string())).append_column(
                                "finding", pa.array(["differs"] * len(bad), pa.string())
                            )
                        )
            return (pa.concat_tables(out) if out else None), (rows.slice(upto) if keep_back else None)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            found, held = emit(rows, last=False)
            if found is not None:
                yield from found.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            found, _ = emit(held, last=True)
            if found is not None:
                yield from found.combine_chunks().to_batches()

    return run


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    rules: list[FieldRule],
    version: str,
    left_only: str = "only_main",
    right_only: str = "only_mirror",
) -> DataFrame:
    """Rows (keys, item, finding): ``item`` is ``'row'`` with ``left_only``/``right_only`` for a key on one side, else a field's name with ``'differs'``.

    Of each side and key only the row with the greatest ``version`` counts; rows
    that tie are resolved by the greatest values, so the result does not depend
    on the order of arrival, and repeated rows count once. A null version is older
    than any other. Null keys are keys of their own (null meets null). Missing
    against missing is no difference, missing against a value is one. Two empty
    tables give no rows; further columns are ignored, whatever their names.
    """
    fields = [rule.name for rule in rules]
    both = _newest(left, keys, rules, version, 0).unionByName(_newest(right, keys, rules, version, 1))
    ordered = both.repartitionByRange(*keys).sortWithinPartitions(*keys, "_side")
    types = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["item string", "finding string"])
    return ordered.mapInArrow(_merge(keys, fields, (left_only, right_only)), schema)
