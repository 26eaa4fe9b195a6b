"""Pairwise matches consolidated into groups: union-find forests merged through bounded partitions.

Each scan task runs union-find over its own pairs and keeps only a spanning forest.
Level by level the forests are then dealt out anew by member into partitions of about
``bound`` edges, each merged by union-find into one forest. A member that is no root
of any forest has done its part: its pointer is put aside, and only the edges of the
others go on to the next level. A level's roots are the least keys in an order, of the
keys themselves first, which gathers records with like ids, and of their hashes then:
in a random order a third of a forest's records at least are expected to be no root, so
every graph shrinks by a constant factor a level. When at most ``bound`` edges are left
one bounded task finishes, and the labels are carried back down the pointers.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalarscape.session import cut_lineage, discard, written

BOUND = 1_000_000  # edges that one task may hold
HOT_SHARE = 0.01  # a group with more than this share of all records is named by broadcast: at most 1 / HOT_SHARE rows


def match_key(col: Column) -> Column:
    """Ids that differ only in letter case or in white space around them have one key; a blank id has none."""
    key = F.lower(F.regexp_replace(col, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(key != "", key)


def _forest(a: pa.Array, b: pa.Array, seed: int) -> tuple[pa.Array, pa.Array]:
    """Edges (member, root) of the components of the pairs (a, b); the root is the least key, under seeds from 1 on the one of least hash."""
    names = pc.unique(pa.chunked_array([a, b]))
    names = names.take(pc.array_sort_indices(names))
    if seed:
        hashes = np.array([crc32(name, seed) for name in names.cast(pa.large_binary()).to_pylist()], dtype=np.int64)
        names = names.take(pa.array(np.argsort(hashes, kind="stable")))
    left = pc.index_in(a, value_set=names).to_numpy(zero_copy_only=False).tolist()
    right = pc.index_in(b, value_set=names).to_numpy(zero_copy_only=False).tolist()
    parent = list(range(len(names)))
    for x, y in zip(left, right, strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    member = np.flatnonzero(root != np.arange(len(root)))
    return names.take(pa.array(member)), names.take(pa.array(root[member]))


PAIR = pa.schema([("a", pa.string()), ("b", pa.string())])


def _local_forests(edges: DataFrame, bound: int, seed: int = 0) -> DataFrame:
    """(a, b): members and roots of each partition's forest, or of the forests of its runs of about ``bound`` edges where it holds more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def settle() -> pa.Table:
            whole = pa.concat_tables(held).combine_chunks()
            a, b = (whole.column(i).combine_chunks() for i in (0, 1))
            a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
            forest = _forest(a.cast(pa.large_string()), b.cast(pa.large_string()), seed)
            return pa.table(dict(zip(("a", "b"), forest, strict=True))).cast(PAIR)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= 2 * bound:  # shrink what is held; if it stays large, pass it on
                small = settle()
                if small.num_rows > bound:
                    yield from small.to_batches(max_chunksize=65536)
                    held, size = [], 0
                else:
                    held, size = [small], small.num_rows
        if held:
            yield from settle().to_batches(max_chunksize=65536)

    return edges.select("a", "b").mapInArrow(run, "a string, b string")


def _look_up(rows: DataFrame, key: str, found: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of the one row of ``found`` (key, value) for their key, null where there is none.

    Keys that more than HOT_SHARE of the rows have are met by broadcast, at most
    1 / HOT_SHARE of them, so that a giant group is in no one's partition.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    many = max(2.0, HOT_SHARE * rows.count())
    hot = counts.where(F.col("_n") > many).select(key).join(found, key).select(key, F.col(value).alias("_hot"))
    hot = F.broadcast(hot.limit(int(1 / HOT_SHARE)))
    marked = rows.join(hot, key, "left")
    cold = marked.where("_hot is null").drop("_hot").join(found, key, "left")
    return marked.where("_hot is not null").withColumnRenamed("_hot", value).unionByName(cold)


def representatives(pairs: DataFrame, bound: int = BOUND) -> DataFrame:
    """(key, root) for each record of ``pairs`` (a, b) that is not its group's root; a group has one root, any of its records.

    Pairs with a null side, of a record with itself and repeated pairs add nothing;
    an empty table gives no rows. Keys are compared as bytes.
    """
    edges = pairs.where("a is not null and b is not null and a <> b").select("a", "b")
    forest = written(_local_forests(edges, bound))
    left, seed, aside = forest.count(), 0, []
    while left > bound:
        parts = -(-left // bound)
        dealt = forest.repartition(parts, "a") if seed else forest.repartitionByRange(parts, "a")
        merged = written(_local_forests(dealt, 4 * bound, seed))  # parts are even but for chance, so each is one forest
        roots = merged.select(F.col("b").alias("a")).distinct().withColumn("_on", F.lit(True))
        twice = merged.groupBy("a").agg(F.count(F.lit(1)).alias("_times"))
        flagged = written(merged.join(roots, "a", "left").join(twice, "a").select("a", "b", (F.col("_on").isNotNull() | (F.col("_times") > 1)).alias("_on")))
        discard(forest, merged)
        aside.append(flagged)
        forest = flagged.where("_on").select("a", "b")
        left, seed = forest.count(), seed + 1
    found = _local_forests(forest.coalesce(1), bound).select(F.col("a").alias("key"), F.col("b").alias("root"))
    for flagged in reversed(aside):
        found = written(found)
        below = _look_up(flagged.where("not _on").select(F.col("a").alias("key"), F.col("b").alias("_up")), "_up", found.select(F.col("key").alias("_up"), "root"), "root")
        found = found.unionByName(below.select("key", F.coalesce("root", "_up").alias("root")))
    return found


def _least_of_group(rows: DataFrame, root: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the least ``value`` among those of one root."""
    return _look_up(rows, root, rows.groupBy(root).agg(F.min(value).alias(out)), out)


def labels(pairs: DataFrame, bound: int = BOUND) -> DataFrame:
    """(key, root) for each record of ``pairs`` (a, b) whose root, the smallest key of its group, is another record; see ``representatives``."""
    found = cut_lineage(representatives(pairs, bound))
    whole = found.unionByName(found.select(F.col("root").alias("key"), "root").distinct())
    return _least_of_group(whole, "root", "key", "_least").select("key", F.col("_least").alias("root")).where("key <> root")


def groups(records: DataFrame, links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(group_id, cluster_id): one row for each distinct, non-null cluster_id of ``records``, those in no link included.

    ``links`` needs cluster_a, cluster_b and is_linked; a row links its two records
    if is_linked is true, and rows that are false, null or one-sided do nothing.
    group_id is the group's smallest cluster_id as ``records`` write it. A linked id
    that ``records`` lack still joins its neighbours, but has no row. Repeated rows
    count once; empty tables give no rows; further columns are ignored.
    """
    pairs = links.where("is_linked").select(match_key(F.col("cluster_a")).alias("a"), match_key(F.col("cluster_b")).alias("b"))
    found = representatives(pairs, bound)
    nodes = (
        records.where("cluster_id is not null")
        .select("cluster_id")
        .distinct()
        .withColumn("key", F.coalesce(match_key(F.col("cluster_id")), F.col("cluster_id")))
    )
    rooted = cut_lineage(nodes.join(found, "key", "left").select("cluster_id", F.coalesce("root", "key").alias("root")))
    return _least_of_group(rooted, "root", "cluster_id", "group_id").select("group_id", "cluster_id")
