"""Iterative graph operators on edge tables, one set-based step per round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scalarscape.operators.windows import running_total
from scalarscape.session import partitions_for, written

BLOCK = 1 << 22  # edges of a group that one task colours


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) and the smallest node of its component.

    Alternates the two star operations: every node hands its larger neighbours its
    smallest neighbour, then its smaller ones; trees become stars in few rounds. Edges of
    a node with itself or with a null end, and repeated edges, add nothing but their node.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e)
    seen = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def flat_pointers(pointers: DataFrame) -> DataFrame:
    """(node, root) of pointers (node, up): doubled until each leads to a node that points at itself or nowhere."""
    now = written(pointers.select("node", F.col("up").alias("root")))
    while True:
        step = lambda c, n: now.select(F.col("node").alias(c), F.col("root").alias(n))
        nxt = now.join(step("root", "second").hint("merge"), "root", "left").join(step("second", "third").hint("merge"), "second", "left")
        moved = F.col("second").isNotNull() & (F.col("second") != F.col("root"))
        nxt = written(nxt.select("node", F.coalesce("third", "second", "root").alias("root"), moved.alias("_moved")))
        now = nxt.select("node", "root")
        if nxt.where("_moved").limit(1).count() == 0:
            return now


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """(a, b, w) of the pairs that taking the lightest free pair again and again takes.

    A pair lighter than all others at both its ends is taken in any such order, so all of
    these are taken at once, their ends are struck out, and the rest goes into the next
    round. Equal weights are ordered by (a, b).
    """
    left = written(pairs.select("a", "b", "w"))
    taken = left.limit(0)
    while left.limit(1).count():
        key = F.struct("w", "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("n"), key.alias("key"))
        first = ends.groupBy("n").agg(F.min("key").alias("best"))
        at = lambda c: first.select(F.col("n").alias(c), F.col("best").alias(f"best_{c}"))
        judged = left.join(at("a"), "a").join(at("b"), "b")
        won = written(judged.where((key == F.col("best_a")) & (key == F.col("best_b"))).select("a", "b", "w"))
        gone = won.select(F.explode(F.array("a", "b")).alias("n"))
        left = left.join(gone.select(F.col("n").alias("a")), "a", "left_anti").join(gone.select(F.col("n").alias("b")), "b", "left_anti")
        left = written(left.select("a", "b", "w"))
        taken = taken.unionByName(won)
    return taken


def colours(edges: DataFrame, n_colours: int = 18, apart: list[str] | None = None) -> DataFrame:
    """(node, colour): neighbours differ where the palette allows; nodes choose by falling degree, ties by node.

    A node takes the least colour that none of its neighbours before it has, or the least
    frequent among them if all are taken. ``apart``: columns of the edges that are equal
    for all edges of a node, as its mesh, so that nodes of different values never meet;
    without them the components are found. A group of at most BLOCK edges is coloured by
    one task, node after node; a larger one in rounds of nodes with BLOCK edges.
    """
    apart = apart or []
    e = edges.where("a <> b").select(*apart, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not apart:
        e = e.join(connected_groups(edges).select(F.col("node").alias("a"), F.col("root").alias("_group")), "a")
        apart = ["_group"]
    e = written(e)
    large = written(e.groupBy(*apart).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(*apart))
    if large.isEmpty():
        return _coloured_at_once(e, apart, n_colours)
    at_once = _coloured_at_once(e.join(F.broadcast(large), apart, "left_anti"), apart, n_colours)  # few: each stands for more than BLOCK edges
    return at_once.unionByName(_coloured_in_rounds(e.join(F.broadcast(large), apart, "left_semi"), apart, n_colours))


def _coloured_at_once(edges: DataFrame, apart: list[str], n_colours: int) -> DataFrame:
    to = StructType([StructField("node", edges.schema["a"].dataType), StructField("colour", IntegerType())])
    dealt = edges.repartition(partitions_for(edges.sparkSession), *apart).select("a", "b")
    return dealt.mapInArrow(lambda batches: _whole(batches, n_colours), to)


def _coloured_in_rounds(edges: DataFrame, apart: list[str], n_colours: int) -> DataFrame:
    both = written(edges.distinct())
    degree = both.select(*apart, F.explode(F.array("a", "b")).alias("node")).groupBy(*apart, "node").agg(F.count(F.lit(1)).alias("d"))
    ordered = running_total(degree.withColumn("_fall", -F.col("d")), apart, "_fall", ["node"], "d", "_at")
    nodes = written(ordered.select(*apart, "node", "d", "_at", F.floor(F.col("_at") / BLOCK).alias("block")))
    side = lambda p: nodes.select(*apart, F.col("node").alias(p), F.col("_at").alias(f"{p}_at"), F.col("block").alias(f"{p}_block")).hint("merge")
    placed = both.join(side("a"), [*apart, "a"]).join(side("b"), [*apart, "b"])
    pick = lambda c: F.when(F.col("a_at") > F.col("b_at"), F.col(f"a{c}")).otherwise(F.col(f"b{c}"))
    other = lambda c: F.when(F.col("a_at") > F.col("b_at"), F.col(f"b{c}")).otherwise(F.col(f"a{c}"))
    links = written(placed.select(*apart, pick("").alias("node"), pick("_block").alias("block"), other("").alias("before"), other("_block").alias("before_block")))
    kind = nodes.schema["node"].dataType
    done = nodes.select("node", F.lit(0).cast("int").alias("colour")).limit(0)
    for k in range((nodes.agg(F.max("block")).first()[0] or 0) + 1):
        now = links.where(F.col("block") == k)
        inner = now.where(F.col("before_block") == k).select(*apart, "node", F.lit(0).cast("bigint").alias("d"), "before", F.lit(None).cast("int").alias("colour"))
        outer = now.where(F.col("before_block") < k).join(done.select(F.col("node").alias("before"), "colour").hint("merge"), "before")
        own = nodes.where(F.col("block") == k).select(*apart, "node", "d", F.lit(None).cast(kind).alias("before"), F.lit(None).cast("int").alias("colour"))
        asked = own.unionByName(inner).unionByName(outer.select(*inner.columns[:-3], F.lit(0).cast("bigint").alias("d"), "before", "colour")) if k else own.unionByName(inner)
        chosen = asked.repartition(partitions_for(edges.sparkSession), *apart).drop(*apart).mapInArrow(lambda batches: _greedy(batches, n_colours), StructType([StructField("node", kind), StructField("colour", IntegerType())]))
        done = done.unionByName(written(chosen))
    return done


def _greedy(batches: Iterator[pa.RecordBatch], n_colours: int) -> Iterator[pa.RecordBatch]:
    """Colours of the nodes with a degree d; a row with ``before`` names a neighbour that chose earlier, with its colour if that is known."""
    rows = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    own = pc.is_null(rows.column("before"))
    nodes = rows.filter(own).select(["node", "d"]).sort_by([("d", "descending"), ("node", "ascending")]).column("node").combine_chunks()
    links = rows.filter(pc.invert(own))
    n = len(nodes)
    node = pc.index_in(links.column("node"), value_set=nodes).to_numpy()
    known = pc.fill_null(links.column("colour"), -1).to_numpy()
    beside = np.where(known >= 0, n + known, pc.fill_null(pc.index_in(links.column("before"), value_set=nodes), -1).to_numpy())
    yield pa.RecordBatch.from_arrays([nodes, pa.array(_in_order(n, node, beside, n_colours))], names=["node", "colour"])


def _whole(batches: Iterator[pa.RecordBatch], n_colours: int) -> Iterator[pa.RecordBatch]:
    """Colours of all nodes of the edges (a, b), which may repeat; names are put by as numbers while they are read."""
    names, ends = {}, []
    for batch in batches:
        for c in (0, 1):
            coded = batch.column(c).dictionary_encode()
            own = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int32)
            ends.append(own[coded.indices.to_numpy()])
    if not names:
        return
    a, b = np.concatenate(ends[::2]), np.concatenate(ends[1::2])
    del ends
    n, label = len(names), list(names)
    pairs = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
    a, b = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
    degree = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)).tolist()
    order = sorted(range(n), key=lambda i: (-degree[i], label[i]))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    a, b = place[a], place[b]
    colour = _in_order(n, np.maximum(a, b), np.minimum(a, b), n_colours)
    yield pa.RecordBatch.from_arrays([pa.array([label[i] for i in order], type=batch.column(0).type), pa.array(colour)], names=["node", "colour"])


def _in_order(n: int, node: np.ndarray, before: np.ndarray, n_colours: int) -> np.ndarray:
    """Colours of the nodes 0 to n - 1, which choose in that order after their neighbours ``before``; n + c there stands for one that has the colour c."""
    before = before[np.argsort(node, kind="stable")]
    ends = np.cumsum(np.bincount(node, minlength=n))
    colour = np.concatenate([np.zeros(n, np.int32), np.arange(n_colours, dtype=np.int32)])
    start = 0
    for i, end in enumerate(ends.tolist()):
        if end > start:
            colour[i] = np.bincount(colour[before[start:end]], minlength=n_colours).argmin()
        start = end
    return colour[:n]
