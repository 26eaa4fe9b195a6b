"""Sources combined to target weights by a Pfair schedule of token blocks.

A mixture is as large as its scarcest source allows when that source is repeated
as often as it may be. Each source is a stream of documents in hashed order,
repeated copy after copy, cut into blocks of equal size. Block k of a source
with weight w is released at slot floor((k-1)/w) and due by slot ceil(k/w);
earliest deadline first fills the slots. Weights are exact fractions. A mixture's
block is its ``SLOTS``-th part, so its schedule has about as many slots whatever its
size, and no task walks the whole mixture.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarscape.llm import tokenizer
from scalarscape.operators.windows import running_total
from scalarscape.session import cut_lineage

SLOTS = 20_000  # slots of a mixture's schedule, about, whatever its size
MAX_TARGETS = 10_000  # rows of the table of target weights, which the driver reads
BUCKETS = 4096  # pieces of a source's hashed order


def source_key(col: Column) -> Column:
    """Sources that differ in letter case, white space around them or hyphen for underscore are one; a blank source is none."""
    key = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[-\s]+", "_")
    return F.when(key != "", key)


def shares_of(weights: dict[str, float]) -> dict[str, Fraction]:
    """Positive weights as exact parts of their sum."""
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def pfair(shares: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block number from 0, slot): earliest deadline first among the released blocks, ties by source; ``blocks`` of each source are placed."""
    waiting, ready, out = [], [], []  # by release and by deadline
    for s, w in shares.items():
        if blocks[s]:
            heappush(waiting, (0, s, 0))
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:  # only where rounding the blocks up left a gap at the end
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, k = heappop(waiting)
            w = shares[s]
            heappush(ready, (-(-(k + 1) * w.denominator // w.numerator), s, k))
        _, s, k = heappop(ready)
        out.append((s, k, slot))
        if k + 1 < blocks[s]:
            w = shares[s]
            heappush(waiting, ((k + 1) * w.denominator // w.numerator, s, k + 1))
        slot += 1
    return out


def mix(
    documents: DataFrame,
    targets: DataFrame,
    block_tokens: int | None = None,
    folder: str = tokenizer.TOKENIZER_DIR,
    vocabulary: str = tokenizer.VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The mixtures' rows (mixture, source, doc_id, copy_no, n_tokens, slot, position) and shares (one row for each target).

    Read in the order (slot, position), a mixture's tokens of every source stay within
    less than ``deviation_bound`` of its target share of all tokens so far: one block and,
    as documents are kept whole, the longest document of each source, those of the others
    by the source's weight. Shares give target_share (of the weights of the sources that
    the mixture names), actual_share, tokens, documents, copies (most of one document),
    available tokens, max_repeats, block_tokens (``block_tokens`` or the mixture's own)
    and deviation_bound. A source without documents, or with weight 0 or
    null, contributes nothing; the others keep their weights among each other and its
    actual share 0 is reported. No document has more than max_repeats copies (null or
    less than 1: none). Documents whose text is null, empty or without tokens have no
    size and are not used. A mixture named twice for one source counts with the sum
    of weights and the least of repeats. Repeated rows of documents count as documents
    of their own. Empty tables give no rows.
    """
    spark = documents.sparkSession
    wanted = (
        targets.select("mixture", source_key(F.col("source")).alias("source"), "target_weight", "max_repeats")
        .where("mixture is not null and source is not null")
        .groupBy("mixture", "source")
        .agg(F.sum("target_weight").alias("w"), F.min("max_repeats").alias("r"))
        .limit(MAX_TARGETS + 1)
        .collect()
    )
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target weights")
    names = sorted({t.source for t in wanted})
    chosen = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    chosen = chosen.where(F.col("source").isin(names)) if names else chosen.limit(0)
    sized = tokenizer.count_tokens(chosen, ["doc_id", "source"], "text", folder, vocabulary).where("n_tokens > 0")
    hashed = sized.withColumn("_h", F.xxhash64("doc_id")).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)))
    sized = running_total(cut_lineage(hashed), ["source"], "_bucket", ["_h", "doc_id"], "n_tokens", "start")  # read twice, so encoded before
    per_source = cut_lineage(sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))).collect()  # one row a target's source
    totals, longest = {t.source: t.n for t in per_source}, {t.source: t.longest for t in per_source}

    plans, slots, rows = [], [], []
    for mixture in sorted({t.mixture for t in wanted}):
        own = {t.source: t for t in wanted if t.mixture == mixture}
        given = {s: float(t.w) for s, t in own.items() if t.w and t.w > 0}
        live = {s: w for s, w in given.items() if totals.get(s) and (own[s].r or 0) >= 1}
        parts = shares_of(live) if live else {}
        size = min((totals[s] * own[s].r / p for s, p in parts.items()), default=0)
        block = block_tokens or max(1, int(-(-size // SLOTS)))
        blocks = {s: int(-(-size * p // block)) for s, p in parts.items()}
        around = sum(longest[s] for s in parts)
        for s, p in parts.items():
            need = size * p
            full = min(int(need // totals[s]), own[s].r)
            plans.append((mixture, s, totals[s], full, float(need - full * totals[s]) if full < own[s].r else 0.0, block, blocks[s]))
        slots += [(mixture, s, k, slot) for s, k, slot in pfair(parts, blocks)]
        weight = sum(given.values())
        for s in own:
            bound = float(block + longest[s] + parts[s] * around) if s in parts else None
            rows.append((mixture, s, given.get(s, 0.0) / weight if weight else 0.0, totals.get(s, 0), own[s].r, block, bound))

    plan = spark.createDataFrame(
        plans, "mixture string, source string, total bigint, full int, rest double, block bigint, blocks bigint"
    )
    schedule = spark.createDataFrame(slots, "mixture string, source string, k bigint, at bigint")
    placed = sized.join(F.broadcast(plan), "source")
    copies = F.col("full") + F.when(F.col("start") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    copied = placed.where(copies > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies)))
    offset = (F.col("copy_no") - 1) * F.col("total") + F.col("start")
    k = F.least(F.floor(offset / F.col("block")), F.col("blocks") - 1)
    blocked = copied.withColumn("position", offset).withColumn("k", k)
    small = len(slots) <= 20 * SLOTS  # the schedules of many mixtures are joined by shuffle
    scheduled = blocked.join(F.broadcast(schedule) if small else schedule, ["mixture", "source", "k"])
    mixed = scheduled.select(
        "mixture", "source", "doc_id", F.col("copy_no").cast("int").alias("copy_no"), "n_tokens", F.col("at").alias("slot"), "position"
    )
    asked = spark.createDataFrame(
        rows, "mixture string, source string, target_share double, available_tokens bigint, max_repeats int, block_tokens bigint, deviation_bound double"
    )
    reached = mixed.groupBy("mixture", "source").agg(
        F.sum("n_tokens").alias("tokens"),
        F.count_if(F.col("copy_no") == 1).alias("documents"),
        F.max("copy_no").alias("copies"),
    )
    whole = reached.groupBy("mixture").agg(F.sum("tokens").alias("_whole"))
    shares = (
        asked.join(reached, ["mixture", "source"], "left")
        .join(whole, "mixture", "left")
        .select(
            "mixture",
            "source",
            "target_share",
            F.coalesce(F.col("tokens") / F.col("_whole"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            "available_tokens",
            "max_repeats",
            "block_tokens",
            "deviation_bound",
        )
    )
    return mixed, shares


def deviations(mixed: DataFrame, shares: DataFrame) -> DataFrame:
    """(mixture, source, deviation_tokens, deviation_bound): how far a source's running tokens are from its part of the running total at most, over all documents in order.

    Its part is the weight among the sources that the mixture holds. Running totals are
    taken slot by slot, each slot a piece of its own, so no task walks a whole mixture.
    """
    # one source fills a slot, so within it only that source's tokens grow
    per_slot = mixed.groupBy("mixture", "slot", "source").agg(F.sum("n_tokens").alias("tokens"))
    per_slot = per_slot.withColumn("_piece", F.floor(F.col("slot") / 256))
    own = running_total(per_slot, ["mixture", "source"], "_piece", ["slot"], "tokens", "own_before")
    whole = cut_lineage(running_total(own, ["mixture"], "_piece", ["slot", "source"], "tokens", "all_before"))
    held = shares.where("tokens > 0").select("mixture", "source", "target_share", "deviation_bound")
    held = held.withColumn("part", F.col("target_share") / F.sum("target_share").over(Window.partitionBy("mixture")))  # one row a target
    # a source's deviation is an extreme at a slot's ends: of its own slots it rises, of the others' it falls
    at = whole.join(F.broadcast(held), ["mixture", "source"])
    own_end = F.col("own_before") + F.col("tokens")
    all_end = F.col("all_before") + F.col("tokens")
    before, after = F.col("own_before") - F.col("part") * F.col("all_before"), own_end - F.col("part") * all_end
    worst = at.groupBy("mixture", "source").agg(F.max(F.greatest(F.abs(before), F.abs(after))).alias("deviation_tokens"))
    return held.join(worst, ["mixture", "source"]).select("mixture", "source", "deviation_tokens", "deviation_bound")
