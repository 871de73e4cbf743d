"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.llm.common import local_table, table

#: Slots that are scheduled one by one at least and at most; the places of later blocks are computed.
PERIOD, MAX_SLOTS = 1000, 100_000
#: Weights are whole numbers of this total, so that a schedule of 10**11 slots is off by less than one block for it.
GRAIN = 10**12
#: Rows of a source that are scheduled together; doubled until the first source runs out within MAX_SLOTS slots.
BLOCK_ROWS = 64
#: The schedule and the weights are driver-side tables; more sources than this are refused.
MAX_SOURCES = 500
#: Rows that one task ranks at least, and how many for each square root of a source's rows: ranges are ranked in one task too.
RANK_ROWS, RANK_ROOT = 1024, 4


def slot_shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole shares of a period for each source: largest remainders, at least one each."""
    total = math.fsum(weights.values())
    exact = {k: period * w / total for k, w in weights.items()}
    shares = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(weights, key=lambda k: (-(exact[k] - math.floor(exact[k])), k))
    i = 0
    while sum(shares.values()) < period:
        shares[order[i % len(order)]] += 1
        i += 1
    while sum(shares.values()) > period:
        shares[max(shares, key=lambda k: (shares[k], k))] -= 1
    return shares


def pfair_slots(shares: dict, slots: int | None = None) -> list[tuple]:
    """The first slots of the schedule (as many as all shares, if not given) as (source, block, slot).

    Block k of a source with weight w, its part of all shares, may start at floor(k / w) and must be done by
    ceil((k + 1) / w). Among the released blocks the one with the earliest deadline gets the slot (ties by name),
    which keeps every source within one block of weight times slots.
    """
    period = sum(shares.values())
    slots = period if slots is None else slots
    waiting: list[list] = [[] for _ in range(slots)]
    for source in sorted(shares):
        waiting[0].append((source, 0))
    ready: list[tuple] = []
    out = []
    for slot in range(slots):
        for source, k in waiting[slot]:
            heapq.heappush(ready, (-(-(k + 1) * period // shares[source]), source, k))
        _, source, k = heapq.heappop(ready)
        out.append((source, k, slot))
        release = max((k + 1) * period // shares[source], slot + 1)
        if release < slots:
            waiting[release].append((source, k + 1))
    return out


def split_steps(shares: dict, done: dict) -> dict:
    """The steps (a, b, f) from each source up a Huffman tree of the shares, for the blocks after the first ``done``.

    A node deals its slots to its two branches in proportion: of its first c slots, floor((a * c + f) / b) belong to
    a branch that holds a of the node's b shares. So block m of a branch is slot (b * (m + 1) - f - 1) div a of its
    node, and at the root that is the slot of the whole schedule. A node never strays by a whole block from where
    ``done`` left it, and its error reaches a source only in proportion to the source's part of the branch; a source's
    part at least halves with every second step, so the sum is bounded whatever the run's length and the number of sources.
    """
    steps: dict = {s: [] for s in shares}
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(shares.items()))]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, left), (other, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        b, here = a + other, sum(done[s] for s in left)
        low = b * here - a * (here + sum(done[s] for s in right))
        f = min(max(b // 2, low), low + b - 1)
        for s in left:
            steps[s].append((a, b, f))
        for s in right:
            steps[s].append((other, b, b - 1 - f))
        heapq.heappush(heap, (b, i, left + right))
    return steps


def default_weights(counts: dict) -> dict:
    """Square roots of the sources' row counts: large sources lead, small ones are heard."""
    return {k: math.sqrt(n) for k, n in counts.items() if n}


def mix_sources(docs: DataFrame, weights: dict | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Give each row its place in an interleaving of the sources that follows target weights.

    Rows of a source are ordered by the MD5 of their doc_id and cut into blocks of ``block_rows``, or
    so many times two of that that the first source runs out within ``MAX_SLOTS`` slots. Up to there
    (and for ``period`` slots at least) the slots follow a Pfair schedule by the unrounded weights, so
    every source keeps within one block of its target as long as all sources last. The place of a later
    block is arithmetic on the steps of its source (``split_steps``), which go on from there. The
    tables are bounded and no task sees a whole source. No row is dropped or repeated: where a
    source has run out its later slots stay empty. Columns: ``doc`` (the input row as a struct),
    ``source_key``, ``block``, ``slot`` and ``pos`` (the row's place in its block); ordering by slot
    and pos is the mix. ``on_target`` is true for the slots before the first source has run out.

    Defined cases: a null source is the source ``""``; sources without a given weight get the
    smallest given weight; no weights at all are the default ones; a source of weight zero gets its
    slots after all others have long run out, and if all are zero they are equal; negative, infinite
    and NaN weights are refused with ValueError. Null doc_ids are ordered by their rows' hashes; repeated
    rows keep separate places in any order; an empty table gives an empty result. More than
    ``max_sources`` sources are refused with ValueError, since weights and slots are held by the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source")
    if weights and not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    rows = docs.select(F.struct("*").alias("doc"), key, F.md5(F.coalesce(F.col("doc_id").cast("string"), hashed.cast("string")).cast("binary")).alias("_order"), hashed.alias("_hash"))
    counted = rows.groupBy("_source").count().limit(max_sources + 1).collect()
    if len(counted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    counts = {r["_source"]: r["count"] for r in counted}
    target = {k: weights.get(k, min(weights.values())) for k in counts} if weights else default_weights(counts)
    target = target if any(target.values()) else dict.fromkeys(target, 1.0)
    shares = slot_shares(target, GRAIN) if counts else {}
    lasts = lambda: min((-(-counts[s] // block_rows) * GRAIN // n for s, n in shares.items()), default=0)
    while lasts() > MAX_SLOTS:
        block_rows *= 2
    period = max(period, len(counts), lasts())
    first = pfair_slots(shares, period) if counts else []
    done = Counter(s for s, _, _ in first)
    steps = split_steps(shares, done)
    slots = local_table(spark, first, "_source string, _block long, _slot long")
    size = local_table(
        spark, [(s, math.ceil(counts[s] / max(RANK_ROWS, RANK_ROOT * math.isqrt(counts[s]))), *([x[i] for x in steps[s]] for i in range(3))) for s in shares],
        "_source string, _ranges long, _a array<long>, _b array<long>, _f array<long>",
    )
    # a source's order is cut into ranges of the digest, small enough to be ranked in one task
    place_of = F.coalesce(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(0))
    rows = rows.join(F.broadcast(size), "_source").withColumn("_bucket", F.floor(place_of * F.col("_ranges") / F.lit(16**8)))
    starts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n")).select(
        "_source", "_bucket", (F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", F.col("doc.doc_id"), "_hash")) - 1
    ranked = rows.withColumn("_place", place).join(starts, ["_source", "_bucket"]).withColumn("_rank", F.col("_place") + F.col("_before"))
    at = ranked.withColumn("_block", F.floor(F.col("_rank") / block_rows))
    # products of shares and slots exceed a long
    later = "aggregate(arrays_zip(_a, _b, _f), _block, (m, s) -> (cast(s._b as decimal(15,0)) * cast(m + 1 as decimal(20,0)) - s._f - 1) div s._a)"
    placed = at.join(F.broadcast(slots), ["_source", "_block"], "left").withColumn("_at", F.coalesce("_slot", F.expr(later)))
    begun: dict = {s: {} for s in shares}
    for s, k, slot in first:
        begun[s][k] = slot
    horizon = min((_end_slot(-(-counts[s] // block_rows), begun[s], steps[s]) for s in shares), default=0)
    return placed.select(
        "doc",
        F.col("_source").alias("source_key"),
        F.col("_block").cast("long").alias("block"),
        F.col("_at").cast("long").alias("slot"),
        (F.col("_rank") % block_rows).cast("long").alias("pos"),
        (F.col("_at") < horizon).alias("on_target"),
    )


def _end_slot(block: int, first: dict, steps: list[tuple]) -> int:
    """The slot of a block, here of the one after a source's last: from there the source's slots are empty."""
    if block in first:
        return first[block]
    for a, b, f in steps:
        block = (b * (block + 1) - f - 1) // a
    return block


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), F.col("source_key").alias("source"), "block", "slot", "pos", "on_target")
