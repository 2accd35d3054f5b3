"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents in a seeded random order. With target weight w, block k of a source is released at
slot floor(k / w) and due by slot ceil((k + 1) / w); every slot goes to the released block that is due first. At any slot each
source then has had its weight times the slots so far, with a deviation of less than one block.

Weights are exact rationals, never rounded to parts of a frame. When a source has had its due of all its blocks, the others share its part by their
weights: k / w is read as the virtual time at which each source would have had k blocks, and the slot of a virtual time is the sum of what
all sources would have had by then. That fluid mix fills every slot, so windows of whole slots around it can always be met, and
earliest deadlines first meets them: the deviation from it stays below one block to the end, over any number of sources that run out. Every document gets
exactly one place; nothing is repeated or left out.

Scale: a document's number in its source comes from small hash buckets and running counts over buckets, so a source holding a third of all
rows is spread like any other. One task works out the slots of blocks (one step for each ``block_rows`` documents) and holds two numbers
and one waiting block of each source; the slots are a stored table, joined by source and block.

Defined cases: a null source is a source of its own; rows of one source with equal ids are placed next to each other in any
order; an empty table gives an empty result; sources without a given weight get one ``frame``-th of the sum of the given ones. ``max_sources``
raises an error beyond that many sources; by default there is no limit.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solea.session import store

BUCKET_ROWS = 128  # expected rows of one hash bucket
BUCKETS_TOGETHER = 512  # buckets whose counts are summed in one step
SLOTS_TOGETHER = 65_536  # slots of the schedule in one batch


def slots(blocks: dict[str, int], weights: dict[str, Fraction | int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of all blocks by earliest deadline among released blocks, slot after slot."""
    scale = lcm(*(Fraction(w).denominator for w in weights.values()))
    whole = {s: int(w * scale) for s, w in weights.items()}
    ends = sorted((Fraction(n, whole[s]), s) for s, n in blocks.items())  # virtual times at which sources run out
    times = [v for v, _ in ends]
    had, rate = [0], [sum(whole[s] for s in blocks)]  # by number of sources that have run out: their blocks, and the weight of the others
    for _, s in ends:
        had.append(had[-1] + blocks[s])
        rate.append(rate[-1] - whole[s])

    def around(source: str, k: int) -> tuple[int, int]:
        """The slots before and after the time at which the source would have had k blocks."""
        out = bisect_right(times, Fraction(k, whole[source]))
        at = had[out] * whole[source] + k * rate[out]
        return at // whole[source], -(-at // whole[source])

    later = [(0, source, 0) for source in sorted(blocks)]  # (release, source, block)
    ready: list[tuple[int, str, int, int]] = []  # (deadline, source, block, release of the next)
    for slot in range(sum(blocks.values())):
        while later and later[0][0] <= slot:
            _, source, k = heapq.heappop(later)
            release, deadline = around(source, k + 1)
            heapq.heappush(ready, (deadline, source, k, release))
        _, source, k, release = heapq.heappop(ready)
        yield source, k, slot
        if k + 1 < blocks[source]:
            heapq.heappush(later, (release, source, k + 1))


def frame_schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) where each source has as many blocks as its weight says."""
    return list(slots(parts, parts))


def target_weights(rows: dict[str, int], weights: dict[str, float] | None, power: float, frame: int) -> dict[str, Fraction]:
    """Exact weights: the given ones as they are written, or rows to the power; sources without one get a ``frame``-th of the sum."""
    wanted = {s: Fraction(str(weights.get(s, 0) if weights else n**power)) for s, n in rows.items()}
    least = sum(w for w in wanted.values() if w > 0) / frame or Fraction(1)
    return {s: w if w > 0 else least for s, w in wanted.items()}


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def place_in_mix(documents: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 64, power: float = 0.7,
                 frame: int = 200, max_sources: int | None = None, seed: int = 7) -> DataFrame:
    """All columns, and ``__block`` (number in its source), ``__slot`` and ``__position`` (order of documents in the mix)."""
    keyed = documents.withColumn("__source", _source_key(F.col("source"))).withColumn("__hash", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    if max_sources is not None and keyed.select("__source").distinct().limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    given = {(f"={s}" if s is not None else "null"): w for s, w in weights.items()} if weights else None

    def schedule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {s: int(n) for batch in batches for s, n in zip(batch["__source"], batch["__rows"])}
        found = slots({s: -(-n // block_rows) for s, n in rows.items()}, target_weights(rows, given, power, frame))
        while some := list(islice(found, SLOTS_TOGETHER)):
            yield pd.DataFrame(some, columns=["__source", "__block", "__slot"])

    counted, _ = store(keyed.groupBy("__source").agg(F.count("*").alias("__rows")), "mix-sources")
    planned, _ = store(counted.coalesce(1).mapInPandas(schedule, "__source string, __block long, __slot long"), "mix-slots")

    widths = counted.select("__source", F.ceil(F.col("__rows") / BUCKET_ROWS).alias("__buckets"))
    part = (F.shiftrightunsigned("__hash", 11) / F.lit(float(1 << 53))) * F.col("__buckets")
    keyed = keyed.join(widths, "__source").withColumn("__bucket", F.floor(part)).drop("__buckets")
    group = ["__source", "__bucket"]
    ranked = keyed.withColumn("__in_bucket", F.row_number().over(Window.partitionBy(*group).orderBy("__hash", "doc_id")))
    counts = keyed.groupBy(*group).agg(F.count("*").alias("__n")).withColumn("__run", F.floor(F.col("__bucket") / BUCKETS_TOGETHER))
    in_run = Window.partitionBy("__source", "__run").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.partitionBy("__source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("__source", "__run").agg(F.sum("__n").alias("__n")).select("__source", "__run", F.coalesce(F.sum("__n").over(over_runs), F.lit(0)).alias("__before"))
    offsets = counts.withColumn("__in_run", F.coalesce(F.sum("__n").over(in_run), F.lit(0))).join(runs, ["__source", "__run"]).select(
        *group, (F.col("__before") + F.col("__in_run")).alias("__first"))
    numbered = ranked.join(offsets, group).withColumn("__number", F.col("__first") + F.col("__in_bucket") - 1).drop("__first", "__in_bucket", "__bucket", "__hash")
    numbered = numbered.withColumn("__block", F.floor(F.col("__number") / block_rows)).withColumn("__row", F.col("__number") % block_rows).drop("__number")

    found = numbered.join(planned, ["__source", "__block"]).withColumn("__position", F.col("__slot") * block_rows + F.col("__row"))
    return found.select(*documents.columns, "__block", "__slot", "__position")


def mix_order(documents: DataFrame, **how) -> DataFrame:
    """doc_id, source, block_no (in its source), slot and position of every document."""
    placed = place_in_mix(documents.select("doc_id", "source"), **how)
    return placed.select("doc_id", "source", F.col("__block").alias("block_no"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, in the order of the mix: partitions follow each other and each is sorted."""
    placed = place_in_mix(documents, **how)
    return placed.repartitionByRange("__position").sortWithinPartitions("__position").select(*documents.columns)
