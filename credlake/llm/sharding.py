"""Operator 9: consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of 2**60 places.  A row hashes to
a place by its key and belongs to the shard of the next point clockwise.  A
shard takes rows of its own arcs up to its capacity, in ring order; what
overflows continues clockwise to the next points whose shards have room.  So
the balance is set by the capacities, and a change of the shard count moves
only the rows near changed arcs and full shards.

Only per-arc counts (at most ``n_shards * vnodes`` rows) reach the driver,
which turns them into intervals of the ring order; rows are then matched to
intervals in parallel.  A key holding a third of all rows is one place of the
ring, but the ring order breaks its ties by the row's other columns, so it is
spread over range partitions like any other rows.

Edge cases: a null text counts as empty (size 16, CRC 0); null, repeated or
equal ids and texts are ordinary rows; equal texts share one ring place, so
copies stay on one shard while it has room; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credlake.llm.common import ordered_index, saved

RING_BITS = 60
ROW_OVERHEAD = 16


def ring(n_shards: int, vnodes: int, seed: str = "ring") -> tuple[list[int], list[int]]:
    """Sorted ring places of all virtual nodes and the shard owning each."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"{seed}/{s}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS), s)
        for s in range(n_shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def equal_capacities(total: int, n_shards: int) -> list[int]:
    """Capacities that sum to ``total`` and differ by one at most (no slack)."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def slack_capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """The classical bound: every shard may hold ``1 + slack`` times the mean."""
    return [-int(-total * (1 + slack) // n_shards)] * n_shards


def overflow_intervals(loads: list[int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """Intervals ``(first, last + 1, shard)`` of the ring order, sorted.

    ``loads[i]`` rows hash to arc ``i``.  First each arc keeps what its shard
    has room for; then the overflow walks clockwise, first come first served,
    twice round at most.
    """
    if sum(loads) > sum(capacities):
        raise ValueError("the capacities are smaller than the load")
    room, begins, out, spilled = list(capacities), [], [], []
    at = 0
    for load, shard in zip(loads, owners):
        kept = min(load, room[shard])
        room[shard] -= kept
        if kept:
            out.append((at, at + kept, shard))
        spilled.append((at + kept, at + load))
        begins.append(at)
        at += load
    carried: deque[tuple[int, int]] = deque()
    for lap in range(2):
        for arc, shard in enumerate(owners):
            while carried and room[shard]:
                lo, hi = carried.popleft()
                n = min(room[shard], hi - lo)
                room[shard] -= n
                out.append((lo, lo + n, shard))
                if lo + n < hi:
                    carried.appendleft((lo + n, hi))
            if lap == 0 and spilled[arc][0] < spilled[arc][1]:
                carried.append(spilled[arc])
    return sorted(out)


def bounded_ring(docs: DataFrame, n_shards: int, vnodes: int = 128, slack: float = 0.0,
                 seed: str = "ring") -> DataFrame:
    """Shard the rows of ``docs`` (doc_id, text); see the module docstring.

    ``slack`` 0 gives exact capacities: shard sizes differ by one row at most.
    Returns doc_id, size, text_crc32, home_shard (the owner of the row's ring
    place), shard, slot.
    """
    places, owners = ring(n_shards, vnodes, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - RING_BITS).alias("place"))
    indexed = ordered_index(saved(keyed, "ring-keys"), [F.col("place"), F.col("doc_id"), F.col("size")], "ring", "ring_index")

    edges = np.array(places, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(edges, place.to_numpy()) % len(edges)).astype(np.int32))

    counts = {r["arc"]: r["count"] for r in indexed.groupBy(arc_of("place").alias("arc")).count().collect()}
    # rows after the last point belong to the first arc but end the ring order:
    # they are an arc of their own here, with the first arc's owner
    last = indexed.filter(F.col("place") > places[-1]).count()
    loads = [counts.get(a, 0) for a in range(len(places))]
    loads[0] -= last
    loads.append(last)
    total = sum(loads)
    capacities = equal_capacities(total, n_shards) if slack == 0 else slack_capacities(total, n_shards, slack)
    parts = overflow_intervals(loads, owners + owners[:1], capacities)

    begins, shards, slots, filled = [], [], [], [0] * n_shards
    for lo, hi, shard in parts:
        begins.append(lo)
        shards.append(shard)
        slots.append(filled[shard] - lo)
        filled[shard] += hi - lo
    first, shard_of, shift_of = (np.array(x, dtype=np.int64) for x in (begins, shards, slots))
    owner_of = np.array(owners, dtype=np.int64)

    @F.pandas_udf("shard int, slot long, home_shard int")
    def assign(index: pd.Series, place: pd.Series) -> pd.DataFrame:
        at = index.to_numpy()
        k = np.searchsorted(first, at, side="right") - 1
        home = owner_of[np.searchsorted(edges, place.to_numpy()) % len(edges)]
        return pd.DataFrame({"shard": shard_of[k].astype(np.int32), "slot": at + shift_of[k],
                             "home_shard": home.astype(np.int32)})

    return (indexed.withColumn("_to", assign("ring_index", "place"))
            .select("doc_id", "size", "text_crc32", "_to.shard", "_to.slot", "_to.home_shard"))


def owner(place: int, places: list[int], owners: list[int]) -> int:
    """The shard of the next point clockwise (plain Python, for checks)."""
    return owners[bisect_left(places, place) % len(places)]
