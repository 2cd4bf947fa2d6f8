"""Operator 5: benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of ``window`` consecutive words (a shorter
item is one window).  A window is a set of word shingles, and a text contains
the window only if it holds all of them; so one necessary prefix token -- the
window's rarest shingle, by counts over all documents -- is enough to find
every candidate.  Documents keep the shingles that a fixed-size bitmap of all
window shingles lets through, join on the prefix tokens, pass the length and
positional bounds, and are verified shingle by shingle over the whole window.

The bitmap has a fixed size whatever the benchmark's; the prefix table is
replicated over a few salts, so a passage that a third of all documents share
does not meet in one task.

Edge cases: null or empty text has no words and no hits; an item without words
has no window; equal windows of several items count for each of them; rows
that repeat a doc_id are judged row by row; an empty benchmark leaves every
document clean.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import saved
from credlake.llm.words import ALNUM, WordHasher, groups, shingles, signed

WINDOW = 10
SHINGLE = 3
BITMAP_BITS = 23
SALTS = 16
#: a position carries its shingle's length above this bit, for windows under SHINGLE words
LENGTH_SHIFT = 40


def _windows(batches):
    """item_id, window hash lists: first column the window's size in words."""
    hasher = WordHasher(ALNUM)
    for part, data, offsets in groups(batches, "text"):
        hashes, _, first = hasher(data, offsets)
        ids = part.column("item_id").to_pylist()
        item, size, tokens = [], [], []
        for k, item_id in enumerate(ids):
            words = hashes[first[k]:first[k + 1]]
            if not len(words):
                continue
            n = min(WINDOW, len(words))
            grams = signed(shingles(words, min(SHINGLE, n)))
            per = n - min(SHINGLE, n) + 1
            for at in range(len(words) - n + 1):
                item.append(item_id)
                size.append(n)
                tokens.append(grams[at:at + per].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
            ["item_id", "size", "tokens"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id (as string), size, tokens (the window's shingle hashes in order)."""
    return (benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
            .mapInArrow(_windows, "item_id string, size int, tokens array<long>").distinct())


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the top BITMAP_BITS of column ``token``; 2**17 words at most reach the driver."""
    bit = F.shiftrightunsigned("token", 64 - BITMAP_BITS)
    words = (hashes.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast({} & 63 as int))".format(
        f"shiftrightunsigned(token, {64 - BITMAP_BITS})")).alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).collect())
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    for r in words:
        out[r["word"]] = np.uint64(r["bits"] & ((1 << 64) - 1))
    return out


def _hit_finder(bitmap: np.ndarray, lengths: list[int]):
    top = np.uint64(64 - BITMAP_BITS)

    def find(batches):
        hasher = WordHasher(ALNUM)
        for part, data, offsets in groups(batches, "text"):
            hashes, _, first = hasher(data, offsets)
            all_pos, all_tokens, all_rows = [], [], []
            for length in lengths:
                grams = shingles(hashes, length)
                bits = grams >> top
                hit = np.flatnonzero((bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1))
                row = np.searchsorted(first, hit, side="right") - 1
                inside = hit + length <= first[row + 1]  # not over the end of its text
                hit, row = hit[inside], row[inside]
                all_pos.append(hit - first[row] + (length << LENGTH_SHIFT))
                all_tokens.append(signed(grams[hit]))
                all_rows.append(row)
            row = np.concatenate(all_rows) if all_rows else np.zeros(0, np.int64)
            order = np.argsort(row, kind="stable")
            at = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
            pos = np.concatenate(all_pos)[order] if all_pos else row
            tokens = np.concatenate(all_tokens)[order] if all_tokens else row
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, pa.int64())) for x in (pos, tokens)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row_id"), part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists],
                ["row_id", "doc_id", "n_words", "pos", "token"])
    return find


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its necessary token: the rarest of its shingles.

    A window with a shingle that no document holds cannot occur and is dropped.
    """
    owners = windows.groupBy("size", "tokens").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    owners = owners.withColumn("window_id", F.xxhash64("size", "tokens"))
    return (owners.select("window_id", "size", "tokens", "items", F.posexplode("tokens").alias("offset", "token"))
            .join(counts, "token")
            .groupBy("window_id")
            .agg(F.min(F.struct("n", "token", "offset")).alias("rarest"), F.count(F.lit(1)).alias("seen"),
                 *(F.first(c).alias(c) for c in ("size", "tokens", "items")))
            .filter(F.col("seen") == F.size("tokens"))
            .select("size", "tokens", "items", F.col("rarest.offset").alias("offset"), F.col("rarest.token").alias("token"),
                    F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit,
    items (sorted ids of the items with occurring windows)."""
    windows = saved(benchmark_windows(benchmark), "windows")
    bitmap = _bitmap(windows.select(F.explode("tokens").alias("token")).distinct())
    lengths = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("n")).distinct().collect())
    hits = saved(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                             F.col("text").cast("string").alias("text"))
                 .mapInArrow(_hit_finder(bitmap, lengths),
                             "row_id long, doc_id long, n_words long, pos array<long>, token array<long>"), "hits")
    spots = hits.select("row_id", "n_words", F.explode(F.arrays_zip("pos", "token")).alias("h")).select(
        "row_id", "n_words", "h.pos", "h.token", F.pmod(F.hash("row_id"), F.lit(SALTS)).cast("int").alias("salt"))
    prefixes = _prefixes(windows, spots.groupBy("token").agg(F.count(F.lit(1)).alias("n")))

    position = F.col("pos").bitwiseAND((1 << LENGTH_SHIFT) - 1)
    candidates = (spots.join(prefixes, ["token", "salt"])
                  .withColumn("start", position - F.col("offset"))
                  .filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
                  .groupBy("row_id").agg(F.collect_list(F.struct(
                      "start", "size", "tokens", "items", (F.col("pos") - F.col("offset")).alias("first"))).alias("found")))

    def holds(c):
        """The window's shingles stand in the row's hits, in order and without a gap."""
        at = F.array_position("pos", c["first"]).cast("int")
        n = F.size(c["tokens"])
        return ((at > 0) & (F.try_element_at("pos", at + n - 1) == c["first"] + n - 1)
                & (F.slice("token", F.greatest(at, F.lit(1)), n) == c["tokens"]))

    judged = (hits.join(candidates, "row_id", "left")
              .withColumn("found", F.coalesce(F.filter("found", holds), F.array())))
    covered = F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1)))
    return judged.select(
        "doc_id", "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"])))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with the items as count and digest, and the verdict."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
