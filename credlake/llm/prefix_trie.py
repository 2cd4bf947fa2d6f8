"""Operator 12: trie of conversation prefixes by time-forward processing.

Every distinct sequence of first turns is a node; subtree totals flow from the
deepest nodes to the root.  A node is named by its depth and a 128-bit digest of
its turns, so texts are read once and never shuffled.

Time-forward processing: the nodes of a shard are sorted by reverse level order
(Spark's external sort); a task walks them once, takes the totals that children
sent to the node out of a priority queue and sends the node's own totals to its
parent, which is always further on.  The queue holds ``QUEUE_ITEMS`` messages in
memory and spills sorted runs to an unnamed file that ends with the task.

Shards: a node is heavy if more than B conversations begin with it, where B is
at least ``SHARD_MEMBERS`` and 1/``HEAVY_NODES`` of all turns, so there are at most
``HEAVY_NODES`` heavy nodes however the turns are spread.  A shard root is a node
under a heavy one that is not heavy itself: its subtree has B members at most,
and subtrees are dealt to tasks by their root.  The roots' totals are added up per
heavy parent before the shuffle, and the heavy nodes are walked last.

Long conversations: positions come from one order over all turns, and prefix
digests from digests of blocks of ``BLOCK`` turns, so no conversation is read by
one task before the walk.  A subtree is walked by one task, whose memory does not
grow with it.

Edge cases: null role or text is empty; turns of one conversation with equal
numbers are ordered by the digest of role and text, so repeated rows are turns
of their own; a null turn comes first; rows without conv_id belong to no
conversation; other columns are not read, and very long texts are hashed where
they are read; an empty table has no nodes.
"""
from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.llm.common import ordered_index, saved

SHARD_MEMBERS = 128
HEAVY_NODES = 50_000
BLOCK = 256
QUEUE_ITEMS = 200_000
CHUNK_IDS = 5_000         # ids of a chunk of a node's ends
BATCH_ROWS = 20_000
BRANCH = 100              # a conversation continues the one at the last multiple of BRANCH
MOST_SHARED = 6           # by fewer turns than this


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1-based), digest of (role, text) in two longs, code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"), F.length(text).cast("long").alias("chars"))
    placed = ordered_index(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "turn-order", "at")
    heads = placed.groupBy("conv_id").agg(F.min("at").alias("head"))
    return placed.join(heads, "conv_id").select("conv_id", (F.col("at") - F.col("head") + 1).alias("pos"), "a", "b", "chars")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one it continues."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED))


def rebuilt(original: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv_id, length) of all of them.

    A conversation c begins with the first turns of c - c % BRANCH, as many as
    ``shared_turns`` says, and goes on with its own turns after as many."""
    sizes = saved(original.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "conversation-sizes")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BRANCH))
    stems = sizes.where(F.pmod("conv_id", F.lit(BRANCH)) == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("stem"))
    convs = sizes.withColumn("base", base).withColumn("h", shared_turns(F.col("conv_id"))).join(stems, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("stem", F.lit(0))))
    lengths = saved(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")),
                    "rebuilt-sizes")
    own = (original.join(lengths, "conv_id").where("pos > h")
           .select("conv_id", (F.col("pos") + F.col("taken") - F.col("h")).alias("pos"), "a", "b", "chars"))
    heads = original.where((F.pmod("conv_id", F.lit(BRANCH)) == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    first = heads.join(lengths, "base").where("pos <= taken").select("conv_id", "pos", "a", "b", "chars")
    return own.unionByName(first), lengths.select("conv_id", "length")


def prefixes(turn_rows: DataFrame) -> DataFrame:
    """``turn_rows`` with the digest of the turns up to each: XOR of digests keyed by position."""
    keyed = turn_rows.select("conv_id", "pos", "chars", F.expr(f"pos div {BLOCK}").alias("block"),
                             F.xxhash64("a", "pos").alias("a"), F.xxhash64("b", "pos", F.lit("prefix")).alias("b"))
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = saved(keyed.withColumns({"ka": F.bit_xor("a").over(within), "kb": F.bit_xor("b").over(within)}), "prefix-blocks")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where(F.col("block") > 0).select("conv_id").distinct()
    carried = (rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
               .select("conv_id", "block", F.bit_xor("a").over(before).alias("ca"), F.bit_xor("b").over(before).alias("cb")).where("block > 0"))
    later = rows.where(F.col("block") > 0).join(carried, ["conv_id", "block"]).withColumns(
        {"ka": F.col("ka").bitwiseXOR(F.col("ca")), "kb": F.col("kb").bitwiseXOR(F.col("cb"))})
    both = rows.where(F.col("block") == 0).unionByName(later.select(*rows.columns))
    return both.select("conv_id", F.col("pos").alias("depth"), "chars", "ka", "kb",
                       F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"))


class MessageQueue:
    """Least message first; beyond ``limit`` messages, sorted runs go to a file."""

    RECORD = struct.Struct("<qqqqqq")

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.file, self.runs = limit, [], None, []

    def push(self, message: tuple) -> None:
        if len(self.held) >= self.limit:
            self._spill()
        heapq.heappush(self.held, message)

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.held.sort()
        begin = self.file.seek(0, 2)
        self.file.write(b"".join(self.RECORD.pack(*m) for m in self.held))
        self._head(self._read(begin, self.file.tell()))
        self.held = []

    def _read(self, at: int, end: int):
        while at < end:
            self.file.seek(at)
            data = self.file.read(min(end - at, 1024 * self.RECORD.size))
            at += len(data)
            yield from self.RECORD.iter_unpack(data)

    def _head(self, run) -> None:
        message = next(run, None)
        if message is not None:
            heapq.heappush(self.runs, (message, id(run), run))

    def least(self):
        first = self.held[0] if self.held else None
        if self.runs and (first is None or self.runs[0][0] < first):
            return self.runs[0][0]
        return first

    def pop(self) -> tuple:
        if self.runs and (not self.held or self.runs[0][0] < self.held[0]):
            message, _, run = heapq.heappop(self.runs)
            self._head(run)
            return message
        return heapq.heappop(self.held)


_NODE = ["depth", "ka", "kb", "pa", "pb", "conv_id", "n_convs", "own_saved", "is_root", "children", "leaves", "saved"]
_TOTALS = "depth long, ka long, kb long, pa long, pb long, conv_id long, n_convs long, is_root boolean, n_children long, n_leaves long, saved_tokens long"


def walk(batches):
    """Totals of nodes that come deepest first; a shard root's are for another walk."""
    queue = MessageQueue(QUEUE_ITEMS)
    names = [c.split()[0] for c in _TOTALS.split(", ")]
    for batch in batches:
        out = []
        for depth, ka, kb, pa_, pb_, conv, n, own, root, children, leaves, total in zip(*(batch.column(c).to_pylist() for c in _NODE)):
            total += own
            at = (-depth, ka, kb)
            while (message := queue.least()) is not None and message[:3] == at:
                queue.pop()
                children, leaves, total = children + 1, leaves + message[4], total + message[5]
            if message is not None and message[:3] < at:
                raise RuntimeError("a message was sent to a node that is not here")
            leaves = leaves or 1
            if not root:
                queue.push((1 - depth, pa_, pb_, 0, leaves, total))
            out.append((depth, ka, kb, pa_, pb_, conv, n, root, children, leaves, total))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if queue.least() is not None:
        raise RuntimeError("a message was sent to a node that is not here")


def _id_chunks(batches):
    """Runs of a node's ids, in order, as comma-joined texts."""
    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                          ["ka", "kb", "first", "ids"])
    key, ids, done = None, [], []
    for batch in batches:
        for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "conv_id"))):
            if (a, b) != key or len(ids) >= CHUNK_IDS:
                if ids:
                    done.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (a, b), []
                if len(done) >= BATCH_ROWS:
                    yield rows(done)
                    done = []
            ids.append(conv)
    if ids:
        done.append((*key, ids[0], ",".join(map(str, ids))))
    if done:
        yield rows(done)


def _digests(batches):
    """One digest per node of its chunks in order, read as a stream."""
    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                          ["ka", "kb", "ends_sha256"])
    key, digest, done = None, None, []
    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids"))):
            if (a, b) != key:
                if digest is not None:
                    done.append((*key, digest.hexdigest()))
                    if len(done) >= BATCH_ROWS:
                        yield rows(done)
                        done = []
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if digest is not None:
        done.append((*key, digest.hexdigest()))
    if done:
        yield rows(done)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of rows (ka, kb, conv_id).

    Ids are range-partitioned in order and travel on as chunks of ``CHUNK_IDS``;
    only the digest itself, which is serial, reads a node's chunks in one task."""
    order = ["ka", "kb", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_chunks, "ka long, kb long, first long, ids string")
    return (chunks.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first")
            .mapInArrow(_digests, "ka long, kb long, ends_sha256 string"))


def trie(turn_rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the conversations with turns (conv_id, pos, a, b, chars) and (conv_id, length)."""
    paths = saved(prefixes(turn_rows), "paths")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    below = paths.groupBy("depth", "ka", "kb").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                                   F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = saved(below.unionByName(root.select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv_id", "n_convs",
                                                zero.alias("chars"), zero.alias("pa"), zero.alias("pb"))), "nodes")
    bound = max(SHARD_MEMBERS, -(-paths.count() // HEAVY_NODES))
    is_heavy = (F.col("n_convs") > bound) | (F.col("depth") == 0)
    heavy = saved(nodes.where(is_heavy), "heavy-nodes")
    key = ["depth", "ka", "kb"]
    heavy_keys = F.broadcast(heavy.select(*key))  # HEAVY_NODES + 1 rows at most
    light_paths = paths.join(heavy_keys, key, "left_anti")
    anchors = light_paths.groupBy("conv_id").agg(F.min_by(F.struct("depth", "ka", "kb"), "depth").alias("anchor"))
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved")
    starts = [zero.alias(c) for c in ("children", "leaves", "saved")]
    light = (nodes.where(~is_heavy).join(anchors, "conv_id")
             .select(*key, "pa", "pb", "conv_id", "n_convs", own, (F.col("depth") == F.col("anchor.depth")).alias("is_root"), *starts, "anchor"))
    lower = saved(light.repartition("anchor.depth", "anchor.ka", "anchor.kb").sortWithinPartitions(F.desc("depth"), "ka", "kb")
                  .select(*_NODE).mapInArrow(walk, _TOTALS), "lower-totals")
    sent = (lower.where("is_root").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
            .agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    top = (heavy.join(sent, key, "left").select(
        *key, "pa", "pb", "conv_id", "n_convs", own, (F.col("depth") == 0).alias("is_root"),
        *(F.coalesce(c, zero).alias(c) for c in ("children", "leaves", "saved"))))
    upper = saved(top.coalesce(1).sortWithinPartitions(F.desc("depth"), "ka", "kb").mapInArrow(walk, _TOTALS), "upper-totals")

    # parents: heavy ones are few, light ones have a bounded number of children
    parent = [(F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id")]
    by = ["depth", "pa", "pb"]
    totals = (upper.unionByName(lower.where("is_root")).join(F.broadcast(heavy.select(*parent)), by, "left")
              .unionByName(lower.where("not is_root").join(lower.select(*parent), by)))
    ends = (lengths.join(paths.select("conv_id", F.col("depth").alias("length"), "ka", "kb"), ["conv_id", "length"], "left")
            .select(F.coalesce("ka", zero).alias("ka"), F.coalesce("kb", zero).alias("kb"), "conv_id"))
    return totals.join(ends_digests(ends), ["ka", "kb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    original = saved(turns(conversations), "turns")
    rows, lengths = rebuilt(original)
    return trie(rows, lengths)
