"""Operator 8: shortest-pack-first packing over the length histogram.

Every document is tokenised whole (its ids, then one closing id) and cut at
multiples of the sequence length, so only its last piece is shorter.  The
counts of pieces by length -- at most ``capacity`` numbers -- are packed
longest length first: each length goes to the packs with the most room (the
shortest packs) that still fit it, a whole group of equal packs at a time, and
opens new packs only where none fits.  The result is a list of packing patterns
with counts; its size depends on the capacity, not on the data.  Pieces are
joined back by rank: the k-th piece of a length takes the k-th slot that the
patterns hold for this length.

Ranks come from one total order over (length, row, start), so a length that a
third of all pieces share is spread like any other; ids move once, keyed by
piece.

Edge cases: a null or empty text is the closing id alone; repeated rows are
packed one by one; special-token strings in a text get their special id, as
the tokenizer's own default; an empty table gives no rows.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import ordered_index, released, saved

CAPACITY = 2048
CACHE_ENTRIES = 120_000
CACHED_CHARS = 48


class CachedEncoder:
    """Token ids of whole texts as little-endian 16-bit integers.

    Byte-level BPE never joins across the end of a word that white space
    follows, so a text's ids are the ids of its white-space + word chunks in a
    row; chunks are cached.  Texts with special-token strings or with control
    characters on whose class the libraries differ are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.by_whole = re.compile("|".join(["[\x1c-\x1f]", *(re.escape(t["content"]) for t in added)]))
        self.uneven = re.compile(r"^\s|\s$|\s\s")
        self.chunks = re.compile(r"\s*\S+|\s+")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.spaced, self.plain = _Cache(self.ordinary, " "), _Cache(self.ordinary, "")

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded for the few texts that need it."""
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.json_path)

    def forget(self) -> None:
        """Drops what was cached, and the tokenizer that few texts need."""
        self.spaced, self.plain = _Cache(self.ordinary, " "), _Cache(self.ordinary, "")
        self.__dict__.pop("whole", None)

    def __call__(self, text: str) -> bytes:
        if self.by_whole.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        if not text:
            return b""
        if self.uneven.search(text):
            return b"".join(map(self.plain.__getitem__, self.chunks.findall(text)))
        parts = text.split(" ")
        return self.plain[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))


class _Cache(dict):
    """Ids by chunk, in two generations: a full young one becomes the old one,
    and what is still in use moves back as it is met."""

    def __init__(self, encode, prefix: str) -> None:
        super().__init__()
        self.encode, self.prefix, self.old = encode, prefix, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = array("H", self.encode(self.prefix + chunk)).tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


_ENCODERS: dict[tuple[str, str], CachedEncoder] = {}


def _pieces(json_path: str, ranks_path: str, pattern: str, closing_id: int, capacity: int):
    def run(batches):
        from credlake.llm.packing import _ENCODERS  # the worker's own, not a copy sent along
        encoder = _ENCODERS.get((json_path, ranks_path))
        if encoder is None:
            encoder = _ENCODERS[json_path, ranks_path] = CachedEncoder(json_path, ranks_path, pattern)
        end = np.array([closing_id], dtype="<u2").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for row, doc, text in zip(*(part.column(c).to_pylist() for c in ("row_id", "doc_id", "text"))):
                    ids = encoder(text or "") + end
                    n = len(ids) // 2
                    for at in range(0, n, capacity):
                        piece = ids[2 * at:2 * (at + capacity)]
                        crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                        out.append((row, doc, at, len(piece) // 2, n, crc, piece))
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                    ["row_id", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])
        encoder.forget()  # the worker serves later stages
        released()
    return run


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in order) patterns holding every counted piece."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:
                by_room.setdefault(capacity - length, []).append((left, (length,)))
                break
            packs, pattern = by_room[room].pop()
            used = min(packs, left)
            left -= used
            if packs > used:
                by_room[room].append((packs - used, pattern))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - length, []).append((used, (*pattern, length)))
    return [group for room in sorted(by_room) for group in by_room[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]], counts: dict[int, int]):
    """Slot intervals in the order of (length, rank): begin, sequence - rank, offset."""
    begin_of, at = {}, 0
    for length in sorted(counts):
        begin_of[length] = at
        at += counts[length]
    out, first_sequence = [], 0
    for packs, pattern in patterns:
        offset = 0
        for length in pattern:
            out.append((begin_of[length], first_sequence - begin_of[length], offset))
            begin_of[length] += packs
            offset += length
        first_sequence += packs
    out.sort()
    return [np.array(x, dtype=np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def packed(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, closing_id: int = 1,
           capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their place and ids: doc_id, start, length, doc_tokens,
    sequence_id, offset, ids (little-endian 16-bit) and ids_crc32 (of the ids as
    little-endian 32-bit).  A reader that leaves the ids out never moves them."""
    pieces = saved(
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"))
        .mapInArrow(_pieces(json_path, ranks_path, pattern, closing_id, capacity),
                    "row_id long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    begins, shifts, offsets = slots(pack_histogram(counts, capacity), counts)

    @F.pandas_udf("sequence_id long, offset long")
    def place(index: pd.Series) -> pd.DataFrame:
        at = index.to_numpy()
        k = np.searchsorted(begins, at, side="right") - 1
        return pd.DataFrame({"sequence_id": at + shifts[k], "offset": offsets[k]})

    order = [F.col("length"), F.col("row_id"), F.col("start")]
    placed = ordered_index(pieces.select("length", "row_id", "start"), order, "piece-order", "piece_index")
    placed = placed.withColumn("_to", place("piece_index")).select("row_id", "start", "_to.sequence_id", "_to.offset")
    return pieces.join(placed, ["row_id", "start"]).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to ``capacity``: the rows a trainer reads."""
    def rows(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                ids = np.full(capacity, pad_id, dtype=np.int32)
                for p in parts:
                    ids[p["offset"]:p["offset"] + p["length"]] = np.frombuffer(p["ids"], "<u2")
                out.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return (pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "length", "ids")).alias("parts"))
            .mapInArrow(rows, "sequence_id long, ids array<int>"))
