"""Operator 13: alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

A text (with a space before it) is cut into chunks at places that no token of
either tokenizer crosses -- before a space, tab or line feed that follows a
character which is no white space -- so a chunk is tokenised and aligned once
and used again wherever it occurs.  Within a chunk the byte offsets at which
tokens of both sides end cut the tokens into groups, and every pair of tokens
with overlapping bytes is a link.

Counts of linked id pairs come from a minimal perfect hash of the distinct
pairs.  Pairs are dealt to buckets of about ``BUCKET`` pairs; in each bucket
small groups of pairs get the first seed that sends all of them to free slots.
Every task adds its links up in dense vectors indexed by the hash, cut to slices,
and the slices are summed up a tree.  A second pass over the documents aligns
them again and looks the counts up; the pair stored in a slot must be the pair
asked for.

The number of distinct pairs is bounded by the two vocabularies, not by the
corpus; up to ``MOST_PAIRS`` of them the hash with its counts (15 bytes a pair)
is broadcast.  Beyond that the second pass joins the counts instead.

Edge cases: null or empty texts, and texts that a side's tokens do not spell (a
text with U+2581, say) have zeros and an empty digest; repeated rows and null
doc_ids are rows like others; an empty table gives no rows; other columns of
the input are not read; very long texts are aligned whole, and a stretch
without white space is one chunk, however long.
"""
from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import saved, spread_join
from credlake.llm.words import groups, mix

BUCKET = 2048
PER_SEED = 4              # pairs that share a seed, on average
SLICE_SLOTS = 1 << 14
FAN_IN = 8
MOST_PAIRS = 8_000_000
CACHED_CHUNKS = 150_000
HELD_PAIRS = 2_000_000    # distinct pairs a task holds before it gives them out

_SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: chunks end before a space, tab or line feed; other white space (some pieces end in \r) does not cut
CHUNK = re.compile(f"[{_SPACES}]*[^{_SPACES}]+(?:(?![ \n\t])[{_SPACES}]+[^{_SPACES}]*)*|[{_SPACES}]+")


#: chunks that begin and end like most, of characters on whose classes all versions
#: of the first side's pattern agree (ASCII and Latin letters)
PLAIN = re.compile("[ \n\t][\t\n -~\xa1-\u024f]*[!-~\xa1-\u024f]")
JOINED_CHUNKS = 2000


class Tokenizers:
    """Ids of chunks by both tokenizers and the bytes of every id.

    The first side's vocabulary comes as the tokenizer and as ranks, which are
    faster and serve for plain chunks."""

    def __init__(self, a_path: str, a_ranks: str, a_pattern: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_ranks, "rb") as lines:
            ranks = {base64.b64decode(t): int(k) for t, k in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("chunks", pat_str=a_pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            if all(ch in byte_of for ch in token):
                self.a_bytes[k] = bytes(byte_of[ch] for ch in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def plain_ids(self, chunks: list[str]):
        """Ids of plain chunks and their number by chunk, of both sides; None where
        the tokens do not spell them.

        No token crosses from chunk to chunk, so they are encoded in one text; a
        letter before it keeps the second side from adding a space."""
        text = "".join(chunks)
        whole = text.encode()
        ends = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks)))
        sides = []
        for ids, table, size in ((self.fast(text), self.a_bytes, self.a_size), (self.b.encode("x" + text)[1:], self.b_bytes, self.b_size)):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return None
            ids = np.array(ids, np.int64)
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            sides.append((ids, np.diff(last, prepend=-1)))
        return sides

    def ids(self, chunks: list[str]):
        """The same one by one, and which chunks are spelt; others have one id 0."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = [ids[1:] for ids in self.b.encode(["x" + c for c in chunks], num_threads=1)]
        good = np.ones(len(chunks), bool)
        for k, c in enumerate(chunks):
            if any(not ids[k] or b"".join(map(table.__getitem__, ids[k])) != c.encode() for ids, table in ((a, self.a_bytes), (b, self.b_bytes))):
                good[k] = False
                a[k] = b[k] = [0]
        return [_flat(a), _flat(b)], good


def _byte_level() -> dict[str, int]:
    """Byte of every character of a byte-level vocabulary: printable ones stand for
    themselves, the others for the code points from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligner(dict):
    """Number of each chunk; by number: tokens, groups, links and the digest's text."""

    def __init__(self, tokenizers: Tokenizers, with_text: bool) -> None:
        super().__init__()
        self.tokenizers, self.with_text = tokenizers, with_text
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.counts = [array("q") for _ in range(4)]  # a tokens (-1: not spelt), b tokens, groups, links
        self.text: list[str] = []
        self.pairs: list[np.ndarray] = []  # of the chunks learnt at a time

    def learn(self, chunks) -> None:
        """Aligns the chunks that are new."""
        if len(self) > CACHED_CHUNKS:
            self.reset()
        new = [c for c in set(chunks) if c not in self]
        plain = [c for c in new if PLAIN.fullmatch(c)]
        others = [c for c in new if not PLAIN.fullmatch(c)] if len(plain) < len(new) else []
        for lo in range(0, len(plain), JOINED_CHUNKS):
            part = plain[lo:lo + JOINED_CHUNKS]
            sides = self.tokenizers.plain_ids(part)
            if sides is None:
                others += part
            else:
                self._align(part, *sides, np.ones(len(part), bool))
        for lo in range(0, len(others), JOINED_CHUNKS):
            part = others[lo:lo + JOINED_CHUNKS]
            sides, good = self.tokenizers.ids(part)
            self._align(part, *sides, good)

    def _align(self, chunks: list[str], a_side, b_side, good: np.ndarray) -> None:
        (a, n_a), (b, n_b) = a_side, b_side
        size_a, size_b = self.tokenizers.a_size[a], self.tokenizers.b_size[b]
        if not good.all():  # give the single ids of chunks not spelt one byte
            size_a[(np.cumsum(n_a) - 1)[~good]] = 1
            size_b[(np.cumsum(n_b) - 1)[~good]] = 1
        a_end, b_end = np.cumsum(size_a), np.cumsum(size_b)
        # groups: cut where tokens of both sides end
        b_over = np.searchsorted(b_end, a_end)
        cut_a = b_end[b_over] == a_end
        cut_b = np.zeros(len(b), bool)
        cut_b[b_over[cut_a]] = True
        # links: tokens of b from the one over a token's first byte to the one over its last
        first = np.concatenate([[0], b_over[:-1] + cut_a[:-1]])
        n_links = b_over - first + 1
        of_a = np.repeat(np.arange(len(a)), n_links)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n_links) - n_links - first, n_links)
        self.pairs.append((a[of_a] << 16 | b[of_b]).astype(np.uint32))
        a_from = np.cumsum(n_a) - n_a
        links = np.add.reduceat(n_links, a_from)
        cuts = np.add.reduceat(cut_a.astype(np.int64), a_from)
        self.update(zip(chunks, range(len(self), len(self) + len(chunks))))
        for col, values in zip(self.counts, (np.where(good, n_a, -1), n_b, cuts, links)):
            col.frombytes(values.astype(np.int64).tobytes())
        if self.with_text:
            self.text.extend(_group_texts(a, b, cut_a, cut_b, np.cumsum(n_a + n_b).tolist()))

    def column(self, k: int) -> np.ndarray:
        return np.array(self.counts[k], np.int64)

    def all_pairs(self) -> np.ndarray:
        """Links of all chunks, chunk by chunk."""
        return np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.uint32)


#: an id as text before a comma, before the bar after a group's a tokens, and before the end of a group
_WRITTEN = [f"{k}{mark}" for mark in ",|;" for k in range(1 << 16)]


def _group_texts(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ends: list[int]) -> list[str]:
    """Per chunk, its groups as a1,a2|b1;a3|b2,b3; -- the a tokens of a group, then its b tokens."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    b_before = np.concatenate([[0], np.flatnonzero(cut_b) + 1])
    a_up_to = np.flatnonzero(cut_a) + 1
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + b_before[group_a]] = a + np.where(cut_a, 1 << 16, 0)
    codes[np.arange(len(b)) + a_up_to[group_b]] = b + np.where(cut_b, 2 << 16, 0)
    written = list(map(_WRITTEN.__getitem__, codes.tolist()))
    return ["".join(written[lo:hi]) for lo, hi in zip([0] + ends[:-1], ends)]


def _chunked(part, aligner: Aligner) -> tuple[np.ndarray, np.ndarray]:
    """Chunk numbers of a group of rows, and each row's first (one more at the end)."""
    lists = [CHUNK.findall(" " + t) if t and "▁" not in t else [] for t in part.column("text").to_pylist()]
    flat = list(chain.from_iterable(lists))
    aligner.learn(flat)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
    return np.fromiter(map(aligner.__getitem__, flat), np.int64, len(flat)), first


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _unspelt(aligner: Aligner, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of which some chunk is not spelt by the tokens."""
    return _row_sums(aligner.column(0)[ids] < 0, first) > 0 if len(ids) else np.zeros(len(first) - 1, bool)


def _compacted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, where, np.concatenate(counts))
    return distinct, out


def _pair_counter(paths: tuple[str, ...]):
    """(key, n): links of each id pair, added up as far as a task holds them."""
    def run(batches):
        aligner = Aligner(Tokenizers(*paths), with_text=False)
        keys, counts, held = [], [], 0

        def given():
            k, n = _compacted(keys, counts)
            for lo in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[lo:lo + 100_000].astype(np.int64)), pa.array(n[lo:lo + 100_000])], ["key", "n"])

        for part, _, _ in groups(batches, "text"):
            ids, first = _chunked(part, aligner)
            keep = np.repeat(~_unspelt(aligner, ids, first), np.diff(first))
            times = np.repeat(np.bincount(ids[keep], minlength=len(aligner)), aligner.column(3))
            used = times > 0
            if not used.any():
                continue
            keys.append(aligner.all_pairs()[used])
            counts.append(times[used])
            held += len(keys[-1])
            if held > HELD_PAIRS:
                k, n = _compacted(keys, counts)
                keys[:], counts[:], held = [k], [n], len(k)
                if held > HELD_PAIRS // 2:
                    yield from given()
                    keys.clear(), counts.clear()
                    held = 0
        if held:
            yield from given()
    return run


# ---- the minimal perfect hash ----

def _hash(keys: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.asarray(seed).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_hash(keys, 1 << 40) % np.uint64(buckets)).astype(np.int64)


def bucket_seeds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a bucket's groups and its pairs in the order of their slots."""
    n = len(keys)
    n_groups = -(-n // PER_SEED)
    group = (_hash(keys, 1 << 41) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=n_groups)
    ends = np.cumsum(sizes)
    seeds, free = np.zeros(n_groups, np.uint32), np.ones(n, bool)
    slots = np.zeros(n, np.uint32)
    tries = 64
    for g in np.argsort(-sizes, kind="stable"):
        members = keys[order[ends[g] - sizes[g]:ends[g]]]
        base = 0
        while len(members):
            at = (_hash(members[None, :], np.arange(base, base + tries)[:, None]) % np.uint64(n)).astype(np.int64)
            fits = free[at].all(axis=1)
            if len(members) > 1:
                fits &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            hit = np.flatnonzero(fits)
            if len(hit):
                seeds[g] = base + hit[0]
                free[at[hit[0]]] = False
                slots[at[hit[0]]] = members
                break
            base += tries
            tries = min(4096, tries * 2)
        tries = 64 if sizes[g] > 1 else tries
    return seeds, slots


def _build_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys = np.sort(table.column("key").to_numpy()).astype(np.uint32)
    seeds, slots = bucket_seeds(keys)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int32()),
                     "seeds": pa.array([seeds.tobytes()], pa.binary()), "keys": pa.array([slots.tobytes()], pa.binary())})


class PairHash:
    """The minimal perfect hash: slot of every pair, or -1 for a pair that is not its own."""

    def __init__(self, rows) -> None:
        rows = {r["bucket"]: r for r in rows}
        self.buckets = max(rows, default=0) + 1
        sizes = np.array([rows[k]["n"] if k in rows else 0 for k in range(self.buckets)], np.int64)
        seeds = [np.frombuffer(rows[k]["seeds"], np.uint32) if k in rows else np.zeros(0, np.uint32) for k in range(self.buckets)]
        self.n, self.size = sizes, int(sizes.sum())
        self.first = np.cumsum(sizes) - sizes
        self.groups = np.array([len(s) for s in seeds], np.int64)
        self.first_group = np.cumsum(self.groups) - self.groups
        self.seeds = np.concatenate(seeds)
        self.keys = np.concatenate([np.frombuffer(rows[k]["keys"], np.uint32) if k in rows else np.zeros(0, np.uint32) for k in range(self.buckets)])

    def slots(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        of = np.minimum(_bucket(keys, buckets), self.buckets - 1)
        group = (_hash(keys, 1 << 41) % np.maximum(self.groups[of], 1).astype(np.uint64)).astype(np.int64)
        seed = self.seeds[np.minimum(self.first_group[of] + group, len(self.seeds) - 1)]
        at = self.first[of] + (_hash(keys, seed) % np.maximum(self.n[of], 1).astype(np.uint64)).astype(np.int64)
        at = np.minimum(at, self.size - 1)
        return np.where((self.keys[at] == keys) & (self.n[of] > 0), at, -1)


def _vectors(shared, buckets: int):
    """Slices of a task's dense count vector."""
    def run(batches):
        pair_hash = shared.value
        total = np.zeros(pair_hash.size, np.int64)
        task = None
        for batch in batches:
            slots = pair_hash.slots(batch.column("key").to_numpy().astype(np.uint32), buckets)
            if (slots < 0).any():
                raise RuntimeError("a counted pair is not in the hash")
            np.add.at(total, slots, batch.column("n").to_numpy())
            task = batch.column("part")[0].as_py()
        for k in range(0, len(total), SLICE_SLOTS) if task is not None else ():
            cut = total[k:k + SLICE_SLOTS]
            if cut.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE_SLOTS], pa.int32()), pa.array([task], pa.int32()), pa.array([cut.tobytes()], pa.binary())],
                                                 ["slice", "part", "vector"])
    return run


def _sum_slices(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table.column("vector")], axis=0)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "vector": pa.array([total.tobytes()], pa.binary())})


_SLICE = "slice int, part int, vector binary"


def _tree_sum(slices: DataFrame, parts: int) -> DataFrame:
    """One vector per slice: FAN_IN tasks' vectors are added at a time, up a tree."""
    while parts > 1:
        parts = -(-parts // FAN_IN)
        slices = slices.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy("slice", "part").applyInArrow(_sum_slices, _SLICE)
    return slices


class PairCounts:
    """Counts of all pairs by slot, and whether a pair's count is its second id's highest."""

    def __init__(self, pair_hash: PairHash, slices, buckets: int) -> None:
        self.pair_hash, self.buckets = pair_hash, buckets
        self.n = np.zeros(pair_hash.size, np.int64)
        for row in slices:
            cut = np.frombuffer(row["vector"], np.int64)
            self.n[row["slice"] * SLICE_SLOTS:row["slice"] * SLICE_SLOTS + len(cut)] = cut
        second = pair_hash.keys & np.uint32(0xFFFF)
        highest = np.zeros(1 << 16, np.int64)
        np.maximum.at(highest, second, self.n)
        self.best = self.n == highest[second]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.pair_hash.slots(keys, self.buckets)
        found = slots >= 0
        at = np.maximum(slots, 0)
        if not len(self.n):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        return np.where(found, self.n[at], 0), found & self.best[at]


_OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _second_pass(paths: tuple[str, ...], shared):
    """The documents' rows; without ``shared`` counts, each row's pairs for the join."""
    def run(batches):
        aligner = Aligner(Tokenizers(*paths), with_text=True)
        seen, best, total = None, None, None
        for part, _, _ in groups(batches, "text"):
            ids, first = _chunked(part, aligner)
            bad = _unspelt(aligner, ids, first)
            sizes = [np.where(bad, 0, _row_sums(aligner.column(k)[ids], first)) for k in range(4)]
            if shared is not None:
                if aligner.text is not seen:  # the aligner began anew
                    seen, best, total = aligner.text, np.zeros(0, np.int64), np.zeros(0, np.int64)
                fresh = aligner.column(3)[len(best):]
                if len(fresh):
                    n, top = shared.value(aligner.all_pairs()[-int(fresh.sum()):])
                    starts = np.concatenate([[0], np.cumsum(fresh)])
                    best = np.concatenate([best, _row_sums(top, starts)])
                    total = np.concatenate([total, _row_sums(n, starts)])
                sizes += [np.where(bad, 0, _row_sums(v[ids], first)) for v in (best, total)]
            numbers = ids.tolist()
            digests = [hashlib.sha256("".join(map(aligner.text.__getitem__, numbers[lo:hi]))[:-1].encode()).hexdigest() if hi > lo and not out else ""
                       for lo, hi, out in zip(first[:-1].tolist(), first[1:].tolist(), bad)]
            cols = [part.column("doc_id"), *(pa.array(s.astype(np.int64)) for s in sizes)]
            if shared is not None:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(digests, pa.string())], [c.split()[0] for c in _OUT.split(", ")])
                continue
            of_chunk = np.split(aligner.all_pairs(), np.cumsum(aligner.column(3))[:-1])
            links = [np.concatenate([of_chunk[k] for k in numbers[lo:hi]]).astype(np.int64) if hi > lo and not out else np.zeros(0, np.int64)
                     for lo, hi, out in zip(first[:-1].tolist(), first[1:].tolist(), bad)]
            yield pa.RecordBatch.from_arrays([part.column("row_id"), *cols, pa.array(digests, pa.string()), pa.array(links, pa.list_(pa.int64()))],
                                             ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
    return run


def pair_hash_rows(partial: DataFrame, distinct: int) -> tuple[DataFrame, int]:
    """Buckets of the minimal perfect hash over column ``key``, and their number."""
    buckets = max(1, -(-distinct // BUCKET))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(_bucket(key.to_numpy(), buckets).astype(np.int32))

    keys = partial.select("key").distinct().withColumn("bucket", bucket("key"))
    return saved(keys.groupBy("bucket").applyInArrow(_build_bucket, "bucket int, n int, seeds binary, keys binary"), "pair-hash"), buckets


def alignment(docs: DataFrame, a_path: str, a_ranks: str, a_pattern: str, b_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens, groups, links and their corpus-wide counts.

    The first side is a byte-level BPE (its file, its ranks and its pattern), the
    second a piece model that adds the space before a text itself."""
    spark = docs.sparkSession
    paths = (a_path, a_ranks, a_pattern, b_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = saved(rows.select("text").mapInArrow(_pair_counter(paths), "key long, n long"), "pair-counts")
    distinct = partial.select("key").distinct().count()
    if distinct > MOST_PAIRS:
        return _by_join(rows, paths, partial)
    hash_rows, buckets = pair_hash_rows(partial, distinct)
    pair_hash = PairHash(hash_rows.collect())  # MOST_PAIRS pairs at most
    parts = max(1, partial.rdd.getNumPartitions())
    dense = (partial.withColumn("part", F.spark_partition_id())
             .mapInArrow(_vectors(spark.sparkContext.broadcast(pair_hash), buckets), _SLICE))
    counts = PairCounts(pair_hash, _tree_sum(dense, parts).collect(), buckets)
    return rows.mapInArrow(_second_pass(paths, spark.sparkContext.broadcast(counts)), _OUT)


def _by_join(rows: DataFrame, paths: tuple[str, ...], partial: DataFrame) -> DataFrame:
    """The same rows with the counts joined, for more pairs than are broadcast."""
    counts = saved(partial.groupBy("key").agg(F.sum("n").alias("n")), "all-pairs")
    highest = counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("second")).agg(F.max("n").alias("highest"))
    counts = (counts.withColumn("second", F.col("key").bitwiseAND(F.lit(0xFFFF))).join(highest, "second")
              .select("key", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")))
    own = saved(rows.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
        _second_pass(paths, None), "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"),
        "aligned")
    links = own.select("row_id", F.explode("pairs").alias("key")).groupBy("row_id", "key").agg(F.count(F.lit(1)).alias("times"))
    sums = (spread_join(links, counts, ["key"], ["row_id"]).groupBy("row_id")
            .agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    return own.join(sums, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
