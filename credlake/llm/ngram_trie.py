"""Operator 11: n-gram language model in Elias-Fano tries.

The model is a bigram trie with Dirichlet smoothing (MacKay and Peto 1995):
p(w | v) = (c(v w) + ``PRIOR`` p(w)) / (c(v) + ``PRIOR``), where p(w) is the
add-one unigram; the first word's context is the beginning of the text, and
every text ends with one end token.  An unseen context leaves p(w).

Shards.  The trie is cut into shards by context.  A shard has three levels: its
contexts in order with their counts, Elias-Fano pointers to each context's range
of successors, and the successors, known by a 32-bit hash that is relative to
their context, as one Elias-Fano sequence with 16-bit quantised log
probabilities.  (Two successors of a context in a shard share a hash about three
times in 100,000 where the context fills the shard, else less; they then share
a count.)  The levels lie in a memory-mapped file of the task.  A lookup
finds the context, takes its range, and searches the first successor not below
the wanted one there.  A context whose bucket of hashes holds more than a
shard's share of all tokens is split over several shards by its successors.

Sheets.  A task gathers documents to sheets of ``SHEET_TOKENS`` tokens.  A sheet
sends each shard its distinct contexts and successors with their training
counts, and gets counts and quantised probabilities back in the same order, so
what travels is every distinct bigram of a sheet once each way, in packed arrays.

Sizes: the fullest buckets of hashes come from counts over all training tokens
(2**``BUCKET_BITS`` numbers at most reach the driver).  Shards hold about
``SHARD_TOKENS`` training tokens each, or more beyond 2**16 shards.  Unigram
counts are exact, by 64-bit word hashes.

Edge cases: a null or empty text is its end token alone; a null doc_id counts as
the empty text for the split, so it trains; repeated rows each count; other
columns are not read; an empty table gives no rows, and without training rows
every score is that of the base with no counts; a very long text is one sheet.
"""
from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from credlake.llm.common import dropped
from credlake.llm.words import NON_SPACE, WordHasher, groups, mix
from credlake.session import work_dir

PRIOR = 200.0
HELD_OUT = (7, 2)         # held out: crc32 of the id as text leaves 2 by 7
SHEET_TOKENS = 1 << 21
SHARD_TOKENS = 1 << 18
MOST_SHARDS = 1 << 16
BUCKET_BITS = 18
FINGER_BITS = 32
STEP = 16 / 65534         # of a quantised log10 probability
BEGIN, END = np.uint64(0x5BEADB0D1E57A127), np.uint64(0x1E57E4D0F7E47000)


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, without the leading planes that are all zero."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    used = np.flatnonzero(raw.any(axis=1))
    return np.ascontiguousarray(raw[:used[-1] + 1 if len(used) else 0]).tobytes()


def unplaned(data: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    out = np.zeros((n, width), np.uint8)
    if n and data:
        out[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view(dtype)


# ---- Elias-Fano ----

class Bits:
    """A bit vector in 64-bit words with the zeros and ones before each word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(zeros)])
        self.ones_before = np.arange(len(self.before), dtype=np.int64) * 64 - self.before

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left = (k - self.before[word]).astype(np.int64)
        rest = ~self.words[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = rest & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            beyond = left >= n
            left -= np.where(beyond, n, 0)
            place += np.where(beyond, width, 0)
            rest = np.where(beyond, rest >> np.uint64(width), low)
        return word * 64 + place


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary."""

    def __init__(self, values: np.ndarray, put) -> None:
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.top = n, top
        self.low_bits = max(0, min(48, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        where = high + np.arange(n)
        size = (int(high[-1]) if n else 0) + n + 2
        words = np.zeros(-(-size // 64) + 1, np.uint64)
        np.bitwise_or.at(words, where >> 6, np.uint64(1) << (where & 63).astype(np.uint64))
        self.upper = Bits(put(words))
        self.lower = put(self._pack(values & np.uint64((1 << self.low_bits) - 1)))

    def _pack(self, low: np.ndarray) -> np.ndarray:
        words = np.zeros(len(low) * self.low_bits // 64 + 2, np.uint64)
        at = np.arange(len(low)) * self.low_bits
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, at >> 6, low << shift)
        over = np.where(shift > 0, low >> (np.uint64(63) - shift) >> np.uint64(1), np.uint64(0))
        np.bitwise_or.at(words, (at >> 6) + 1, over)
        return words

    def low(self, k: np.ndarray) -> np.ndarray:
        at = k * self.low_bits
        shift = (at & 63).astype(np.uint64)
        first, second = self.lower[at >> 6], self.lower[(at >> 6) + 1]
        both = first >> shift | np.where(shift > 0, second << (np.uint64(63) - shift) << np.uint64(1), np.uint64(0))
        return both & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        """Values at places k (select on the unary part)."""
        word = np.searchsorted(self.upper.ones_before, k, side="right") - 1
        left, rest = k - self.upper.ones_before[word], self.upper.words[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = rest & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            beyond = left >= n
            left = left - np.where(beyond, n, 0)
            place += np.where(beyond, width, 0)
            rest = np.where(beyond, rest >> np.uint64(width), low)
        return (word * 64 + place - k).astype(np.uint64) << np.uint64(self.low_bits) | self.low(k)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Place of the first value not below each wanted one (n where there is none)."""
        out = np.full(len(wanted), self.n, np.int64)
        todo = np.flatnonzero(wanted <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        high = (wanted[todo] >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted[todo] & np.uint64((1 << self.low_bits) - 1)
        # values with the same high part lie side by side; halve their range
        begin = np.where(high > 0, self.upper.select0(np.maximum(high - 1, 0)) + 1, 0) - high
        end = self.upper.select0(high) - high
        while len(todo):
            done = begin >= end
            out[todo[done]] = begin[done]
            go = ~done
            todo, low, begin, end = todo[go], low[go], begin[go], end[go]
            middle = (begin + end) >> 1
            below = self.low(middle) < low
            begin, end = np.where(below, middle + 1, begin), np.where(below, end, middle)
        return out


class Levels:
    """Arrays of a shard's trie in one memory-mapped file that ends with the task."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def put(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return values
        begin = self.file.seek(0, 2)
        begin += -begin % 8
        self.file.seek(begin)
        self.file.write(values.tobytes())
        self.file.flush()
        return np.asarray(np.memmap(self.file, values.dtype, "r", begin, values.shape))


class Trie:
    """One shard: contexts with counts, pointers, successors with quantised probabilities."""

    def __init__(self, contexts: np.ndarray, tokens: np.ndarray, context: np.ndarray, finger: np.ndarray, n: np.ndarray) -> None:
        """``contexts`` ascending with their counts as ``tokens``; bigrams (place of
        the context, successor's hash, count) ascending."""
        levels = Levels()
        self.contexts, self.tokens = levels.put(contexts), levels.put(tokens)
        ends = np.searchsorted(context, np.arange(len(contexts) + 1))
        followed = np.concatenate([[0], np.cumsum(n)])[ends]
        self.followed = levels.put(np.diff(followed))
        self.pointers = EliasFano(ends.astype(np.uint64), levels.put)
        self.successors = EliasFano(context.astype(np.uint64) << np.uint64(FINGER_BITS) | finger, levels.put)
        self.codes = levels.put(quantised(n / (np.diff(followed)[context] + PRIOR)))

    def contexts_of(self, v: np.ndarray) -> np.ndarray:
        """Place of each context, -1 where it has none."""
        if not len(self.contexts):
            return np.full(len(v), -1, np.int64)
        at = np.minimum(np.searchsorted(self.contexts, v), len(self.contexts) - 1)
        return np.where(self.contexts[at] == v, at, -1)

    def code(self, context: np.ndarray, finger: np.ndarray) -> np.ndarray:
        """Quantised probability of successors of contexts; 0: not there."""
        out = np.zeros(len(context), np.uint16)
        known = np.flatnonzero(context >= 0)
        if not len(known) or not self.successors.n:
            return out
        of = context[known]
        begin, end = self.pointers[of].astype(np.int64), self.pointers[of + 1].astype(np.int64)
        wanted = of.astype(np.uint64) << np.uint64(FINGER_BITS) | finger[known]
        at = self.successors.successor(wanted)
        inside = (at >= begin) & (at < end)
        at = np.minimum(at, self.successors.n - 1)
        found = inside & (self.successors.low(at) == wanted & np.uint64((1 << self.successors.low_bits) - 1)) & (self.successors[at] == wanted)
        out[known[found]] = self.codes[at[found]]
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    return (1 + np.minimum(np.rint(-np.log10(p) / STEP), 65533)).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    """Of quantised codes; 0 for the code of what is not there."""
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) * STEP), 0.0)


# ---- dealing ----

class Dealer:
    """Shard of a context and successor; ``ways``: over how many shards a bucket of contexts is split."""

    def __init__(self, shards: int, ways: np.ndarray) -> None:
        self.shards, self.ways = shards, ways

    def home(self, v: np.ndarray) -> np.ndarray:
        return (mix(v ^ np.uint64(0xA5A5)) % np.uint64(self.shards)).astype(np.int64)

    def way(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        ways = self.ways[(v >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        return np.where(ways > 1, (mix(w) % ways.astype(np.uint64)).astype(np.int64), 0)


class Layout:
    """A sheet's distinct bigrams in the order in which they are sent to shards."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, dealer: Dealer) -> None:
        """``words``: distinct, in the order of their home shards; ``tokens``: places in
        ``words``, texts one after the other, each with its end token."""
        n = len(words)
        begins = np.cumsum(lengths) - lengths
        key = np.empty(len(tokens), np.int64)
        key[1:] = tokens[:-1]
        key[begins] = n  # the beginning of the text
        key *= n + 1
        key += tokens
        named = np.append(words, BEGIN)
        key, self.of_token = np.unique(key, return_inverse=True)
        v, w = key // (n + 1), key % (n + 1)
        home = dealer.home(named)
        way = dealer.way(named[v], words[w])
        shard = (home[v] + way) % dealer.shards
        order = np.argsort(shard, kind="stable")
        self.v, self.w, self.shard = v[order], w[order], shard[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_token = place[self.of_token]
        self.finger = mix(words[self.w] ^ mix(named[self.v])) >> np.uint64(64 - FINGER_BITS)
        # entries of contexts: one per shard with successors, and every word in its home shard
        heads = np.flatnonzero((np.diff(self.shard, prepend=-1) != 0) | (np.diff(self.v, prepend=-1) != 0))
        entry = np.concatenate([self.shard[heads] * (n + 1) + self.v[heads], home[:n] * (n + 1) + np.arange(n)])
        sizes = np.concatenate([np.diff(heads, append=len(self.v)), np.zeros(n, np.int64)])
        self.entry, where = np.unique(entry, return_inverse=True)
        self.successors = np.zeros(len(self.entry), np.int64)
        np.add.at(self.successors, where, sizes)
        self.entry_shard, self.entry_word = self.entry // (n + 1), self.entry % (n + 1)
        self.at_home = (home[self.entry_word] == self.entry_shard) & (self.entry_word < n)
        self.hashes = named


def _sheet_rows(sheet: int, docs, dealer: Dealer):
    """The sheet's own row and one row per shard."""
    hashes, lengths, ids, held = (np.concatenate(c) for c in zip(*docs))
    words, tokens = np.unique(hashes, return_inverse=True)
    order = np.argsort(dealer.home(words), kind="stable")
    words, place = words[order], np.argsort(order, kind="stable").astype(np.int32)
    tokens = place[tokens]
    del hashes
    out = Layout(words, tokens, lengths, dealer)
    trains = np.repeat(held != 1, lengths)
    counts = np.bincount(tokens[trains], minlength=len(words))
    bigrams = np.bincount(out.of_token[trains], minlength=len(out.v))
    rows = [(True, -1, sheet, len(words), planes(words), planes(tokens.astype(np.uint32)), planes(lengths.astype(np.uint32)), planes(ids), held.tobytes())]
    edges = np.flatnonzero(np.diff(out.entry_shard, prepend=-1)).tolist() + [len(out.entry)]
    bigram_at = np.concatenate([[0], np.cumsum(out.successors)])
    for lo, hi in zip(edges[:-1], edges[1:]):
        entries, here = slice(lo, hi), slice(bigram_at[lo], bigram_at[hi])
        which = out.entry_word[entries]
        own = np.where(out.at_home[entries], np.append(counts, 0)[which], 0)
        rows.append((False, int(out.entry_shard[lo]), sheet, hi - lo, planes(out.hashes[which]), planes(own.astype(np.uint32)),
                     planes(out.successors[entries].astype(np.uint32)), planes(out.finger[here]), planes(bigrams[here].astype(np.uint32))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SHEET_TYPES)], _SHEET_NAMES)


_SHEET = "own boolean, shard int, sheet long, n int, a binary, b binary, c binary, d binary, e binary"
_SHEET_NAMES = [c.split()[0] for c in _SHEET.split(", ")]
_SHEET_TYPES = [pa.bool_(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]


def _token_hashes(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by the end token, and texts' lengths."""
    hashes, _, first = hasher(data, offsets)
    lengths = np.diff(first) + 1
    out = np.empty(len(hashes) + len(lengths), np.uint64)
    ends = np.cumsum(lengths) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[ends], out[is_word] = END, hashes
    return out, lengths


def _sheets(dealer: Dealer):
    def run(batches):
        hasher = WordHasher(NON_SPACE)
        sheet = TaskContext.get().partitionId() << 32
        docs, held = [], 0
        for part, data, offsets in groups(batches, "text"):
            hashes, lengths = _token_hashes(data, offsets, hasher)
            docs.append((hashes, lengths, part.column("doc").to_numpy(), part.column("held").to_numpy()))
            held += len(hashes)
            if held >= SHEET_TOKENS:
                yield _sheet_rows(sheet, docs, dealer)
                sheet, docs, held = sheet + 1, [], 0
        if docs:
            yield _sheet_rows(sheet, docs, dealer)
    return run


def _context_buckets(batches):
    """(bucket, n): training tokens by bucket of the context; bucket -1: texts, -2: tokens."""
    hasher = WordHasher(NON_SPACE)
    total, texts, tokens = np.zeros(1 << BUCKET_BITS, np.int64), 0, 0
    for part, data, offsets in groups(batches, "text"):
        hashes, lengths = _token_hashes(data, offsets, hasher)
        trains = part.column("held").to_numpy() == 0
        hashes = hashes[np.repeat(trains, lengths)]
        n = int(trains.sum())
        hashes = hashes[hashes != END]
        total += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        texts, tokens = texts + n, tokens + len(hashes) + n
    total[int(BEGIN >> np.uint64(64 - BUCKET_BITS))] += texts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(total[used], [texts, tokens]))], ["bucket", "n"])


# ---- shards ----

_ANSWER = "sheet long, shard int, tokens binary, followed binary, codes binary, n_words long"


def _decoded(rows):
    """Contexts, their token counts and numbers of successors, successors and their counts."""
    for r in rows:
        n = r["n"]
        sizes = unplaned(r["c"], n, np.uint32).astype(np.int64)
        m = int(sizes.sum())
        yield (unplaned(r["a"], n, np.uint64), unplaned(r["b"], n, np.uint32), sizes, unplaned(r["d"], m, np.uint64), unplaned(r["e"], m, np.uint32))


def shard_trie(sent) -> Trie:
    """The trie of one shard from all that the sheets sent to it."""
    contexts, tokens, sizes, finger, n = (np.concatenate(c) for c in zip(*sent))
    distinct, of_entry = np.unique(contexts, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, of_entry, tokens.astype(np.int64))
    key = np.repeat(of_entry, sizes).astype(np.uint64) << np.uint64(FINGER_BITS) | finger
    trained = n > 0
    bigrams, of_bigram = np.unique(key[trained], return_inverse=True)
    times = np.zeros(len(bigrams), np.int64)
    np.add.at(times, of_bigram, n[trained].astype(np.int64))
    return Trie(distinct, counts, (bigrams >> np.uint64(FINGER_BITS)).astype(np.int64), bigrams & np.uint64((1 << FINGER_BITS) - 1), times)


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = table.select(["sheet", "n", "a", "b", "c", "d", "e"]).to_pylist()
    sent = list(_decoded(rows))
    trie = shard_trie(sent)
    out = []
    for row, (contexts, _, sizes, finger, _) in zip(rows, sent):
        at = trie.contexts_of(contexts)
        known = np.maximum(at, 0)
        tokens, followed = (np.where(at >= 0, level[known], 0) for level in (trie.tokens, trie.followed))
        codes = trie.code(np.repeat(at, sizes), finger)
        out.append((row["sheet"], key[0].as_py(), planes(tokens.astype(np.int64)), planes(followed.astype(np.int64)), planes(codes), None))
    out.append((-1, key[0].as_py(), None, None, None, int((np.asarray(trie.tokens) > 0).sum())))
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in _ANSWER.split(", ")])


# ---- scores ----

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(dealer: Dealer, train_texts: int, train_tokens: int, distinct: int):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        words = unplaned(row["a"], row["n"], np.uint64)
        held = np.frombuffer(row["e"], np.uint8)
        lengths = unplaned(row["c"], len(held), np.uint32).astype(np.int64)
        tokens = unplaned(row["b"], int(lengths.sum()), np.uint32).astype(np.int64)
        ids = unplaned(row["d"], len(held), np.int64)
        out = Layout(words, tokens, lengths, dealer)
        by_shard = {r["shard"]: r for r in answers.to_pylist()}
        shards, n_entries = np.unique(out.entry_shard, return_counts=True)
        n_bigrams = np.bincount(np.searchsorted(shards, out.shard), minlength=len(shards))
        at_home, followed, codes = ([], [], [])
        for s, n, m in zip(shards.tolist(), n_entries.tolist(), n_bigrams.tolist()):
            at_home.append(unplaned(by_shard[s]["tokens"], n, np.int64))
            followed.append(unplaned(by_shard[s]["followed"], n, np.int64))
            codes.append(unplaned(by_shard[s]["codes"], m, np.uint16))
        at_home, followed, codes = (np.concatenate(c) for c in (at_home, followed, codes))
        counts = np.zeros(len(words) + 1, np.int64)  # of every word, and of the beginning of a text as context
        counts[out.entry_word[out.at_home]] = at_home[out.at_home]
        context = counts.copy()
        context[-1] = train_texts
        base = (counts[:-1] + 1) / (train_tokens + distinct + 1)
        # a shard's probabilities are relative to the part of the context that it holds
        share = np.repeat(followed, out.successors) + PRIOR
        p = (probability(codes) * share + PRIOR * base[out.w]) / (context[out.v] + PRIOR)
        ends = np.cumsum(lengths)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, ends - lengths)

        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=held > 1), "held_out": pa.array(held == 1), "n_tokens": pa.array(lengths),
            "n_known": pa.array(per_text((counts[tokens] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), train_tokens)),
            "base_score": pa.array(per_text(np.log10(base)[tokens])), "score": pa.array(per_text(np.log10(p)[out.of_token]))})
    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) under the model of the rows not held out."""
    spark = docs.sparkSession
    doc = F.col("doc_id").cast("long")
    held = (F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]).cast("tinyint")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), F.when(doc.isNull(), F.lit(2).cast("tinyint")).otherwise(held).alias("held"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trained = rows.where("held <> 1").select(F.lit(0).cast("tinyint").alias("held"), "text")
    counted = trained.mapInArrow(_context_buckets, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    buckets = {r["bucket"]: r["n"] for r in counted}
    train_texts, train_tokens = buckets.pop(-1, 0), buckets.pop(-2, 0)
    shards = min(MOST_SHARDS, max(1, -(-train_tokens // SHARD_TOKENS)))
    per_shard = max(1, train_tokens // shards)
    ways = np.ones(1 << BUCKET_BITS, np.int32)
    for bucket, n in buckets.items():
        ways[bucket] = min(shards, -(-n // per_shard))
    dealer = Dealer(shards, ways)

    path = work_dir(spark, "llm-sheets")
    rows.mapInArrow(_sheets(dealer), _SHEET).write.partitionBy("own").option("compression", "zstd").parquet(path)
    schema = ", ".join(_SHEET.split(", ")[1:])
    sheets = {own: spark.read.schema(f"{schema}, own boolean").parquet(path).where(F.col("own") == own).drop("own") for own in (True, False)}
    answers_path = work_dir(spark, "llm-answers")
    sheets[False].groupBy("shard").applyInArrow(_answers, _ANSWER).write.option("compression", "zstd").parquet(answers_path)
    dropped(spark, f"{path}/own=false")  # answered, and the answers are stored
    answers = spark.read.schema(_ANSWER).parquet(answers_path)
    distinct = answers.where("sheet < 0").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    finish = _scores(dealer, train_texts, train_tokens, distinct)
    return (sheets[True].groupBy("sheet").cogroup(answers.where("sheet >= 0").groupBy("sheet"))
            .applyInArrow(finish, _SCORES))
