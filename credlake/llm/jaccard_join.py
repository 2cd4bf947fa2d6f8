"""Operator 3: n-gram Jaccard join as a T-occurrence search.

A document is the set of its distinct word shingles.  Two documents link when
``100 * |A & B| >= threshold * |A | B|``.  Equal sets are one class from the
start; the join runs on classes:

1. Classes are dealt to parts by their key, each task sending the first text it
   meets of a class, so a hot class is one row per task.  A part counts its
   classes by shingle and deals the counts to buckets of the hash space: a
   shingle in a third of all documents is one entry per part.  A bucket adds
   the counts up and answers each part with the frequencies of its shingles;
   no list of a shingle's classes is made.  Shingles of one class alone can be
   in no intersection and go no further.
2. A partner must share at least T = ceil(threshold * n) of a class's n
   shingles, so classes with fewer shared shingles have no link.
3. DivideSkip: of a class's inverted lists, taken from short to long, the last
   T - 1 (the long ones) are set aside; any partner occurs in one of the others.
   The short lists are merged by key in Spark; a pair that passes the length,
   count and position bounds is then probed against the long lists by binary
   search, with an early stop once T is out of reach.
4. Merging would emit all pairs of a list.  Instead every member of a list is
   first probed against one member, the one with the fewest shingles of its
   own; linked members form components; members outside a list's largest
   component are probed against a few of it; and at last all pairs of members
   in *different* components are probed.  Pairs left out join documents that
   are connected already, so components are exact.

Shingles are 64-bit hashes.  Hot lists are salted; sets travel once per probe.

Edge cases: null text, empty text and text without words have no shingles,
link with nothing and are their own component; with fewer words than the
shingle size the whole sequence is one shingle; repeated rows and equal texts
are one class; a null doc_id never becomes a component id unless it is alone;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import components, saved, spread_join
from credlake.llm.words import NON_SPACE, WordHasher, groups, mix, shingles, signed

BUCKET_SHINGLES = 1_500_000
PART_SHINGLES = 500_000   # of the classes that are counted together before the shuffle
LIST_WAYS = 4             # salts of a list in joins by token; AQE splits what is still skewed
SPEAKERS = 8              # members of a component that strangers are probed against first
_LOW = (1 << 48) - 1
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _document_sets(batches, size: int):
    """(rows of the group, list of sorted distinct shingle hashes per row)."""
    hasher = WordHasher(NON_SPACE)
    for part, data, offsets in groups(batches, "text"):
        hashes, _, first = hasher(data, offsets)
        grams = shingles(hashes, size)
        sets = []
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= size:
                sets.append(np.unique(grams[lo:hi - size + 1]))
            else:
                sets.append(shingles(hashes[lo:hi], int(hi - lo)) if hi > lo else hashes[:0])
        yield part, sets


def _key(tokens: np.ndarray) -> int:
    """64-bit identity of a set."""
    total = np.array([int(mix(tokens ^ _ODD).sum(dtype=np.uint64)) ^ len(tokens)], dtype=np.uint64)
    return int(signed(mix(total))[0])


def _classes(size: int):
    def run(batches):
        for part, sets in _document_sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_key(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "key"])
    return run


def _firsts(size: int, parts: int):
    """The first text of every class a task meets, and the part of the class."""
    def run(batches):
        seen = set()
        for group, sets in _document_sets(batches, size):
            rows, keys = [], []
            for row, found in enumerate(sets):
                if len(found) and (key := _key(found)) not in seen:
                    seen.add(key)
                    rows.append(row)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key % parts for key in keys], pa.int32()), pa.array(keys, pa.int64()),
                 group.column("text").take(pa.array(rows, pa.int64()))], ["part", "key", "text"])
    return run


def _part_sets(table: pa.Table, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and shingles of the classes of a part, each class once, by key."""
    keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
    batches = table.select(["text"]).take(pa.array(first)).to_batches()
    return keys, [found for _, sets in _document_sets(batches, size) for found in sets]


def _packed(numbers: np.ndarray) -> bytes:
    return numbers.astype(np.min_scalar_type(numbers.max())).tobytes()


def _unpacked(table: pa.Table, column: str) -> np.ndarray:
    """The packed numbers of all rows; column n has how many a row holds."""
    return np.concatenate([np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)
                           for raw, n in zip(table.column(column).to_pylist(), table.column("n").to_pylist())])


def _deal(size: int, buckets: int):
    """A part's distinct shingles dealt to buckets, with how many of its classes hold them."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        tokens, counts = np.unique(np.concatenate(_part_sets(table, size)[1]), return_counts=True)
        bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending
        out = [(bucket[lo], part, hi - lo, tokens[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), _packed(counts[lo:hi]))
               for lo, hi in zip(*_runs(bucket))]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["bucket", "part", "n", "tokens", "counts"])
    return run


def _read(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return begins, np.r_[begins[1:], len(sorted_values)]


def _shared(table: pa.Table) -> pa.Table:
    """How many classes hold each shingle of a bucket, to each part in its own order."""
    _, place = np.unique(_widened(_read(table, "tokens", np.uint8)), return_inverse=True)
    frequency = np.bincount(place, weights=_unpacked(table, "counts")).astype(np.int64)[place]
    ends = np.cumsum(table.column("n").to_numpy())
    packed = [_packed(frequency[lo:hi]) for lo, hi in zip(np.r_[0, ends[:-1]], ends)]
    return table.select(["bucket", "part", "n"]).append_column("frequency", pa.array(packed, pa.binary()))


def _widened(raw: np.ndarray) -> np.ndarray:
    """48-bit integers of six bytes each as 64-bit ones."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _candidates(size: int, num: int, den: int):
    """Of one part, the classes that share enough shingles: their shared
    shingles from rare to frequent, and the short part of their lists."""
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, sets = _part_sets(table, size)
        tokens = np.unique(np.concatenate(sets))
        frequency = _unpacked(answers.sort_by("bucket"), "frequency")  # buckets and shingles ascend together
        out = []
        for key, mine in zip(keys.tolist(), sets):
            n, needed = len(mine), -(-num * len(mine) // den)
            often = frequency[np.searchsorted(tokens, mine)]
            mine, often = mine[often > 1], often[often > 1]
            if len(mine) >= needed:
                mine = mine[np.lexsort((mine, often))]
                out.append((key, n, len(mine), mine.tobytes(), signed(mine[:len(mine) - needed + 1]).tolist()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                        ["key", "n", "shared", "tokens", "short"])
    return run


def overlap(rare_first: np.ndarray, other_sorted: np.ndarray, needed: int, step: int = 64) -> int:
    """Common tokens of two sets, or fewer than ``needed`` once that is certain.

    Probes ``other_sorted`` by binary search, rarest tokens first.
    """
    found, left = 0, len(rare_first)
    while left and found + left >= needed:
        part = rare_first[len(rare_first) - left:len(rare_first) - left + step]
        at = np.minimum(np.searchsorted(other_sorted, part), len(other_sorted) - 1)
        found += int((other_sorted[at] == part).sum())
        left -= len(part)
        step *= 2
    return found


def _probe(num: int, den: int):
    def run(batches):
        last, probed = None, None
        for batch in batches:
            linked = []
            columns = [batch.column(c) for c in ("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")]
            for _, b, n_a, n_b, x, y in zip(*(c.to_pylist() for c in columns)):
                if b != last:
                    last, probed = b, np.sort(np.frombuffer(y, np.uint64))
                needed = -(-num * (n_a + n_b) // (num + den))
                linked.append(overlap(np.frombuffer(x, np.uint64), probed, needed) >= needed)
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(linked, pa.bool_())], ["a", "b", "linked"])
    return run


def _possible(a: str, b: str, num: int, den: int, places: bool = True) -> Column:
    """Length and count bounds of two classes; of two entries of one list, the position bound."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = [F.col(f"{s}.shared") - (F.col(f"{s}.at") if places else 0) for s in (a, b)]
    return ((n_a * den >= n_b * num) & (n_b * den >= n_a * num)
            & (F.least(*rest) * (num + den) >= (n_a + n_b) * num))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """(a, b, linked) of every pair; ``b`` may be hot."""
    named = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    with_a = pairs.join(named("a"), "a")
    with_b = spread_join(with_a, pairs.select("b").distinct().join(named("b"), "b"), ["b"], ["a"])
    return saved(with_b.select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
                 .mapInArrow(_probe(num, den), "a long, b long, linked boolean"), name)


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists that hold several components: token, e, comp, and
    the list's largest component."""
    placed = saved(lists.select("token", "e", F.col("e.key").alias("node")).join(labels, "node", "left")
                   .select("token", "e", F.coalesce("label", "node").alias("comp")), "placed-lists")
    mains = (placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
             .groupBy("token").agg(F.max(F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
             .filter("comps > 1").select("token", F.col("main.comp").alias("main")))
    return spread_join(placed, mains, ["token"], ["e"], ways=LIST_WAYS)


def jaccard_components(docs: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row."""
    num, den = threshold, 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(texts.mapInArrow(_classes(size), "doc_id long, n_shingles long, key long"), "shingle-sets")
    classes = saved(rows.filter("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "shingle-classes")

    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets, parts = max(1, -(-total // BUCKET_SHINGLES)), max(1, -(-total // PART_SHINGLES))
    owned = texts.select("text").mapInArrow(_firsts(size, parts), "part int, key long, text string")
    dealt = owned.groupBy("part").applyInArrow(_deal(size, buckets), "bucket int, part int, n long, tokens binary, counts binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "bucket int, part int, n long, frequency binary")
    sets = saved(owned.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        _candidates(size, num, den), "key long, n long, shared long, tokens binary, short array<long>"), "candidate-sets")

    # every member of a list against the member with the fewest shingles of its own
    entry = F.struct((F.col("n") - F.col("shared")).alias("own"), "key", "n", "shared", "at")
    lists = sets.select("key", "n", "shared", F.posexplode("short").alias("at", "token")).select("token", entry.alias("e"))
    least = lists.groupBy("token").agg(F.min("e").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    lists = saved(spread_join(lists, least, ["token"], ["e"], ways=LIST_WAYS), "short-lists")
    stars = (lists.filter((F.col("e.key") != F.col("hub.key")) & _possible("e", "hub", num, den))
             .select(F.col("e.key").alias("a"), F.col("hub.key").alias("b")).distinct())
    tried = _verified(stars, sets, num, den, "star-pairs")
    links = tried.filter("linked").select("a", "b")

    # members of other components than their list's largest, against a few of the latter
    labels = components(links, "stars")
    own = (F.col("n") - F.col("shared")).alias("own")
    few = (sets.join(labels, F.col("key") == F.col("node"))
           .groupBy(F.col("label").alias("main"), F.pmod(F.xxhash64("key"), F.lit(SPEAKERS)).alias("seat"))
           .agg(F.min(F.struct(own, "key", "n", "shared")).alias("r")).drop("seat"))
    asking = _mixed(lists, labels).filter("comp <> main").select("e.key", "e.n", "e.shared", "main").distinct()
    asked = (spread_join(asking.select(F.struct("key", "n", "shared").alias("e"), "main", "key"), few, ["main"], ["key"])
             .filter(_possible("e", "r", num, den, places=False))
             .select(F.col("e.key").alias("a"), F.col("r.key").alias("b")).distinct()
             .join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    tried = tried.union(_verified(asked, sets, num, den, "speaker-pairs"))
    links = tried.filter("linked").select("a", "b")

    # all pairs that are still in different components
    mixed = _mixed(lists, components(links, "speakers"))
    others = mixed.filter("comp <> main").select("token", F.col("e").alias("o"), F.col("comp").alias("o_comp"))
    known = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = (spread_join(mixed, others, ["token"], ["e"], ways=LIST_WAYS)
            .filter((F.col("comp") != F.col("o_comp")) & _possible("e", "o", num, den))
            .select(F.greatest("e.key", "o.key").alias("a"), F.least("e.key", "o.key").alias("b")).distinct()
            .join(known, ["a", "b"], "left_anti"))
    more = _verified(rest, sets, num, den, "cross-pairs").filter("linked").select("a", "b")

    final = components(links.union(more), "links")
    members = classes.join(final, F.col("key") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("label", "key").alias("label"))
    least_of = members.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = spread_join(members, least_of, ["label"], ["key"]).select("key", "component_id")
    return (spread_join(rows.filter("n_shingles > 0"), named, ["key"], ["doc_id"])
            .select("doc_id", "n_shingles", "component_id")
            .union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
