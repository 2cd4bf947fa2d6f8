"""Operator 7 [native]: document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs -- its lines, long ones cut every ``PARAGRAPH_WORDS`` words
-- are hashed to digests, and each digest is XORed into one cell of each of the
three parts of a small table.  The table is the fingerprint.  Two versions'
tables subtract cell by cell, which leaves only what differs; a cell that holds
a single digest is recognised by the digest's own checksum and place, and
peeling such digests out of the other cells recovers the difference.  Where
peeling gets stuck the pair is sketched again larger: its digests are dealt by
a fresh hash to several tables with fresh cells, and those that still fail again.
What is stuck after ``LEVELS`` enlargements (equal cells on every level) is
compared as sets.

Likeness is the Jaccard coefficient of the paragraph sets, from their sizes
and the size of the recovered difference.

The neighbour of a row (the next lower doc_id, round to the highest) comes from
buckets of ``1 << BUCKET_BITS`` consecutive ids: each bucket also gets the head of
the next one, so texts are shuffled once.  Where ids repeat (null counts as one
id) or lie far apart, buckets are made of consecutive places in the order by id
and text instead, so no id fills a bucket.  Neither way orders the table in one task.

Edge cases: null text counts as empty; an empty text has an empty set, like
every other empty set (likeness 1) and unlike any other (0); equal texts have
equal fingerprints; rows that share a doc_id are ordered by text, repeated rows
follow each other; a null doc_id comes after all others; a single row is its
own neighbour; other columns are not read; an empty table gives no rows; very
long texts are sketched whole, and their differences in tables of bounded size.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.llm.common import BROADCAST_IDS, ordered_index, saved

PARAGRAPH_WORDS = 24
CELLS = 48                # of one table; a third of them in each part
ROUNDS = 10               # peeling rounds before a table counts as stuck
BUCKET_BITS = 11
DEAL_BITS = 6             # a larger sketch has up to 64 tables, then 64 times as many
LEVELS = 6                # enlargements before what is left is compared as sets
LEAST_IN_BUCKET = 64      # rows of a bucket of ids on average, else places are used
PARAGRAPH = f"(?:\\S++[^\\S\\n]*+){{1,{PARAGRAPH_WORDS}}}+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _checksum(top: Column) -> Column:
    return F.xxhash64(top).bitwiseAND(F.lit(0xFFFF))


def digests(text: Column) -> Column:
    """Distinct 64-bit paragraph digests: 48 hash bits, then their checksum."""
    def digest(p: Column) -> Column:
        return bound(F.shiftright(F.xxhash64(F.rtrim(p)), 16), lambda top: F.shiftleft(top, 16).bitwiseOR(_checksum(top)))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), digest))


def _places(digest: Column, seed: str) -> Column:
    """The digest with its cell in each of the three parts."""
    part = CELLS // 3
    return bound(F.xxhash64(F.shiftright(digest, 16), F.lit(seed)), lambda h: F.struct(
        digest.alias("d"), *((F.pmod(F.shiftright(h, 20 * j).bitwiseAND(F.lit(0xFFFFF)), F.lit(part)).cast("int") + j * part).alias(f"p{j}")
                             for j in range(3))))


def _toggled(cells: Column, of: Column, seed: str) -> Column:
    """``cells`` with the digests of an array XORed in (or out)."""
    return F.aggregate(F.transform(of, lambda d: _places(d, seed)), cells, lambda acc, e: F.transform(acc, lambda c, i: F.when(
        (i == e["p0"]) | (i == e["p1"]) | (i == e["p2"]), c.bitwiseXOR(e["d"])).otherwise(c)))


def sketch(of: Column, seed: str = "cell") -> Column:
    """The table of a set of digests."""
    return _toggled(F.array_repeat(F.lit(0).cast("long"), CELLS), of, seed)


def _single(cells: Column, seed: str) -> Column:
    """Distinct digests that stand alone in a cell."""
    def alone(c: Column, i: Column) -> Column:
        place = bound(_places(c, seed), lambda e: (i == e["p0"]) | (i == e["p1"]) | (i == e["p2"]))
        return F.when((c != 0) & (c.bitwiseAND(F.lit(0xFFFF)) == _checksum(F.shiftright(c, 16))), F.when(place, c))
    return F.array_distinct(F.filter(F.transform(cells, alone), lambda c: c.isNotNull()))


def peel(a: Column, b: Column, seed: str = "cell") -> Column:
    """The digests in which two tables differ, or null where peeling gets stuck."""
    def state(cells: Column, found: Column) -> Column:
        return bound(cells, lambda c: F.struct(c.alias("cells"), _single(c, seed).alias("single"), found.alias("found")))

    none = F.array().cast("array<long>")
    start = state(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), none)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(F.size(s["single"]) == 0, s).otherwise(
        state(_toggled(s["cells"], s["single"], seed), F.concat(s["found"], s["single"]))))
    return bound(done, lambda s: F.when(F.forall(s["cells"], lambda c: c == 0), s["found"]))


def fingerprint(n: Column, cells: Column) -> Column:
    """Set size and table as text."""
    whole = F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c), 16, "0")), "")
    return F.concat(n.cast("string"), F.lit(":"), F.base64(F.unhex(whole)))


def likeness(n_a: Column, n_b: Column, n_different: Column) -> Column:
    """Jaccard coefficient from two set sizes and the size of their difference."""
    return F.when(n_a + n_b == 0, 1.0).otherwise((n_a + n_b - n_different) / (n_a + n_b + n_different))


def _enlarged(stuck: DataFrame, level: int) -> DataFrame:
    """Each pair's digests dealt to 4 to 64 tables by a hash of this level."""
    size = F.size("a") + F.size("b")
    tables = reduce(lambda rest, n: F.when(size <= 16 * n, n).otherwise(rest), (32, 16, 8, 4), F.lit(1 << DEAL_BITS))

    def table(d: Column) -> Column:
        return F.pmod(F.xxhash64(d, F.lit(f"deal {level}")), F.col("tables")).cast("int")

    dealt = stuck.withColumn("tables", tables)
    parts = F.transform(F.sequence(F.lit(0), F.col("tables") - 1), lambda g: F.struct(
        F.filter("a", lambda d: table(d) == g).alias("a"), F.filter("b", lambda d: table(d) == g).alias("b")))
    return dealt.select("row_id", "kind", F.explode(parts).alias("p")).select("row_id", "kind", "p.a", "p.b")


def recovered(stuck: DataFrame, name: str) -> DataFrame:
    """(row_id, kind, n): size of the difference of pairs (row_id, kind, a, b) of
    digest sets, by sketches enlarged until each peels."""
    solved = []
    for level in range(LEVELS):
        seed = f"cell {level}"
        tried = _enlarged(stuck, level).withColumn("found", peel(sketch(F.col("a"), seed), sketch(F.col("b"), seed), seed))
        ok = F.col("found").isNotNull()
        tried = saved(tried.select("row_id", "kind", F.when(ok, F.size("found")).alias("n"), F.when(~ok, F.col("a")).alias("a"),
                                   F.when(~ok, F.col("b")).alias("b")), f"{name}-{level}")
        solved.append(tried.filter("n is not null").select("row_id", "kind", "n"))
        stuck = tried.filter("n is null").select("row_id", "kind", "a", "b")
        if stuck.isEmpty():
            break
    else:
        solved.append(stuck.select("row_id", "kind", (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).alias("n")))
    return reduce(DataFrame.union, solved).groupBy("row_id", "kind").agg(F.sum("n").alias("n"))


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in buckets, in order of ``place`` within each,
    and as ``tail`` the head of the bucket that comes next."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    keyed = keyed.withColumn("place", F.bitwise_not("at")).withColumn("bucket", F.shiftright("place", BUCKET_BITS))
    heads = saved(keyed.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("bucket").agg(F.min("place").alias("place"), F.sum("n").alias("n"), F.max("n").alias("most")), "bucket-heads")
    buckets, rows, most = heads.agg(F.count(F.lit(1)), F.sum("n"), F.max("most")).first()
    if buckets and (most > 1 or buckets * LEAST_IN_BUCKET > rows):
        keyed = ordered_index(keyed.select("doc_id", "text", "place"), [F.col("place"), F.col("text")], "document-order", "k")
        keyed = keyed.select("doc_id", "text", F.col("k").alias("place"), F.shiftright("k", BUCKET_BITS).alias("bucket"))
        last = (rows - 1) >> BUCKET_BITS
        tails = (keyed.where(F.col("place") % (1 << BUCKET_BITS) == 0)
                 .withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(last + 1))))
        return keyed.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    order = ordered_index(heads.select("bucket", "place"), [F.col("bucket")], "bucket-order", "k")
    before = order.select(F.pmod(F.col("k") + 1, F.lit(max(buckets, 1))).alias("k"), F.col("bucket").alias("into"))
    next_of = saved(order.join(before, "k").select("place", "into"), "bucket-next")
    if buckets <= BROADCAST_IDS:
        next_of = F.broadcast(next_of)
    tails = keyed.join(next_of, "place").select("doc_id", "text", "place", F.col("into").alias("bucket"), F.lit(1).alias("tail"))
    return keyed.select("doc_id", "text", "place", "bucket", F.lit(0).alias("tail")).union(tails)


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the neighbour's first as many."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs`` and of its edited text, and likenesses."""
    own = (_with_neighbours(docs).repartition("bucket")
           .withColumn("own", digests(F.col("text"))).withColumn("cells", sketch(F.col("own"))))
    order = Window.partitionBy("bucket").orderBy("tail", "place")
    beside = (own.withColumn("next_text", F.lead("text").over(order)).withColumn("next", F.lead("own").over(order))
              .withColumn("next_cells", F.lead("cells").over(order)).filter("tail = 0")
              .withColumn("edited_text", edited(F.col("text"), F.col("next_text"))))
    read = beside.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
                         "own", "cells", "next", "next_cells", digests(F.col("edited_text")).alias("edited"))
    both = read.withColumn("edited_cells", sketch(F.col("edited")))
    tried = (both.withColumn("by_edited", F.size(peel(F.col("cells"), F.col("edited_cells"))))
             .withColumn("by_next", F.size(peel(F.col("cells"), F.col("next_cells")))))
    stuck = {k: F.coalesce(F.col(f"by_{k}"), F.lit(-1)) < 0 for k in ("edited", "next")}
    base = saved(tried.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_chars", "edited_sha256", "cells", "edited_cells",
        *(F.size(k).alias(f"n_{k}") for k in ("own", "edited", "next")),
        *(F.when(~s, F.col(f"by_{k}")).alias(f"by_{k}") for k, s in stuck.items()),
        F.when(stuck["edited"] | stuck["next"], F.col("own")).alias("own"),
        *(F.when(s, F.col(k)).alias(k) for k, s in stuck.items())), "sketches")
    pairs = base.select("row_id", F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("own").alias("a"), F.col(k).alias("b"))
                                                               for k in stuck)), lambda p: p["b"].isNotNull())).alias("p"))
    larger = recovered(pairs.select("row_id", "p.kind", "p.a", "p.b"), "larger")
    found = larger.groupBy("row_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"larger_{k}") for k in stuck))
    return (base.drop("own", "edited", "next").join(found, "row_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("n_own"), F.col("cells")).alias("fingerprint"),
        fingerprint(F.col("n_edited"), F.col("edited_cells")).alias("edited_fingerprint"),
        *(likeness(F.col("n_own"), F.col(f"n_{k}"), F.coalesce(f"by_{k}", f"larger_{k}")).alias(f"near_{k}") for k in stuck)))
