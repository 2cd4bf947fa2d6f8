"""Classifier data preparation and evaluation.

Metrics are single conditional aggregates over (truth, prediction) pairs --
one pass, partial aggregation, nothing collected.  Zero divisions give 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.session import work_dir

CLASS_NAMES = {0: "Fake", 1: "Real"}


def label_to_int(label) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == "Real", F.lit(1)).when(c == "Fake", F.lit(0)).cast("int")


def truth_join(pred: DataFrame, truth: DataFrame, key: str = "doc_id", truth_col: str = "quality",
               pred_col: str = "label") -> DataFrame:
    """Predictions joined to ground truth by key -> (key, y, p) with 1 = Real."""
    p = pred.select(key, label_to_int(pred_col).alias("p"))
    t = truth.select(key, F.col(truth_col).cast("int").alias("y"))
    return p.join(t, key).where(F.col("y").isNotNull() & F.col("p").isNotNull()).select(key, "y", "p")


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _cells(yp: DataFrame) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return yp.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count(F.lit(1)).alias("n"))


def accuracy_f1(yp: DataFrame) -> DataFrame:
    """Accuracy and binary F1 (positive = Real = 1)."""
    c = _cells(yp)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select("tp", "fp", "fn", "tn", "n", _div(tp + tn, n).alias("accuracy"),
                    _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(yp: DataFrame) -> DataFrame:
    """2x2 confusion matrix (rows truth, columns prediction), all four cells."""
    c = _cells(yp)
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("y"), F.lit(0).alias("p"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("y"), F.lit(1).alias("p"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("y"), F.lit(0).alias("p"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("y"), F.lit(1).alias("p"), F.col("tp").alias("n")))).alias("c")
    ).select("c.*")


def report(yp: DataFrame) -> DataFrame:
    """A10: per-class precision / recall / f1 / support, accuracy, macro and
    support-weighted averages (zero division -> 0)."""
    c = _cells(yp)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))

    def cls(name, t_p, f_p, f_n, support):
        prec, rec = _div(t_p, t_p + f_p), _div(t_p, t_p + f_n)
        f1 = _div(2 * t_p, 2 * t_p + f_p + f_n)
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1"), support.cast("long").alias("support"))

    fake = cls("Fake", tn, fn, fp, tn + fp)
    real = cls("Real", tp, fp, fn, tp + fn)
    base = c.select(fake.alias("fk"), real.alias("rl"), "n", _div(tp + tn, n).alias("acc"))

    def avg(name, wf, wr, total):
        return F.struct(
            F.lit(name).alias("class"),
            _div(F.col("fk.precision") * wf + F.col("rl.precision") * wr, total).alias("precision"),
            _div(F.col("fk.recall") * wf + F.col("rl.recall") * wr, total).alias("recall"),
            _div(F.col("fk.f1") * wf + F.col("rl.f1") * wr, total).alias("f1"),
            F.col("n").cast("long").alias("support"))

    acc = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                   F.col("n").cast("long").alias("support"))
    rows = F.array(F.col("fk"), F.col("rl"), acc,
                   avg("macro avg", F.lit(1.0), F.lit(1.0), F.lit(2.0)),
                   avg("weighted avg", F.col("fk.support"), F.col("rl.support"), F.col("n")))
    return base.select(F.explode(rows).alias("r")).select("r.*")


def gate(yp: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy on a labelled sample must reach the threshold."""
    a = accuracy_f1(yp)
    return a.select("n", "accuracy", (F.col("accuracy") >= threshold).alias("passed"))


def balance(corpus: DataFrame) -> DataFrame:
    """N, pos (label 1), neg (label 0)."""
    return corpus.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"),
                      F.count_if(F.col("label") == 0).alias("neg"))


def fingerprint_col(n: Column, neg: Column, pos: Column) -> Column:
    """sha1 of ``{"n": N, "neg": X, "pos": Y}`` (sorted keys), first 8 hex."""
    text = F.format_string('{"n": %d, "neg": %d, "pos": %d}', n, neg, pos)
    return F.substring(F.sha1(text), 1, 8)


def fingerprint(corpus: DataFrame) -> DataFrame:
    b = balance(corpus)
    return b.select(fingerprint_col(F.col("n"), F.col("neg"), F.col("pos")).alias("hash8"))


SPLIT_BUCKETS_LOG2 = 20
COPIES_A_PIECE = 100_000  # equal rows that one row of the split's last step stands for


def split_hash(text="text", seed: int = 42) -> Column:
    """A row's place in the split order: 48 bits of md5(text|seed)."""
    t = F.col(text) if isinstance(text, str) else text
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(t, F.lit("")), F.lit(f"|{seed}"))), 1, 12), 16, 10)
    return h.cast("long")


def _cut(counts: DataFrame, order: list[str], wanted) -> DataFrame:
    """Of groups with ``n`` rows in ``order`` within each label: the one that holds the
    ``wanted``-th row, and how many of its rows are wanted (``need``)."""
    by_label = Window.partitionBy("label")
    placed = counts.withColumn("upto", F.sum("n").over(by_label.orderBy(*order))).withColumn("wanted", wanted)
    return (placed.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
            .withColumn("need", F.col("wanted") - F.col("upto") + F.col("n")))


def stratified_split(corpus: DataFrame, test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """M1: ``part`` = test for exactly ``ceil(test_fraction * n)`` rows of every
    label, the first in hash order; independent of partitioning.

    No rows are ranked.  Counts per label and hash bucket (at most 2**20) give the
    bucket the cut falls into; inside it, counts per text and hash of the other
    columns (a text that repeats without end is 2**20 groups at most) give the group;
    its rows are equal, but for chance, so they are counted, and each distinct row is
    written out as often as it was there, in pieces dealt over the cluster.

    The corpus is computed once, into a scratch table with the hashes: the counts read
    these alone, and only the parts read the texts.
    """
    spark, others = corpus.sparkSession, [c for c in corpus.columns if c not in ("label", "text")]
    variant = F.pmod(F.xxhash64(*others), F.lit(1 << SPLIT_BUCKETS_LOG2)) if others else F.lit(0).cast("long")
    hashed = corpus.select("*", split_hash("text", seed).alias("_h"), F.xxhash64("text").alias("_x"), variant.alias("_v"))
    staged = work_dir(spark, "split")
    hashed.write.parquet(staged)
    rows = spark.read.schema(hashed.schema).parquet(staged)
    rows = rows.withColumn("_bucket", F.shiftright("_h", 48 - SPLIT_BUCKETS_LOG2))
    share = F.ceil(F.lit(test_fraction) * F.sum("n").over(Window.partitionBy("label")))
    cut = (_cut(rows.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("n")), ["_bucket"], share)
           .select(F.col("label").alias("_label"), F.col("_bucket").alias("_cut"), F.col("need").alias("_need")))
    told = rows.join(F.broadcast(cut), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")  # one row per label
    told = told.withColumn("_at", F.when(F.col("_bucket") == F.col("_cut"), F.struct("_h", "_x", "_v")))
    group = (_cut(told.where("_at is not null").groupBy("label", "_at", "_need").agg(F.count(F.lit(1)).alias("n")), ["_at"], F.col("_need"))
             .select(F.col("label").alias("_label"), F.col("_at").alias("_last"), F.col("need").alias("_of_last")))
    told = told.join(F.broadcast(group), F.col("label").eqNullSafe(F.col("_label")), "left")
    last = F.coalesce(F.col("_at") == F.col("_last"), F.lit(False))
    first = F.when(F.col("_at").isNull(), F.col("_bucket") < F.col("_cut")).otherwise(F.col("_at") < F.col("_last"))
    side = lambda test: F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("part")

    equal = told.where(last).groupBy(*corpus.columns, "_of_last").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy(*corpus.columns)) - F.col("n")
    piece = F.col("_piece") * COPIES_A_PIECE
    pieces = (equal.withColumn("_test", F.col("_of_last") - before)
              .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_A_PIECE))))
              .withColumn("_copies", F.least(F.col("n") - piece, F.lit(COPIES_A_PIECE))).withColumn("_test", F.col("_test") - piece)
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_piece"))
    copies = pieces.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return (told.where(~last).select(*corpus.columns, side(first))
            .unionByName(copies.select(*corpus.columns, side(F.col("_copy") <= F.col("_test")))))


def split_counts(split: DataFrame) -> DataFrame:
    """Rows per label and part, and a checksum of which rows they are."""
    return split.groupBy("label", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(split_hash("text") % 1_000_003).alias("place_sum"))


def run_summary(corpus: DataFrame, yp: DataFrame, test_fraction: float = 0.1) -> DataFrame:
    """M4: n_train, n_eval, dataset fingerprint, accuracy, f1 -- one row.

    The sizes follow from the class counts (M1 takes ``ceil(fraction * n)`` rows
    of each class).  Corpus rows and (y, p) pairs go through one aggregate over
    their union, so no join of two one-row results.
    """
    none = F.lit(None).cast("int")
    rows = (corpus.select("label", none.alias("y"), none.alias("p"))
            .unionByName(yp.select(none.alias("label"), "y", "p")))
    y, p = F.col("y"), F.col("p")
    agg = rows.agg(
        F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn, neg, pos = (F.col(x) for x in ("tp", "fp", "fn", "tn", "neg", "pos"))
    n_eval = F.ceil(F.lit(test_fraction) * neg) + F.ceil(F.lit(test_fraction) * pos)
    return agg.select((neg + pos - n_eval).alias("n_train"), n_eval.alias("n_eval"),
                      fingerprint_col(neg + pos, neg, pos).alias("dataset_hash"),
                      _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                      _div(2 * tp, 2 * tp + fp + fn).alias("f1"))
