"""Article-shaped data derived from the driver tables (see FIXTURES.md).

Every derivation is a projection or a bounded grouping of ``documents``, so
its work grows with the table; nothing is invented or capped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.functions.ids import stable_id
from credlake.functions.times import to_iso
from credlake.sources.corpus import FNN_FILES, LIAR_FAKE, LIAR_REAL

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z
PUBLISH_STEP_S = 7 * 60
PAYLOAD_BLOCK = 20

LIAR_RULINGS = [*LIAR_FAKE, *LIAR_REAL, "unknown"]  # picked by doc_id % 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def articles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one article per document, typed timestamps, plus ``doc_id`` lineage."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    title = F.substring_index("text", "\n", 1)
    pub = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * PUBLISH_STEP_S)
    url = F.concat(F.lit("https://news.example/"), F.substring(F.md5(F.col("text")), 1, 16))
    return (
        d.select(
            "doc_id",
            F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("newsapi:")).otherwise(F.lit("gnews:")),
                     F.col("source")).alias("source"),
            title.alias("title"),
            F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("content"),
            url.alias("url"),
            pub.alias("published_at"),
        )
        .withColumn("fetched_at", F.col("published_at") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.col("doc_id") % 60, F.lit(0)))
        .withColumn("id", stable_id("url", "title"))
        .select("doc_id", "id", "source", "title", "content", "url", "published_at", "fetched_at")
    )


def articles_text(art: DataFrame) -> DataFrame:
    """Wire form of F1: timestamps as ISO ``+00:00`` text."""
    return art.withColumn("published_at", to_iso("published_at")) \
              .withColumn("fetched_at", to_iso("fetched_at"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, key, value, timestamp) raw-topic messages."""
    art = articles_text(articles_raw(spark, sf_dir))
    ts = F.to_timestamp(F.col("fetched_at"))
    fields = ["id", "source", "title", "content", "url", "published_at", "fetched_at"]
    value = (F.when(F.col("doc_id") % 97 == 0, F.lit("not json"))
             .when(F.col("doc_id") % 89 == 0, F.to_json(F.struct(*fields[1:])))
             .otherwise(F.to_json(F.struct(*fields))))
    return art.select("doc_id", F.col("source").alias("key"), value.alias("value"),
                      ts.alias("timestamp"))


FILE_BYTES = 32_000_000  # of text in a landed file: one Parquet row group, which one task reads in order


def write_envelopes(spark: SparkSession, sf_dir: str, path: str, parts: int = 4) -> str:
    """Land F2 as ``parts`` spans of time, one after the other (multi-batch input).

    Messages of one article lie in one file of a span, in order of time, so which copy
    of it arrives first is defined: the one with the least (timestamp, doc_id).
    """
    art_id = F.get_json_object("value", "$.id")
    return land_in_time_order(envelopes(spark, sf_dir), path, "timestamp", ["timestamp", "doc_id"], parts, art_id, drop=["doc_id"])


def land_in_time_order(df: DataFrame, path: str, time: str, order: list[str], parts: int, key: Column | str = "id", drop=()) -> str:
    """Write ``df`` to ``path/part=0 ..``, equal spans of time one after the other,
    so that a file stream takes them in that order.

    ``df`` is computed once.  Every span has the same number of files, as many as the
    largest needs (:func:`files_per_part`): a stream of so many files a trigger takes
    span by span.  Rows are dealt to a span's files by ``key`` and are in order there.
    """
    spark = df.sparkSession
    second = F.col("_second")
    timed = df.withColumn("_second", F.unix_timestamp(time))
    timed.write.mode("overwrite").parquet(f"{path}/staged")
    staged = spark.read.schema(timed.schema).parquet(f"{path}/staged")
    bounds = staged.agg(F.min(second).alias("lo"), F.max(second).alias("hi")).first()
    if bounds["lo"] is None:
        return path
    width = bounds["hi"] - bounds["lo"] + 1
    part = F.floor((second - bounds["lo"]) * parts / width).cast("int")
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in staged.dtypes if kind == "string"]
    sizes = staged.groupBy(part.alias("part")).agg(F.sum(sum(texts, F.lit(0)).cast("long")).alias("bytes"))
    files = -(-max(1, sizes.agg(F.max("bytes")).first()[0]) // FILE_BYTES)
    for k in range(parts):
        folder = f"{path}/part={k}"
        begins, ends = (bounds["lo"] + -(-at * width // parts) for at in (k, k + 1))
        own = staged.where((second >= begins) & (second < ends) & (part == k))  # by the bounds, row groups of other times are skipped
        span = own.repartition(files, key).sortWithinPartitions(*order).drop("_second", *drop)
        span.write.mode("overwrite").parquet(folder)
        for _ in range(files - files_per_part(spark, path, k)):  # hash partitions without a row wrote no file
            span.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return path


def files_per_part(spark: SparkSession, path: str, part: int = 0) -> int:
    """Files of a span that :func:`land_in_time_order` wrote."""
    from credlake.sources.lake import _glob

    return len(_glob(spark, f"{path}/part={part}/*.parquet"))


def articles_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 -> clean -> first copy per id -> default score -> scored_at."""
    from credlake.operators.clean import clean
    from credlake.operators.score import score_default

    art = articles_raw(spark, sf_dir)
    silver = clean(art, order_by=("fetched_at", "doc_id"))
    scored = score_default(silver, scored_at=F.col("fetched_at") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(5) + F.col("doc_id") % 26))
    return scored.select("doc_id", "id", "source", "title", "content", "url", "published_at",
                         "fetched_at", "date", "label", "confidence", "scored_at")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """later scored records for existing and new ids (null = keep old)."""
    return updates_of(articles_scored(spark, sf_dir))


def updates_of(sc: DataFrame) -> DataFrame:
    """F4 from the rows of F3, which are read once: each brings the updates of its doc_id."""
    flip = F.when(F.col("label") == "Fake", F.lit("Real")).otherwise(F.lit("Fake"))
    day = F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    same = {c: F.col(c) for c in sc.columns}

    def record(here: Column, **changed: Column) -> Column:
        return F.when(here, F.struct(*[v.alias(c) for c, v in (same | changed).items()]))

    first = record(F.col("doc_id") % 5 == 0, content=F.lit(None).cast("string"), label=flip,
                   confidence=F.round(F.lit(1.49) - F.col("confidence"), 4), scored_at=F.col("scored_at") + day)
    second = record(F.col("doc_id") % 15 == 0, title=F.concat(F.col("title"), F.lit(" (updated)")), content=F.lit(None).cast("string"),
                    confidence=F.lit(None).cast("double"), scored_at=F.col("scored_at") + day * 2)
    fresh = record(F.col("doc_id") % 100 == 3, id=F.substring(F.sha1(F.concat(F.lit("new:"), F.col("id"))), 1, 24),
                   scored_at=F.col("scored_at") + day * 3)
    records = sc.select(F.explode(F.array(first, second, fresh)).alias("r")).where(F.col("r").isNotNull())
    return records.select(*[F.col(f"r.{c}").alias(c) for c in sc.columns])


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one provider JSON payload per block of 20 documents.

    Columns: block, fetched_at (timestamp), payload (JSON text).
    """
    art = articles_text(articles_raw(spark, sf_dir))
    a = art.withColumn("name", F.expr("substr(source, instr(source, ':') + 1)"))
    item = F.struct(
        # to_json omits null fields: name is absent from the JSON when doc_id % 41 = 0
        F.struct(F.when(F.col("doc_id") % 41 != 0, F.col("name")).alias("name")).alias("source"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" Writer "), (F.col("doc_id") % 11).cast("string"), F.lit(" ")))
         .alias("author"),
        F.when(F.col("doc_id") % 53 == 0, F.lit("[Removed]")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("content")).alias("description"),
        F.col("content").alias("content"),
        F.when(F.col("doc_id") % 59 == 0, F.lit(None).cast("string")).otherwise(F.col("url")).alias("url"),
        F.col("published_at").alias("publishedAt"),
    )
    block = F.floor(F.col("doc_id") / PAYLOAD_BLOCK).cast("long")
    grouped = (a.select(block.alias("block"), F.col("doc_id"), item.alias("item"))
               .groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("doc_id", "item"))).alias("items")))
    status = F.when(F.col("block") % 13 == 0, F.lit("error")).otherwise(F.lit("ok"))
    return grouped.select(
        "block",
        F.timestamp_seconds(F.lit(EPOCH_2024) + (F.col("block") * PAYLOAD_BLOCK + 30)
                            * PUBLISH_STEP_S).alias("fetched_at"),
        F.to_json(F.struct(status.alias("status"),
                           F.transform("items", lambda x: x["item"]).alias("articles"))).alias("payload"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two-class logits from all embedding components: the sums of the
    even and of the odd places."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))

    def total(odd: int):
        kept = F.filter("x", lambda v, i: i % 2 == odd)
        return F.when(F.col("x").isNotNull(), F.aggregate(kept, F.lit(0.0), lambda a, v: a + v))
    return e.select("vec_id", F.array(total(0), total(1)).alias("logits"))


ID2LABEL = {0: "FAKE", 1: "REAL"}
RAW_LABELS = ["FAKE", "fake", "0", "1", "LABEL_0", "real", "Fake News"]


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model label strings, one per document: picked by a hash of its whole text,
    every eighth followed by the text's first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5("text").alias("h"))

    def byte(at: int) -> F.Column:
        return F.conv(F.substring("h", at, 2), 16, 10).cast("int")
    picked = F.element_at(F.array(*[F.lit(x) for x in RAW_LABELS]), byte(1) % len(RAW_LABELS) + 1)
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select("doc_id", F.when(byte(3) % 8 == 0, F.concat_ws(" ", picked, line)).otherwise(picked).alias("raw"))


def write_corpus(spark: SparkSession, sf_dir: str, path: str) -> str:
    """LIAR TSVs and four FakeNewsNet CSVs built from F1 titles/contents."""
    art = articles_raw(spark, sf_dir)
    clean_title = F.regexp_replace(F.col("title"), "[\t\"]", "")
    ruling = F.element_at(F.array(*[F.lit(x) for x in LIAR_RULINGS]),
                          (F.col("doc_id") % len(LIAR_RULINGS) + 1).cast("int"))
    split = (F.when(F.col("doc_id") % 10 == 0, "test")
             .when(F.col("doc_id") % 10 == 1, "valid").otherwise("train"))
    pad = [F.lit(x).alias(f"c{i}") for i, x in
           enumerate(["none", "none", "none", "0", "0", "0", "0", "0", "news"], start=5)]
    liar = art.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("c0"),
                      ruling.alias("c1"), clean_title.alias("c2"), F.lit("news").alias("c3"),
                      F.col("source").alias("c4"), *pad, split.alias("split"))
    for part in ("train", "valid", "test"):
        (liar.where(F.col("split") == part).drop("split").write.mode("overwrite")
         .option("sep", "\t").option("header", "false")
         .csv(f"{path}/liar/{part}.tsv"))
    body = F.regexp_replace(F.col("content"), "[\r\n\"]+", " ")
    for i, name in enumerate(FNN_FILES):  # picked by doc_id % 4
        cols = ("Title", "Content") if i == 3 else ("title", "text")
        (art.where(F.col("doc_id") % 4 == i)
         .select(clean_title.alias(cols[0]), body.alias(cols[1]), F.col("doc_id").alias("news_id"))
         .write.mode("overwrite").option("header", "true").option("escape", "\"")
         .csv(f"{path}/fnn/{name}"))
    return path


FNN_HEADER = "news_id,title,text"


def write_marred_corpus(spark: SparkSession, sf_dir: str, path: str) -> str:
    """F8: the training files with lines as they come in the wild, one per article and corpus.

    By doc_id: % 17 = 3 quotes its title with a separator and doubled quotes inside,
    % 19 = 1 has no title and no body, % 11 = 5 has two fields too many, % 13 = 7 ends after the title.
    """
    doc = F.col("doc_id")
    art = articles_raw(spark, sf_dir)
    title = F.when(doc % 19 != 1, F.regexp_replace("title", '[\t\r",]', ""))
    body = F.when(doc % 19 != 1, F.regexp_replace("content", '[\r\n",]+', " "))

    def line(sep: str, *fields):
        quoted = F.concat(F.lit('"'), title, F.lit(f'{sep}said ""so"""'))
        shown = F.coalesce(F.when(doc % 17 == 3, quoted), title, F.lit(""))
        rest = F.when(doc % 13 == 7, F.lit("")).otherwise(F.concat_ws(sep, F.lit(""), *fields[1:]))
        more = F.when(doc % 11 == 5, F.lit(f"{sep}x{sep}y")).otherwise(F.lit(""))
        return F.concat(fields[0], F.lit(sep), shown, rest, more).alias("line")

    ruling = F.element_at(F.array(*[F.lit(x) for x in LIAR_RULINGS]), (doc % len(LIAR_RULINGS) + 1).cast("int"))
    head = F.concat(doc.cast("string"), F.lit(".json\t"), ruling)
    liar = line("\t", head, F.lit("news"), F.col("source"), *[F.lit(x) for x in ["none"] * 3 + ["0"] * 5 + ["news"]])
    for name, part in {"train": doc % 10 > 1, "valid": doc % 10 == 1, "test": doc % 10 == 0}.items():
        art.where(part).select(liar).write.mode("overwrite").text(f"{path}/liar/{name}.tsv")
    fnn = line(",", doc.cast("string"), F.coalesce(body, F.lit("")))
    for i, name in enumerate(FNN_FILES):  # picked by doc_id % 4; lines are written as they are under the header
        (art.where(doc % 4 == i).select(fnn.alias(FNN_HEADER)).write.mode("overwrite").option("header", "true")
         .option("sep", "\u0001").option("quote", "\u0000").csv(f"{path}/fnn/{name}"))
    return path


def scored_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 variant for the sink guard: scored JSON with broken rows mixed in."""
    from credlake.schemas import GOLD_COLUMNS

    sc = articles_scored(spark, sf_dir)
    value = (F.when(F.col("doc_id") % 97 == 0, F.lit("not json"))
             .when(F.col("doc_id") % 89 == 0, F.to_json(F.struct(*GOLD_COLUMNS[1:])))
             .when(F.col("doc_id") % 83 == 0, F.lit('["a"]'))
             .when(F.col("doc_id") % 79 == 0, F.lit('{"id":null}'))
             .when(F.col("doc_id") % 73 == 0, F.lit('{"ID":"z"}'))
             .otherwise(F.to_json(F.struct(*GOLD_COLUMNS))))
    return sc.select("doc_id", F.col("id").alias("key"), value.alias("value"))
