"""One query per training-data operator, over the whole table it is meant for."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.llm import (bloom_sketch, decontaminate, jaccard_join, language, licences, ngram_trie, packing, page_diff, prefix_trie, sharding, sql,
                          surrogates, token_alignment, token_rollup)
from credlake.llm.common import saved, table
from credlake.session import work_dir

N_SHARDS = 40
SURROGATE_KEY = "surrogates-of-this-corpus"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return surrogates.replace_pii(docs, SURROGATE_KEY)


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_diff.main_text(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by five-word shingles at a Jaccard of 0.75 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: every document counted, recounted without its
    repeated lines, short documents deleted, and the second batch replayed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    docs = docs.withColumn("kept", once)

    def state(text: str):
        return F.array(*(F.struct(F.lit(name).alias("tokenizer"), token_rollup.count_tokens(F.col(text), name).alias("tokens"),
                                  F.octet_length(text).cast("long").alias("bytes")) for name in token_rollup.TOKENIZERS))

    counted = saved(docs.select("source", "lang", (F.col("text") != F.col("kept")).alias("changed"),
                                F.explode(F.arrays_zip(state("text").alias("a"), state("kept").alias("b"))).alias("z"),
                                (token_rollup.count_tokens(F.col("kept"), "words_v1") < sql.MIN_WORDS).alias("short"))
                    .select("source", "lang", "changed", "short", F.col("z.a.tokenizer").alias("tokenizer"),
                            *(F.col(f"z.a.{m}").alias(f"first_{m}") for m in ("tokens", "bytes")),
                            *(F.col(f"z.b.{m}").alias(f"kept_{m}") for m in ("tokens", "bytes"))), "counts")

    def rows(op: str, old: str | None = None, new: str | None = None) -> DataFrame:
        cols = [F.lit(op).alias("op")]
        for prefix, version in (("old_", old), ("", new)):
            cols += [F.col(k).alias(prefix + k) for k in token_rollup.KEYS]
            cols += [(F.col(f"{version}_{m}") if version else F.lit(0)).alias(prefix + m) for m in ("tokens", "bytes")]
        return counted.select("changed", "short", *cols)

    root = work_dir(spark, "token-rollup")
    revised = rows("revise", "first", "kept").filter("changed")
    token_rollup.commit(rows("insert", new="first"), root, "1")
    token_rollup.commit(revised, root, "2")
    token_rollup.commit(rows("delete", old="kept").filter("short"), root, "3")
    token_rollup.commit(revised, root, "2")  # a replay changes nothing
    return token_rollup.totals(spark, root)


def op5_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address and host."""
    model = language.train(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"))
    pages = language.page_evidence(table(spark, sf_dir, "pages"))
    return (language.identify(pages.withColumn("row_id", F.col("page_id").cast("long")), model)
            .withColumnRenamed("row_id", "page_id"))


def op7_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and its edited text, and their likenesses."""
    return bloom_sketch.fingerprints(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` packed to 2048 tokens of the public byte-level BPE."""
    import public_tokenizers

    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.drop("ids")


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed to sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards of the bounded-load ring; counts differ by one at most."""
    out = sharding.bounded_ring(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op10_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, known licence and known notices of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a bigram trie of the documents not held out."""
    return ngram_trie.score(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations with its subtree's totals."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens by a byte-level BPE and a piece model."""
    import public_tokenizers

    return token_alignment.alignment(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_page_differencing": op2_page_differencing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_rollup": op4_token_rollup,
    "op5_prefix_decontamination": op5_prefix_decontamination,
    "op6_language_fusion": op6_language_fusion,
    "op7_bloom_fingerprints": op7_bloom_fingerprints,
    "op8_histogram_packing": op8_histogram_packing,
    "op9_ring_shards": op9_ring_shards,
    "op10_licence_digests": op10_licence_digests,
    "op11_ngram_trie": op11_ngram_trie,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLES.items() if name in QUERIES}
