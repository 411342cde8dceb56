"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(id_col: str, n: int, k: int) -> Column:
    """Whether crc32 of a row's id as text is k modulo n; a row without an id is held out, too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n == k, F.lit(True))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=40, carry=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that has a line; null and empty texts, and those of blank lines only, have nothing to drop
    and no row."""
    from lumiframe.llm.line_dedup import line_components

    lines = line_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    dropped = F.sort_array(F.collect_set(F.when(~F.col("keep"), F.col("line"))))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("keep").alias("n_kept"), dropped.alias("dropped_lines"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.langid import detect_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", in_fold("doc_id", 5, 0))
    return detect_language(docs, train=~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", in_fold("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return score_toxicity(docs, labels, train=~F.col("held_out")).select("doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.warc import build_derivatives, responses_of_pages

    records = build_derivatives(responses_of_pages(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))
    return records.select(F.col("source_id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "headers", "block")


def domain() -> Column:
    """The domain of a source."""
    source = F.col("source")
    return F.when(source.rlike("^src[0-4]$"), "web").when(source.rlike("^src[5-9]$"), "forum").when(source.isNotNull(), "reference")


#: Weights of the tree's nodes among their siblings; a node that isn't named weighs 1.
WEIGHTS = [{"web": 2.0, "forum": 1.0, "reference": 3.0}, {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, {"src0": 2.0, "src9": 3.0}]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix_sources(docs, domain(), WEIGHTS, fraction=0.8, max_epochs=3, seed=42)
    return out.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.lm_score import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", in_fold("doc_id", 10, 0))
    return score_texts(docs, train=~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumiframe.llm.decontamination import benchmark_hits

    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
