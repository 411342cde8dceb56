"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage reads what its predecessor kept, as a table, and its decisions take effect. All but the last return the
columns of documents; the last adds size, text_crc32, law, shard, slot and grown_shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm.decontamination import decontaminate
from lumiframe.llm.langid import detect_language
from lumiframe.llm.linking import exclude
from lumiframe.llm.mixing import mix_sources
from lumiframe.llm.ngram_join import ngram_jaccard_components
from lumiframe.llm.queries import WEIGHTS, domain, table
from lumiframe.llm.sharding import shard_documents
from lumiframe.llm.storage import Scratch

#: No SQL form: the language models, the fingerprints and the seeded orders have none. tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that no language model accepts."""
    return detect_language(docs).filter(~F.col("rejected")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: that of the least id. Rows of one id are one document, of which the
    row with the least content stays (the columns in order); rows without an id stay."""
    scratch = Scratch(spark, "pipeline-join")
    with Scratch(spark, "pipeline-join-steps") as steps:
        found = scratch.save(ngram_jaccard_components(docs, scratch=steps), "found")
    dropped = scratch.save(found.filter("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    kept = exclude(docs, dropped, "doc_id")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not twice.isEmpty():
        again = kept.join(twice, "doc_id", "left_semi")
        first = again.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("first"))
        kept = exclude(kept, twice, "doc_id").unionByName(first.select("first.*"))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps nine tenths of the tokens, dealt by the weights of the tree; no document is taken twice."""
    return mix_sources(docs, domain(), WEIGHTS, fraction=0.9, max_epochs=1, seed=42).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to 40 shards of equal bytes."""
    return shard_documents(docs, shards=40)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", ngram_join), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's table is written and read again as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, before, sf_dir), name)
        scratch.drop(before)
        before = docs
    return docs
