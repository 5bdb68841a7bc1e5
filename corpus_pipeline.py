"""A corpus pipeline of the training-data operators over ``documents``.

Quality classifier, near-duplicates, repeated passages, benchmark passages, tokens: each stage
works on everything its predecessor kept. All stages but the last return the columns of their
input, whatever their names; the last returns doc_id, ids, n_pieces, n_bytes and lossless.

Null and empty texts are judged as empty texts and stay null or empty; a document that a cut leaves blank is dropped.
Rows that repeat a doc_id and a text count as one group of copies, of which one row stays, also without a doc_id;
rows without a doc_id lose no passages to others. An empty table gives empty tables. A label, benchmark or document table
may repeat rows or hold nulls.

No stage is expressible in SQL at its own semantics, so the pipeline is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_dup, quality_classifier, sentencepiece_sampling, suffix_dedup
from tessera.llm.common import ROW, drop_rows, fresh, pack, rewritten, row_key, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    keyed = docs.select(row_key().alias("key"), "doc_id", "text", "lang", "source")
    judged = quality_classifier.judge_documents(keyed, table(spark, sf_dir, "labels").select("doc_id", "quality"), keep=["key"])
    return drop_rows(docs, scratch(judged.where("NOT kept").select("key").distinct(), "rejected"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates, and one row of those that repeat it with its text."""
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    judged = near_dup.near_duplicates(keyed, width=5, percent=80, keep=["key"])
    dropped = scratch(judged.where("NOT kept").select("key").distinct(), "dropped")
    repeated = scratch(judged.where("kept").groupBy("key").count().where("count > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return drop_rows(docs, dropped)
    left = drop_rows(docs, dropped.unionByName(repeated))
    own = fresh("tessera_key", docs.columns)
    again = docs.select(row_key().alias(own), pack(docs.columns)).join(repeated.select(F.col("key").alias(own)), own, "left_semi")
    one = again.groupBy(own).agg(F.min_by(ROW, F.xxhash64(ROW)).alias(ROW))
    return left.unionByName(one.select(*[F.col(ROW).getField(n).alias(n) for n in docs.columns]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id has; those left blank by it are dropped."""
    packed = docs.select(pack(docs.columns), "doc_id", "text")
    done = suffix_dedup.remove_repeats(packed, keep=[ROW], whole_characters=True)
    changed = F.col("n_removed") > 0
    left = done.withColumn("text", F.when(F.col(ROW).getField("text").isNotNull(), F.col("kept").cast("string"))).where(~changed | (F.trim("text") != ""))
    return left.select(*rewritten(docs, F.col("text"), changed))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations, checked by decoding."""
    return sentencepiece_sampling.round_trip(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_distinct),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, "stage")
    return docs
