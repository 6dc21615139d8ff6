"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, packing, in this order.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.
All but the last return the columns of ``docs``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm import language_id, packing, simhash_dedup, substring_dedup
from turfline.llm.buffers import free_name
from turfline.llm.queries import table, word_tokenizer
from turfline.session import stage

#: Texts whose n-grams are this far from every profile are in none of the languages.
LEAST_SCORE = 0.2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in one of the languages of the labelled documents; letterless and foreign texts go."""
    pred, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    said = language_id.identify(docs, language_id.learn(docs), pred=pred, score=score)
    return said.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.

    Rows without an id are in no group and stay.  Of rows that repeat an id and a fingerprint one stays, with the smallest text.  Where an id has
    texts of several fingerprints, each is judged by its own.
    """
    names, bits = docs.columns, free_name(docs.columns, "fingerprint")
    groups = stage(simhash_dedup.near_duplicates(docs), "groups").select("doc_id", F.col("fingerprint").alias(bits), (F.col("doc_id") == F.col("component_id")).alias("first"))
    first = groups.where("first").select("doc_id", bits).distinct()
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(repeated, "doc_id", "left_anti").join(first.select("doc_id"), "doc_id", "left_semi")
    again = simhash_dedup.with_fingerprint(docs.join(repeated, "doc_id", "left_semi"), bits).join(first, ["doc_id", bits], "left_semi")
    whole = F.min_by(F.struct(*names), F.coalesce("text", F.lit(""))).alias("row")
    return once.select(*names).unionByName(again.groupBy("doc_id", bits).agg(whole).select("row.*")).unionByName(docs.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that a document with a smaller id has too.

    A text that loses every word goes; a text that had none, null or blank, has nothing to lose and stays.
    """
    found = stage(substring_dedup.repeats(docs), "repeats")
    had = free_name(docs.columns, "had_words")
    left = substring_dedup.strip(docs.withColumn(had, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))), found)
    return left.where(~F.col(had) | (F.col("text") != "")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left as pieces of sequences of 2048 tokens."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("language_id", by_language),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]

#: Profiles, fingerprints and token ids are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
