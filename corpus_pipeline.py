"""The corpus pipeline: documents through five operators of tessera.llm, each stage over all that its predecessor kept.

language id -> near-duplicate removal -> pseudonyms -> mixing to target weights -> sampled segmentations
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, mixing, pii, sampling
from tessera.llm.common import saved
from tessera.llm.tokenfile import public_vocabulary
from tessera.session import ship

PIECES = "piece_bpe_32k.model"
#: A document whose words speak for no language by more than this is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def _stage(work):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return work(spark, docs, sf_dir)

    return run


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; others go. A missing lang is filled in with the prediction."""
    found = langid.identify(docs, public_vocabulary(PIECES))
    spoken = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    named = spoken.groupBy("doc_id").agg(F.max("lang_pred").alias("__lang"))
    return docs.join(named, "doc_id").withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id. Rows that repeat a doc_id are settled before
    they are judged: the one with the smallest digest of all its columns stays, on any machine and in any run."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = docs
    if not again.isEmpty():
        digest = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
        least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), digest).alias("row"))
        once = saved(docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(least.select("row.*")), "once")
    kept = minhash.near_duplicates(once).where("kept")
    return _kept(once, kept)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data in their texts; n_chars is kept in step."""
    return pii.pseudonymise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn with their calibrated probabilities, whole; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document's text, as ids; a text with one segmentation gives one."""
    return sampling.sample_segmentations(docs, public_vocabulary(PIECES))


STAGES = [
    ("language_id", _stage(identify_language)),
    ("minhash_dedup", _stage(remove_near_duplicates)),
    ("pii_pseudonyms", _stage(pseudonymise)),
    ("raked_mixing", _stage(mix_sources)),
    ("gumbel_segmentations", _stage(sample_segmentations)),
]

#: The first, second and last stage learn, hash and sample in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
