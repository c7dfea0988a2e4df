"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, audit, imatch, langid, license, merkle, minhash, mixing, pii, sampling, secretscan, substring, tokenfile
from tessera.llm.common import read_table
from tessera.llm.oracles import ORACLES
from tessera.llm.tokenfile import public_vocabulary


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, read back from a token file of byte planes."""
    return tokenfile.token_digests(read_table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


def op2_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, and how many were verified for it."""
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms, and how many of each kind it held."""
    return pii.report(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's predicted language, learned outside the held-out fold."""
    return langid.identify(read_table(spark, sf_dir, "documents"), public_vocabulary("piece_bpe_32k.model"))


def op5_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, calibrated probability and draw; probability and residual to six digits."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.withColumns({"probability": F.round("probability", 6), "residual": F.round("residual", 6)})


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return imatch.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places of every text: counts, labels, and whether a tag permits reuse."""
    return license.summary(license.scan(read_table(spark, sf_dir, "documents")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group, over links confirmed on whole sets."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without passages that stand in earlier ones, and the longest level it shares."""
    return substring.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text, decoded again: samples' figures, crc32 of ids and of decoded text."""
    docs = read_table(spark, sf_dir, "documents")
    return sampling.digests(sampling.sample_segmentations(docs, public_vocabulary("piece_bpe_32k.model"), decoded=True))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of 120 orders of five filters removes at each step, a source at a time."""
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and the root that its possibly changed text folds to."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets in every text."""
    return secretscan.summary(secretscan.scan(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_planes,
            op2_collision_search,
            op3_pii_pseudonyms,
            op4_language_id,
            op5_raked_mixing,
            op6_imatch_fingerprints,
            op7_license_scan,
            op8_minhash_dedup,
            op9_substring_dedup,
            op10_gumbel_segmentations,
            op11_filter_audit,
            op12_merkle_manifest,
            op13_secret_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
