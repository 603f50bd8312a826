"""The corpus pipeline: documents through quality, near-dedup, decontamination, secrets and segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontamination, quality_rules, secret_scan, sentencepiece_lattice, simhash_dedup
from pagewright.plans.session import scratch, scratch_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are.

    Null and empty texts go, repeated rows get one verdict, null languages and
    sources are groups of their own, texts are judged whole, an empty table stays
    empty, and other columns may have any names.
    """
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Of repeated rows one stays; a row with a null doc_id stays only if its group has
    no other; null, empty and blank texts are one group; ids of different groups
    never meet; an empty table stays empty, and other columns may have any names.
    """
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, as they are.

    Null and empty texts and documents without benchmark words stay, whole texts are
    searched, repeated rows share their fate, an empty table or benchmark takes
    nothing away, and other columns may have any names.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text where that has changed.

    Null and empty texts stay as they are, a null doc_id is a repository of its own
    and a null source one owner, repeated rows stay, an empty table stays empty, and
    other columns may have any names.
    """
    return secret_scan.redact(docs, length="n_chars")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentations with their scores, and whether all of them decode to its text.

    samples holds up to three of them; ids, log_prob and inclusion are those of the
    first.  Null and empty texts have one without pieces, rows with equal id and text
    equal samples, and an empty table gives no rows; texts are segmented whole, and
    other columns are not read.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    sampled = sentencepiece_lattice.sample_segmentations(docs, path, ["doc_id", "lang", "source"], check=True)
    first = [f"samples[0].{x} AS {x}" for x in ("ids", "log_prob", "inclusion")]
    return sampled.selectExpr("doc_id", "lang", "source", "size(samples) AS n_samples", *first, "samples", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("segmentation", segmentation),
]

#: Segmentation is sampled by hashes and a search, which SQL cannot express; the tests hold each stage, and run, against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    What an operator writes on its way is removed once its stage has been written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
