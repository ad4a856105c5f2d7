"""The stages of the training-data pipeline, each one corpus operator, and their run.

Each stage's rows are written to the shared folder and read again as the next one's documents, so a lost
executor costs no more than the stage at hand. All but the last return the columns of their input, whatever those
are called, with values unchanged but for masked texts and their n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom.llm import bpe, decontam, rules, secrets, simhash
from langloom.llm.common import Workspace, numbered, scratch, table

DOCUMENT = {"doc_id": "doc_id", "text": "text"}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    frame, own = numbered(docs, DOCUMENT)
    model = rules.train(frame, table(spark, sf_dir, "labels"))
    return rules.quality_rules(frame, model).where("kept").select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more, or fingerprints within four bits."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    frame, own = numbered(docs, DOCUMENT)
    return decontam.find_leaks(frame, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*own)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars, if there, is that of the new text."""
    frame, own = numbered(docs, DOCUMENT)
    size = F.length("text").cast("long")
    return secrets.redact(frame).select(*[size.alias(c) if c == "n_chars" else o for c, o in zip(docs.columns, own, strict=True)])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, as ids and n_tokens beside its columns but text and n_chars."""
    return bpe.encode(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")])


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave. Of what is written, only the last stage's rows stay."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch():
            docs = work.keep(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
