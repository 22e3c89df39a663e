"""A corpus pipeline: documents in, packed token sequences out.

Five stages, each of which works on what the stage before it kept: a quality classifier drops what it rejects,
near-duplicates leave one document of each group, benchmark passages and secrets are cut out of the texts, and what is
left is packed into sequences.

Null and empty texts are scored like any other, are near-duplicates of each other, and what stays of them is packed as an
end mark alone. Ties: of equal or near documents the smallest doc_id stays. Rows with one doc_id are one document to the
near-dedup, so they stay or go together; rows without doc_id stay. Repeated rows go through each stage as often as they
occur. A very long text is a row like any other. Other columns go along, whatever their names, up to the packing, which
drops them. Empty tables give no rows; without labels every document is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common, decontamination, packing, quality, secrets, simhash

#: Near-duplicates in the pipeline: words of a shingle; words of the fingerprint (64 bits each), the bits of all words,
#: and of the first, by which linked texts may differ; bands in which texts meet. Texts that share 0.8 of their shingles
#: differ in 116 of 768 bits on average (10 of the first 64) with a deviation of 10, unrelated ones in 384. Of those at
#: 0.8, 5 in 10^8 don't meet in any band, at every number of texts; at 0.65 it is 2 in 10^3.
SHINGLE, WORDS, CUT, FIRST, BANDS = 5, 12, 132, 22, 32


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = quality.learn(*quality.labelled(docs, common.table(spark, sf_dir, "labels")))
    # with nothing to learn from every score is 0.5, and nothing is dropped
    if not scorer.weights.any():
        return docs
    return quality.scored(docs, scorer).filter(F.col("quality_score") >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, CUT, SHINGLE, WORDS, FIRST, BANDS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.vocabulary_path())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmarks),
    ("secret scans", cut_secrets),
    ("best-fit packing", pack),
]

#: Scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    return docs
