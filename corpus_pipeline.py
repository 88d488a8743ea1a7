"""The corpus pipeline: each stage keeps, drops or rewrites documents and hands the rest on.

A stage takes (spark, docs, data folder) and returns a frame; ``run`` writes each result as
Parquet in the shared folder and rereads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import common, decontaminate, language, mixing, pii, simhash

#: A document whose language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language stays in doubt."""
    found = language.identify(common.pack(docs, "text"), language.train(docs))
    certain = found.where(
        (F.col("lang_pred") != language.UNDETERMINED)
        & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)
    )
    return common.unpack(certain, docs.columns, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints are linked."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents a twentieth of whose words, or more, lie in windows of benchmark items."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(common.pack(docs, "text"), benchmark)
    return common.unpack(found.where(~F.col("contaminated")), docs.columns, "text")


def clean_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and terms that disclose it; ``n_chars`` follows the new text."""
    clean = pii.sanitise(docs, everywhere=True, generalise=pii.GENERALISE_FROM_LARGE)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the mix takes, with how often as ``repeats``."""
    row = common.unused(docs, "_row")
    stored = common.stage(docs.withColumn(row, F.monotonically_increasing_id()))
    sized = stored.select(F.col(row).alias("row"), "doc_id", "source", mixing.words("text").alias("size"))
    taken = mixing.mix(common.stage(sized)).where("repeats > 0").select(F.col("row").alias(row), "repeats")
    return common.without(stored, ["repeats"]).join(taken, row).drop(row)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", clean_personal_data),
    ("mixing sources", mix_sources),
]

#: No SQL: the stages fit models and join texts by likeness. Tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir))
    return docs
