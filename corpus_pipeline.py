"""A training corpus from ``documents``: five stages, each on all that its predecessor kept.

Language identification, MinHash near-dedup, benchmark decontamination,
removal of personal data, and mixing of sources to target weights. Each stage's
result is written to the shared folder and read back, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import common, decontam, lang_id, minhash, mixing, pii


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised; profiles are learnt from those not held out."""
    train = docs.where(~lang_id.held_out("doc_id") & F.col("doc_id").isNotNull())
    return lang_id.keep_identified(docs, lang_id.fit(train))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (5-word shingles, similarity 0.8): the one of least id.

    Rows are told apart by id and text, so each is judged by its own text and a
    repeated row stays once; texts without words are no copies.
    """
    keyed = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest")))
    found = common.durable(minhash.near_duplicates(keyed, id_col="__row", width=5, percent=80).where("n_shingles > 0"), "near")
    unique = keyed.join(found.where("not kept").select(F.col("id").alias("__row")), "__row", "left_anti")
    twice = common.durable(found.where("kept").groupBy(F.col("id").alias("__row")).count().where("count > 1").select("__row"), "twice")
    if not twice.isEmpty():
        once = unique.join(twice, "__row", "left_semi").dropDuplicates(["__row"])
        unique = unique.join(twice, "__row", "left_anti").unionByName(once)
    return unique.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover 5 % of the words or more."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts; ``n_chars`` follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources have their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", remove_personal_data),
    ("mix_sources", mix_sources),
]

#: SQL has neither the profiles nor the sketches; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
