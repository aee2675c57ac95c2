"""Registered queries of the llm operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import centroids, decontam, embed_join, html_extract, interaction, lang_id, minhash, mixing, oracle, packing, pii, secrets, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without what its elements, names and site template mark as something else."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, equal payloads as revisits, and read back."""
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` inside 200-byte strings that occur more than once."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside 13-word windows of ``benchmark``, and who is contaminated at 5 %."""
    hits = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated(5).alias("contaminated"),
    )


def op5_secret_scan_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of ``documents``: each distinct text scanned once, findings joined to every document."""
    findings, _ = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings.select(
        F.col("id").alias("doc_id"),
        *[count(kind) for kind, *_ in secrets.BASE_RULES],
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op6_pii_information_theoretic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of ``documents``: base spans, and terms that disclose an entity."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(pii.span_text("base").cast("binary"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of 150 % of all words takes each of ``documents``, sources weighing 3, 1, 2 in turn."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on distinct 2-word shingles at Jaccard 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).withColumnRenamed("id", "doc_id")


def op9_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between all ``embeddings``."""
    return embed_join.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of ``documents`` by rank-order profiles learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = lang_id.fit(docs.where(~lang_id.held_out("doc_id") & F.col("doc_id").isNotNull()))
    found = lang_id.identify(docs, profiles)
    return found.select(F.col("id").alias("doc_id"), lang_id.held_out("id").alias("held_out"), "lang_pred", "score")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters of ``documents`` remove in each of their 120 orders, for each language."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ``documents`` in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of ``embeddings`` around 8 integer centroids after 10 rounds."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    components = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(components.cast("binary"), 256).alias("centroid_sha256"))


QUERIES = [
    op1_html_main_text,
    op2_warc_round_trip,
    op3_suffix_dedup,
    op4_benchmark_decontamination,
    op5_secret_scan_blob_ledger,
    op6_pii_information_theoretic,
    op7_source_mixing,
    op8_minhash_near_dedup,
    op9_embedding_range_join,
    op10_rank_order_language_id,
    op11_filter_interaction_audit,
    op12_linear_grouping_packing,
    op13_hamerly_clusters,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.build()
