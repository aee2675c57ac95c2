"""JSONL corpora (§2.1): marker and span records read with explicit schemas, and sinks with a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import text as T

MARKER = r"<\|(?:sentence|paragraph)\|>"
SPANS = "text string, spans array<struct<label:string,start:bigint,end:bigint,char_start:bigint,char_end:bigint,left_open:boolean,right_open:boolean>>"
OUT = "array<struct<label:string,start:bigint,end:bigint>>"


def marker_spans(marked: str | Column) -> Column:
    """``struct(text, spans, markers)`` of a text with inline separators.

    A span is the text since the last marker, in bytes; a marker's place is the
    last byte before it. Text behind the last marker is a span without one.
    """
    marked = T.col(marked)
    parts = F.split(marked, MARKER, -1)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(OUT).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.octet_length(part)
        span = F.array(F.struct(F.lit("sentence").alias("label"), state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.when(end > state["at"], span).otherwise(F.array().cast(OUT))).alias("spans"))

    spans = F.aggregate(parts, zero, step)["spans"]
    closed = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, step)["spans"]
    return F.struct(F.array_join(parts, "").alias("text"), spans.alias("spans"), F.transform(closed, lambda s: s["end"] - 1).alias("markers"))


def read_marked(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(text, spans, markers)`` for each line; blank lines are left out and malformed ones are errors."""
    rows = spark.read.schema("text string").option("mode", "FAILFAST").json(path)
    rows = rows.where("text is not null")
    rows = rows.limit(limit) if limit is not None else rows
    return rows.select(marker_spans("text").alias("r")).select("r.*")


def check_spans(text: str | Column, spans: str | Column, labels: dict[str, str] | None = None) -> Column:
    """Spans by code points with known labels (aliases resolved), empty ones dropped, sorted, in bytes.

    Null if any kept span is out of range: the record is to be dropped.
    """
    text, spans = T.col(text), T.col(spans)
    names = labels or {"Sentence": "sentence", "sentence": "sentence", "section_heading": "section", "section": "section", "paragraph": "paragraph", "list_item": "list_item", "metadata": "metadata"}
    alias = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    start, end = (lambda s: F.coalesce(s["char_start"], s["start"])), (lambda s: F.coalesce(s["char_end"], s["end"]))
    known = F.filter(spans, lambda s: alias[s["label"]].isNotNull() & (start(s) != end(s)))
    fits = F.forall(known, lambda s: (start(s) >= 0) & (start(s) < end(s)) & (end(s) <= F.length(text)))
    size = lambda n: F.octet_length(F.substring(text, F.lit(1), n.cast("int"))).cast("bigint")
    moved = F.transform(known, lambda s: F.struct(size(start(s)).alias("start"), size(end(s)).alias("end"), alias[s["label"]].alias("label")))
    return F.when(fits, F.transform(F.array_sort(moved), lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))))


def read_spans(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """``(records, rejected)``: text and checked spans, and lines that are malformed or have a span out of range.

    Records without spans may carry inline markers instead.
    """
    rows = spark.read.schema(SPANS + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(list(paths))
    rows = rows.withColumn("checked", check_spans("text", F.coalesce("spans", F.array().cast(SPANS.partition("spans ")[2]))))
    inline = (F.size(F.coalesce("spans", F.array().cast(SPANS.partition("spans ")[2]))) == 0) & F.col("text").rlike(MARKER)
    marked = marker_spans("text")
    good = rows.where("_corrupt is null and text is not null and checked is not null")
    records = good.select(F.when(inline, marked["text"]).otherwise(F.col("text")).alias("text"), F.when(inline, marked["spans"]).otherwise(F.col("checked")).alias("spans"))
    bad = rows.where("_corrupt is not null or text is null or checked is null")
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("text").isNull(), "no text").otherwise("span out of range")
    return records, bad.select(reason.alias("error"), F.substring(F.coalesce("_corrupt", "text"), 1, 120).alias("preview"))


def write_annotated(annotated: DataFrame, path: str, errors: DataFrame | None = None, error_path: str | None = None) -> None:
    """Annotations as JSONL, and errors with a preview to a place of their own."""
    annotated.write.mode("overwrite").json(path)
    if errors is not None and error_path:
        errors.write.mode("overwrite").json(error_path)
