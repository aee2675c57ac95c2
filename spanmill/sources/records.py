"""Numbered JSONL records: every line keeps its number in the whole input, whatever splits it is read in.

Splits of a file are counted, and running sums of the counts over files in
order give each split the number of its first line; lines then count on from
there. Lines are never sorted or shuffled, and only counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.functions import text as T
from spanmill.sources.jsonl import MARKER, marker_spans

SCHEMA = "text string, spans array<struct<label:string,start:bigint,end:bigint,char_start:bigint,char_end:bigint,right_open:boolean>>"
OUT = "array<struct<start:bigint,end:bigint,right_open:boolean>>"
#: What can become of a line, in the order in which it is judged.
OUTCOMES = ("blank", "malformed", "no text", "record")


class EmptyInput(ValueError):
    """An input without a record that can be used."""


def numbered_lines(spark: SparkSession, paths: list[str], max_records: int | None = None) -> DataFrame:
    """``(path, number, line)`` for each line of the files, numbered from 1 through all files in the order of their paths.

    Lines end at a line feed; a carriage return before it goes. With
    ``max_records`` only lines up to that number are read on, blank and
    malformed ones counted.
    """
    source = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\\r\\z", "").alias("line")
    )
    counts = source.groupBy("path", "block").agg(F.count("*").alias("n"))
    in_file = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    files = counts.groupBy("path").agg(F.sum("n").alias("whole"))
    before = F.sum("whole").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = files.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    bases = counts.select("path", "block", F.coalesce(in_file, F.lit(0)).alias("earlier")).join(files, "path").select("path", "block", (F.col("before") + F.col("earlier")).alias("base"))

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, nth = None, 0
        for batch in batches:
            path, block = batch.column(0), np.asarray(batch.column(1))
            n = len(block)
            if not n:
                continue
            codes = np.asarray(path.dictionary_encode().indices)
            fresh = np.flatnonzero((np.diff(codes, prepend=codes[0]) != 0) | (np.diff(block, prepend=block[0]) != 0))
            first = (path[0].as_py(), int(block[0]))
            starts = np.zeros(n, np.int64)
            starts[fresh] = fresh
            order = np.arange(n) - np.maximum.accumulate(starts)
            lead = fresh[0] if len(fresh) else n
            order[:lead] += nth if first == here else 0
            here, nth = (path[n - 1].as_py(), int(block[-1])), int(order[-1]) + 1
            yield pa.RecordBatch.from_arrays([path, batch.column(1), pa.array(order), batch.column(2)], ["path", "block", "nth", "line"])

    own = source.mapInArrow(count_on, "path string, block long, nth long, line string")
    found = own.join(bases, ["path", "block"]).select("path", (F.col("base") + F.col("nth") + 1).alias("number"), "line")
    return found if max_records is None else found.where(F.col("number") <= max_records)


def _at_boundary(text: Column, at: Column) -> Column:
    return T.char_boundary(text, at) == at


def byte_spans(text: Column, spans: Column) -> Column:
    """Sentence spans in bytes, in their order: by code points where a span has both of these, else by bytes where they are whole characters of the text, else by code points; what fits neither is dropped."""
    size, length = F.octet_length(text), F.length(text)
    to_byte = lambda n: F.octet_length(F.left(text, n.cast("int"))).cast("bigint")

    def by_characters(start: Column, end: Column) -> Column:
        return F.when((start >= 0) & (start < end) & (end <= length), F.struct(to_byte(start).alias("start"), to_byte(end).alias("end")))

    def moved(s: Column) -> Column:
        in_bytes = (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size)
        whole = F.coalesce(in_bytes & _at_boundary(text, s["start"]) & _at_boundary(text, s["end"]), F.lit(False))
        plain = F.when(whole, F.struct(s["start"].alias("start"), s["end"].alias("end"))).otherwise(by_characters(s["start"], s["end"]))
        named = s["char_start"].isNotNull() & s["char_end"].isNotNull()
        bounds = F.when(named, by_characters(s["char_start"], s["char_end"])).otherwise(plain)
        return F.struct(bounds.alias("at"), F.coalesce(s["right_open"], F.lit(False)).alias("right_open"))

    sentences = F.filter(F.coalesce(spans, F.array()), lambda s: F.lower(s["label"]) == "sentence")
    kept = F.filter(F.transform(sentences, moved), lambda s: s["at"].isNotNull())
    return F.transform(kept, lambda s: F.struct(s["at"]["start"].alias("start"), s["at"]["end"].alias("end"), s["right_open"].alias("right_open"))).cast(OUT)


@dataclass(frozen=True)
class Records:
    """``records`` ``(path, number, text, spans, dropped)``; ``rejected`` ``(path, number, outcome, preview)``; ``counts`` ``(path, outcome, lines, spans, dropped)``."""

    records: DataFrame
    rejected: DataFrame
    counts: DataFrame


def read_records(spark: SparkSession, paths: list[str], max_records: int | None = None, required: bool = False) -> Records:
    """Trainer records of JSONL files with their line numbers, and what became of every line.

    A record has a text and spans by code points or bytes; one without spans may
    carry inline markers, and text behind the last of these is a ``right_open``
    span. Blank, malformed and textless lines are rejected, with a preview;
    spans that fit no text are dropped and counted. With ``required`` an input
    without any record raises ``EmptyInput``.
    """
    raw = numbered_lines(spark, paths, max_records)
    parsed = raw.withColumn("r", F.from_json("line", SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    text = F.col("r.text")
    outcome = F.when(F.length(F.trim(F.regexp_replace("line", "\\s+", " "))) == 0, "blank").when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "malformed").when(text.isNull(), "no text").otherwise("record")
    inline = (F.size(F.coalesce("r.spans", F.array().cast(SCHEMA.partition("spans ")[2]))) == 0) & text.rlike(MARKER)
    marked = marker_spans(text)
    tail = F.octet_length(F.element_at(F.split(text, MARKER, -1), -1)) > 0
    found = F.transform(marked["spans"], lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), (tail & (k == F.size(marked["spans"]) - 1)).alias("right_open"))).cast(OUT)
    spans = F.when(inline, found).otherwise(byte_spans(text, F.col("r.spans")))
    given = F.when(inline, F.size(found)).otherwise(F.size(F.coalesce("r.spans", F.array().cast(SCHEMA.partition("spans ")[2]))))
    judged = parsed.select("path", "number", "line", outcome.alias("outcome"), F.when(inline, marked["text"]).otherwise(text).alias("text"), F.when(outcome == "record", spans).alias("spans"), given.alias("given"))
    records = judged.where("outcome = 'record'").select("path", "number", "text", "spans", (F.col("given") - F.size("spans")).cast("long").alias("dropped"))
    rejected = judged.where("outcome <> 'record'").select("path", "number", "outcome", F.left("line", F.lit(120)).alias("preview"))
    kept = F.coalesce(F.size("spans"), F.lit(0))
    counts = judged.groupBy("path", "outcome").agg(
        F.count("*").alias("lines"), F.sum(F.when(F.col("outcome") == "record", kept).otherwise(0)).cast("long").alias("spans"), F.sum(F.when(F.col("outcome") == "record", F.col("given") - kept).otherwise(0)).cast("long").alias("dropped")
    )
    if required and records.isEmpty():
        raise EmptyInput(f"no records in {paths}")
    return Records(records, rejected, counts)
