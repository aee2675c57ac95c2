"""Interval algebra and rendering (§2.8)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import marks as K
from spanmill.functions import text as T

#: Order in which crossing spans win, and labels nest at equal bounds (fixed values).
PRIORITY = ("sentence", "paragraph", "list_item", "dialogue", "metadata", "section")
#: Offsets of one bucket of a range join.
BUCKET = 4096
#: The same for single places, of which a bucket of the other size would hold many.
POINT_BUCKET = 512
#: Spans that a task holds as Python objects at a time; a document's are never divided.
SLICE = 20_000


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two ranges overlap and neither contains the other."""
    return (a < c) & (c < b) & (b < d) | (c < a) & (a < d) & (d < b)


def range_join(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of overlapping ranges ``(doc_id, start, end)`` x ``(doc_id, r_start, r_end)``.

    Both sides get a row for each bucket of offsets they touch, so the join is
    an equi-join on document and bucket; a pair is kept in the bucket where its
    overlap begins.
    """
    spread = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket))))
    both = spread(left.where("start < end"), "start", "end").join(spread(right.where("r_start < r_end"), "r_start", "r_end"), ["doc_id", "bucket"])
    first = F.floor(F.greatest("start", "r_start") / bucket) == F.col("bucket")
    return both.where(overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) & first).drop("bucket")


def overlap_ratio() -> Column:
    """Share of the left range that the right one covers."""
    return (F.least("end", "r_end") - F.greatest("start", "r_start")) / (F.col("end") - F.col("start"))


class _Extremes:
    """Greatest value put at any place of a range, places being 0 to n - 1: a segment tree."""

    def __init__(self, n: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [-1] * (2 * self.size)

    def put(self, at: int, value: int) -> None:
        at += self.size
        while at and self.tree[at] < value:
            self.tree[at] = value
            at >>= 1

    def most(self, low: int, high: int) -> int:
        low, high, out = low + self.size, high + self.size, -1
        while low < high:
            if low & 1:
                out = max(out, self.tree[low])
                low += 1
            if high & 1:
                high -= 1
                out = max(out, self.tree[high])
            low, high = low >> 1, high >> 1
        return out


def without_crossings(items, least: int = 1) -> list:
    """The spans of one document that cross none that went before, by priority, start and length; in order of start.

    A span crosses an accepted one that begins inside it and ends behind it, or
    ends inside it and begins before it; two trees over the sorted
    offsets answer that, so n spans cost n log n.
    """
    rank = {label: k for k, label in enumerate(PRIORITY)}
    order = sorted((s for s in items if s["end"] - s["start"] >= least), key=lambda s: (rank.get(s["label"], 9), s["start"], -s["end"]))
    places = sorted({x for s in order for x in (s["start"], s["end"])})
    at = {x: k for k, x in enumerate(places)}
    ends, starts, n = _Extremes(len(places)), _Extremes(len(places)), len(places)
    kept = []
    for s in order:
        a, b = at[s["start"]], at[s["end"]]
        if ends.most(a + 1, b) <= b and n - starts.most(a + 1, b) >= a:
            kept.append(s)
            ends.put(a, b)
            starts.put(b, n - a)
    return sorted(kept, key=lambda s: (s["start"], s["end"], -rank.get(s["label"], 9)))


def resolve(spans: DataFrame, least: int = 1) -> DataFrame:
    """Spans of each document without crossings: by priority, start and length, a span stays if it crosses none that stayed.

    ``spans`` is ``(doc_id, spans array<struct<label,start,end,score>>)``, so a
    document's spans are one row; the fold over them is sequential by nature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                kept = [None if items is None else without_crossings(items, least) for items in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, part.column(1).type)], ["doc_id", "spans"])

    rows = spans.select("doc_id", "spans")
    return rows.mapInArrow(run, rows.schema)


def _slices(batch: pa.RecordBatch, lists: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some ``SLICE`` elements of its column of lists, so that few are Python objects at a time."""
    ends = np.cumsum(np.asarray(batch.column(lists).value_lengths().fill_null(0)) + 1)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def tagged_text(text: Column, spans: Column, close: str = "</|{}|>", in_bytes: bool = False) -> Column:
    """The text with nested tags for an array of non-crossing spans with ``label`` and bounds, in code points or bytes.

    Each span gives two events; at one position closing tags come first (latest
    start first), then opening tags (longest first, then priority). Text pieces
    run from event to event, are cut out of an encoding of fixed width, and are joined once.
    """
    first, last = ("start_byte", "end_byte") if in_bytes else ("start", "end")
    raw, cut = (text.cast("binary"), T.byte_piece) if in_bytes else (F.encode(text, "UTF-32"), T.wide_piece)
    size = F.octet_length(text) if in_bytes else F.length(text)
    priority = lambda s: F.array_position(F.array(*map(F.lit, PRIORITY)), s["label"])
    head, tail = close.split("{}")
    event = lambda at, kind, a, b, tag: F.struct(at.cast("bigint").alias("at"), F.lit(kind).alias("kind"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), tag.alias("tag"))
    opening = F.transform(spans, lambda s: event(s[first], 1, -s[last], -priority(s), F.concat(F.lit("<|"), s["label"], F.lit("|>"))))
    closing = F.transform(spans, lambda s: event(s[last], 0, -s[first], priority(s), F.concat(F.lit(head), s["label"], F.lit(tail))))
    end = F.array(event(size, 2, F.lit(0), F.lit(0), F.lit("")))
    whole = F.struct(raw.alias("raw"), F.concat(F.array_sort(F.concat(opening, closing)), end).alias("events"))

    def join(w: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(w["events"], lambda e: e["at"]))
        pieces = F.zip_with(w["events"], F.slice(before, 1, F.size(w["events"])), lambda e, at: F.concat(cut(w["raw"], at, e["at"]), e["tag"]))
        return F.array_join(pieces, "")

    return F.when(text.isNotNull(), T.let(whole, join))


def render(spans: DataFrame, docs: DataFrame, close: str = "</|{}|>") -> DataFrame:
    """``(doc_id, tagged)``: text with nested tags, for non-crossing spans ``(doc_id, label, start, end)`` in code points."""
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("label", "start", "end")).alias("spans"))
    both = docs.select("doc_id", "text").join(own, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(tagged_text(F.col("text"), F.col("spans"), close)).alias("tagged"))


def checked(text: Column, spans: Column, labels: tuple[str, ...] = PRIORITY) -> Column:
    """``spans`` (``label, start, end`` in code points) as they are; an unknown label or an offset outside the text raises."""
    sound = lambda s, n: F.coalesce(s["label"].isin(*labels) & (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= n), F.lit(False))
    message = lambda bad: F.concat(F.lit("not a span of the text: "), F.to_json(bad[0]))
    bad = T.let(F.length(text), lambda n: F.filter(spans, lambda s: ~sound(s, n)))
    return T.let(bad, lambda bad: F.when(F.size(bad) > 0, F.raise_error(message(bad)).cast("boolean")).otherwise(F.lit(True)))


def render_checked(docs: DataFrame, close: str = "</|{}|>") -> DataFrame:
    """``(doc_id, tagged)`` of documents ``(doc_id, text, spans)``, for anyone's spans.

    Unknown labels and offsets outside the text raise; empty spans and those that cross one of
    higher priority are left out.
    """
    sound = docs.where(checked(F.col("text"), F.col("spans"))).select("doc_id", F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.lit(1.0).alias("score"))).alias("spans"))
    kept = docs.select("doc_id", "text").join(resolve(sound), "doc_id")
    return kept.select("doc_id", tagged_text(F.col("text"), F.col("spans"), close).alias("tagged"))


def strict_text(text: Column, spans: Column, close: str = "</|{}|>") -> Column:
    """The tagged text; an unknown label, an offset outside, an empty span or neighbours (by start, longest first) that cross raise."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), (-s["end"]).cast("long").alias("last"))))
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.size(ordered)), lambda a, b: crosses(a["start"], -a["last"], b["start"], -b["last"]))
    sound = checked(text, spans)
    return (
        F.when(~sound, F.lit(None).cast("string"))
        .when(F.exists(spans, lambda s: s["start"] >= s["end"]), F.raise_error(F.lit("an empty span")).cast("string"))
        .when(F.exists(pairs, lambda x: x), F.raise_error(F.lit("crossing spans")).cast("string"))
        .otherwise(tagged_text(text, spans, close))
    )


def position_targets(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """``inside``, ``starts`` and ``ends`` of each position against spans ``(doc_id, start, end)`` (an end is the offset behind).

    Spans may have ``left_open`` and ``right_open``: an open edge is inside, but neither a start nor an end.
    """
    points = positions.select("doc_id", F.col("position").alias("start"), (F.col("position") + 1).alias("end"))
    closed = lambda side: ~F.coalesce(F.col(side), F.lit(False)) if side in spans.columns else F.lit(True)
    # A span reaches one place further, to its end, and so meets all places that it says something of.
    reach = spans.select("doc_id", F.least("start", "end").alias("r_start"), (F.greatest("start", "end") + 1).alias("r_end"), F.col("start").alias("s"), F.col("end").alias("e"), closed("left_open").alias("begins"), closed("right_open").alias("closes"))
    at = F.col("start")
    tests = {"inside": (at >= F.col("s")) & (at < F.col("e")), "starts": (at == F.col("s")) & F.col("begins"), "ends": (at == F.col("e")) & F.col("closes")}
    flags = range_join(points, reach, POINT_BUCKET).groupBy("doc_id", at.alias("position")).agg(*[F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(k) for k, t in tests.items()])
    return positions.join(flags, ["doc_id", "position"], "left").fillna(0, list(tests))


def boundary_targets(candidates: DataFrame, spans: DataFrame, end: str = "end_byte") -> DataFrame:
    """``candidates`` ``(doc_id, break_end)`` with ``target``: whether a span ends there that isn't ``right_open``."""
    closed = spans.where(~F.coalesce(F.col("right_open"), F.lit(False))) if "right_open" in spans.columns else spans
    gold = closed.select("doc_id", F.col(end).alias("break_end"), F.lit(1).alias("target")).distinct()
    return candidates.join(gold, ["doc_id", "break_end"], "left").fillna(0, ["target"])


def parse_tagged(tagged: DataFrame, labels: tuple[str, ...] = PRIORITY) -> DataFrame:
    """``(doc_id, text, spans, error)`` from ``(doc_id, tagged)``: the inverse of ``render``, in either dialect.

    Tags are read one by one with a stack of open ones, in their row. ``error`` names an unknown label, a wrong closing tag or
    one left open; spans are then empty.
    """
    pattern = "<\\|[a-z_]+\\|>|</\\|[a-z_]+\\|>|<\\|/[a-z_]+\\|>"
    kind = "array<struct<label:string,start:bigint,end:bigint>>"
    tag = re.compile(pattern)

    def parse(text: str) -> tuple[list[tuple[str, int, int]], str | None]:
        stack, spans, error, size = [], [], None, 0
        for m in tag.finditer(text):
            label, at = m[0].strip("<>|/"), m.start() - size
            size += m.end() - m.start()
            closes = "/" in m[0]
            if label not in labels:
                error = error or f"unknown label {label}"
            if not closes:
                stack.append((label, at))
            elif stack and stack[-1][0] == label:
                spans.append((label, stack.pop()[1], at))
            else:
                error = error or f"unexpected end of {label}"
        error = error or ("a tag is left open" if stack else None)
        return [] if error else spans, error

    def run(raws: pa.Array) -> pa.Array:
        found = [None if text is None else parse(text) for text, _ in K.texts(raws)]
        flat = [s for x in found if x for s in x[0]]
        columns = [pa.array([s[k] for s in flat], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        spans = K.lists([x and len(x[0]) for x in found], pa.StructArray.from_arrays(columns, ["label", "start", "end"]))
        return pa.StructArray.from_arrays([spans, pa.array([x and x[1] for x in found], pa.string())], ["spans", "error"])

    parsed = F.arrow_udf(K.by_slices(run), f"struct<spans:{kind},error:string>")(F.col("tagged").cast("binary"))
    rows = tagged.select("doc_id", F.regexp_replace("tagged", pattern, "").alias("text"), parsed.alias("p"))
    return rows.select("doc_id", "text", "p.spans", "p.error")
