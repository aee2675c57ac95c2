"""Candidate generators: rows ``(doc_id, ...)`` of positions, each a narrow plan without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import predicates as Q
from spanmill.functions import text as T
from spanmill.operators.positions import keys

#: Closers and terminators that may end a sentence (fixed values).
TERMINATORS = ".!?…\"')]}>“”‘’«»‹›"
TERMINATOR_PATTERN = "[" + "".join("\\" + c if c.isascii() else c for c in TERMINATORS) + "]"
#: A trimmed block that is longer is no heading and no metadata whatever follows, and its start says the rest.
SETTLED = 180
#: Bytes whose places are rows of one batch.
WINDOW = 1 << 16
CLOSERS = "\"')]}>”’»›"


def spans(docs: DataFrame, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), around: tuple[str, ...] = ("value",), reach: int = 32) -> DataFrame:
    """One row for each match: ``keep``, ``k`` from 0, ``start, end, start_byte, end_byte``, and what ``around`` names (see ``text.locate``).

    Rows hold no text of the document, only short pieces of it.
    """
    found = docs.select(*keep, F.posexplode(T.locate(text, pattern, around, reach)).alias("k", "s"))
    return found.select(*keep, F.col("k").cast("long").alias("k"), "s.*")


def scan_set(docs: DataFrame, chars: str, text: str = "text") -> DataFrame:
    """Every occurrence of a character of the set, by byte offset; an empty set has none."""
    if not chars:
        return docs.select("doc_id", F.lit(0).cast("long").alias("position")).limit(0)
    return spans(docs, "[" + "".join("\\" + c if c.isascii() else c for c in sorted(set(chars))) + "]", text, around=()).select("doc_id", F.col("start_byte").alias("position"))


def scan_stride(docs: DataFrame, stride: int, begin: int = 0, stop: int | None = None, text: str = "text") -> DataFrame:
    """``begin, begin + stride, ...`` below the byte length (and ``stop``)."""
    size = F.octet_length(text).cast("long")
    end = size if stop is None else F.least(size, F.lit(stop).cast("long"))
    places = F.when(end > begin, F.sequence(F.lit(begin).cast("long"), end - 1, F.lit(stride).cast("long")))
    return docs.select("doc_id", F.explode(places).alias("position"))


def scan_line_starts(docs: DataFrame, text: str = "text") -> DataFrame:
    """0 and the byte after each newline that is inside the text."""
    size = F.octet_length(text).cast("long")
    after = F.filter(F.transform(T.locate(text, "\\n"), lambda s: s["end_byte"]), lambda p: p < size)
    return docs.select("doc_id", F.explode(F.when(size > 0, F.concat(F.array(F.lit(0).cast("long")), after))).alias("position"))


def exhaustive(docs: DataFrame, text: str = "text") -> DataFrame:
    """A candidate behind every code point: ``(doc_id, feature_pos, break_end)`` in bytes.

    The bytes of a batch are walked once, in windows of a fixed size, however long a text is.
    """
    rows = docs.select("doc_id", F.col(text).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(raws.buffers()[1], np.int64)[raws.offset : raws.offset + len(raws) + 1]
            if not len(raws) or bounds[0] == bounds[-1]:
                continue
            data = np.frombuffer(raws.buffers()[2], np.uint8)
            for low in range(int(bounds[0]), int(bounds[-1]), WINDOW):
                high = min(low + WINDOW, int(bounds[-1]))
                lead = low + np.flatnonzero((data[low : min(high + 4, int(bounds[-1]))] & 0xC0) != 0x80)
                n = int(np.searchsorted(lead, high))
                which = np.searchsorted(bounds, lead[:n], "right") - 1
                following = np.append(lead, bounds[-1])[1 : n + 1]  # the next text begins where one ends
                columns = [batch.column(0).take(pa.array(which)), pa.array(lead[:n] - bounds[which]), pa.array(np.minimum(following, bounds[which + 1]) - bounds[which])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "feature_pos", "break_end"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, feature_pos long, break_end long")


def sampled_positions(docs: DataFrame, edges: DataFrame | Column, most: int, text: str = "text", seed: int = 0) -> DataFrame:
    """``(doc_id, position)``: the byte offset of every code point and the end, ``most`` of a document where it has more.

    Edges always stay; the others fill up by least ``sampling.draw``. Edges are
    rows ``(doc_id, position)``, or an array column of ``docs``, which then needs
    no shuffle. Places are drawn inside the row and become rows once they are taken.
    """
    if isinstance(edges, DataFrame):
        docs = docs.join(edges.groupBy("doc_id").agg(F.collect_set("position").alias("__edges")), "doc_id", "left")
        edges = F.col("__edges")
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"), F.coalesce(edges.cast("array<bigint>"), F.array().cast("array<bigint>")).alias("edges"))

    def taken(doc: int | None, raw: bytes, sure: np.ndarray) -> np.ndarray:
        places = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        edge = np.isin(places, sure)
        rest, room = places[~edge], max(0, most - int(edge.sum()))
        if len(rest) > room:
            draws = 0 if doc is None else keys(doc, rest, seed) % 10_000
            rest = np.sort(draws * (1 << 40) + rest)[:room] % (1 << 40) if room else rest[:0]
        return np.concatenate((places[edge], rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [taken(doc.as_py(), raw.as_py(), np.asarray(sure.values, np.int64)) for doc, raw, sure in zip(*batch.columns, strict=True)]
            which = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            if len(which):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(np.concatenate(found), pa.int64())], ["doc_id", "position"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, position long")


def from_break_ends(docs: DataFrame, breaks: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, feature_pos, break_end)`` for break ends in bytes: the terminal before closers and blanks, else the last non-blank before.

    A break end at 0, outside the text or with only blanks before it has no candidate.
    """
    raw = F.col(text).cast("binary")
    before = F.substring(raw, F.lit(1), F.col("break_end").cast("int")).cast("string")
    rows = breaks.join(docs.select("doc_id", text), "doc_id").where((F.col("break_end") > 0) & (F.col("break_end") <= F.octet_length(text)))
    terminal = F.regexp_extract(before, "(?s)([.!?…])[\"')\\]}”’»\\s]*\\z", 1)
    closing = F.octet_length(F.regexp_extract(before, "(?s)[.!?…][\"')\\]}”’»\\s]*\\z", 0))
    last = F.regexp_extract(before, "(?s)(\\S)\\s*\\z", 0)
    size = F.when(F.length(terminal) > 0, closing).otherwise(F.octet_length(last))
    return rows.select("doc_id", (F.octet_length(before) - size).cast("long").alias("feature_pos"), "break_end", size.alias("size")).where("size > 0").drop("size")


def sentence_terminators(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, feature_pos, break_end, value)`` for each character of ``TERMINATORS``."""
    return spans(docs, TERMINATOR_PATTERN, text).select("doc_id", F.col("start_byte").alias("feature_pos"), F.col("end_byte").alias("break_end"), "value")


def lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Non-blank lines, trimmed: ``line_no`` among all matches, offsets of the trimmed line and its text."""
    rows = spans(docs, "[^\\n\\r]+", text, keep)
    lead = F.length("value") - F.length(F.ltrim("value"))
    lead_bytes = F.octet_length("value") - F.octet_length(F.ltrim("value"))
    body = F.trim("value")
    return rows.where(F.length(body) > 0).select(
        *keep,
        F.col("k").alias("line_no"),
        (F.col("start") + lead).alias("start"),
        (F.col("start") + lead + F.length(body)).alias("end"),
        (F.col("start_byte") + lead_bytes).alias("start_byte"),
        (F.col("start_byte") + lead_bytes + F.octet_length(body)).alias("end_byte"),
        body.alias("line"),
    )


def punctuation_breaks(docs: DataFrame, version: int = 1, text: str = "text") -> DataFrame:
    """``(doc_id, feature_pos, break_end)`` for terminators that end a sentence by their neighbours.

    Version 1 knows ``.!?`` and ends after the mark; version 2 adds the
    ellipsis and takes closing quotes and brackets into the break. A mark
    between digits is none; the next non-space must be missing, an upper-case
    letter or an opener.
    """
    around = ("left", "right", "after")
    if version == 1:
        rows, opener = spans(docs, "[.!?]", text, around=around, reach=1), r"\"'#*\-"
    else:
        rows, opener = spans(docs, "[.!?…][\"')\\]}”’]*", text, around=around, reach=1), r"\"'#*\-“‘•"
    decimal = F.col("left").rlike("[0-9]") & F.col("right").rlike("[0-9]") & (F.col("end") - F.col("start") == 1)
    good = (F.length("after") == 0) | F.col("after").rlike(rf"^[\p{{Lu}}{opener}]")
    return rows.where(~decimal & good).select("doc_id", F.col("start_byte").alias("feature_pos"), F.col("end_byte").alias("break_end"))


def paragraph_breaks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Starts of white-space runs with two line breaks or more, and the end of the text."""
    runs = F.filter(F.transform(T.locate(text, "[ \\t\\n\\r\\f]*[\\n\\r][ \\t\\f]*[\\n\\r][ \\t\\n\\r\\f]*"), lambda s: s["start_byte"]), lambda p: p >= 0)
    ends = F.array_distinct(F.concat(runs, F.array(F.octet_length(text).cast("long"))))
    return docs.where(F.octet_length(text) > 0).select("doc_id", F.explode(ends).alias("break_end"))


def union_breaks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Punctuation and paragraph breaks, each break once."""
    return punctuation_breaks(docs, 2, text).select("doc_id", "break_end").unionAll(paragraph_breaks(docs, text)).distinct()


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed paragraphs between blank lines: ``(doc_id, k, start, end, value)``."""
    breaks = T.locate(text, "\\n[ \\t\\r]*\\n[ \\t\\r\\n]*")
    zero = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("byte"))
    first = F.concat(F.array(zero), F.transform(breaks, lambda s: F.struct(s["end"].alias("start"), s["end_byte"].alias("byte"))))
    last = F.concat(F.transform(breaks, lambda s: s["start_byte"]), F.array(F.octet_length(text).cast("long")))
    whole = F.struct(F.arrays_zip(first.alias("a"), last.alias("b")).alias("bounds"), F.col(text).cast("binary").alias("raw"))
    cut = lambda w: F.transform(w["bounds"], lambda x: F.struct(x["a"]["start"].alias("start"), T.byte_piece(w["raw"], x["a"]["byte"], x["b"]).alias("value")))
    rows = docs.select("doc_id", F.posexplode(T.let(whole, cut)).alias("k", "s")).select("doc_id", F.col("k").cast("long").alias("k"), "s.start", "s.value")
    lead = F.length("value") - F.length(F.ltrim("value", F.lit(" \t\n\r")))
    body = F.trim("value", F.lit(" \t\n\r"))
    rows = rows.where(F.length(body) > 0)
    return rows.select("doc_id", "k", (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length(body)).alias("end"), body.alias("value"))


def windows(units: DataFrame, least: int, most: int, reach: int) -> DataFrame:
    """Runs of consecutive units ``(doc_id, k, start, end)`` of ``least`` to ``most`` code points, ``reach`` units at most.

    Each unit looks at its next ``reach - 1`` neighbours by ``lead``-like frames, so
    the range join never meets units of other documents or far away.
    """
    other = units.select("doc_id", F.explode(F.sequence(F.greatest(F.col("k") - (reach - 1), F.lit(0)), F.col("k"))).alias("k"), F.col("k").alias("last"), F.col("end").alias("stop"))
    size = F.col("stop") - F.col("start")
    return units.join(other, ["doc_id", "k"]).where(size.between(least, most)).select("doc_id", F.col("k").alias("first"), "last", "start", F.col("stop").alias("end"))


def weak_breaks(docs: DataFrame, abbreviations: tuple[str, ...], text: str = "text", margin: int = 36) -> DataFrame:
    """Breaks for weak labels: a terminal with closers, white space behind, not at the end, no abbreviation before.

    ``marker`` shows the place as ``<<<BREAK>>>`` between ``margin`` characters on either side.
    """
    rows = spans(docs, "[.!?]+[\"')\\]}”’]*", text, around=("value", "left", "right", "after", "word"), reach=margin)
    before = F.right(F.concat("left", "value"), F.lit(margin))
    good = F.col("right").rlike("^[ \\t\\n\\r]") & (F.length("after") > 0) & ~F.lower("word").isin(*abbreviations)
    return rows.where(good).select("doc_id", F.col("end").alias("break_char"), F.col("end_byte").alias("break_end"), F.concat(before, F.lit("<<<BREAK>>>"), F.col("right")).alias("marker"))


def prose_paragraphs(docs: DataFrame, least: int = 1, most: int = 1 << 30, text: str = "text") -> DataFrame:
    """Paragraphs of prose of ``least`` to ``most`` code points: ``(doc_id, k, start, end, value)``."""
    return paragraphs(docs, text).where(Q.paragraph_like(F.col("value")) & (F.col("end") - F.col("start")).between(least, most))


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Logical blocks ``(doc_id, block, start, end, value)``: lines that belong together, in code points.

    A blank line ends a block. A line joins the open block by the types of both: metadata
    and headings stand alone, prose and dialogue join each other and list items.
    The type of a block is that of its whole text so far, so the lines are folded one by one; a text of more
    than ``SETTLED`` characters keeps its type, so a long block isn't looked at again for each of its lines.
    """
    bounds = "struct<start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>"
    big, none = F.lit(0).cast("bigint"), F.lit(None).cast(bounds)
    zero = F.struct(big.alias("at"), big.alias("byte"), big.alias("start"), big.alias("start_byte"), F.lit("").alias("head"), F.lit("").alias("kind"), F.lit(False).alias("settled"), none.alias("done"))
    blank = lambda c: ~c.rlike("[^ \\t\\n\\x0B\\f\\r]")
    kind_of = lambda c: T.let(T.let(F.trim(c, F.lit(T.BLANKS)), Q.display_type), lambda k: F.when(k.isin("prose", "dialogue"), "running").otherwise(k))

    def judged(line: Column) -> Column:
        return F.struct(line.alias("line"), F.length(line).alias("n"), F.octet_length(line).alias("bytes"), blank(line).alias("empty"), kind_of(line).alias("kind"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        """The block that ends before a line is in the state, and comes out with the next line."""
        at, byte = (s["at"] + x["n"]).alias("at"), (s["byte"] + x["bytes"]).alias("byte")
        joins = ~x["empty"] & (x["kind"] == "running") & s["kind"].isin("running", "list")
        same = F.struct(at, byte, s["start"].alias("start"), s["start_byte"].alias("start_byte"), F.lit("").alias("head"), s["kind"].alias("kind"), F.lit(True).alias("settled"), none.alias("done"))

        def other(j: Column, head: Column) -> Column:
            ended = F.struct(s["start"].alias("start"), s["at"].alias("end"), s["start_byte"].alias("start_byte"), s["byte"].alias("end_byte"))
            return F.struct(
                at, byte, F.when(j, s["start"]).otherwise(s["at"]).alias("start"), F.when(j, s["start_byte"]).otherwise(s["byte"]).alias("start_byte"), head.alias("head"),
                F.when(x["empty"], "").when(j, kind_of(head)).otherwise(x["kind"]).alias("kind"), (F.length(F.trim(head, F.lit(T.BLANKS))) > SETTLED).alias("settled"),
                F.when(~j & (s["kind"] != ""), ended).alias("done"),
            )

        def longer(j: Column) -> Column:
            head = F.when(x["empty"], "").when(j, F.concat(s["head"], x["line"])).otherwise(x["line"])
            return F.when(j & s["settled"], same).otherwise(T.let(head, lambda h: other(j, h)))

        return T.let(joins, longer), s["done"]

    flush = F.array(F.lit("\n"), F.lit("\n"))  # the first ends the last block, the second brings it out
    lines = F.concat(F.regexp_extract_all(text, F.lit("[^\\n\\r]*(?:\\r\\n|\\n|\\r)|[^\\n\\r]+"), F.lit(0)), flush)
    found = F.filter(T.scan(F.transform(lines, judged), zero, step, bounds), lambda b: b.isNotNull())
    cut = lambda raw: F.transform(found, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), T.byte_piece(raw, b["start_byte"], b["end_byte"]).alias("value")))
    rows = docs.select("doc_id", F.posexplode(T.let(F.col(text).cast("binary"), cut)).alias("block", "b"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), "b.start", "b.end", "b.value")


def line_windows(lines: DataFrame, anchors: DataFrame, above: int = 3, below: int = 4, least: int = 1, most: int = 2000) -> DataFrame:
    """Distinct runs of lines around anchor lines: up to ``above`` before and ``below`` behind, within a size.

    ``lines`` is ``(doc_id, line_no, start, end)``; anchors are ``(doc_id, line_no)``. Every anchor names its
    few neighbours, so both ends meet by equi-joins.
    """
    at = anchors.select("doc_id", "line_no", F.explode(F.expr(f"sequence(greatest(line_no - {above}, 0L), line_no)")).alias("first"))
    at = at.select("doc_id", "first", F.explode(F.expr(f"sequence(line_no, line_no + {below}L)")).alias("last")).distinct()
    a = lines.select("doc_id", F.col("line_no").alias("first"), "start")
    b = lines.select("doc_id", F.col("line_no").alias("last"), "end")
    return at.join(a, ["doc_id", "first"]).join(b, ["doc_id", "last"]).where((F.col("end") - F.col("start")).between(least, most)).select("doc_id", "first", "last", "start", "end")


def list_blocks(lines: DataFrame) -> DataFrame:
    """A list item's line with the indented lines that follow it; a blank line ends it. ``lines``: ``(doc_id, line_no, raw, start, end)``, blank ones too."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    item, indented = T.list_like("raw"), F.col("raw").rlike("^[ \\t]+[^ \\t]")
    plain = ~item & ~indented
    head = F.sum((item | plain).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = lines.withColumn("block", head).withColumn("item", item).groupBy("doc_id", "block")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("lines"), F.max("item").alias("item")).where("item").drop("item", "block")


def chunks(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Chunks of whole lines, ``most`` code points at most: ``(doc_id, chunk, start, value)``; a longer line is cut.

    A greedy fold over a document's lines in the row: a line joins the open chunk
    if it fits, else opens the next.
    """
    rows = docs.select("doc_id", F.col(text).alias("text")).where(F.length("text") > 0)
    raw = F.regexp_extract_all("text", F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))
    cut = F.transform(raw, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda k: F.substring(x, k * most + 1, F.lit(most))))
    pieces = F.flatten(cut)
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state, piece):
        fits = F.length(state["open"]) + F.length(piece) <= most
        return F.when(fits, F.struct(F.concat(state["open"], piece).alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(piece.alias("open"), F.concat(state["done"], F.array(state["open"])).alias("done"))
        )

    state = F.aggregate(pieces, zero, step)
    out = rows.select("doc_id", F.posexplode(F.concat(state["done"], F.array(state["open"]))).alias("chunk", "value"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk")
    size = F.length("value")
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.sum(size).over(w) - size).cast("long").alias("start"), "value")
