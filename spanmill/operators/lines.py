"""The lines of a text with their neighbours, and what a line says about candidates in it. All stays inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import marks as K
from spanmill.functions import text as T

#: White space, Unicode's included, as a regex class.
SPACE = "[\\s\\x0B\\x85\\p{Z}]"
_LINE = "struct<start_byte:bigint,previous:string,before:int,raw:string>"


def bare(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.regexp_replace(line, f"^{SPACE}+|{SPACE}+\\z", "")


def _blank(line: Column) -> Column:
    return F.length(bare(line)) == 0


def line_array(text: str | Column) -> Column:
    """Every line of a text, blank ones too, as an array.

    Lines end at ``\\n`` or ``\\r``. Each has its ``raw`` text, its ``start_byte``, the last line before it that isn't
    empty (``previous``), the line directly behind it, which may be empty
    (``following``), and the line breaks in the white space before its start
    (``before``) and behind its end (``after``).
    """

    def build(raws: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("b"), F.lit("").alias("previous"), F.lit(0).alias("before"))

        def forward(state: Column, raw: Column) -> tuple[Column, Column]:
            out = F.struct(state["b"].alias("start_byte"), state["previous"].alias("previous"), state["before"].alias("before"), raw.alias("raw"))
            before = F.when(_blank(raw), state["before"] + 1).otherwise(1)
            return F.struct((state["b"] + F.octet_length(raw) + 1).alias("b"), F.when(F.length(raw) > 0, raw).otherwise(state["previous"]).alias("previous"), before.alias("before")), out

        def backward(state: Column, raw: Column) -> tuple[Column, Column]:
            return F.when(_blank(raw), state + 1).otherwise(1), state

        after = F.reverse(T.scan(F.reverse(raws), F.lit(0), backward, "int"))
        following = F.concat(F.slice(raws, 2, F.size(raws)), F.array(F.lit("")))
        joined = F.arrays_zip(T.scan(raws, zero, forward, _LINE).alias("line"), after.alias("after"), following.alias("following"))
        return F.transform(
            joined,
            lambda x: F.struct(
                x["line"]["raw"].alias("raw"), x["line"]["start_byte"].alias("start_byte"), x["line"]["previous"].alias("previous"), x["following"].alias("following"),
                x["line"]["before"].alias("before"), x["after"].alias("after"),
            ),
        )

    return T.let(F.split(T.col(text), "[\\n\\r]", -1), build)


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, position, size, raw, start_byte, previous, following, before, after)`` for each line that isn't blank.

    ``position`` is the byte of its first non-blank, ``size`` the text's bytes; ``line_no`` counts all lines.
    """
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("size"), F.posexplode(line_array(text)).alias("line_no", "x"))
    rows = rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "size", "x.*").where(~_blank(F.col("raw")))
    lead = F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", f"^{SPACE}+", ""))
    return rows.withColumn("position", (F.col("start_byte") + lead).cast("long"))


def line_of(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """``positions`` ``(doc_id, position)`` in bytes with the line that holds each: ``line_start``, ``line_end`` and ``line``.

    An as-of lookup over both, one window for each document; a position on a line break belongs to the line it ends.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines.select("doc_id", F.col("start_byte").alias("at"), F.lit(0).alias("kind"), F.struct("start_byte", "raw").alias("l"))
    asked = positions.select("doc_id", F.col("position").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<start_byte:bigint,raw:string>").alias("l"))
    found = own.unionByName(asked).withColumn("l", F.last("l", ignorenulls=True).over(w)).where("kind = 1")
    end = F.col("l.start_byte") + F.octet_length("l.raw")
    return found.select("doc_id", F.col("at").alias("position"), F.col("l.start_byte").alias("line_start"), end.cast("long").alias("line_end"), F.col("l.raw").alias("line"))


_FLAGS = "heading:boolean,list:boolean,metadata:boolean,next_heading:boolean,next_list:boolean,line_breaks_before:int"


def with_line_flags(text: Column, marks: Column, kind: str) -> Column:
    """``marks`` (an array of structs of type ``struct<kind>`` with ``start_byte``) with flags of the line each stands in and of the next.

    Lines and marks are events in the order of their bytes; the fold carries the line's flags to its marks.
    """

    def flags(x: Column) -> Column:
        tests = {"heading": T.heading_like(x["raw"]), "list": T.list_like(x["raw"]), "metadata": T.metadata_colon(x["raw"]), "next_heading": T.heading_like(x["following"]), "next_list": T.list_like(x["following"])}
        return F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in tests.items()], x["before"].alias("line_breaks_before"))

    none = lambda t: F.lit(None).cast(t)
    line_events = F.transform(line_array(text), lambda x: F.struct(x["start_byte"].alias("at"), F.lit(0).alias("order"), flags(x).alias("f"), none(f"struct<{kind}>").alias("m")))
    mark_events = F.transform(marks, lambda m: F.struct(m["start_byte"].alias("at"), F.lit(1).alias("order"), none(f"struct<{_FLAGS}>").alias("f"), m.alias("m")))

    def step(state: Column, e: Column) -> tuple[Column, Column]:
        here = F.coalesce(e["f"], state)
        return here, F.when(e["order"] == 1, F.struct(e["m"].alias("m"), here.alias("f")))

    ordered = F.array_sort(F.concat(line_events, mark_events))
    return F.filter(T.scan(ordered, none(f"struct<{_FLAGS}>"), step, f"struct<m:struct<{kind}>,f:struct<{_FLAGS}>>"), lambda x: x.isNotNull())


def rest_of_line_counts(text: str | Column, pattern: str, chars: str) -> Column:
    """For each match the share of every ASCII character of ``chars`` in the bytes from its start to the next ``\\n``.

    Matches and line feeds are folded from the end of the text on, so a long line costs its own length.
    """
    if K.PLAIN.fullmatch(pattern) and "^" not in pattern and "\\n" not in pattern and chars and chars.isascii():
        return K.rest_of_line_shares(T.col(text), pattern, chars)
    both = f"(?:{pattern})|\\n"

    def build(p: Column) -> Column:
        n = F.size(p["found"])
        items = F.reverse(F.arrays_zip(p["found"].alias("m"), F.slice(p["gaps"], 2, n).alias("a")))
        zero = F.struct(F.array(*[F.lit(0)] * len(chars)).alias("counts"), F.lit(0).alias("size"))

        def counted(x: Column) -> Column:
            counts = lambda piece: F.array(*[F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit(ch), F.lit(""))) for ch in chars])
            own = T.let(F.concat(x["m"], x["a"]), lambda piece: F.struct(counts(piece).alias("counts"), F.octet_length(piece).alias("size")))
            return F.struct(own.alias("own"), (x["m"] == "\n").alias("feed"))

        def step(state: Column, x: Column) -> tuple[Column, Column]:
            counts = F.zip_with(state["counts"], x["own"]["counts"], lambda a, b: a + b)
            longer = F.struct(counts.alias("counts"), (state["size"] + x["own"]["size"]).alias("size"))
            return F.when(x["feed"], zero).otherwise(longer), F.when(~x["feed"], longer)

        sums = F.filter(T.scan(F.transform(items, counted), zero, step, "struct<counts:array<int>,size:int>"), lambda x: x.isNotNull())
        return F.reverse(F.transform(sums, lambda x: F.transform(x["counts"], lambda c: c / F.greatest(x["size"], F.lit(1)))))

    text = T.col(text)
    return T.let(F.struct(F.regexp_extract_all(text, F.lit(both), F.lit(0)).alias("found"), F.split(text, both, -1).alias("gaps")), build)
