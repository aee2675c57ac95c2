"""The segmenter (§2.11): candidates, features, scores, decoding, merging and rendering as one lazy plan."""

from __future__ import annotations

import itertools
import json
import math
import os
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import marks as K
from spanmill.functions import predicates as Q
from spanmill.functions import text as T
from spanmill.operators import candidates as C
from spanmill.operators import decode as D
from spanmill.operators import models as M
from spanmill.operators import nets
from spanmill.operators import spans as R
from spanmill.operators.kernels import Kernel, SpecError, compile_kernel
from spanmill.sources import bundles, generate

#: Fixed model: space behind, end of text behind, digit behind, lower case behind, short capital before. Multiples of 1/2.
WEIGHTS = [3.0, 3.0, -4.0, -2.5, -2.5]
BIAS = -1.0
THRESHOLD = 0.5


def _is_break(m: Column, threshold: float | None = None) -> Column:
    """Score of a mark by its surroundings, or whether that is at least ``threshold``."""
    right, after = m["right"], m["after"]
    tests = [right.rlike("^[ \\t\\n\\r]"), F.length(right) == 0, right.rlike("^[0-9]"), right.rlike("^[ \\t\\n\\r]") & after.rlike("^[a-z]"), F.right(m["left"], F.lit(4)).rlike("(?:^|[^A-Za-z])[A-Z][a-z]?\\z")]
    z = F.lit(BIAS)
    for test, weight in zip(tests, WEIGHTS, strict=True):
        z = z + F.when(test, weight).otherwise(0.0)
    return M.sigmoid(z) if threshold is None else M.sigmoid(z) >= threshold


def is_break(left: str, right: str, after: str, threshold: float = THRESHOLD) -> bool:
    """The same for one mark, from the characters before it, the one behind it and the first non-blank behind it."""
    tests = [right and right in T.BLANKS, not right, right.isascii() and right.isdigit(), right and right in T.BLANKS and re.match("[a-z]", after), re.search(r"(?:^|[^A-Za-z])[A-Z][a-z]?\Z", left)]
    z = BIAS + sum(w for test, w in zip(tests, WEIGHTS, strict=True) if test)
    return 1 / (1 + math.exp(-z)) >= threshold


AROUND = ("left", "right", "after")


def score(docs: DataFrame, pattern: str = "[.!?]") -> DataFrame:
    """``(doc_id, break_end, break_char, score)`` for each mark, by a logistic model over its context."""
    rows = docs.select("doc_id", F.explode(T.locate("text", pattern, AROUND, 4)).alias("m"))
    return rows.select("doc_id", F.col("m.end_byte").alias("break_end"), F.col("m.end").alias("break_char"), _is_break(F.col("m")).alias("score"))


def sentence_finder(threshold: float = THRESHOLD, careful: bool = False) -> Callable[[str, list[int]], tuple[list[int], list[int]]]:
    """What gives the starts and ends of a text's sentences from the ends of its marks, in code points; a mark is judged as by ``_is_break``, whose tests have 32 outcomes in all."""
    good = {}
    for tests in itertools.product((False, True), repeat=len(WEIGHTS)):
        z = BIAS + sum(w for test, w in zip(tests, WEIGHTS, strict=True) if test)
        good[tests] = (1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))) >= threshold
    behind, short, blanks = re.compile("([ \t\n\r]*)(.?)", re.DOTALL), re.compile(r"(?:^|[^A-Za-z])[A-Z][a-z]?\Z"), re.compile("[ \t\n\r]*")

    def find(text: str, marks: list[int]) -> tuple[list[int], list[int]]:
        starts, ends, last = [], [], 0
        for e in marks:
            blank, after = behind.match(text, e).groups()
            tests = (bool(blank), not blank and not after, not blank and "0" <= after <= "9", bool(blank) and "a" <= after <= "z")
            if good[*tests, False] == good[*tests, True]:
                ends_here = good[*tests, False]
            else:
                ends_here = good[*tests, bool(short.search(text[max(0, e - 5) : e - 1]))]
            if ends_here and not (careful and text[e - 1] == "." and Q.is_false_boundary(text[max(0, e - 33) : e - 1], text[e : e + 32])):
                starts.append(blanks.match(text, last).end())
                ends.append(last := e)
        return starts, ends

    return find


def sentence_chooser(threshold: float = THRESHOLD, careful: bool = False) -> Callable[[K.Places], np.ndarray]:
    """``sentence_finder`` for all marks of a slice at once: which of them end a sentence."""
    good = np.zeros(32, bool)
    for k in range(32):
        z = BIAS + sum(w for i, w in enumerate(WEIGHTS) if k >> i & 1)
        good[k] = (1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))) >= threshold
    codes = np.arange(257)
    blank, digit, lower, upper = np.isin(codes, [9, 10, 13, 32]), (codes >= 48) & (codes <= 57), (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90)
    letter = lower | upper

    def choose(p: K.Places) -> np.ndarray:
        data = np.append(p.data, 0)
        byte = lambda at, inside: np.where(inside, data[np.where(inside, at, 0)], 256)  # noqa: E731  256 stands for nothing

        def before(k: int) -> np.ndarray:
            return byte(p.at - k, p.at - k >= p.low)

        e = p.at + 1
        behind, after = byte(e, e < p.high), p.solid(e, p.high)
        b1, b2, b3 = before(1), before(2), before(3)
        short = upper[b1] & ~letter[b2] | lower[b1] & upper[b2] & ~letter[b3]
        tests = [blank[behind], behind == 256, digit[behind], blank[behind] & lower[byte(after, after < p.high)], short]
        keep = good[sum(t.astype(np.int64) << i for i, t in enumerate(tests))]
        if careful:
            asked = np.flatnonzero(keep & (p.data[p.at] == 46))
            s, e = p.at[asked], e[asked]
            low, high = p.low[asked], p.high[asked]
            left, right = p.pieces(p.before(s, low, 32), s).to_pylist(), p.pieces(e, p.behind(e, high, 32)).to_pylist()
            keep[asked] = ~np.fromiter(map(Q.is_false_boundary, left, right), bool, len(asked))
        return np.flatnonzero(keep)

    return choose


def _sentence_spans(threshold: float, careful: bool = False) -> Column:
    """Array of sentence spans of ``text``: from the first non-blank behind a break to the next break.

    ``careful`` joins what a full stop of an abbreviation, a number or the like would part.
    """

    return K.spans_between(F.col("text"), "[.!?]", sentence_finder(threshold, careful), sentence_chooser(threshold, careful))


def sentences(docs: DataFrame, threshold: float = THRESHOLD, values: bool = True) -> DataFrame:
    """Sentence spans ``(doc_id, start, end, start_byte, end_byte)``, trimmed, and their ``value``; text behind the last break has none.

    Breaks are folded inside the row, so a document is never shuffled.
    """
    found = _sentence_spans(threshold)
    if values:
        raw = F.col("text").cast("binary")
        cut = lambda r: F.transform(r["found"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte"), T.byte_piece(r["raw"], s["start_byte"], s["end_byte"]).alias("value")))
        found = T.let(F.struct(found.alias("found"), raw.alias("raw")), cut)
    return docs.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.*")


def silver_labels(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, spans)``: trimmed sentences of each text for training, joined over full stops that end none, in code points and bytes."""
    return docs.select("doc_id", _sentence_spans(threshold, True).alias("spans"))


#: Kinds of lines that are spans of their own, and their labels.
STRUCTURE = {"heading": "section", "list": "list_item", "metadata": "metadata"}
_LABELLED = "struct<label:string,start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>"


def _lines() -> Column:
    """Array of the non-blank lines of ``text``, trimmed: bounds, label (null for prose) and whether a blank line is before (``apart``)."""

    def trim(s: Column) -> Column:
        lead, body = F.length(s["value"]) - F.length(F.ltrim(s["value"])), F.trim(s["value"])
        kind = Q.display_type(s["value"])
        label = F.coalesce(*[F.when(kind == k, v) for k, v in STRUCTURE.items()])
        apart = F.regexp_count(F.replace(s["gap"], F.lit("\r\n"), F.lit("\n")), F.lit("[\\n\\r]")) >= 2
        return F.struct(
            label.alias("label"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(body)).alias("end"), (s["start_byte"] + lead).alias("start_byte"),
            (s["start_byte"] + lead + F.octet_length(body)).alias("end_byte"), apart.alias("apart"),
        )

    return F.transform(T.locate("text", "[^\\n\\r]*[^ \\t\\n\\r][^\\n\\r]*", ("value", "gap")), trim)


def _structure_spans(lines: Column) -> Column:
    """Neighbouring lines of one label, no blank line between, as one span each; prose has none."""
    lines = F.transform(lines, lambda x: x.dropFields("apart"))
    none = F.lit(None).cast(_LABELLED)
    stop = F.array(F.lit(None).cast(_LABELLED))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        joins = state["label"].eqNullSafe(x["label"]) & (x["start"] - state["end"] <= 2) & state.isNotNull()
        longer = F.struct(state["label"].alias("label"), state["start"].alias("start"), x["end"].alias("end"), state["start_byte"].alias("start_byte"), x["end_byte"].alias("end_byte"))
        return F.when(joins, longer).otherwise(x), F.when(~joins & state["label"].isNotNull(), state)

    return F.filter(T.scan(F.concat(lines, stop), none, step, _LABELLED), lambda s: s.isNotNull())


def _bounded_sentences(lines: Column, marks: Column, threshold: float) -> Column:
    """Sentence spans that begin at a line's start or behind a break and cross neither structure lines nor blank lines.

    Lines and breaks are events in the order of their bytes; the fold holds the open
    sentence's start and where the last line ended.
    """
    at = lambda label, start, end, byte, end_byte, mark, apart: F.struct(byte.alias("at"), F.lit(mark).alias("mark"), label.alias("label"), start.alias("start"), end.alias("end"), end_byte.alias("end_byte"), apart.alias("apart"))
    line_events = F.transform(lines, lambda x: at(x["label"], x["start"], x["end"], x["start_byte"], x["end_byte"], 0, x["apart"]))
    good = F.filter(marks, lambda m: _is_break(m, threshold))
    blank = lambda m: F.when(F.length(m["right"]) > 0, F.length(m["rest"]) - F.length(F.ltrim(m["rest"], F.lit(T.BLANKS)))).otherwise(0)
    mark_events = F.transform(good, lambda m: at(F.lit(None).cast("string"), m["end"] + blank(m), m["end"], m["end_byte"], m["end_byte"], 1, F.lit(False)))
    big = lambda x=None: F.lit(x).cast("bigint")
    zero = F.struct(big().alias("start"), big().alias("start_byte"), big(-9).alias("line_end"), F.lit(False).alias("special"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        is_mark = x["mark"] == 1
        apart = state["special"] | x["label"].isNotNull() | x["apart"] | state["start"].isNull()
        inside = x["start"] < state["line_end"]  # behind this break the line goes on
        start = F.when(is_mark, F.when(inside, x["start"])).when(apart, x["start"]).otherwise(state["start"])
        byte = F.when(is_mark, F.when(inside, x["end_byte"] + x["start"] - x["end"])).when(apart, x["at"]).otherwise(state["start_byte"])
        span = F.struct(F.lit("sentence").alias("label"), state["start"].alias("start"), x["end"].alias("end"), state["start_byte"].alias("start_byte"), x["end_byte"].alias("end_byte"))
        following = F.struct(start.alias("start"), byte.alias("start_byte"), F.when(is_mark, state["line_end"]).otherwise(x["end"]).alias("line_end"), F.when(is_mark, state["special"]).otherwise(x["label"].isNotNull()).alias("special"))
        return following, F.when(is_mark & (state["start"] < x["end"]), span)

    events = F.array_sort(F.concat(line_events, mark_events))
    return F.filter(T.scan(events, zero, step, _LABELLED), lambda s: s.isNotNull())


def annotate(docs: DataFrame, include_sentences: bool = True, include_structure: bool = True, min_span: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, spans, tagged)`` for each document: sentences and structure without crossings, and the tagged text.

    Sentences lie inside one structure line or between such lines, and no
    sentence crosses a blank line, so spans nest. All of it is
    folded inside the row: one narrow plan, no shuffle. A null text has a null
    result, an empty one no spans.
    """
    lines = docs.select("doc_id", "text", _lines().alias("lines"))
    found = []
    if include_structure:
        found.append(_structure_spans(F.col("lines")))
    if include_sentences:
        bounds = F.col("lines") if include_structure else F.transform("lines", lambda x: x.withField("label", F.lit(None).cast("string")))
        found.append(T.let(T.locate("text", "[.!?]", (*AROUND, "rest"), 4), lambda marks: _bounded_sentences(bounds, marks, threshold)))
    spans = F.filter(F.concat(*found), lambda s: s["end"] - s["start"] >= min_span) if found else F.array().cast(f"array<{_LABELLED}>")
    rows = lines.select("doc_id", "text", spans.alias("found"))
    plain = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    kept = F.transform(plain, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")))
    return rows.select("doc_id", kept.alias("spans"), R.tagged_text(F.col("text"), F.col("found"), in_bytes=True).alias("tagged"))


#: Role of the head that judges sentence ends, its label, its kernel and its candidates.
SENTENCE_ROLE, SENTENCE_LABEL = "sentence_boundary", "sentence.end"
SENTENCE_KERNEL = [{"kind": "terminators"}]
TERMINATOR_PATTERN = C.TERMINATOR_PATTERN
#: A trained bundle that comes with the package.
DEFAULT_BUNDLE = f"{os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}/bundles/sentence"


def default_net() -> nets.Net:
    """The sentence net of the package's bundle, from its file."""
    with open(f"{DEFAULT_BUNDLE}/manifest.json", encoding="utf-8") as f:
        path = next(x["path"] for x in json.load(f)["files"] if x["role"] == SENTENCE_ROLE)
    with open(f"{DEFAULT_BUNDLE}/{path}", encoding="utf-8") as f:
        return nets.Net.from_json(f.read())


def _marks(kernel: Kernel) -> Column:
    """Array of a text's candidates: ``break_end, break_char, resume`` and ``x``, the kernel's features."""
    if kernel.inner is None:
        raise SpecError("sentence ends are judged inside a row, by components that can be: terminators, lexicon")

    def judged(m: Column) -> Column:
        get = lambda name: m["value" if name == "here" else name]
        resume = m["end_byte"] + F.octet_length(m["rest"]) - F.octet_length(F.ltrim(m["rest"], F.lit(T.BLANKS)))
        return F.struct(m["end_byte"].alias("break_end"), m["end"].alias("break_char"), resume.alias("resume"), kernel.inner(get).alias("x"))

    return F.transform(T.locate("text", kernel.pattern, ("value", *kernel.around, "rest"), kernel.reach), judged)


def scored_marks(docs: DataFrame, head: bundles.Head) -> DataFrame:
    """``(doc_id, text, marks)``: an array of ``decode.MARK`` for each text, every candidate scored by a bundle's head.

    Features are made in the JVM and scored as a matrix on Arrow batches; marks
    stay in their row, so nothing is shuffled.
    """
    rows = docs.select("doc_id", "text", _marks(head.kernel).alias("m"))
    rows = rows.select("doc_id", "text", F.transform("m", lambda m: m.dropFields("x")).alias("m"), F.transform("m", lambda m: m["x"]).alias("x"))
    rows = nets.with_scores(rows, "x", head.net, "s")
    mark = lambda m, s: F.struct(m["break_end"], m["break_char"], m["resume"], s[0].alias("score")).cast(D.MARK)
    return rows.select("doc_id", "text", F.zip_with("m", "s", mark).alias("marks"))


def bundle_sentences(docs: DataFrame, head: bundles.Head, threshold: float | None = None) -> DataFrame:
    """``(doc_id, spans)``: sentences of each text between the best marks of a sentence head; text behind the last one has none.

    A null text has null spans.
    """
    least = head.thresholds[0] if threshold is None else threshold
    return scored_marks(docs, head).select("doc_id", D.spans_between(F.col("text"), D.best_of_clusters(F.col("marks"), least)).alias("spans"))


def train_sentences(spark: SparkSession, root: str, count: int = 6000, hidden: tuple[int, ...] = (12,), epochs: int = 200, seed: int = 1) -> nets.Fitted:
    """Fit a sentence head on generated texts and put it into the bundle at ``root``."""
    kernel = compile_kernel(SENTENCE_KERNEL, TERMINATOR_PATTERN)
    cases = generate.sentence_cases(spark, count, seed=seed)
    rows = cases.select("doc_id", "text", "ends").withColumn("m", _marks(kernel)).select("ends", F.explode("m").alias("m"))
    rows = rows.select(F.col("m.x").alias("features"), F.array(F.array_contains("ends", F.col("m.break_char")).cast("int")).alias("targets"))
    fitted = nets.fit(rows, hidden, epochs=epochs, rate=0.03, seed=seed)
    bundles.upsert(spark, root, SENTENCE_ROLE, fitted.net, SENTENCE_KERNEL, [SENTENCE_LABEL], {SENTENCE_LABEL: THRESHOLD}, TERMINATOR_PATTERN, digits=4)
    return fitted
