"""Decoders (§2.7): scores at ordered positions become spans, by windows over one document's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import text as T


def threshold_spans(scored: DataFrame, sizes: DataFrame, threshold: float, tail: bool = True) -> DataFrame:
    """Spans that end behind each position with ``score >= threshold``; the rest of the text is a span too if ``tail``.

    ``scored`` is ``(doc_id, break_end, score)``, ``sizes`` ``(doc_id, size)``.
    """
    order = Window.partitionBy("doc_id").orderBy("end")
    ends = scored.where(F.col("score") >= threshold).select("doc_id", F.col("break_end").alias("end"))
    if tail:
        ends = ends.unionAll(sizes.select("doc_id", F.col("size").alias("end"))).distinct()
    return ends.withColumn("start", F.lag("end", 1, 0).over(order)).where("start < end").select("doc_id", "start", "end")


def argmax(scores: str = "scores"):
    """Index of the first largest score; an empty or all-null row raises."""
    best = F.array_max(scores)
    return F.when(best.isNotNull(), F.array_position(F.col(scores), best) - 1).otherwise(F.raise_error(F.lit("no score")).cast("bigint"))


def runs(rows: DataFrame, label: str = "label", order: str = "position", by: tuple[str, ...] = ("doc_id",), gap: str | None = None) -> DataFrame:
    """``rows`` with ``run``: numbers runs of equal labels; ``gap`` is a condition on ``previous_*`` columns that also breaks."""
    w = Window.partitionBy(*by).orderBy(order)
    change = ~F.col(label).eqNullSafe(F.lag(label).over(w))
    if gap:
        change = change | F.expr(gap)
    return rows.withColumn("run", F.sum(change.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def contiguous_spans(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Maximal runs of one label: from the first position to the next run's, the last to the text's end; best and mean score."""
    grouped = runs(rows).groupBy("doc_id", "run", "label").agg(F.min("position").alias("start"), F.max("score").alias("score"), F.avg("score").alias("mean"))
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("run"))
    spans = grouped.withColumn("next", after).join(sizes, "doc_id")
    return spans.select("doc_id", "label", "start", F.coalesce("next", "size").alias("end"), "score", "mean")


def line_runs(lines: DataFrame, threshold: float, gap: int = 2) -> DataFrame:
    """Structure spans: neighbouring lines of one label at or above the threshold, ``gap`` bytes apart at most.

    ``lines`` is ``(doc_id, label, line_no, start, end, score)``. A line below
    the threshold ends a run.
    """
    w = Window.partitionBy("doc_id", "label").orderBy("line_no")
    good = F.col("score") >= threshold
    fresh = good & ~(F.coalesce(F.lag(good).over(w), F.lit(False)) & (F.col("start") - F.lag("end").over(w) <= gap))
    marked = lines.withColumn("run", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(good)
    return marked.groupBy("doc_id", "label", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("run")


def as_of(positions: DataFrame, scores: DataFrame, on: str = "position", value: str = "score") -> DataFrame:
    """The last score at or before each position, by one window over the union of both: no range join."""
    both = positions.select("doc_id", on, F.lit(1).alias("side"), F.lit(None).cast("double").alias(value)).unionByName(
        scores.select("doc_id", on, F.lit(0).alias("side"), F.col(value).cast("double").alias(value))
    )
    w = Window.partitionBy("doc_id").orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")


#: Shares of the end's score, of the next start's and of the drop of being inside, in a fused score; least thresholds (fixed values).
FUSED, LEAST_END, LEAST_BREAK, OF_END = (0.70, 0.20, 0.10), 0.01, 0.08, 0.55


def fused_breaks(candidates: DataFrame, scores: DataFrame, end_threshold: float = 0.20) -> DataFrame:
    """``(doc_id, end, score, selected)`` of candidates ``(doc_id, end, next_start)`` from scores ``(doc_id, position, inside, starts, ends)``.

    A break's score takes the end's, the next start's and how far being inside drops between the byte before the
    end and the next start. Each is the last score at or before its place, or a
    document's first one; a null ``next_start`` counts 0. All lookups are one window over a document.
    """
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), at.cast("long").alias("at")) for k, at in enumerate((F.col("end"), F.greatest(F.col("end") - 1, F.lit(0)), F.col("next_start")))]))
    asked = candidates.select("doc_id", "end", places.alias("p")).where("p.at is not null")
    kind = "struct<inside:double,starts:double,ends:double>"
    known = scores.select("doc_id", F.col("position").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("int").alias("what"), F.struct(*[F.col(c).cast("double").alias(c) for c in ("inside", "starts", "ends")]).cast(kind).alias("s"))
    both = known.unionByName(asked.select("doc_id", "p.at", F.lit(1).alias("side"), F.col("end").cast("long").alias("end"), "p.what", F.lit(None).cast(kind).alias("s")))
    w = Window.partitionBy("doc_id").orderBy("at", "side")
    last = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = both.withColumn("s", F.coalesce(last, first)).where("side = 1")
    of = lambda what, c: F.coalesce(F.max(F.when(F.col("what") == what, F.col(f"s.{c}"))), F.lit(0.0))
    parts = found.groupBy("doc_id", "end").agg(of(0, "ends").alias("e"), of(2, "starts").alias("n"), F.greatest(of(1, "inside") - of(2, "inside"), F.lit(0.0)).alias("d"))
    score = FUSED[0] * F.col("e") + FUSED[1] * F.col("n") + FUSED[2] * F.col("d")
    limit = max(OF_END * max(end_threshold, LEAST_END), LEAST_BREAK)
    return parts.select("doc_id", "end", score.alias("score")).withColumn("selected", F.col("score") >= limit)


def unit_spans(units: DataFrame) -> DataFrame:
    """Neighbouring units of one label merged; ``none`` breaks and is left out. ``units``: ``(doc_id, k, label, start, end)``."""
    merged = runs(units, order="k").groupBy("doc_id", "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("units"))
    return merged.where("label <> 'none'").drop("run")


def line_runs_loose(lines: DataFrame, threshold: float, gap: int = 2, least: int = 1) -> DataFrame:
    """The trainer's variant of ``line_runs``: a line below the threshold doesn't end a run, only a gap does; short spans go."""
    w = Window.partitionBy("doc_id", "label").orderBy("line_no")
    good = lines.where(F.col("score") >= threshold)
    far = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    runs = good.withColumn("run", F.sum(far.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "label", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    return out.where(F.col("end") - F.col("start") >= least).drop("run")


def breaks_within(parents: DataFrame, breaks: DataFrame) -> DataFrame:
    """Sentences of each parent span ``(doc_id, k, start, end)`` between its breaks ``(doc_id, break_char)``; the rest is one too.

    Parents don't overlap, so a break's parent is the last one that starts before it.
    """
    starts = parents.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), "k", "start", "end")
    marks = breaks.select("doc_id", F.col("break_char").alias("at"), F.lit(1).alias("side"), *[F.lit(None).cast("long").alias(c) for c in ("k", "start", "end")])
    w = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("side") == 0, F.struct("k", "start", "end")), ignorenulls=True).over(w)
    inside = starts.unionByName(marks).withColumn("owner", owner).where("side = 1 and at < owner.end and at > owner.start")
    cuts = inside.select("doc_id", F.col("owner.k").alias("k"), F.col("owner.start").alias("start"), "at").unionAll(parents.select("doc_id", "k", "start", F.col("end").alias("at")))
    order = Window.partitionBy("doc_id", "k").orderBy("at")
    return cuts.select("doc_id", "k", F.coalesce(F.lag("at").over(order), "start").alias("start"), F.col("at").alias("end")).where("start < end")


#: A scored mark: where it ends in bytes and code points, the first non-blank byte behind it (or the end), and its score.
MARK = "struct<break_end:bigint,break_char:bigint,resume:bigint,score:double>"


def best_of_clusters(marks: Column, threshold: float) -> Column:
    """Of an array of ``MARK`` in order, the best of each cluster.

    Marks of ``threshold`` or more form clusters: one joins the open cluster if
    it ends where that resumes or before. The highest score stays, of equal ones
    the first. A fold over the row's marks; a null array gives null.
    """
    none = F.lit(None).cast(f"struct<mark:{MARK},reach:bigint>")

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        inside = F.coalesce(x["break_end"] <= state["reach"], F.lit(False))
        better = x["score"] > state["mark"]["score"]
        longer = F.struct(F.when(better, x).otherwise(state["mark"]).alias("mark"), F.greatest(state["reach"], x["resume"]).alias("reach"))
        opened = F.when(x.isNotNull(), F.struct(x.alias("mark"), x["resume"].alias("reach")))
        return F.when(inside, longer).otherwise(opened), F.when(~inside, state["mark"])

    good = F.concat(F.filter(marks, lambda m: m["score"] >= threshold), F.array(F.lit(None).cast(MARK)))  # the last one flushes
    return F.filter(T.scan(good, none, step, MARK), lambda m: m.isNotNull())


def spans_between(text: Column, ends: Column) -> Column:
    """Spans ``text.SPAN`` of a text from the first non-blank behind one end to the next end, in an array of ``MARK``; blanks at either end go, empty spans too."""
    raw = text.cast("binary")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("char"))

    def step(state: Column, m: Column) -> tuple[Column, Column]:
        whole = F.struct(state["at"].alias("at"), state["char"].alias("char"), m["break_end"].alias("end"))
        return F.struct(m["break_end"].alias("at"), m["break_char"].alias("char")), whole

    def trimmed(s: Column) -> Column:
        def span(x: Column) -> Column:
            start, first = s["at"] + x["lead"], s["char"] + x["lead"]  # blanks are single bytes
            return F.when(
                x["chars"] > 0, F.struct(first.alias("start"), (first + x["chars"]).alias("end"), start.alias("start_byte"), (start + x["bytes"]).alias("end_byte"))
            )

        def measured(b: Column) -> Column:
            return F.struct((F.octet_length(b["whole"]) - F.octet_length(b["behind"])).alias("lead"), F.length(b["body"]).alias("chars"), F.octet_length(b["body"]).alias("bytes"))

        blanks = F.lit(T.BLANKS)
        parts = T.let(T.byte_piece(raw, s["at"], s["end"]), lambda w: T.let(F.ltrim(w, blanks), lambda v: F.struct(w.alias("whole"), v.alias("behind"), F.rtrim(v, blanks).alias("body"))))
        return T.let(T.let(parts, measured), span)

    found = F.transform(T.scan(ends, zero, step, "struct<at:bigint,char:bigint,end:bigint>"), trimmed)
    return F.filter(found, lambda x: x.isNotNull())
