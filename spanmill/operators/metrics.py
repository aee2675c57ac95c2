"""Evaluation (§2.9): confusion counts, sweeps, boundary sets, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(df: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 (0 where undefined) from ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(rows: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Counts at ``score >= threshold`` against ``label = 1`` for each key, with accuracy."""
    hit, gold = F.col("score") >= threshold, F.col("label") == 1
    out = rows.groupBy(*keys).agg(F.count_if(hit & gold).alias("tp"), F.count_if(hit & ~gold).alias("fp"), F.count_if(~hit & gold).alias("fn"), F.count_if(~hit & ~gold).alias("tn"))
    accuracy = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy")
    return prf(out.withColumn("accuracy", accuracy), *keys, "tn", "accuracy")


def sweep(rows: DataFrame, first: int = 5, last: int = 95, *keys: str) -> DataFrame:
    """Counts at every threshold ``first/100 .. last/100``.

    Rows are counted once by the highest grid point they reach; running sums over
    the grid, one row for each step, give all thresholds: no row meets the grid.
    """
    reach = F.least(F.floor(F.col("score") * 100 + 1e-9), F.lit(last)).cast("int")
    step = F.greatest(reach, F.lit(first - 1))
    hist = rows.groupBy(*keys, step.alias("step")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    grid = hist.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(first - 1), F.lit(last))))
    full = grid.join(hist, [*keys, "step"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = full.select(
        *keys, "step", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("fn")
    )
    return prf(out.where(F.col("step") >= first), *keys, "step")


def best_threshold(swept: DataFrame, *keys: str) -> DataFrame:
    """The step of best F1; ties go to precision, then to the lowest."""
    best = F.max_by(F.struct("step", "precision", "recall", "f1"), F.struct(F.round("f1", 9), F.round("precision", 9), -F.col("step"))).alias("best")
    return swept.groupBy(*keys).agg(best).select(*keys, "best.*")


def boundary_scores(predicted: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """Micro precision and recall of span bounds: per document the set of both starts and ends."""
    bounds = lambda df, name: df.select(*keys, "doc_id", F.explode(F.array("start", "end")).alias("at")).distinct().withColumn(name, F.lit(True))
    both = bounds(predicted, "p").join(bounds(gold, "g"), [*keys, "doc_id", "at"], "full")
    p, g = F.coalesce("p", F.lit(False)), F.coalesce("g", F.lit(False))
    return prf(both.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")), *keys)


def parity(left: DataFrame, right: DataFrame, key: str, values: str, most: int = 8) -> DataFrame:
    """The first ``most`` cells in which two feature tables differ: ``(key, column, a, b)``."""
    a = left.select(key, F.posexplode(values).alias("column", "a"))
    b = right.select(key, F.posexplode(values).alias("column", "b"))
    return a.join(b, [key, "column"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).orderBy(key, "column").limit(most)


def marker_breaks(cases: DataFrame) -> DataFrame:
    """Gold breaks of cases ``(id, text, gold_marker)``: behind the first occurrence of each ``;``-separated marker, in code points."""
    marks = F.filter(F.split(F.coalesce("gold_marker", F.lit("")), ";"), lambda m: F.length(m) > 0)
    rows = cases.select("id", "text", F.explode(marks).alias("mark")).withColumn("at", F.instr("text", F.col("mark")))
    return rows.where("at > 0").select("id", (F.col("at") - 1 + F.length("mark")).cast("long").alias("break_char")).distinct()


def internal_breaks(spans: DataFrame, drop_last: bool = True) -> DataFrame:
    """Ends of sentences ``(id, end)`` without each text's last one, which is the end of the text."""
    last = F.max("end").over(Window.partitionBy("id"))
    rows = spans.withColumn("last", last)
    return (rows.where("end < last") if drop_last else rows).select("id", F.col("end").alias("break_char")).distinct()


def break_report(cases: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of breaks over all cases, four digits."""
    both = predicted.withColumn("p", F.lit(True)).join(gold.withColumn("g", F.lit(True)), ["id", "break_char"], "full")
    p, g = F.coalesce("p", F.lit(False)), F.coalesce("g", F.lit(False))
    out = prf(both.agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")))
    return out.select("tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def leaderboard(rows: DataFrame, first: int = 5, last: int = 95) -> DataFrame:
    """One row for each experiment of ``(experiment, part, label, score)``: best F1 in validation and in the first evaluation, best experiments first.

    ``rank`` orders by validation, then by evaluation, then by name.
    """
    swept = sweep(rows.withColumn("key", F.struct("experiment", "part")), first, last, "key")
    best = best_threshold(swept, "key").select("key.experiment", "key.part", "step", "f1")
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    out = best.groupBy("experiment").agg(of("validation", "f1").alias("validation_f1"), of("validation", "step").alias("step"), of("evaluation", "f1").alias("evaluation_f1"))
    order = Window.orderBy(F.desc(F.round("validation_f1", 9)), F.desc(F.round("evaluation_f1", 9)), "experiment")  # a row for each experiment
    return out.withColumn("rank", F.row_number().over(order).cast("long"))
