"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import durable

WEIGHTS = (3, 1, 2)
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight. That has one solution:
    ``target = least(cap, level * weight)``, where ``level`` is found on the
    sources ordered by cap over weight. Only one row for each source is ordered.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = levels.withColumn("final", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(whole))
    target = F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return final.select("source", "source_size", target.alias("target"))


#: Above this many sources their targets aren't broadcast but joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _name(id_col: str, text_col: str) -> Column:
    """What a row's draw depends on: its id, or its text where it has none."""
    return F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _copies(rows: DataFrame, sizes: DataFrame, name: Column, source_col: str, seed: str, rates: dict) -> DataFrame:
    """``rows`` with their source's ``source_size`` and ``target`` and their own ``copies``."""
    targets = durable(source_targets(sizes, **rates).withColumnRenamed("source", "__of"), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return rows.join(targets, F.col(source_col).eqNullSafe(F.col("__of")), "left").withColumn("__copies", copies)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), _name(id_col, text_col).alias("name"), F.col(source_col).alias("source"), size.alias("size"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **rates) -> DataFrame:
    """``(id, size, source_size, target, copies)`` for each row of ``docs``.

    A document is taken floor(rate) times, rate being its source's target over
    the source's size, plus once more if a hash of its id, seeded, falls below
    the fraction of the rate: reruns agree, and no rate is above ``most``.
    A null text has size 0; a source of size 0 has target 0 and its documents
    are not taken; a null source is a source of its own; rows that share an id
    and a source share the draw, and so do rows without an id that share a text;
    an empty table gives an empty result.
    """
    sizes = durable(_sizes(docs, id_col, text_col, source_col), "sizes")
    return _copies(sizes, sizes, F.col("name"), "source", seed, rates).select("id", "size", "source_size", "target", F.col("__copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **rates) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan_mix`` takes it; texts aren't shuffled."""
    taken = _copies(docs, _sizes(docs, id_col, text_col, source_col), _name(id_col, text_col), source_col, seed, rates)
    repeated = F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).otherwise(F.array().cast("array<bigint>")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], repeated.alias("__copy")).drop("__copy")


#: The same in DuckDB's SQL, for the default parameters.
ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
final AS (SELECT min_by(level, cap / weight) FILTER (level * weight <= cap) AS level FROM levels),
targets AS (
  SELECT l.source, l.source_size, least(l.cap, coalesce(f.level * l.weight, l.cap)) AS target FROM levels l, final f),
rates AS (
  SELECT s.doc_id, s.name, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates
"""
