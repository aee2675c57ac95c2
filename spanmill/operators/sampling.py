"""Splits and samples (§2.10): by hash or by rank, never by a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multipliers of the sampling hash, and their modulus.
_A, _B, _MOD = 48271, 69621, 2**31 - 1


def draw(first: Column, second: Column) -> Column:
    """A number in [0, 1) from two non-negative integers: two steps of a linear congruence, exact in 64 bits."""
    x = (F.pmod(first, F.lit(_MOD)) * _A + F.pmod(second, F.lit(_MOD)) * _B + 12345) % _MOD
    x = (x * _A) % _MOD
    x = (x * _B) % _MOD
    return (x % 10000) / 10000.0


#: Multipliers of the 64-bit sampling hash (fixed values).
_FIRST, _SECOND = 1_146_959_810_393_466_583, 1_099_511_628_211


def hash_draw(index: Column, position: Column, end: Column) -> Column:
    """A number in [0, 1): ``(index * A) ^ (position * B) ^ end`` in wrapping unsigned 64 bits, modulo 10,000.

    Products are taken as decimals of 38 digits, so they don't overflow for numbers below 2**63.
    """
    two64, two63 = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)")

    def product(x: Column, factor: int) -> Column:
        low = F.pmod((x.cast("decimal(19,0)") * F.lit(str(factor)).cast("decimal(19,0)")).cast("decimal(38,0)"), two64)
        return F.when(low >= two63, low - two64).otherwise(low).cast("bigint")

    mixed = product(index, _FIRST).bitwiseXOR(product(position, _SECOND)).bitwiseXOR(end.cast("bigint"))
    unsigned = mixed.cast("decimal(38,0)") + F.when(mixed < 0, two64).otherwise(F.lit(0).cast("decimal(38,0)"))
    return F.pmod(unsigned, F.lit(10000).cast("decimal(38,0)")).cast("int") / 10000.0


def keep_hashed_negatives(rows: DataFrame, rate: float, terminal_rate: float) -> DataFrame:
    """All positives of ``(doc_id, feature_pos, break_end, value, label)``, and negatives whose draw is below the rate (the larger one at ``.!?``)."""
    limit = F.when(F.col("value").isin(".", "!", "?"), F.lit(max(rate, terminal_rate))).otherwise(rate)
    return rows.where((F.col("label") == 1) | (hash_draw(F.col("doc_id"), F.col("feature_pos"), F.col("break_end")) < limit))


def focus_labels(rows: DataFrame, labels: list[str], strategy: str = "round-robin", index: str = "doc_id", seed: int = 0) -> DataFrame:
    """``rows`` with ``labels`` that are asked for and the one in ``focus`` (null for ``all``), in turn or by hash of ``index``."""
    if strategy == "all":
        return rows.withColumns({"labels": F.array(*map(F.lit, labels)), "focus": F.lit(None).cast("string")})
    if strategy == "round-robin":
        at = F.pmod(F.col(index), F.lit(len(labels)))
    elif strategy == "random":
        at = F.floor(draw(F.col(index), F.lit(seed)) * len(labels))
    else:
        raise ValueError(f"unknown label strategy {strategy!r}")
    focus = F.element_at(F.array(*map(F.lit, labels)), (at + 1).cast("int"))
    return rows.withColumn("focus", focus).withColumn("labels", F.array("focus"))


def segments(docs: DataFrame, least: int, most: int, text: str = "text", seed: int = 0, reach: int = 40) -> DataFrame:
    """``(doc_id, start, end, value)``: a hashed piece of ``least`` to ``most`` code points of each longer text, a shorter one whole.

    Both ends move to white space within ``reach`` characters (the start behind it, the end before it) where there is any.
    """
    n = F.length(text)
    size = (least + F.floor(draw(F.col("doc_id"), F.lit(2 * seed)) * (most - least + 1))).cast("int")
    start = F.floor(draw(F.col("doc_id"), F.lit(2 * seed + 1)) * (n - size + 1)).cast("int")
    rows = docs.where(n > 0).select("doc_id", F.col(text).alias("text"), F.when(n > size, start).otherwise(0).alias("a"), F.when(n > size, start + size).otherwise(n).alias("b"))
    head = F.substring("text", F.col("a") + 1, F.lit(reach))
    tail = F.substring("text", F.greatest(F.col("b") - reach, F.col("a")) + 1, F.least(F.lit(reach), F.col("b") - F.col("a")))
    skip = F.length(F.regexp_extract(head, "^[^ \\t\\n\\r]*[ \\t\\n\\r]+", 0))
    cut = F.length(F.regexp_extract(tail, "[ \\t\\n\\r]+[^ \\t\\n\\r]*\\z", 0))
    a, b = F.when(F.col("a") > 0, F.col("a") + skip).otherwise(0), F.when(F.col("b") < F.length("text"), F.col("b") - cut).otherwise(F.col("b"))
    rows = rows.select("doc_id", "text", a.alias("start"), b.alias("end")).where("start < end")
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))


def keep_negatives(rows: DataFrame, rate: float, terminal_rate: float) -> DataFrame:
    """All positives, and negatives whose draw is below the rate (the larger one behind a terminal)."""
    limit = F.when(F.col("terminal"), F.greatest(F.lit(rate), F.lit(terminal_rate))).otherwise(rate)
    return rows.where((F.col("label") == 1) | (draw(F.col("doc_id"), F.col("position")) < limit))


#: A range of the order with at most so many rows is ranked in one task; a larger one is divided anew.
RANGE_ROWS = 100_000
#: Ranges of one division.
RANGES = 1024


def prefix_split(rows: DataFrame, order: str, numerator: int, denominator: int) -> DataFrame:
    """``train``: the first n * numerator / denominator rows of an order of whole numbers, nulls last.

    The cut is found from counts of ranges of the order, a narrower one each
    time, until the range around the cut is small or one value; only its rows
    are ranked. Rows that are equal at the cut are ranked by the spread of
    their tasks: as many as fit are in.
    """
    low, high, n, known = rows.agg(F.min(order), F.max(order), F.count("*"), F.count(order)).first()
    left = n * numerator // denominator
    if left == 0:
        return rows.withColumn("train", F.lit(False))
    if left == n:
        return rows.withColumn("train", F.lit(True))
    key = F.col(order)
    if left >= known:
        before, inside, left, size = key.isNotNull(), key.isNull(), left - known, n - known
    else:
        size = known
        while size > RANGE_ROWS and low < high:
            step = (high - low) // RANGES + 1
            counts = rows.where(key.between(low, high)).groupBy(F.expr(f"CAST((CAST({order} AS DECIMAL(20,0)) - {low}) DIV {step} AS INT)").alias("range")).count()
            for r in sorted(counts.collect()):
                if left < r["count"]:
                    break
                left -= r["count"]
            low, size = low + r["range"] * step, r["count"]
            high = min(high, low + step - 1)
        before, inside = key < low, key.between(low, high)
    if left == 0:
        return rows.withColumn("train", F.coalesce(before, F.lit(False)))
    if size <= RANGE_ROWS:
        ranked = rows.where(inside).withColumn("train", F.row_number().over(Window.orderBy(order)) <= left)
    else:
        ranked = _first_of_equal(rows.where(inside), left)
    return rows.where(~F.coalesce(inside, F.lit(False))).withColumn("train", F.coalesce(before, F.lit(False))).unionByName(ranked)


def _first_of_equal(rows: DataFrame, left: int) -> DataFrame:
    """``train`` for ``left`` of many rows that are equal in the order, by counts of their partitions."""
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    task = F.shiftright("__row", 33)
    counts = dict(sorted(map(tuple, numbered.groupBy(task).count().collect())))
    part, whole = -1, left
    for part, count in counts.items():
        if whole < count:
            break
        whole -= count
    return numbered.withColumn("train", F.col("__row") < F.lit((part << 33) + whole)).drop("__row")


def stratified(rows: DataFrame, key: str, by: str, cap: int) -> DataFrame:
    """``cap`` rows of each stratum by least draw; -1 is all and 0 none."""
    if cap < 0:
        return rows
    w = Window.partitionBy(by).orderBy(draw(F.col(key), F.lit(7)), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("rank")


def repeat_positives(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, with its copy number."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int"))))
