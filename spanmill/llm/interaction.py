"""How the filters of a corpus interact: every order of them, from counts of failure masks.

A document's mask has a bit for each filter that it fails. What any order of
the filters removes at any step depends on masks only, so the corpus is counted
once, by part and mask. All orders are then visited by swaps of neighbours
(Steinhaus, Johnson, Trotter): a swap changes two steps, which are counted anew
from the mask cells; the other steps carry over. Each filter's removals, added
up along the walk, are its Shapley value times the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import discard, durable

#: Filters at most: eight have 40,320 orders.
MAX_FILTERS = 8
#: Rows of a part's report that a task holds, times the parts it walks at once.
HELD_ROWS = 400_000
WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: few words, few distinct words, many capitals, symbols of markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(
    docs: DataFrame, labels: DataFrame, filters=text_filters, repeated: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """``(id, part, mask, good, toxic)`` for each row of ``docs``.

    ``filters`` gives named failure conditions of a text column, in the order of
    the mask's bits; the filter ``repeated``, the last bit, fails every text
    that some smaller id has too, table-wide. A null text is empty, a null part
    is the empty one, a condition that is null isn't a failure. A null id has no labels, isn't
    smaller than any other and has none that is; rows that share an id and a text don't repeat each other. A document is good
    (toxic) if any row of ``labels`` under its id says 1.

    Only digests, ids and masks are shuffled. First ids and labels are tables
    before rows meet them, so a text or id of very many rows is a skewed join
    that Spark splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = filters(F.col("text"))
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << k).otherwise(0) for k, fails in enumerate(named.values())]
    mask = sum(bits, F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = durable(rows.select("id", "part", mask.alias("mask"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "masks")
    if repeated:
        first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
        first = durable(first, "first")
        again = F.when(F.col("id") > F.col("first"), 1 << len(named)).otherwise(0)
        rows = rows.join(first, "digest", "left").select("id", "part", (F.col("mask") + again).alias("mask"))
    of = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = durable(of.where("good = 1 or toxic = 1"), "judged")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.join(of, "id", "left").select("id", "part", "mask", flag("good"), flag("toxic"))


def neighbour_swaps(n: int) -> Iterator[int]:
    """Positions ``i`` such that swapping places ``i`` and ``i + 1``, one after the other, visits all orders of ``n`` things once."""
    order, ahead = list(range(n)), [False] * n
    while True:
        for thing in range(n - 1, -1, -1):  # the largest that can move; those above it turn
            at = order.index(thing)
            to = at + (1 if ahead[thing] else -1)
            if 0 <= to < n and order[to] < thing:
                break
            ahead[thing] = not ahead[thing]
        else:
            return
        order[at], order[to] = order[to], order[at]
        yield min(at, to)


def walk(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orders, what each of their steps removes, and what each filter removes over all orders.

    ``cells`` is ``(parts, 3, 2**n)``: documents, good ones and toxic ones of
    each mask. Returns ``(orders, n)`` filters, ``(orders, n, parts, 3)``
    removals and ``(n, parts)`` sums of removed documents.
    """
    number = np.arange(1 << n)

    def removed(earlier: int, own: int) -> np.ndarray:
        return cells[:, :, (number & earlier == 0) & (number >> own & 1 == 1)].sum(axis=2)

    order, earlier, steps = list(range(n)), 0, []
    for own in order:
        steps.append(removed(earlier, own))
        earlier |= 1 << own
    share = np.array([s[:, 0] for s in steps])  # what each filter removes in the order at hand
    shapley = share.copy()
    orders, walked = [tuple(order)], [list(steps)]
    for i in neighbour_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        earlier = sum(1 << own for own in order[:i])
        for k in (i, i + 1):
            steps[k] = removed(earlier, order[k])
            share[order[k]] = steps[k][:, 0]
            earlier |= 1 << order[k]
        shapley += share
        orders.append(tuple(order))
        walked.append(list(steps))
    return np.array(orders, np.int64).reshape(-1, n), np.array(walked), shapley


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` for rows ``(part, cells)``, a few parts at a time."""
    n = len(names)
    orders = int(np.prod(np.arange(1, n + 1)))
    at_once = max(1, HELD_ROWS // (orders * n))
    number = np.arange(1 << n)
    for at in range(0, batch.num_rows, at_once):
        piece = batch.slice(at, at_once)
        parts = piece.num_rows
        cells = np.zeros((parts, 3, 1 << n), np.int64)
        for row, found in enumerate(piece.column(1).to_pylist()):
            for cell in found:
                cells[row, :, cell["mask"]] += cell["n"], cell["good"], cell["toxic"]
        visited, removals, shapley = walk(cells, n)
        removed = removals[..., 0]
        total = cells[:, 0].sum(axis=1)
        fails = np.array([cells[:, 0, number >> k & 1 == 1].sum(axis=1) for k in range(n)])
        alone = np.array([cells[:, 0, 1 << k] for k in range(n)])
        columns = [total - removed.cumsum(axis=1), removed, fails[visited] - removed, alone[visited], removals[..., 1], removals[..., 2], shapley[visited]]
        named = ["".join(names[k] for k in order) for order in visited]
        shape = removed.shape  # orders, steps, parts
        step, part = (np.broadcast_to(x, shape).ravel() for x in (np.arange(1, n + 1, dtype=np.int32)[:, None], np.arange(parts)))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0).take(pa.array(part)), pa.array(np.repeat(np.array(named, object), n * parts)), pa.array(step), *(pa.array(c.ravel()) for c in columns)],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )


def audit(
    docs: DataFrame, labels: DataFrame, filters=text_filters, repeated: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """One row of ``SCHEMA`` for each part, order of the filters and step, zeros included.

    Orders are the filters' names, applied left to right. ``removed`` counts
    the part's documents that the step takes away, ``kept`` those that are left
    behind it, ``redundant`` those that fail its filter and went earlier,
    ``unique_fails`` those that fail no other, ``good_lost`` and ``toxic_lost``
    the labelled ones it takes; ``shapley`` is what its filter removes in all
    orders together. Nulls are as in ``masks``; an empty table has no part and
    gives no row. More than ``MAX_FILTERS`` filters are refused.
    """
    names = [*filters(F.col("text")), *([repeated] if repeated else [])]
    if len(names) > MAX_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; {MAX_FILTERS} at most")
    rows = masks(docs, labels, filters, repeated, id_col, text_col, part_col)
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters cells at most

    def scan(batches):
        for batch in batches:
            yield from report(batch, names)

    return parts.mapInArrow(scan, SCHEMA)
