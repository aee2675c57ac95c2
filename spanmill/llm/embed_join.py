"""Exact near-duplicate links between embeddings by a metric range join.

Cosine of at least ``c`` between unit vectors is a Euclidean distance of at
most ``r = sqrt(2 - 2c)``. Pivots cut the space into cells; a vector's home is
the cell of its nearest pivot. By the triangle inequality a vector within ``r``
of anything in another cell lies within ``r`` of the plane between the two
pivots, so it is replicated to that cell as a guest if it does, and cells join
independently: home with home, and home with guests of higher cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import discard, durable, small_batches
from spanmill.llm.components import components

#: Vectors of a cell that one task compares with as many others, and pivots at most.
BLOCK = 4096
MAX_PIVOTS = 512
#: Up to so many cells (pivots, and lengths of vectors without one) have their sizes broadcast.
BROADCAST_CELLS = 100_000
_SLACK = 1e-4


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component, which is exact and keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def usable(vector_col: str) -> Column:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cell_entries(reps: DataFrame, pivots: list[np.ndarray], radius: float) -> DataFrame:
    """``(cell, home, node, n, v)``: each vector in its home cell and, as a guest, in the lower cells it may have links in.

    Cells hold vectors of one length; a length without a pivot has one cell of its own, of negative number.
    """
    by: dict[int, list[int]] = {}
    for k, p in enumerate(pivots):
        by.setdefault(len(p), []).append(k)
    kind = reps.schema["v"].dataType.simpleString()

    def place(x: np.ndarray, numbers: np.ndarray, at: np.ndarray, norms: np.ndarray):
        """Rows and cells of each entry, and every row's home, for vectors of one length."""
        x = _scaled(x)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        square = 2 - 2 * x @ at.T
        home = square.argmin(axis=1)
        gap = square - square[np.arange(len(x)), home][:, None]
        near = gap <= 2 * radius * norms[home] + 1e-9
        near &= np.arange(len(at))[None] < home[:, None]
        near[np.arange(len(x)), home] = True
        row, cell = np.nonzero(near)
        return row, numbers[cell], numbers[home[row]]

    def assign(batches):
        known = {}
        for size, numbers in by.items():
            at = np.array([pivots[k] for k in numbers])
            known[size] = np.array(numbers), at, np.linalg.norm(at[:, None] - at[None], axis=2)
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(np.asarray(vectors.offsets))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size in known:
                    row, cell, home = place(_matrix(vectors.take(pa.array(rows))), *known[size])
                else:
                    row = np.arange(len(rows))
                    cell = home = np.full(len(rows), -1 - size)
                take = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(home.astype(np.int64)), *(batch.column(k).take(take) for k in range(3))], ["cell", "home", "node", "n", "v"])

    return reps.select("node", "n", "v").transform(small_batches).mapInArrow(assign, f"cell long, home long, node long, n long, v {kind}")


def join_block(table: pa.Table, cosine: float) -> pa.Table:
    """Links of one pair of blocks: partial counts ``(node, links)`` and edges ``(node, other)`` that span its components."""
    side = np.asarray(table["side"])
    ids, n = np.asarray(table["node"]), np.asarray(table["n"])
    same = bool(np.asarray(table["i"])[0] == np.asarray(table["j"])[0])
    x = _scaled(_matrix(table["v"].combine_chunks()))
    size = np.sqrt((x * x).sum(axis=1))
    unit = (x / size[:, None]).astype(np.float32)
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links = np.zeros(len(ids), np.int64)
    label = np.arange(len(ids))
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        found = unit[rows] @ unit[right].T >= cosine - _SLACK
        if same:
            found &= rows[:, None] < right[None]
        for r, hits in zip(rows, found, strict=True):
            js = right[hits]
            if not len(js):
                continue
            js = js[(x[js] @ x[r]) / (size[js] * size[r]) >= cosine]
            links[r] += n[js].sum()
            links[js] += n[r]
            groups = np.unique(label[np.append(js, r)])
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
    counted = np.flatnonzero(links)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    none = pa.nulls(len(counted), pa.int64())
    return pa.table(
        {
            "node": np.concatenate((ids[counted], ids[moved])),
            "links": pa.chunked_array([pa.array(links[counted]), pa.nulls(len(moved), pa.int64())]),
            "other": pa.chunked_array([none, pa.array(ids[label[moved]])]),
        }
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``vectors``.

    ``n_links`` counts the other rows with cosine of at least ``cosine``
    (compared in double precision, 32-bit components being exact), ``component_id``
    is the smallest id reachable by links. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors of different lengths
    don't link; rows with a null id have no links and no component and are kept;
    ids are of any type with an order; other columns aren't read; an
    empty table gives an empty result. Equal vectors are joined as one that
    stands for all of them; rows that share an id are one node of the components.

    A pilot of hashed rows gives the pivots, about one for ``BLOCK`` vectors.
    A cell's homes and guests are dealt into blocks of about ``BLOCK``; each pair
    of home blocks, and of a home block and a guest block, is a task of its own,
    so no task holds a whole hot cell and guests aren't compared with guests.
    Tasks return counts and spanning edges, never all pairs.
    """
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    v = F.col(vector_col).cast("array<double>") if wide else F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable(vector_col), v).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.md5(F.to_binary(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.lit("utf-8")))))
    rows = durable(rows, "vectors")
    good = rows.where("v is not null and id is not null")
    classes = good.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once it is written
    wanted = min(MAX_PIVOTS, max(1, -(-classes.count() // BLOCK)))
    pivots = [_scaled(np.array([r[0]], np.float64))[0] for r in classes.orderBy(F.xxhash64("key"), "node").limit(wanted).select("v").collect()]
    pivots = [p / np.linalg.norm(p) for p in pivots]
    entries = durable(cell_entries(classes, pivots, math.sqrt(2 - 2 * cosine)), "entries")
    sizes = entries.groupBy("cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("homes"), F.count_if(F.col("home") != F.col("cell")).alias("guests"))
    sizes = durable(sizes, "sizes")
    if sizes.count() <= BROADCAST_CELLS:  # else entries of a large cell would meet in one task
        sizes = F.broadcast(sizes)
    at_home = F.col("home") == F.col("cell")
    blocks = lambda side: F.ceil(F.col(side) / BLOCK)
    dealt = entries.join(sizes, "cell").withColumns({"homes": blocks("homes"), "guests": blocks("guests")}).where("homes > 0")
    own = F.pmod(F.xxhash64("node"), F.when(at_home, F.col("homes")).otherwise(F.col("guests"))) + F.when(at_home, 0).otherwise(F.col("homes"))
    other = F.sequence(F.lit(0).cast("bigint"), F.when(at_home, F.col("homes") + F.col("guests")).otherwise(F.col("homes")).cast("bigint") - 1)
    dealt = dealt.withColumn("block", own).withColumn("to", F.explode(other)).select(
        "cell", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") > F.col("to")).cast("int").alias("side"), "node", "n", "v"
    )
    found = dealt.groupBy("cell", "i", "j").applyInArrow(lambda t: join_block(t, cosine), "node long, links long, other long")
    found = durable(found, "links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select("node", "other")
    several = durable(good.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("id", "lo"), "several")
    if not several.isEmpty():  # ids of different vectors join their nodes
        of = classes.select("key", "node")
        twins = good.select("id", "key").join(several, "id").where("key <> lo").select("key", "lo").distinct()
        edges = edges.unionAll(twins.join(of, "key").join(of.toDF("lo", "other"), "lo").select("node", "other"))
    joined = components(edges, "node", "other").withColumnRenamed("id", "node")
    per = durable(classes.drop("v").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    least = durable(per.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    per = per.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    discard(classes, entries, found, several)
    out = rows.select("id", "key").join(per, "key", "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "id"))
    return out.select("id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
