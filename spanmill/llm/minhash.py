"""MinHash near-duplicate detection with fast similarity sketches.

A sketch has ``t`` coordinates. Round ``i`` hashes every element of the set
once; in the first ``t`` rounds the hash also picks the bin it falls in, in the
last ``t`` rounds the bin is ``i - t``. A bin keeps the least ``(round, hash)``
it has seen, and rounds stop when no bin is empty. So every coordinate fills,
a set of ``t log t`` elements needs few rounds instead of ``t``, and two
sketches agree in a coordinate with probability equal to the Jaccard
similarity, with concentration as for independent minima. (Dahlgaard, Knudsen,
Thorup: Fast Similarity Sketching, 2017.)

Candidates share one of ``bands`` bands of ``t / bands`` coordinates; they are
confirmed on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bit_filter, discard, durable, maybe, small_batches, steps, utf8_batch
from spanmill.llm.components import components
from spanmill.llm.textscan import (
    SPACE_SEPARATORS,
    RangeHasher,
    _stream,
    class_table,
    lower_table,
    mix,
    window_hashes,
    word_spans,
)

COORDINATES = 128
BANDS = 32
#: Members of a bucket that all its members are compared with before the rest is searched.
PIVOTS = 3
#: 64-bit words of a set's parities, which bound what two sets may share.
PARITY_WORDS = 16
#: Bits of the filter of wanted sets: 4 MB at any corpus size.
FILTER_BITS = 1 << 25


def fast_sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketch of a non-empty set of distinct uint64 elements; ``t`` is a power of two up to 128."""
    bits = t.bit_length() - 1
    seeds = _stream(2 * t, 0x5EED)
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    done = 0
    while done < 2 * t:
        take = int(min(2 * t - done, max(1, -(-6 * t // len(elements)))))
        hashed = mix(elements[None, :] ^ seeds[done : done + take, None])
        rounds = np.arange(done, done + take, dtype=np.uint64)[:, None]
        bins = (hashed >> np.uint64(64 - bits)).astype(np.int64)
        fixed = np.arange(done, done + take)[:, None] - t
        bins = np.where(fixed >= 0, fixed, bins)
        value = (rounds << np.uint64(48)) | (hashed & np.uint64((1 << 48) - 1))
        np.minimum.at(out, bins.ravel(), value.ravel())
        done += take
        if (out != np.iinfo(np.uint64).max).all():
            break
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket key for each band of each sketch."""
    rows = sketch.reshape(*sketch.shape[:-1], bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[-1]):
        key = mix(key ^ rows[..., k]) + np.uint64(k)
    return key


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Yield each row's sorted distinct shingle hashes, words being cut at ASCII white space after lower-casing A-Z.

    A row of fewer than ``width`` words has its whole sequence as one shingle; a row without words has none.
    """
    starts, ends, bounds = word_spans(data, offsets, class_table(SPACE_SEPARATORS))
    words = RangeHasher(data, lower_table())(starts, ends)
    runs = window_hashes(words, width)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        n = hi - lo
        if n >= width:
            yield np.unique(runs[lo : hi - width + 1])
        elif n:
            yield window_hashes(words[lo:hi], int(n))
        else:
            yield np.zeros(0, np.uint64)


def parities(elements: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Whether an odd number of elements falls into each of ``64 * words`` bins, as int64 words.

    Two sets differ in at least as many elements as their parities differ in bins.
    """
    odd = (np.bincount((elements & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def with_parities(sets: DataFrame) -> DataFrame:
    """``(node, component, n, odd)``: ``sets`` with their ``parities`` instead of their elements."""

    def scan(batches):
        for batch in batches:
            lists = batch.column(3)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            values = np.asarray(lists.flatten()).view(np.uint64)
            odd = pa.array([parities(values[a:b]).tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], odd], ["node", "component", "n", "odd"])

    return sets.select("node", "component", "n", "elements").transform(small_batches).mapInArrow(scan, "node long, component long, n long, odd array<long>")


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """``(id, n, digest, bands)`` for each row: set size, MD5 of the set, band keys (empty for an empty set)."""

    def scan(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(1))
            for i, j in steps(offsets):
                own = offsets[i : j + 1] - offsets[i]
                found = list(shingle_sets(data[offsets[i] : offsets[j]], own, width))
                n = np.array([len(s) for s in found], np.int64)
                sketches = [fast_sketch(s) for s in found if len(s)]
                keys = band_keys(np.array(sketches)) if sketches else np.zeros((0, BANDS), np.uint64)
                ends = np.cumsum([0, *np.where(n > 0, BANDS, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n),
                        pa.array([hashlib.md5(s.tobytes()).digest() for s in found], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["id", "n", "digest", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(
        scan, f"id {kind}, n long, digest binary, bands array<long>"
    )


def document_sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """``(node, n, elements)`` for each of ``wanted`` ``(digest, node)``: the full shingle set as sorted 64-bit hashes.

    A bitmap of the wanted digests keeps other texts' sets where they are made, so no text is shuffled.
    """
    key = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(key.alias("key")), "key", FILTER_BITS))

    def scan(batches):
        seen: set[bytes] = set()
        for batch in batches:
            data, offsets = utf8_batch(batch.column(0))
            for i, j in steps(offsets):
                found = {}
                for elements in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width):
                    digest = hashlib.md5(elements.tobytes()).digest()
                    if digest not in seen and maybe(sent.value, np.array([int.from_bytes(digest[:7], "big")], np.int64))[0]:
                        found[digest] = elements
                seen.update(found)
                ends = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
                values = np.concatenate([*found.values(), np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["digest", "n", "elements"])

    made = docs.select(text_col).transform(small_batches).mapInArrow(scan, "digest binary, n long, elements array<long>")
    return made.join(wanted, "digest").dropDuplicates(["node"]).select("node", "n", "elements")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``(a, b)`` whose full sets have 100 * intersection >= percent * union.

    A pivot is ``a`` of very many pairs: it comes to them in the last join, whose
    sides are plain shuffles, so that a skewed one is split.
    """
    of = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("elements").alias(f"e{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    shared = F.size(F.array_intersect("ea", "eb")).cast("long")
    return both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` ``(node, component)`` after ``links`` ``(a, b)`` join components."""
    links = durable(links, "confirmed")
    ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").where("ca <> cb").select("ca", "cb")
    roots = durable(components(ends, "ca", "cb").toDF("component", "root"), "roots")
    out = durable(labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    discard(links, roots)
    return out


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold two components or more, with their ``component``."""
    labelled = durable(members.join(labels, "node"), "labelled")
    mixed = durable(labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    out = durable(labelled.join(mixed, "bucket", "left_semi"), "open")
    discard(labelled, mixed)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Return ``(id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Documents whose shingle sets have ``100 * intersection >= percent * union``
    are linked; ``component_id`` is the smallest id reachable by links, itself
    included, and ``kept`` says that it is the row's own id. Null or blank
    texts have an empty set and link with nothing; rows that share an id are
    one node, whatever their texts; rows with a null id link with nothing, have
    no component and are kept; ids are of any type with an order; other columns
    of ``docs`` aren't read; an empty table gives an empty result.

    Plan: rows of equal sets are one node; only its bands are exploded. In each
    bucket of two or more, every node is first compared with one pivot, the
    least it shares a bucket with. Where a bucket still holds
    several components, its nodes are compared with ``PIVOTS`` of them, and what
    is open then goes through ``prefix_pairs``, which finds every link that may
    be left and skips the pairs that share only what is frequent.
    """
    rows = durable(sketch_documents(docs, id_col, text_col, width), "sketches")
    full = rows.where("n > 0 and id is not null")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once it is written
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    pivots = [F.min("node"), *(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(1, PIVOTS))]
    shared = durable(buckets.groupBy("bucket").agg(F.array(*pivots).alias("pivots"), F.max("node").alias("last")).where("pivots[0] < last").select("bucket", "pivots"), "shared")
    members = durable(buckets.join(shared, "bucket"), "members")
    nodes = members.select("node").distinct()
    sets = durable(document_sets(docs, classes.select("digest", "node").join(nodes, "node", "left_semi"), text_col, width), "sets")

    labels = nodes.select("node", F.col("node").alias("component"))
    least = members.groupBy(F.col("node").alias("b")).agg(F.min("pivots")[0].alias("a")).where("a < b")
    labels = merge(labels, confirm(least, sets, percent))
    left = open_members(members, labels)
    if not left.isEmpty():
        pairs = left.select(F.col("node").alias("b"), "component", F.explode("pivots").alias("a")).where("a <> b").distinct()
        pairs = pairs.join(labels.toDF("a", "other"), "a").where("component <> other").select("a", "b")
        labels = merge(labels, confirm(pairs, sets, percent))
        left = open_members(left.drop("component"), labels)
    if not left.isEmpty():
        rest = sets.join(left.select("node", "component").distinct(), "node")
        labels = merge(labels, confirm(prefix_pairs(rest, percent), sets, percent))

    labels = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    several = full.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id", "lo")
    several = durable(several, "several")
    if not several.isEmpty():  # ids of different texts join their nodes
        of = classes.select("digest", "node")
        twins = full.select("id", "digest").join(several, "id").where("digest <> lo").select("digest", "lo").distinct()
        links = twins.join(of, "digest").withColumnRenamed("node", "a").join(of.toDF("lo", "b"), "lo").select("a", "b")
        labels = merge(labels, links)
    labelled = durable(classes.select("digest", "node", "rep").join(labels, "node"), "labelled")
    least = durable(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "least")  # a table, so that a skewed join is split
    found = labelled.join(least, "component").select("digest", "component_id")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    discard(classes, shared, members, sets, several)
    out = rows.select("id", "n", "digest").join(found, "digest", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of rows ``(node, component, n, elements)`` in different components that may have similarity ``percent``.

    Elements are ranked from rare to frequent. Sets of at least that similarity
    share an element among the first ``n - ceil(n * percent / 100) + 1`` of the
    larger and the first ``n - ceil(2 * n * percent / (100 + percent)) + 1`` of the smaller one,
    the ranks of the first shared one bound the overlap, and their parities
    differ in no more bins than the sets may in elements. These rules are exact;
    the last one drops pairs somewhat below the threshold before they are rows, so
    an element that many unlinked sets share makes few.
    """
    about = durable(with_parities(sets), "about")
    frequency = sets.select(F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("df"))
    ranked = (
        sets.select("node", F.explode("elements").alias("element"))
        .join(frequency, "element")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("ranked"))
        .join(about, "node")
    )
    prefix = durable(
        ranked.select("node", "component", "n", "odd", F.posexplode(F.expr(f"slice(ranked, 1, CAST(n - ceil(n * {percent} / 100) + 1 AS INT))")).alias("rank", "e"))
        .where("e.df > 1")
        .select("node", "component", "n", "odd", "rank", F.col("e.element").alias("element")),
        "prefix",
    )
    small = prefix.where(f"rank < n - ceil(2 * n * {percent} / (100 + {percent})) + 1")
    other = prefix.select("element", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "n", "odd", "rank")))
    differ = " + ".join(f"bit_count(odd[{k}] ^ other_odd[{k}])" for k in range(PARITY_WORDS))
    fits = (
        f"component <> other_component and (n < other_n or n = other_n and node < other_node) and 100 * n >= {percent} * other_n and "
        f"(100 + {percent}) * least(n - rank, other_n - other_rank) >= {percent} * (n + other_n) and "
        f"(100 + {percent}) * ({differ}) <= (100 - {percent}) * (n + other_n)"
    )
    pairs = small.join(other, ["element"]).where(fits)
    return pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
