"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are sorted only through ``length`` tokens (bytes) and only into
groups, most significant digit first; groups of one member are dropped after
each pass, and the groups that are left after the last are exactly the windows
of ``length`` bytes that occur more than once.

Not every suffix takes part in the first passes. Of the byte ``K``-grams of a
window the one of least hash is its anchor, which depends on the window's bytes
alone; neighbouring windows mostly share it, so a run of windows with one anchor
is one row:

1. first digit: the anchor's ``K`` bytes. Most runs are alone in their group.
2. second digit: all bytes of the run. Runs in a group of two or more repeat
   with all their windows; runs that are alone there (the rims of repeated
   passages), and one run of each settled group that rims share a first digit
   with, go on.
3. those runs are cut into blocks of ``BLOCK`` windows by distance to the
   anchor. The bytes that all windows of a block share are the next digit:
   who is alone there has no repeated window. All bytes of the block settle it
   as in pass 2.
4. the blocks that are left: single windows.

Digits are compared as 64-bit hashes of the bytes; what is called equal agrees in
two of them at least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import STEP_BYTES, bit_filter, discard, durable, maybe, small_batches, steps, utf8_batch
from spanmill.llm.textscan import RangeHasher, gram_hashes

LENGTH = 200
#: Bytes of the first digit.
ANCHOR = 40
#: Windows in a block of the third pass.
BLOCK = 16
#: Bits of the filter that keeps runs of unrepeated first digits from being shuffled: 4 MB at any corpus size.
FILTER_BITS = 1 << 25


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block-wise running minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """``(row, first window, last window, anchor, first digit)`` of each run as arrays; positions are in the buffer."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = np.arange(n - anchor + 1)
    grams = gram_hashes(data, anchor)
    low = np.uint64((1 << 20) - 1)
    least = sliding_min((grams & ~low) | at.astype(np.uint64), length - anchor + 1)
    ok = np.zeros(n + 1, np.int64)
    long_rows = np.flatnonzero(np.diff(offsets) >= length)
    ok[offsets[long_rows]] += 1
    ok[offsets[long_rows + 1] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ok[: n - length + 1]) > 0)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    where = (least[starts] & low).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, a = starts[first], starts[last], where[first]
    row = np.searchsorted(offsets, s0, "right") - 1
    return row, s0, s1, a, grams[a]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Steps of a batch, long rows cut into overlapping pieces: first row, bytes, row bounds, position of the piece in its row."""
    for i, j in steps(offsets, STEP_BYTES):
        if offsets[j] - offsets[i] <= 2 * STEP_BYTES:
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
        else:
            for at in range(0, int(offsets[j] - offsets[i]), STEP_BYTES):
                piece = data[offsets[i] + at : min(offsets[i] + at + STEP_BYTES + length - 1, offsets[j])]
                yield i, piece, np.array([0, len(piece)]), at


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def find_runs(keyed: DataFrame, length: int, anchor: int, repeated=None) -> DataFrame:
    """The first digits of every run; with a bitmap of repeated ones, the runs that may have one of these."""
    kind = keyed.schema["id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(2))
            for i, part, own, at in _pieces(data, offsets, length):
                row, s0, s1, where, key = runs(part, own, length, anchor)
                key = key.view(np.int64)
                if repeated is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                    continue
                k = np.flatnonzero(maybe(repeated.value, key))
                if not len(k):
                    continue
                whole = RangeHasher(part)(s0[k], s1[k] + length) + (where[k] - s0[k]).astype(np.uint64)  # the second digit
                rows = pa.array(row[k] + i)
                base = at - own[row[k]]
                places = (pa.array(x[k] + base) for x in (s0, s1, where))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key[k]), pa.array(whole.view(np.int64)), *places],
                    ["id", "text_key", "key", "whole", "s0", "s1", "at"],
                )

    return keyed.transform(small_batches).mapInArrow(scan, "key long" if repeated is None else f"id {kind}, text_key long, key long, whole long, s0 long, s1 long, at long")


def find_contexts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs ``(id, text_key, key, s0, s1, at, unsettled)`` with their bytes."""
    kind = keyed.schema["id"].dataType.simpleString()
    lists = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("key", "s0", "s1", "at", "unsettled")).alias("runs"))
    lists = lists.select(F.col("id").alias("of"), F.col("text_key").alias("of_key"), "runs")
    both = keyed.join(lists, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))).select("id", "text_key", "text", "runs")

    def scan(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(2))
            raw = data.tobytes()
            lists = batch.column(3)
            count = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(batch)), count)
            flat = lists.flatten()
            starts, stops = offsets[row] + np.asarray(flat.field(1)), offsets[row] + np.asarray(flat.field(2)) + length
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(flat.field(k) for k in range(5)), pa.array([raw[a:b] for a, b in zip(starts, stops, strict=True)], pa.binary())],
                ["id", "text_key", "key", "s0", "s1", "at", "unsettled", "bytes"],
            )

    return both.transform(small_batches).mapInArrow(scan, f"id {kind}, text_key long, key long, s0 long, s1 long, at long, unsettled boolean, bytes binary")


def cut_runs(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of each run: ``(id, text_key, key, s0, at, node, core, whole, b0, b1, unsettled)``.

    A block's windows start from ``b0`` to ``b1`` and lie ``node * block`` bytes
    or more, and less than a block further, before the anchor ``at``.
    """
    kind = contexts.schema["id"].dataType.simpleString()

    def scan(batches):
        names = ["id", "text_key", "key", "s0", "s1", "at", "unsettled"]
        for batch in batches:
            data, lengths = utf8_batch(batch.column(7))
            s0, s1, at = (np.asarray(batch.column(names.index(c))) for c in ("s0", "s1", "at"))
            for i, j in steps(lengths):
                part = data[lengths[i] : lengths[j]]
                begin = lengths[i:j] - lengths[i]
                low, high = (at - s1)[i:j] // block, (at - s0)[i:j] // block
                count = high - low + 1
                row = np.repeat(np.arange(j - i), count)
                node = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
                far, near = at[i:j][row] - node * block - block + 1, at[i:j][row] - node * block
                b0, b1 = np.maximum(far, s0[i:j][row]), np.minimum(near, s1[i:j][row])
                move = begin[row] - s0[i:j][row]
                hasher = RangeHasher(part)
                whole = hasher(b0 + move, b1 + move + length) + (near - b0).astype(np.uint64)
                core = hasher(near + move, far + move + length) if block < length else whole
                take = pa.array(row + i)
                col = lambda c: batch.column(names.index(c)).take(take)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [col("id"), col("text_key"), col("key"), col("s0"), col("at"), pa.array(node), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(b0), pa.array(b1), col("unsettled")],
                    ["id", "text_key", "key", "s0", "at", "node", "core", "whole", "b0", "b1", "unsettled"],
                )

    return contexts.transform(small_batches).mapInArrow(scan, f"id {kind}, text_key long, key long, s0 long, at long, node long, core long, whole long, b0 long, b1 long, unsettled boolean")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(id, text_key, spans)``: for each text with repeats, distinct byte ranges that cover them, neither merged nor sorted.

    A window repeats if its bytes also start anywhere else, in the same
    document or another; matches don't cross documents.
    """
    keyed = _keyed(docs, id_col, text_col)
    repeated = durable(find_runs(keyed, length, anchor).groupBy("key").count().where("count > 1").select("key"), "digit-1")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, "key", FILTER_BITS))
    mates = durable(find_runs(keyed, length, anchor, sent).join(repeated, "key"), "digit-1-mates")
    first = F.min(F.struct("id", "text_key", "s0", "s1", "at")).alias("r")
    groups = durable(mates.groupBy("key", "whole").agg(F.count("*").alias("n"), first), "digit-2")
    open_keys = groups.groupBy("key").agg(F.min("n").alias("least")).where("least = 1").select("key", F.lit(True).alias("open"))
    rims = groups.where("n = 1").select("r.id", "r.text_key", "key", "r.s0", "r.s1", "r.at", F.lit(True).alias("unsettled"))
    heads = groups.where("n > 1").join(open_keys, "key").select("r.id", "r.text_key", "key", "r.s0", "r.s1", "r.at", F.lit(False).alias("unsettled"))
    settled = mates.join(groups.where("n > 1").select("key", "whole"), ["key", "whole"], "left_semi")
    spans = settled.select("id", "text_key", F.col("s0").alias("start"), (F.col("s1") + length).alias("end"))

    contexts = durable(find_contexts(keyed, rims.unionByName(heads), length), "contexts")
    blocks = durable(cut_runs(contexts, length, BLOCK), "digit-3")
    digits = ["key", "node", "core"]
    shared = blocks.groupBy(*digits, "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_key", "s0", "at", "b0", "b1", "unsettled")).alias("r"))
    shared = durable(shared, "digit-3-groups")
    cores = shared.groupBy(*digits).agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1").select(*digits)
    left = shared.join(cores, digits, "left_semi").select("r.id", "r.text_key", "key", "r.s0", "r.at", "r.b0", "r.b1", (F.col("r.unsettled") & (F.col("n") == 1)).alias("unsettled"))
    settled = blocks.where("unsettled").join(shared.where("n > 1").select(*digits, "whole"), [*digits, "whole"], "left_semi")
    spans = spans.unionByName(settled.select("id", "text_key", F.col("b0").alias("start"), (F.col("b1") + length).alias("end")))

    run = contexts.select("id", "text_key", "key", "s0", "bytes").dropDuplicates(["id", "text_key", "s0"])
    left = left.withColumnsRenamed({"id": "of", "text_key": "of_key", "key": "run_key", "s0": "run"})
    narrow = run.join(left, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")) & (F.col("s0") == F.col("run")))
    narrow = narrow.select(
        "id", "text_key", "key", F.col("b0").alias("s0"), F.col("b1").alias("s1"), "at", "unsettled",
        F.substring("bytes", F.col("b0") - F.col("s0") + 1, F.col("b1") - F.col("b0") + length).alias("bytes"),
    )
    windows = durable(cut_runs(narrow, length, 1), "digit-4")
    twice = windows.groupBy("key", "node", "whole").count().where("count > 1").select("key", "node", "whole")
    settled = windows.where("unsettled").join(twice, ["key", "node", "whole"], "left_semi")
    spans = spans.unionByName(settled.select("id", "text_key", F.col("b0").alias("start"), (F.col("b1") + length).alias("end")))
    spans = durable(spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeats")
    discard(repeated, mates, groups, contexts, blocks, shared, windows)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(id, n_bytes, removed, kept)`` for each row of ``docs``.

    ``removed`` holds the maximal byte ranges covered by a string of ``length``
    bytes that also starts anywhere else in the table, judged on the input;
    ``kept`` is the other bytes, joined. Null is the empty text; texts shorter
    than ``length`` lose nothing; a repeated row is another occurrence; other
    columns aren't read; an empty table gives an empty result.
    """
    filled = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = _keyed(filled, "id", "text")
    found = find_repeats(filled, "id", "text", length, anchor)
    found = found.select(F.col("id").alias("of"), F.col("text_key").alias("of_key"), "spans")
    both = keyed.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left").select("id", "text", "spans")
    kind = keyed.schema["id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(1))
            sizes, removed, kept = [], [], []
            for i, spans in enumerate(batch.column(2)):
                own = data[offsets[i] : offsets[i + 1]]
                sizes.append(len(own))
                if not spans.is_valid:
                    removed.append([])
                    kept.append(own.tobytes())
                    continue
                start, end = (np.asarray(spans.values.field(k)) for k in (0, 1))
                depth = np.zeros(len(own) + 1, np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                removed.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pairs), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return both.transform(small_batches).mapInArrow(cut, f"id {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
