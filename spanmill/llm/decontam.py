"""Benchmark decontamination: a broadcast hash set of test n-grams over whole training texts.

Words are runs of letters, digits and non-ASCII characters after lower-casing
A-Z. A window is ``WIDTH`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bit_filter, durable, maybe, small_batches, steps, utf8_batch
from spanmill.llm.textscan import SYMBOL_SEPARATORS, RangeHasher, class_table, lower_table, window_hashes, word_spans

WIDTH = 13
#: Benchmarks of more text than this are not broadcast but joined by a shuffle; windows take about 40 times their text.
BROADCAST_BYTES = 4 << 20
#: Bytes that an item counts for beside its text, so that many short ones aren't collected either.
ITEM_BYTES = 64


def _words(data: np.ndarray, offsets: np.ndarray, seed: int = 7):
    starts, ends, bounds = word_spans(data, offsets, class_table(SYMBOL_SEPARATORS))
    return starts, ends, bounds, RangeHasher(data, lower_table(), seed)(starts, ends)


def _phrase(data: np.ndarray, starts, ends) -> bytes:
    return b" ".join(data[s:e].tobytes().lower() for s, e in zip(starts, ends, strict=True))


def build_index(items: list[tuple[object, str | None]], width: int = WIDTH) -> dict:
    """``{window length: (sorted hashes, windows as bytes, item ids of each)}``."""
    by: dict[int, dict[int, tuple[bytes, list]]] = {}
    for item, text in items:
        data, offsets = utf8_batch(pa.array([text], pa.string()))
        starts, ends, _, words = _words(data, offsets)
        size = min(width, len(words))
        if not size:
            continue
        for k, h in enumerate(window_hashes(words, size).tolist()):
            phrase, owners = by.setdefault(size, {}).setdefault(h, (_phrase(data, starts[k : k + size], ends[k : k + size]), {}))
            owners[str(item)] = None
    out = {}
    for size, windows in by.items():
        keys = sorted(windows)
        out[size] = np.array(keys, np.uint64), [windows[k][0] for k in keys], [list(windows[k][1]) for k in keys]
    return out


def _cover(count: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of ``count`` words lie inside a window that begins at ``at`` and has ``size`` words."""
    depth = np.zeros(count + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + size, -1)
    return np.cumsum(depth[:-1]) > 0


def _runs(mask: np.ndarray) -> np.ndarray:
    """Bounds of the runs of true values, as rows (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _scan(index: dict, data: np.ndarray, offsets: np.ndarray):
    """For each row: words, hit words, items, byte spans of hit runs (within the row)."""
    starts, ends, bounds, words = _words(data, offsets)
    found: list[tuple[np.ndarray, int, list]] = []
    for size, (keys, phrases, owners) in index.items():
        hashes = window_hashes(words, size)
        if not len(hashes):
            continue
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        for k in np.flatnonzero(keys[at] == hashes):
            row = int(np.searchsorted(bounds, k, "right")) - 1
            if k + size <= bounds[row + 1] and _phrase(data, starts[k : k + size], ends[k : k + size]) == phrases[at[k]]:
                found.append((row, int(k), size, owners[at[k]]))
    by: dict[int, list] = {}
    for hit in found:
        by.setdefault(hit[0], []).append(hit)
    for row in range(len(offsets) - 1):
        lo, hi = int(bounds[row]), int(bounds[row + 1])
        hits = by.get(row)
        if not hits:
            yield hi - lo, 0, [], []
            continue
        mask = _cover(hi - lo, np.array([h[1] - lo for h in hits]), np.array([h[2] for h in hits]))
        spans = [(int(starts[lo + a] - offsets[row]), int(ends[lo + b - 1] - offsets[row])) for a, b in _runs(mask)]
        yield hi - lo, int(mask.sum()), sorted({o for h in hits for o in h[3]}), spans


OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start_byte:bigint,end_byte:bigint>>"
_SPANS = pa.list_(pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(id, n_words, n_hit, items, spans)`` for each row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a benchmark window,
    ``items`` are the sorted ids of the items with an occurring window and
    ``spans`` the byte ranges of hit runs. Null and word-less texts have no
    words and no hits; null or word-less items have no windows; repeated rows
    and repeated items change nothing else; other columns aren't read; empty
    tables are allowed on either side.

    The size of the benchmark is measured first. Up to ``broadcast_bytes`` its
    windows are broadcast and no text is shuffled; beyond, windows of both
    sides meet in a join on their hash. Either way the bytes of a hit are compared.
    """
    index = _broadcast_index(docs, benchmark, item_col, width, broadcast_bytes)
    if index is None:
        return _scan_by_join(docs, benchmark.select(F.col(item_col).cast("string").alias("id"), "text"), id_col, text_col, width).drop("key")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(1))
            for i, j in steps(offsets):
                rows = list(_scan(index.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                n, hit, names, spans = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([[{"start_byte": a, "end_byte": b} for a, b in s] for s in spans], _SPANS)],
                    ["id", "n_words", "n_hit", "items", "spans"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(run, f"id {kind}, {OUT}")


def _windows(rows: DataFrame, lengths: list[int] | None, width: int, kind: str, known=None) -> DataFrame:
    """``(id, n_words, size, at, key, phrase, start_byte, end_byte)``: windows of each row, and one of size 0 for the row itself.

    Items (``lengths`` None) give their windows; documents give windows of all ``lengths`` whose key passes the bitmap ``known``.
    """

    def run(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(1))
            for i, j in steps(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds, words = _words(part, own)
                ids = batch.column(0).slice(i, j - i)
                counts = np.diff(bounds)
                zero = pa.array(np.zeros(j - i, np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), zero, zero, zero, pa.nulls(j - i, pa.binary()), zero, zero], names)
                for size in lengths or range(1, width + 1):
                    key = window_hashes(words, size).view(np.int64)
                    k = np.arange(len(key)) if known is None else np.flatnonzero(maybe(known.value, key))
                    row = np.searchsorted(bounds, k, "right") - 1
                    ok = k + size <= bounds[row + 1]
                    if lengths is None:
                        ok &= (size == width) | (counts[row] == size)
                    k, row = k[ok], row[ok]
                    phrases = pa.array([_phrase(part, starts[x : x + size], ends[x : x + size]) for x in k], pa.binary())
                    count, sizes, at, first, last = (pa.array(np.asarray(c, np.int64)) for c in (counts[row], np.full(len(k), size), k - bounds[row], starts[k] - own[row], ends[k + size - 1] - own[row]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), count, sizes, at, pa.array(key[k]), phrases, first, last], names)

    names = ["id", "n_words", "size", "at", "key", "phrase", "start_byte", "end_byte"]
    return rows.transform(small_batches).mapInArrow(run, f"id {kind}, n_words long, size long, at long, key long, phrase binary, start_byte long, end_byte long")


#: Bits of the filter of benchmark windows where these are joined: 4 MB at any size.
FILTER_BITS = 1 << 25


def _scan_by_join(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Windows that pass a bitmap meet the benchmark's by hash, and count where their bytes agree."""
    kind = docs.schema[id_col].dataType.simpleString()
    grams = durable(_windows(items, None, width, "string").where("size > 0").select("size", "key", "phrase", F.col("id").alias("item")).distinct(), "grams")
    lengths = sorted(r[0] for r in grams.select("size").distinct().collect())
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(grams, "key", FILTER_BITS))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("key")).alias("id"), F.col(text_col).alias("text"))
    windows = durable(_windows(keyed, lengths, width, f"struct<id:{kind},key:string>", known), "windows")
    hits = windows.where("size > 0").join(grams.drop("size"), ["key", "phrase"])
    found = hits.groupBy("id").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("at", "size", "start_byte", "end_byte")).alias("hits")
    )

    def fold(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                hits = row["hits"] or []
                mask = _cover(row["n_words"], np.array([h["at"] for h in hits], np.int64), np.array([h["size"] for h in hits], np.int64))
                ends = {h["at"]: h["start_byte"] for h in hits} | {-h["at"] - h["size"]: h["end_byte"] for h in hits}
                spans = [{"start_byte": ends[int(a)], "end_byte": ends[-int(b)]} for a, b in _runs(mask)]
                out.append({"id": row["id"], "key": row["key"], "n_words": row["n_words"], "n_hit": int(mask.sum()), "items": row["items"] or [], "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", batch.schema.field("id").type), ("key", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)]))

    rows = windows.where("size = 0").select("id", "n_words").join(found, "id", "left").select("id.id", "id.key", "n_words", "items", "hits")
    return rows.transform(small_batches).mapInArrow(fold, f"id {kind}, key string, {OUT}")


def contaminated(percent: int = 5):
    """Whether hit words are at least ``percent`` of all words."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 5, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    With a broadcast benchmark rows are dropped where they are read, without a
    shuffle; with a larger one, by an anti join on the text's digest. Each row
    is judged by its own text, whatever id it has.
    """
    index = _broadcast_index(docs, benchmark, item_col, width, broadcast_bytes)
    if index is None:
        items = benchmark.select(F.col(item_col).cast("string").alias("id"), "text")
        bad = _scan_by_join(docs, items, id_col, text_col, width).where(contaminated(percent)).select(F.col("key").alias("__digest")).distinct()
        return docs.join(bad, F.md5(F.col(text_col).cast("binary")) == F.col("__digest"), "left_anti")
    at = docs.columns.index(text_col)

    def select(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(at))
            for i, j in steps(offsets):
                rows = _scan(index.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array([not (hit and 100 * hit >= percent * n) for n, hit, _, _ in rows], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(select, docs.schema)


def _broadcast_index(docs: DataFrame, benchmark: DataFrame, item_col: str, width: int, broadcast_bytes: int):
    """The broadcast windows, or None if the benchmark is too large for that."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").alias("words")).where(F.length("words") > 0)
    if items.agg(F.coalesce(F.sum(F.octet_length("words") + ITEM_BYTES), F.lit(0))).first()[0] > broadcast_bytes:
        return None
    return docs.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in items.collect()], width))


def remove_spans(text: str, spans) -> str:
    """The text without the given byte ranges."""
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start_byte"]])
        at = s["end_byte"]
    return b"".join([*out, raw[at:]]).decode()


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
