"""Sampled positions in 40 bytes each, and heads that are fitted on them.

All that ``positions.position_features`` says of a position follows from the
classes of seven characters, counts in two windows and four distances. Kept as
that, the positions of a corpus stay in memory where sparse vectors of the same
features would take some 600 bytes each, and a pass of a fit looks weights up by
class. Texts are read once: tasks pack every boundary and their own least draws
of each pool, and the pools' last draws then tell which of those stay.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.marks import texts as decoded
from spanmill.operators import positions as P
from spanmill.operators.positions import KINDS, NEGATIVE, RADII, _columns
from spanmill.operators.sampling import _A, _B, _MOD

#: Where the seven characters stand; the first six are kept in pairs.
OFFSETS = (0, *P.NEIGHBOURS)
#: Features that aren't classes of characters.
NUMBERS = ("bias", *(f"r{r}_{name}_rate" for r in RADII for name in P.RATES), "pos_frac", "from_start_log", "to_end_log", "line_pos_frac", "line_from_start_log", "line_to_end_log")
#: A position: distances to the ends of its text and line, pairs of classes, the seventh class, targets as bits, and for the windows of ``RADII`` the counts of ``RATES`` and the width.
ROW = np.dtype([("far", "<i4", (4,)), ("pair", "<u2", (3,)), ("last", "u1"), ("bits", "u1"), ("near", "u1", (8,)), ("around", "u1", (8,))])
#: Positions of a block, and code points of the texts that are looked at together; a text is never divided.
BLOCK, SLICE = 1 << 14, 1 << 20
_LOGS = 1 << 16


@functools.lru_cache(1)
def alphabet() -> tuple[bytes, tuple[tuple, ...]]:
    """The class of every code point, compressed, and what each class is: bucket, category and ``TESTS``. The last class is what is outside a text."""
    table, profiles = bytearray(sys.maxunicode + 1), {}
    for k in range(sys.maxunicode + 1):
        ch = chr(k)
        category = unicodedata.category(ch)
        plain = category in ("Cn", "Co", "Cs")  # passes no test
        profile = (f"<{category}>", category) + (False,) * len(P.TESTS) if plain else (P.bucket(ch), category, *(bool(test(ch)) for test in P.TESTS.values()))
        table[k] = profiles.setdefault(profile, len(profiles))
    return zlib.compress(bytes(table)), (*profiles, (P.bucket(""), "NONE") + (False,) * len(P.TESTS))


def _units(profiles: tuple[tuple, ...]) -> np.ndarray:
    """What a character of each class adds to a window: a byte for each of ``RATES`` and one for the width, in a word."""
    which = [2 + list(P.TESTS).index(f"is_{name}") for name in P.RATES]
    return np.array([sum(int(p[k]) << 8 * i for i, k in enumerate(which)) + (1 << 56) for p in profiles], np.uint64)


class _Texts:
    """Some texts behind each other: classes of their characters, and what the spans make of their positions."""

    def __init__(self, docs: list[int], texts: list[str], spans: pa.ListArray, labels: list[str], table: np.ndarray):
        self.docs = docs
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        joined = "".join(texts)
        self.n = len(joined)
        self.classes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        self.feeds = np.flatnonzero(self.classes == table[10])
        row = np.repeat(np.arange(len(texts)), np.asarray(spans.value_lengths()))
        which, start, end, left, right = _columns(spans.flatten(), labels)
        sound = (which >= 0) & (start >= 0) & (end <= self.sizes[row]) & (start < end)
        row, which, start, end, left, right = (c[sound] for c in (row, which, start, end, left, right))
        whole, first = end == self.sizes[row], start == 0
        start, last = start + self.begins[row], end + self.begins[row] - 1
        self.flags = np.zeros((len(labels), len(KINDS), self.n), bool)
        for k in range(len(labels)):
            own = which == k
            depth = np.zeros(self.n + 1, np.int32)
            np.add.at(depth, start[own], 1)
            np.subtract.at(depth, last[own] + 1, 1)
            np.greater(np.cumsum(depth[: self.n], dtype=np.int32), 0, out=self.flags[k, 0])
        self.edge = np.zeros(self.n, bool)
        for kind, here, at in ((1, ~left, start), (2, ~right, last), (3, left & first, start), (4, right & whole, last)):
            self.flags[which[here], kind, at[here]] = True
            self.edge[at[here]] = True

    def draws(self, seed: int) -> np.ndarray:
        """``positions.keys`` of all positions."""
        first = np.array([(doc + seed) % _MOD * _A for doc in self.docs], np.uint64) + np.uint64(12345)
        x = np.arange(self.n, dtype=np.uint64)
        x -= np.repeat(self.begins.astype(np.uint64), self.sizes)
        x *= np.uint64(_B)
        x += np.repeat(first, self.sizes)
        most = np.uint64(_MOD)
        for factor in (_A, _B, 1):
            x -= x // most * most  # a division by a constant is quicker than a remainder
            x *= np.uint64(factor)
        return x.astype(np.int64)

    def pack(self, at: np.ndarray, units: np.ndarray, targets: list[tuple[int, int]]) -> np.ndarray:
        """``ROW`` of positions in ascending order."""
        out = np.empty(len(at), ROW)
        row = np.searchsorted(self.ends, at, "right")
        begin, end = self.begins[row], self.ends[row]
        before = np.searchsorted(self.feeds, at)
        line = np.maximum(np.where(before > 0, np.append(self.feeds, 0)[before - 1] + 1, 0), begin)
        following = np.minimum(np.append(self.feeds, self.n)[before], end)
        out["far"] = np.stack((at - begin, end - 1 - at, at - line, following - at), 1)
        classes = []
        for o in OFFSETS:
            there = (at + o >= begin) & (at + o < end)
            classes.append(np.where(there, self.classes[np.where(there, at + o, 0)], len(units) - 1))
        for k in range(3):
            out["pair"][:, k] = classes[2 * k].astype(np.uint16) * len(units) + classes[2 * k + 1]
        out["last"] = classes[6]
        out["bits"] = sum(self.flags[label, kind, at].astype(np.uint8) << bit for bit, (label, kind) in enumerate(targets))
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(units[self.classes], out=sums[1:])  # wraps around, differences don't
        for window, r in zip(("near", "around"), RADII, strict=True):
            counts = sums[np.minimum(at + r + 1, end)] - sums[np.maximum(at - r, begin)]
            out[window] = counts.astype("<u8").view(np.uint8).reshape(-1, 8)
        return out


def _slices(batches: Iterator[pa.RecordBatch], labels: list[str], table: np.ndarray) -> Iterator[_Texts]:
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.utf8_length(batch.column(1)), np.int64))
        cuts = (np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                yield _Texts(part.column(0).to_pylist(), [text for text, _ in decoded(part.column(1).cast(pa.binary()))], part.column(2), labels, table)


def _blocks(rows: np.ndarray) -> Iterator[bytes]:
    """Blocks of ``ROW``, column by column and compressed, behind their length."""
    for k in range(0, len(rows), BLOCK):
        part = rows[k : k + BLOCK]
        far = part["far"].T
        columns = (far.astype("<u2"), (far >> 16).astype("<u2"), part["pair"].T, part["last"], part["bits"], part["near"].T, part["around"].T)
        yield np.int32(len(part)).tobytes() + pa.compress(b"".join(c.tobytes() for c in columns), "lz4", asbytes=True)


class _Block:
    """The columns of a block: indexes of pairs and of the seventh class, targets, and ``NUMBERS`` but for the bias, a row for each."""

    def __init__(self, raw: bytes, logs: np.ndarray, room: np.ndarray):
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        raw = pa.decompress(memoryview(raw)[4:], n * ROW.itemsize, "lz4")
        low, high, pairs = (c.reshape(-1, n) for c in np.split(np.frombuffer(raw, "<u2", 11 * n), (4 * n, 8 * n)))
        last, self.bits, counts = np.split(np.frombuffer(raw, np.uint8, 18 * n, 22 * n), (n, 2 * n))
        self.n, self.pairs, self.last = n, pairs.astype(np.intp), last.astype(np.intp)
        self.numbers = room[:, :n]
        for k, window in enumerate(counts.reshape(2, 8, n)):
            np.divide(window[:7], window[7].astype(np.float64), out=self.numbers[7 * k : 7 * k + 7])
        far = low.astype(np.int32)
        if high.any():
            far += high.astype(np.int32) << 16
        for out, (a, b), least in zip((self.numbers[14:17], self.numbers[17:]), (far[:2], far[2:]), (0, 1), strict=True):
            np.divide(a, np.maximum(1, a + b - least), out=out[0])
            for k, x in ((1, a), (2, b)):
                if high.any():
                    np.log1p(x, out=out[k])
                else:
                    np.take(logs, x, out=out[k], mode="clip")

    def classes(self, k: int) -> np.ndarray:
        """The class at each of ``OFFSETS``, a row for each, of ``k`` classes."""
        return np.stack([f(p, k) for p in self.pairs for f in (np.floor_divide, np.remainder)] + [self.last])


def positions(docs: DataFrame, labels: list[str], targets: list[str], inside: int, negative: int, text: str = "text", spans: str = "spans", seed: int = 0) -> DataFrame:
    """The positions of ``positions.position_rows`` as blocks, those of reservoirs as candidates that ``settle`` sifts.

    ``targets`` (``kind:label``, 8 at most) are the columns that heads may ask for.
    """
    packed, profiles = alphabet()
    units = _units(profiles)
    if len(targets) > 8:
        raise ValueError("a position has room for 8 targets")
    asked = [(labels.index(label), KINDS.index(kind)) for kind, label in (t.split(":", 1) for t in targets)]
    caps = {**dict.fromkeys(labels, inside), NEGATIVE: negative}
    pools = list(caps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(packed), np.uint8)
        held = {p: (np.zeros((0, 4), np.int64), np.zeros(0, ROW)) for p, c in caps.items() if c > 0}
        bound = dict.fromkeys(held, _MOD)  # no larger draw gets into a pool that is full
        texts = 0
        for t in _slices(batches, labels, table):
            sure = t.edge.copy()
            here = {p: t.flags[k, 0] & ~t.edge for k, p in enumerate(labels)} | {NEGATIVE: ~(t.edge | t.flags[:, 0].any(axis=0))}
            for p, c in caps.items():
                if c < 0:
                    sure |= here[p]
            drawn = {}
            if held:
                draws = t.draws(seed)
                low = np.flatnonzero((draws <= max(bound.values())) & ~sure)
                for p in held:
                    at = low[here[p][low] & (draws[low] <= bound[p])]
                    if len(at) > caps[p]:
                        at = at[draws[at] <= np.partition(draws[at], caps[p] - 1)[caps[p] - 1]]
                    drawn[p] = at
            at = np.unique(np.concatenate([np.flatnonzero(sure), *drawn.values()]))
            rows = t.pack(at, units, asked)
            for p, some in drawn.items():
                if not len(some):
                    continue
                row = np.searchsorted(t.ends, some, "right")
                keys = np.column_stack((draws[some], np.array(t.docs, np.int64)[row], some - t.begins[row], texts + row))
                held[p] = (np.concatenate((held[p][0], keys)), np.concatenate((held[p][1], rows[np.searchsorted(at, some)])))
                if len(held[p][0]) > 2 * caps[p]:
                    held[p] = _least(*held[p], caps[p])
                    bound[p] = int(held[p][0][-1, 0])
            texts += len(t.docs)
            for block in _blocks(rows[sure[at]]):
                yield _batch([block], [None])
        held = {p: _least(*both, caps[p]) for p, both in held.items()}
        keys = np.concatenate([np.zeros((0, 4), np.int64), *(k for k, _ in held.values())])
        if len(keys):
            rows = np.concatenate([r for _, r in held.values()])
            bits = np.concatenate([np.full(len(r), 1 << pools.index(p)) for p, (_, r) in held.items()])
            keys, first, same = np.unique(keys, axis=0, return_index=True, return_inverse=True)
            member = np.zeros(len(keys), np.int64)
            np.bitwise_or.at(member, same.ravel(), bits)
            rows = rows[first]
            for k in range(0, len(keys), BLOCK):
                each = [*keys[k : k + BLOCK, :3].T, member[k : k + BLOCK]]
                yield _batch([rows[k : k + BLOCK].tobytes()], [np.stack(each, 1).ravel()])

    return P._rows(docs, text, spans).mapInArrow(scan, "block binary, drawn array<long>")


def _batch(blocks: list[bytes], drawn: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array(drawn, pa.list_(pa.int64()))], ["block", "drawn"])


def _least(keys: np.ndarray, rows: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``cap`` least draws, and all that equal the last of them, in order."""
    order = np.lexsort(keys.T[::-1])
    if len(order) > cap:
        equal = (keys[order, :3] == keys[order[cap - 1], :3]).all(axis=1)
        order = order[: max(cap, int(np.flatnonzero(equal)[-1]) + 1)]
    return keys[order], rows[order]


def settle(found: DataFrame, labels: list[str], inside: int, negative: int) -> DataFrame:
    """``(block)``: blocks of those candidates of ``positions`` that are in the reservoirs of the whole corpus. ``found`` is read twice: persist it."""
    caps = {**dict.fromkeys(labels, inside), NEGATIVE: negative}
    wanted = {p: c for p, c in caps.items() if c > 0}
    if not wanted:
        return found.where("drawn is not null").select("block")  # none
    candidates = found.where("drawn is not null")
    each = candidates.select(F.explode(F.transform(F.sequence(F.lit(0), (F.size("drawn") / 4 - 1).cast("int")), lambda i: F.slice("drawn", 4 * i + 1, F.lit(4)))).alias("d"))
    each = each.select(F.explode(F.array(*[F.when(F.col("d")[3].bitwiseAND(F.lit(1 << k)) != 0, F.lit(p)) for k, p in enumerate(caps)])).alias("pool"), *[F.col("d")[i].alias(c) for i, c in enumerate(("draw", "doc_id", "position"))])
    cuts = P.last_drawn(each.where("pool is not null"), wanted)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, drawn in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                draw, doc, at, member = np.asarray(drawn.values).reshape(-1, 4).T
                stays = np.zeros(len(draw), bool)
                for k, p in enumerate(caps):
                    if p in cuts:
                        first, second, third = cuts[p] or (_MOD, 0, 0)
                        stays |= (member >> k & 1 > 0) & ((draw < first) | (draw == first) & ((doc < second) | (doc == second) & (at <= third)))
                if stays.any():
                    yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(raw, ROW)[stays].tobytes()], pa.binary())], ["rows"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [raw for batch in batches for raw in batch.column(0).to_pylist()]  # as many as the caps allow
        for block in _blocks(np.frombuffer(b"".join(parts), ROW)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    parts = max(1, min(P.MERGE_BUCKETS, sum(wanted.values()) // BLOCK))
    return candidates.mapInArrow(sift, "rows binary").repartition(parts).mapInArrow(join, "block binary")


# --- heads -------------------------------------------------------------------------------------------


def slots(spark: SparkSession, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that ``positions.hashed`` gives the features, and for each class at each of ``OFFSETS`` and each of ``NUMBERS`` what it adds to them."""
    _, profiles = alphabet()
    values = {c: sorted({p[1 if c.endswith("cat") else 0] for p in profiles}) for c in P.CATEGORICAL}
    entries = [(c, None) for c in P.NUMERIC] + [(c, v) for c, some in values.items() for v in some]
    names = [*P.NUMERIC, *P.CATEGORICAL]
    rows = [(k, *(((1.0 if v is None else v) if c == name else None) for name in names)) for k, (c, v) in enumerate(entries)]
    schema = ", ".join(["entry int", *(f"`{c}` double" for c in P.NUMERIC), *(f"`{c}` string" for c in P.CATEGORICAL)])
    found = {entries[r.entry]: int(r.features.indices[0]) for r in P.hashed(spark.createDataFrame(rows, schema), size).collect()}  # a row for each word of a fixed vocabulary
    used = np.unique(list(found.values()))
    at = {e: int(np.searchsorted(used, s)) for e, s in found.items()}
    k = len(profiles)
    adds = np.zeros((len(OFFSETS) * k + len(NUMBERS), len(used)))
    flag = {name: 2 + i for i, name in enumerate(P.TESTS)}
    for i, o in enumerate(OFFSETS):
        prefix = f"n{o:+d}_" if o else ""
        for j, p in enumerate(profiles):
            adds[i * k + j, at[f"{prefix}ch", p[0]]] += 1
            adds[i * k + j, at[f"{prefix}cat", p[1]]] += 1
            if o:
                for name in ("space", "newline"):
                    adds[i * k + j, at[f"{prefix}{name}", None]] += p[flag[f"is_{name}"]] or j == k - 1
            else:
                for name in P.FLAGS:
                    adds[i * k + j, at[name, None]] += p[flag[name]]
    for j, name in enumerate(NUMBERS):
        adds[len(OFFSETS) * k + j, at[name, None]] += 1
    return used, adds


def _sums(blocks: DataFrame, scan) -> dict[int, float]:
    """What tasks say of their blocks ``(at, value)``, added up in an order of its own, so that reruns agree."""
    ordered = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, x: a + x)
    return {r[0]: r[1] for r in blocks.mapInArrow(scan, "at int, value double").groupBy("at").agg(ordered).collect()}  # a row for each parameter


def _said(total: np.ndarray, names: list[str]) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    logs, room = np.log1p(np.arange(_LOGS)), np.empty((len(NUMBERS) - 1, BLOCK))  # the next block overwrites it
    for batch in batches:
        for raw in batch.column(0):
            yield _Block(raw.as_buffer(), logs, room)


def moments(blocks: DataFrame, adds: np.ndarray, k: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each pattern of targets: rows, and the sums of all slots and of their squares.

    Squares of a slot that several features share need their products: classes
    of two places are counted together, and features of one place exclude or imply each other.
    """
    places, words = len(OFFSETS), len(OFFSETS) * k
    tables = [adds[i * k : (i + 1) * k] for i in range(places)] + [adds[words + j : words + j + 1] for j in range(len(NUMBERS))]
    touched = [t.any(axis=0) for t in tables]
    shared = [(a, b, np.flatnonzero(touched[a] & touched[b])) for a in range(len(tables)) for b in range(a + 1, len(tables)) if (touched[a] & touched[b]).any()]
    shared = [(a, b, at, tables[a][:, at], tables[b][:, at]) for a, b, at in shared]
    dims, width = len(adds), adds.shape[1]
    span = 1 + dims + len(NUMBERS) + width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((256, span))
        for block in _read(batches):
            for bits in np.unique(block.bits):
                own, out = block.bits == bits, total[bits]
                classes, numbers = block.classes(k)[:, own], np.concatenate((np.ones((1, block.n)), block.numbers))[:, own]
                out[0] += own.sum()
                for i in range(places):
                    out[1 + i * k : 1 + (i + 1) * k] += np.bincount(classes[i], minlength=k)
                out[1 + words : 1 + dims] += numbers.sum(axis=1)
                out[1 + dims : 1 + dims + len(NUMBERS)] += (numbers**2).sum(axis=1)
                for a, b, at, left, right in shared:
                    if b < places:
                        both = np.bincount(classes[a] * k + classes[b], minlength=k * k).reshape(k, k)
                        more = (left * (both @ right)).sum(axis=0)
                    elif a < places:
                        more = np.bincount(classes[a], numbers[b - places], k) @ left * right[0]
                    else:
                        more = numbers[a - places] @ numbers[b - places] * left[0] * right[0]
                    out[1 + dims + len(NUMBERS) + at] += more
        yield _said(total.ravel(), ["at", "value"])

    found = np.zeros(256 * span)
    for at, value in _sums(blocks, scan).items():
        found[at] = value
    out = {}
    for bits, row in enumerate(found.reshape(256, span)):
        if row[0]:
            first, squares, products = row[1 : 1 + dims], np.append(row[1 : 1 + words], row[1 + dims : 1 + dims + len(NUMBERS)]), row[1 + dims + len(NUMBERS) :]
            out[bits] = (row[0], first @ adds, squares @ adds**2 + 2 * products)
    return out


def _log_product(x: np.ndarray) -> float:
    """The sum of the logarithms of numbers from 1 to 2, of products of some."""
    whole = len(x) // 256 * 256
    return float(np.log(np.multiply.reduce(x[:whole].reshape(256, -1), axis=0)).sum() + np.log(x[whole:]).sum())


def _losses(blocks: DataFrame, heads: list[tuple[int, float, float, np.ndarray, float]], k: int) -> list[tuple[float, float, np.ndarray]]:
    """For each head ``(bit, weight of negatives and of positives, weights, offset)``: sums over rows of the loss, of its slope, and of the slope times each class and number."""
    words = len(OFFSETS) * k
    dims = words + len(NUMBERS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(heads), 2 + dims))
        places = np.stack([w[:words].reshape(len(OFFSETS), k) for *_, w, _ in heads])
        tables = (places[:, :6:2, :, None] + places[:, 1:6:2, None, :]).reshape(len(heads), 3, k * k)
        pairs, singles = np.zeros(tables.shape), np.zeros((len(heads), k))
        for block in _read(batches):
            for h, (bit, low, high, w, offset) in enumerate(heads):
                z = w[words + 1 :] @ block.numbers
                z += places[h, 6][block.last]
                z += offset + w[words]
                for at, table in zip(block.pairs, tables[h], strict=True):
                    z += table[at]
                hit = (block.bits >> bit & 1).astype(bool)
                e = np.exp(-np.abs(z))
                more, weight = 1 + e, np.where(hit, high, low)
                total[h, 0] += low * _log_product(more) + (high - low) * _log_product(more[hit]) + weight @ np.maximum(np.where(hit, -z, z), 0)
                np.multiply(weight, np.where(z >= 0, 1.0, e) / more - hit, out=z)  # the slope
                total[h, 1] += z.sum()
                for i, at in enumerate(block.pairs):
                    pairs[h, i] += np.bincount(at, z, k * k)
                singles[h] += np.bincount(block.last, z, k)
                total[h, 2 + words + 1 :] += block.numbers @ z
        for h in range(len(heads)):
            by = pairs[h].reshape(3, k, k)
            total[h, 2 : 2 + words] = np.concatenate([by[i].sum(axis=1 - side) for i in range(3) for side in (0, 1)] + [singles[h]])
        total[:, 2 + words] = total[:, 1]  # the bias
        yield _said(total.ravel(), ["at", "value"])

    found = np.zeros(len(heads) * (2 + dims))
    for at, value in _sums(blocks, scan).items():
        found[at] = value
    return [(row[0], row[1], row[2:]) for row in found.reshape(len(heads), -1)]


def orthantwise(start: np.ndarray, l1: np.ndarray, most: int = 50, memory: int = 10, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimises a smooth function plus ``l1 * |x|``: yields points, is sent the function's value and gradient there, and returns the last point.

    Orthant-wise L-BFGS with the line search and the stopping rules that Spark ML's elastic net has, so that a fit ends where that would.
    """

    def adjusted(x, value, slope):
        at_zero = np.where(slope - l1 > 0, slope - l1, np.where(slope + l1 < 0, slope + l1, 0.0))
        return value + np.abs(l1 * x).sum(), np.where(l1 == 0, slope, np.where(x == 0, at_zero, slope + np.sign(x) * l1))

    x = start
    value, slope = yield x
    total, pull = adjusted(x, value, slope)
    first, recent, steps, failed = total, [np.inf], [], False
    turn = 0
    while turn < most:
        if len(recent) >= 2 and abs(total - max(recent)) <= tolerance * first or np.linalg.norm(pull) <= max(tolerance * total, 1e-8):
            break
        way, kept = pull.copy(), []
        for s, y in steps:
            kept.append(s @ way / (s @ y))
            way -= kept[-1] * y
        if steps:
            way *= steps[0][0] @ steps[0][1] / (steps[0][1] @ steps[0][1])
        for (s, y), a in zip(reversed(steps), reversed(kept), strict=True):
            way += (a - y @ way / (s @ y)) * s
        way = np.where(-way * pull < 0, -way, 0.0)
        orthant = np.where(x != 0, np.sign(x), np.sign(-pull))

        def moved(step, x=x, way=way, orthant=orthant):
            to = x + way * step
            return np.where(np.sign(to) == orthant, to, 0.0)

        down, shrink = pull @ way, 0.5 if turn else 0.1
        step = 1.0 if turn else 0.5 / np.linalg.norm(slope)
        here = value  # the first step is judged by what it starts from
        for tries in range(20):
            if not tries and here > total + step * down * 1e-4:
                step *= shrink
                continue
            to = moved(step)
            new = yield to
            there, rise = adjusted(to, *new)
            rise = rise @ way
            here = there if tries else here
            factor = shrink if here > total + step * down * 1e-4 else 2.1 if rise < 0.9 * down else shrink if rise > -0.9 * down else 1.0
            if factor == 1 or tries == 19:
                break
            step *= factor
            if not 1e-10 <= step <= 1e10:
                break
        if not 1e-10 <= step <= 1e10:
            if failed:
                break
            failed, steps = True, []  # once without what was learnt of the curvature
            continue
        failed, turn = False, turn + 1
        s, y = to - x, new[1] - slope
        steps = [(s, y), *steps][:memory]
        x, (value, slope) = to, new
        total, pull = adjusted(x, value, slope)
        recent = [*recent, total][-20:]
        if s @ y < 0:
            steps = []
    return x


def fit_heads(blocks: DataFrame, targets: list[str], wanted: list[str], size: int, penalty: float = 0.001, mix: float = 0.05, most: float = 20.0) -> dict[str, tuple[list[float], float]]:
    """What ``models.fit_heads`` learns from ``positions.hashed`` of the same positions, for the ``wanted`` of the ``targets``; all heads in the same passes. ``blocks`` is read again and again: persist it."""
    used, adds = slots(blocks.sparkSession, size)
    k = len(alphabet()[1])
    found = moments(blocks, adds, k)
    out, running = {}, {}
    for target in wanted:
        bit = targets.index(target)
        positive = sum(n for bits, (n, *_) in found.items() if bits >> bit & 1)
        negative = sum(n for n, *_ in found.values()) - positive
        if not negative or not positive:
            out[target] = ([0.0] * (size if found else 0), 20.0 if positive else -20.0)
            continue
        high = min(most, negative / positive)
        weight = {bits: high if bits >> bit & 1 else 1.0 for bits in found}
        mass = high * positive + negative
        mean = sum(weight[b] * first for b, (_, first, _) in found.items()) / mass
        square = sum(weight[b] * second for b, (*_, second) in found.items()) / mass
        spread = square - mean**2
        scale = mass / (mass - (high**2 * positive + negative) / mass)
        inverse = np.where(spread > 1e-13 * square, 1 / np.sqrt(np.maximum(spread * scale, 1e-300)), 0.0)
        start = np.append(np.zeros(len(used)), np.log(high * positive / negative))
        search = orthantwise(start, np.append(np.full(len(used), mix * penalty), 0.0))
        running[target] = [search, next(search), (bit, high, mass, mean, inverse)]
    while running:
        asked = []
        for _, x, (bit, high, _, mean, inverse) in running.values():
            weights = x[:-1] * inverse
            asked.append((bit, 1.0, high, adds @ weights, float(x[-1] - weights @ mean)))
        for (target, state), (loss, slope, each) in zip(list(running.items()), _losses(blocks, asked, k), strict=True):
            search, x, (_, _, mass, mean, inverse) = state
            ridge = (1 - mix) * penalty
            gradient = np.append((each @ adds - mean * slope) * inverse / mass + ridge * x[:-1], slope / mass)
            try:
                state[1] = search.send((loss / mass + ridge / 2 * float(x[:-1] @ x[:-1]), gradient))
            except StopIteration as end:
                weights = np.zeros(size)
                weights[used] = end.value[:-1] * inverse
                out[target] = (weights.tolist(), float(end.value[-1] - (end.value[:-1] * inverse) @ mean))
                del running[target]
    return {target: out[target] for target in wanted}


def train(
    docs: DataFrame, labels: list[str], wanted: list[str], inside: int, negative: int, size: int, text: str = "text", spans: str = "spans", seed: int = 0,
) -> dict[str, tuple[list[float], float]]:
    """Heads for ``wanted`` targets (``kind:label``) over all positions of ``positions.position_rows``: ``{target: (weights, bias)}``, as ``fit_heads`` says. Texts are read once."""
    found = positions(docs, labels, wanted, inside, negative, text, spans, seed).persist()
    kept = settle(found, labels, inside, negative).persist()
    try:
        return fit_heads(found.where("drawn is null").select("block").unionByName(kept), wanted, wanted, size)
    finally:
        kept.unpersist()
        found.unpersist()
