"""Marks and sentences of a text, found in Python workers on Arrow batches.

A fold over arrays inside the JVM is interpreted node by node and copies what it
gathers; here a batch of texts gives flat arrays of offsets and short pieces, at a
fraction of the time. Texts stay in their row: no shuffle, and the work of a row
is its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A class of single characters, or what runs up to one, without ranges or named classes: such a pattern means the same to Java and Python.
PLAIN = re.compile(r"\[(?:[^\\\[\]^&-]|\\[^A-Za-z0-9]|\\[nrtf])+\]|\[\^(?:[^\\\[\]^&-]|\\[^A-Za-z0-9]|\\[nrtf])+\]\+")
BOUNDS = ("start", "end", "start_byte", "end_byte")
#: Bytes of text that a task holds as Python objects at a time; a text is never divided.
SLICE_BYTES = 1 << 22
_BLANKS = re.compile("[ \t\n\r]*")


def byte_offsets(raw: bytes, text: str) -> np.ndarray | None:
    """The byte at which each code point begins, and the end; None where these are the same numbers."""
    if len(raw) == len(text):
        return None
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def texts(raws: pa.Array) -> Iterator[tuple[str | None, bytes]]:
    """Each text of an array of UTF-8 bytes, and its bytes; odd bytes become replacement characters."""
    for raw in raws.to_pylist():
        if raw is None:
            yield None, b""
            continue
        text = raw.decode("utf-8", "replace")
        yield text, raw if "�" not in text else text.encode()


def lists(sizes: list[int | None], values: pa.Array) -> pa.ListArray:
    """An array of lists of these sizes, null where the size is None."""
    missing = np.array([n is None for n in sizes], bool)
    offsets = np.cumsum([0, *(n or 0 for n in sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(missing))


def bounds(spans: list[tuple[str | None, bytes, list[int], list[int]]]) -> dict[str, pa.Array]:
    """``BOUNDS`` of all spans as flat arrays, from those of each text in code points."""
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in BOUNDS}
    for text, raw, starts, ends in spans:
        if text is None or not starts:
            continue
        a, b, at = np.array(starts, np.int64), np.array(ends, np.int64), byte_offsets(raw, text)
        for k, v in zip(BOUNDS, (a, b, a, b) if at is None else (a, b, at[a], at[b]), strict=True):
            parts[k].append(v)
    return {k: pa.array(np.concatenate(v), pa.int64()) for k, v in parts.items()}


def by_slices(run: Callable[..., pa.Array], columns: int = 1) -> Callable[..., pa.Array]:
    """``run`` over a batch in slices of some ``SLICE_BYTES`` of its first column, so that few texts and pieces are Python objects at a time, whatever the batches' size."""

    def slices(*batch: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(pc.binary_length(batch[0]).fill_null(0), np.int64))
        cuts = (np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist()
        return pa.concat_arrays([run(*(c[a:b] for c in batch)) for a, b in zip([0, *cuts], [*cuts, len(batch[0])], strict=True)])

    def one(raws: pa.Array) -> pa.Array:
        return slices(raws)

    def two(raws: pa.Array, pieces: pa.Array) -> pa.Array:
        return slices(raws, pieces)

    out = one if columns == 1 else two
    out.__annotations__ = dict.fromkeys(out.__annotations__, pa.Array)  # Spark reads them as types
    return out


class Places:
    """The bytes of a slice's texts as one array, and where the characters of an ASCII class stand in it (``at``, of which row, and its bounds ``low`` and ``high``)."""

    def __init__(self, raws: pa.Array, table: np.ndarray):
        wide = raws.cast(pa.large_binary())
        offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.at = np.flatnonzero(table[self.data])
        row = np.searchsorted(self.offsets, self.at, "right") - 1
        self.low, self.high = self.offsets[row], self.offsets[row + 1]
        self.sizes = np.diff(np.searchsorted(self.at, self.offsets))
        self.first = np.append(True, row[1:] != row[:-1])[: len(row)]
        solid = np.flatnonzero(~_BLANK[self.data])
        self._solid = np.append(solid, len(self.data))
        #: Where code points begin, None where every byte is one.
        self.lead = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data)) if len(self.data) and self.data.max() > 127 else None

    def char(self, at: np.ndarray) -> np.ndarray:
        """How many code points of the slice begin before a byte."""
        return at if self.lead is None else np.searchsorted(self.lead, at)

    def byte(self, char: np.ndarray) -> np.ndarray:
        return char if self.lead is None else self.lead[char]

    def solid(self, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The first byte from ``at`` on that is no blank, or ``most``."""
        return np.minimum(self._solid[np.searchsorted(self._solid, at)], most)

    def before(self, at: np.ndarray, low: np.ndarray, reach: int) -> np.ndarray:
        """Where up to ``reach`` code points before a byte begin."""
        return np.maximum(self.byte(np.maximum(self.char(at) - reach, 0)), low)

    def behind(self, at: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
        """Where up to ``reach`` code points from a byte on end."""
        return np.minimum(self.byte(np.minimum(self.char(at) + reach, len(self.data) if self.lead is None else len(self.lead) - 1)), high)

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of the slice between bytes."""
        offsets = np.append(0, np.cumsum(ends - starts))
        taken = self.data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(taken)).cast(pa.string())

    def bounds(self, starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> list[pa.Array]:
        """``BOUNDS`` of spans of bytes, in texts that begin at ``low``."""
        base = self.char(low)
        return [pa.array(x.astype(np.int64)) for x in (self.char(starts) - base, self.char(ends) - base, starts - low, ends - low)]


_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
#: ``AROUND`` for all marks of ``Places`` at once: the first and last byte of each piece, from the marks, the ends of their neighbours and the reach.
PIECES: dict[str, Callable[[Places, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]] = {
    "value": lambda p, s, e, last, following, reach: (s, e),
    "left": lambda p, s, e, last, following, reach: (p.before(s, p.low, reach), s),
    "right": lambda p, s, e, last, following, reach: (e, p.behind(e, p.high, reach)),
    "gap": lambda p, s, e, last, following, reach: (last, s),
    "rest": lambda p, s, e, last, following, reach: (e, following),
    "after": lambda p, s, e, last, following, reach: ((a := p.solid(e, following)), p.behind(a, p.high, reach)),
}


def ascii_class(pattern: str) -> np.ndarray | None:
    """Which bytes a ``PLAIN`` class of ASCII characters matches; None for other patterns."""
    if not PLAIN.fullmatch(pattern) or pattern.startswith("[^") or not pattern.isascii():
        return None
    one = re.compile(pattern)
    return np.array([k < 128 and one.fullmatch(chr(k)) is not None for k in range(256)])


def sound(raws: pa.Array) -> bool:
    """Whether all texts are UTF-8, so that bytes say where characters are."""
    try:
        raws.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def sizes_or_none(raws: pa.Array, sizes: np.ndarray) -> list[int | None]:
    return [None if missing else n for missing, n in zip(raws.is_null().to_pylist(), sizes.tolist(), strict=True)]


def spans_between(text: Column, pattern: str, find: Callable[[str, list[int]], tuple[list[int], list[int]]], choose: Callable[[Places], np.ndarray] | None = None) -> Column:
    """An array of spans (``text.SPAN``): ``find`` gives their starts and ends in code points, from a text and where its matches of a pattern for one character end.

    ``choose`` says the same of all marks of a slice at once, where the pattern is an ``ascii_class``: which marks end a span that
    begins at the first non-blank behind the last one. Texts that aren't UTF-8 then are the only ones that are split.
    """
    table = ascii_class(pattern) if choose else None

    def chosen(raws: pa.Array) -> pa.Array:
        places = Places(raws, table)
        keep = choose(places)
        ends, low = places.at[keep] + 1, places.low[keep]
        first = np.append(True, low[1:] != low[:-1])[: len(low)]
        starts = places.solid(np.where(first, low, np.append(0, ends[:-1])[: len(low)]), ends)
        sizes = np.diff(np.searchsorted(ends - 1, places.offsets))
        return lists(sizes_or_none(raws, sizes), pa.StructArray.from_arrays(places.bounds(starts, ends, low), list(BOUNDS)))

    def run(raws: pa.Array, pieces: pa.Array) -> pa.Array:
        if table is not None and sound(raws):
            return chosen(raws)
        if pieces.null_count > raws.null_count:  # a slice of which some texts are UTF-8
            return pa.concat_arrays([run(raws[k : k + 1], pieces[k : k + 1]) for k in range(len(raws))])
        ends = np.cumsum(np.append(0, np.asarray(pc.utf8_length(pieces.values), np.int64) + 1))
        found = []
        for (t, raw), a, b in zip(texts(raws), pieces.offsets[:-1].to_pylist(), pieces.offsets[1:].to_pylist(), strict=True):
            at = ends[a + 1 : b] - ends[a]
            found.append((t, raw, *(find(t, at[at <= len(t)].tolist()) if t else ([], []))))
        return lists([None if t is None else len(starts) for t, _, starts, _ in found], pa.StructArray.from_arrays(list(bounds(found).values()), list(BOUNDS)))

    kind = ",".join(f"{k}:bigint" for k in BOUNDS)
    pieces = F.split(text, pattern, -1)
    return F.arrow_udf(by_slices(run, 2), f"array<struct<{kind}>>")(text.cast("binary"), pieces if table is None else F.when(~F.is_valid_utf8(text), pieces))


#: What ``marks`` can say of the places around a mark, from the text, its bounds, the ends of its neighbours and the reach.
AROUND: dict[str, Callable[[str, int, int, int, int, int], str]] = {
    "value": lambda t, s, e, last, following, reach: t[s:e],
    "left": lambda t, s, e, last, following, reach: t[max(0, s - reach) : s],
    "right": lambda t, s, e, last, following, reach: t[e : e + reach],
    "gap": lambda t, s, e, last, following, reach: t[last:s],
    "rest": lambda t, s, e, last, following, reach: t[e:following],
    "after": lambda t, s, e, last, following, reach: t[(a := _BLANKS.match(t, e, following).end()) : a + reach],
}


def marks(text: Column, pattern: str, around: tuple[str, ...], reach: int) -> Column:
    """``text.locate`` for a ``PLAIN`` pattern and fields of ``AROUND``."""
    mark, named, table = re.compile(pattern), [AROUND[k] for k in around], ascii_class(pattern)

    def at_once(raws: pa.Array) -> pa.Array:
        places = Places(raws, table)
        starts, first = places.at, places.first
        ends = starts + 1
        last = np.where(first, places.low, np.append(0, ends[:-1])[: len(ends)])
        following = np.where(np.append(first[1:], True)[: len(ends)], places.high, np.append(starts[1:], 0)[: len(ends)])
        columns = [*places.bounds(starts, ends, places.low), *(places.pieces(*PIECES[k](places, starts, ends, last, following, reach)) for k in around)]
        return lists(sizes_or_none(raws, places.sizes), pa.StructArray.from_arrays(columns, [*BOUNDS, *around]))

    def run(raws: pa.Array) -> pa.Array:
        if table is not None and sound(raws):
            return at_once(raws)
        found, pieces = [], [[] for _ in named]
        for t, raw in texts(raws):
            starts, ends = ([*x] for x in zip(*(m.span() for m in mark.finditer(t or "")), strict=True)) if t and mark.search(t) else ([], [])
            found.append((t, raw, starts, ends))
            for out, get in zip(pieces, named, strict=True):
                out += [get(t, s, e, last, following, reach) for s, e, last, following in zip(starts, ends, [0, *ends], [*starts[1:], len(t or "")], strict=False)]
        columns = [*bounds(found).values(), *(pa.array(out, pa.string()) for out in pieces)]
        return lists([None if t is None else len(starts) for t, _, starts, _ in found], pa.StructArray.from_arrays(columns, [*BOUNDS, *around]))

    kind = ",".join([*(f"{k}:bigint" for k in BOUNDS), *(f"{k}:string" for k in around)])
    return F.arrow_udf(by_slices(run), f"array<struct<{kind}>>")(text.cast("binary"))


def rest_of_line_shares(text: Column, pattern: str, chars: str) -> Column:
    """``lines.rest_of_line_counts`` for a ``PLAIN`` pattern and ASCII characters: running sums over a text's bytes, asked at each match and at the end of its line."""
    mark, codes = re.compile(pattern), chars.encode()

    def shares(t: str, raw: bytes) -> np.ndarray:
        starts = np.array([m.start() for m in mark.finditer(t)], np.int64)
        at, data = byte_offsets(raw, t), np.frombuffer(raw, np.uint8)
        starts = starts if at is None else at[starts]
        feeds = np.append(np.flatnonzero(data == 10), len(data))
        ends = feeds[np.searchsorted(feeds, starts)]
        out = np.empty((len(starts), len(codes)))
        for k, code in enumerate(codes):
            places = np.flatnonzero(data == code)
            out[:, k] = np.searchsorted(places, ends) - np.searchsorted(places, starts)
        return out / np.maximum(ends - starts, 1)[:, None]

    def run(raws: pa.Array) -> pa.Array:
        found = [None if t is None else shares(t, raw) for t, raw in texts(raws)]
        values = pa.array(np.concatenate([np.zeros((0, len(codes))), *(x for x in found if x is not None)]).ravel())
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(values) // len(codes) + 1) * len(codes), pa.int32()), values)
        return lists([None if x is None else len(x) for x in found], inner)

    return F.arrow_udf(by_slices(run), "array<array<double>>")(text.cast("binary"))


def ascii_members(one: str) -> np.ndarray | None:
    """Which ASCII characters a regex of single characters matches, by code; None where Python may read it otherwise than Java."""
    category = re.fullmatch(r"\\p\{([A-Z][a-z]?)\}", one)
    if category:
        return np.array([k < 128 and unicodedata.category(chr(k)).startswith(category[1]) for k in range(256)])
    if not re.fullmatch(r"\[(?:[^\\\[\]^&]|\\[^A-Za-z0-9]|\\[nrtf])+\]", one):
        return None
    return np.array([k < 128 and re.fullmatch(one, chr(k)) is not None for k in range(256)])


def side_shares(left: Column, right: Column, classes: list[str]) -> Column | None:
    """For each class its share of the characters of ``left`` and of ``right``; null where either isn't ASCII, so that Java says what its characters are."""
    tables = [ascii_members(c) for c in classes]
    if any(t is None for t in tables):
        return None

    def shares(side: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide = side.cast(pa.large_binary())
        offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        within = lambda hits: np.diff(np.append(0, np.cumsum(hits, dtype=np.int64))[offsets - offsets[0]])
        return np.stack([within(t[data]) for t in tables]) / np.maximum(np.diff(offsets), 1), within(data > 127) > 0

    def run(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        (a, odd), (b, odder) = shares(lefts), shares(rights)
        values = np.stack([a, b], 1).reshape(2 * len(tables), -1).T
        missing = odd | odder | np.asarray(lefts.is_null()) | np.asarray(rights.is_null())
        width = 2 * len(tables)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(missing))

    run.__annotations__ = dict.fromkeys(run.__annotations__, pa.Array)  # Spark reads them as types
    return F.arrow_udf(run, "array<double>")(left, right)
