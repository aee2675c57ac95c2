"""Training positions of texts: label reservoirs over all positions, and features of those that were taken.

Reservoirs are bottom-k samples by a hash of document and position, so samples
of parts of a corpus merge into that of the whole: each task keeps its least
draws of each pool, and Spark the least of those. The last draw of each pool
that is in then tells every position in a second pass, so texts are never
shuffled and no position becomes a row before it is taken.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators.sampling import _A, _B, _MOD

SPANS = "array<struct<label:string,start:bigint,end:bigint,left_open:boolean,right_open:boolean>>"
BOUNDARY, NEGATIVE = "<boundary>", "<negative>"
#: What a position can be of a label (fixed values).
KINDS = ("inside", "start", "end", "left_open", "right_open")
#: Buckets in which the draws of tasks are merged before those of a pool meet.
MERGE_BUCKETS = 64


def keys(document: int, positions: np.ndarray, seed: int) -> np.ndarray:
    """The draws of positions of a document, below 2**31 - 1: two steps of the congruence of ``sampling.draw``, without its division."""
    x = ((document + seed) % _MOD * _A + positions % _MOD * _B + 12345) % _MOD
    return x * _A % _MOD * _B % _MOD


def _columns(spans: pa.StructArray, labels: list[str]) -> tuple[np.ndarray, ...]:
    """Spans as arrays: number of the label (-1 for others), start and end (-1 for none), and whether they are open to the left and right."""
    which = pc.index_in(spans.field("label"), value_set=pa.array(labels, pa.string())).fill_null(-1)
    return tuple(np.asarray(c) for c in (which, *(spans.field(k).fill_null(-1) for k in ("start", "end")), *(spans.field(k).fill_null(False) for k in ("left_open", "right_open"))))


def _flags(n: int, which: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, labels: int) -> np.ndarray:
    """``(labels, kinds, n)`` flags of a text's positions; spans outside the text, empty ones and other labels count for nothing."""
    sound = (which >= 0) & (start >= 0) & (end <= n) & (start < end)
    which, start, end, left, right = (c[sound] for c in (which, start, end, left, right))
    out = np.zeros((labels, len(KINDS), n), bool)
    for k in range(labels):
        own = which == k
        depth = np.bincount(start[own], minlength=n + 1) - np.bincount(end[own], minlength=n + 1)
        np.greater(np.cumsum(depth[:n]), 0, out=out[k, 0])
    out[which[~left], 1, start[~left]] = True
    out[which[~right], 2, end[~right] - 1] = True
    out[which[left & (start == 0)], 3, 0] = True
    out[which[right & (end == n)], 4, n - 1] = True
    return out


def pools(flags: np.ndarray, labels: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Positions of each pool: boundaries of any label, else inside each label, else none of it."""
    edge = flags[:, 1:].any(axis=(0, 1))
    inside = flags[:, 0]
    yield BOUNDARY, np.flatnonzero(edge)
    for k, label in enumerate(labels):
        yield label, np.flatnonzero(inside[k] & ~edge)
    yield NEGATIVE, np.flatnonzero(~edge & ~inside.any(axis=0))


def _rows(docs: DataFrame, text: str, spans: str) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.length(text) > 0)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(spans), F.array()).cast(SPANS).alias("spans")
    )


def _each(batches: Iterator[pa.RecordBatch], labels: list[str]):
    for batch in batches:
        found = batch.column(2)
        at = found.offsets.to_pylist()  # into all values, also where the batch is a slice
        columns = _columns(found.values, labels)
        for k, (doc, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)):
            yield doc, text, _flags(len(text), *(c[at[k] : at[k + 1]] for c in columns), len(labels))


def reservoir_cuts(docs: DataFrame, labels: list[str], inside: int, negative: int, text: str = "text", spans: str = "spans", seed: int = 0) -> dict[str, tuple[int, int, int] | None]:
    """For each pool the largest ``(draw, doc_id, position)`` that is in its reservoir; nothing where all are in, an impossible one for a cap of 0.

    ``inside`` is the cap for each label, ``negative`` that for positions inside
    no label; -1 is all and 0 none. Boundaries have no cap.
    """
    caps = {**{label: inside for label in labels}, NEGATIVE: negative}
    out: dict[str, tuple[int, int, int] | None] = {BOUNDARY: None, **{p: (None if c < 0 else (-1, -1, -1)) for p, c in caps.items()}}
    wanted = {p: c for p, c in caps.items() if c > 0}
    if not wanted:
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {p: np.zeros((0, 3), np.int64) for p in wanted}
        bound = dict.fromkeys(wanted, _MOD)  # no larger draw gets into a pool that is full
        for doc, _, flags in _each(batches, labels):
            every = keys(doc, np.arange(flags.shape[2]), seed)
            low = np.flatnonzero(every <= max(bound.values()))
            for pool, at in pools(flags[:, :, low], labels):
                if pool in wanted and len(at):
                    draws, at = every[low[at]], low[at]
                    draws, at = draws[draws <= bound[pool]], at[draws <= bound[pool]]
                    if not len(at):
                        continue
                    few = np.argpartition(draws, wanted[pool] - 1)[: wanted[pool]] if len(at) > wanted[pool] else np.arange(len(at))
                    few = np.flatnonzero(draws <= draws[few].max())  # with ties, by position
                    more = np.column_stack((draws[few], np.full(len(few), doc), at[few]))
                    both = np.concatenate((held[pool], more))
                    if len(both) > 2 * wanted[pool]:
                        both = both[np.lexsort(both.T[::-1])[: wanted[pool]]]
                        bound[pool] = int(both[-1, 0])
                    held[pool] = both
        for pool, rows in held.items():
            rows = rows[np.lexsort(rows.T[::-1])[: wanted[pool]]]
            yield pa.RecordBatch.from_arrays([pa.array([pool] * len(rows), pa.string()), *(pa.array(c) for c in np.ascontiguousarray(rows.T))], ["pool", "draw", "doc_id", "position"])

    drawn = _rows(docs, text, spans).mapInArrow(scan, "pool string, draw long, doc_id long, position long")
    return out | last_drawn(drawn, wanted)


def last_drawn(drawn: DataFrame, caps: dict[str, int]) -> dict[str, tuple[int, int, int] | None]:
    """For each pool of ``drawn`` ``(pool, draw, doc_id, position)`` the last of as many as its cap, nothing where there are fewer."""
    order = [F.col("draw"), F.col("doc_id"), F.col("position")]
    cap = F.coalesce(*[F.when(F.col("pool") == p, c) for p, c in caps.items()])
    for by in ([F.col("pool"), F.pmod(F.col("draw"), F.lit(MERGE_BUCKETS))], [F.col("pool")]):
        drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= max(caps.values())).where(F.col("r") <= cap).drop("r")
    last = drawn.groupBy("pool").agg(F.count("*").alias("n"), F.max(F.struct("draw", "doc_id", "position")).alias("last"))
    found = {r.pool: (r.n, tuple(r.last)) for r in last.collect()}  # a row for each pool
    return {pool: found[pool][1] if found.get(pool, (0, None))[0] == cap_of else None for pool, cap_of in caps.items()}


def _taken(doc: int, flags: np.ndarray, labels: list[str], cuts: dict, seed: int) -> dict[str, np.ndarray]:
    """The positions of each pool that its reservoir holds."""
    out = {}
    every = keys(doc, np.arange(flags.shape[2]), seed)
    for pool, at in pools(flags, labels):
        cut = cuts[pool]
        if cut is not None and len(at):
            draws = every[at]
            first, second, third = cut
            at = at[(draws < first) | (draws == first) & ((doc < second) | (doc == second) & (at <= third))]
        out[pool] = at
    return out


def select_positions(docs: DataFrame, labels: list[str], inside: int, negative: int, text: str = "text", spans: str = "spans", seed: int = 0) -> DataFrame:
    """``(doc_id, position, pool)``: every boundary of the labelled spans, and reservoirs of positions inside each label and inside none.

    ``spans`` is an array of ``SPANS`` in code points. A position inside several
    labels may stand in several pools. Reruns agree. Null and empty texts and
    null ids have no positions, null spans are none; rows that share an id draw
    alike.
    """
    cuts = reservoir_cuts(docs, labels, inside, negative, text, spans, seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, flags in _each(batches, labels):
            for pool, at in _taken(doc, flags, labels, cuts, seed).items():
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(at), pa.array([pool] * len(at))], ["doc_id", "position", "pool"])

    return _rows(docs, text, spans).mapInArrow(scan, "doc_id long, position long, pool string")


# --- features of positions ---------------------------------------------------------------------------

NEIGHBOURS = (-3, -2, -1, 1, 2, 3)
RADII = (8, 32)
RATES = ("alpha", "digit", "space", "newline", "upper", "punct", "quote")
QUOTES = "\"'“”‘’"
FLAGS = ("is_alpha", "is_upper", "is_lower", "is_digit", "is_space", "is_newline", "is_punct")
#: What a character can be.
TESTS = {
    "is_alpha": str.isalpha, "is_upper": str.isupper, "is_lower": str.islower, "is_digit": str.isdigit, "is_space": str.isspace, "is_newline": lambda c: c in "\r\n",
    "is_punct": lambda c: unicodedata.category(c)[0] == "P", "is_quote": lambda c: c in QUOTES,
}
CATEGORICAL = ("ch", "cat", *(f"n{o:+d}_{c}" for o in NEIGHBOURS for c in ("ch", "cat")))
NUMERIC = (
    "bias", *FLAGS, "pos_frac", "from_start_log", "to_end_log", *(f"n{o:+d}_{c}" for o in NEIGHBOURS for c in ("space", "newline")),
    *(f"r{r}_{name}_rate" for r in RADII for name in RATES), "line_pos_frac", "line_from_start_log", "line_to_end_log",
)


def bucket(ch: str) -> str:
    """What a character counts as: itself in lower case for ASCII letters, itself for ASCII punctuation, else a class in angle brackets."""
    named = {"": "<EDGE>", "\n": "<LF>", "\r": "<CR>", "\t": "<TAB>"}
    category = unicodedata.category(ch) if ch else ""
    if ch in named:
        return named[ch]
    plain = ord(ch) < 128
    if ch.isspace():
        return "<SPACE>"
    if ch.isdigit():
        return "<DIGIT>"
    if ch.isalpha():
        return ch.lower() if plain else "<LETTER_NONASCII>"
    if category[0] == "P":
        return ch if plain else f"<PUNCT_{category}>"
    return f"<{category}>"


def position_features(text: str, at: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """``NUMERIC`` and ``CATEGORICAL`` columns of positions of a text; each distinct character is classified once."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, which = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in distinct]
    which = np.append(which, len(chars))  # one more for what is outside
    names = np.array([*(bucket(c) for c in chars), "<EDGE>"], object)
    cats = np.array([*(unicodedata.category(c) for c in chars), "NONE"], object)
    flag = {name: np.array([*map(test, chars), False], float) for name, test in TESTS.items()}
    own = which[at]
    numeric = {"bias": np.ones(len(at)), **{f: flag[f][own] for f in FLAGS}}
    numeric |= {"pos_frac": at / max(1, n - 1), "from_start_log": np.log1p(at), "to_end_log": np.log1p(n - 1 - at)}
    categorical = {"ch": names[own], "cat": cats[own]}
    outside = {"is_space": 1.0, "is_newline": 1.0}
    for o in NEIGHBOURS:
        there = (at + o >= 0) & (at + o < n)
        near = which[np.where(there, at + o, n)]
        categorical |= {f"n{o:+d}_ch": names[near], f"n{o:+d}_cat": cats[near]}
        numeric |= {f"n{o:+d}_{c}": np.where(there, flag[f"is_{c}"][near], outside[f"is_{c}"]) for c in ("space", "newline")}
    sums = {name: np.append(0, np.cumsum(flag[f"is_{name}"][which[:n]])) for name in RATES}
    for r in RADII:
        low, high = np.maximum(at - r, 0), np.minimum(at + r + 1, n)
        numeric |= {f"r{r}_{name}_rate": (sums[name][high] - sums[name][low]) / np.maximum(high - low, 1) for name in RATES}
    feeds = np.flatnonzero(codes == 10)
    before = np.searchsorted(feeds, at)
    start = np.where(before > 0, np.append(feeds, 0)[before - 1] + 1, 0)
    end = np.append(feeds, n)[before]
    numeric |= {"line_pos_frac": (at - start) / np.maximum(1, end - start - 1), "line_from_start_log": np.log1p(at - start), "line_to_end_log": np.log1p(end - at)}
    return numeric, categorical


def position_rows(docs: DataFrame, labels: list[str], inside: int, negative: int, text: str = "text", spans: str = "spans", seed: int = 0) -> DataFrame:
    """The positions of ``select_positions``, each once, with targets ``kind:label`` (0 or 1) and the columns ``NUMERIC`` and ``CATEGORICAL``."""
    cuts = reservoir_cuts(docs, labels, inside, negative, text, spans, seed)
    names = [f"{kind}:{label}" for label in labels for kind in KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, body, flags in _each([batch], labels):
                at = np.unique(np.concatenate(list(_taken(doc, flags, labels, cuts, seed).values())))
                if not len(at):
                    continue
                numeric, categorical = position_features(body, at)
                hot = flags.reshape(-1, len(body))[:, at].astype(np.int32)
                columns = [pa.array(np.full(len(at), doc)), pa.array(at), *map(pa.array, hot), *(pa.array(numeric[c]) for c in NUMERIC), *(pa.array(categorical[c], pa.string()) for c in CATEGORICAL)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", *names, *NUMERIC, *CATEGORICAL])

    schema = ["doc_id long", "position long", *(f"`{c}` int" for c in names), *(f"`{c}` double" for c in NUMERIC), *(f"`{c}` string" for c in CATEGORICAL)]
    return _rows(docs, text, spans).mapInArrow(scan, ", ".join(schema))


def hashed(rows: DataFrame, size: int = 1 << 16, out: str = "features") -> DataFrame:
    """``rows`` with ``NUMERIC`` and ``CATEGORICAL`` columns as one sparse vector of ``size`` slots, by Spark's hashing of names and values."""
    from pyspark.ml.feature import FeatureHasher

    made = FeatureHasher(inputCols=[*NUMERIC, *CATEGORICAL], outputCol=out, numFeatures=size, categoricalCols=list(CATEGORICAL)).transform(rows)
    return made.drop(*NUMERIC, *CATEGORICAL)
