"""Packing documents into token sequences by linear grouping.

Documents are tokenised, those longer than a sequence are cut, and pieces are
counted by length, of which there are at most ``capacity``. On these counts
(never on documents) the driver rounds large lengths up within groups of equal
cardinality, finds configurations of the few rounded sizes by column
generation, puts actual lengths in their places and best-fits the rest. Its
plan is a list of runs: "the pieces of length ``l`` from rank ``r`` on go to
these sequences at these offsets". Spark ranks the pieces of each length and
looks every piece up. (Fernandez de la Vega, Lueker: Bin packing can be solved
within 1 + epsilon in linear time, 1981.)
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import discard, durable, small_batches, utf8_batch

CAPACITY = 2048
#: Ends every document.
END_ID = 0
#: ``(parts, groups)`` of the plans tried: lengths of ``capacity / parts`` or more are large and form so many groups.
#: The first plan that no other can beat is kept, else that of fewest sequences.
SCHEMES = ((2, 64), (3, 128), (4, 64))
#: Characters that are encoded at a time: many texts share chunks, and what is held is some hundred MB at most.
STEP_CHARS = 1 << 23
#: White space as the tokenizers' patterns have it (Unicode's White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No token crosses from a character that isn't white space to one that is, so chunks are encoded one by one, each once for a batch.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: Texts whose chunks aren't just what stands between blanks.
_IRREGULAR = f"[{_SPACE}] |^ "
#: Chunks that may be encoded in one string: white space first and none last, characters whose classes all versions of Unicode agree on.
_JOINABLE = f"^[\t-\r \x85\xa0](?s:.*)[^{_SPACE}]$"
_PLAIN = "^[\x01-\u024f\u2010-\u2027]*$"
#: The pattern by which byte-level BPE splits text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merges_as_ranks(tokenizer: str):
    """An encoder by ranks for the file of a plain byte-level BPE, in which a token's id tells when it is merged; else nothing."""
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        raw = json.load(f)
    split, model = raw.get("pre_tokenizer") or {}, raw["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not raw.get("normalizer") and model.get("type") == "BPE"
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], model["merges"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    first = len(vocab) - len(merges)
    if first != 256 or any(vocab.get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of many texts at once, each distinct chunk being encoded once.

    Ids are those of the file's tokenizer. Chunks of plain characters, without
    added tokens, are merged by ``merges_as_ranks``, which gives the same ids
    in less time; all others go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.ranks = merges_as_ranks(tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.ranks:
            known = self.ranks.token_byte_values()
            self.sizes = np.zeros(self.ranks.n_vocab, np.int64)
            self.sizes[[self.ranks.encode_single_token(t) for t in known]] = [len(t) for t in known]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, at most about ``STEP_CHARS`` characters at a time."""
        parts: list[str] = []
        of: list[int] = []
        for k, text in enumerate(texts):
            for part in segments(text or ""):
                parts.append(part)
                of.append(k)
        held: list[np.ndarray] = []
        at = done = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to]) <= STEP_CHARS):
                size += len(parts[to])
                to += 1
            for k, ids in zip(of[at:to], self._group(parts[at:to]), strict=True):
                if k > done:
                    yield np.concatenate(held)
                    held, done = [], k
                held.append(ids)
            at = to
        if held:
            yield np.concatenate(held)

    def _group(self, parts: list[str]) -> list[np.ndarray]:
        texts = pa.array(parts, pa.large_string())
        odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR))
        regular, order = np.flatnonzero(~odd), []
        lists = pc.split_pattern(texts.take(pa.array(regular)), " ")
        first = np.zeros(len(lists.flatten()), bool)
        first[np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()] = True
        chunks = [pc.if_else(pa.array(first), lists.flatten(), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), lists.flatten(), pa.scalar("", pa.large_string())))]
        counts = np.zeros(len(parts), np.int64)
        counts[regular] = np.asarray(lists.value_lengths())
        order += regular.tolist()
        for k in np.flatnonzero(odd).tolist():
            found = _CHUNK.findall(parts[k])
            chunks.append(pa.array(found, pa.large_string()))
            counts[k] = len(found)
            order.append(k)
        coded = pa.concat_arrays(chunks).dictionary_encode()
        ids, ends = self._distinct(coded.dictionary)
        which = np.asarray(coded.indices)
        size = np.diff(ends, prepend=0)[which]
        stop = np.cumsum(size)
        flat = ids[np.repeat(ends[which] - stop, size) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.append(0, stop)[np.append(0, np.cumsum(counts[order]))]
        out: list[np.ndarray] = [flat[:0]] * len(parts)
        for n, k in enumerate(order):
            out[k] = flat[bounds[n] : bounds[n + 1]]
        return out

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and where each ends."""
        joined = np.zeros(len(chunks), bool)
        if self.ranks:
            joined = np.asarray(pc.match_substring_regex(chunks, _PLAIN)) & np.asarray(pc.match_substring_regex(chunks, _JOINABLE))
            for token in self.added:
                joined &= ~np.asarray(pc.match_substring(chunks, token))
        together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        pieces: list[np.ndarray] = []
        sizes = np.zeros(len(chunks), np.int64)
        if len(together):
            picked = chunks.take(pa.array(together))
            data, bounds = utf8_batch(picked)
            found = np.array(self.ranks.encode_ordinary(data.tobytes().decode()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[found]), bounds[1:]) + 1
            sizes[together] = np.diff(ends, prepend=0)
            pieces.append(found)
        if len(alone):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks.take(pa.array(alone)).to_pylist(), add_special_tokens=False)]
            sizes[alone] = [len(f) for f in found]
            pieces += [np.array(f, np.uint32) for f in found]
        order = np.concatenate((together, alone))
        ends = np.zeros(len(chunks), np.int64)
        ends[order] = np.cumsum(sizes[order])
        # in the order of the chunks: their ids stand elsewhere, so they are gathered once
        flat = np.concatenate([*pieces, np.zeros(0, np.uint32)])
        stop = np.cumsum(sizes)
        return flat[np.repeat(ends - stop, sizes) + np.arange(stop[-1] if len(stop) else 0)], stop


def segments(text: str) -> Iterator[str]:
    """A text in parts of about ``STEP_CHARS`` characters at most, each beginning where a chunk does; a chunk that is longer stays whole."""
    at = 0
    while len(text) - at > STEP_CHARS and (found := _CUT.search(text, at + STEP_CHARS)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """``(start, length, crc32)`` of each piece of a document's ids; all but the first are full."""
    n, raw = len(ids), memoryview(ids.astype("<u4").tobytes())
    first = n if n <= capacity else n % capacity or capacity
    for start, end in zip([0, *range(first, n, capacity)], [*range(first, n + 1, capacity)], strict=True):
        yield start, end - start, zlib.crc32(raw[4 * start : 4 * end])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, task, nth)``: a row for each piece, the ``nth`` of its length in its task."""

    def scan(batches):
        encoder = Encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in together(batches, STEP_CHARS):
            found, owner = [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                for k, (start, length, crc) in enumerate(cut(np.append(ids, np.uint32(END_ID)), capacity)):
                    found.append((k, start, length, crc, task, seen[length]))
                    owner.append(row)
                    seen[length] += 1
            columns = np.array(found, np.int64).reshape(-1, 6).T
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:4]), pa.array(columns[4].astype(np.int32)), pa.array(columns[5])],
                ["id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(
        scan, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


# --- the plan, on counts of lengths ---------------------------------------------------------------


def linear_groups(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(rounded size, [(length, count), ...])`` from long to short: large lengths in groups of equal cardinality."""
    total = int(counts[large:-1].sum())
    groups = max(1, min(groups, total))
    bounds = [total * (k + 1) // groups for k in range(groups)]
    out: list[tuple[int, list[tuple[int, int]]]] = []
    members: list[tuple[int, int]] = []
    done = 0
    for length in range(len(counts) - 2, large - 1, -1):
        left = int(counts[length])
        while left:
            take = min(left, bounds[len(out)] - done)
            if take:
                members.append((length, take))
            done, left = done + take, left - take
            if done == bounds[len(out)]:
                out.append((members[0][0], members))
                members = []
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` of greatest worth within ``capacity``, as a count for each size."""
    use = np.flatnonzero(worth > 1e-12)
    best = np.zeros(capacity + 1)
    picks: list[np.ndarray] = []
    while len(use):
        took = np.full((len(use), capacity + 1), -np.inf)
        for row, k in enumerate(use):
            took[row, sizes[k] :] = best[: capacity + 1 - sizes[k]] + worth[k]
        pick = took.argmax(axis=0)
        value = took[pick, np.arange(capacity + 1)]
        better = value > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, use[pick], -1))
        best = np.where(better, value, best)
    config = np.zeros(len(sizes), np.int64)
    at = capacity
    for pick in reversed(picks):
        if pick[at] >= 0:
            config[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(config @ worth), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, rounded down: the linear programme over all configurations, by column generation."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(12 * n + 50):
        worth = inverse.sum(axis=0)
        value, config = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ config
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        row = int(ratio.argmin())
        theta = ratio[row]
        amount = amount - theta * step
        amount[row] = theta
        columns[:, row] = config
        pivot = inverse[row] / step[row]
        inverse -= np.outer(step, pivot)
        inverse[row] = pivot
    return [(columns[:, k].astype(np.int64), int(amount[k] + 1e-6)) for k in range(n) if amount[k] + 1e-6 >= 1]


def take(queue: list[tuple[int, int]], times: int) -> list[tuple[int, int]]:
    """The last ``times`` pieces of a stack of ``(length, count)``, as such a stack."""
    out = []
    while times:
        length, count = queue.pop()
        used = min(count, times)
        if count > used:
            queue.append((length, count - used))
        out.append((length, used))
        times -= used
    return out[::-1]


class Plan:
    """Runs ``(length, rank, per, sequence, offset)``: from that rank on, each sequence from that one on gets ``per`` pieces of the length."""

    def __init__(self, capacity: int):
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.capacity = capacity
        self._rank: Counter[int] = Counter()
        self._rooms: list[int] = []  # sorted, those that some sequence has left
        self._open: dict[int, list[tuple[int, int]]] = {}  # first and number of the sequences with so much room

    def place(self, length: int, per: int, first: int, many: int, offset: int) -> None:
        self.runs.append((length, self._rank[length], per, first, offset))
        self._rank[length] += per * many

    def leave(self, room: int, first: int, many: int) -> None:
        if room not in self._open:
            insort(self._rooms, room)
            self._open[room] = []
        self._open[room].append((first, many))

    def substitute(self, config: np.ndarray, times: int, queues: list[list[tuple[int, int]]]) -> None:
        """``times`` sequences of a configuration, each rounded size being an actual piece of its group."""
        slots = [take(queues[k], times) for k in np.repeat(np.arange(len(config)), config)]
        while times:
            many, offset = min(slot[-1][1] for slot in slots), 0
            for slot in slots:
                length, count = slot.pop()
                if count > many:
                    slot.append((length, count - many))
                self.place(length, 1, self.sequences, many, offset)
                offset += length
            self.leave(self.capacity - offset, self.sequences, many)
            self.sequences += many
            times -= many

    def best_fit(self, length: int, left: int) -> None:
        """``left`` pieces of a length, each in the fullest sequence that has room for it."""
        while left:
            at = bisect_left(self._rooms, length)
            if at == len(self._rooms):
                self.leave(self.capacity, self.sequences, -(-left // (self.capacity // length)))
                self.sequences += self._open[self.capacity][-1][1]
                continue
            room = self._rooms[at]
            first, many = self._open[room].pop()
            if not self._open[room]:
                del self._open[room], self._rooms[at]
            per = min(room // length, left)
            used = min(many, left // per)
            self.place(length, per, first, used, self.capacity - room)
            left -= per * used
            if many > used:
                self.leave(room, first + used, many - used)
            self.leave(room - per * length, first, used)


def plan(counts: np.ndarray, parts: int, groups: int) -> Plan:
    """A plan for ``counts[length]`` pieces of every length up to the capacity."""
    capacity = len(counts) - 1
    left = counts.copy()
    out = Plan(capacity)
    if left[capacity]:
        out.place(capacity, 1, 0, int(left[capacity]), 0)
        out.sequences += int(left[capacity])
        left[capacity] = 0
    large = max(1, -(-capacity // parts))
    if left[large:].any():
        merged: dict[int, list[tuple[int, int]]] = {}
        for size, members in linear_groups(left, large, groups):
            merged.setdefault(size, []).extend(members)
        sizes = np.array(list(merged))
        queues = [m[::-1] for m in merged.values()]
        demand = np.array([sum(n for _, n in m) for m in merged.values()], float)
        for config, times in configurations(sizes, demand, capacity):
            out.substitute(config, times, queues)
        left[large:] = 0
        for queue in queues:
            for length, count in queue:
                left[length] += count
    for length in np.flatnonzero(left)[::-1]:
        out.best_fit(int(length), int(left[length]))
    return out


def best_plan(counts: np.ndarray, schemes=SCHEMES) -> Plan:
    """The plan of fewest sequences among ``schemes``; what the driver holds depends on the capacity, not on the number of pieces."""
    least = -(-sum(int(n) * length for length, n in enumerate(counts)) // (len(counts) - 1))
    best = None
    for parts, groups in schemes:
        found = plan(counts, parts, groups)
        if best is None or found.sequences < best.sequences:
            best = found
        if best.sequences == least:
            break
    return best


# --- on Spark --------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``: where every piece of every document goes.

    A document is its tokens and ``END_ID``; one of more than ``capacity`` ids
    is cut into pieces of which all but the first are full. Every piece lies in
    one sequence, and a sequence's pieces fill it from 0 without a gap.
    ``tokenizer`` is the path of a byte-level BPE file that executors can open.
    A null text is empty and has the end id alone; rows that share an id are
    packed one by one, null ids too; other columns aren't read; an empty table
    gives an empty result; equal lengths are told apart by task and order, so
    ties don't matter.

    Texts are read once and never shuffled. The table of pieces is counted by
    length, ranks within a length are sums of counts of tasks, and the plan is
    broadcast: its size is bounded by the capacity (some thousand runs).
    """
    spark = docs.sparkSession
    found = durable(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    by_task = durable(found.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # a row for each length
        counts[length] = n
    runs = np.array(sorted(best_plan(counts).runs), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(runs)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = durable(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    ranked = found.join(bases, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def locate(batches):
        length, rank, per, sequence, offset = sent.value.T
        starts = (length << 40) + rank
        for batch in batches:
            own, at = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            run = np.searchsorted(starts, (own << 40) + at, "right") - 1
            nth = at - rank[run]
            places = sequence[run] + nth // per[run], offset[run] + nth % per[run] * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, places)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    discard(by_task)
    return ranked.mapInArrow(locate, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
