"""Personal data: base patterns, and terms that give a protected entity away.

Information-theoretic sanitisation in the sense of Sanchez and Batet: the
corpus tells how much a term discloses about a protected entity. Here an
entity is a value that the base patterns find, and it co-occurs with every word
of the documents that hold it. A term ``t`` discloses an entity ``e`` where
``P(e | t)``, the documents with both over the documents with ``t``, is at
least ``DISCLOSURE``: then seeing ``t`` leaves at most ``-log2(DISCLOSURE)``
bits of ``e``. Such terms are generalised wherever they stand, also in documents
that don't hold the entity, as they give it away there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bit_filter, combined, discard, durable, maybe, small_batches, steps, utf8_batch
from spanmill.llm.textscan import SYMBOL_SEPARATORS, RangeHasher, class_table, lower_table, word_spans

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
DISCLOSURE = 0.5
#: Bits of the filters that keep scans to entities and words that may count: 1 MB each at any corpus size.
FILTER_BITS = 1 << 23
#: One document of so many tells which words are too common to disclose anything.
PART = 64
#: Up to so many disclosing terms are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def find_emails(text: str):
    """Bounds of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost, in time linear in the text.

    The part before an ``@`` holds none, so it is the longest run of its
    characters to the left that no earlier match has taken.
    """
    done = 0
    for m in _DOMAIN.finditer(text):
        at, low = m.start(), max(done, text.rfind("@", done, m.start()) + 1)
        stop = _NOT_LOCAL.search(text[low:at][::-1])
        start = at - stop.start() if stop else low
        if start < at:
            done = m.end()
            yield start, done


def find_personal(text: str) -> list[tuple[str, int, int]]:
    """Base spans ``(kind, start, end)`` in code points, by start and then in the order of ``KINDS``."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in find_emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _entities(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Distinct hashes, as int64, of the values of base spans."""
    values = [f"{kind}:{text[s:e]}".encode() for kind, s, e in spans]
    bounds = np.cumsum([0, *map(len, values)])
    return np.unique(RangeHasher(np.frombuffer(b"".join(values), np.uint8))(bounds[:-1], bounds[1:]).view(np.int64))


def _terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes as int64, starts and ends of the words of three letters or more outside all base spans."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char_at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), class_table(SYMBOL_SEPARATORS))
    a, b = char_at[starts], char_at[ends]
    low, high = np.array([s for _, s, _ in spans], np.int64), np.maximum.accumulate([0, *(e for _, _, e in spans)])
    before = np.searchsorted(low, b, "left")  # spans that begin before the word ends
    free = (b - a >= 3) & (high[before] <= a)
    return RangeHasher(raw, lower_table())(starts, ends).view(np.int64)[free], a[free], b[free]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, base, entities)`` for each row: a hash of the text, base spans and the hashes of their values."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            base, entities = [], []
            for text in batch.column(2).to_pylist():
                spans = find_personal(text) if text else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                entities.append(_entities(text, spans) if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.int64()))], ["id", "key", "base", "entities"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.transform(small_batches).mapInArrow(run, f"id {kind}, key long, base array<struct<kind:string,start:bigint,end:bigint>>, entities array<bigint>")


def count_held(docs: DataFrame, known: np.ndarray, text_col: str = "text") -> DataFrame:
    """``(term, held)``: in how many rows that hold an entity of the filter ``known`` each term occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def found(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = find_personal(text) if text else []
                if spans and maybe(sent.value, _entities(text, spans)).any():
                    terms = np.unique(_terms(text, spans)[0])
                    yield terms, np.ones(len(terms), np.int64)

    def run(batches):
        for term, n in combined(found(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "n"])

    return docs.select(text_col).transform(small_batches).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("held"))


def find_holders(docs: DataFrame, known: np.ndarray, terms: np.ndarray, text_col: str = "text") -> DataFrame:
    """``(row, entities, terms)`` for each row that holds an entity of ``known``: these, and its distinct words of ``terms``."""
    sent = docs.sparkSession.sparkContext.broadcast((known, terms))

    def run(batches):
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, entities, words = [], [], []
            for text in batch.column(0).to_pylist():
                spans = find_personal(text) if text else []
                own = _entities(text, spans) if spans else np.zeros(0, np.int64)
                own = own[maybe(sent.value[0], own)]
                if len(own):
                    found = np.unique(_terms(text, spans)[0])
                    rows.append(n := n + 1)
                    entities.append(own)
                    words.append(found[maybe(sent.value[1], found)])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (entities, words))], ["row", "entities", "terms"])

    return docs.select(text_col).transform(small_batches).mapInArrow(run, "row long, entities array<bigint>, terms array<bigint>")


def count_terms(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, documents)``: in how many rows of ``docs`` each of ``terms`` occurs, and a few other words.

    A filter of ``FILTER_BITS`` bits, made of the terms, goes to every task and
    keeps other words from being shuffled; what it lets through wrongly goes in
    the caller's join.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(terms, "term", FILTER_BITS))

    def found(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column(0))
            for i, j in steps(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = word_spans(part, own, class_table(SYMBOL_SEPARATORS))
                hashes = RangeHasher(part, lower_table())(starts, ends).view(np.int64)
                k = np.flatnonzero(maybe(sent.value, hashes))
                row = np.searchsorted(bounds, k, "right")
                order = np.lexsort((row, hashes[k]))
                h, r = hashes[k][order], row[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                yield np.unique(h[fresh], return_counts=True)

    def run(batches):
        for term, n in combined(found(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "n"])

    return docs.select(text_col).transform(small_batches).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("documents"))


def find_disclosing(docs: DataFrame, entities: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(term)``: the hashes of terms that disclose an entity.

    A pair needs ``support`` documents and a disclosure at the threshold at
    least. So its entity has that many documents, and its term at most
    ``1 / disclosure`` times as many as its entity; only what can meet this is paired.
    A word that already stands in more than ``held / disclosure`` of a part of the
    documents can't meet it whatever the others hold, so such common words are
    told by that part and aren't counted in every task; all others are counted in all documents.
    """
    known = entities.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("holders")).where(F.col("holders") >= support)
    known = durable(known, "known")
    known_bits = bit_filter(known, "entity", FILTER_BITS)
    held = durable(count_held(docs, known_bits, text_col).where(F.col("held") >= support), "held")
    part = count_terms(docs.where(F.pmod(F.xxhash64(text_col), F.lit(PART)) == 0), held, text_col).withColumnRenamed("documents", "some")
    rare = held.join(part, "term", "left").where(F.col("some").isNull() | (F.col("held") >= disclosure * F.col("some"))).select("term", "held")
    rare = durable(rare, "rare")
    totals = rare.join(count_terms(docs, rare, text_col), "term").where(F.col("held") >= disclosure * F.col("documents")).select("term", "documents")
    totals = durable(totals, "totals")
    holders = durable(find_holders(docs, known_bits, bit_filter(totals, "term", FILTER_BITS), text_col), "holders")
    near = holders.select("row", F.explode("entities").alias("entity")).join(known, "entity")
    words = holders.select("row", F.explode("terms").alias("term")).join(totals, "term")
    pairs = near.join(words, "row").where(F.col("holders") >= disclosure * F.col("documents")).groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("documents").alias("documents"))
    found = durable(pairs.where((F.col("both") >= support) & (F.col("both") >= disclosure * F.col("documents"))).select("term").distinct(), "disclosing")
    discard(known, held, rare, totals, holders)
    return found


@dataclass(frozen=True)
class TermSet:
    """Disclosing terms as a filter of fixed size and, up to ``BROADCAST_TERMS`` of them, as sorted hashes."""

    mask: np.ndarray
    exact: np.ndarray | None

    @staticmethod
    def of(terms: DataFrame) -> TermSet:
        exact = np.sort(np.asarray(terms.select("term").toArrow()["term"])) if terms.count() <= BROADCAST_TERMS else None
        return TermSet(bit_filter(terms, "term", FILTER_BITS), exact)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the set, or that may be where ``exact`` is None."""
        k = np.flatnonzero(maybe(self.mask, hashes))
        if self.exact is None or not len(k):
            return k
        at = np.minimum(np.searchsorted(self.exact, hashes[k]), max(len(self.exact) - 1, 0))
        return k[self.exact[at] == hashes[k]] if len(self.exact) else k[:0]


def _rows_with_terms(terms: TermSet, data: np.ndarray, offsets: np.ndarray):
    """``(row, text, base spans, hashes, starts, ends)`` of each row with a term outside its base spans."""
    for i, j in steps(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = word_spans(part, own, class_table(SYMBOL_SEPARATORS))
        hit = terms.find(RangeHasher(part, lower_table())(starts, ends).view(np.int64))
        for row in np.unique(np.searchsorted(bounds, hit, "right") - 1).tolist():
            text = part[own[row] : own[row + 1]].tobytes().decode("utf-8", "replace")
            base = find_personal(text)
            found = _terms(text, base)
            k = terms.find(found[0])
            yield i + row, text, base, *(x[k] for x in found)


def find_places(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, start, end)``: where words of ``terms`` stand in any row, outside its base spans.

    Words that are no terms go where they are read; where the terms are too
    many to be sent whole, a join drops what their filter let through.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = TermSet.of(terms)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for row, _, _, *found in _rows_with_terms(sent.value, *utf8_batch(batch.column(2))):
                at = pa.array(np.full(len(found[0]), row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, found)], ["id", "key", "term", "start", "end"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    places = texts.transform(small_batches).mapInArrow(run, f"id {kind}, key long, term long, start long, end long")
    if known.exact is None:
        places = places.join(terms, "term", "left_semi")
    return places.select("id", "key", "start", "end")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``(id, key, base, spans)`` for each row of ``docs``.

    ``base`` holds the spans of the base patterns and ``spans`` these and the
    disclosing terms, each ``(kind, start, end)`` in code points. A null or
    empty text has none; rows that share id and text share spans; other columns
    aren't read; an empty table gives an empty result.
    """
    entities = durable(find_entities(docs, id_col, text_col), "entities")
    places = find_places(docs, find_disclosing(docs, entities, text_col, **thresholds), id_col, text_col)
    terms = places.groupBy(F.col("id").alias("of"), F.col("key").alias("text_key")).agg(
        F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("terms")
    )
    rows = entities.join(terms, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("text_key")), "left")
    every = F.concat("base", F.coalesce("terms", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    ordered = F.transform(
        F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return rows.select("id", "key", "base", ordered.alias("spans"))


def span_text(column: str):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_text(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """All rows and columns of ``docs``, personal data and disclosing terms replaced in the text.

    Base patterns and terms are matched anew where the text is rewritten, so no
    text is shuffled. Only where the terms are too many to be sent whole are
    their places joined to the texts. A null text stays null.
    """
    entities = durable(find_entities(docs, id_col, text_col), "entities")
    terms = find_disclosing(docs, entities, text_col, **thresholds)
    discard(entities)
    known = TermSet.of(terms)
    at, schema, rows = docs.columns.index(text_col), docs.schema, docs
    if known.exact is None:
        places = find_places(docs, terms, id_col, text_col).groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("start", "end")).alias("__terms"))
        here = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key"))
        rows = docs.join(places, here, "left").drop("__id", "__key")
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if sent.value.exact is None:
                found = {k: [("term", s["start"], s["end"]) for s in x] for k, x in enumerate(batch.column(len(schema)).to_pylist()) if x}
            else:
                found = {row: [("term", a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] for row, _, _, _, starts, ends in _rows_with_terms(sent.value, *utf8_batch(batch.column(at)))}
            for k, text in enumerate(texts):
                spans = (find_personal(text) if text else []) + found.get(k, [])
                if spans:
                    texts[k] = mask_text(text, sorted(spans, key=lambda s: s[1]))
            columns = list(batch.columns[: len(schema)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.transform(small_batches).mapInArrow(run, schema)
