"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to 3 letters,
words padded with one space), most frequent first. A document's own profile is
compared with each language's by out-of-place distance: for every n-gram of
the document the difference of the two ranks, or ``size`` where the language
lacks it. (Cavnar, Trenkle: N-Gram-Based Text Categorization, 1994.)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import merge_counts, small_batches

UNKNOWN = "und"
#: Code points that are counted at a time.
PIECE = 1 << 17


def letter_table() -> np.ndarray:
    """True for each code point of the Basic Multilingual Plane that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def ngrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers (21 bits for each letter) and their counts.

    A long text is taken in pieces that end between words, so memory follows
    its distinct n-grams.
    """
    text, at, pieces = text.lower(), 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        pieces.append(_count_ngrams(text[at:end], letters))
        at = end
        if len(pieces) > 32:
            pieces = [merge_counts(pieces)]
    return pieces[0] if len(pieces) == 1 else merge_counts(pieces)


def _count_ngrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one piece of lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[np.minimum(points, 0xFFFF)]
    if (astral := points > 0xFFFF).any():
        is_letter[astral] = [chr(c).isalpha() for c in points[astral]]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate(([32], np.where(is_letter, points, 32), [32]))
    is_letter = np.concatenate(([False], is_letter, [False]))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    points, is_letter = points[keep], is_letter[keep]
    two = (points[:-1] << 42) | (points[1:] << 21)
    three = (two[:-1] | points[2:])[is_letter[1:-1]]
    return np.unique(np.concatenate((points[is_letter] << 42, two, three)), return_counts=True)


@dataclass(frozen=True)
class Profiles:
    """Rank of each n-gram in each language; ``size`` where it isn't in the profile."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """Nearest language (ties: the least name) and 1 minus its distance over the largest possible."""
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        if len(grams) > self.size:
            least = np.partition(counts, -self.size)[-self.size]
            frequent = counts >= least
            grams, counts = grams[frequent], counts[frequent]
        own = grams[np.lexsort((grams, -counts))][: self.size]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        hit = self.grams[at] == own
        ranks = np.where(hit, self.ranks[:, at], self.size)
        away = np.where(ranks < self.size, np.abs(ranks - np.arange(len(own))), self.size).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.size * len(own)))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", size: int = 400, per_language: int = 2000) -> Profiles:
    """Learn profiles from rows with a non-null label.

    The fit reads a sample of about ``per_language`` documents of each language
    (a hash of ``key_col`` decides, so reruns agree; a language of fewer rows is
    read whole): that is the documented bound of this model. Counts are summed
    in Spark, and only the ``size`` top n-grams of each language reach the driver.
    """
    rows = labelled.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    totals = rows.groupBy("lang").agg(F.count("*").alias("rows")).collect()
    rates = {r["lang"]: min(1.0, per_language / r["rows"]) for r in totals}
    if not rates:
        return Profiles([], np.zeros(1, np.int64), np.zeros((0, 1), np.int64), size)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit(10)), F.lit(1_000_000)) < rate * 1_000_000)

    def count(batches):
        letters = letter_table()
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                found: list = []
                for text in texts:
                    found.append(ngrams(text, letters))
                    if len(found) > 256:
                        found = [merge_counts(found)]
                grams, counts = merge_counts(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    summed = picked.select("text", "lang").transform(small_batches).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    languages = sorted(rates)
    grams = np.unique([r["gram"] for r in top]) if top else np.zeros(1, np.int64)
    ranks = np.full((len(languages), len(grams)), size, np.int64)
    for r in top:
        ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"] - 1
    return Profiles(languages, grams, ranks, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(id, lang_pred, score)``, one row for each row of ``docs``, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text when there is no profile. Repeated rows give repeated rows;
    other columns aren't read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType

    def predict(batches):
        letters = letter_table()
        for batch in batches:
            found = [profiles.predict(*ngrams(t or "", letters)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(predict, f"id {kind.simpleString()}, lang_pred string, score double")


def held_out(column: str) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = 0.02) -> DataFrame:
    """The rows whose language is identified with at least ``min_score``, with all their columns.

    What goes: null texts, texts without letters, and texts whose n-grams are
    in next to no profile.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def select(batches):
        letters = letter_table()
        for batch in batches:
            found = (profiles.predict(*ngrams(t or "", letters)) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(select, schema)
