"""Texts out of fetched pages, as column expressions and one aggregate (§2.1, without the fetching)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r"
#: Shortest text that is kept, and most code points of one (fixed values).
LEAST, MOST = 1500, 50_000


def preformatted(html: Column) -> Column:
    """What stands in the first ``pre`` element, or the whole page, without tags and trimmed."""
    inner = F.when(html.rlike("(?s)<pre>.*?</pre>"), F.regexp_extract(html, "(?s)<pre>(.*?)</pre>", 1)).otherwise(html)
    return F.trim(F.regexp_replace(inner, "<[^>]+>", ""), F.lit(BLANKS))


def page_texts(pages: DataFrame, least: int = LEAST, html: str = "html") -> DataFrame:
    """``pages`` with their ``body``, where that has more than ``least`` code points."""
    return pages.withColumn("body", preformatted(F.col(html))).where(F.length("body") > least)


def join_passages(passages: DataFrame, by: str, order: str, text: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """``(by, body)``: a document's non-empty passages in order, a blank line between, cut at ``most``; short ones go.

    One document's passages meet in one row; that is the size of a document.
    """
    rows = passages.where(F.length(text) > 0).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    rows = rows.select(by, F.array_join(F.transform("parts", lambda p: p[text]), "\n\n").alias("body"))
    return rows.where(F.length("body") > least).withColumn("body", F.left("body", F.lit(most)))


def without_front_matter(text: Column, start: str, end: str, most: int = MOST) -> Column:
    """``most`` code points from two fifths into a book of more than twice that, or into one of more than ``most``; null for shorter ones.

    ``start`` and ``end`` are patterns of the lines around the book; a text without both is no book.
    """
    body = F.trim(F.regexp_extract(text, f"(?s)(?:{start})(.*?)(?:{end})", 1), F.lit(BLANKS))
    size, piece = F.length(body), lambda at: F.substring(body, at + 1, most)
    return F.when(size > 2 * most, piece(most * 4 // 5)).when(size > most, piece(most * 2 // 5))
