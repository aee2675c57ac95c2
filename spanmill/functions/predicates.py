"""Line and segment predicates (§2.5) as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a full stop that end no sentence (fixed values).
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "inc", "ltd", "co", "corp", "no", "vol", "fig", "cf", "al", "e.g", "i.e")


def section_like(line: Column) -> Column:
    """Short, without a closing terminal, and marked, numbered or upper-case."""
    c = F.trim(line)
    letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    upper = F.regexp_count(c, F.lit("[A-Z]"))
    return F.length(c).between(1, 140) & ~c.rlike("[.!?;,]\\z") & (c.rlike("^#+ ") | c.rlike("^(?i)(chapter|section|part|article|appendix)\\b") | (letters > 0) & (100 * upper > 85 * letters))


def dialogue_like(line: Column) -> Column:
    """Speaker and colon, or an opening quote or dash, with some text behind."""
    c = F.trim(line)
    return (F.length(c) >= 10) & c.rlike("^(?:[A-Za-z][A-Za-z ]{0,30}: |[\"“‘]|[—–] ?)")


def list_item_like(line: Column) -> Column:
    c = F.trim(line)
    return (F.length(c) >= 5) & c.rlike("^(?:[-*•] |[0-9]{1,3}[.)] |[A-Za-z][.)] )")


def metadata_like(line: Column) -> Column:
    """``key: value`` with a short key, or an address or date line."""
    c = F.trim(line)
    return F.length(c).between(5, 180) & (c.rlike("^[A-Za-z][A-Za-z _-]{0,38}: ") | c.rlike("(?i)^(?:by|date|from|to|subject)\\b") & ~c.rlike("[.!?]\\z"))


def display_type(line: Column) -> Column:
    """First that holds of metadata, heading, list, dialogue, prose and empty."""
    return (
        F.when(F.length(F.trim(line)) == 0, "empty")
        .when(metadata_like(line), "metadata")
        .when(section_like(line), "heading")
        .when(list_item_like(line), "list")
        .when(dialogue_like(line), "dialogue")
        .otherwise("prose")
    )


def quality_ok(text: Column, alpha: float = 0.55, symbols: float = 0.18, control: float = 0.01) -> Column:
    """Enough letters, few symbols and control characters, spaces in longer texts, and no run over 160 without one."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    spaces = F.regexp_count(text, F.lit("[ \\t\\n\\r]"))
    longest = F.array_max(F.transform(F.split(text, "[ \\t\\n\\r]+"), F.length))
    return (
        (share("\\p{L}") >= alpha) & (share("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]") <= control) & (share("[^\\p{L}\\p{N} \\t\\n\\r.,;:!?'\"()-]") <= symbols)
        & ((F.length(text) < 40) | (spaces / n >= 0.02)) & (longest <= 160)
    )


def has_terminal(text: Column) -> Column:
    """Ends with a terminal, closers aside; an ellipsis is none."""
    bare = F.regexp_replace(F.rtrim(text, F.lit(" \t\n\r")), "[\"')\\]}”’»]+\\z", "")
    return bare.rlike("[.!?。！？]\\z") & ~bare.rlike("(?:\\.\\.\\.|…)\\z")


def unbalanced_quotes(text: Column) -> Column:
    return F.regexp_count(text, F.lit("“")) != F.regexp_count(text, F.lit("”"))


def edge_flags(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Whether a span continues beyond its edges: no boundary (start, line break or terminal) on that side."""
    before, after = F.rtrim(F.substring(text, F.lit(1), start.cast("int"))), F.substring(text, (end + 1).cast("int"), F.lit(1_000_000_000))
    left = (F.length(before) > 0) & ~before.rlike("[.!?\\n\\r][\"')\\]}”’»]*\\z")
    inside = F.rtrim(F.substring(text, F.lit(1), end.cast("int")))
    right = (F.length(F.trim(after)) > 0) & ~inside.rlike("[.!?][\"')\\]}”’»]*\\z") & ~after.rlike("^[ \\t]*[\\n\\r]")
    return left, right


def span_quality(value: Column) -> Column:
    """Reason why a sentence span isn't one, or ``ok``."""
    return (
        F.when(F.length(F.trim(value)) == 0, "empty")
        .when(F.trim(value) != value, "untrimmed")
        .when(F.length(value) < 12, "short")
        .when(value.rlike("\\n[ \\t]*\\n"), "crosses paragraphs")
        .when(unbalanced_quotes(value), "quotes")
        .when(~has_terminal(value), "no terminal")
        .otherwise("ok")
    )


def paragraph_like(text: Column) -> Column:
    """Prose: 40 letters and 20 lower-case ones at least, no blank line, a first line that is no section, list item or metadata, and a terminal."""
    body = F.trim(text, F.lit(" \t\n\r"))
    first = F.trim(F.regexp_extract(body, "^[^\\n\\r]*", 0))
    enough = (F.regexp_count(body, F.lit("\\p{L}")) >= 40) & (F.regexp_count(body, F.lit("\\p{Ll}")) >= 20)
    terminal = has_terminal(body) | body.rlike("[.!?][\"')\\]}”’]*[ \\t\\n\\r]")
    return (F.length(body) > 0) & ~body.contains("\n\n") & ~section_like(first) & ~list_item_like(first) & ~metadata_like(first) & enough & terminal


#: Labels of blocks that sentences may lie in (fixed values).
SENTENCE_PARENTS = ("paragraph", "dialogue", "list_item")


def squeezed(text: Column) -> Column:
    """Without ``&#xD;``, white space as single spaces."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("&#xD;"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))


def sentence_eligible(text: Column, label: Column, least: int = 30, least_letters: int = 15) -> Column:
    """Whether a block may hold sentences: by label, length, letters and lower case, and no heading or metadata."""
    body = squeezed(text)
    return (
        label.isin(*SENTENCE_PARENTS) & (F.length(body) >= least) & (F.regexp_count(body, F.lit("\\p{L}")) >= least_letters) & body.rlike("\\p{Ll}") & ~section_like(body) & ~metadata_like(body)
    )


def block_has_terminal(text: Column) -> Column:
    """Whether a block's text ends with a mark and closers."""
    return squeezed(text).rlike("[.!?][\"'”’)\\]]*\\z")


def eligible_outputs(here: Column, closes_here: Column, at_end: Column, breaks: Column, sentence: Column, paragraph: Column) -> tuple[Column, Column]:
    """Masks of a candidate's two outputs: positives always count, else a terminal whose closers end at the break, and an end of text or a blank line."""
    return sentence | here.rlike("^[.!?…]") & closes_here, paragraph | at_end | (breaks >= 2)


def false_boundary(left: Column, right: Column) -> Column:
    """Whether a full stop between two contexts ends no sentence: abbreviation, initial, number, roman numeral, decimal, or lower case behind."""
    word = F.lower(F.regexp_extract(left, "([A-Za-z.]+)\\z", 1))
    follow = F.regexp_extract(right, "^[ \\t\\n\\r\"')\\]]*(.)", 1)
    return (
        word.isin(*ABBREVIATIONS) | left.rlike("(?:^|[^A-Za-z])[A-Z]\\z") | left.rlike("(?:^|[\\n\\r])[ \\t]*(?:[0-9]{1,3}|[IVXLC]{1,6})\\z")
        | left.rlike("[0-9]\\z") & right.rlike("^[0-9]") | follow.rlike("\\p{Ll}")
    )


_LAST_WORD, _FOLLOW = re.compile("[A-Za-z.]+\\Z"), re.compile("[ \t\n\r\"')\\]]*(.)")
_INITIAL, _NUMBERED = re.compile("(?:^|[^A-Za-z])[A-Z]\\Z"), re.compile("(?:^|[\n\r])[ \t]*(?:[0-9]{1,3}|[IVXLC]{1,6})\\Z")


def is_false_boundary(left: str, right: str) -> bool:
    """``false_boundary`` of one full stop."""
    word, follow = _LAST_WORD.search(left), _FOLLOW.match(right)
    return bool(
        word and word[0].lower() in ABBREVIATIONS or _INITIAL.search(left) or _NUMBERED.search(left) or re.search("[0-9]\\Z", left) and re.match("[0-9]", right)
        or follow and unicodedata.category(follow[1]) == "Ll"
    )
