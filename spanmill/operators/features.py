"""Fixed-width feature blocks around candidate positions, as Catalyst expressions over a bounded context.

``context`` cuts the characters near each candidate out of the text once; every
block works on these short strings, so a long document costs its own length.
Byte windows are given for ASCII contexts; other characters count as code 255.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import marks as K
from spanmill.functions import text as T
from spanmill.functions.lexicon import DEFAULT, Lexicon
from spanmill.operators import candidates as C
from spanmill.operators import lines as L

REACH = 32
#: Everything that the blocks below look at.
EVERYTHING = ("value", "left", "right", "before", "behind", "after", "token", "breaks", "breaks_behind")


def context(docs: DataFrame, pattern: str = "[.!?]", text: str = "text", reach: int = REACH, around: tuple[str, ...] = EVERYTHING) -> DataFrame:
    """``(doc_id, feature_pos, here, ...)``: a candidate and what ``around`` names of its context (see ``text.locate``).

    Windows hold up to ``reach`` characters; blank runs, words and tokens count whole.
    """
    rows = C.spans(docs, pattern, text, around=("value", *around), reach=reach)
    return rows.select("doc_id", F.col("start_byte").alias("feature_pos"), F.col("value").alias("here"), *[n for n in around if n != "value"])


#: Fields that ``line_context`` adds.
LINE_FLAGS = ("heading", "list", "metadata", "next_heading", "next_list", "line_breaks_before")
#: What the blocks below look at, where that isn't everything.
BLOCK_FIELDS = {"ascii_neighbours": ("left", "right"), "token_shape": ("left", "right", "after", "token", "breaks")}
#: How far they look, where that isn't ``REACH``.
BLOCK_REACH = {"ascii_neighbours": 1}
#: Characters whose shares in the rest of the line are features (fixed values).
LINE_CHARS = "\n#-*:\"'<>,"


def line_context(docs: DataFrame, pattern: str = "[.!?]", text: str = "text", reach: int = REACH, around: tuple[str, ...] = EVERYTHING, chars: str = LINE_CHARS) -> DataFrame:
    """``context`` with ``LINE_FLAGS`` of each candidate's line and ``line_shares``: shares of ``chars`` in the rest of its line (none for no ``chars``)."""
    fields = tuple(dict.fromkeys(("value", *around)))
    kind = T.SPAN.removeprefix("struct<")[:-1] + "".join(f",{n}:{T.AROUND[n][0]}" for n in fields)
    marks = L.with_line_flags(F.col(text), T.locate(text, pattern, fields, reach), kind)
    if chars:
        marks = F.arrays_zip(marks.alias("x"), L.rest_of_line_counts(text, pattern, chars).alias("line_shares"))
    else:
        marks = F.transform(marks, lambda m: F.struct(m.alias("x")))
    shares = ["line_shares"] if chars else []
    rows = docs.select("doc_id", F.explode(marks).alias("e")).select("doc_id", "e.x.m.*", "e.x.f.*", *[f"e.{c}" for c in shares])
    return rows.select("doc_id", F.col("start_byte").alias("feature_pos"), F.col("value").alias("here"), *[n for n in around if n != "value"], *LINE_FLAGS, *shares)


def line_shares(docs: DataFrame, pattern: str = "[.!?]", text: str = "text", chars: str = LINE_CHARS) -> DataFrame:
    """``(doc_id, feature_pos, line_shares)``: the part of ``line_context`` that looks at no flags and no neighbours."""
    both = F.arrays_zip(T.locate(text, pattern).alias("m"), L.rest_of_line_counts(text, pattern, chars).alias("line_shares"))
    return docs.select("doc_id", F.explode(both).alias("e")).select("doc_id", F.col("e.m.start_byte").alias("feature_pos"), "e.line_shares")


def _at(offset: int, get: Callable[[str], Column] = F.col) -> Column:
    """The character ``offset`` places from the candidate, empty outside the text."""
    if offset == 0:
        return get("here")
    if offset > 0:
        return F.substring(get("right"), offset, 1)
    return F.when(F.length(get("left")) >= -offset, F.substring(get("left"), offset, 1)).otherwise("")


def _codes(left: int, right: int) -> Column:
    """Character codes of a window, as an array."""
    return F.transform(F.array(*[_at(k) for k in range(-left, right + 1)]), T.char_code)


def byte_window(left: int, right: int) -> Column:
    """Codes over 255 from ``left`` before to ``right`` behind, 0 outside."""
    return F.transform(_codes(left, right), lambda c: c / 255.0)


def encoded_window(left: int, right: int) -> Column:
    """Ordinal codes of the same window."""
    return F.transform(_codes(left, right), lambda c: T.encoded_byte(c).cast("double"))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def ascii_neighbours() -> Column:
    """Previous and next character: space, upper, lower."""
    tests = lambda ch: (ch.isin(*" \t\n\r\f"), ch.between("A", "Z"), ch.between("a", "z"))  # noqa: E731  of one character or none
    return F.concat(*[T.let(_at(side), lambda ch: F.array(*map(flag, tests(ch)))) for side in (-1, 1)])


def boundary_shape() -> Column:
    """What stands at, before and behind the candidate, and what its line and the next look like (22 columns of ``line_context``)."""
    here, after, before = F.col("here"), F.col("behind"), F.col("before")
    tests = [
        here.rlike("[.!?…]"), here == ".", here == "!", here == "?", here.rlike("[:;]"), here.rlike("[\"')\\]}>”’»]"), before.rlike("[.!?…]\\z"), after.rlike("^\\p{Lu}"), after.rlike("^\\p{Ll}"),
        after.rlike("^[0-9]"), after.rlike("^[\"'“‘]"), after.startswith("#"), after.rlike("^[-*•]"), F.length(after) == 0, F.col("right").rlike("^[\"')\\]}>”’»]"),
        F.col("breaks_behind") >= 2, F.col("line_breaks_before") >= 2, *map(F.col, LINE_FLAGS[:5]),
    ]
    return F.array(*[flag(t) for t in tests])


def token_shape() -> Column:
    """The token that ends at the candidate and the one that follows."""
    return T.let(F.regexp_extract("after", "^[A-Za-z]*", 0), _token_tests)


def _token_tests(following: Column) -> Column:
    token = F.col("token")
    period = F.col("here") == "."
    tests = [
        flag(period & F.col("left").rlike("[0-9]\\z") & F.col("right").rlike("^[0-9]")),
        flag(period & F.col("left").rlike("[0-9]\\z")),
        flag(period & F.col("right").rlike("^[0-9]")),
        F.least(token["dots"], F.lit(4)) / 4.0,
        F.least(token["letters"], F.lit(16)) / 16.0,
        flag(token["first"]),
        F.when(token["letters"] > 0, token["capitals"] / token["letters"]).otherwise(0.0),
        F.least(F.length(following), F.lit(16)) / 16.0,
        flag(following.rlike("^[A-Z]")),
        flag(following.rlike("^[a-z]")),
        flag(F.col("breaks") > 0),
        flag(period & token["first"] & token["letters"].between(1, 4)),
    ]
    return F.array(*tests)


def class_counts(classes: list[str], left: int, right: int, directional: bool = False) -> Column:
    """Share of each character class (a regex) in the clamped window; directional: left and right on their own, ASCII ones on Arrow batches."""
    a, b = F.when(F.length("left") > left, F.right("left", F.lit(left))).otherwise(F.col("left")), F.substring("right", 1, right)
    share = lambda s, c: T.class_count(s["text"], c) / s["size"]
    side = lambda c: F.struct(c.alias("text"), F.greatest(F.length(c), F.lit(1)).alias("size"))
    if directional:
        sides = T.let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.struct(side(x["a"]).alias("a"), side(x["b"]).alias("b")))
        slow = T.let(sides, lambda x: F.array(*[share(x[k], c) for c in classes for k in ("a", "b")]))
        quick = K.side_shares(a, b, classes)
        return slow if quick is None else F.coalesce(quick, slow)
    return T.let(T.let(F.concat(a, F.col("here"), b), side), lambda x: F.array(*[share(x, c) for c in classes]))


_PUNCTUATION = "[!-/:-@\\[-`{-~]"


def _length_share(c: Column) -> Column:
    return F.least(F.ln(F.octet_length(c) + 1.0) / F.ln(F.lit(1024.0)), F.lit(1.0))


def line_shape(line: str = "raw") -> Column:
    """Lengths, indent, character shares and endings of a line (14 columns)."""
    c, body = F.col(line), L.bare(F.col(line))
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    some = F.greatest(F.regexp_count(c, F.lit("\\p{L}")), F.lit(1))
    indent = F.octet_length(c) - F.octet_length(F.regexp_replace(c, f"^{L.SPACE}+", ""))
    return F.array(
        _length_share(c), _length_share(body), F.least(indent / 64.0, F.lit(1.0)), share("\\p{L}"), share("[0-9]"), share(L.SPACE), share(_PUNCTUATION), share(_PUNCTUATION),
        F.regexp_count(c, F.lit("\\p{Lu}")) / some, F.regexp_count(c, F.lit("\\p{Ll}")) / some, share("[\"'“”‘’]"), flag(body.endswith(":")), flag(body.rlike("[.;,]\\z")), flag(~body.rlike("\\p{Ll}")),
    )


def line_context_metrics() -> Column:
    """Place of a line in its text and shapes of its neighbours (22 columns over ``lines.line_table``)."""
    sides = [F.col("previous"), F.col("following")]

    def shape(side: str) -> Column:
        def known(body: Column) -> Column:
            return F.struct(body.alias("body"), F.greatest(F.length(body), F.lit(1)).alias("n"), T.class_count(body, "\\p{L}").alias("letters"))

        def values(x: Column) -> Column:
            body, n, letters = x["body"], x["n"], x["letters"]
            return F.array(
                _length_share(body), letters / n, T.class_count(body, "[0-9]") / n, T.class_count(body, "\\p{Lu}") / F.greatest(letters, F.lit(1)), T.class_count(body, _PUNCTUATION) / n,
                flag(F.length(body) == 0),
            )

        return T.let(T.let(L.bare(F.col(side)), known), values)

    end = F.col("start_byte") + F.octet_length("raw")
    place = [flag(F.col("start_byte") == 0), flag(end >= F.col("size")), F.col("position") / F.greatest(F.col("size"), F.lit(1)), flag(F.col("before") >= 2), flag(F.col("after") >= 2)]
    kinds = [flag(test(c)) for test in (T.heading_like, T.list_like, T.metadata_colon) for c in sides]

    def joined(x: Column) -> Column:
        return F.array(*place, *[x[side][k] for k in range(5) for side in ("a", "b")], *kinds, F.greatest(x["a"][5], x["b"][5]))

    return T.let(F.struct(shape("previous").alias("a"), shape("following").alias("b")), joined)


#: The ten byte classes of counts, as regexes.
BYTE_CLASSES = {
    "upper": "[A-Z]", "lower": "[a-z]", "alpha": "[A-Za-z]", "digit": "[0-9]", "alnum": "[A-Za-z0-9]", "space": "[ \\t\\n\\r\\f]", "punctuation": _PUNCTUATION,
    "line_break": "[\\n\\r]", "open_bracket": "[(\\[{]", "close_bracket": "[)\\]}]",
}
#: General categories by group.
UNICODE_GROUPS = ("\\p{L}", "\\p{N}", "\\p{P}", "\\p{S}", "\\p{Z}", "\\p{C}")
COUNTED = ("upper", "lower", "digit", "space", "punctuation", "line_break", "open_bracket", "close_bracket")


def sentence_kernel(encoded: int = 15, radius: int = 16, tokens: bool = False) -> Column:
    """The preset of sentence models over ``line_context``: 97 columns, 109 with ``tokens``."""
    blocks = [
        encoded_window(encoded, encoded), ascii_neighbours(), boundary_shape(), class_counts([BYTE_CLASSES[c] for c in COUNTED], radius, radius, True), class_counts(list(UNICODE_GROUPS), radius, radius, True),
        F.col("line_shares"), *([token_shape()] if tokens else []),
    ]
    return F.concat(*blocks)


def rounded(values: Column, digits: int = 6) -> Column:
    """Blocks at query edges: rounded so that engines agree, joined to one string."""

    def whole(y: Column) -> Column:
        return F.when(y == F.floor(y), F.floor(y)).otherwise(F.round(y).cast("bigint")).cast("string")

    return F.array_join(F.transform(values, lambda x: whole(x.cast("double") * 10**digits)), ",")


def line_edges(prefix: int, suffix: int, line: str = "line") -> Column:
    """``(code + 1) / 256`` of a line's first characters, then of its last ones backwards; 0 past its length."""
    c, n = F.col(line), F.length(line)
    value = lambda ch, ok: F.when(ok, (T.char_code(ch) + 1) / 256.0).otherwise(0.0)
    head = [value(F.substring(c, k + 1, 1), n > k) for k in range(prefix)]
    return F.array(*head, *[value(F.substring(c, (n - k).cast("int"), F.lit(1)), n > k) for k in range(suffix)])


def ngram_hashes(lines: DataFrame, buckets: int = 64, least: int = 2, most: int = 4) -> DataFrame:
    """``(doc_id, feature_pos, features)``: signed hashed byte n-grams of each line, scaled by the root of their number.

    Bytes are lower-cased (A-Z). The 64-bit FNV-1a hash, started from its basis
    xor n, wraps around, which SQL arithmetic can't; it runs on Arrow batches.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        basis, prime = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
        for batch in batches:
            out = []
            for line in batch.column(2).to_pylist():
                raw = np.frombuffer(line.encode().lower(), np.uint8).astype(np.uint64)
                total, count = np.zeros(buckets), 0
                for n in range(least, min(most, len(raw)) + 1):
                    h = np.full(len(raw) - n + 1, basis ^ np.uint64(n))
                    for k in range(n):
                        h = (h ^ raw[k : k + len(h)]) * prime
                    np.add.at(total, (h % np.uint64(buckets)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0))
                    count += len(h)
                out.append((total / np.sqrt(count) if count else total).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "feature_pos", "features"])

    return lines.select("doc_id", F.col("start_byte").cast("long").alias("feature_pos"), "line").mapInArrow(run, "doc_id long, feature_pos long, features array<double>")


#: Characters that an item of a list may hold at a candidate, and those that touch one (fixed values).
ITEM_CHARS = "()0123456789abcdefghijklmnopqrstuvwxyz.•·○●■□▪▫"
TOUCHING_BEFORE, TOUCHING = ".,;:()", ".,;:()[]"
#: Letters to the encoder.
LETTER = "\\p{L}\\p{Nl}"
#: What ``lexicon_block`` looks at; its windows reach 50 characters.
LEXICON_FIELDS, LEXICON_REACH = ("value", "left", "right", "quotes"), 50


def any_of(words: str | tuple[str, ...]) -> str:
    """A pattern for any of the words (or characters), longest first."""
    return "(?:" + "|".join("".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c for c in w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def encoded_character(ch: Column, lexicon: Lexicon) -> Column:
    """A letter's distance from the lower-case a, from 1 on; 0 for ASCII digits, -1 to -5 for terminators, paragraph ends, white space or nothing, punctuation and the rest."""
    return T.let(ch, lambda c: _encoded(c, lexicon))


def _is_one(ch: Column, chars: str | tuple[str, ...]) -> Column:
    """Whether a text begins with one of the characters."""
    return F.left(ch, F.lit(1)).isin(*[c for c in chars if len(c) == 1])


def _encoded(ch: Column, lexicon: Lexicon) -> Column:
    one_of = lambda chars: _is_one(ch, chars)
    return (
        F.when(F.length(ch) == 0, -3).when(ch.between("a", "z"), F.ascii(ch) - 96).when(ch.rlike(f"^[{LETTER}]"), F.ascii(F.lower(ch)) - 96).when(ch.rlike("^[0-9]"), 0).when(one_of(lexicon.terminators), -1)
        .when(one_of(lexicon.paragraph), -2).when(one_of(lexicon.spaces) | ch.rlike("^[\\s\\p{Z}]"), -3).when(one_of(lexicon.punctuation), -4).otherwise(-5)
    ).cast("double")


def lexicon_block(left: int = 5, right: int = 3, lexicon: Lexicon = DEFAULT, get: Callable[[str], Column] = F.col) -> Column:
    """An encoded window and eight flags that look words up, over ``context`` with ``LEXICON_FIELDS`` and ``LEXICON_REACH``.

    The flags: the full stop ends an abbreviation; kind of terminator (1
    primary, -1 secondary, 0 none); a quote that leaves all quotes up to it in
    pairs (1 for what is no quote); a closing quote that doesn't stand inside a
    word; a lower-case letter next; part of a list item (20 characters); a
    semicolon of a list (50); a colon within 10 characters before. The list
    windows count characters.
    """
    here, before, behind = get("here"), get("left"), get("right")
    ahead = F.concat(here, behind)
    parts = {
        "previous": F.right(before, F.lit(1)), "following": F.left(behind, F.lit(1)), "ahead": ahead, "near20": F.right(before, F.lit(20)), "ahead20": F.left(ahead, F.lit(20)), "ahead50": F.left(ahead, F.lit(50)),
    }
    flags = T.let(F.struct(*[v.alias(k) for k, v in parts.items()]), lambda x: _lexicon_flags(x, lexicon, get))
    return F.concat(F.array(*[encoded_character(_at(k, get), lexicon) for k in range(-left, right + 1)]), flags)


def _lexicon_flags(x: Column, lexicon: Lexicon, get: Callable[[str], Column]) -> Column:
    here, before, behind = get("here"), get("left"), get("right")
    previous, following, ahead, near20, ahead20, ahead50 = (x[k] for k in ("previous", "following", "ahead", "near20", "ahead20", "ahead50"))
    among = _is_one
    holds = lambda c, words: c.rlike(any_of(words)) if words else F.lit(False)

    token = F.concat(F.reverse(F.regexp_extract(F.reverse(before), f"^[{LETTER}\\p{{N}}.]*", 0)), here)
    abbreviation = (here == ".") & token.isin(*lexicon.abbreviations)
    kind = F.when(among(here, lexicon.primary), 1.0).when(among(here, lexicon.secondary), -1.0).otherwise(0.0)
    q = get("quotes")
    paired = (q["double"] % 2 == 0) & (q["single"] % 2 == 0) & (q["curly_double"] == 0) & (q["curly_single"] == 0)
    balanced = ~among(here, lexicon.opening_quotes + lexicon.closing_quotes) | paired
    complete = ~among(here, lexicon.closing_quotes) | ~following.rlike("^\\p{Ll}") | among(following, lexicon.terminators + lexicon.punctuation)

    marked = before.rlike(any_of(lexicon.list_markers) + "\\z") | ahead.rlike("^" + any_of(lexicon.list_markers))
    eligible = among(here, ITEM_CHARS) | (F.length(before) > 0) & (F.length(behind) > 0) & (among(here, ".,;:") | among(previous, ".,;:"))
    touching = among(here, TOUCHING) | among(previous, TOUCHING_BEFORE) | among(following, TOUCHING)
    introduced = (F.length(near20) >= 5) & F.right(near20, F.lit(5)).contains(":") & holds(near20, lexicon.list_intros)
    at = [F.instr(ahead20, w) for w in lexicon.list_conjunctions]
    joined = [(k > 1) & (k < 6) & F.substring(ahead20, k - 1, F.lit(1)).isin(";", ",") for k in at]
    item = eligible & (marked | touching & (introduced | (among(here, ";,") | among(previous, ";,")) & _any(joined)))
    around = F.concat(before, ahead50)
    semicolon = (here == ";") & (
        (F.regexp_count(around, F.lit(";")) >= 2) | holds(around, lexicon.list_markers) | holds(before, lexicon.list_intros) | holds(ahead50, lexicon.list_conjunctions)
    )
    colon = F.right(before, F.lit(10)).contains(":")
    return F.array(flag(abbreviation), kind, *map(flag, (balanced, complete, following.rlike("^\\p{Ll}"), item, semicolon, colon)))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


#: What ``terminator_block`` looks at.
TERMINATOR_FIELDS = ("value", "left", "right", "before", "token", "breaks")
TERMINATOR_WIDTH = 36


def terminator_block(lexicon: Lexicon = DEFAULT, get: Callable[[str], Column] = F.col) -> Column:
    """What tells whether a mark, closer or quote ends a sentence (36 columns over ``context`` with ``TERMINATOR_FIELDS``), each from 0 to 1."""
    left, right = get("left"), get("right")

    def looked_up(x: Column) -> Column:
        more = {
            "beyond": x["beyond"], "follow": x["follow"], "word": x["word"], "dotted": F.concat(x["word"], get("here")), "line": F.regexp_extract(left, "[^\\n\\r]*\\z", 0),
            "next_word": F.regexp_extract(x["follow"], f"^[{LETTER}]+", 0), "last": F.right(left, F.lit(1)),
        }
        return F.struct(*[v.alias(k) for k, v in more.items()])

    word = F.reverse(F.regexp_extract(F.reverse(left), f"^[{LETTER}\\p{{N}}.]*", 0))
    beyond = F.regexp_replace(right, "^[\"')\\]}>”’»]+", "")
    parts = T.let(beyond, lambda c: F.struct(c.alias("beyond"), F.ltrim(c, F.lit(T.BLANKS)).alias("follow"), word.alias("word")))
    known = T.let(T.let(parts, looked_up), lambda x: x.withField("abbreviation", (get("here") == ".") & x["dotted"].isin(*lexicon.abbreviations)))
    return T.let(known, lambda x: _terminator_tests(x, lexicon, get))


def _terminator_tests(x: Column, lexicon: Lexicon, get: Callable[[str], Column]) -> Column:
    here, left, right, token = get("here"), get("left"), get("right"), get("token")
    beyond, follow, word, dotted, line, next_word, last, abbreviation = (x[k] for k in ("beyond", "follow", "word", "dotted", "line", "next_word", "last", "abbreviation"))
    blank = lambda c: c.rlike("^[ \\t\\n\\r]")
    period = here == "."
    title = period & dotted.isin(*lexicon.titles)
    tests = [
        period, here == "!", here == "?", here == "…", here.isin('"', "'"), here.isin(")", "]", "}", ">"), here.isin("”", "’", "»", "›"), here.isin("“", "‘", "«", "‹"),
        F.length(right) == 0, blank(right), right.rlike("^[\"')\\]}>”’»]"), right.rlike("^[.!?…]"), blank(beyond) | (F.length(beyond) == 0),
        F.length(follow) == 0, follow.rlike("^\\p{Lu}"), follow.rlike("^\\p{Ll}"), follow.rlike("^[0-9]"), follow.rlike("^[\"'“‘«(\\[]"),
        get("breaks") >= 1, get("breaks") >= 2, get("before").rlike("[.!?…]\\z"), blank(last) | (F.length(left) == 0), last.rlike("[0-9]"), last.rlike("[.!?…]"),
        abbreviation, title, period & word.rlike("^\\p{Lu}\\z"), period & word.rlike("^(?:\\p{L}\\.)+\\p{L}\\z"), period & word.rlike("[0-9]\\z") & right.rlike("^[0-9]"),
        period & line.rlike("^[ \\t]*(?:[0-9]{1,3}|[IVXLCivxlc]{1,6}|[A-Za-z])\\z"), abbreviation & follow.rlike("^\\p{Lu}"), abbreviation & next_word.isin(*STARTERS), next_word.isin(*STARTERS),
        abbreviation & follow.rlike("^[0-9]"),
    ]
    return F.array(*[flag(t) for t in tests], F.least(token["letters"], F.lit(16)) / 16.0, F.least(token["dots"], F.lit(4)) / 4.0)


#: Words that often begin a sentence and seldom follow an abbreviation inside one.
STARTERS = ("The", "A", "An", "He", "She", "It", "They", "We", "You", "I", "This", "That", "These", "Those", "There", "Then", "But", "And", "However", "When", "If", "In", "On", "At", "After", "His", "Her", "Their", "Our", "My", "What", "Who", "No", "Yes", "Nobody", "Everyone", "Later", "Now", "Shares", "Students")
