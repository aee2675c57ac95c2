"""Column functions on text: offsets, views, lines, normalising. All stay in the JVM.

Offsets are half-open. ``start``/``end`` count code points, ``*_byte`` UTF-8
bytes. Nulls give nulls unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmill.functions import marks as K

SPAN = "struct<start:bigint,end:bigint,start_byte:bigint,end_byte:bigint>"
#: Steps of each aggregate of a scan, and how many of these lie in one another below the outermost.
BLOCK, LEVELS = 16, 3
BLANKS = " \t\n\r"
CLOSERS_AND_BLANKS = "^[\"')\\]}>”’»]*[ \\t\\n\\r]*"
#: What ``locate`` knows of a token of ASCII letters, digits and full stops: its full stops, letters, capitals, and whether its first letter is one.
TOKEN = "struct<dots:int,letters:int,capitals:int,first:boolean>"
#: Straight double and single quotes up to and with a match, and how many more curly ones open than close.
QUOTES = "struct<double:int,single:int,curly_double:int,curly_single:int>"
_TOKEN = "^[A-Za-z0-9.]*"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.aggregate(F.array(F.lit(0)), value, lambda v, _: v, body)  # unlike transform, it copies nothing


def once(value: str | Column) -> Column:
    """A generated column of one value a row: nothing that is asked of it, a filter least of all, works it out anew."""
    return F.explode(F.array(col(value)))


def each(items: str | Column) -> Column:
    """``explode`` of a column, which the optimizer would otherwise test for elements below, by working it out anew for each test."""
    return F.explode(F.flatten(F.array(col(items))))


def class_count(text: Column, one: str) -> Column:
    """How many characters of a text match a regex of single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{one})+", ""))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` emits for each item: it takes the state and an item and gives the next state and an element of type ``kind``.

    ``aggregate`` copies all that its state holds at each step, so elements gather
    in aggregates of ``BLOCK`` steps, and these in others: an array of n items
    copies each of them some ``BLOCK`` times for each of the ``LEVELS``, not n times.
    """

    def part(level: int, items: Column, n: Column, at: Column, state: Column, finish: Callable[[Column], Column]) -> Column:
        """``finish`` of the state and elements behind the items from ``at`` on, ``BLOCK`` to the power of ``level`` + 1 of them at most but for the outermost."""
        start = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        grown = lambda a, state, more: F.struct(state.alias("s"), F.concat(a["out"], more).alias("out"))

        def go(a: Column, x: Column) -> Column:
            if level:
                return part(level - 1, items, n, x, a["s"], lambda r: grown(a, r["s"], r["out"]))
            state, out = step(a["s"], x)
            return grown(a, state, F.array(out))

        last = n if level == LEVELS else F.least(at + (BLOCK ** (level + 1) - 1), n)
        return F.aggregate(F.sequence(at, last, F.lit(BLOCK**level)) if level else F.slice(items, at, F.lit(BLOCK)), start, go, finish)

    return let(items, lambda items: let(F.greatest(F.size(items), F.lit(1)), lambda n: part(LEVELS, items, n, F.lit(1), zero, lambda a: a["out"])))


def window(raw: Column, at: Column, reach: int) -> Column:
    """Up to ``reach`` code points of UTF-8 bytes from the byte ``at`` on, without walking the text before it."""
    return F.left(F.substring(raw, (at + 1).cast("int"), F.lit(4 * reach)).cast("string"), F.lit(reach))


def window_before(raw: Column, at: Column, reach: int) -> Column:
    """Up to ``reach`` code points that end before the byte ``at``."""

    def cut(at: Column) -> Column:
        size = F.least(at, F.lit(4 * reach))
        return F.substring(raw, (at - size + 1).cast("int"), size.cast("int")).cast("string")

    return let(let(at, cut), lambda found: F.right(found, F.lit(reach)))


#: What ``locate`` can say of the places around a match: type and expression over (bytes of the text, its item, reach).
AROUND = {
    "value": ("string", lambda raw, s, reach: s["m"]),
    "left": ("string", lambda raw, s, reach: window_before(raw, s["start_byte"], reach)),
    "right": ("string", lambda raw, s, reach: window(raw, s["end_byte"], reach)),
    "before": ("string", lambda raw, s, reach: window_before(raw, s["start_byte"] - F.octet_length(s["g"]) + F.octet_length(F.rtrim(s["g"], F.lit(BLANKS))), reach)),
    "after": ("string", lambda raw, s, reach: window(raw, s["end_byte"] + F.octet_length(s["a"]) - F.octet_length(F.ltrim(s["a"], F.lit(BLANKS))), reach)),
    "behind": ("string", lambda raw, s, reach: window(raw, s["end_byte"] + F.octet_length(F.regexp_extract(s["a"], CLOSERS_AND_BLANKS, 0)), reach)),
    "word": ("string", lambda raw, s, reach: F.regexp_extract(s["g"], "[A-Za-z]*\\z", 0)),
    "breaks": ("int", lambda raw, s, reach: F.regexp_count(F.regexp_extract(s["a"], "^[ \\t\\n\\r]*", 0), F.lit("[\\n\\r]"))),
    "breaks_behind": ("int", lambda raw, s, reach: F.regexp_count(F.regexp_extract(s["a"], CLOSERS_AND_BLANKS, 0), F.lit("[\\n\\r]"))),
    "gap": ("string", lambda raw, s, reach: s["g"]),
    "rest": ("string", lambda raw, s, reach: s["a"]),
    "token": (TOKEN, lambda raw, s, reach: s["token"]),
    "quotes": (QUOTES, lambda raw, s, reach: s["quotes"]),
}


def _tail(part: Column) -> Column:
    """The token that ends a piece of text, and whether it is the ``whole`` piece. It is read backwards, so the piece isn't searched."""

    def known(tail: Column) -> Column:
        letters = class_count(tail, "[A-Za-z]")
        some = F.struct(
            class_count(tail, "\\.").alias("dots"), letters.alias("letters"), class_count(tail, "[A-Z]").alias("capitals"),
            F.when(letters > 0, F.regexp_extract(tail, "([A-Za-z])[0-9.]*\\z", 1).between("A", "Z")).alias("first"), (F.length(tail) == F.length(part)).alias("whole"),
        )
        none = F.struct(F.lit(0).alias("dots"), F.lit(0).alias("letters"), F.lit(0).alias("capitals"), F.lit(None).cast("boolean").alias("first"), (F.length(part) == 0).alias("whole"))
        return F.when(F.length(tail) > 0, some).otherwise(none)

    return let(F.regexp_extract(F.reverse(part), _TOKEN, 0), known)


def _grown(token: dict[str, Column], tail: Column) -> dict[str, Column]:
    """The token at the end of a piece with that ``tail``, when ``token`` ended in front of it."""
    counts = {k: F.when(tail["whole"], token[k]).otherwise(0) + tail[k] for k in ("dots", "letters", "capitals")}
    return {**counts, "first": F.coalesce(F.when(tail["whole"], token["first"]), tail["first"])}


def _quotes(*parts: Column) -> dict[str, Column]:
    """Quotes in pieces of text, as the fields of ``QUOTES``."""
    n = lambda c: sum((F.length(p) - F.length(F.replace(p, F.lit(c), F.lit(""))) for p in parts), F.lit(0))
    return {"double": n('"'), "single": n("'"), "curly_double": n("“") - n("”"), "curly_single": n("‘") - n("’")}


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def locate(text: str | Column, pattern: str, around: tuple[str, ...] = (), reach: int = 32) -> Column:
    """All leftmost non-overlapping matches of a pattern (of non-empty matches) as an array of ``SPAN``.

    Gaps and matches alternate, so a scan over their lengths gives every offset
    inside the row: no explode, window or shuffle. ``around`` names fields of
    ``AROUND`` to add: up to ``reach`` characters before (``left``) and behind
    (``right``) the match, up to the last non-blank before (``before``) and from
    the first non-blank behind (``after``) or behind closers (``behind``), the
    letters before it, the line breaks in blanks, the whole gaps,
    the ``TOKEN`` that ends at it, over matches too, and the ``QUOTES`` up to it. Line breaks are counted
    directly behind (``breaks``) or behind closers (``breaks_behind``). Blank runs of any
    length are looked through, so the pattern must not match blanks or (for
    ``behind``) closers. A plain class of characters with plain fields is
    looked for on Arrow batches (``marks.marks``); all else is folded in the JVM.
    """
    text = col(text)
    more = tuple(dict.fromkeys(around))
    if K.PLAIN.fullmatch(pattern) and all(f in K.AROUND for f in more):
        return K.marks(text, pattern, more, reach)
    tokens, quoted = "token" in more, "quotes" in more
    big = F.lit(0).cast("bigint")
    zero = {"c": big, "b": big}
    if tokens:
        zero["t"] = F.struct(F.lit(0).alias("dots"), F.lit(0).alias("letters"), F.lit(0).alias("capitals"), F.lit(None).cast("boolean").alias("first"))
    if quoted:
        zero["q"] = F.struct(*[F.lit(0).alias(k) for k in ("double", "single", "curly_double", "curly_single")])

    def measured(x: Column) -> Column:
        """What the fold needs of a match and the gaps around it, worked out once."""
        out = {"gc": F.length(x["g"]), "gb": F.octet_length(x["g"]), "mc": F.length(x["m"]), "mb": F.octet_length(x["m"])}
        if tokens:
            out |= {"gt": _tail(x["g"]), "mt": _tail(x["m"])}
        if quoted:
            out["q"] = _struct(_quotes(x["g"], x["m"]))
        return _struct(({k: x[k] for k in ("g", "m", "a")} if more else {}) | out)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start, start_byte = state["c"] + x["gc"], state["b"] + x["gb"]
        out = {"start": start, "end": start + x["mc"], "start_byte": start_byte, "end_byte": start_byte + x["mb"]}
        after = {"c": out["end"], "b": out["end_byte"]}
        if more:
            out |= {k: x[k] for k in ("g", "m", "a")}
        if tokens:
            token = _grown({k: state["t"][k] for k in ("dots", "letters", "capitals", "first")}, x["gt"])
            out["token"], after["t"] = _struct(token), _struct(_grown(token, x["mt"]))
        if quoted:
            out["quotes"] = after["q"] = _struct({k: state["q"][k] + x["q"][k] for k in ("double", "single", "curly_double", "curly_single")})
        return _struct(after), _struct(out)

    kind = SPAN[:-1] + (",g:string,m:string,a:string" if more else "") + (f",token:{TOKEN}" if tokens else "") + (f",quotes:{QUOTES}" if quoted else "") + ">"

    def spans(found: Column, gaps: Column, raw: Column) -> Column:
        n = F.size(found)
        items = F.arrays_zip(F.slice(gaps, 1, n).alias("g"), found.alias("m"), F.slice(gaps, 2, n).alias("a"))
        places = scan(F.transform(items, measured), _struct(zero), step, kind)
        if not more:
            return places
        return F.transform(places, lambda s: F.struct(*[s[k].alias(k) for k in ("start", "end", "start_byte", "end_byte")], *[AROUND[k][1](raw, s, reach).alias(k) for k in more]))

    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.struct(found.alias("found"), gaps.alias("gaps"), (text.cast("binary") if more else F.lit(None).cast("binary")).alias("raw"))
    return F.when(text.isNotNull(), let(parts, lambda p: spans(p["found"], p["gaps"], p["raw"])))


def cut(text: str | Column, size: int) -> Column:
    """A text in pieces of ``size`` code points (the last may be shorter): an array of ``struct(start, start_byte, value)``, made in one walk."""
    kind = "struct<start:bigint,start_byte:bigint,value:string>"
    zero = F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("b"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        after = F.struct((state["c"] + F.length(x)).alias("c"), (state["b"] + F.octet_length(x)).alias("b"))
        return after, F.struct(state["c"].alias("start"), state["b"].alias("start_byte"), x.alias("value"))

    return scan(F.regexp_extract_all(col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), zero, step, kind)


def piece(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """Code points [start, end) of a text."""
    return F.substring(col(text), (col(start) + 1).cast("int"), (col(end) - col(start)).cast("int"))


def byte_piece(raw: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of UTF-8 bytes as text."""
    return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def wide_piece(raw: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text that is given in UTF-32."""
    return F.decode(F.substring(raw, (4 * start + 1).cast("int"), (4 * (end - start)).cast("int")), "UTF-32")


def is_ascii(text: str | Column) -> Column:
    return F.octet_length(col(text)) == F.length(col(text))


def char_to_byte(text: str | Column, at: str | Column) -> Column:
    """Byte offset of a code-point offset; an offset past the end raises."""
    inside = F.when(col(at) <= F.length(col(text)), F.octet_length(F.substring(col(text), F.lit(1), col(at).cast("int"))))
    return F.coalesce(inside, F.when(col(at).isNotNull(), F.raise_error(F.lit("offset out of range")).cast("int")))


def byte_to_char(text: str | Column, at: str | Column) -> Column:
    """Index of the code point that owns a byte; the end maps to the length."""
    codes = F.regexp_extract_all(F.hex(F.substring(F.encode(col(text), "UTF-8"), F.lit(1), col(at).cast("int") + 1)), F.lit(".."), F.lit(0))
    leads = F.size(F.filter(codes, lambda x: ~F.substring(x, 1, 1).isin("8", "9", "A", "B")))
    return F.when(col(at) >= F.octet_length(col(text)), F.length(col(text))).otherwise(leads - 1)


def strip_tags(text: str | Column) -> Column:
    """Text without ``<|label|>`` and ``<|/label|>`` or ``</|label|>`` tags."""
    return F.regexp_replace(col(text), r"<\|/?[a-z_]+\|>|</\|[a-z_]+\|>", "")


def squeeze(text: str | Column) -> Column:
    """``&#xD;`` removed, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), "&#xD;", ""), r"[ \t\n\x0B\f\r]+", " "))


def trimmed_length(text: str | Column) -> Column:
    """Code points left when trailing blanks, tabs and line breaks go."""
    return F.length(F.rtrim(col(text), F.lit(" \t\n\r")))


def encoded_byte(code: str | Column) -> Column:
    """Ordinal code of a byte: letters 1-26, digits 0, terminators -1, line breaks -2, NUL -3, other white space -3, punctuation -4, rest -5."""
    c = col(code)
    lower = F.when(c.between(65, 90), c + 32).otherwise(c)
    return (
        F.when(c == 0, -3)
        .when(lower.between(97, 122), lower - 96)
        .when(c.between(48, 57), 0)
        .when(c.isin(46, 33, 63, 59, 58, 34, 39), -1)
        .when(c.isin(10, 13), -2)
        .when(c.isin(9, 12, 32), -3)
        .when(c.between(33, 47) | c.between(58, 64) | c.between(91, 96) | c.between(123, 126), -4)
        .otherwise(-5)
    )


def char_code(ch: str | Column) -> Column:
    """Code of an ASCII character, 0 for none, 255 for any other character (all non-ASCII bytes are alike to the encoders)."""
    c = col(ch)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(F.octet_length(c) > 1, 255).otherwise(F.ascii(c))


def heading_like(line: str | Column) -> Column:
    """``#`` first, or an upper-case ASCII letter first and a colon within 48 characters."""
    c = F.trim(col(line))
    return c.startswith("#") | c.rlike(r"^[A-Z]") & F.substring(c, 1, 48).contains(":")


def list_like(line: str | Column) -> Column:
    """A bullet, or digits and a full stop or parenthesis, first."""
    return F.trim(col(line)).rlike(r"^(?:[-*•]|[0-9]+[.)])")


def metadata_colon(line: str | Column) -> Column:
    """A first colon within 40 bytes, an ASCII letter and no full stop before it."""
    c = F.trim(col(line))
    head = F.substring_index(c, ":", 1)
    return c.contains(":") & (F.octet_length(head) <= 40) & head.rlike("[A-Za-z]") & ~head.contains(".")


def char_boundary(text: str | Column, at: str | Column, up: bool = False) -> Column:
    """The byte offset itself where a code point begins there (or the text ends), else the one before, or behind with ``up``."""
    raw, size = col(text).cast("binary"), F.octet_length(col(text))
    at = F.least(F.greatest(col(at), F.lit(0)), size)
    inner = lambda k: F.conv(F.hex(F.substring(raw, (at + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int").between(128, 191)
    sign = 1 if up else -1
    steps = F.when(~F.coalesce(inner(0), F.lit(False)), 0)
    for k in (1, 2):
        steps = steps.when(~F.coalesce(inner(sign * k), F.lit(False)), k)
    return at + sign * steps.otherwise(3)


def snippet(text: str | Column, most: int) -> Column:
    """The first ``most`` code points with line breaks written out, and dots where there are more."""
    c = col(text)
    shown = F.replace(F.replace(F.left(c, F.lit(most)), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(shown, F.when(F.length(c) > most, "...").otherwise(""))


def point_context(text: str | Column, at: str | Column, radius: int) -> Column:
    """``left|right``: what stands within ``radius`` bytes of a byte offset, widened to whole code points, as snippets."""
    raw, size = col(text).cast("binary"), F.octet_length(col(text))
    at = F.least(col(at), size)
    start, end = char_boundary(text, at - radius), char_boundary(text, F.least(at + radius, size), True)
    return F.concat(snippet(byte_piece(raw, start, at), radius), F.lit("|"), snippet(byte_piece(raw, at, end), radius))


def trimmed_span(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """``struct(start, end)`` without the blanks at both ends of code points [start, end); all blank gives an empty span at its start."""
    whole = piece(text, start, end)
    lead = F.length(whole) - F.length(F.ltrim(whole, F.lit(BLANKS)))
    body = F.length(F.trim(whole, F.lit(BLANKS)))
    first = F.when(body > 0, col(start) + lead).otherwise(col(start)).cast("long")
    return F.struct(first.alias("start"), (first + body).cast("long").alias("end"))
