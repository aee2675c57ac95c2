"""The queries of the catalogue in DuckDB's SQL, put together from shared parts."""

from __future__ import annotations

from spanmill.functions.lexicon import DEFAULT as LEXICON
from spanmill.functions.predicates import ABBREVIATIONS
from spanmill.operators.candidates import CLOSERS, TERMINATOR_PATTERN, TERMINATORS
from spanmill.operators.features import _PUNCTUATION as PUNCTUATION
from spanmill.operators.features import BYTE_CLASSES, COUNTED, ITEM_CHARS, LETTER, LINE_CHARS, STARTERS, TOUCHING, TOUCHING_BEFORE, UNICODE_GROUPS, any_of
from spanmill.operators.lines import SPACE
from spanmill.operators.models import fixed_weights
from spanmill.operators.sampling import _A as A
from spanmill.operators.sampling import _B as B
from spanmill.operators.sampling import _MOD as MOD
from spanmill.plans.segmenter import BIAS, THRESHOLD, WEIGHTS, default_net

WS = "' ' || chr(9) || chr(10) || chr(13)"
CONV = """conv AS (SELECT conv_id AS doc_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""
STRUCT = """struct_docs AS (SELECT doc_id, '# ' || coalesce(source, 'none') || chr(10) || chr(10) || 'Lang: ' || coalesce(lang, 'none') || chr(10)
  || '1. first item' || chr(10) || '- second item' || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents)"""


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def located(pattern: str, table: str = "documents", name: str = "loc") -> str:
    """CTE of all matches with running offsets, the gaps before (g) and behind (a) them, and their neighbours' values."""
    p = lit(pattern)
    return f"""{name}_u AS (SELECT doc_id, text, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(g[2:len(m) + 1]) AS a, unnest(range(0, len(m))) AS k
  FROM (SELECT doc_id, text, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m FROM {table}) WHERE len(m) > 0),
{name} AS (SELECT doc_id, text, m AS value, g, a, coalesce(lag(m) OVER w, '') AS prev, coalesce(lead(m) OVER w, '') AS next, k::BIGINT AS k,
  (sum(length(g) + length(m)) OVER w - length(m))::BIGINT AS s, (sum(length(g) + length(m)) OVER w)::BIGINT AS e,
  (sum(strlen(g) + strlen(m)) OVER w - strlen(m))::BIGINT AS sb, (sum(strlen(g) + strlen(m)) OVER w)::BIGINT AS eb
  FROM {name}_u WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""


#: What stands directly before and behind a match of ``located``, and beyond blanks, of any length.
BEFORE_1 = "CASE WHEN length(g) > 0 THEN right(g, 1) ELSE right(prev, 1) END"
BEHIND_1 = "CASE WHEN length(a) > 0 THEN left(a, 1) ELSE left(next, 1) END"
AFTER = f"CASE WHEN length(ltrim(a, {WS})) > 0 THEN ltrim(a, {WS}) ELSE next END"
BEFORE = f"CASE WHEN length(rtrim(g, {WS})) > 0 THEN rtrim(g, {WS}) ELSE prev END"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def char_set(chars: str) -> str:
    return "[" + "".join("\\" + c if c.isascii() else c for c in chars) + "]"


def flag(test: str) -> str:
    return f"CASE WHEN coalesce({test}, false) THEN 1.0 ELSE 0.0 END"


def rx(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {lit(pattern)})"


def count(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, {lit(pattern)}))"


def block(values: list[str], digits: int = 6) -> str:
    """Rounded and joined features."""
    items = ", ".join(f"round(({v})::DOUBLE * {10**digits}::DOUBLE)::BIGINT::VARCHAR" for v in values)
    return f"array_to_string([{items}], ',') AS features"


def context(pattern: str = "[.!?]", table: str = "documents", reach: int = 32) -> str:
    closers = lit("^[\"')\\]}>”’»]+")
    bare = f"ltrim(regexp_replace(a, {closers}, ''), {WS})"
    blanks = lambda c: f"len(regexp_extract_all(regexp_extract({c}, '^[ \\t\\n\\r]*', 0), '[\\n\\r]'))"
    return located(pattern, table) + f""",
ctx AS (SELECT doc_id, s, sb AS feature_pos, value AS here, substring(text, greatest(s - {reach} + 1, 1), least(s, {reach})) AS "left", substring(text, e + 1, {reach}) AS "right",
  {BEFORE} AS before, {AFTER} AS after, CASE WHEN length({bare}) > 0 THEN {bare} ELSE next END AS behind, regexp_extract(g, '[A-Za-z]*\\z', 0) AS word,
  {blanks("a")} AS breaks, {blanks(f"regexp_replace(a, {closers}, '')")} AS breaks_behind,
  regexp_extract(substring(text, greatest(s - 400 + 1, 1), least(s, 400)), '[A-Za-z0-9.]*\\z', 0) AS token FROM loc)"""


def stripped(c: str) -> str:
    return f"regexp_replace({c}, {lit('^' + SPACE + '+|' + SPACE + '+' + chr(92) + 'z')}, '', 'g')"


def line_table(table: str = "struct_docs") -> str:
    """All lines of a table's texts with their neighbours."""
    return f"""raws AS (SELECT doc_id, strlen(text) AS size, unnest(g) AS raw, unnest(range(0, len(g))) AS k FROM (SELECT doc_id, text, string_split_regex(text, '[\\n\\r]') AS g FROM {table} WHERE text IS NOT NULL)),
flagged AS (SELECT *, length({stripped("raw")}) = 0 AS blank FROM raws),
ltab AS (SELECT doc_id, size, k AS line_no, raw, blank, (sum(strlen(raw) + 1) OVER w - strlen(raw) - 1)::BIGINT AS start_byte, coalesce(lead(raw) OVER w, '') AS following,
  coalesce(last_value(nullif(raw, '') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous,
  k - coalesce(max(CASE WHEN NOT blank THEN k END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(min(CASE WHEN NOT blank THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY doc_id) - 1) - k AS after
  FROM flagged WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
own AS (SELECT *, (start_byte + strlen(raw) - strlen(regexp_replace(raw, {lit('^' + SPACE + '+')}, '')))::BIGINT AS position FROM ltab WHERE NOT blank)"""


def line_context(table: str = "struct_docs", pattern: str = "[.!?]") -> str:
    """``context`` with flags of each mark's line and the rest of that line."""
    return context(pattern, table) + ",\n" + line_table(table) + f""",
lctx AS (SELECT c.*, l.raw, l.following, l.before AS line_breaks_before, split_part(substring(d.text, c.s + 1), chr(10), 1) AS rest
  FROM ctx c ASOF JOIN ltab l ON c.doc_id = l.doc_id AND c.feature_pos >= l.start_byte JOIN {table} d ON d.doc_id = c.doc_id)"""


LEFT, RIGHT = '"left"', '"right"'


def among(value: str, words) -> str:
    return rx(value, "^" + any_of(words))


def holds(value: str, words) -> str:
    return rx(value, any_of(words))


def words(items) -> str:
    return ", ".join(map(lit, items))


def last(value: str, n: int) -> str:
    return f"(CASE WHEN length({value}) > {n} THEN right({value}, {n}) ELSE {value} END)"


def lexicon_features(left: int = 5, right: int = 3, lexicon=LEXICON) -> list[str]:
    """``features.lexicon_block`` over ``context`` of reach 50 with ``upto``, the text through the mark."""

    def character(c: str) -> str:
        return f"""CASE WHEN length({c}) = 0 THEN -3 WHEN {rx(c, f"^[{LETTER}]")} THEN unicode(lower({c})) - 96 WHEN {rx(c, "^[0-9]")} THEN 0 WHEN {among(c, lexicon.terminators)} THEN -1
  WHEN {among(c, lexicon.paragraph)} THEN -2 WHEN {among(c, lexicon.spaces)} OR {rx(c, "^[" + chr(92) + "s" + chr(92) + "p{Z}]")} THEN -3 WHEN {among(c, lexicon.punctuation)} THEN -4 ELSE -5 END"""

    previous, following, ahead = f"({last(LEFT, 1)})", f"left({RIGHT}, 1)", f"(here || {RIGHT})"
    near20, ahead20, ahead50 = last(LEFT, 20), f"left({ahead}, 20)", f"left({ahead}, 50)"
    token = f"regexp_extract({LEFT}, {lit(f'[{LETTER}' + chr(92) + 'p{N}.]*' + chr(92) + 'z')}, 0) || here"
    n = lambda c: f"(length(upto) - length(replace(upto, {lit(c)}, '')))"
    double, single = n('"'), n("'")
    paired = f"({double} % 2 = 0 AND {single} % 2 = 0 AND {n('“')} = {n('”')} AND {n('‘')} = {n('’')})"
    marked = f"({rx(LEFT, any_of(lexicon.list_markers) + chr(92) + 'z')} OR {among(ahead, lexicon.list_markers)})"
    eligible = f"({among('here', ITEM_CHARS)} OR (length({LEFT}) > 0 AND length({RIGHT}) > 0 AND ({among('here', '.,;:')} OR {among(previous, '.,;:')})))"
    touching = f"({among('here', TOUCHING)} OR {among(previous, TOUCHING_BEFORE)} OR {among(following, TOUCHING)})"
    introduced = f"(length({near20}) >= 5 AND contains({last(near20, 5)}, ':') AND {holds(near20, lexicon.list_intros)})"
    spot = lambda w: f"strpos({ahead20}, {lit(w)})"
    joined = " OR ".join(f"({spot(w)} BETWEEN 2 AND 5 AND substring({ahead20}, {spot(w)} - 1, 1) IN (';', ','))" for w in lexicon.list_conjunctions)
    item = f"{eligible} AND ({marked} OR ({touching} AND ({introduced} OR (({among('here', ';,')} OR {among(previous, ';,')}) AND ({joined})))))"
    around = f"({LEFT} || {ahead50})"
    semicolon = f"here = ';' AND ({count(around, ';')} >= 2 OR {holds(around, lexicon.list_markers)} OR {holds(LEFT, lexicon.list_intros)} OR {holds(ahead50, lexicon.list_conjunctions)})"
    return [
        *[character(f"({at(k)})") for k in range(-left, right + 1)], flag(f"here = '.' AND {token} IN ({words(lexicon.abbreviations)})"),
        f"CASE WHEN {among('here', lexicon.primary)} THEN 1 WHEN {among('here', lexicon.secondary)} THEN -1 ELSE 0 END",
        flag(f"NOT {among('here', lexicon.opening_quotes + lexicon.closing_quotes)} OR {paired}"),
        flag(f"NOT {among('here', lexicon.closing_quotes)} OR NOT {rx(following, '^' + chr(92) + 'p{Ll}')} OR {among(following, lexicon.terminators + lexicon.punctuation)}"),
        flag(rx(following, "^\\p{Ll}")), flag(item), flag(semicolon), flag(f"contains({last(LEFT, 10)}, ':')"),
    ]


def terminator_features(lexicon=LEXICON) -> list[str]:
    """``features.terminator_block`` over ``context`` of the terminators."""
    beyond = f"regexp_replace({RIGHT}, {lit('^[' + chr(34) + chr(39) + ')' + chr(92) + ']}>”’»]+')}, '')"
    follow, near = f"ltrim({beyond}, {WS})", f"({last(LEFT, 1)})"
    word = f"regexp_extract({LEFT}, {lit(f'[{LETTER}' + chr(92) + 'p{N}.]*' + chr(92) + 'z')}, 0)"
    line, following = f"regexp_extract({LEFT}, {lit('[^' + chr(92) + 'n' + chr(92) + 'r]*' + chr(92) + 'z')}, 0)", f"regexp_extract({follow}, {lit(f'^[{LETTER}]+')}, 0)"
    blank = lambda c: rx(c, "^[ \\t\\n\\r]")
    abbreviation, title = f"(here = '.' AND {word} || here IN ({words(lexicon.abbreviations)}))", f"here = '.' AND {word} || here IN ({words(lexicon.titles)})"
    tests = [
        *[f"here = {lit(c)}" for c in ".!?…"], *[f"here IN ({words(c)})" for c in ("\"'", ")]}>", "”’»›", "“‘«‹")],
        f"length({RIGHT}) = 0", blank(RIGHT), rx(RIGHT, "^[\"')\\]}>”’»]"), rx(RIGHT, "^[.!?…]"), f"({blank(beyond)} OR length({beyond}) = 0)",
        f"length({follow}) = 0", rx(follow, "^\\p{Lu}"), rx(follow, "^\\p{Ll}"), rx(follow, "^[0-9]"), rx(follow, "^[\"'“‘«(\\[]"),
        "breaks >= 1", "breaks >= 2", rx("before", "[.!?…]\\z"), f"({blank(near)} OR length({LEFT}) = 0)", rx(near, "[0-9]"), rx(near, "[.!?…]"),
        abbreviation, title, f"here = '.' AND {rx(word, '^' + chr(92) + 'p{Lu}' + chr(92) + 'z')}", "here = '.' AND " + rx(word, "^(?:\\p{L}\\.)+\\p{L}\\z"), f"here = '.' AND {rx(word, '[0-9]' + chr(92) + 'z')} AND {rx(RIGHT, '^[0-9]')}",
        "here = '.' AND " + rx(line, "^[ \\t]*(?:[0-9]{1,3}|[IVXLCivxlc]{1,6}|[A-Za-z])\\z"), f"{abbreviation} AND {rx(follow, '^' + chr(92) + 'p{Lu}')}", f"{abbreviation} AND {following} IN ({words(STARTERS)})", f"{following} IN ({words(STARTERS)})",
        f"{abbreviation} AND {rx(follow, '^[0-9]')}",
    ]
    return [*map(flag, tests), f"least({count('token', '[A-Za-z]')}, 16) / 16.0::DOUBLE", f"least({count('token', '[.]')}, 4) / 4.0::DOUBLE"]


def clusters(marks: str) -> str:
    """Best mark of each cluster of a table ``(doc_id, break_end, break_char, resume, score)`` of good marks, as CTE ``best``."""
    return f"""islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR break_end > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY break_end) AS cluster
  FROM (SELECT *, max(resume) OVER (PARTITION BY doc_id ORDER BY break_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {marks})),
best AS (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY doc_id, cluster ORDER BY score DESC, break_end) = 1)"""


def net_score(features: str, net) -> str:
    """First output of a net over a list of features."""
    values = features
    vector = lambda v: "[" + ", ".join(f"{x!r}::DOUBLE" for x in map(float, v)) + "]"
    for k, (weights, bias) in enumerate(net.layers):
        z = [f"list_dot_product({values}, {vector(w)}) + {float(b)!r}::DOUBLE" for w, b in zip(weights.T, bias, strict=True)]
        if k == len(net.layers) - 1:
            return f"1 / (1 + exp(-({z[0]})))"
        values = "[" + ", ".join(f"greatest({x}, 0)" for x in z) + "]"


def at(offset: int) -> str:
    if offset == 0:
        return "here"
    if offset > 0:
        return f"substring({RIGHT}, {offset}, 1)"
    return f"CASE WHEN length({LEFT}) >= {-offset} THEN right(left({LEFT}, length({LEFT}) - {-offset - 1}), 1) ELSE '' END"


def code(ch: str) -> str:
    return f"CASE WHEN length({ch}) = 0 THEN 0 WHEN strlen({ch}) > 1 THEN 255 ELSE ascii({ch}) END"


def encoded(c: str) -> str:
    low = f"CASE WHEN {c} BETWEEN 65 AND 90 THEN {c} + 32 ELSE {c} END"
    return f"""CASE WHEN {c} = 0 THEN -3 WHEN ({low}) BETWEEN 97 AND 122 THEN ({low}) - 96 WHEN {c} BETWEEN 48 AND 57 THEN 0 WHEN {c} IN (46, 33, 63, 59, 58, 34, 39) THEN -1
  WHEN {c} IN (10, 13) THEN -2 WHEN {c} IN (9, 12, 32) THEN -3 WHEN {c} BETWEEN 33 AND 47 OR {c} BETWEEN 58 AND 64 OR {c} BETWEEN 91 AND 96 OR {c} BETWEEN 123 AND 126 THEN -4 ELSE -5 END"""


def lines(table: str) -> str:
    return located("[^\\n\\r]+", table, "ln") + """,
lines AS (SELECT doc_id, k AS line_no, s + length(value) - length(ltrim(value, ' ')) AS start, s + length(value) - length(ltrim(value, ' ')) + length(trim(value, ' ')) AS "end",
  sb + strlen(value) - strlen(ltrim(value, ' ')) AS start_byte, sb + strlen(value) - strlen(ltrim(value, ' ')) + strlen(trim(value, ' ')) AS end_byte, trim(value, ' ') AS line
  FROM ln WHERE length(trim(value, ' ')) > 0)"""


def heading(c: str) -> str:
    return f"(starts_with({c}, '#') OR {rx(c, '^[A-Z]')} AND contains(substring({c}, 1, 48), ':'))"


def meta_colon(c: str) -> str:
    head = f"split_part({c}, ':', 1)"
    return f"(contains({c}, ':') AND strlen({head}) <= 40 AND {rx(head, '[A-Za-z]')} AND NOT contains({head}, '.'))"


def section_like(c: str) -> str:
    return f"""(length({c}) BETWEEN 1 AND 140 AND NOT {rx(c, "[.!?;,]\\z")} AND ({rx(c, "^#+ ")} OR {rx(c, "^(?i)(chapter|section|part|article|appendix)\\b")}
  OR {count(c, "[A-Za-z]")} > 0 AND 100 * {count(c, "[A-Z]")} > 85 * {count(c, "[A-Za-z]")}))"""


def dialogue_like(c: str) -> str:
    return f"(length({c}) >= 10 AND " + rx(c, '^(?:[A-Za-z][A-Za-z ]{0,30}: |["“‘]|[—–] ?)') + ")"


def list_item_like(c: str) -> str:
    return f"(length({c}) >= 5 AND {rx(c, '^(?:[-*•] |[0-9]{1,3}[.)] |[A-Za-z][.)] )')})"


def metadata_like(c: str) -> str:
    return f"""(length({c}) BETWEEN 5 AND 180 AND ({rx(c, "^[A-Za-z][A-Za-z _-]{0,38}: ")} OR {rx(c, "(?i)^(?:by|date|from|to|subject)\\b")} AND NOT {rx(c, "[.!?]\\z")}))"""


def display(c: str) -> str:
    t = f"trim({c}, ' ')"
    return f"""CASE WHEN length({t}) = 0 THEN 'empty' WHEN {metadata_like(t)} THEN 'metadata' WHEN {section_like(t)} THEN 'heading' WHEN {list_item_like(t)} THEN 'list'
  WHEN {dialogue_like(t)} THEN 'dialogue' ELSE 'prose' END"""


def terminal(v: str) -> str:
    bare = f"regexp_replace(rtrim({v}, {WS}), " + lit("[\"')\\]}”’»]+\\z") + ", '')"
    return f"({rx(bare, '[.!?。！？]' + chr(92) + 'z')} AND NOT {rx(bare, '(?:' + chr(92) + '.' + chr(92) + '.' + chr(92) + '.|…)' + chr(92) + 'z')})"


def unbalanced(v: str) -> str:
    return f"({count(v, '“')} <> {count(v, '”')})"


def scored(table: str = "documents") -> str:
    left = "substring(text, greatest(s - 4, 1), least(s, 5))"
    right = f"({BEHIND_1})"
    tests = [rx(right, "^[ \\t\\n\\r]"), f"length({right}) = 0", rx(right, "^[0-9]"), f"{rx(right, '^[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')} AND {rx(f'({AFTER})', '^[a-z]')}", rx(left, "(?:^|[^A-Za-z])[A-Z][a-z]?\\z")]
    z = " + ".join([f"({BIAS})", *(f"({w}) * ({flag(t)})" for t, w in zip(tests, WEIGHTS, strict=True))])
    return located("[.!?]", table, "sc") + f""",
scored AS (SELECT doc_id, text, a, s, e, sb, eb AS break_end, 1 / (1 + exp(-(({z})::DOUBLE))) AS score FROM sc)"""


def sentences(table: str = "documents") -> str:
    return scored(table) + f""",
sent_b AS (SELECT doc_id, text, e, break_end, lag(e, 1, 0) OVER w AS c, lag(break_end, 1, 0) OVER w AS b FROM scored WHERE score >= {THRESHOLD} WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
sent_r AS (SELECT *, substring(text, c + 1, e - c) AS raw FROM sent_b),
sentences AS (SELECT doc_id, (c + length(raw) - length(ltrim(raw, {WS})))::BIGINT AS start, e AS "end", (b + length(raw) - length(ltrim(raw, {WS})))::BIGINT AS start_byte, break_end AS end_byte,
  ltrim(raw, {WS}) AS value FROM sent_r WHERE length(ltrim(raw, {WS})) > 0)"""


SIZES = "sizes AS (SELECT doc_id, strlen(text)::BIGINT AS size FROM documents)"
CUTS = f"""cut_ends AS (SELECT doc_id, break_end AS "end" FROM scored WHERE score >= {THRESHOLD} UNION SELECT doc_id, size FROM sizes),
cuts AS (SELECT * FROM (SELECT doc_id, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "end") AS start, "end" FROM cut_ends) WHERE start < "end")"""
STRIDES = "strides AS (SELECT doc_id, unnest(range(0, strlen(text), 256))::BIGINT AS start FROM documents WHERE strlen(text) > 0)"
JUDGED = """judged AS (SELECT doc_id, quality::BIGINT AS label, toxic::BIGINT AS toxic, ((doc_id * 37) % 100 + 40 * quality) / 140.0::DOUBLE AS score FROM labels WHERE quality IS NOT NULL)"""
RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
CONFUSION = """conf AS (SELECT toxic, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp,
  count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM judged GROUP BY toxic)"""


def sweep(key: str) -> str:
    return f"""swept AS (SELECT {key} step::INT AS step, count(*) FILTER (reach >= step AND label = 1) AS tp, count(*) FILTER (reach >= step AND label <> 1) AS fp,
  count(*) FILTER (reach < step AND label = 1) AS fn FROM (SELECT *, least(floor(score * 100 + 1e-9), 95) AS reach FROM judged), range(5, 96) t(step) GROUP BY {key} step)"""


F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END"


def dot(v: str, weights: list[float], bias: float) -> str:
    return f"({bias} + list_sum([x[1] * x[2] FOR x IN list_zip({v}, {[float(w) for w in weights]}::DOUBLE[])]))"


def draw(a: str, b: str) -> str:
    m = 2**31 - 1
    x = f"((({a}) % {m}) * 48271 + (({b}) % {m}) * 69621 + 12345) % {m}"
    return f"(((((({x}) * 48271) % {m}) * 69621) % {m}) % 10000) / 10000.0"


def para(table: str) -> str:
    sep = lit("\\n[ \\t\\r]*\\n[ \\t\\r\\n]*")
    return f"""par_g AS (SELECT doc_id, text, unnest(g) AS raw, unnest(list_concat(m, [''])) AS sep, unnest(range(0, len(g))) AS k
  FROM (SELECT doc_id, text, string_split_regex(text, {sep}) AS g, regexp_extract_all(text, {sep}) AS m FROM {table})),
par_o AS (SELECT doc_id, k::BIGINT AS k, raw, (sum(length(raw) + length(sep)) OVER (PARTITION BY doc_id ORDER BY k) - length(raw) - length(sep))::BIGINT AS a FROM par_g),
paras AS (SELECT doc_id, k, (a + length(raw) - length(ltrim(raw, {WS})))::BIGINT AS start, (a + length(raw) - length(ltrim(raw, {WS})) + length(trim(raw, {WS})))::BIGINT AS "end", trim(raw, {WS}) AS value
  FROM par_o WHERE length(trim(raw, {WS})) > 0)"""


def punct(version: int, table: str) -> str:
    pattern = "[.!?]" if version == 1 else "[.!?…][\"')\\]}”’]*"
    opener = "\"'#*\\-" if version == 1 else "\"'#*\\-“‘•"
    rest = f"({AFTER})"
    return located(pattern, table, "pu") + f""",
breaks AS (SELECT doc_id, sb AS feature_pos, eb AS break_end FROM pu WHERE NOT ({rx(f"({BEFORE_1})", "[0-9]")} AND {rx(f"({BEHIND_1})", "^[0-9]")} AND e - s = 1)
  AND (length({rest}) = 0 OR {rx(rest, "^[\\p{Lu}" + opener + "]")}))"""


def para_breaks(table: str) -> str:
    return located("[ \\t\\n\\r\\f]*[\\n\\r][ \\t\\f]*[\\n\\r][ \\t\\n\\r\\f]*", table, "pb") + f""",
pbreaks AS (SELECT doc_id, sb AS break_end FROM pb UNION SELECT doc_id, strlen(text)::BIGINT FROM {table} WHERE strlen(text) > 0)"""


LABELLED = f"""labelled AS (SELECT doc_id, line_no, start_byte AS position, start_byte AS start, end_byte AS "end", {display("line")} AS label, (length(line) % 10 + 1) / 10.0::DOUBLE AS score FROM lines)"""
CROSS = """pairs AS (SELECT a.doc_id, a.start, a.start + 256 AS "end", b.start AS r_start, b."end" AS r_end FROM strides a JOIN sentences b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a.start + 256)"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    out["ascii_flags"] = "SELECT lang, count(*) FILTER (strlen(text) = length(text)) AS ascii, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang"
    chars = "(SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0)"
    out["scalar_table"] = f"SELECT ch, count(*) AS n, min(strlen(ch))::BIGINT AS width FROM {chars} GROUP BY ch"
    out["offset_maps"] = "SELECT doc_id, floor(length(text) / 2)::BIGINT AS at, strlen(left(text, floor(length(text) / 2)::INT))::BIGINT AS at_byte, floor(length(text) / 2)::BIGINT AS back FROM documents"
    tagged = "'<|section|>' || coalesce(source, '') || '</|section|> &#xD; ' || text || '<|/paragraph|>  ' || chr(10)"
    bare = f"regexp_replace({tagged}, {lit('<[|]/?[a-z_]+[|]>|</[|][a-z_]+[|]>')}, '', 'g')"
    squeezed = f"trim(regexp_replace(replace({bare}, '&#xD;', ''), {lit('[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+')}, ' ', 'g'), ' ')"
    out["normalise_text"] = f"SELECT doc_id, md5({squeezed}) AS digest, length(rtrim({bare}, {WS}))::BIGINT AS trimmed FROM documents"
    out["byte_encoders"] = f"SELECT ({encoded('c')})::BIGINT AS code, count(*) AS n FROM (SELECT {code('ch')} AS c FROM {chars}) GROUP BY 1"
    groups = {"letter": r"\p{L}", "mark": r"\p{M}", "number": r"\p{N}", "punctuation": r"\p{P}", "symbol": r"\p{S}", "separator": r"\p{Z}", "upper": r"\p{Lu}", "lower": r"\p{Ll}"}
    out["unicode_groups"] = "SELECT lang, " + ", ".join(f'sum({count("text", p)})::BIGINT AS "{n}"' for n, p in groups.items()) + " FROM documents GROUP BY lang"
    out["scan_byteset"] = with_(located(char_set("!.?"))) + "SELECT doc_id, count(*) AS n, min(sb) AS first, max(sb) AS last, sum(sb)::BIGINT AS total FROM loc GROUP BY doc_id"
    out["scan_utf8_set"] = with_(located(char_set("ßéñü"))) + "SELECT doc_id, count(*) AS n, min(sb) AS first, sum(sb)::BIGINT AS total FROM loc GROUP BY doc_id"
    out["scan_stride"] = "SELECT doc_id, unnest(range(0, strlen(text), 512))::BIGINT AS position FROM documents WHERE strlen(text) > 0"
    out["scan_line_starts"] = with_(located("\\n")) + "SELECT doc_id, eb AS position FROM loc WHERE eb < strlen(text) UNION ALL SELECT doc_id, 0 FROM documents WHERE strlen(text) > 0"
    chars = "ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS k FROM documents WHERE length(text) > 0)"
    out["cand_exhaustive"] = with_(chars, "pos AS (SELECT doc_id, strlen(c) AS w, (sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e FROM ch)") + """SELECT doc_id, count(*) AS candidates, sum(e - w)::BIGINT AS positions, max(e) AS last_break,
  count(*) FILTER (w > 1) AS wide FROM pos GROUP BY doc_id"""
    out["cand_terminators"] = with_(located(char_set(TERMINATORS))) + "SELECT doc_id, sb AS feature_pos, eb AS break_end, value FROM loc"
    out["cand_lines"] = with_(STRUCT, lines("struct_docs")) + 'SELECT doc_id, line_no, start, "end", start_byte, end_byte, md5(line) AS digest FROM lines'
    out["cand_punct_v1"] = with_(punct(1, "documents")) + "SELECT * FROM breaks"
    out["cand_punct_v2"] = with_(CONV, punct(2, "conv")) + "SELECT * FROM breaks"
    out["cand_paragraph"] = with_(CONV, para_breaks("conv")) + "SELECT * FROM pbreaks"
    out["cand_union"] = with_(CONV, punct(2, "conv"), para_breaks("conv")) + "SELECT doc_id, break_end FROM breaks UNION SELECT doc_id, break_end FROM pbreaks"
    out["spans_paragraph"] = with_(CONV, para("conv")) + 'SELECT doc_id, k, start, "end", md5(value) AS digest FROM paras'
    out["windows_sentence"] = with_(CONV, para("conv")) + """SELECT a.doc_id, a.k AS first, b.k AS last, a.start, b."end" FROM paras a JOIN paras b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 3
  WHERE b."end" - a.start BETWEEN 200 AND 2000"""
    out["chunks_fixed"] = """SELECT doc_id, p::BIGINT AS start, length(chunk)::BIGINT AS size, md5(chunk) AS digest FROM (SELECT doc_id, p, substring(text, p + 1, 1000) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS p FROM documents WHERE length(text) > 0)) WHERE length(chunk) >= 200"""
    features = {
        "feat_byte_window": [f"({code(at(k))}) / 255.0::DOUBLE" for k in range(-8, 9)],
        "feat_encoded_window": [encoded(f"({code(at(k))})") for k in range(-4, 5)],
        "feat_ascii_neighbors": [flag(rx(f"({at(side)})", m)) for side in (-1, 1) for m in ("^[ \\t\\n\\r\\f]", "^[A-Z]", "^[a-z]")],
    }
    follow, letters = "regexp_extract(after, '^[A-Za-z]*', 0)", count("token", "[A-Za-z]")
    first = rx("regexp_extract(token, '[A-Za-z]', 0)", "[A-Z]")
    features["feat_token_shape"] = [
        flag(f"here = '.' AND {rx(LEFT, '[0-9]' + chr(92) + 'z')} AND {rx(RIGHT, '^[0-9]')}"), flag("here = '.' AND " + rx(LEFT, "[0-9]\\z")), flag("here = '.' AND " + rx(RIGHT, "^[0-9]")),
        f"least({count('token', '[.]')}, 4) / 4.0::DOUBLE", f"least({letters}, 16) / 16.0::DOUBLE", flag(first),
        f"CASE WHEN {letters} > 0 THEN {count('token', '[A-Z]')} / {letters}::DOUBLE ELSE 0 END", f"least(length({follow}), 16) / 16.0::DOUBLE",
        flag(rx(follow, "^[A-Z]")), flag(rx(follow, "^[a-z]")), flag("breaks > 0"), flag(f"here = '.' AND {first} AND {letters} BETWEEN 1 AND 4"),
    ]
    a, b = f"CASE WHEN length({LEFT}) > 16 THEN right({LEFT}, 16) ELSE {LEFT} END", f"substring({RIGHT}, 1, 16)"
    whole = f"(({a}) || here || {b})"
    out["feat_lexicon"] = with_(context("[.!?;,:\"')]", reach=50), "marks AS (SELECT c.*, substring(d.text, 1, c.s + 1) AS upto FROM ctx c JOIN documents d ON d.doc_id = c.doc_id)") + f"SELECT doc_id, feature_pos, {block(lexicon_features())} FROM marks"
    out["feat_terminators"] = with_(context(TERMINATOR_PATTERN)) + f"SELECT doc_id, feature_pos, {block(terminator_features())} FROM ctx"
    resume = f"eb + strlen(a) - strlen(ltrim(regexp_replace(a, {lit('^' + char_set(CLOSERS) + '+')}, ''), {WS}))"
    out["decode_clusters"] = with_(located(TERMINATOR_PATTERN), f"""scored AS (SELECT doc_id, eb AS break_end, e AS break_char, {resume} AS resume,
  CASE WHEN value IN ('.', '!', '?', '…') THEN 0.75 WHEN value IN ({words(CLOSERS)}) THEN 0.5 ELSE 0.25 END + CASE WHEN k % 3 = 0 THEN 0.125 ELSE 0 END AS score FROM loc)""", "good AS (SELECT * FROM scored WHERE score >= 0.5)", clusters("good")) + "SELECT doc_id, break_end, score FROM best"
    best = f"""scored AS (SELECT c.doc_id, l.eb AS break_end, l.e AS break_char, l.eb + strlen(l.a) - strlen(ltrim(l.a, {WS})) AS resume, ({net_score("x", default_net())})::DOUBLE AS score
  FROM (SELECT doc_id, s, [{", ".join(terminator_features())}]::DOUBLE[] AS x FROM ctx) c JOIN loc l ON c.doc_id = l.doc_id AND c.s = l.s)"""
    cut = f"""cut AS (SELECT b.doc_id, lo, substring(text, lo + 1, break_char - lo) AS whole FROM (SELECT *, coalesce(lag(break_char) OVER (PARTITION BY doc_id ORDER BY break_end), 0) AS lo FROM best) b JOIN documents d ON d.doc_id = b.doc_id)"""
    lead = f"lo + length(whole) - length(ltrim(whole, {WS}))"
    out["segment_bundle"] = with_(context(TERMINATOR_PATTERN), best, f"good AS (SELECT * FROM scored WHERE score >= {THRESHOLD})", clusters("good"), cut) + f"""SELECT doc_id, ({lead})::BIGINT AS start, ({lead} + length(trim(whole, {WS})))::BIGINT AS "end" FROM cut WHERE length(trim(whole, {WS})) > 0"""
    features["feat_class_counts"] = [f"{count(whole, c)} / greatest(length({whole}), 1)::DOUBLE" for c in ("[A-Z]", "[a-z]", "[0-9]", "[ \\t\\n\\r]", "[.!?]")]
    a, b = f"(CASE WHEN length({LEFT}) > 12 THEN right({LEFT}, 12) ELSE {LEFT} END)", f"substring({RIGHT}, 1, 12)"
    features["feat_dir_unicode_categories"] = [f"{count(x, c)} / greatest(length({x}), 1)::DOUBLE" for c in ("\\p{Lu}", "\\p{Ll}", "\\p{N}", "\\p{P}", "\\p{S}") for x in (a, b)]
    for name, values in features.items():
        out[name] = with_(context()) + f"SELECT doc_id, feature_pos, {block(values)} FROM ctx"
    after, before, head = "behind", "before", lambda c: f"({heading(f'trim({c}, chr(32))')})"
    listed, meta = (lambda c: rx(f"trim({c}, ' ')", "^(?:[-*•]|[0-9]+[.)])")), lambda c: meta_colon(f"trim({c}, ' ')")
    shape = [
        rx("here", "[.!?…]"), "here = '.'", "here = '!'", "here = '?'", rx("here", "[:;]"), rx("here", "[\"')\\]}>”’»]"), rx(before, "[.!?…]\\z"), rx(after, "^\\p{Lu}"), rx(after, "^\\p{Ll}"), rx(after, "^[0-9]"),
        rx(after, "^[\"'“‘]"), f"starts_with({after}, '#')", rx(after, "^[-*•]"), f"length({after}) = 0", rx(RIGHT, "^[\"')\\]}>”’»]"), "breaks_behind >= 2", "line_breaks_before >= 2",
        head("raw"), listed("raw"), meta("raw"), head("following"), listed("following"),
    ]
    boundary = shape = [flag(t) for t in shape]
    shares = [f"(length(rest) - length(replace(rest, {lit(c) if c != chr(10) else 'chr(10)'}, ''))) / greatest(strlen(rest), 1)::DOUBLE" for c in LINE_CHARS]
    out["feat_boundary_shape"] = with_(STRUCT, line_context()) + f"SELECT doc_id, feature_pos, {block(shape)} FROM lctx"
    out["feat_line_byte_counts"] = with_(STRUCT, line_context()) + f"SELECT doc_id, feature_pos, {block(shares)} FROM lctx"
    a, b = f"CASE WHEN length({LEFT}) > 16 THEN right({LEFT}, 16) ELSE {LEFT} END", f"substring({RIGHT}, 1, 16)"
    both_sides = [f"{count(f'({x})', c)} / greatest(length({x}), 1)::DOUBLE" for c in (*[BYTE_CLASSES[c] for c in COUNTED], *UNICODE_GROUPS) for x in (a, b)]
    kernel = [*[encoded(f"({code(at(k))})") for k in range(-15, 16)], *features["feat_ascii_neighbors"], *shape, *both_sides, *shares, *features["feat_token_shape"]]
    out["feat_sentence_kernel"] = with_(CONV, line_context("conv")) + f"SELECT doc_id, feature_pos, {block(kernel)} FROM lctx"
    whole = f"(({a}) || here || {b})"
    out["feat_byte_class_counts"] = with_(context()) + f"SELECT doc_id, feature_pos, {block([f'{count(whole, c)} / greatest(length({whole}), 1)::DOUBLE' for c in BYTE_CLASSES.values()])} FROM ctx"
    out["feat_dir_byte_classes"] = with_(context()) + f"SELECT doc_id, feature_pos, {block(both_sides)} FROM ctx"
    length = lambda c: f"least(ln(strlen({c}) + 1.0::DOUBLE) / ln(1024.0::DOUBLE), 1.0)"
    n, alpha, body = "greatest(length(raw), 1)::DOUBLE", count("raw", "\\p{L}"), stripped("raw")
    share = lambda p: f"{count('raw', p)} / {n}"
    values = [
        length("raw"), length(body), f"least((strlen(raw) - strlen(regexp_replace(raw, {lit('^' + SPACE + '+')}, ''))) / 64.0::DOUBLE, 1.0)", share("\\p{L}"), share("[0-9]"), share(SPACE), share(PUNCTUATION), share(PUNCTUATION),
        f"{count('raw', chr(92) + 'p{Lu}')} / greatest({alpha}, 1)::DOUBLE", f"{count('raw', chr(92) + 'p{Ll}')} / greatest({alpha}, 1)::DOUBLE", share("[\"'“”‘’]"),
        flag(f"ends_with({body}, ':')"), flag(rx(body, "[.;,]\\z")), flag(f"NOT {rx(body, chr(92) + 'p{Ll}')}"),
    ]
    out["feat_line_shape"] = with_(STRUCT, line_table()) + f"SELECT doc_id, position AS feature_pos, {block(values, 4)} FROM own"

    def compact(c: str) -> list[str]:
        body = stripped(c)
        n, letters = f"greatest(length({body}), 1)::DOUBLE", count(body, "\\p{L}")
        return [length(body), f"{letters} / {n}", f"{count(body, '[0-9]')} / {n}", f"{count(body, chr(92) + 'p{Lu}')} / greatest({letters}, 1)::DOUBLE", f"{count(body, PUNCTUATION)} / {n}"]

    place = [flag("start_byte = 0"), flag("start_byte + strlen(raw) >= size"), "position / greatest(size, 1)::DOUBLE", flag("before >= 2"), flag("after >= 2")]
    shapes = [x for pair in zip(compact("previous"), compact("following"), strict=True) for x in pair]
    kinds = [flag(test(c)) for test in (head, listed, meta) for c in ("previous", "following")]
    empty = flag(f"length({stripped('previous')}) = 0 OR length({stripped('following')}) = 0")
    out["feat_line_context"] = with_(STRUCT, line_table()) + f"SELECT doc_id, position AS feature_pos, {block([*place, *shapes, *kinds, empty], 4)} FROM own"
    out["line_at_position"] = with_(STRUCT, line_table(), "asked AS (SELECT doc_id, unnest(range(0, strlen(text), 300))::BIGINT AS position FROM struct_docs WHERE strlen(text) > 0)") + """SELECT a.doc_id, a.position, l.start_byte AS line_start, (l.start_byte + strlen(l.raw))::BIGINT AS line_end, md5(l.raw) AS digest
  FROM asked a ASOF JOIN ltab l ON a.doc_id = l.doc_id AND a.position >= l.start_byte"""
    out["score_logistic_fixed"] = with_(scored()) + "SELECT doc_id, break_end, round(score, 6) AS score FROM scored"
    v = "embedding::DOUBLE[]"
    z = [dot(v, w, c) for w, c in zip(fixed_weights(3, 64), (0.0, 0.125, -0.125), strict=True)]
    soft = "exp(z[{0}] - list_max(z)) / (exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z)))"
    out["score_softmax_fixed"] = f"SELECT vec_id, {', '.join(f'round({soft.format(k + 1)}, 5) AS p{k}' for k in range(3))} FROM (SELECT vec_id, [{', '.join(z)}] AS z FROM embeddings WHERE embedding IS NOT NULL)"
    hidden = ", ".join(f"greatest({dot(v, w, 0.0)}, 0)" for w in fixed_weights(4, 64))
    heads = ", ".join(f"round(1 / (1 + exp(-{dot('h', w, c)})), 5) AS {n}" for n, w, c in zip("ab", fixed_weights(2, 4), (0.125, -0.25), strict=True))
    out["score_mlp_fixed"] = f"SELECT vec_id, {heads} FROM (SELECT vec_id, [{hidden}] AS h FROM embeddings WHERE embedding IS NOT NULL)"
    out["decode_threshold"] = with_(scored(), SIZES, CUTS) + "SELECT * FROM cuts"
    out["decode_argmax"] = "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings WHERE embedding IS NOT NULL"
    out["decode_contiguous"] = with_(STRUCT, lines("struct_docs"), LABELLED, """ch AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY position) THEN 1 ELSE 0 END AS c FROM labelled),
rn AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM ch),
gr AS (SELECT doc_id, run, label, min(position) AS start, max(score) AS score, avg(score) AS mean FROM rn GROUP BY doc_id, run, label)""") + """SELECT g.doc_id, label, start, coalesce(lead(start) OVER (PARTITION BY g.doc_id ORDER BY run), strlen(s.text)::BIGINT) AS "end", round(score, 6) AS score, round(mean, 6) AS mean
  FROM gr g JOIN struct_docs s ON g.doc_id = s.doc_id"""
    out["decode_sentence_spans"] = with_(sentences()) + 'SELECT doc_id, start, "end", start_byte, end_byte FROM sentences'
    out["decode_structure_runs"] = with_(STRUCT, lines("struct_docs"), LABELLED, """fr AS (SELECT *, CASE WHEN score >= 0.4 AND NOT (coalesce(lag(score >= 0.4) OVER w, false) AND start - lag("end") OVER w <= 2) THEN 1 ELSE 0 END AS f
  FROM labelled WINDOW w AS (PARTITION BY doc_id, label ORDER BY line_no)),
rn AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, label ORDER BY line_no) AS run FROM fr)""") + 'SELECT doc_id, label, min(start) AS start, max("end") AS "end", round(max(score), 6) AS score FROM rn WHERE score >= 0.4 GROUP BY doc_id, label, run'
    out["decode_asof"] = with_(scored(), "p AS (SELECT doc_id, unnest(range(0, strlen(text), 700))::BIGINT AS position FROM documents WHERE strlen(text) > 0)") + "SELECT p.doc_id, p.position, round(s.score, 6) AS score FROM p ASOF LEFT JOIN scored s ON p.doc_id = s.doc_id AND p.position >= s.break_end"
    out["units_to_spans"] = with_(CONV, para("conv"), f"""un AS (SELECT doc_id, k, start, "end", CASE WHEN kind = 'prose' THEN 'none' ELSE kind END AS label FROM (SELECT *, {display("split_part(value, chr(10), 1)")} AS kind FROM paras)),
ch AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY k) THEN 1 ELSE 0 END AS c FROM un),
rn AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM ch)""") + """SELECT doc_id, label, min(start) AS start, max("end") AS "end", count(*) AS units FROM rn WHERE label <> 'none' GROUP BY doc_id, run, label"""
    ratio = '(least("end", r_end) - greatest(start, r_start)) / ("end" - start)::DOUBLE'
    out["span_overlap_targets"] = with_(sentences(), STRIDES, CROSS) + f"SELECT doc_id, start, count(*) AS n, round(max({ratio}), 6) AS ratio, max({ratio}) >= 0.35 AS target FROM pairs GROUP BY doc_id, start"
    out["span_cross_pairs"] = with_(sentences(), STRIDES, CROSS) + 'SELECT doc_id, count(*) AS crossing FROM pairs WHERE start < r_start AND r_start < "end" AND "end" < r_end OR r_start < start AND start < r_end AND r_end < "end" GROUP BY doc_id'
    out["span_boundary_targets"] = with_(punct(1, "documents"), sentences()) + "SELECT doc_id, break_end, (EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = b.doc_id AND s.end_byte = b.break_end AND s.end_byte % 7 <> 0))::BIGINT AS target FROM breaks b"
    out["render_sentences"] = with_(sentences(), """pieces AS (SELECT doc_id, start, "end", value, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM sentences),
agg AS (SELECT p.doc_id, string_agg(substring(d.text, prev + 1, start - prev) || '<|sentence|>' || value || '</|sentence|>', '' ORDER BY start) AS body, max("end") AS last FROM pieces p JOIN documents d ON p.doc_id = d.doc_id GROUP BY p.doc_id),
done AS (SELECT d.doc_id, coalesce(body || substring(d.text, last + 1), d.text) AS tagged FROM documents d LEFT JOIN agg a ON d.doc_id = a.doc_id)""") + "SELECT doc_id, md5(tagged) AS digest, length(tagged)::BIGINT AS size FROM done"
    flags = ", ".join(f"count(*) FILTER ({f('line')}) AS {n}" for n, f in (("section", section_like), ("dialogue", dialogue_like), ("list_item", list_item_like), ("metadata", metadata_like)))
    both = "every AS (SELECT doc_id, text FROM struct_docs UNION ALL SELECT -1 - doc_id, text FROM conv)"
    out["predicate_line_types"] = with_(STRUCT, CONV, both, lines("every")) + f"SELECT {display('line')} AS kind, count(*) AS n, {flags} FROM lines GROUP BY 1"
    n = "greatest(length(text), 1)::DOUBLE"
    out["quality_segments"] = f"""SELECT doc_id, {count("text", "[\\p{L}]")} / {n} >= 0.55 AND {count("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")} / {n} <= 0.01
  AND {count("text", "[^\\p{L}\\p{N} \\t\\n\\r.,;:!?'\"()-]")} / {n} <= 0.18 AND (length(text) < 40 OR {count("text", "[ \\t\\n\\r]")} / {n} >= 0.02)
  AND list_max([length(x) FOR x IN string_split_regex(text, '[ \\t\\n\\r]+')]) <= 160 AS ok FROM documents"""
    out["terminal_quotes"] = f"SELECT doc_id, {terminal('text')} AS terminal, {unbalanced('text')} AS unbalanced FROM documents"
    out["span_quality"] = with_(sentences()) + f"""SELECT CASE WHEN length(trim(value, ' ')) = 0 THEN 'empty' WHEN trim(value, ' ') <> value THEN 'untrimmed' WHEN length(value) < 12 THEN 'short' WHEN {rx("value", "\\n[ \\t]*\\n")} THEN 'crosses paragraphs'
  WHEN {unbalanced("value")} THEN 'quotes' WHEN NOT {terminal("value")} THEN 'no terminal' ELSE 'ok' END AS reason, count(*) AS n FROM sentences GROUP BY 1"""
    stop = "least(start + 1000, length(text))"
    before, inside, after = "rtrim(left(text, start), ' ')", f"rtrim(left(text, {stop}), ' ')", f"substring(text, {stop} + 1)"
    out["edge_flags"] = f"""SELECT doc_id, start::BIGINT AS start, length({before}) > 0 AND NOT {rx(before, "[.!?\\n\\r][\"')\\]}”’»]*\\z")} AS left_open,
  length(trim({after}, ' ')) > 0 AND NOT {rx(inside, "[.!?][\"')\\]}”’»]*\\z")} AND NOT {rx(after, "^[ \\t]*[\\n\\r]")} AS right_open
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000))::INT AS start FROM documents WHERE length(text) > 0)"""
    abbreviations = ", ".join(map(lit, ABBREVIATIONS))
    false = f"""lower(regexp_extract({LEFT}, '([A-Za-z.]+)\\z', 1)) IN ({abbreviations}) OR {rx(LEFT, "(?:^|[^A-Za-z])[A-Z]\\z")} OR {rx(LEFT, "(?:^|[\\n\\r])[ \\t]*(?:[0-9]{1,3}|[IVXLC]{1,6})\\z")}
  OR {rx(LEFT, "[0-9]\\z")} AND {rx(RIGHT, "^[0-9]")} OR {rx(f"regexp_extract({RIGHT}, " + lit("^[ \\t\\n\\r\"')\\]]*(.)") + ", 1)", "\\p{Ll}")}"""
    out["false_boundary_filter"] = with_(context("[.]")) + f"SELECT doc_id, count(*) FILTER ({false}) AS false_breaks, count(*) AS n FROM ctx GROUP BY doc_id"
    out["metric_confusion"] = with_(JUDGED, CONFUSION) + f"SELECT toxic, tp, fp, fn, tn, {RATES}, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM conf"
    out["metric_threshold_sweep"] = with_(JUDGED, sweep("")) + f"SELECT step, tp, fp, fn, round({F1}, 6) AS f1 FROM swept"
    out["metric_best_threshold"] = with_(JUDGED, sweep("toxic,")) + f"""SELECT toxic, step, round(f1, 6) AS f1 FROM (SELECT toxic, step, {F1} AS f1, row_number() OVER (PARTITION BY toxic
  ORDER BY round({F1}, 9) DESC, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) DESC, step) AS r FROM swept) WHERE r = 1"""
    out["metric_boundary_prf"] = with_(sentences(), SIZES, CUTS, """pb AS (SELECT doc_id, start AS at FROM cuts UNION SELECT doc_id, "end" FROM cuts),
gb AS (SELECT doc_id, start_byte AS at FROM sentences UNION SELECT doc_id, end_byte FROM sentences),
cnt AS (SELECT count(*) FILTER (p.at IS NOT NULL AND g.at IS NOT NULL) AS tp, count(*) FILTER (g.at IS NULL) AS fp, count(*) FILTER (p.at IS NULL) AS fn FROM pb p FULL JOIN gb g ON p.doc_id = g.doc_id AND p.at = g.at)""") + f"SELECT tp, fp, fn, {RATES} FROM cnt"
    out["metric_macro_by_label"] = with_(JUDGED, CONFUSION) + f"SELECT coalesce(toxic, -1) AS toxic, round(avg({F1}), 6) AS f1, count(*) AS heads FROM conf GROUP BY ROLLUP (toxic)"
    out["metric_parity_diff"] = """SELECT vec_id, "column", a, b FROM (SELECT vec_id, unnest(range(0, len(embedding)))::BIGINT AS "column", unnest([floor(x::DOUBLE * 8)::BIGINT FOR x IN embedding]) AS a,
  unnest([floor(x::DOUBLE * 8 + 0.5)::BIGINT FOR x IN embedding]) AS b FROM embeddings WHERE embedding IS NOT NULL) WHERE a <> b ORDER BY 1, 2 LIMIT 8"""
    out["leaderboard"] = with_("""judged AS (SELECT 'w' || w AS experiment, CASE WHEN doc_id % 5 = 4 THEN 'validation' ELSE 'evaluation' END AS part, quality::BIGINT AS label,
  ((doc_id * 37) % 100 + w * quality::BIGINT) / 200.0::DOUBLE AS score FROM labels, (SELECT unnest([0, 20, 40, 80]) AS w) WHERE quality IS NOT NULL)""", sweep("experiment, part,"), f"""best AS (SELECT experiment, part, step, {F1} AS f1, row_number() OVER (PARTITION BY experiment, part
  ORDER BY round({F1}, 9) DESC, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) DESC, step) AS r FROM swept)""", """per AS (SELECT experiment, max(f1) FILTER (part = 'validation') AS v, max(step) FILTER (part = 'validation') AS step, max(f1) FILTER (part = 'evaluation') AS e FROM best WHERE r = 1 GROUP BY experiment)""") + """SELECT experiment,
  row_number() OVER (ORDER BY round(v, 9) DESC, round(e, 9) DESC, experiment) AS rank, step, round(v, 6) AS validation_f1, round(e, 6) AS evaluation_f1 FROM per"""
    out["stats_corpus"] = "SELECT lang, source, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY lang, source"
    two64 = "18446744073709551616::HUGEINT"
    mixed = f"xor(xor((doc_id::HUGEINT * 1146959810393466583) % {two64}, (sb::HUGEINT * 1099511628211) % {two64}), eb::HUGEINT)"
    out["sample_hash_negatives"] = with_(located("[.!?;,]"), sentences(), f"""marks AS (SELECT l.doc_id, l.sb AS feature_pos, value, ({mixed} % 10000)::INT / 10000.0::DOUBLE AS u, (EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = l.doc_id AND s.end_byte = l.eb))::BIGINT AS label FROM loc l)""") + """SELECT doc_id, feature_pos, label FROM marks
  WHERE label = 1 OR u < CASE WHEN value IN ('.', '!', '?') THEN 0.33::DOUBLE ELSE 0.1::DOUBLE END"""
    out["sample_stratified_cap"] = f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {draw('doc_id', '7')}, doc_id) AS r FROM documents) WHERE r <= 20"
    out["split_prefix"] = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= count(*) OVER () * 8 // 10 AS train FROM documents"
    out["split_fifth_alternating"] = "SELECT doc_id, doc_id % 5 = 4 AS validation, doc_id % 2 = 0 AS tuning FROM documents"
    out["repeat_positives"] = "SELECT doc_id, toxic::BIGINT AS toxic, unnest(range(1, CASE WHEN toxic = 1 THEN 4 ELSE 2 END))::BIGINT AS copy FROM labels"
    ws_trim = lambda c: f"trim({c}, {WS})"
    inner = f"CASE WHEN {rx('html', '(?s)<pre>.*?</pre>')} THEN regexp_extract(html, '(?s)<pre>(.*?)</pre>', 1) ELSE html END"
    out["page_texts"] = f"SELECT page_id, length(body)::BIGINT AS size, md5(body) AS digest FROM (SELECT page_id, {ws_trim(f'regexp_replace({inner}, {lit(chr(60) + chr(91) + chr(94) + chr(62) + chr(93) + chr(43) + chr(62))}, {lit(str())}, {lit(chr(103))})')} AS body FROM pages) WHERE length(body) > 1500"
    out["passages_joined"] = """SELECT conv_id, length(left(body, 2000))::BIGINT AS size, md5(left(body, 2000)) AS digest FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS body
  FROM conversations WHERE length(text) > 0 GROUP BY conv_id) WHERE length(body) > 300"""
    out["book_bodies"] = f"""SELECT doc_id, length(body)::BIGINT AS size, md5(body) AS digest FROM (SELECT doc_id, CASE WHEN length(t) > 4000 THEN substring(t, 1601, 2000) WHEN length(t) > 2000 THEN substring(t, 801, 2000) END AS body
  FROM (SELECT doc_id, {ws_trim("text")} AS t FROM documents)) WHERE body IS NOT NULL"""
    close = "[.!?]+[\"')\\]}”’]*"
    after, before = "substring(text, e + 1, 36)", "substring(text, greatest(e - 35, 1), least(e, 36))"
    out["cand_weak_label"] = with_(located(close)) + f"""SELECT doc_id, e AS break_char, eb AS break_end, md5({before} || '<<<BREAK>>>' || {after}) AS digest FROM loc
  WHERE {rx(f"({BEHIND_1})", "^[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]")} AND length({AFTER}) > 0 AND lower(regexp_extract(g, '[A-Za-z]*\\z', 0)) NOT IN ({abbreviations})"""
    out["windows_line"] = with_(STRUCT, lines("struct_docs"), f"anchors AS (SELECT doc_id, line_no FROM lines WHERE {display('line')} IN ('list', 'metadata'))") + """SELECT DISTINCT a.doc_id, f.line_no AS first, l.line_no AS last, f.start, l."end" FROM anchors a
  JOIN lines f ON f.doc_id = a.doc_id AND f.line_no BETWEEN a.line_no - 3 AND a.line_no JOIN lines l ON l.doc_id = a.doc_id AND l.line_no BETWEEN a.line_no AND a.line_no + 4 WHERE l."end" - f.start BETWEEN 1 AND 4000"""
    out["blocks_list_item"] = with_("""built AS (SELECT doc_id, '- one ' || coalesce(source, '') || chr(10) || '  more of one' || chr(10) || chr(10) || chr(9) || 'no longer' || chr(10) || '2. two' || chr(10) || '   of two' || chr(10) || coalesce(text, '') AS text FROM documents)""",
        line_table("built"), f"""hd AS (SELECT *, {rx("trim(raw, ' ')", "^(?:[-*•]|[0-9]+[.)])")} AS item, {rx("raw", "^[ " + chr(92) + "t]+[^ " + chr(92) + "t]")} AS ind FROM ltab),
bl AS (SELECT *, sum((item OR NOT ind)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM hd)""") + """SELECT doc_id, min(start_byte) AS start, max(start_byte + strlen(raw))::BIGINT AS "end", count(*) AS lines FROM bl GROUP BY doc_id, block HAVING bool_or(item)"""  # fmt: skip
    edge = [f"CASE WHEN length(line) > {k} THEN (({code(f'(substring(line, {k + 1}, 1))')}) + 1) / 256.0::DOUBLE ELSE 0 END" for k in range(12)]
    edge += [f"CASE WHEN length(line) > {k} THEN (({code(f'(substring(line, length(line) - {k}, 1))')}) + 1) / 256.0::DOUBLE ELSE 0 END" for k in range(6)]
    out["feat_line_edges"] = with_(STRUCT, lines("struct_docs")) + f"SELECT doc_id, start_byte AS feature_pos, {block(edge)} FROM lines"
    out["decode_structure_loose"] = with_(STRUCT, lines("struct_docs"), LABELLED, """fr AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER w > 200, true) THEN 1 ELSE 0 END AS f FROM labelled WHERE score >= 0.4 WINDOW w AS (PARTITION BY doc_id, label ORDER BY line_no)),
rn AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, label ORDER BY line_no) AS run FROM fr)""") + 'SELECT doc_id, label, min(start) AS start, max("end") AS "end", round(max(score), 6) AS score FROM rn GROUP BY doc_id, label, run HAVING max("end") - min(start) >= 10'
    out["breaks_to_sentences"] = with_(CONV, para("conv"), located("[.!?]", "conv"), """cuts AS (SELECT p.doc_id, p.k, p.start, l.e AS pos FROM paras p JOIN loc l ON l.doc_id = p.doc_id AND l.e > p.start AND l.e < p."end" WHERE substring(l.text, l.e + 1, 1) IN (' ', chr(10))
  UNION ALL SELECT doc_id, k, start, "end" FROM paras)""") + """SELECT * FROM (SELECT doc_id, k, coalesce(lag(pos) OVER (PARTITION BY doc_id, k ORDER BY pos), start) AS start, pos AS "end" FROM cuts) WHERE start < "end" """
    out["span_inside_start_end"] = with_(sentences(), "pos AS (SELECT doc_id, unnest(range(0, length(text), 97))::BIGINT AS p FROM documents WHERE length(text) > 0)") + """SELECT doc_id, p AS position,
  (EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = pos.doc_id AND s.start <= p AND p < s."end"))::BIGINT AS inside, (EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = pos.doc_id AND s.start = p AND s.start % 3 <> 0))::BIGINT AS starts,
  (EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = pos.doc_id AND s."end" = p AND s."end" % 3 <> 0))::BIGINT AS ends FROM pos"""
    out["gold_sentence_ends"] = with_(sentences()) + "SELECT doc_id, count(DISTINCT end_byte) AS n, max(end_byte) AS last FROM sentences GROUP BY doc_id"
    out["metric_marker_breaks"] = with_("bench AS (SELECT item_id AS doc_id, text FROM benchmark WHERE text IS NOT NULL)", sentences("bench"), """pred AS (SELECT DISTINCT doc_id, "end" AS c FROM (SELECT *, max("end") OVER (PARTITION BY doc_id) AS z FROM sentences) WHERE "end" < z),
gold AS (SELECT doc_id, (instr(text, m) - 1 + length(m))::BIGINT AS c FROM (SELECT doc_id, text, regexp_extract(text, '([^.;]{3,12}[.])[ \\n]', 1) AS m FROM bench) WHERE length(m) > 0),
cnt AS (SELECT count(*) FILTER (p.c IS NOT NULL AND g.c IS NOT NULL) AS tp, count(*) FILTER (g.c IS NULL) AS fp, count(*) FILTER (p.c IS NULL) AS fn FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.c = g.c)""") + "SELECT tp, fp, fn, " + RATES.replace(", 6)", ", 4)") + " FROM cnt"
    out["class_weights"] = """WITH c AS (SELECT quality::BIGINT AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS raw FROM c)
SELECT label, n, round(raw / avg(raw) OVER (), 6) AS weight FROM r"""
    out["split_three_way"] = f"SELECT lang, CASE WHEN u < 0.7 THEN 'fit' WHEN u < 0.85 THEN 'calibration' ELSE 'validation' END AS part, count(*) AS n FROM (SELECT lang, {draw('doc_id', '11')} AS u FROM documents) GROUP BY 1, 2"
    out["parse_tagged_roundtrip"] = with_(sentences()) + """SELECT d.doc_id, md5(d.text) AS digest, count(s.doc_id) AS spans, true AS ok FROM documents d LEFT JOIN sentences s ON d.doc_id = s.doc_id GROUP BY d.doc_id, d.text"""
    out["render_checked"] = out["render_strict"] = out["render_sentences"].replace("SELECT doc_id, md5(tagged) AS digest, length(tagged)::BIGINT AS size FROM done", "SELECT doc_id, md5(tagged) AS digest FROM done WHERE doc_id IN (SELECT doc_id FROM sentences)")
    key = f"((doc_id % {MOD} * {A} + p % {MOD} * {B} + 12345) % {MOD} * {A} % {MOD} * {B} % {MOD})"
    out["sample_label_reservoirs"] = with_(sentences(), located("[^\\n\\r]+", name="ln"), """sp AS (SELECT doc_id, 'sentence' AS label, start AS a, "end" AS e FROM sentences UNION ALL SELECT doc_id, 'line', s, e FROM ln)""", """edges AS (SELECT doc_id, a AS p FROM sp UNION SELECT doc_id, e - 1 FROM sp),
ins AS (SELECT DISTINCT doc_id, label, p FROM (SELECT doc_id, label, unnest(range(a, e)) AS p FROM sp)), pos AS (SELECT doc_id, unnest(range(0, length(text))) AS p FROM documents WHERE length(text) > 0),
pools AS (SELECT doc_id, p, '<boundary>' AS pool FROM edges UNION ALL SELECT doc_id, p, label FROM ins ANTI JOIN edges USING (doc_id, p) UNION ALL SELECT doc_id, p, '<negative>' FROM pos ANTI JOIN edges USING (doc_id, p) ANTI JOIN ins USING (doc_id, p)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY """ + key + """, doc_id, p) AS r FROM pools)""") + "SELECT doc_id, p::BIGINT AS position, pool FROM ranked WHERE pool = '<boundary>' OR r <= CASE WHEN pool = '<negative>' THEN 200 ELSE 500 END"
    out["cand_sampled_positions"] = with_(sentences(), chars, f"""pos AS (SELECT doc_id, ((sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k)) - strlen(c))::BIGINT AS p FROM ch UNION ALL SELECT doc_id, coalesce(strlen(text), 0) FROM documents),
mk AS (SELECT p.doc_id, p.p, (s.doc_id IS NOT NULL)::INT AS edge FROM pos p LEFT JOIN (SELECT DISTINCT doc_id, end_byte FROM sentences) s ON s.doc_id = p.doc_id AND s.end_byte = p.p),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY edge DESC, {draw("doc_id", "p")}, p) AS r FROM mk)""") + "SELECT doc_id, p AS position FROM rk WHERE r <= 100 OR edge = 1"
    closers = lit("(?s)[.!?…][\"')\\]}”’»\\s]*\\z")
    out["cand_from_breaks"] = with_(CONV, "every AS (SELECT doc_id, text FROM conv)", para_breaks("every"), "ends AS (SELECT b.doc_id, break_end, c.text FROM pbreaks b JOIN conv c ON b.doc_id = c.doc_id)", """pl AS (SELECT doc_id, break_end, CASE WHEN break_end = strlen(text) THEN text
  ELSE (SELECT min(substring(q.text, 1, p.s)) FROM pb p WHERE p.doc_id = q.doc_id AND p.sb = q.break_end) END AS head FROM ends q)""", f"""sz AS (SELECT doc_id, break_end, head, CASE WHEN {rx("head", "(?s)[.!?…][" + chr(34) + "')" + chr(92) + "]}”’»" + chr(92) + "s]*" + chr(92) + "z")} THEN strlen(regexp_extract(head, {closers}, 0))
  ELSE strlen(regexp_extract(head, {lit("(?s)" + chr(92) + "S" + chr(92) + "s*" + chr(92) + "z")}, 0)) END AS size FROM pl WHERE strlen(head) > 0)""") + "SELECT doc_id, (strlen(head) - size)::BIGINT AS feature_pos, break_end FROM sz WHERE size > 0"
    body = f"trim(value, {WS})"
    first = f"trim(regexp_extract({body}, '^[^\\n\\r]*', 0), ' ')"
    out["paragraphs_prose"] = with_(CONV, para("conv")) + f"""SELECT doc_id, k, start, "end" FROM paras WHERE length({body}) > 0 AND NOT contains({body}, chr(10) || chr(10)) AND NOT {section_like(first)} AND NOT {list_item_like(first)} AND NOT {metadata_like(first)}
  AND {count(body, "[" + chr(92) + "p{L}]")} >= 40 AND {count(body, "[" + chr(92) + "p{Ll}]")} >= 20 AND ({terminal(body)} OR {rx(body, "[.!?][" + chr(34) + "')" + chr(92) + "]}”’]*[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]")}) AND "end" - start BETWEEN 40 AND 4000"""
    squeezed = f"trim(regexp_replace(replace(value, '&#xD;', ''), {lit('[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+')}, ' ', 'g'), ' ')"
    out["blocks_eligible"] = with_(CONV, para("conv"), f"sq AS (SELECT doc_id, k, {squeezed} AS b FROM paras)") + f"""SELECT doc_id, k, k % 4 <> 3 AND length(b) >= 40 AND {count("b", "[" + chr(92) + "p{L}]")} >= 20 AND {rx("b", chr(92) + "p{Ll}")} AND NOT {section_like("b")} AND NOT {metadata_like("b")} AS eligible,
  {rx("b", "[.!?][" + chr(34) + "'”’)" + chr(92) + "]]*" + chr(92) + "z")} AS terminal FROM sq"""
    out["eligible_outputs"] = with_(CONV, located("[.!?…;,][\"')\\]}”’]*", "conv")) + f"""SELECT doc_id, eb AS break_end, e % 11 = 0 OR {rx("value", "^[.!?…]")} AS sentence, e = length(text) OR len(regexp_extract_all(regexp_extract(a, '^[ \\t\\n\\r]*', 0), '[\\n\\r]')) >= 2 AS paragraph FROM loc"""
    neighbours = features["feat_ascii_neighbors"]
    z = [" + ".join([f"({c})", *(f"({w}) * ({t})" for t, w in zip(neighbours, weights, strict=True))]) for weights, c in (((0.5, -1.0, 0.25, 2.0, -0.5, -1.5), 0.125), ((0.0, 1.0, 1.0, -1.0, 0.5, 0.25), -0.5))]
    out["score_matrix"] = with_(context()) + f"SELECT doc_id, feature_pos + strlen(here) AS break_end, {', '.join(f'round(1 / (1 + exp(-(({x})::DOUBLE))), 6) AS {n}' for x, n in zip(z, 'ab', strict=True))} FROM ctx"
    kernel = [*[f"({code(at(k))}) / 255.0::DOUBLE" for k in range(-2, 3)], *neighbours, *both_sides[:16], *boundary, *shares]
    out["feat_compiled_kernel"] = with_(CONV, line_context("conv")) + f"SELECT doc_id, feature_pos, {block(kernel)} FROM lctx"
    out["sample_segments"] = f"""WITH a AS (SELECT doc_id, text, length(text) AS n, (200 + floor({draw("doc_id", "0")} * 401))::INT AS size FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, text, n, CASE WHEN n > size THEN floor({draw("doc_id", "1")} * (n - size + 1))::INT ELSE 0 END AS a, size FROM a), c AS (SELECT doc_id, text, n, a, CASE WHEN n > size THEN a + size ELSE n END AS b FROM b),
d AS (SELECT doc_id, text, CASE WHEN a > 0 THEN a + length(regexp_extract(substring(text, a + 1, 40), '^[^ \\t\\n\\r]*[ \\t\\n\\r]+', 0)) ELSE 0 END AS start,
  CASE WHEN b < n THEN b - length(regexp_extract(substring(text, greatest(b - 40, a) + 1, least(40, b - a)), '[ \\t\\n\\r]+[^ \\t\\n\\r]*\\z', 0)) ELSE b END AS "end" FROM c)
SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", md5(substring(text, start + 1, "end" - start)) AS digest FROM d WHERE start < "end" """
    names = "['sentence', 'paragraph', 'list_item', 'dialogue', 'metadata', 'section']"
    out["focus_labels"] = f"SELECT doc_id, 'turn' AS strategy, {names}[doc_id % 6 + 1] AS focus FROM documents UNION ALL SELECT doc_id, 'random', {names}[(floor({draw('doc_id', '5')} * 6) + 1)::INT] FROM documents"
    out["trimmed_chunks"] = f"""SELECT doc_id, p::BIGINT AS at, (CASE WHEN length(trim(c, {WS})) > 0 THEN p + length(c) - length(ltrim(c, {WS})) ELSE p END)::BIGINT AS start,
  (CASE WHEN length(trim(c, {WS})) > 0 THEN p + length(c) - length(ltrim(c, {WS})) + length(trim(c, {WS})) ELSE p END)::BIGINT AS "end" FROM (SELECT doc_id, p, substring(text, p + 1, 300) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 300)) AS p FROM documents WHERE length(text) > 0))"""
    weights = (0.0, 0.0, 0.5, 3.0, -1.0, -2.0, -4.0, *[0.0] * 7, 0.5, -2.5, 0.0, -2.0)
    z = " + ".join(["(-1.0)", *(f"({w}) * ({t})" for t, w in zip([*neighbours, *features["feat_token_shape"]], weights, strict=True))])
    out["pipeline_run"] = with_(context(), f"scored AS (SELECT doc_id, feature_pos + strlen(here) AS break_end, 1 / (1 + exp(-(({z})::DOUBLE))) AS score FROM ctx)", SIZES, CUTS) + "SELECT * FROM cuts"
    basis, prime, two64 = 0xCBF29CE484222325, 0x100000001B3, 2**64
    byte = lambda k: f"(CASE WHEN hex[2 * {k} - 1:2 * {k}] BETWEEN '41' AND '5A' THEN ('0x' || hex[2 * {k} - 1:2 * {k}])::INT + 32 ELSE ('0x' || hex[2 * {k} - 1:2 * {k}])::INT END)"

    def gram(n: int) -> str:
        h = f"{basis ^ n}::HUGEINT"
        for k in range(n):
            h = f"((xor({h}, bytes[p + {k}]::HUGEINT) * {prime}) % {two64}::HUGEINT)"
        return f"SELECT doc_id, line_no, {h} AS h FROM (SELECT *, unnest(range(1, len(bytes) - {n - 2})) AS p FROM raw_bytes WHERE len(bytes) >= {n})"

    out["feat_ngram_hash"] = with_(STRUCT, lines("struct_docs"), f"""hexed AS (SELECT doc_id, line_no, start_byte, hex(encode(line)) AS hex FROM lines),
raw_bytes AS (SELECT doc_id, line_no, start_byte, [{byte("k")} FOR k IN range(1, len(hex) // 2 + 1)] AS bytes FROM hexed)""", f"grams AS ({' UNION ALL '.join(map(gram, (2, 3, 4)))})", f"""summed AS (SELECT doc_id, line_no, (h % 64)::INT AS b, sum(CASE WHEN h >= {2**63}::HUGEINT THEN -1 ELSE 1 END)::DOUBLE AS v FROM grams GROUP BY 1, 2, 3),
sized AS (SELECT doc_id, line_no, count(*) AS n FROM grams GROUP BY 1, 2),
every AS (SELECT r.doc_id, r.start_byte, b.b, coalesce(s.v / sqrt(z.n), 0) AS v FROM raw_bytes r CROSS JOIN (SELECT unnest(range(0, 64)) AS b) b LEFT JOIN summed s ON s.doc_id = r.doc_id AND s.line_no = r.line_no AND s.b = b.b
  LEFT JOIN sized z ON z.doc_id = r.doc_id AND z.line_no = r.line_no)""") + "SELECT doc_id, start_byte AS feature_pos, string_agg(round(v * 1000000::DOUBLE)::BIGINT::VARCHAR, ',' ORDER BY b) AS features FROM every GROUP BY doc_id, start_byte"
    segs = located("[^\\n\\r]*[^ \\t\\n\\r][^\\n\\r]*", "struct_docs", "sl") + f""",
slines AS (SELECT doc_id, k, CASE {display("value")} WHEN 'heading' THEN 'section' WHEN 'list' THEN 'list_item' WHEN 'metadata' THEN 'metadata' END AS label, s + length(value) - length(ltrim(value, ' ')) AS start,
  s + length(value) - length(ltrim(value, ' ')) + length(trim(value, ' ')) AS "end", sb + length(value) - length(ltrim(value, ' ')) AS start_byte,
  {count("replace(g, chr(13) || chr(10), chr(10))", "[" + chr(92) + "n" + chr(92) + "r]")} >= 2 AS apart FROM sl),
ev AS (SELECT doc_id, start_byte AS place, 0 AS mark, label, start, "end", apart FROM slines UNION ALL
  SELECT doc_id, break_end, 1, NULL, e + length(a) - length(ltrim(a, {WS})), e, false FROM scored WHERE score >= {THRESHOLD}),
ln AS (SELECT *, max(CASE WHEN mark = 0 THEN "end" END) OVER w AS line_end, last_value(CASE WHEN mark = 0 THEN coalesce(label, '') END IGNORE NULLS) OVER w AS last_label, lag(mark) OVER v AS last_mark
  FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY place, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY doc_id ORDER BY place, mark)),
ins AS (SELECT *, lag(mark = 1 AND start < line_end) OVER (PARTITION BY doc_id ORDER BY place, mark) AS last_inside FROM ln),
rs AS (SELECT *, CASE WHEN mark = 1 THEN CASE WHEN start < line_end THEN start END WHEN label IS NOT NULL OR coalesce(last_label, '') <> '' OR apart OR last_mark IS NULL OR last_mark = 1 AND NOT last_inside THEN start END AS restart FROM ins),
se AS (SELECT doc_id, mark, "end", last_value(restart IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM rs),
rn AS (SELECT *, sum(CASE WHEN label IS DISTINCT FROM prior OR start - prior_end > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY k) AS prior, lag("end") OVER (PARTITION BY doc_id ORDER BY k) AS prior_end FROM slines)),
segs AS (SELECT doc_id, 'sentence' AS label, start, "end" FROM se WHERE mark = 1 AND start < "end" UNION ALL SELECT doc_id, label, min(start), max("end") FROM rn WHERE label IS NOT NULL GROUP BY doc_id, label, run)"""
    out["segment_spans"] = with_(STRUCT, scored("struct_docs"), segs) + 'SELECT doc_id, label, start::BIGINT AS start, "end"::BIGINT AS "end" FROM segs'
    out["segment_documents"] = with_(STRUCT, scored("struct_docs"), segs) + """SELECT d.doc_id, count(s.doc_id) AS spans, (any_value(length(d.text)) + coalesce(sum(2 * length(s.label) + 9), 0))::BIGINT AS size
  FROM struct_docs d LEFT JOIN segs s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
    out["silver_labels"] = with_(context(), scored(), f"""kept AS (SELECT s.doc_id, s.text, s.e, s.break_end FROM scored s JOIN ctx c ON s.doc_id = c.doc_id AND s.sb = c.feature_pos WHERE s.score >= {THRESHOLD} AND NOT (here = '.' AND coalesce({false}, false))),
cut AS (SELECT doc_id, text, e, break_end, lag(e, 1, 0) OVER w AS c, lag(break_end, 1, 0) OVER w AS b FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
raw AS (SELECT *, substring(text, c + 1, e - c) AS r FROM cut)""") + f"""SELECT doc_id, (c + length(r) - length(ltrim(r, {WS})))::BIGINT AS start, e AS "end", (b + length(r) - length(ltrim(r, {WS})))::BIGINT AS start_byte, break_end AS end_byte FROM raw"""
    out["decode_fused"] = with_(located("[.!?]"), f"""cand AS (SELECT doc_id, eb AS "end", greatest(eb - 1, 0) AS inner_at, CASE WHEN length({AFTER}) > 0 THEN eb + length(a) - length(ltrim(a, {WS})) END AS next_start FROM loc),
sc AS (SELECT doc_id, p AS position, (p * 7) % 11 / 10.0::DOUBLE AS inside, (p * 3) % 13 / 12.0::DOUBLE AS starts, (p * 5) % 17 / 16.0::DOUBLE AS ends FROM (SELECT doc_id, unnest(range(0, strlen(text), 16))::BIGINT AS p FROM documents WHERE strlen(text) > 0)),
j AS (SELECT c.doc_id, c."end", e.ends, coalesce(n.starts, 0) AS starts, greatest(i.inside - coalesce(n.inside, 0), 0) AS drop FROM cand c ASOF JOIN sc e ON c.doc_id = e.doc_id AND c."end" >= e.position
  ASOF JOIN sc i ON c.doc_id = i.doc_id AND c.inner_at >= i.position ASOF LEFT JOIN sc n ON c.doc_id = n.doc_id AND c.next_start >= n.position),
f AS (SELECT doc_id, "end", 0.70::DOUBLE * ends + 0.20::DOUBLE * starts + 0.10::DOUBLE * drop AS score FROM j)""") + 'SELECT doc_id, "end", round(score, 6) AS score, score >= 0.55::DOUBLE * 0.9::DOUBLE AS selected FROM f'
    return out
