"""Marks and sentences found on Arrow batches: the same as the fold in the JVM finds, and no fold in the plan."""

import pytest
from pyspark.sql import functions as F

from spanmill.functions import predicates as Q
from spanmill.functions import text as T
from spanmill.operators import candidates as C
from spanmill.operators import features as X
from spanmill.operators import spans as R
from spanmill.plans import catalogue, segmenter

SF = "/root/testdata/sf0.001"
TEXTS = (
    "One. Two!\n\n Three? 3.5 is Mr. Smith's.  e.g. this", "", None, "Ünö. “Zwei!” 🙂. Ende.", " . .. ?! \t\n", "no mark", "A. B. C.\nIV. x. It went up 5.\n 12. items", "x" * 40 + ". Y" + " " * 50 + "z.", "End.",
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_plain_marks_are_those_of_the_fold(spark):
    fields = ("value", "left", "right", "after", "gap", "rest")
    for chars, reach in (("[.!?]", 4), ("[.!?;,\"')“”🙂]", 32)):
        fast, fold = (T.locate("text", p, fields, reach) for p in (chars, f"(?:{chars})"))
        for row in docs(spark, *TEXTS).select("text", fast.alias("fast"), fold.alias("fold")).collect():
            assert row.fast == row.fold, row.text


@pytest.mark.parametrize("name", ["score_matrix", "feat_dir_byte_classes"])
def test_marks_need_no_fold(spark, name):
    found = plan(catalogue.queries()[name](spark, SF))
    assert "ArrowEvalPython" in found and "split(text#" not in found, found


def test_slices_of_a_batch_lose_nothing(spark):
    from spanmill.functions import marks

    long = "Über. " * 400_000  # 2.8 MB: slices end behind it
    assert len(long.encode()) < marks.SLICE_BYTES < 2 * len(long.encode())
    rows = docs(spark, "a.", long, None, long, "b. c.", "").coalesce(1).select("doc_id", F.size(T.locate("text", "[.!?]", ())).alias("n"), F.size(segmenter._sentence_spans(0.5)).alias("s"))
    assert [(r.n, r.s) for r in rows.orderBy("doc_id").collect()] == [(1, 1), (400_000, 400_000), (None, None), (400_000, 400_000), (2, 1), (0, 0)]


@pytest.mark.parametrize("name", ["decode_sentence_spans", "silver_labels", "span_inside_start_end", "render_strict", "sample_label_reservoirs"])
def test_sentences_need_no_fold(spark, name):
    rows = segmenter.sentences(docs(spark, "x"), values=False) if name.startswith("sample") else catalogue.queries()[name](spark, SF)
    found = plan(rows)
    assert "ArrowEvalPython" in found and "regexp_extract_all(text#" not in found, found


def test_sentences_are_those_of_the_fold(spark):
    """Against the marks' scores: a sentence runs from the first non-blank behind a break to the next break."""
    rows = docs(spark, *TEXTS)
    scores = {(r.doc_id, r.break_char): r.score for r in segmenter.score(rows, "(?:[.!?])").collect()}
    for threshold in (0.2, 0.5, 0.8):
        for row in rows.select("doc_id", "text", segmenter._sentence_spans(threshold).alias("spans")).collect():
            if row.text is None:
                assert row.spans is None
                continue
            last, want = 0, []
            for end in sorted(e for (d, e), score in scores.items() if d == row.doc_id and score >= threshold):
                start = last + len(row.text[last:]) - len(row.text[last:].lstrip(" \t\n\r"))
                want.append((start, end, len(row.text[:start].encode()), len(row.text[:end].encode())))
                last = end
            assert [tuple(s) for s in row.spans] == want


def test_false_boundaries_are_those_of_the_columns(spark):
    cases = [(t[max(0, k - 32) : k], t[k + 1 : k + 33]) for t in (*TEXTS, "vs. et al. (éa. ß. 9.9 \n XIV. Q .  a e.g.", ". \n\u0085x") if t for k, c in enumerate(t) if c == "."]
    rows = spark.createDataFrame(cases, "left string, right string").select("*", F.coalesce(Q.false_boundary(F.col("left"), F.col("right")), F.lit(False)).alias("want"))
    for row in rows.collect():
        assert Q.is_false_boundary(row["left"], row["right"]) == row.want, row


def test_lines_are_those_of_the_fold(spark):
    fields = ("value", "left", "right", "after", "gap", "rest")
    fast, fold = (T.locate("text", p, fields, 5) for p in ("[^\\n\\r]+", "(?:[^\\n\\r]+)"))
    for row in docs(spark, *TEXTS, " a \n\n \r\n\tb  \n ", "\n").select("text", fast.alias("fast"), fold.alias("fold")).collect():
        assert row.fast == row.fold, row.text
    assert "ArrowEvalPython" in plan(catalogue._spanned(spark, SF)) and "split(text#" not in plan(docs(spark, "x").select(T.locate("text", "[^\\n\\r]+")))


def test_shares_of_the_rest_of_a_line_are_those_of_the_fold(spark):
    from spanmill.operators import lines as L

    fast, fold = (L.rest_of_line_counts("text", p, "\n#:,.'") for p in ("[.!?]", "(?:[.!?])"))
    rows = docs(spark, *TEXTS, "a. b: c\n#. x,,.\n\n.", ".\r\n'ü.':").select("text", fast.alias("fast"), fold.alias("fold"))
    for row in rows.collect():
        assert row.fast == row.fold, row.text
    assert "split(text#" not in plan(rows.select("fast"))


def test_exhaustive_walks_windows(spark, monkeypatch):
    monkeypatch.setattr(C, "WINDOW", 7)
    texts = (*TEXTS, "ß🙂" * 9, "", "🙂")
    got = {}
    rows = C.exhaustive(docs(spark, *texts))
    for r in rows.collect():
        got.setdefault(r.doc_id, []).append((r.feature_pos, r.break_end))
    for k, t in enumerate(texts):
        ends = [len(t[:i].encode()) for i in range(len(t) + 1)] if t else []
        assert sorted(got.get(k, [])) == list(zip(ends, ends[1:])), t
    assert "left(" not in plan(rows) and "MapInArrow" in plan(rows)


def test_tags_are_parsed_without_a_fold(spark):
    S = R.parse_tagged(spark.createDataFrame([(0, "<|sentence|>Ü<|section|>b</|section|><|/sentence|> c"), (1, "a<|nope|>"), (2, "</|section|>"), (3, "<|section|>x"), (4, None), (5, ""), (6, "<|nope|></|section|>")], "doc_id long, tagged string"))
    got = {r.doc_id: (r.text, r.spans and [tuple(s) for s in r.spans], r.error) for r in S.collect()}
    assert got == {
        0: ("Üb c", [("section", 1, 2), ("sentence", 0, 2)], None), 1: ("a", [], "unknown label nope"), 2: ("", [], "unexpected end of section"), 3: ("x", [], "a tag is left open"), 4: (None, None, None),
        5: ("", [], None), 6: ("", [], "unknown label nope"),
    }
    assert "aggregate(" not in plan(S)


def test_shares_of_texts_gather_no_matches(spark, monkeypatch):
    monkeypatch.setattr(catalogue.M, "fit_heads", lambda rows, labels: {c: ([0.5] * 5, 0.0) for c in labels})
    found = plan(catalogue.queries()["train_heads"](spark, SF))
    assert "regexp_replace(" in found and "regexp_count(" not in found and "regexp_extract_all(" not in found


ODD = (b"A. b! \xff? C. d.", b"\xc3. Ae. x", b"Fine. Text here. And so")


def test_odd_bytes_are_read_as_before(spark):
    """Texts that aren't UTF-8 stand between sound ones in a slice."""
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(ODD)], "doc_id long, raw binary").coalesce(1).select("doc_id", F.col("raw").cast("string").alias("text"))
    fields = ("value", "left", "right", "after", "gap", "rest")
    for row in rows.select("doc_id", T.locate("text", "[.!?]", fields, 4).alias("m"), segmenter._sentence_spans(0.5).alias("s")).collect():
        t = ODD[row.doc_id].decode("utf-8", "replace")
        marks = [k for k, c in enumerate(t) if c in ".!?"]
        assert [(m.start, m.left, m.gap, m.rest) for m in row.m] == [(k, t[max(0, k - 4) : k], t[last:k], t[k + 1 : following]) for k, last, following in zip(marks, [0, *(k + 1 for k in marks)], [*marks[1:], len(t)])]
        assert len(row.s) > 0 and all(t[x.end - 1] in ".!?" and not t[x.start].isspace() for x in row.s)
    assert "is_valid_utf8" in plan(rows.select(segmenter._sentence_spans(0.5)))


def test_marks_of_a_slice_are_found_at_once(monkeypatch):
    """No Python call for each mark: what is taken around one is not asked."""
    import pyarrow as pa

    from spanmill.functions import marks

    raws = pa.array([None if t is None else t.encode() for t in (*TEXTS, "ü.é")], pa.binary())
    p = marks.Places(raws.slice(3), marks.ascii_class("[.!?]"))
    assert p.pieces(p.before(p.at, p.low, 2), p.at).to_pylist()[:5] == ["nö", "ei", " 🙂", "de", " "]
    assert marks.ascii_class("[^\\n]+") is None and marks.ascii_class("[.…]") is None and marks.ascii_class("[\\n.]").sum() == 2


def test_a_pipeline_cuts_no_wider_than_its_blocks_look():
    from spanmill.plans.pipeline import Pipeline

    assert Pipeline().with_block("n", X.ascii_neighbours).reach == 1
    assert Pipeline().with_block("n", X.ascii_neighbours).with_block("t", X.token_shape).reach == X.REACH


def test_shares_of_either_side_are_those_of_the_regexes(spark, monkeypatch):
    from spanmill.functions import marks

    classes = [*[X.BYTE_CLASSES[c] for c in X.COUNTED], *X.UNICODE_GROUPS, "\\p{Lu}", "\\p{Ll}"]
    sides = ["", "Ab 1", "a\n\r\t\f[(]){}", "x" * 20, "".join(map(chr, range(1, 65))), "".join(map(chr, range(64, 128))), "Ünö²€\u2003", "\x7f\x00~`^$+<=>|"]
    rows = spark.createDataFrame([(a, b) for a in sides for b in sides], "left string, right string")
    quick = rows.select(X.class_counts(classes, 64, 64, True).alias("x"))
    assert "ArrowEvalPython" in plan(quick)
    got = [r.x for r in quick.collect()]
    monkeypatch.setattr(marks, "side_shares", lambda *a: None)
    assert got == [r.x for r in rows.select(X.class_counts(classes, 64, 64, True).alias("x")).collect()]


def test_neighbours_are_compared_without_a_regex(spark):
    rows = spark.createDataFrame([("a", "B"), ("", "é"), ("É", "\n"), ("Z", "z"), ("[", "{")], "left string, right string").select(X.ascii_neighbours().alias("x"))
    assert "RLIKE" not in plan(rows) and "rlike" not in plan(rows)
    assert [r.x for r in rows.collect()] == [[0, 0, 1, 0, 1, 0], [0] * 6, [0, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 1], [0] * 6]
