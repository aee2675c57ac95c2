"""Golden cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from spanmill.functions import text as T
from spanmill.operators import candidates as C
from spanmill.operators import decode as D
from spanmill.operators import metrics as A
from spanmill.operators import models as M
from spanmill.operators import sampling as S
from spanmill.operators import spans as R
from spanmill.operators import features as X
from spanmill.operators import kernels as K
from spanmill.operators import lines as L
from spanmill.plans import segmenter


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def positions(df, c="position"):
    return sorted(r[c] for r in df.collect())


def test_scanners(spark):
    assert positions(C.scan_set(docs(spark, "A. B! C?"), ".!?")) == [1, 4, 7]
    assert positions(C.scan_set(docs(spark, "A.” B?"), ".”?")) == [1, 2, 7]
    assert positions(C.scan_set(docs(spark, "abc", None, ""), "")) == []
    assert positions(C.scan_stride(docs(spark, "abcdefghij", "", None), 3)) == [0, 3, 6, 9]
    assert positions(C.scan_line_starts(docs(spark, "one\ntwo\nthree", "", "x\n"))) == [0, 0, 4, 8]


def test_lines_and_breaks(spark):
    rows = [tuple(r)[2:6] for r in C.lines(docs(spark, "A\n\n- B\n")).collect()]
    assert rows == [(0, 1, 0, 1), (3, 6, 3, 6)]
    breaks = lambda t, v: [(r.feature_pos, r.break_end) for r in C.punctuation_breaks(docs(spark, t), v).orderBy("break_end").collect()]
    assert breaks("One. Two.", 2) == [(3, 4), (8, 9)]
    assert breaks('"One." Two.', 2)[0] == (4, 6)
    assert breaks("pi is 3.14 or so. yes", 1) == []
    assert positions(C.paragraph_breaks(docs(spark, '"One."\n\nTwo.')), "break_end") == [6, 12]
    assert [(r.start, r.end) for r in C.paragraphs(docs(spark, " a\n b \n\n\n c")).collect()] == [(1, 5), (10, 11)]


def test_offsets(spark):
    row = docs(spark, "Aé.\U0001f600b").select(
        T.char_to_byte("text", F.lit(3)).alias("b"), *[T.byte_to_char("text", F.lit(k)).alias(f"c{k}") for k in range(10)], T.is_ascii("text").alias("a")
    ).first()
    assert row.b == 4 and [row[f"c{k}"] for k in range(10)] == [0, 1, 1, 2, 3, 3, 3, 3, 4, 5] and not row.a
    with pytest.raises(Exception, match="out of range"):
        docs(spark, "ab").select(T.char_to_byte("text", F.lit(3))).collect()


def test_decoders(spark):
    scored = spark.createDataFrame([(1, 2, 0.9), (1, 5, 0.1), (1, 7, 0.8)], "doc_id long, break_end long, score double")
    sizes = spark.createDataFrame([(1, 9)], "doc_id long, size long")
    spans = lambda tail: sorted((r.start, r.end) for r in D.threshold_spans(scored, sizes, 0.5, tail).collect())
    assert spans(True) == [(0, 2), (2, 7), (7, 9)] and spans(False) == [(0, 2), (2, 7)]
    rows = spark.createDataFrame([(1, 0, "a", 0.5), (1, 3, "a", 0.75), (1, 6, "b", 1.0)], "doc_id long, position long, label string, score double")
    assert sorted(map(tuple, D.contiguous_spans(rows, sizes).collect())) == [(1, "a", 0, 6, 0.75, 0.625), (1, "b", 6, 9, 1.0, 1.0)]
    asof = D.as_of(spark.createDataFrame([(1, 1), (1, 6)], "doc_id long, position long"), scored.withColumnRenamed("break_end", "position"))
    assert sorted((r.position, r.score) for r in asof.collect()) == [(1, None), (6, 0.1)]


def test_crossing_spans_and_rendering(spark):
    table = docs(spark, "One. Two é.", None)
    spans = [("paragraph", 0, 11), ("sentence", 0, 4), ("sentence", 5, 11), ("section", 2, 7), ("metadata", 3, 3)]
    rows = spark.createDataFrame([(0, [(a, b, c, 1.0) for a, b, c in spans])], "doc_id long, spans array<struct<label:string,start:long,end:long,score:double>>")
    kept = R.resolve(rows)
    assert [tuple(s)[:3] for s in kept.first().spans] == [("sentence", 0, 4), ("paragraph", 0, 11), ("sentence", 5, 11)]
    tagged = R.render(kept.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.label", "s.start", "s.end"), table)
    text = {r.doc_id: r.tagged for r in tagged.collect()}
    assert text[0] == "<|paragraph|><|sentence|>One.</|sentence|> <|sentence|>Two é.</|sentence|></|paragraph|>" and text[1] is None
    assert tagged.select(T.strip_tags("tagged")).first()[0] == "One. Two é."


def test_range_join_matches_nested_loops(spark):
    rng = random.Random(5)
    spans = lambda n: [(rng.randrange(3), a, a + rng.randrange(0, 60)) for a in (rng.randrange(500) for _ in range(n))]
    left, right = spans(60), spans(60)
    got = R.range_join(spark.createDataFrame(left, "doc_id long, start long, end long"), spark.createDataFrame(right, "doc_id long, r_start long, r_end long"), 16)
    expected = sorted((d, a, b, c, e) for d, a, b in left for f, c, e in right if d == f and a < b and c < e and a < e and c < b)
    assert sorted((r.doc_id, r.start, r.end, r.r_start, r.r_end) for r in got.collect()) == expected


def test_metrics(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.4, 1), (0.1, 0)], "score double, label int")
    c = A.confusion(rows, 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.f1, c.accuracy) == (1, 1, 1, 1, 0.5, 0.5)
    best = A.best_threshold(A.sweep(rows)).first()
    assert best.step == 11 and abs(best.f1 - 0.8) < 1e-9
    bounds = A.boundary_scores(spark.createDataFrame([(1, 0, 4)], "doc_id long, start long, end long"), spark.createDataFrame([(1, 0, 5)], "doc_id long, start long, end long")).first()
    assert (bounds.tp, bounds.fp, bounds.fn) == (1, 1, 1)


def test_models(spark):
    rows = spark.createDataFrame([([float(x), 1.0 - x], x) for x in [0, 1] * 20], "features array<double>, label int")
    weights, bias = M.fit_logistic(rows)
    scores = {r.label: r.s for r in rows.select("label", M.logistic(F.col("features"), weights, bias).alias("s")).collect()}
    assert scores[1] > 0.9 > 0.1 > scores[0]
    p = rows.select(M.softmax(F.col("features"), [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]).alias("p")).first().p
    assert abs(sum(p) - 1) < 1e-12
    with pytest.raises(Exception, match="width"):
        rows.select(M.dot(F.col("features"), [1.0])).collect()


def test_samples(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "id AS position", "CAST(id % 10 = 0 AS INT) AS label", "id % 2 = 0 AS terminal")
    kept = S.keep_negatives(rows, 0.1, 0.5)
    assert kept.where("label = 1").count() == 100 and 150 < kept.where("label = 0").count() < 350
    assert S.prefix_split(rows.select("doc_id"), "doc_id", 1, 4).where("train").count() == 250
    assert S.stratified(rows, "doc_id", "label", 7).count() == 14 and S.stratified(rows, "doc_id", "label", 0).count() == 0


def test_segmenter(spark):
    out = segmenter.sentences(docs(spark, "One. Two é! three. Mr. X said 3.5. Tail", "", None)).orderBy("start").collect()
    assert [r.value for r in out] == ["One.", "Two é! three.", "Mr. X said 3.5."]
    assert all("One. Two é! three. Mr. X said 3.5. Tail"[r.start : r.end] == r.value for r in out)
    assert [r.end_byte - r.end for r in out] == [0, 1, 1]
    row = segmenter.annotate(docs(spark, "# Head\n\nAuthor: Me\n- item one\nIt is so. Yes.")).first()
    assert {s.label for s in row.spans} >= {"section", "metadata", "sentence"} and row.tagged.startswith("<|section|># Head</|section|>")


def test_prefix_split(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 8)
    monkeypatch.setattr(S, "RANGES", 4)
    for values in (list(range(100)), [5] * 60 + [7] * 40, [None] * 30 + list(range(-35, 35)), [-(2**63), 2**63 - 1] * 10, [3], []):
        rows = spark.createDataFrame([(v,) for v in values], "doc_id long").repartition(3)
        got = S.prefix_split(rows, "doc_id", 8, 10).collect()
        order = lambda v: (v is None, v or 0)
        assert sorted((r.doc_id for r in got), key=order) == sorted(values, key=order)
        taken = sorted((r.doc_id for r in got if r.train), key=order)
        assert taken == sorted(values, key=order)[: len(values) * 8 // 10] and all(r.train is not None for r in got)


def test_crossings_as_by_comparing_all():
    rng = random.Random(2)
    rank = {label: k for k, label in enumerate(R.PRIORITY)}
    for _ in range(300):
        spans = [{"label": rng.choice(R.PRIORITY), "start": (a := rng.randrange(30)), "end": a + rng.randrange(12)} for _ in range(rng.randrange(25))]
        kept = []
        for s in sorted((s for s in spans if s["end"] > s["start"]), key=lambda s: (rank[s["label"]], s["start"], -s["end"])):
            if not any(k["start"] < s["start"] < k["end"] < s["end"] or s["start"] < k["start"] < s["end"] < k["end"] for k in kept):
                kept.append(s)
        assert R.without_crossings(spans) == sorted(kept, key=lambda s: (s["start"], s["end"], -rank[s["label"]]))


def test_renderers_that_check(spark):
    kind = "doc_id long, text string, spans array<struct<label:string,start:long,end:long>>"
    table = lambda *spans: spark.createDataFrame([(0, "One. Two é.", list(spans))], kind)
    strict = lambda df: df.select(R.strict_text(F.col("text"), F.col("spans"))).first()[0]
    good = [("sentence", 0, 4), ("sentence", 5, 11), ("paragraph", 0, 11)]
    tagged = "<|paragraph|><|sentence|>One.</|sentence|> <|sentence|>Two é.</|sentence|></|paragraph|>"
    assert strict(table(*good)) == tagged == R.render_checked(table(*good, ("section", 2, 7), ("metadata", 3, 3))).first().tagged
    for spans, message in [([("odd", 0, 4)], "not a span"), ([("sentence", 5, 12)], "not a span"), ([("sentence", 3, 3)], "empty"), ([("sentence", 0, 4), ("section", 2, 7)], "crossing")]:
        with pytest.raises(Exception, match=message):
            strict(table(*spans))
    with pytest.raises(Exception, match="not a span"):
        R.render_checked(table(("sentence", -1, 4))).collect()


def test_blank_runs_of_any_length(spark):
    for gap in (" " * 10, " " * 100, "\n" * 300):
        text = f"One.{gap}two.{gap}Three."
        assert [r.break_end for r in C.punctuation_breaks(docs(spark, text)).orderBy("break_end").collect()] == [len(f"One.{gap}two."), len(text)]
        assert [r.end for r in segmenter.sentences(docs(spark, text)).orderBy("end").collect()] == [len(f"One.{gap}two."), len(text)]
    row = docs(spark, "a" * 80 + "." + "b.c" * 40 + ". x").select(F.explode(T.locate("text", "[.]", ("word", "token"))).alias("m")).select("m.*").collect()
    assert len(row[0].word) == 80 and row[-1].token.dots == 41 and row[-1].token.letters == 160


def test_sentences_end_at_structure(spark):
    text = "# Head\n\nAuthor: Me\nFirst line\r\nof prose. Next one! Mr. X\n\nstays. - no\n- item one. Two\nTail here."
    row = segmenter.annotate(docs(spark, text, "", None)).where("doc_id = 0").first()
    parts = [(s.label, text[s.start : s.end]) for s in row.spans]
    assert parts == [("section", "# Head"), ("metadata", "Author: Me"), ("sentence", "First line\r\nof prose."), ("sentence", "Next one!"), ("sentence", "stays."), ("sentence", "- item one."), ("list_item", "- item one. Two"), ("sentence", "Tail here.")]
    assert docs(spark, row.tagged).select(T.strip_tags("text")).first()[0] == text
    found = segmenter.annotate(docs(spark, text), include_structure=False).first()
    assert {s.label for s in found.spans} == {"sentence"}


def test_blocks(spark):
    text = "Para one\ngoes on.\n\n- item here\nmore of it\n- second one\nTitle: value\nprose again\r\n\r\nend"
    got = [(text[r.start : r.end], r.value) for r in C.blocks(docs(spark, text, "", "\n \n", None)).orderBy("block").collect()]
    assert [a for a, _ in got] == [b for _, b in got]
    assert [b for _, b in got] == ["Para one\ngoes on.\n", "- item here\nmore of it\n", "- second one\n", "Title: value\n", "prose again\r\n", "end"]


def test_kernels(spark):
    kernel = K.compile_kernel('[{"kind": "ascii_class"}, {"kind": "boundary_shape"}, {"kind": "line_byte_counts"}]')
    assert kernel.width == 38 and len(kernel.extract(docs(spark, "# A. b\n- c.")).first().features) == 38
    for bad in ("[]", '[{"kind": "odd"}]', '[{"kind": "byte_window", "left": 1}]', '[{"kind": "byte_window", "left": 99, "right": 0}]', '[{"kind": "byte_class_counts", "left": 1, "right": 1, "classes": ["odd"]}]'):
        with pytest.raises(K.SpecError):
            K.compile_kernel(bad)
    rows = X.line_context(docs(spark, "A b. C", "no mark", None))
    assert [(len(r.a), len(r.b)) for r in rows.select(X.sentence_kernel().alias("a"), X.sentence_kernel(tokens=True).alias("b")).collect()] == [(97, 109)]


def test_lines_with_neighbours(spark):
    text = "one\n\n  \ntwo\r\n\nthree"
    rows = {r.raw: r for r in L.line_table(docs(spark, text, "", None)).collect()}
    assert [(r.before, r.after, r.previous, r.following) for r in (rows["one"], rows["two"], rows["three"])] == [(0, 3, "", ""), (3, 3, "  ", ""), (3, 0, "two", "")]
    assert all(text.encode()[r.position :].startswith(r.raw.strip().encode()) for r in rows.values())


def test_code_point_bounds(spark):
    row = docs(spark, "aé\U0001f600b").select(*[T.char_boundary("text", F.lit(k), up).alias(f"{k}{up}") for k in range(-1, 10) for up in (False, True)]).first()
    assert [row[f"{k}False"] for k in range(-1, 10)] == [0, 0, 1, 1, 3, 3, 3, 3, 7, 8, 8]
    assert [row[f"{k}True"] for k in range(-1, 10)] == [0, 0, 1, 3, 3, 7, 7, 7, 7, 8, 8]
    assert docs(spark, "ab\ncd").select(T.point_context("text", F.lit(2), 2)).first()[0] == "ab|\\nc"


def test_hash_draw_in_64_bits(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2**40), rng.randrange(2**31), rng.randrange(2**31)) for _ in range(200)]
    got = spark.createDataFrame(rows, "i long, p long, e long").select("i", "p", "e", S.hash_draw(F.col("i"), F.col("p"), F.col("e")).alias("u")).collect()
    for r in got:
        mixed = (r.i * 1146959810393466583 % 2**64) ^ (r.p * 1099511628211 % 2**64) ^ r.e
        assert r.u == mixed % 10000 / 10000


def test_independent_heads(spark):
    rows = spark.createDataFrame([([float(k % 7), float(k % 3)], int(k % 7 > 3), None if k % 5 == 0 else int(k % 3 == 0), 1) for k in range(300)], "features array<double>, a int, b int, c int")
    heads = M.fit_heads(rows, ["a", "b", "c"])
    got = rows.select("a", "b", *[M.logistic(F.col("features"), *heads[h]).alias(f"p{h}") for h in heads]).collect()
    assert all((r.pa > 0.5) == (r.a == 1) for r in got) and all(r.pc > 0.99 for r in got)
    assert all((r.pb > 0.5) == (r.b == 1) for r in got if r.b is not None)


def test_long_texts_cost_their_length(spark):
    import time

    unit = "A line of prose here.\nAnother one.\n\nÜber alles, a new paragraph. "
    plans = {
        "paragraphs": C.paragraphs, "exhaustive": C.exhaustive, "cut": lambda d: d.select(F.explode(T.cut("text", 300)).alias("s")).select("s.*"),
    }
    for name, plan in plans.items():
        seconds = []
        for times in (100, 6_000, 60_000):  # the first compiles; 0.4 and 4 MB
            table = docs(spark, unit * times)
            began = time.perf_counter()
            plan(table).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        assert seconds[2] < 15 * seconds[1] + 3, (name, seconds)
