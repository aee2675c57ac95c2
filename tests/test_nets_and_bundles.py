"""Nets, bundles, lexicon features and the segmenter that is put together from them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.functions import lexicon
from spanmill.operators import candidates as C
from spanmill.operators import decode as D
from spanmill.operators import features as X
from spanmill.operators import kernels, metrics, models, nets
from spanmill.plans import segmenter
from spanmill.sources import bundles, generate
from spanmill.sources.artifacts import ArtifactError
from tests.labelled_cases import CASES


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_net_round_trip_and_scores_equal_the_column_version(spark):
    net = nets.fresh([3, 5, 2], seed=3)
    assert np.array_equal(nets.Net.from_json(net.to_json()).flat(), net.flat())
    rows = [(k, [k / 7, -1.0, 0.5 * k]) for k in range(20)] + [(99, None)]
    table = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    layers = [(w.T.tolist(), b.tolist()) for w, b in net.layers]
    expected = {r.id: r.b for r in table.where("x is not null").select("id", models.mlp(F.col("x"), layers).alias("b")).collect()}
    for r in table.select("id", nets.scores(F.col("x"), net).alias("a")).collect():
        assert r.a is None if r.id == 99 else np.allclose(r.a, expected[r.id])
    nested = table.groupBy(F.pmod("id", F.lit(4)).alias("g")).agg(F.collect_list("x").alias("x")).unionByName(spark.createDataFrame([(50, None), (51, [])], "g long, x array<array<double>>"))
    for r in nets.with_scores(nested.withColumn("y", F.col("x")), "x", net, "s").withColumnRenamed("y", "x").collect():
        assert r.s is None if r.g == 50 else np.allclose(np.array(r.s).reshape(-1, 2), net.predict(np.array(r.x, float).reshape(-1, 3)))
    with pytest.raises(Exception, match="the net takes 3"):
        spark.createDataFrame([([1.0],)], "x array<double>").select(nets.scores(F.col("x"), net)).collect()


@pytest.mark.parametrize("text", ['{"format": "other"}', '{"format": "spanmill-net-1", "layers": []}', '{"format": "spanmill-net-1", "layers": [{"weights": [[1], [2, 3]], "bias": [0]}]}',
    '{"format": "spanmill-net-1", "layers": [{"weights": [[1, 2]], "bias": [0]}]}', '{"format": "spanmill-net-1", "layers": [{"weights": [[1]], "bias": [0]}, {"weights": [[1], [2]], "bias": [0]}]}',
    '{"format": "spanmill-net-1", "layers": [{"weights": [[NaN]], "bias": [0]}]}'])
def test_nets_that_cannot_be_read(text):
    with pytest.raises(nets.NetError):
        nets.Net.from_json(text)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    net = nets.fresh([4, 6, 3], seed=1)
    x, y, w = rng.normal(size=(9, 4)), rng.integers(0, 2, (9, 3)).astype(float), rng.uniform(0, 2, 9)
    y[0, 1] = np.nan
    positive = np.array([1.0, 2.0, 0.5])
    g, _ = nets.gradient(net, x, y, w, positive)
    flat = net.flat()
    for k in range(0, flat.size, 5):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (nets.gradient(net.like(up), x, y, w, positive)[1] - nets.gradient(net.like(down), x, y, w, positive)[1]) / 2e-6
        assert g[k] == pytest.approx(slope, abs=1e-5)


def ring(spark, n=400, parts=3):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (n, 2))
    rows = [(a.tolist(), [int((a**2).sum() < 0.4), int(a[0] > 0) if k % 10 else None]) for k, a in enumerate(x)]
    return spark.createDataFrame(rows, "features array<double>, targets array<int>").repartition(parts)


def test_fit_learns_what_a_line_cannot_and_reruns_agree(spark):
    rows = ring(spark).persist()
    one, two = (nets.fit(rows, (12,), epochs=120, rate=0.05, seed=2) for _ in range(2))
    assert np.array_equal(one.net.flat(), two.net.flat()) and one.losses[-1] < 0.5 * one.losses[0] and one.rows == 400
    line = nets.fit(rows, (), epochs=120, rate=0.05)

    def right(net):
        scored = rows.select("targets", nets.scores(F.col("features"), net).alias("s"))
        return scored.agg(F.avg((F.round(F.col("s")[0]) == F.col("targets")[0]).cast("double"))).first()[0]

    assert right(one.net) > 0.93 > right(line.net) + 0.15


@pytest.mark.parametrize("extra, what", [(([1.0], [1, 0]), "other widths"), (([1.0, None], [1, 0]), "can't be used"), (([1.0, float("nan")], [1, 0]), "can't be used"), (([1.0, 2.0], [2, 0]), "can't be used")])
def test_fit_refuses_bad_rows_before_it_learns(spark, extra, what):
    rows = ring(spark, 30).unionByName(spark.createDataFrame([extra], "features array<double>, targets array<int>"))
    with pytest.raises(nets.NetError, match=what):
        nets.fit(rows, (3,), epochs=1)


def test_fit_refuses_one_class_and_nothing(spark):
    with pytest.raises(nets.NetError, match="one class"):
        nets.fit(ring(spark, 30).withColumn("targets", F.array(F.col("targets")[0], F.lit(1))), (3,), epochs=1)
    with pytest.raises(nets.NetError, match="no rows"):
        nets.fit(ring(spark, 30).where("false"), (3,))


LEXICON = [{"kind": "lexicon", "left": 5, "right": 3}]


def test_bundle_upsert_load_and_crash(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/b"
    net = nets.fresh([17, 4, 2], seed=1)
    bundles.upsert(spark, root, "one", net, LEXICON, ["a", "b"], {"a": 0.25})
    bundles.upsert(spark, root, "two", nets.fresh([17, 1]), LEXICON, ["c"])
    head = bundles.load(spark, root, "one")
    assert np.array_equal(head.net.flat(), net.flat()) and head.labels == ("a", "b") and head.thresholds == (0.25, 0.5)
    other = nets.fresh([17, 2], seed=9)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:  # between payload and manifest
        m.setattr(bundles, "swap", stop)
        with pytest.raises(RuntimeError):
            bundles.upsert(spark, root, "one", other, LEXICON, ["a", "b"])
    assert np.array_equal(bundles.load(spark, root, "one").net.flat(), net.flat())
    bundles.upsert(spark, root, "one", other, LEXICON, ["x", "y"])
    assert np.array_equal(bundles.load(spark, root, "one").net.flat(), other.flat()) and bundles.load(spark, root, "two").labels == ("c",)
    files = json.loads((tmp_path / "b/manifest.json").read_text())["files"]
    assert [f["role"] for f in files] == ["one", "two"] and sorted(p.name for p in (tmp_path / "b").glob("[a-z]*")) == sorted(["manifest.json", *(f["path"] for f in files)])


def test_bundles_that_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(ArtifactError, match="missing"):
        bundles.load(spark, root, "one")
    with pytest.raises(ArtifactError, match="17 features"):
        bundles.upsert(spark, root, "one", nets.fresh([16, 1]), LEXICON, ["a"])
    bundles.upsert(spark, root, "one", nets.fresh([17, 1]), LEXICON, ["a"])
    path = tmp_path / "manifest.json"
    good = json.loads(path.read_text())

    def refused(match, **change):
        path.write_text(json.dumps({**good, **change}))
        (tmp_path / ".manifest.json.crc").unlink(missing_ok=True)
        with pytest.raises(ArtifactError, match=match):
            bundles.load(spark, root, "one")

    file, head = good["files"][0], good["heads"]["one"]
    refused("unknown format", format="x")
    refused("at least one file", files=[])
    refused("twice", files=[file, file])
    refused("no payload", files=[{**file, "role": "two"}])
    refused("unsafe", files=[{**file, "path": "../x.json"}])
    refused("unsafe", files=[{**file, "path": "/etc/passwd"}])
    refused("missing", files=[{**file, "path": "gone.json"}])
    refused("isn't what", files=[{**file, "sha256": "0" * 64}])
    refused("isn't what", files=[{**file, "bytes": 1}])
    refused("feature_dim", heads={"one": {**head, "feature_dim": 18}})
    refused("inputs", heads={"one": {**head, "feature_dim": 0, "kernel": [{"kind": "ascii_class"}]}})
    refused("outputs", heads={"one": {**head, "labels": ["a", "b"]}})
    refused("labels", heads={"one": {**head, "labels": []}})


def legacy(spark, text, at, left=5, right=3):
    rows = X.context(docs(spark, text), "(?s).", around=X.LEXICON_FIELDS, reach=X.LEXICON_REACH).where(F.col("feature_pos") == at)
    return rows.select(X.lexicon_block(left, right).alias("f")).first().f


def test_lexicon_features(spark):
    row = legacy(spark, "Mr. Smith.", 2)
    assert len(row) == 17 and row == [-3, -3, -3, 13, 18, -1, -3, 19, 13, 1, 1, 1, 1, 0, 0, 0, 0]
    assert legacy(spark, "Mr. Smith.", 9)[9:] == [0, 1, 1, 1, 0, 0, 0, 0]
    flags = lambda text, at: legacy(spark, text, at)[9:]
    assert flags('He said "no', 8)[2] == 0 and flags('He said "no"', 11)[2] == 1 and flags("“a” b “c", 10)[2] == 0 and flags("“a” b", 4)[2] == 1  # quotes in pairs
    assert flags("don't", 3)[3] == 0 and flags("dogs' tails", 4)[3] == 1  # inside a word
    assert flags("a.b", 1)[4] == 1
    assert flags("(a) first", 1)[5] == 0 and flags("see (a) first", 4)[5] == 1 and flags("see (a) first", 7)[5] == 0 and flags("as follows: x", 12)[5] == 0 and flags("as follows: x", 11)[5] == 1 and flags("including: , x", 11)[5] == 1
    assert flags("pears, and plums", 5)[5] == 1 and flags("pears, plums", 5)[5] == 0
    assert flags("one; two; three", 3)[6] == 1 and flags("one; two", 3)[6] == 0 and flags("one; and two", 3)[6] == 1
    assert flags("to: it.", 6)[7] == 1 and flags("to: many words.", 14)[7] == 0
    assert legacy(spark, "ß. ", 2, 1, 1)[:3] == [ord("ß") - 96, -1, -3]


def test_lexicon_from_json():
    assert lexicon.Lexicon.from_json(lexicon.DEFAULT.to_json()) == lexicon.DEFAULT
    raw = json.loads(lexicon.DEFAULT.to_json())
    for change in ({"titles": ["Mr"]}, {"primary": 3}, {"list_intros": ["a", ""]}, {"more": "x"}):
        with pytest.raises(lexicon.LexiconError):
            lexicon.Lexicon.from_json(json.dumps({**raw, **change}))


def shape(spark, text, at, block, around=X.EVERYTHING):
    rows = X.line_context(docs(spark, text), around=around).where(F.col("feature_pos") == at)
    return rows.select(block.alias("f")).first().f


def test_boundary_shape_golden(spark):
    row = shape(spark, '"Done."\n\nNext.', 5, X.boundary_shape())
    assert {k for k, v in enumerate(row) if v} == {0, 1, 7, 14, 15}
    assert shape(spark, "a.>\n\nB", 1, X.boundary_shape())[14:16] == [1, 1]


@pytest.mark.parametrize("text, at, columns", [
    ("1.2", 1, {0: 1, 1: 1, 2: 1}), ("End is 1.", 8, {0: 0, 1: 1, 2: 0}), ("3!4", 1, {0: 0, 1: 0, 2: 0}), ("Mr. Jones", 2, {4: 0.125, 8: 1, 11: 1}), ("Sentence. Next", 8, {4: 0.5, 11: 0}),
    ("U.S. is", 3, {3: 0.25, 4: 0.125, 5: 1, 6: 1}), ("U.S. is", 1, {3: 0}), ("St. with", 2, {9: 1}), ("x. " + "b" * 30, 1, {7: 1}), ("End.\nNext", 3, {10: 1}), ("USA.", 3, {6: 1}), ("x.y-z.", 5, {3: 0, 4: 1 / 16, 5: 0}),
    ("4th.", 3, {4: 0.125, 5: 0, 11: 0}), ("v1.2.B3.", 7, {3: 0.5, 4: 0.125, 5: 0, 6: 0.5}),
])
def test_token_shape_golden(spark, text, at, columns):
    row = shape(spark, text, at, X.token_shape())
    assert {k: row[k] for k in columns} == columns


def test_class_counts_golden(spark):
    row = shape(spark, "AA. bb", 2, X.class_counts(["[A-Z]", "[a-z]"], 3, 3, True))
    assert row[0] > 0 and row[1:3] == [0, 0] and row[3] > 0


def test_best_of_clusters(spark):
    marks = lambda *m: [dict(zip(("break_end", "break_char", "resume", "score"), x, strict=True)) for x in m]
    cases = [
        (marks((1, 1, 2, 0.9), (3, 3, 3, 0.4), (5, 5, 6, 0.5)), [1, 5]),
        (marks((1, 1, 4, 0.6), (3, 3, 5, 0.8), (5, 5, 6, 0.8), (7, 7, 7, 0.7)), [3, 7]),  # one cluster through 5, the first best stays
        (marks((1, 1, 9, 0.6), (2, 2, 2, 0.9), (8, 8, 8, 0.95), (10, 10, 10, 0.6)), [8, 10]),
        ([], []), (None, None),
    ]
    table = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(cases)], f"k long, m array<{D.MARK}>")
    got = {r.k: r.b and [m.break_end for m in r.b] for r in table.select("k", D.best_of_clusters(F.col("m"), 0.5).alias("b")).collect()}
    assert got == {k: (e or e) if e is None or e else [] for k, (_, e) in enumerate(cases)}


def test_segmenter_of_the_package_bundle(spark):
    head = bundles.load(spark, f"file://{segmenter.DEFAULT_BUNDLE}", segmenter.SENTENCE_ROLE)
    table = spark.createDataFrame(CASES, "id string, text string, gold_marker string")
    found = segmenter.bundle_sentences(table.select(F.col("id").alias("doc_id"), "text"), head)
    ends = found.select(F.col("doc_id").alias("id"), F.explode("spans").alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    report = metrics.break_report(table, metrics.internal_breaks(ends), metrics.marker_breaks(table)).first()
    assert report.f1 >= 0.9, report
    held = generate.sentence_cases(spark, 300, seed=77)
    spans = {r.doc_id: [s.end for s in r.spans] for r in segmenter.bundle_sentences(held, head).collect()}
    gold = {r.doc_id: [e for e in r.ends if r.text[e - 1] in C.TERMINATORS] for r in held.collect()}
    hits = sum(len(set(spans[k]) & set(gold[k])) for k in gold)
    assert 2 * hits / sum(len(spans[k]) + len(gold[k]) for k in gold) > 0.97


def test_sentences_of_a_head(spark):
    head = bundles.load(spark, f"file://{segmenter.DEFAULT_BUNDLE}", segmenter.SENTENCE_ROLE)
    texts = ['  "It is done." She left.\n\nÜber uns.  (Yes.) No end', None, "", "no mark", "…"]
    got = {r.doc_id: r.spans for r in segmenter.bundle_sentences(docs(spark, *texts), head).collect()}
    assert [texts[0][s.start : s.end] for s in got[0]] == ['"It is done."', "She left.", "Über uns.", "(Yes.)"]
    assert all(texts[0].encode()[s.start_byte : s.end_byte].decode() == texts[0][s.start : s.end] for s in got[0])
    assert got[1] is None and got[2] == [] and got[3] == []
    with pytest.raises(kernels.SpecError):
        segmenter.scored_marks(docs(spark, "a."), bundles.Head("x", nets.fresh([6, 1]), kernels.compile_kernel([{"kind": "ascii_class"}]), ("a",), (0.5,)))
