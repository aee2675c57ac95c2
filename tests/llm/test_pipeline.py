
import corpus_pipeline
from spanmill.llm import lang_id, mixing, pii
from tests.llm.corpus import documents
from tests.llm.test_near_dedup import brute
from tests.llm.test_text_scans import benchmark, brute_hits


def test_stages_against_brute_force(spark, tmp_path):
    items, table = benchmark(spark)
    table.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    profiles = lang_id.fit(docs.where(~lang_id.held_out("doc_id")))
    kept = {r.id for r in lang_id.identify(docs, profiles).collect() if r.lang_pred != "und" and r.score >= 0.02}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    roots = {i for i, _, _, root in brute([r[:2] for r in rows], 5) if root}
    rows = [r for r in rows if r[0] in roots]
    bad = {i for i, n, h, _ in brute_hits([r[:2] for r in rows], items) if h and 20 * h >= n}
    rows = [r for r in rows if r[0] not in bad]
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clean = pii.sanitise(left)
    copies = {r.id: r.copies for r in mixing.plan_mix(clean).collect()}
    expected = sorted((r.doc_id, r.text, r.source) for r in clean.collect() for _ in range(copies[r.doc_id]))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == expected
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(roots) < len(kept) and bad


def test_near_dedup_judges_rows_by_their_own_text(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (None, b, "x"), (None, a + " c", "x"), (None, "lone text", "x"), (7, None, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    # of the copies of a one row stays, of those of b one; a null id comes behind others
    assert got == sorted([(3, a, "x"), (5, b, "x"), (None, "lone text", "x"), (7, None, "x"), (7, None, "x")], key=str)
