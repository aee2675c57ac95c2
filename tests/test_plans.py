import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators import candidates as C
from spanmill.operators import features as X
from spanmill.operators import spans as R
from spanmill.plans.pipeline import Pipeline, PipelineError
from spanmill.sources import artifacts, generate


def test_pipeline_fits_and_runs(spark):
    made = generate.generate(spark, 300, 3)
    gold = made.select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", F.col("s.end").alias("break_end"))
    p = Pipeline().with_block("neighbours", X.ascii_neighbours).with_block("token", X.token_shape)
    with pytest.raises(PipelineError):
        p.run(made)
    fitted = p.fit(made, gold)
    ends = fitted.run(made).select("doc_id", F.col("end").alias("break_end"))
    hit = ends.join(gold, ["doc_id", "break_end"], "left_semi").count()
    assert hit / ends.count() > 0.85 and hit / gold.count() > 0.9
    again = artifacts.model_from_json(artifacts.model_to_json(list(fitted.weights), fitted.bias, [("neighbours", 6), ("token", 12)]))
    assert again == (list(fitted.weights), fitted.bias, [("neighbours", 6), ("token", 12)])
    with pytest.raises(artifacts.ArtifactError):
        artifacts.model_to_json([1.0], 0.0, [("a", 2)])


def test_generated_texts_depend_on_the_seed_alone(spark):
    a = generate.generate(spark, 50, 1).orderBy("doc_id").collect()
    assert a == generate.generate(spark, 50, 1).repartition(7).orderBy("doc_id").collect()
    assert a != generate.generate(spark, 50, 2).orderBy("doc_id").collect()
    assert all(r.text[s.start : s.end][-1] in ".!?" for r in a for s in r.spans)


def test_bundles(spark, tmp_path):
    good = b"weights"
    for name, files in {
        "a": [{"path": "m.json", "role": "model", "bytes": 7, "sha256": hashlib.sha256(good).hexdigest()}],
        "b": [{"path": "m.json", "role": "model", "bytes": 7, "sha256": "0" * 64}, {"path": "../x", "role": "model", "bytes": 1, "sha256": ""}, {"path": "none", "role": "model", "bytes": 1, "sha256": ""}],
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.json").write_bytes(good)
        (tmp_path / name / "manifest.json").write_text(json.dumps({"format": "1", "name": name, "files": files}))
    got = {(r.bundle, r.path): r.problem for r in artifacts.check_bundles(spark, str(tmp_path)).collect()}
    assert got == {("a", "m.json"): None, ("b", "m.json"): "sha256", ("b", "../x"): "unsafe path", ("b", "none"): "missing"}


def test_parse_tagged(spark):
    rows = [(1, "<|paragraph|><|sentence|>Oné.</|sentence|> x<|/paragraph|>"), (2, "<|sentence|>a"), (3, "<|odd|>a</|odd|>"), (4, "a</|sentence|>"), (5, "plain"), (6, None)]
    got = {r.doc_id: r for r in R.parse_tagged(spark.createDataFrame(rows, "doc_id long, tagged string")).collect()}
    assert got[1].text == "Oné. x" and [tuple(s) for s in got[1].spans] == [("sentence", 0, 4), ("paragraph", 0, 6)] and got[1].error is None
    assert got[2].error == "a tag is left open" and got[3].error == "unknown label odd" and got[4].error == "unexpected end of sentence"
    assert got[5].text == "plain" and got[5].error is None


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "aa\nbbb\ncccccccccc\nd"), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in C.chunks(docs, 7).orderBy("chunk").collect()] == [(1, 0, 0, "aa\nbbb\n"), (1, 1, 7, "ccccccc"), (1, 2, 14, "ccc\nd")]
