"""A leaderboard from specification files on generated records."""

import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators.candidates import TERMINATOR_PATTERN
from spanmill.operators.kernels import SpecError
from spanmill.plans import experiments
from spanmill.sources import generate


def write_cases(spark, path, count, seed):
    with path.open("w") as f:
        for r in generate.sentence_cases(spark, count, seed=seed).collect():
            starts = [0, *r.ends[:-1]]
            f.write(json.dumps({"text": r.text, "spans": [{"label": "sentence", "start": 0, "end": 0, "char_start": a, "char_end": e} for a, e in zip(starts, r.ends, strict=True)]}) + "\n")


def test_leaderboard_from_files(spark, tmp_path):
    write_cases(spark, tmp_path / "train.jsonl", 250, 5)
    write_cases(spark, tmp_path / "eval.jsonl", 60, 6)
    base = {"training_path": str(tmp_path / "train.jsonl"), "evaluation_paths": [str(tmp_path / "eval.jsonl")], "pattern": TERMINATOR_PATTERN}
    specs = {
        "good": base | {"features": [{"kind": "terminators"}], "model": {"kind": "logistic"}},
        "net": base | {"features": [{"kind": "terminators"}], "model": {"kind": "net", "hidden": [6], "epochs": 40, "rate": 0.1}},
        "poor": base | {"features": [{"kind": "ascii_class"}], "model": {"kind": "logistic"}, "training_limit": 100},
    }
    paths = []
    for name, spec in specs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, **spec}))
        paths.append(str(tmp_path / f"{name}.json"))
    board = {r.experiment: r for r in experiments.run(spark, paths).collect()}
    assert board["poor"]["rank"] == 3 and min(board["good"].evaluation_f1, board["net"].evaluation_f1) > 0.93 > board["poor"].evaluation_f1
    found = experiments.read(spark, paths)
    assert found[0].extraction == found[1].extraction != found[2].extraction
    one = experiments.scores(spark, found[:1]).where(F.col("part") == "validation").agg(F.count("*"), F.sum("label")).first()
    assert one[0] > one[1] > 40


@pytest.mark.parametrize("change, what", [({"model": {"kind": "forest"}}, "unknown model"), ({"features": [{"kind": "none"}]}, "unknown component"), ({"split_numerator": 5}, "split"), ({"more": 1}, "can't be read"), ({"name": None, "training_path": None, "model": {}}, "unknown model")])
def test_specifications_that_are_refused(change, what):
    good = {"name": "x", "training_path": "p", "features": [{"kind": "terminators"}], "model": {"kind": "logistic"}}
    with pytest.raises(SpecError, match=what):
        experiments.parse(json.dumps(good | change))
    with pytest.raises(SpecError, match="can't be read"):
        experiments.parse("{")
