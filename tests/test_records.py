"""Numbered records against a sequential reader, on files that are cut in many splits."""

import json

import pytest

from spanmill.sources import records


def sequential(files, most=None):
    out, number = [], 0
    for path in sorted(files):
        lines = path.read_bytes().split(b"\n")
        for line in lines if lines[-1] else lines[:-1]:
            number += 1
            if most is None or number <= most:
                out.append((number, line.decode().removesuffix("\r")))
    return out


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("most", [None, 1, 7, 60, 10_000])
def test_numbers_equal_a_sequential_readers(spark, tmp_path, small_splits, most):
    files = [tmp_path / name for name in ("b.jsonl", "a.jsonl", "c.jsonl", "d.jsonl")]
    files[0].write_bytes(b"".join(b'{"text": "line %d %s"}\n' % (k, b"x" * (k % 90)) for k in range(60)))
    files[1].write_bytes(b"first\r\n\r\n\n" + "ü last without end".encode())
    files[2].write_bytes(b"")
    files[3].write_bytes(b"y" * 2000 + b"\n" + b"z\n" * 50)
    lines = records.numbered_lines(spark, [str(f) for f in files], most)
    assert spark.read.option("lineSep", "\n").text([str(f) for f in files]).rdd.getNumPartitions() > 8
    assert sorted((r.number, r.line) for r in lines.collect()) == sequential(files, most)


def test_outcomes_and_spans(spark, tmp_path):
    span = lambda *at, **more: {"label": "Sentence", "start": at[0], "end": at[1], **more}
    lines = [
        json.dumps({"text": "Éa. Bé.", "spans": [span(0, 0, char_start=0, char_end=3), span(5, 9, right_open=True), span(0, 3), span(1, 4), span(7, 40), {"label": "paragraph", "start": 0, "end": 3}]}),
        "", "   ", "{broken", json.dumps({"spans": []}), json.dumps({"text": "One.<|sentence|> Two.<|sentence|><|paragraph|>Three."}), json.dumps({"text": "Plain."}), json.dumps({"text": "A.<|sentence|>"}), "7",
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(lines) + "\n")
    found = records.read_records(spark, [str(path)])
    got = {r.number: (r.text, [(s.start, s.end, s.right_open) for s in r.spans], r.dropped) for r in found.records.collect()}
    assert got == {
        1: ("Éa. Bé.", [(0, 4, False), (5, 9, True), (0, 4, False), (2, 5, False)][:2] + [(0, 3, False), (2, 5, False)], 2),
        6: ("One. Two.Three.", [(0, 4, False), (4, 9, False), (9, 15, True)], 0), 7: ("Plain.", [], 0), 8: ("A.", [(0, 2, False)], 0),
    }
    assert {(r.number, r.outcome) for r in found.rejected.collect()} == {(2, "blank"), (3, "blank"), (4, "malformed"), (5, "no text"), (9, "malformed")}
    assert {(r.outcome, r.lines, r.spans, r.dropped) for r in found.counts.collect()} == {("record", 4, 8, 2), ("blank", 2, 0, 0), ("malformed", 2, 0, 0), ("no text", 1, 0, 0)}


def test_empty_input(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text("\n{x\n")
    assert records.read_records(spark, [str(path)]).records.collect() == []
    with pytest.raises(records.EmptyInput):
        records.read_records(spark, [str(path)], required=True)
