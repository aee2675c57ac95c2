"""Packed positions and the heads fitted on them against the rows of features and Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import models, packed
from spanmill.operators import positions as P
from spanmill.plans import catalogue
from tests.test_positions import LABELS, TEXTS, table

SF = "/root/testdata/sf0.001"
TARGETS = ["start:s", "end:t", "left_open:t", "inside:s"]


def unpacked(blocks) -> list[tuple]:
    profiles, out = packed.alphabet()[1], []
    for b in packed._read([packed._batch([r.block], [None]) for r in blocks.collect()]):
        classes = b.classes(len(profiles))
        for k in range(b.n):
            near = [profiles[c][:2] for c in classes[:, k]]
            out.append((tuple(np.round(b.numbers[:, k], 9)), tuple(x for pair in near for x in pair), int(b.bits[k])))
    return sorted(out)


def settled(docs, inside, negative):
    found = packed.positions(docs, LABELS, TARGETS, inside, negative).persist()
    return found.where("drawn is null").select("block").unionByName(packed.settle(found, LABELS, inside, negative))


@pytest.mark.parametrize("inside, negative", [(5, 3), (-1, -1), (0, 0), (40, 1), (-1, 2)])
def test_positions_are_those_of_the_rows_of_features(spark, monkeypatch, inside, negative):
    monkeypatch.setattr(packed, "SLICE", 60)
    monkeypatch.setattr(packed, "BLOCK", 64)
    docs, _ = table(spark)
    expected = []
    for r in P.position_rows(docs, LABELS, inside, negative).collect():
        expected.append((tuple(np.round([r[c] for c in packed.NUMBERS[1:]], 9)), tuple(r[c] for c in P.CATEGORICAL), sum(r[t] << k for k, t in enumerate(TARGETS))))
    assert unpacked(settled(docs, inside, negative)) == sorted(expected)


def test_classes_say_what_a_character_is():
    import zlib

    packs, profiles = packed.alphabet()
    codes = zlib.decompress(packs)
    assert len(profiles) ** 2 < 1 << 16
    for ch in "aZ9²½ \t\n\r é中“'́€\U0001f600\U0010ffff\x00_":
        profile = profiles[codes[ord(ch)]]
        assert profile[0] == P.bucket(ch) and profile[2:] == tuple(bool(test(ch)) for test in P.TESTS.values())


def test_heads_are_those_of_spark_ml(spark):
    """Few slots, so that features share them."""
    docs = spark.createDataFrame([(k, f"Item {k} is here. So is {TEXTS[k % 5] or ''}{k * 7}!\n", [("s", 0, 14 + len(str(k)), False, False), ("t", 3, 9 + k % 3, False, False)]) for k in range(60)], f"doc_id long, text string, spans {P.SPANS}")
    wanted = ["end:s", "start:t", "left_open:s"]
    expected = models.fit_heads(P.hashed(P.position_rows(docs, LABELS, 200, 200), 128).persist(), wanted)
    got = packed.train(docs, LABELS, wanted, 200, 200, 128)
    assert got["left_open:s"] == expected["left_open:s"] == ([0.0] * 128, -20.0)
    for target in wanted:
        assert got[target][0] == pytest.approx(expected[target][0], abs=1e-6) and got[target][1] == pytest.approx(expected[target][1], abs=1e-6)
    assert packed.train(docs.where("false"), LABELS, ["end:s"], 200, 200, 128) == {"end:s": ([], -20.0)}


def test_a_position_of_the_query_is_no_row(spark, monkeypatch):
    """Sparse vectors of 6 GB's positions took some hundred GB, read again in each of a hundred passes; heads share passes now, and texts are read once."""
    passes, seen = [], []
    sums, fit = packed._sums, packed.fit_heads
    monkeypatch.setattr(packed, "_sums", lambda blocks, scan: passes.append(1) or sums(blocks, scan))
    monkeypatch.setattr(packed, "fit_heads", lambda blocks, *a: seen.append(blocks.select(F.count("*"), F.sum(F.length("block"))).first()) or fit(blocks, *a))
    monkeypatch.setattr(P, "reservoir_cuts", None)
    rows = catalogue.queries()["train_position_heads"](spark, SF).collect()
    assert [(r.head, r.width) for r in rows] == [("start:sentence", 4096), ("end:sentence", 4096)] and all(r.used for r in rows)
    assert seen[0][0] < 100 and seen[0][1] < 40 * 20_000 and len(passes) < 80
