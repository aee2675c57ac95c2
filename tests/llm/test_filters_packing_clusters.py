"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanmill.llm import centroids, interaction, packing
from tests.llm.corpus import SCHEMA, documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int, lang string, id long"


def fails(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": not first,
    }


def brute_audit(rows, good, toxic):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = [(i, part or "", fails(text or "", i is None or least[text or ""] >= i)) for i, text, part in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [d for d in docs if d[1] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[2][f]]
                left = [d for d in left if not d[2][f]]
                failing = [d for d in own if d[2][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(d[2].values()) == 1 for d in failing), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), 0,
                ]
        for f in "ABCDE":
            keys = [(part, "".join(o), o.index(f) + 1) for o in itertools.permutations("ABCDE")]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k][6] = total
    return out


def audited(found):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}


def test_swaps_of_neighbours_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in interaction.neighbour_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_audit_against_brute_force(spark):
    docs = documents(spark)
    long = "#" + " ".join(f"UP{k} down" for k in range(3000))
    extra = [(None, "repeated # text", "en"), (None, None, None), (900, "repeated # text", "en"), (901, "repeated # text", ""), (902, long, "fr"), (903, long, "fr"), (903, long, "fr")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rng = random.Random(5)
    judged = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "x", 1) for i in range(0, 70, 2)] + [(2, 1, 0, "x", 1), (2, 0, 0, "x", 1), (None, 1, 1, "x", 1), (903, 1, 1, "x", 1)]
    good, toxic = {r[0] for r in judged if r[0] is not None and r[1] == 1}, {r[0] for r in judged if r[0] is not None and r[2] == 1}
    got = audited(interaction.audit(docs, spark.createDataFrame(judged, LABELS)))
    assert got == brute_audit(rows, good, toxic) and len({k[0] for k in got}) == 4


def test_audit_of_other_filters_and_of_nothing(spark):
    labels = spark.createDataFrame([], LABELS)
    assert interaction.audit(spark.createDataFrame([], SCHEMA), labels).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, "b c"), (3, None)], "doc_id long, text string").selectExpr("*", "'p' AS lang")
    two = lambda text: {"x": text == "a", "y": text.rlike("^[ab]")}
    got = {k: v[:4] for k, v in audited(interaction.audit(docs, labels, two, repeated=None)).items()}
    assert got == {("p", "xy", 1): [2, 1, 0, 0], ("p", "xy", 2): [1, 1, 1, 1], ("p", "yx", 1): [1, 2, 0, 1], ("p", "yx", 2): [1, 0, 1, 0]}
    with pytest.raises(ValueError):
        interaction.audit(docs, labels, lambda text: {str(k): text == "a" for k in range(9)})


ODD = ["\xa0\n  bar foo\xa0 \n x", "foo\x1c\x1d bar \x85   baz　 \t\r\n", "a<|endoftext|>b  <|endoftext|> \n c", "  leading", "trailing  ", "don't we'll  'S", "​ ﻿ x ᠎ y", "数字 和 汉字" * 50, "x" * 3000, " " * 5000 + "a", "\n\n\n a \n\n"]


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_gives_the_whole_texts_ids():
    spaces = [f"ab{chr(c)}{d} cd {chr(c)}\n{chr(c)} ef" for c in [*range(0, 33), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF] for d in ("", " ", "\n", "x")]
    texts = [*ODD, *spaces, "", None, " ", "one", "one two", "one two", "one  two"]
    encoder = packing.Encoder(TOKENIZER)
    assert encoder.ranks is not None
    assert [x.tolist() for x in encoder.encode(texts)] == whole_ids(texts)
    assert [x.tolist() for t in texts for x in encoder.encode([t])] == whole_ids(texts)
    assert list(encoder.encode([])) == []


def test_encoder_on_random_texts_and_by_the_tokenizer_alone():
    rng = random.Random(7)
    letters = "abcdeXYZ019 ,.'\"!?-_äéßñ¿¡«»…–“”œŠ$%\t\n  数😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    encoder = packing.Encoder(TOKENIZER)
    assert [x.tolist() for x in encoder.encode(texts)] == whole_ids(texts)
    encoder.ranks = None
    assert [x.tolist() for x in encoder.encode(texts[:200])] == whole_ids(texts[:200])


def test_steps_through_long_texts(monkeypatch):
    monkeypatch.setattr(packing, "STEP_CHARS", 7)
    assert [x.tolist() for x in packing.Encoder(TOKENIZER).encode([*ODD, None, *ODD])] == whole_ids([*ODD, None, *ODD])
    assert "".join(packing.segments(ODD[9])) == ODD[9]


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check_packing(found, rows, capacity):
    whole = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        at, size, k = 0, first, 0
        while at < len(ids):
            expected[i, k, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
            at, size, k = at + size, capacity, k + 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r.length for r in found]
    assert -(-sum(lengths) // capacity) <= len(sequences) <= best_fit_decreasing(lengths, capacity)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, capacity):
    docs = documents(spark).select("doc_id", "text", "id", "n").repartition(3, "doc_id")
    extra = [(None, t, 1, 2) for t in ODD] + [(5, None, 1, 2)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(packing.pack(docs, TOKENIZER, capacity).collect(), rows, capacity)


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), TOKENIZER).collect() == []


@pytest.mark.parametrize("low, high", [(1, 2048), (500, 1400), (620, 760), (350, 900), (2048, 2049), (1, 2), (1025, 2048)])
def test_plans_fit_and_best_fit_does_no_better(low, high):
    rng = np.random.default_rng(low)
    lengths = rng.integers(low, high, 700)
    counts = np.bincount(lengths, minlength=2049)
    found = packing.best_plan(counts)
    used, placed = Counter(), Counter()
    runs = sorted(found.runs)
    for (length, rank, per, first, offset), after in zip(runs, [*runs[1:], None], strict=True):
        end = after[1] if after and after[0] == length else int(counts[length])
        assert (end - rank) % per == 0
        placed[length] += end - rank
        for k in range((end - rank) // per):
            assert used[first + k, offset] == 0
            used[first + k, offset] = per * length
    assert placed == Counter(lengths.tolist())
    full = Counter()
    for (sequence, offset), size in sorted(used.items()):
        assert full[sequence] == offset
        full[sequence] += size
    assert max(full.values()) <= 2048 and len(full) == found.sequences <= best_fit_decreasing(lengths.tolist(), 2048)


def test_mid_lengths_need_fewer_sequences_than_best_fit():
    lengths = np.random.default_rng(1).integers(620, 760, 3000)
    assert packing.best_plan(np.bincount(lengths, minlength=2049)).sequences < 0.93 * best_fit_decreasing(lengths.tolist(), 2048)


def brute_clusters(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in ordered[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(at)), key=lambda c: (square(v, at[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, nearest(v), square(v, at[nearest(v)])) for i, v in kept]
    total = Counter()
    for _, c, d in out:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), at[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("kind, rounds", [("float", 10), ("double", 3)])
def test_clusters_against_brute_force(spark, kind, rounds):
    rng = random.Random(9)
    spots = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [round(x + rng.gauss(0, 0.3), 2) for x in rng.choice(spots)]) for i in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 480)] + [(7, rows[3][1]), (7, rows[4][1]), (None, [0.0] * 4), (None, None), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 1.0, 1.0]), (504, [1.0, math.nan, 1.0, 1.0]), (505, [math.inf, 0.0, 0.0, 0.0]), (506, [0.5, 0.5, -0.5, 1000.0])]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v int, id string").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = centroids.cluster(table, size=4, rounds=rounds, scale=16)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_clusters(rows, 8, rounds, 4, 16)


def test_clusters_of_few_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).collect() == []
    three = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0]), (2, [5.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in centroids.cluster(three, size=2, scale=1).collect()), key=str)
    assert got == brute_clusters([(1, [0.0, 1.0]), (2, [5.0, 1.0]), (2, [5.0, 1.0])], 8, 10, 2, 1)
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([(1, [1e9, -1e30])], "vec_id long, embedding array<double>"), size=2)


def test_bounds_spare_most_scans():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-40, 40, (500, 8)) + 1000 * k for k in range(3)])
    at = np.array([[1000 * k + 3] * 8 for k in range(3)])
    zero = np.zeros(3)
    own, upper, lower = centroids.reassign(x, np.full(1500, -1), np.zeros(1500), np.zeros(1500), at, zero, zero, centroids.half_gaps(at.tolist()))
    moved = at - 3
    d, o = centroids.drifts(at.tolist(), moved.tolist())
    again, upper2, _ = centroids.reassign(x, own, upper, lower, moved, d, o, centroids.half_gaps(moved.tolist()))
    assert (again == own).all() and (upper2 > upper).all()  # all were safe: no distance was computed


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op13_hamerly_clusters"])
def test_queries_and_their_sql(spark, name):
    from pathlib import Path

    import duckdb

    from spanmill.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    with duckdb.connect() as con:
        for f in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        columns = sorted(got.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(expected)
