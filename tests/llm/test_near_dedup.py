import random
import re

import numpy as np

from spanmill.llm import minhash, textscan
from spanmill.llm.components import components
from tests.llm.corpus import SCHEMA, documents


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_matches_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for width in (2, 5):
        got = sorted(tuple(r) for r in minhash.near_duplicates(docs, width=width).collect())
        assert got == brute(rows, width)
    assert any(not r[3] for r in got)


def test_group_below_the_threshold_and_a_chain(spark):
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(40):  # all pairs share much, neighbours are linked
        words = list(base)
        words[:d] = [f"x{k}" for k in range(d)]
        rows.append((d, " ".join(words)))
    for d in range(40, 80):  # each shares a passage with all, none is linked
        rows.append((d, " ".join(base[:40] + [f"y{d}_{k}" for k in range(25)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, width=2).collect())
    assert got == brute(rows, 2)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 200: 100, 150: 100}


def test_rows_that_share_an_id_and_odd_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [("e", text), ("c", text + " more"), ("c", other), ("d", other + " more"), (None, text), (None, None), ("f", None), ("g", "alone here"), ("c", other)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in minhash.near_duplicates(docs, width=2).collect()), key=str)
    assert got == sorted([("e", "c", False), ("c", "c", True), ("c", "c", True), ("d", "c", False), (None, None, True), (None, None, True), ("f", "f", True), ("g", "g", True), ("c", "c", True)], key=str)


def test_words_of_patterns_that_polynomials_modulo_powers_of_two_confuse(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, "x " + word), (5, "x " + word[:-1])]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == brute(rows, 2)


def test_products_and_powers_modulo_the_prime():
    rng = np.random.default_rng(1)
    p = (1 << 61) - 1
    a, b = (np.append(rng.integers(0, p, 500, dtype=np.uint64), [0, 1, p - 1, p - 2]).astype(np.uint64) for _ in range(2))
    assert textscan.times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    assert textscan._Powers(12345).upto(70).tolist() == [pow(12345, k, p) for k in range(70)]
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    hashed = textscan.RangeHasher(data)(np.arange(3990), np.arange(3990) + 10)
    raw = data.tobytes()
    same = {}
    for k, h in enumerate(hashed.tolist()):
        assert same.setdefault(h, raw[k : k + 10]) == raw[k : k + 10]
    assert len(same) == len({raw[k : k + 10] for k in range(3990)})


def test_rare_element_of_many_unlinked_sets(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for d in range(1, 500):  # each is linked with the first one only
        words = list(base)
        for k in rng.sample(range(5, 120), 8):
            words[k] = f"y{d}_{k}"
        rows.append((d, " ".join(words)))
    rows += [(d, "rare word " + " ".join(f"z{d}_{k}" for k in range(50))) for d in range(500, 1000)]  # one shingle in common, no links
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, width=2).collect())
    assert got == brute(rows, 2)


def test_prefix_pairs_hold_every_link_and_few_others(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)] + [" ".join(f"y{d}_{k}" if k in gone else w for k, w in enumerate(base)) for d in range(1, 300) for gone in [set(rng.sample(range(120), 11))]]
    sets = [shingles(t, 2) for t in texts]
    number = {e: k + 1 for k, e in enumerate(sorted(set().union(*sets)))}
    arrays = [textscan.mix(np.array(sorted(number[e] for e in s), np.uint64)) for s in sets]
    rows = [(k, k, len(a), a.view(np.int64).tolist()) for k, a in enumerate(arrays)]
    found = {tuple(r) for r in minhash.prefix_pairs(spark.createDataFrame(rows, "node long, component long, n long, elements array<long>"), 80).collect()}
    links = {(a, b) for a in range(300) for b in range(a + 1, 300) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links <= found and len(found) < len(links) + 1500  # of 44,850 pairs
