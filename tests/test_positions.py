"""Label reservoirs and features of positions against straightforward versions."""

import math
import unicodedata

import numpy as np
import pytest

from spanmill.operators import models
from spanmill.operators import positions as P

TEXTS = ["One two.\nThree, four!", "", None, "x", "Ünï 1²3 “q” — ok\r\n\tend\n\n", "a" * 500, "naïve 😀 test. Yes."]
LABELS = ["s", "t"]


def table(spark):
    rows = []
    for k, text in enumerate(TEXTS):
        n = len(text or "")
        spans = [("s", 0, n // 2, False, False), ("t", n // 3, n, True, k % 2 == 0), ("s", n // 2, n, None, True), ("other", 0, n, False, False), ("s", -1, 3, False, False), ("t", 2, n + 5, False, False), ("t", 1, 1, False, False)]
        rows.append((k, text, spans if k != 3 else None, 5))
    rows += [(None, "no id", [], 5), (5, "shares an id", [("s", 1, 4, False, False)], 5)]
    return spark.createDataFrame(rows, f"doc_id long, text string, spans {P.SPANS}, position int").repartition(3), [(i, t, s) for i, t, s, _ in rows if i is not None and t]


def brute(rows, inside, negative):
    pools = {P.BOUNDARY: [], "s": [], "t": [], P.NEGATIVE: []}
    for doc, text, spans in rows:
        n = len(text)
        good = [s for s in spans or [] if s[0] in LABELS and s[1] >= 0 and s[2] <= n and s[1] < s[2]]
        for p in range(n):
            edge = any((p == a and not lo) or (p == e - 1 and not ro) or (lo and a == 0 and p == 0) or (ro and e == n and p == n - 1) for _, a, e, lo, ro in good)
            within = {label for label, a, e, *_ in good if a <= p < e}
            for pool in [P.BOUNDARY] if edge else within or [P.NEGATIVE]:
                pools[pool].append((int(P.keys(doc, np.array([p]), 0)[0]), doc, p))
    caps = {P.BOUNDARY: -1, "s": inside, "t": inside, P.NEGATIVE: negative}
    taken = []
    for pool, found in pools.items():
        found = sorted(found)
        if caps[pool] >= 0 and found[caps[pool] :]:
            last = found[caps[pool] - 1] if caps[pool] else (-1, -1, -1)
            found = [f for f in found if f <= last]
        taken += [(doc, p, pool) for _, doc, p in found]
    return sorted(taken)


@pytest.mark.parametrize("inside, negative", [(5, 3), (-1, -1), (0, 0), (40, 1), (10_000, 2)])
def test_reservoirs(spark, inside, negative):
    docs, rows = table(spark)
    got = sorted(map(tuple, P.select_positions(docs, LABELS, inside, negative).collect()))
    assert got == brute(rows, inside, negative)
    assert got == sorted(map(tuple, P.select_positions(docs.repartition(7), LABELS, inside, negative).collect()))


def plain_features(text, p):
    ch, n = text[p], len(text)
    cat = unicodedata.category
    near = lambda o: text[p + o] if 0 <= p + o < n else ""
    out = {"bias": 1, "ch": P.bucket(ch), "cat": cat(ch), "is_alpha": ch.isalpha(), "is_upper": ch.isupper(), "is_lower": ch.islower(), "is_digit": ch.isdigit(), "is_space": ch.isspace(), "is_newline": ch in "\r\n", "is_punct": cat(ch)[0] == "P"}
    out |= {"pos_frac": p / max(1, n - 1), "from_start_log": math.log1p(p), "to_end_log": math.log1p(n - 1 - p)}
    for o in P.NEIGHBOURS:
        x = near(o)
        out |= {f"n{o:+d}_ch": P.bucket(x), f"n{o:+d}_cat": cat(x) if x else "NONE", f"n{o:+d}_space": x.isspace() if x else 1, f"n{o:+d}_newline": x in "\r\n" if x else 1}
    for r in P.RADII:
        w = text[max(0, p - r) : p + r + 1]
        counts = {"alpha": sum(map(str.isalpha, w)), "digit": sum(map(str.isdigit, w)), "space": sum(map(str.isspace, w)), "newline": sum(c in "\r\n" for c in w), "upper": sum(map(str.isupper, w)), "punct": sum(cat(c)[0] == "P" for c in w), "quote": sum(c in P.QUOTES for c in w)}
        out |= {f"r{r}_{k}_rate": v / len(w) for k, v in counts.items()}
    a, e = text.rfind("\n", 0, p) + 1, text.find("\n", p)
    e = n if e < 0 else e
    return out | {"line_pos_frac": (p - a) / max(1, e - a - 1), "line_from_start_log": math.log1p(p - a), "line_to_end_log": math.log1p(e - p)}


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_features_of_positions(text):
    numeric, categorical = P.position_features(text, np.arange(len(text)))
    assert tuple(numeric) == P.NUMERIC and set(categorical) == set(P.CATEGORICAL)
    for p in range(len(text)):
        expected = plain_features(text, p)
        assert {k: v[p] for k, v in categorical.items()} == {k: expected[k] for k in P.CATEGORICAL}
        assert all(numeric[k][p] == pytest.approx(float(expected[k])) for k in P.NUMERIC)


def test_heads_fit_on_sparse_vectors(spark):
    docs = spark.createDataFrame([(k, f"Item {k} is here. So is {k * 7}!", [("s", 0, 14 + len(str(k)), False, False)]) for k in range(40)], f"doc_id long, text string, spans {P.SPANS}")
    rows = P.hashed(P.position_rows(docs, ["s"], 200, 200), 1 << 10).persist()
    assert rows.where("`end:s` = 1").count() == 40 and rows.where("`start:s` = 1").count() == 40
    heads = models.fit_heads(rows, ["end:s", "left_open:s"])
    weights, bias = heads["end:s"]
    scored = [(r["end:s"], r.features.dot(weights) + bias) for r in rows.collect()]
    assert len(weights) == 1 << 10 and min(z for y, z in scored if y) > max(z for y, z in scored if not y) and heads["left_open:s"][1] == -20
