"""Decontamination, secrets, personal data, mixing, language identification."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanmill.llm import common, decontam, lang_id, mixing, pii, secrets
from tests.llm.corpus import SCHEMA, documents, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def normal_words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = [(str(i), tuple(w[k : k + min(13, len(w))])) for i, t in items if (w := normal_words(t)) for k in range(max(1, len(w) - 12))]
    out = []
    for i, t in rows:
        words, hit, names = normal_words(t), set(), set()
        for name, win in windows:
            for k in range(len(words) - len(win) + 1):
                if tuple(words[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        out.append((i, len(words), len(hit), sorted(names)))
    return sorted(out)


def benchmark(spark):
    source = [t for t in texts() if t]
    items = [(9, source[1][30:300]), (10, source[1][30:300]), (2, "Maple1 the2"), (3, None), (4, ""), (5, "..."), (6, "ONE"), (11, source[6][:400]), (12, "not there at all")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_broadcast_and_join_match_brute_force(spark):
    docs = documents(spark)
    items, table = benchmark(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_hits(rows, items)
    assert sum(r[2] > 0 for r in expected) > 3
    for limit in (decontam.BROADCAST_BYTES, 0):
        found = decontam.scan(docs, table, broadcast_bytes=limit).collect()
        assert sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in found) == expected
        spans = {(r.id, tuple(map(tuple, r.spans))) for r in found}
        kept = decontam.drop_contaminated(docs, table, broadcast_bytes=limit)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, h, _ in expected if not (h and 20 * h >= n))
        assert kept.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    for i, ranges in spans:
        for a, b in ranges:
            assert text[i].encode()[a:b].decode()


def test_decontamination_judges_rows_by_their_own_text(spark):
    passage = " ".join(f"q{k}" for k in range(20))
    rows = [(1, "clean text"), (1, passage), (None, passage), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([("i", passage)], "item_id string, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):
        kept = decontam.drop_contaminated(docs, table, broadcast_bytes=limit).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, "clean text"), (None, "clean too"), (2, None)], key=str)
        hits = decontam.scan(docs, table, broadcast_bytes=limit).collect()
        assert sorted((str(r.id), r.n_words, r.n_hit) for r in hits) == sorted([("1", 2, 0), ("1", 20, 20), ("None", 20, 20), ("None", 2, 0), ("2", 0, 0)])


def test_decontamination_empty_tables(spark):
    items, table = benchmark(spark)
    assert decontam.scan(spark.createDataFrame([], SCHEMA), table).collect() == []
    none = decontam.scan(documents(spark), table.limit(0)).collect()
    assert all(r.n_hit == 0 and r["items"] == [] for r in none)


RULES = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 20),
    ("hex", re.compile("([0-9a-f]+)"), 1, 24),
]


def test_secrets_match_brute_force_and_ledger_skips_known_blobs(spark):
    docs = documents(spark)
    findings, ledger = secrets.scan(docs)
    got = sorted((r.id, secrets_of(r.spans)) for r in findings.collect())
    expected = []
    for r in docs.collect():
        spans = [(m.start(), k, kind, m.end()) for k, (kind, rule, group, least) in enumerate(RULES) for m in rule.finditer(r.text or "") if len(m[group]) >= least]
        expected.append((r.doc_id, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))))
    assert got == sorted(expected) and any(x for _, x in got)
    assert ledger.count() == len({r.text or "" for r in docs.collect()})
    marked = ledger.withColumn("spans", F.expr("array()").cast(ledger.schema["spans"].dataType))
    again, after = secrets.scan(docs, ledger=marked)
    assert not any(r.spans for r in again.collect()) and after.count() == ledger.count()
    newer, _ = secrets.scan(docs, ledger=marked, version="2")
    assert sorted((r.id, secrets_of(r.spans)) for r in newer.collect()) == got
    assert secrets.scan(spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_secrets_of_versions_under_one_id(spark, monkeypatch):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefghij x"), (None, "token=abcdefgh"), (None, "password: hunter22"), (None, None), (2, "token=abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (secrets.BROADCAST_ROWS, -1):
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", limit)
        findings, ledger = secrets.scan(docs)
        assert sorted((str(r.id), secrets_of(r.spans)) for r in findings.collect()) == sorted([("1", "assign:0:14"), ("1", "assign:0:16"), ("None", "assign:0:14"), ("None", "assign:0:18"), ("None", ""), ("2", "assign:0:14")])
        assert ledger.count() == 4


def secrets_of(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s["rank"] < 3)


def test_more_secret_rules(spark):
    text = "k -----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY----- x"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert [(s.kind, s.start) for s in row.spans] == [("pem", 2)]


def test_personal_data_by_hand():
    assert pii.find_personal("a@b.c, +1 (469) 555-8958") == [("email", 0, 5), ("phone", 7, 24)]
    assert pii.find_personal("10.0.0.255 300.1.1.1 1.2.3.4.5") == [("ip", 0, 10), ("ip", 21, 28)]
    assert pii.find_personal("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.find_personal("4111 1111 1111 1112") == []
    assert pii.find_personal("0000255.1.1.1") == [("ip", 0, 13)]


def test_disclosing_terms(spark):
    rows = [(k, f"zorblatt common{k % 2} word met ann@mail.org near Quux again {k}") for k in range(4)]
    rows += [(10 + k, f"word again near common{k % 2} {k}") for k in range(20)] + [(40, None), (41, ""), (42, "zorblatt alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in pii.find_spans(docs).collect()}
    terms = lambda i: {rows[i][1][s.start : s.end] for s in found[i].spans if s.kind == "term"}
    assert terms(0) == {"zorblatt", "met", "Quux"}  # zorblatt: 4 of 5 documents; word, near, again: 4 of 24
    assert len(found) == len(rows) and not found[40].spans and not found[41].spans
    assert [tuple(s) for s in found[42].spans] == [("term", 0, 8)]  # gives the entity away where it stands alone
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "[TERM] common0 word [TERM] [EMAIL] near [TERM] again 0" and clean[10] == rows[4][1] and clean[40] is None


def test_disclosing_terms_by_join(spark, monkeypatch):
    rows = [(k, f"zorblatt common{k % 2} met ann@mail.org Quux {k}") for k in range(4)] + [(10 + k, f"common{k % 2} {k}") for k in range(20)] + [(None, "zorblatt alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for limit in (pii.BROADCAST_TERMS, -1):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
        spans = sorted(((r.id, sorted(map(tuple, r.spans))) for r in pii.find_spans(docs).collect()), key=str)
        results.append((spans, sorted(((r.doc_id, r.text) for r in pii.sanitise(docs).collect()), key=str)))
    assert results[0] == results[1] and (None, "[TERM] alone") in results[0][1]


def test_disclosing_terms_far_from_their_entity(spark):
    gap = " ".join(f"filler{j}" for j in range(30))
    rows = [(k, f"Zorblatt {gap} own{k} ann@mail.org own{k} {gap} zorblatt 4111 1111 1111 1111 own{k} quux" if k else f"ann@mail.org {gap} ZORBLATT") for k in range(4)]
    rows += [(10 + k, f"{gap} nothing{k} to quux") for k in range(9)] + [(30, "zorblatt here"), (31, "bob@mail.org zorblatt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find_spans(docs).collect()}
    assert {i: [t[a:b] for a, b in found[i]] for i, t in rows if found[i]} == {30: ["zorblatt"], 31: ["zorblatt"], 0: ["ZORBLATT"], 1: ["Zorblatt", "zorblatt"], 2: ["Zorblatt", "zorblatt"], 3: ["Zorblatt", "zorblatt"]}
    assert "zorblatt" not in " ".join(r.text for r in pii.sanitise(docs).where("doc_id < 4").collect()).lower()


def test_personal_data_of_a_corpus(spark):
    docs = documents(spark)
    got = sorted((r.id, [tuple(s) for s in r.base]) for r in pii.find_spans(docs).collect())
    assert got == sorted((r.doc_id, pii.find_personal(r.text or "")) for r in docs.collect())
    assert sorted(r.doc_id for r in pii.sanitise(docs).collect()) == sorted(r.doc_id for r in docs.collect())
    assert pii.find_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    docs = documents(spark)
    plan = mixing.plan_mix(docs).collect()
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + size(r.text)
    target = water_fill(totals)
    source = {r.doc_id: r.source for r in rows}
    for r in plan:
        assert abs(r.target - target[source[r.id]]) < 1e-6 and r.source_size == totals[source[r.id]] and 0 <= r.copies <= 2
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + (rate > int(rate)))
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mixing.plan_mix(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).collect() == []
    one = mixing.plan_mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()
    assert (one["size"], one.target, one.copies) == (0, 0.0, 0)


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 7) AS text", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 9 END) AS source")
    f = F.expr("target / source_size - floor(target / source_size)")
    spread = F.sqrt(F.sum(F.col("size") * F.col("size") * f * (1 - f)))
    got = mixing.plan_mix(docs).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.sum("size").alias("own"), spread.alias("spread")).collect()
    assert all(abs(r.taken - r.target * r.own / r.source_size) <= 4 * r.spread for r in got)


def test_mixing_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"text number {k} w w w", "a" if k % 4 else "b") for k in range(2000)], "doc_id long, text string, source string")
    got = mixing.plan_mix(docs).groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 0.05 * r.target for r in got)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = lang_id.fit(docs.where(~lang_id.held_out("doc_id")))
    found = lang_id.identify(docs, profiles).join(docs.withColumnRenamed("doc_id", "id").select("id", "lang"), "id").where(lang_id.held_out("id")).collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    mine = documents(spark)
    odd = {r.id: r for r in lang_id.identify(mine, profiles).collect()}
    for r in mine.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (odd[r.doc_id].lang_pred == "und") == (not letters) and 0 <= odd[r.doc_id].score <= 1
    kept = lang_id.keep_identified(mine, profiles)
    assert kept.columns == mine.columns and kept.where("text is null or text = ''").isEmpty()
    nothing = lang_id.fit(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in lang_id.identify(mine, nothing).collect()} == {"und"}
    assert lang_id.identify(spark.createDataFrame([], SCHEMA), profiles).collect() == []


def test_personal_patterns_are_those_of_the_contract():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(5)
    for _ in range(20000):
        text = "".join(rng.choice("a.@-1 \u00e9") for _ in range(rng.randint(0, 14)))
        assert [m.span() for m in email.finditer(text)] == list(pii.find_emails(text))
        text = "".join(rng.choice("12.. ") for _ in range(rng.randint(0, 20)))
        assert [m.span() for m in ip.finditer(text)] == [m.span() for m in pii._IP.finditer(text)]
    assert pii.find_personal("1" * 300_000 + "a" * 300_000 + "@") == []


def test_counts_added_up_in_a_task(monkeypatch):
    rng = random.Random(6)
    words = [[rng.randrange(50) for _ in range(rng.randrange(30))] for _ in range(40)]
    total = {}
    for x in (w for ws in words for w in ws):
        total[x] = total.get(x, 0) + 1
    for held in (1 << 20, 60, 3):
        monkeypatch.setattr(common, "HELD_COUNTS", held)
        got = {}
        for keys, counts in common.combined(np.unique(np.array(ws, np.int64), return_counts=True) for ws in words):
            for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                got[k] = got.get(k, 0) + n
        assert got == total


def test_ngrams_of_long_texts(monkeypatch):
    letters = lang_id.letter_table()
    text = "".join(random.Random(7).choice("abé ,.Σ\U0001d400") for _ in range(3000)) + "x" * 500
    whole = lang_id.ngrams(text, letters)
    monkeypatch.setattr(lang_id, "PIECE", 40)
    pieces = lang_id.ngrams(text, letters)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True)) and len(lang_id.ngrams("", letters)[0]) == 0


def test_common_words_are_not_counted_in_every_task(spark, monkeypatch):
    """Words that a part of the documents shows to be too common go before the count over all, and no disclosing term with them."""
    from spanmill.llm import pii

    rows = [(k, f"the mail of person{k % 7} is p{k % 7}@x.org secretword{k % 7} said they") for k in range(42)] + [(100 + k, f"the word number{k} said they person{k % 7}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, count = [], pii.count_terms
    monkeypatch.setattr(pii, "count_terms", lambda d, terms, *a: asked.append(terms) or count(d, terms, *a))
    found, sizes = {}, {}
    for part in (2, 1 << 62):
        monkeypatch.setattr(pii, "PART", part)
        asked.clear()
        kept = []
        monkeypatch.setattr(pii, "discard", lambda *tables: kept.extend(t.count() for t in tables))
        entities = pii.durable(pii.find_entities(docs), "entities")
        found[part] = {r.term for r in pii.find_disclosing(docs, entities).collect()}
        sizes[part] = kept[2]
    assert len(found[2]) == 7 and found[2] == found[1 << 62]  # secretword0 to 6, each in 6 documents with its entity
    assert sizes[2] < sizes[1 << 62]
