import hashlib

from spanmill.llm import suffix_dedup
from tests.llm.corpus import SCHEMA, documents


def brute(rows, length):
    seen = {}
    for _, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    return sorted((r.id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


def test_matches_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute(rows, 200)
    assert run(docs, length=50, anchor=20) == brute(rows, 50)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 300)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute(rows, 200)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
