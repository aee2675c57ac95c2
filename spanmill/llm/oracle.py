"""SQL twins, for DuckDB, of those operator queries that SQL can express."""

from __future__ import annotations

from spanmill.llm import mixing, secrets
from spanmill.plans.oracle import lit, located, with_

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to FROM m
"""

OP4 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM iw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM ig),
sizes AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM dw, sizes)),
hits AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM dg d JOIN grams i ON d.n = i.n AND d.g = i.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""

OP9 = """
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM reach r JOIN links l ON r.id = l.a WHERE r.low < l.b),
low AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, low.low AS component_id, low.low = e.vec_id AS kept FROM embeddings e JOIN low ON low.id = e.vec_id
"""

OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
good AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN good ON w.doc_id = good.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM orders, unnest(range(1, 6)) AS r(step)),
counted AS (
  SELECT part, filter_order, step, bit, sum(n) AS total, coalesce(sum(n) FILTER (mask & bit <> 0), 0) AS fails, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
  (fails - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


def op13(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds on (vector, component) rows, distances and floors in wide integers."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, i, v[i]::HUGEINT AS x FROM kept, unnest(range(1, 65)) AS r(i))",
        f"c0 AS MATERIALIZED (SELECT c, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept) JOIN x USING (vec_id) WHERE c < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT vec_id, c, sum((x.x - c{n}.x) * (x.x - c{n}.x)) AS d FROM x JOIN c{n} USING (i) GROUP BY vec_id, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, min_by(c, {k} * d + c) AS c, min(d) AS d FROM d{n} GROUP BY vec_id)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (vec_id) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - (s % n + n) % n) // n, x) AS x FROM c{n} LEFT JOIN s{n} USING (c, i))")
    text = f"t AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)"
    return with_(*parts, text) + f"""SELECT vec_id, a{rounds}.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN t ON a{rounds}.c = t.c"""


def op5() -> str:
    """Every rule's matches with offsets, filtered, joined in order."""
    parts, unions = ["texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"], []
    for rank, (kind, pattern, group, least) in enumerate(secrets.RULES):
        parts.append(located(pattern, "texts", f"r{rank}"))
        unions.append(f"SELECT doc_id, s, {rank} AS rank, '{kind}' AS kind, e FROM r{rank} WHERE length(regexp_extract(value, {lit(pattern)}, {group})) >= {least}")
    join = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(f.doc_id) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in secrets.BASE_RULES)
    return with_(*parts, "found AS (" + " UNION ALL ".join(unions) + ")") + f"""SELECT t.doc_id, {counts}, sha256(coalesce({join} FILTER (rank < {len(secrets.BASE_RULES)}), '')) AS base_sha256, coalesce({join}, '') AS spans
FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id GROUP BY t.doc_id"""


def build() -> dict[str, str]:
    return {
        "op2_warc_round_trip": OP2,
        "op4_benchmark_decontamination": OP4,
        "op5_secret_scan_blob_ledger": op5(),
        "op7_source_mixing": mixing.ORACLE_SQL,
        "op9_embedding_range_join": OP9,
        "op11_filter_interaction_audit": OP11,
        "op13_hamerly_clusters": op13(),
    }
