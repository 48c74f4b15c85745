"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from answerlens.llm.decontaminate import op4_decontaminate
from answerlens.llm.embeddings import op7_embedding_near_dedup
from answerlens.llm.filter_audit import op11_filter_audit
from answerlens.llm.language import op12_language
from answerlens.llm.licenses import op5_licenses
from answerlens.llm.minhash import op1_minhash_near_dedup
from answerlens.llm.mixing import op9_mix_sources
from answerlens.llm.pii import op3_pii
from answerlens.llm.quality import op10_quality
from answerlens.llm.resampling import op13_resample
from answerlens.llm.substrings import op8_substring_dedup
from answerlens.llm.tokens import op2_token_counts
from answerlens.llm.warc import op6_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_token_counts, op3_pii, op4_decontaminate, op5_licenses,
        op6_warc, op7_embedding_near_dedup, op8_substring_dedup, op9_mix_sources, op10_quality,
        op11_filter_audit, op12_language, op13_resample,
    )
}

_REACH = "reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r), comps AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1), nodes AS (SELECT doc_id AS id FROM documents),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)), {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN comps c ON c.id = d.doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(x, 1 + 5 * g, 5) AS INT) >> CAST(15 - 5 * k AS INT)) % 32, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d""",
    "op7_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT vec_id AS id FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM comps""",
    "op11_filter_audit": r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
docs AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f
  FROM words LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE length(o) < 5 AND NOT contains(o, l)),
steps AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
told AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter, n, good, toxic, f[ord(filter_order[step]) - 64] AS fails,
  len(list_filter(range(1, step), lambda k: f[ord(filter_order[k]) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS all_fails FROM cells, steps),
got AS (SELECT part, filter_order, step, any_value(letter) AS letter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND all_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM got
""",
}
