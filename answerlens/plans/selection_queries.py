"""Queries that choose evidence and judge it."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.operators import questions as Q
from answerlens.operators import retrieval as R
from answerlens.operators import selection as S
from answerlens.operators import structured as K
from answerlens.plans.registry import query
from answerlens.plans.retrieval_queries import _ENT, _LEX, _CONF, _Q, asked, counted, entities, hits

TARGETS, FORBIDDEN = ["the", "that"], ["for", "by"]
ROLES = [("definition", "^The "), ("example", " for "), ("relevance", " with ")]
_T, _F = "['the', 'that']", "['for', 'by']"


def _n(c: str, terms: str) -> str:
    return f"len(list_intersect(regexp_extract_all(lower({c}), '[a-z0-9]+'), {terms}))"


_LINES = f"cand AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 8), raw AS (SELECT id, unnest(string_split(source_excerpt, chr(10))) AS l, unnest(range(len(string_split(source_excerpt, chr(10))))) AS pos FROM <chunks> WHERE id IN (SELECT id FROM cand)), lines AS (SELECT c.*, pos, trim(l) AS line FROM cand c JOIN raw ON raw.id = c.id WHERE length(trim(l)) >= 20)"


def lines(v):
    return S.lines_of(hits(v, 8).select("query_id", "id", "rank"), v.chunks)


@query("r25_constraint_rerank", f"""
WITH {_LEX}, c AS (SELECT r.query_id, r.id, r.rank, k.lecture_number, query_id % 20 AS wanted, {_n('topic', _T)} AS at1, {_n("concat_ws(' ', clean_explanation, source_excerpt)", _T)} AS ab, {_n('topic', _F)} AS ft, {_n("concat_ws(' ', clean_explanation, source_excerpt)", _F)} AS fb
  FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE rank <= 12),
d AS (SELECT *, round(1.5::DOUBLE * at1 + least(0.6::DOUBLE * ab, 3.0) - 1.2::DOUBLE * ft - least(0.4::DOUBLE * fb, 1.6) + CASE WHEN wanted = lecture_number THEN 0.8 WHEN at1 + ab = 0 THEN -0.6 ELSE 0.0 END, 9) AS delta FROM c)
SELECT query_id, id, round(delta, 6) AS delta, row_number() OVER (PARTITION BY query_id ORDER BY delta DESC, rank) AS place FROM d WHERE delta > -2 OR at1 + ab > 0""")
def _(v):
    wanted = v.queries.select("query_id", (F.col("query_id") % 20).cast("int").alias("lecture_number"))
    return S.constraint_rerank(hits(v, 12), v.chunks, TARGETS, FORBIDDEN, wanted).withColumn("delta", F.round("delta", 6))


@query("r31_role_lines", f"""
WITH {_LEX}, {_LINES}, x AS (SELECT *, CASE WHEN regexp_matches(line, '^The ') THEN 'definition' WHEN contains(line, ' for ') THEN 'example' WHEN contains(line, ' with ') THEN 'relevance' END AS role, {_n('line', _T)} AS hits FROM lines)
SELECT query_id, role, id, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY hits DESC, length(line), id, pos) AS place FROM x WHERE role IS NOT NULL) WHERE place <= 2""")
def _(v):
    return S.role_lines(lines(v), ROLES, TARGETS)


@query("r32_defining_line", f"""
WITH {_LEX}, {_LINES}, x AS (SELECT *, CASE WHEN contains(line, ' is ') THEN 2 ELSE 0 END + {_n('line', _T)} - 3 * {_n('line', _F)} AS score FROM lines)
SELECT query_id, id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS r FROM x) WHERE r = 1""")
def _(v):
    return S.defining_line(lines(v), " is ", TARGETS, FORBIDDEN)


_ALLOWED = f"""p AS (SELECT * FROM lines WHERE {_n('line', _T)} > 0 AND {_n('line', _F)} = 0), o AS (SELECT query_id, substr(lower(line), 1, 200) AS key, min((rank, pos, id, line)) AS x FROM p GROUP BY 1, 2),
allowed AS (SELECT query_id, x[3] AS id, x[4] AS line, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x) AS place FROM o) WHERE place <= 5)""".replace("x[3]", "struct_extract(x, 3)").replace("x[4]", "struct_extract(x, 4)")


@query("r34_allowed_lines", f"WITH {_LEX}, {_LINES}, {_ALLOWED} SELECT query_id, place, id, line FROM allowed")
def _(v):
    return S.allowed_lines(lines(v), TARGETS, FORBIDDEN)


@query("r35_topic_pick", """
WITH w AS (SELECT query_id, 'src' || (query_id % 30) || ' ' AS needle FROM <queries>), n AS (SELECT w.query_id, count(*) AS n FROM w JOIN <chunks> k ON contains(lower(k.topic), trim(needle)) GROUP BY 1)
SELECT w.query_id, coalesce(n, (SELECT count(*) FROM <chunks>)) AS picked, n IS NULL AS fallback FROM w LEFT JOIN n ON n.query_id = w.query_id""")
def _(v):
    wanted = v.queries.select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 30).cast("string"), F.lit(" ")).alias("needle"))
    return S.pick_by_topic(wanted, v.chunks)


@query("r36_quiz_items", """
WITH i AS (SELECT id, lecture_number, topic FROM (SELECT *, row_number() OVER (PARTITION BY lecture_number ORDER BY sha256('7:' || id), id) AS r FROM <chunks>) WHERE r = 1),
f AS (SELECT list(topic ORDER BY h, topic) AS four FROM (SELECT topic, sha256('7:' || topic) AS h FROM (SELECT DISTINCT topic FROM <chunks>) ORDER BY h, topic LIMIT 4))
SELECT id, lecture_number, topic, array_to_string(list_filter(four, lambda t: t <> topic)[1:3], ' | ') AS wrong FROM i, f""")
def _(v):
    return S.quiz_items(v.chunks, 7)


@query("r41_primary_order", f"WITH {_ENT} SELECT query_id, id, place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM es WHERE concept_id = 'c1' AND score > 0.1) WHERE place <= 12")
def _(v):
    own = R.entity_scores(entities(v), ["c3"]).filter("concept_id = 'c1' AND score > 0.1").select("query_id", "id", "score")
    return R.top_k(own, 12).select("query_id", "id", F.col("rank").alias("place"))


@query("r43_related_in_evidence", rf"""
WITH {_ENT}, spoken AS (SELECT query_id, concept_id, min(pos) AS pos FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term, unnest(range(len(regexp_extract_all(lower(query_text), '[a-z0-9]+')))) AS pos FROM <queries>) JOIN <concept_terms> USING (term) GROUP BY 1, 2),
lead AS (SELECT query_id, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, concept_id) AS place FROM spoken) WHERE place = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pos, dst) AS r FROM <concept_edges> WHERE kind = 'related'), barred AS (SELECT query_id, 'c2' AS concept_id FROM <queries> WHERE query_id % 5 = 0)
SELECT l.query_id, l.concept_id, min_by(dst, r) AS related FROM lead l JOIN near ON src = l.concept_id AND r <= 5 WHERE (l.query_id, dst) IN (SELECT (query_id, concept_id) FROM eh) AND (l.query_id, dst) NOT IN (SELECT (query_id, concept_id) FROM barred) GROUP BY 1, 2""")
def _(v):
    barred = v.queries.filter("query_id % 5 = 0").select("query_id", F.lit("c2").alias("concept_id"))
    return R.related_in_evidence(K.named_concepts(v.queries, v.concept_terms), v.concept_edges, entities(v), barred)


@query("r45_one_liners", f"WITH {_LEX}, {_LINES}, x AS (SELECT *, {_n('line', '[' + repr('that') + ']')} = 0 AS no FROM lines) SELECT query_id, struct_extract(min((no, rank, pos, id, line)), 5) AS line, NOT struct_extract(min((no, rank, pos, id, line)), 1) AS named FROM x GROUP BY 1")
def _(v):
    return S.one_liners(lines(v), ["that"])


PATTERNS = {"quiz": "^the ", "compare": " with .* with ", "summary": "^la ", "synthesis": " and .* and .* and ", "definition": "^[a-m]"}


@query("q3_query_types", f"""
SELECT query_id, CASE WHEN regexp_matches(lower(query_text), '^the ') THEN 'quiz' WHEN regexp_matches(lower(query_text), ' with .* with ') THEN 'compare' WHEN regexp_matches(lower(query_text), '^la ') THEN 'summary'
  WHEN regexp_matches(lower(query_text), ' and .* and .* and ') THEN 'synthesis' ELSE 'lecture_specific' END AS type FROM {_Q}""")
def _(v):
    return S.query_types(asked(v), PATTERNS)


_LOW = f"conf AS ({_CONF.strip().replace('WITH ' + _LEX + ', b AS', 'WITH b AS')})"


@query("q16_low_confidence", f"WITH {_ENT}, {_LOW}, s AS (SELECT DISTINCT query_id FROM eh WHERE concept_id = 'c2') SELECT c.query_id, confidence < CASE WHEN s.query_id IS NULL THEN 0.35 ELSE 0.35 * 0.55 END AS low FROM conf c LEFT JOIN s ON s.query_id = c.query_id")
def _(v):
    return S.low_confidence(R.confidence(asked(v), counted(v, 12), v.chunks), entities(v).filter("concept_id = 'c2'"))


@query("v2_grounding", f"SELECT id, contains(lower(actual_response), 'lecture') OR {_n('actual_response', _T)} > 0 OR (category <> 'en' AND length(actual_response) > 200) AS grounded FROM <cases>")
def _(v):
    return v.cases.select("id", S.grounded(F.col("actual_response"), TARGETS, F.col("category") == "en").alias("grounded"))


@query("v5_purity", f"""
WITH l AS (SELECT id, unnest(string_split(actual_response, chr(10))) AS line FROM <cases>), b AS (SELECT id, count(*) FILTER ({_n('line', _F)} > 0 AND {_n('line', _T)} = 0) AS bad FROM l GROUP BY 1)
SELECT c.id, bad < 2 AND ({_n('actual_response', _F)} = 0 OR {_n('actual_response', _T)} > 0) AS pure FROM <cases> c JOIN b ON b.id = c.id""")
def _(v):
    return v.cases.select("id", S.concept_pure(F.col("actual_response"), TARGETS, FORBIDDEN).alias("pure"))


@query("v8_distinct_evidence", f"""
WITH {_LEX}, {_LINES}, {_ALLOWED}, n AS (SELECT query_id - query_id % 2 AS q, query_id % 2 AS side, list_sort(list_distinct(list(lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))))) AS s FROM allowed WHERE place <= 3 GROUP BY 1, 2)
SELECT coalesce(a.q, b.q) AS query_id, coalesce(a.s <> b.s, true) AS distinct FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b ON a.q = b.q""".replace("AS distinct", 'AS "distinct"'))
def _(v):
    x = S.allowed_lines(lines(v), TARGETS, FORBIDDEN)
    return S.distinct_evidence(x.filter("query_id % 2 = 0"), x.filter("query_id % 2 = 1").withColumn("query_id", F.col("query_id") - 1))


@query("q15_gates", f"""
WITH {_ENT}, {_LOW}, seen AS (SELECT DISTINCT query_id FROM eh WHERE concept_id = 'c2'), low AS (SELECT c.query_id, hits, confidence < CASE WHEN s.query_id IS NULL THEN 0.35 ELSE 0.35 * 0.55 END AS low FROM conf c LEFT JOIN seen s ON s.query_id = c.query_id),
asked_words AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term FROM <queries>), spam AS (SELECT query_id, count(*) <= 40 AND count(*) FILTER (term IN (SELECT term FROM <concept_terms>)) >= 0.12::DOUBLE * count(*) AS spam FROM asked_words GROUP BY 1),
targets AS (SELECT query_id, count(DISTINCT concept_id) AS targets FROM asked_words JOIN <concept_terms> USING (term) GROUP BY 1), whole AS (SELECT c.query_id, count(DISTINCT concept_id) >= 2 AS complete FROM cand c LEFT JOIN n ON n.id = c.id GROUP BY 1)
SELECT q.query_id, CASE WHEN coalesce(hits, 0) = 0 THEN 'empty' WHEN coalesce(spam, false) THEN 'spam' WHEN coalesce(low, true) AND coalesce(targets, 0) = 0 THEN 'low_confidence_no_target' WHEN NOT coalesce(complete, false) THEN 'incomplete' WHEN coalesce(low, true) THEN 'retry_wider' ELSE 'answer' END AS gate
FROM <queries> q LEFT JOIN low l ON l.query_id = q.query_id LEFT JOIN spam s ON s.query_id = q.query_id LEFT JOIN targets t ON t.query_id = q.query_id LEFT JOIN whole w ON w.query_id = q.query_id""")
def _(v):
    conf = R.confidence(asked(v), counted(v, 12), v.chunks)
    found = entities(v, keep=True)
    low = S.low_confidence(conf, found.filter("concept_id = 'c2'"))
    spam = Q.keyword_spam(v.queries, v.concept_terms, most_tokens=40, share=0.12).select("query_id", "spam")
    targets = Q.linked_concepts(v.queries, v.concept_terms).select("query_id", F.col("n").alias("targets"))
    x = v.queries.select("query_id").join(conf.select("query_id", "hits"), "query_id", "left")
    for part in (low, spam, targets, R.complete_evidence(found, 2).select("query_id", "complete")):
        x = x.join(part, "query_id", "left")
    return S.gates(x.na.fill(0, ["hits", "targets"]).na.fill({"spam": False, "low": True, "complete": False}))
