"""Queries of retrieval by query type."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import constraints as C
from answerlens.operators import questions as Q
from answerlens.operators import retrieval as R
from answerlens.operators import routing as X
from answerlens.operators import selection as S
from answerlens.plans.constraint_queries import _EDGE, _WORD, _sql_parts
from answerlens.plans.registry import query
from answerlens.plans.retrieval_queries import _LEX, _Q

#: The tables hold few question words, so words that occur stand for cues; texts name no, one or two lectures, and some are two words long.
PATTERNS = {"quiz": "^th", "compare": " (?:with|that) ", "summary": "^[l-r]", "synthesis": " and .* and .* and ", "vague": "^[a-z]", "definition": "^[a-g]"}
GLOSSARY = "licen[cs]e|^de "
_TEXTS = """
SELECT query_id, CASE WHEN query_id % 7 = 6 THEN split_part(query_text, ' ', 1) || ' ' || split_part(query_text, ' ', 2) ELSE query_text END
  || CASE query_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' lecture ' || CAST(query_id % 20 AS STRING) || ' lecture ' || CAST((query_id + 3) % 20 AS STRING) ELSE ' lecture ' || CAST(query_id % 23 AS STRING) END AS query_text
FROM <queries>"""
_LECTURE_TERMS = "SELECT lecture_number, lower(split_part(min(clean_explanation), ' ', 1)) AS term FROM <chunks> GROUP BY lecture_number"
_LECTURES = r"list_sort(list_distinct(list_transform(regexp_extract_all(lower(query_text), '\b(?:lecture|lec|week|class)\s*#?\s*([0-9]{1,6})', 1), lambda x: CAST(x AS INT))))"
_KEY = "query_id * 100"
_LISTS = (
    _LEX.replace(_Q, "subs").replace("query_id % 20 AS lecture", f"{_LECTURES} AS lectures").replace("ON lecture_number = lecture)", "ON list_contains(lectures, lecture_number))")
    .replace("ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)",
             "ranked AS (SELECT s.*, b.qid, b.sub, b.strategy, k.lecture_number, k.chunk_type, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.id) AS rank FROM scored s JOIN subs b ON b.query_id = s.query_id JOIN <chunks> k ON k.id = s.id WHERE score > 0 AND (b.lecture IS NULL OR b.lecture = k.lecture_number))")
)
_ROUTED = rf"""
texts AS ({_TEXTS}), lec AS (SELECT *, {_LECTURES} AS lectures FROM texts),
typed AS (SELECT *, CASE WHEN regexp_matches(lower(query_text), '{PATTERNS['quiz']}') THEN 'quiz' WHEN regexp_matches(lower(query_text), '{PATTERNS['compare']}') THEN 'compare' WHEN regexp_matches(lower(query_text), '{PATTERNS['summary']}') THEN 'summary'
  WHEN regexp_matches(lower(query_text), '{PATTERNS['synthesis']}') OR len(lectures) >= 2 THEN 'synthesis' WHEN len({_WORD}) <= 3 AND regexp_matches(lower(query_text), '{PATTERNS['vague']}') THEN 'vague_followup'
  WHEN len(lectures) = 1 THEN 'lecture_specific' WHEN regexp_matches(lower(query_text), '{PATTERNS['definition']}') THEN 'definition' ELSE 'general' END AS type FROM lec),
two AS (SELECT query_id, {_sql_parts(rf"regexp_replace(trim(string_split(query_text, '?')[1]), {_EDGE})", r'\s+(?:with|that)\s+')} AS e FROM texts),
names AS (SELECT query_id, list_filter(list_transform(e[1:8], lambda x: regexp_replace(regexp_replace(string_split(x, ':')[1], '(?s)\s+for\s.*$', ''), {_EDGE})), lambda x: x <> '') AS e FROM two WHERE len(e) >= 2),
routed AS (SELECT y.*, e, CASE WHEN type = 'compare' AND coalesce(len(e), 0) >= 3 THEN 'sides_many' WHEN type = 'compare' AND len(e) = 2 THEN 'sides_two' WHEN type = 'compare' THEN 'spread'
  WHEN type IN ('summary', 'quiz') AND len(lectures) = 1 AND lectures[1] IN (SELECT lecture_number FROM <chunks>) THEN 'lecture' WHEN type = 'summary' THEN 'broad' WHEN type IN ('definition', 'quiz') THEN 'focused'
  WHEN type = 'synthesis' THEN 'threads' WHEN type = 'lecture_specific' THEN 'plain' ELSE 'supported' END AS strategy FROM typed y LEFT JOIN names USING (query_id)),
heads AS ({_LECTURE_TERMS}), own AS (SELECT query_id, unnest(lectures) AS n FROM routed), around AS (SELECT query_id, n FROM own UNION SELECT query_id, dst FROM own JOIN <lecture_edges> ON src = n),
firsts AS (SELECT query_id, term, min(n) AS n, row_number() OVER (PARTITION BY query_id ORDER BY min(n), term) AS r FROM around JOIN heads ON lecture_number = n GROUP BY 1, 2),
extras AS (SELECT query_id, string_agg(term, ' ' ORDER BY r) AS extra FROM firsts WHERE r <= 4 GROUP BY 1),
plain_subs AS (SELECT query_id AS qid, strategy, 0 AS sub, strategy NOT IN ('spread', 'lecture') AS augment, CASE WHEN strategy = 'lecture' THEN lectures[1] END AS lecture, CASE WHEN strategy = 'lecture' THEN 'lecture ' || lectures[1] || ' ' || trim(query_text) ELSE query_text END AS query_text FROM routed WHERE strategy NOT IN ('sides_many', 'sides_two')
  UNION ALL SELECT query_id, strategy, 1, true, NULL, query_text || ' ' || extra FROM routed JOIN extras USING (query_id) WHERE strategy = 'threads'
  UNION ALL SELECT query_id, strategy, sub, true, NULL, trim(CASE WHEN len(lectures) > 0 THEN 'lecture ' || lectures[1] || ' ' ELSE '' END || trim(entity)) FROM (SELECT *, unnest(range(len(e))) AS sub, unnest(e) AS entity FROM routed WHERE strategy IN ('sides_many', 'sides_two'))),
words_of AS (SELECT qid, sub, unnest({_WORD}) AS term, unnest(range(len({_WORD}))) AS pos FROM plain_subs WHERE augment),
linked AS (SELECT qid, sub, concept_id, min(pos) AS pos FROM words_of JOIN <concept_terms> USING (term) GROUP BY 1, 2, 3),
lacks AS (SELECT l.qid, l.sub, c.term, min((l.pos, l.concept_id)) AS spot FROM linked l JOIN <concept_terms> c USING (concept_id) JOIN plain_subs p ON p.qid = l.qid AND p.sub = l.sub WHERE NOT contains(lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))), c.term) GROUP BY 1, 2, 3),
more AS (SELECT qid, sub, string_agg(term, ' ' ORDER BY spot, term) AS more FROM lacks GROUP BY 1, 2),
subs AS (SELECT p.* EXCLUDE (query_text), p.qid * 100 + p.sub AS query_id, p.query_text || coalesce(' ' || more, '') AS query_text FROM plain_subs p LEFT JOIN more USING (qid, sub)),
{_LISTS}"""
_LOW_META = "regexp_matches(lower(coalesce(substr(clean_explanation, 1, 200), '')), '{0}') OR regexp_matches(lower(coalesce(topic, '')), '{0}')".format(GLOSSARY)


def routed(v):
    """(sub-queries, their scores), each computed and written once."""

    def subs():
        texts = v.sql(_TEXTS)
        typed = S.query_types(texts, PATTERNS).join(texts, "query_id").withColumn("lectures", T.lecture_numbers(F.col("query_text")))
        sides = C.compare_entities(texts, sides=r"\s+(?:with|that)\s+", listing="^$", clause=r"(?s)\s+for\s.*$")
        x = X.strategies(typed, sides, v.chunks)
        plain = X.sub_queries(x, sides, X.synthesis_terms(x, v.lecture_edges, v.sql(_LECTURE_TERMS)))
        tagged = plain.filter("augment").select(F.struct("query_id", "sub").alias("query_id"), "query_text")
        linked = Q.linked_concepts(tagged, v.concept_terms).select("query_id", F.posexplode(F.split("concepts", ",")).alias("pos", "concept_id"))
        longer = C.augmented_queries(tagged, linked, v.concept_terms).select("query_id.*", "text")
        return plain.join(longer, ["query_id", "sub"], "left").withColumn("query_text", F.coalesce("text", "query_text")).drop("text")

    made = v.stored("subs", subs)
    return made, v.stored("sub_scores", lambda: X.sub_scores(made, v.chunks))


@query("r20_routed", f"""
WITH {_ROUTED}, lists AS (SELECT r.*, {_LOW_META} AS meta FROM ranked r JOIN <chunks> c ON c.id = r.id
  WHERE rank <= CASE strategy WHEN 'focused' THEN 5 WHEN 'sides_many' THEN 5 WHEN 'sides_two' THEN 5 WHEN 'spread' THEN 7 WHEN 'lecture' THEN 20 WHEN 'broad' THEN 8 WHEN 'threads' THEN 9 ELSE 5 END),
ends AS (SELECT qid, least(coalesce(max(rank) FILTER (sub = 0), 0), coalesce(max(rank) FILTER (sub = 1), 0)) AS bothn FROM lists GROUP BY 1),
spots AS (SELECT qid, strategy, l.id, any_value(l.lecture_number) AS lecture_number, any_value(meta) AS meta,
  min(CASE WHEN strategy = 'sides_two' AND rank <= bothn THEN rank * 1000 + sub WHEN strategy = 'sides_two' THEN 1000000 + sub * 1000 + rank WHEN strategy = 'focused' AND chunk_type NOT IN ('definition', 'process') THEN 1000000 + rank ELSE sub * 1000 + rank END) AS spot
  FROM lists l JOIN ends USING (qid) GROUP BY 1, 2, 3),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, id) AS p FROM spots), capped AS (SELECT *, row_number() OVER (PARTITION BY qid, lecture_number ORDER BY p) > 1 AS again FROM ordered WHERE strategy <> 'threads' OR p <= 18),
sized AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, sum((NOT again)::INT) OVER (PARTITION BY qid) AS lecs FROM capped),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 5 AND (strategy = 'spread' OR strategy = 'threads' AND lecs < 5) THEN again ELSE false END, p) AS seat FROM sized),
main AS (SELECT qid, strategy, id, lecture_number, row_number() OVER (PARTITION BY qid ORDER BY seat) AS place FROM placed
  WHERE seat <= CASE strategy WHEN 'sides_many' THEN 18 WHEN 'focused' THEN 99 WHEN 'lecture' THEN 99 WHEN 'plain' THEN 99 WHEN 'supported' THEN 99 ELSE 5 END AND (strategy = 'threads' OR NOT meta)),
have AS (SELECT DISTINCT qid, strategy, lecture_number FROM main WHERE strategy IN ('threads', 'supported')), next AS (SELECT DISTINCT qid, strategy, dst FROM have JOIN <lecture_edges> ON src = lecture_number WHERE (qid, dst) NOT IN (SELECT (qid, lecture_number) FROM have)),
help AS (SELECT qid, strategy, k.id, row_number() OVER (PARTITION BY qid ORDER BY dst, k.id) AS place FROM next JOIN <chunks> k ON k.lecture_number = dst WHERE chunk_type IN ('definition', 'process', 'overview'))
SELECT qid AS query_id, strategy, 'main' AS section, place, id FROM main UNION ALL SELECT qid, strategy, 'supporting', place, id FROM help WHERE place <= 4""")
def _(v):
    subs, scores = routed(v)
    return X.route(subs, scores, v.chunks, v.lecture_edges, glossary=GLOSSARY)


@query("r20_confidence", f"""
WITH {_ROUTED}, b AS (SELECT * FROM ranked WHERE rank = 1), s AS (SELECT query_id, score AS second FROM ranked WHERE rank = 2),
x AS (SELECT u.qid, u.sub, u.strategy, (b.score - coalesce(second, 0.0)) / (b.score + 1e-6) AS margin, matched::DOUBLE / greatest(len(terms), 1) AS coverage, b.score, phrase_events, strong_score, phrase_score, token_score, list_contains(lectures, lecture_number) AS hit
  FROM subs u JOIN q ON q.query_id = u.query_id LEFT JOIN b ON b.query_id = u.query_id LEFT JOIN s ON s.query_id = u.query_id),
c AS (SELECT *, 0.2 * score / (score + 14.0) + 0.22 * least(1.0, margin * 1.15) + 0.28 * coverage + 0.14 * least(1.0, phrase_events / 3.5) + 0.11 * least(1.0, (strong_score + 0.35 * phrase_score) / (token_score + phrase_score + 1e-6)) + CASE WHEN hit THEN 0.05 ELSE 0.0 END AS conf FROM x),
each_one AS (SELECT *, round(CASE WHEN score IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN hit THEN greatest(conf, 0.44) ELSE conf END)) END, 6) AS confidence FROM c),
news AS (SELECT qid, id, min(sub) AS sub FROM ranked WHERE rank <= 5 AND strategy = 'sides_many' GROUP BY 1, 2),
used AS (SELECT e.*, (SELECT count(*) FROM news n WHERE n.qid = e.qid AND n.sub < e.sub) AS earlier FROM each_one e)
SELECT qid AS query_id, strategy, count(*) AS subs, min(confidence) AS confidence FROM used WHERE CASE strategy WHEN 'sides_many' THEN earlier < 25 WHEN 'sides_two' THEN true ELSE sub = 0 END GROUP BY 1, 2""")
def _(v):
    return X.route_confidence(*routed(v), v.chunks)
