"""Queries of line sides, secondary texts and sub-questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import constraints as C
from answerlens.operators import decomposition as D
from answerlens.operators import retrieval as R
from answerlens.operators import secondary as Y
from answerlens.operators import selection as S
from answerlens.operators import sides as L
from answerlens.operators import structured as K
from answerlens.plans.registry import query
from answerlens.plans.retrieval_queries import _ENT, entities
from answerlens.plans.routing_queries import _ROUTED, _TEXTS, PATTERNS
from answerlens.plans.structured_queries import _NAMED
from answerlens.plans.text_queries import _SENTENCES, units_sql

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
#: A word that each concept's side must not have.
_BARRED = {"c1": "by", "c2": "that", "c3": "de", "c4": "la"}
_BAD = "['" + "'], ['".join(_BARRED.values()) + "']"


def _held(terms: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({terms}, x)))"


_SIDES = f"""
WITH {_ENT}, {_NAMED}, sided AS (SELECT query_id AS key, max(CASE WHEN place = 1 THEN concept_id END) AS ca, max(CASE WHEN place = 2 THEN concept_id END) AS cb FROM named GROUP BY 1 HAVING count(*) >= 2),
told AS (SELECT concept_id, list(term ORDER BY term) AS ts FROM <concept_terms> GROUP BY 1), barred AS (SELECT unnest({list(_BARRED)}) AS concept_id, unnest([{_BAD}]) AS bs),
wanted AS (SELECT key, 'a' AS side, ca AS concept_id FROM sided UNION ALL SELECT key, 'b', cb FROM sided),
picked AS (SELECT key, side, id, row_number() OVER (PARTITION BY key, side ORDER BY score DESC, id) AS place FROM wanted JOIN es ON es.query_id = key AND es.concept_id = wanted.concept_id),
cut AS (SELECT key, side, place, {units_sql('source_excerpt')} AS u FROM picked JOIN <chunks> k ON k.id = picked.id WHERE place <= 4),
rows_of AS (SELECT key, side, place, unnest(range(len(u))) AS pos, unnest(u) AS unit FROM cut),
split AS (SELECT r.*, {_WORDS.format('unit')} AS w, x.ts AS ta, y.ts AS tb, n.bs AS na, m.bs AS nb FROM rows_of r JOIN sided s ON s.key = r.key JOIN told x ON x.concept_id = ca JOIN told y ON y.concept_id = cb JOIN barred n ON n.concept_id = ca JOIN barred m ON m.concept_id = cb),
points AS (SELECT *, {_held('ta')} AS sa, {_held('tb')} AS sb, {_held('na')} > 0 AS ba, {_held('nb')} > 0 AS bb FROM split),
marked AS (SELECT *, CASE WHEN sa >= 1 AND sb >= 1 AND NOT ba AND NOT bb AND least(sa, sb) >= 0.6 * greatest(sa, sb) THEN 'shared' WHEN sa >= 1 AND sa > sb AND NOT ba THEN 'a' WHEN sb >= 1 AND sb > sa AND NOT bb THEN 'b'
  WHEN ba AND sa > 0 THEN 'forbidden_a' WHEN bb AND sb > 0 THEN 'forbidden_b' ELSE 'skip' END AS label FROM points),
c1 AS (SELECT key, side, lower(trim(unit)) AS low, min((place, pos, unit)) AS spot FROM marked WHERE label = side GROUP BY 1, 2, 3), c2 AS (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY spot) AS place FROM c1),
s1 AS (SELECT key, lower(trim(unit)) AS low, min((side, place, pos, unit)) AS spot FROM marked WHERE label = 'shared' GROUP BY 1, 2),
f1 AS (SELECT key, side, CASE WHEN side = 'a' THEN na[1] ELSE nb[1] END AS term, min((place, pos, unit)) AS spot FROM marked WHERE label = 'forbidden_' || side GROUP BY 1, 2, 3)"""


@query("r28_line_sides", _SIDES + """
SELECT key AS query_id, side, 'core' AS kind, place, md5(trim(struct_extract(spot, 3))) AS line FROM c2 WHERE place <= 8
UNION ALL SELECT key, 'both', 'shared', row_number() OVER (PARTITION BY key ORDER BY spot), md5(trim(struct_extract(spot, 4))) FROM s1
UNION ALL SELECT key, side, 'forbidden', row_number() OVER (PARTITION BY key, side ORDER BY spot), md5(term) FROM f1""")
def _(v):
    return told(v)[1].select(F.col("key").alias("query_id"), "side", "kind", "place", F.md5("line").alias("line"))


def told(v):
    """(pairs of concepts, lines of their sides, support of each side)"""
    named = K.named_concepts(v.queries, v.concept_terms).filter("place <= 2")
    at = lambda n: F.max(F.when(F.col("place") == n, F.col("concept_id")))
    pairs = named.groupBy(F.col("query_id").alias("key")).agg(at(1).alias("a"), at(2).alias("b")).filter("b IS NOT NULL")
    scored = R.entity_scores(entities(v), ["c3"])
    chosen = L.side_chunks(scored, pairs)
    barred = F.create_map(*[F.lit(x) for kv in _BARRED.items() for x in kv])
    own = v.concept_terms.groupBy("concept_id").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.array(barred[F.col("concept_id")]).alias("barred"))
    side = lambda c: own.select(F.col("concept_id").alias(c), F.col("terms").alias(f"terms_{c}"), F.col("barred").alias(f"not_{c}"))
    terms = pairs.join(side("a"), "a").join(side("b"), "b").select("key", F.col("terms_a").alias("a"), F.col("terms_b").alias("b"), "not_a", "not_b")
    best = scored.groupBy(F.col("query_id").alias("key"), "concept_id").agg(F.max("score").alias("support"))
    support = pairs.select("key", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("concept_id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("concept_id")))).alias("x")).select("key", "x.*").join(best, ["key", "concept_id"])
    return pairs, L.line_sides(L.unit_rows(chosen, v.chunks), terms), support


@query("r44_fallback", _SIDES + r""",
core AS (SELECT key, side, list_sort(list_distinct(list(lower(trim(regexp_replace(struct_extract(spot, 3), '\s+', ' ', 'g')))))) AS three FROM (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY place) AS r FROM c2) WHERE r <= 3 GROUP BY 1, 2),
held AS (SELECT key, side, max(score) AS support FROM wanted JOIN es ON es.query_id = key AND es.concept_id = wanted.concept_id GROUP BY 1, 2)
SELECT s.key AS query_id, x.three IS NULL OR y.three IS NULL OR x.three = y.three OR coalesce(h.support, -1) < 0.15 OR coalesce(i.support, -1) < 0.15 AS fallback FROM sided s
LEFT JOIN core x ON x.key = s.key AND x.side = 'a' LEFT JOIN core y ON y.key = s.key AND y.side = 'b' LEFT JOIN held h ON h.key = s.key AND h.side = 'a' LEFT JOIN held i ON i.key = s.key AND i.side = 'b'""")
def _(v):
    return L.needs_fallback(*told(v)).select(F.col("key").alias("query_id"), "fallback")


#: Words that occur stand for the phrases that mark what comes from outside.
MARKS = ["th", "er"]
_SECOND = """
SELECT id, CASE WHEN id % 13 = 0 THEN ' ' WHEN id % 3 = 0 THEN 'Boosted explanation: ' || actual_response ELSE actual_response END AS secondary, id % 2 = 0 AS relational, id % 8 > 1 AS external, actual_response FROM <cases>"""
_TERMS_OF = "SELECT id, term FROM <cases> JOIN (VALUES (0, 'the'), (0, 'of'), (0, 'and'), (0, 'in'), (0, 'er'), (0, 'to'), (1, 'tion'), (1, 'nde'), (2, 'explanation'), (3, NULL)) AS t(k, term) ON k = id % 7"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_MARKED = " OR ".join(f"starts_with(lower(s), '{m}')" for m in MARKS)
_COVERED = "(length(s) < 12 OR len(regexp_extract_all(lower(s), '[a-z]{3,}')) = 0 OR len(list_filter(regexp_extract_all(lower(s), '[a-z]{3,}'), lambda x: contains(blob, x))) >= greatest(1, len(regexp_extract_all(lower(s), '[a-z]{3,}')) // 4))"


@query("v12_secondary_texts", rf"""
WITH texts AS ({_SECOND}), bare AS (SELECT id, {_STRIP.format('actual_response')} AS b FROM <cases>),
ls AS (SELECT id, b, list_transform(list_filter(list_transform(string_split(b, chr(10)), lambda x: {_STRIP.format("regexp_replace(" + _STRIP.format("x") + ", '^[-*•]+', '')")}), lambda x: length(x) >= 12)[1:5], lambda x: substr(x, 1, 400)) AS l FROM bare),
ev AS (SELECT id, lower(array_to_string(list_sort(CASE WHEN len(l) > 0 THEN l WHEN b <> '' THEN [substr(b, 1, 800)] ELSE [] END), ' ')) AS blob FROM ls WHERE id % 5 < 4),
fb AS (SELECT id, list_sort(list_distinct(list(term))) AS ts FROM ({_TERMS_OF}) WHERE term IS NOT NULL GROUP BY 1),
x0 AS (SELECT t.id, relational, external, {_STRIP.format('secondary')} AS body, coalesce(blob, '') AS blob, coalesce(ts, []) AS ts FROM texts t LEFT JOIN ev ON ev.id = t.id LEFT JOIN fb ON fb.id = t.id),
x1 AS (SELECT *, {_SENTENCES.format(_STRIP.format("CASE WHEN starts_with(lower(body), 'boosted explanation') THEN substr(body, 21) ELSE body END")).replace('trim(x)', _STRIP.format('x'))} AS sents FROM x0),
x2 AS (SELECT *, list_filter(sents, lambda s: len(list_intersect({_WORDS.format('s')}, ts)) = 0) AS kept FROM x1),
x3 AS (SELECT *, 'Boosted Explanation:' || chr(10) || chr(10) || array_to_string(kept, ' ') AS shown, coalesce(list_filter(range(len(kept)), lambda i: starts_with(lower(kept[i + 1]), 'th') OR starts_with(lower(kept[i + 1]), 'er'))[2], 1000000) AS last FROM x2),
x4 AS (SELECT *, list_filter(ts, lambda t: length(t) > 2 AND contains(lower(shown), t))[1] AS inside, len(list_intersect({_WORDS.format('shown')}, ts)) > 0 AS after, len(list_filter(kept, lambda s: NOT ({_MARKED}) AND NOT {_COVERED})) > 0 AS unmarked,
  list_filter(kept, lambda s, i: NOT ({_MARKED}) OR i - 1 <= last) AS capped FROM x3),
x5 AS (SELECT *, CASE WHEN external THEN len(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(array_to_string(list_filter(capped, lambda s: {_MARKED}), ' '), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{3,}}|[A-Z]{{2,}}')), lambda x: lower(x)), lambda x: NOT contains(blob, x)))) ELSE 0 END AS novel FROM x4),
x6 AS (SELECT *, CASE WHEN body = '' THEN 'empty_boost' WHEN len(kept) = 0 THEN 'all_sentences_forbidden' WHEN after THEN 'forbidden_after_strip' WHEN NOT relational AND inside IS NOT NULL THEN 'forbidden_term:' || substr(inside, 1, 20)
  WHEN external AND unmarked THEN 'unmarked_external' WHEN novel > 1 THEN 'too_many_new_terms' END AS reason FROM x5)
SELECT id, reason, len(kept)::INT AS kept, novel::INT AS novel, CASE WHEN reason IS NULL THEN md5('Boosted Explanation:' || chr(10) || chr(10) || array_to_string(CASE WHEN external THEN capped ELSE kept END, ' ')) END AS clean_text FROM x6""")
def _(v):
    lines = v.cases.filter("id % 5 < 4").select("id", F.explode(Y.fallback_lines(F.col("actual_response"))).alias("line"))
    out = Y.check_secondary(v.sql(_SECOND), lines, v.sql(_TERMS_OF), markers=MARKS)
    return out.withColumn("clean_text", F.md5("clean_text"))


_CONCEPTS = "SELECT concept_id, 'Topic ' || min(term) AS name FROM <concept_terms> WHERE concept_id <> 'c4' GROUP BY concept_id UNION ALL SELECT 'c4', 'Topic der'"
_KNOWN = "SELECT concept_id, pos, 'Where is ' || hint || '?' AS question FROM <concept_hints> WHERE concept_id <> 'c2'"
_TITLES = "SELECT lecture_number, min(topic) AS title FROM <chunks> WHERE lecture_number % 3 <> 0 GROUP BY lecture_number"


@query("q8_sub_questions", rf"""
WITH {_ROUTED.split('heads AS (')[0].strip().rstrip(',')}, {_NAMED.replace('<queries>', 'texts')}, kinds AS (SELECT query_id, type, lectures, e, CASE WHEN type = 'vague_followup' THEN 'vague' WHEN type = 'compare' AND len(e) > 2 THEN 'many' WHEN type = 'compare' AND len(e) = 2 THEN 'two'
  WHEN type = 'summary' AND len(lectures) > 0 THEN 'summary' WHEN type = 'synthesis' THEN 'synthesis' ELSE 'concept' END AS branch FROM routed),
cons AS ({_CONCEPTS}), asks AS ({_KNOWN}), titles AS ({_TITLES}), spans AS (SELECT concept_id, list_sort(list_distinct(list(lecture_number))) AS scope FROM <concept_lectures> GROUP BY 1),
first AS (SELECT query_id, concept_id, name, scope FROM named JOIN cons USING (concept_id) LEFT JOIN spans USING (concept_id) WHERE place = 1), second AS (SELECT query_id, name FROM named JOIN cons USING (concept_id) WHERE place = 2),
parts AS (SELECT query_id, branch, unnest(range(len(e))) AS pos, trim(unnest(e)) AS entity FROM kinds WHERE branch IN ('many', 'two')), keys AS (SELECT lower(term) AS k, min(concept_id) AS cid FROM <concept_terms> GROUP BY 1),
linked AS (SELECT p.*, coalesce(x.cid, y.cid) AS concept_id FROM parts p LEFT JOIN keys x ON x.k = lower(entity) LEFT JOIN keys y ON y.k = lower(string_split_regex(entity, '\s+')[1])),
tours AS (SELECT query_id, branch, unnest(lectures) AS n FROM kinds WHERE branch IN ('summary', 'synthesis')),
rows_of AS (
  SELECT query_id, 0 AS block, 0 AS pos, 'Re-explain the previous topic in simpler terms.' AS text, 'define' AS purpose, concept_id, NULL AS scope FROM kinds LEFT JOIN (SELECT query_id, concept_id FROM named WHERE place = 1) USING (query_id) WHERE branch = 'vague'
  UNION ALL SELECT query_id, 0, pos, 'What is ' || entity || '?', 'compare_side', concept_id, scope FROM linked LEFT JOIN spans USING (concept_id)
  UNION ALL SELECT query_id, 1, 0, 'How do ' || array_to_string(list_transform(e, lambda x: trim(x))[1:6], ', ') || ' differ along role, computation, and typical use?', 'mechanism', NULL, NULL FROM kinds WHERE branch = 'many'
  UNION ALL SELECT query_id, 2, 0, 'Why do these distinctions matter for speech / ML in this course?', 'connection', NULL, NULL FROM kinds WHERE branch = 'many'
  UNION ALL SELECT query_id, 1, 0, 'How do ' || trim(e[1]) || ' and ' || trim(e[2]) || ' differ in purpose and use?', 'mechanism', NULL, NULL FROM kinds WHERE branch = 'two'
  UNION ALL SELECT query_id, 2, 0, 'Why does the distinction matter for speech / ML in this course?', 'connection', NULL, NULL FROM kinds WHERE branch = 'two'
  UNION ALL SELECT query_id, 0, n, CASE WHEN branch = 'summary' THEN 'What is ' || coalesce(title, 'Lecture ' || n) || ' mainly about?' ELSE 'Core ideas from lecture ' || n || ': ' || coalesce(title, 'Lecture ' || n) END, 'lecture_anchor', NULL, [n] FROM tours LEFT JOIN titles ON lecture_number = n
  UNION ALL SELECT query_id, 1, 0, CASE WHEN branch = 'summary' THEN 'What concepts tie these sections together?' ELSE 'What progression or dependency connects these lectures?' END, 'connection', NULL, NULL FROM kinds WHERE branch IN ('summary', 'synthesis')
  UNION ALL SELECT query_id, 0, coalesce(r, 0), coalesce(question, 'What is ' || name || '?', 'Answer the student''s question using course definitions and mechanisms.'), 'define', f.concept_id, scope FROM kinds LEFT JOIN first f USING (query_id)
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY pos, question) AS r FROM asks) a ON a.concept_id = f.concept_id AND r <= 3 WHERE branch = 'concept'
  UNION ALL SELECT query_id, 1, 0, 'How do ' || f.name || ' and ' || s.name || ' relate?', 'connection', NULL, NULL FROM kinds JOIN first f USING (query_id) JOIN second s USING (query_id) WHERE branch = 'concept')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY block, pos) AS place, text, purpose, concept_id, coalesce(array_to_string(scope, ','), '') AS scope FROM rows_of""")
def _(v):
    texts = v.sql(_TEXTS)
    typed = S.query_types(texts, PATTERNS).join(texts, "query_id").select("query_id", "type", T.lecture_numbers(F.col("query_text")).alias("lectures"))
    sides = C.compare_entities(texts, sides=r"\s+(?:with|that)\s+", listing="^$", clause=r"(?s)\s+for\s.*$")
    named = K.named_concepts(texts, v.concept_terms)
    out = D.sub_questions(typed, sides, named, v.sql(_CONCEPTS), v.concept_terms, v.concept_lectures, v.sql(_KNOWN), v.sql(_TITLES))
    return out.withColumn("scope", F.array_join(F.col("scope").cast("array<string>"), ","))
