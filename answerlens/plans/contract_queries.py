"""Contracts of answers over the conversations: each assistant turn against what the user's turn before it asked for (V3, V4, V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import answer_contracts as A
from answerlens.operators import constraints as C
from answerlens.operators import quality_rules as V
from answerlens.operators import selection as Y
from answerlens.operators import structured as S
from answerlens.plans.registry import query
from answerlens.plans.routing_queries import _TEXTS, PATTERNS
from answerlens.plans.structured_queries import _INTENT, _TYPED

# The tables hold few cue words; words that occur in them stand for cues.
CONTRAST, CAUSAL, CONNECTING = " but | with ", " there|ention", ["there", "anin"]
EXAMPLES, TECHNICAL, BOILERPLATE = ["there", "hand"], "ention|inre", ["the ", "with"]
QUIZ, SUMMARY = ["The", "\nOf"], ["An"]
SHORT = 3  # their words are short too
FLAGS = {"no_examples": "(?i) for", "intuition_only": "(?i) was "}

_TURNS = """
SELECT a.id AS query_id, a.content_text AS answer, u.content_text || CASE u.session_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' lecture ' || CAST(u.seq % 7 AS STRING) || ' lecture ' || CAST(u.session_id % 23 AS STRING) ELSE ' lecture ' || CAST(u.session_id % 23 AS STRING) END AS query_text
FROM <messages> a JOIN <messages> u ON u.session_id = a.session_id AND u.seq = a.seq - 1 WHERE a.role = 'assistant' AND u.role = 'user'"""
_NAMES = "SELECT concept_id, row_number() OVER (PARTITION BY concept_id ORDER BY length(term) DESC, term) - 1 AS pos, term AS label FROM <many_concepts> WHERE term <> ''"
_PEERS = "SELECT a.concept_id, b.concept_id AS peer_id FROM (SELECT DISTINCT concept_id FROM <many_concepts>) a JOIN (SELECT DISTINCT concept_id FROM <many_concepts>) b ON ascii(b.concept_id) = ascii(a.concept_id) + 1"
_MAINS = """
SELECT lecture_number, row_number() OVER (PARTITION BY lecture_number ORDER BY concept_id) AS place, concept_id
FROM (SELECT DISTINCT lecture_number, substr(lower(split_part(clean_explanation, ' ', 2)), 1, 1) AS concept_id FROM <chunks>) k WHERE concept_id IN (SELECT concept_id FROM <many_concepts>)"""
_AXES = "SELECT a.concept_id AS low, b.concept_id AS high, a.label AS axis FROM (" + _NAMES + ") a JOIN (" + _NAMES + ") b ON ascii(b.concept_id) = ascii(a.concept_id) + 1 AND a.pos = 1 AND b.pos = 1"


def judged(v):
    """Turns with their intent, lectures, flags and the slots they name."""
    turns = v.sql(_TURNS)
    asked = turns.select("query_id", "query_text")
    sides = C.compare_entities(asked, sides=r"\s+(?:with|that)\s+", listing="^$", clause=r"(?s)\s+for\s.*$")
    intents = S.answer_plans(Y.query_types(asked, PATTERNS).withColumnRenamed("type", "query_type"), sides).select("query_id", "intent")
    flags = C.response_constraints(asked, FLAGS, "([0-9]+)", ["by ([^.]+)"]).select("query_id", *FLAGS)
    names, sides = v.sql(_NAMES), sides.withColumnRenamed("query_id", "id")
    linked = v.stored("linked", lambda: S.named_concepts(asked, v.many_concepts.filter("term <> ''")).withColumnRenamed("query_id", "id"))
    lectures = asked.select(F.col("query_id").alias("id"), F.explode(T.lecture_numbers(F.col("query_text"))).alias("lecture_number"))
    labels = A.side_labels(sides, names)
    for more in (A.plain_labels(sides, linked, names), A.anchor_labels(lectures, v.sql(_MAINS), names), A.forbidden_labels(linked, v.sql(_PEERS), names, SHORT), A.axis_labels(linked, v.sql(_AXES))):
        labels = labels.unionByName(more)
    answers = turns.join(intents, "query_id").join(flags, "query_id").withColumn("lectures", T.lecture_numbers(F.col("query_text"))).withColumnRenamed("query_id", "id")
    return A.named_slots(answers, labels)


def _failed_rules(v, rules):
    return V.run_rules(judged(v), rules).select("id", "intent", F.array_join("failed", ";").alias("failed"))


_LOW = "lower(coalesce(answer, ''))"
_EDGED = r"regexp_replace(trim(regexp_replace(regexp_replace(trim(entity), '[?.,]+$', ''), '(?i)\s+(?:in this class|for this course)\.?\s*$', '')), '[?.,]+$', '')"
_JUDGED = _TYPED.replace(_TEXTS, "SELECT query_id, query_text FROM turns") + rf""",
intents AS (SELECT query_id AS id, lectures, {_INTENT} AS intent, coalesce(e, []) AS e FROM routed), names AS ({_NAMES}), mains AS ({_MAINS}), peers AS ({_PEERS}), axes AS ({_AXES}),
tok AS (SELECT query_id AS id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term, unnest(range(len(regexp_extract_all(lower(query_text), '[a-z0-9]+')))) AS pos FROM turns),
firstly AS (SELECT id, concept_id, min(pos) AS pos FROM tok JOIN <many_concepts> USING (term) GROUP BY 1, 2), linked AS (SELECT id, concept_id, row_number() OVER (PARTITION BY id ORDER BY pos, concept_id) AS place FROM firstly),
sides AS (SELECT id, unnest(e) AS entity, unnest(range(len(e))) AS pos FROM intents), parts AS (SELECT *, lower({_EDGED}) AS part FROM sides),
resolved AS (SELECT id, pos, coalesce((SELECT min(concept_id) FROM names WHERE label = part), (SELECT min(concept_id) FROM names WHERE label = split_part(part, ' ', 1))) AS concept_id FROM parts),
side_labels AS (SELECT id, pos, lower(trim(entity)) AS label FROM parts UNION SELECT id, pos, part FROM parts UNION SELECT id, pos, left(part, length(part) - 1) FROM parts WHERE length(part) >= 5 AND part LIKE '%s' AND part NOT LIKE '%ss'
  UNION SELECT id, r.pos, label FROM resolved r JOIN names n ON n.concept_id = r.concept_id AND n.pos <= 16),
said AS (SELECT query_id AS id, {_LOW} AS low, answer, query_text FROM turns),
ns AS (SELECT id, count(DISTINCT pos) AS sides, coalesce(count(DISTINCT pos) FILTER (hit), 0) AS covered, coalesce(count(DISTINCT pos) FILTER (hit AND pos < 2), 0) AS both FROM (SELECT id, pos, length(label) >= 2 AND contains(low, label) AS hit FROM side_labels JOIN said USING (id)) GROUP BY 1),
pl AS (SELECT id, label, min(spot) AS spot FROM (SELECT id, label, CASE WHEN place <= 2 THEN place - 3 ELSE place + 100 END AS spot FROM linked JOIN names USING (concept_id) WHERE names.pos = 0 UNION ALL SELECT id, lower(trim(entity)), pos FROM sides) WHERE label <> '' GROUP BY 1, 2),
np AS (SELECT id, count(*) AS labels, count(*) FILTER (hit) AS told, count(*) FILTER (hit AND r <= 2) AS told_first FROM (SELECT id, length(label) >= 2 AND contains(low, label) AS hit, row_number() OVER (PARTITION BY id ORDER BY spot, label) AS r FROM pl JOIN said USING (id)) GROUP BY 1),
an AS (SELECT i.id, coalesce(bool_or(contains(low, label)), false) AS anchored FROM intents i JOIN said s ON s.id = i.id JOIN mains m ON m.lecture_number = i.lectures[1] LEFT JOIN names n ON n.concept_id = m.concept_id AND n.pos <= 3 AND m.place <= 6 GROUP BY 1),
alone AS (SELECT id, min(concept_id) AS concept_id FROM linked GROUP BY 1 HAVING count(*) = 1),
fo AS (SELECT DISTINCT id FROM alone JOIN peers USING (concept_id) JOIN names n ON n.concept_id = peer_id AND n.pos <= 6 JOIN said USING (id) WHERE length(label) > {SHORT} AND contains(low, label)),
ax AS (SELECT DISTINCT id FROM (SELECT id, min(concept_id) AS a, max(concept_id) AS b FROM linked WHERE place <= 2 GROUP BY 1) JOIN axes ON a = axes.low AND b = axes.high JOIN said USING (id) WHERE length(axis) >= 2 AND contains(said.low, axis)),
judged AS (SELECT i.*, s.low, s.answer, coalesce(sides, 0) AS sides, coalesce(covered, 0) AS covered, coalesce("both", 0) AS two, coalesce(labels, 0) AS labels, coalesce(told, 0) AS told, coalesce(told_first, 0) AS told_first, an.anchored, fo.id IS NOT NULL AS leaked, ax.id IS NOT NULL AS axis_named,
  regexp_matches(query_text, '{FLAGS['no_examples']}') AS no_examples, regexp_matches(query_text, '{FLAGS['intuition_only']}') AS intuition_only
  FROM intents i JOIN said s ON s.id = i.id LEFT JOIN ns ON ns.id = i.id LEFT JOIN np ON np.id = i.id LEFT JOIN an ON an.id = i.id LEFT JOIN fo ON fo.id = i.id LEFT JOIN ax ON ax.id = i.id)"""
# the routing texts already use the name `names` for their sides
_JUDGED = _JUDGED.replace("names AS (SELECT query_id, list_filter", "spelt AS (SELECT query_id, list_filter").replace("LEFT JOIN names USING (query_id)", "LEFT JOIN spelt USING (query_id)").replace('AS both FROM', 'AS "both" FROM')


def _sql(**bad: str) -> str:
    rules = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in bad.items())
    return f"WITH turns AS ({_TURNS}), {_JUDGED.strip()} SELECT id, intent, array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ';') AS failed FROM judged"


@query("v3_answer_coverage", _sql(
    must_cover_both_sides="intent = 'compare' AND sides >= 2 AND two < 2", must_cover_compare_multi="intent = 'compare_multi' AND sides >= 3 AND covered < least(sides, 4)",
    must_include_comparison_axis=f"intent IN ('compare', 'compare_multi') AND NOT regexp_matches(low, '{CONTRAST}') AND NOT axis_named", must_cover_main_anchors="intent = 'lecture_summary' AND NOT coalesce(anchored, true)",
    must_include_multiple_lectures="intent = 'cross_lecture_synthesis' AND len(lectures) >= 2 AND NOT contains(low, 'lecture')", must_name_connecting_concepts="intent = 'cross_lecture_synthesis' AND length(low) <= 400 AND NOT contains(low, 'there') AND NOT contains(low, 'anin')",
    must_answer_how_or_why=f"intent IN ('multi_step_explanation', 'scoped_explanation') AND NOT regexp_matches(low, '{CAUSAL}') AND NOT contains(low, 'step')",
))
def _(v):
    return _failed_rules(v, A.coverage_contract(CONTRAST, CAUSAL, CONNECTING))


@query("v4_answer_restrictions", _sql(
    must_not_leak_forbidden_terms="intent NOT IN ('compare', 'compare_multi') AND leaked", must_not_have_examples_when_blocked="no_examples AND (contains(low, 'there') OR contains(low, 'hand'))",
    must_not_have_technical_when_intuition_only=f"intuition_only AND regexp_matches(low, '{TECHNICAL}')", must_not_be_boilerplate_summary="intent = 'lecture_summary' AND contains(low, 'the ') AND contains(low, 'with')",
))
def _(v):
    return _failed_rules(v, A.restriction_contract(EXAMPLES, TECHNICAL, BOILERPLATE))


@query("v6_answer_layouts", _sql(
    must_match_quiz_contract="intent = 'teaching_plus_check' AND (contains(answer, 'The') OR contains(answer, chr(10) || 'Of'))", must_match_summary_contract="intent = 'lecture_summary' AND contains(answer, 'An')",
    must_match_compare_contract="intent IN ('compare', 'compare_multi') AND labels >= 2 AND NOT CASE WHEN intent = 'compare_multi' THEN told >= 2 WHEN sides >= 2 THEN two = 2 ELSE told_first = 2 END",
))
def _(v):
    return _failed_rules(v, A.layout_contract(QUIZ, SUMMARY))
