"""Queries about what a query asks of its answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.operators import constraints as C
from answerlens.operators import questions as Q
from answerlens.operators import quality_rules as V
from answerlens.operators import selection as S
from answerlens.plans.registry import query
from answerlens.plans.retrieval_queries import _LEX, hits
from answerlens.plans.selection_queries import _ALLOWED, _LINES, FORBIDDEN, PATTERNS, TARGETS, lines

# The tables hold few question words; words that occur in them stand for cues.
_WORD, _EDGE = "regexp_extract_all(lower(query_text), '[a-z0-9]+')", r"'^\s+|[\s?.,;:]+$', '', 'g'"


def _sql_parts(c: str, sep: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({c}, '{sep}'), lambda x: regexp_replace(x, {_EDGE})), lambda x: x <> '')"


@query("q4_compare_entities", rf"""
WITH b AS (SELECT query_id, {_sql_parts(rf"regexp_replace(trim(string_split(query_text, '?')[1]), {_EDGE})", r'\s+with\s+')} AS two, {_sql_parts(r"regexp_extract(query_text, '(?s)the\s+(.+)$', 1)", r',|\band\b')} AS items FROM <queries>),
f AS (SELECT query_id, (CASE WHEN len(two) >= 2 THEN two WHEN len(items) >= 3 THEN items END)[1:8] AS f FROM b),
e AS (SELECT query_id, list_filter(list_transform(f, lambda x: regexp_replace(regexp_replace(string_split(x, ':')[1], '(?s)\s+for\s.*$', ''), {_EDGE})), lambda x: x <> '') AS e FROM f)
SELECT query_id, unnest(range(len(e))) AS pos, unnest(e) AS entity FROM e""")
def _(v):
    return C.compare_entities(v.queries, sides=r"\s+with\s+", listing=r"(?s)the\s+(.+)$", clause=r"(?s)\s+for\s.*$")


@query("q10_response_constraints", rf"""
WITH c AS (SELECT query_id, query_text, flatten(list_transform(list_concat(regexp_extract_all(query_text, 'by ([^.]+)', 1), regexp_extract_all(query_text, 'from ([^.]+)', 1)), lambda c: {_sql_parts('lower(c)', r',|\s+or\s+|\s+and\s+')})) AS topics FROM <queries>),
u AS (SELECT *, list_filter(topics, lambda x: length(x) >= 2) AS k FROM c)
SELECT query_id, regexp_matches(query_text, '(?i)that') AS no_examples, regexp_matches(query_text, '(?i)with') AS brief, CASE WHEN TRY_CAST(regexp_extract(query_text, '([0-9]+)', 1) AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(regexp_extract(query_text, '([0-9]+)', 1) AS INT) END AS asked_count,
  array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '; ') AS forbidden FROM u""")
def _(v):
    return C.response_constraints(v.queries, {"no_examples": "(?i)that", "brief": "(?i)with"}, "([0-9]+)", ["by ([^.]+)", "from ([^.]+)"])


@query("q14_complexity", rf"""
WITH t AS (SELECT query_id, unnest({_WORD}) AS term FROM <queries>), n AS (SELECT query_id, count(DISTINCT concept_id) AS n FROM t JOIN <concept_terms> USING (term) GROUP BY 1)
SELECT q.query_id, CASE WHEN coalesce(n, 0) >= 3 OR (NOT regexp_matches(lower(q.query_text), '^the ') AND (regexp_matches(lower(q.query_text), ' with .* with ') OR (NOT regexp_matches(lower(q.query_text), '^la ') AND regexp_matches(lower(q.query_text), ' and .* and .* and ')))) THEN 'complex' ELSE 'simple' END AS label
FROM <queries> q LEFT JOIN n ON n.query_id = q.query_id""")
def _(v):
    parts = Q.linked_concepts(v.queries, v.concept_terms).select("query_id", F.col("n").alias("parts"))
    return C.complexity(S.query_types(v.queries, PATTERNS).join(parts, "query_id", "left"))


_PEERS = "VALUES ('c1', 'c2'), ('c2', 'c1'), ('c3', 'c4'), ('c4', 'c3')"


@query("r40_term_roles", rf"""
WITH t AS (SELECT query_id, unnest({_WORD}) AS term FROM <queries>), l AS (SELECT DISTINCT query_id, concept_id FROM t JOIN <concept_terms> USING (term)), p AS (SELECT * FROM ({_PEERS}) AS p(concept_id, peer_id)),
r AS (SELECT query_id, count(*) >= 2 AS relational FROM l GROUP BY 1), tg AS (SELECT DISTINCT query_id, k.term FROM l JOIN <concept_terms> k USING (concept_id)),
fb AS (SELECT DISTINCT query_id, k.term FROM l JOIN p USING (concept_id) JOIN <concept_terms> k ON k.concept_id = p.peer_id)
SELECT x.*, relational FROM (SELECT query_id, term, 'target' AS role FROM tg UNION ALL SELECT query_id, term, 'forbidden' FROM fb WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM tg)) x JOIN r ON r.query_id = x.query_id""")
def _(v):
    linked = Q.linked_concepts(v.queries, v.concept_terms).select("query_id", F.explode(F.split("concepts", ",")).alias("concept_id"))
    return C.term_roles(linked, v.concept_terms, v.sql(f"SELECT * FROM ({_PEERS}) AS p(concept_id, peer_id)"))


@query("r44_shared_lines", f"""
WITH {_LEX}, {_LINES}, {_ALLOWED}, s AS (SELECT query_id - query_id % 2 AS query_id, query_id % 2 AS side, place, line FROM allowed), b AS (SELECT query_id FROM s GROUP BY 1 HAVING count(DISTINCT side) = 2),
once AS (SELECT query_id, lower(trim(line)) AS key, min((side, place, line)) AS x FROM s WHERE query_id IN (SELECT query_id FROM b) GROUP BY 1, 2),
n AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY x) AS place, trim(struct_extract(x, 3)) AS line FROM once) SELECT * FROM n WHERE place <= 5""")
def _(v):
    x = S.allowed_lines(lines(v), TARGETS, FORBIDDEN)
    return C.shared_lines(x.filter("query_id % 2 = 0"), x.filter("query_id % 2 = 1").withColumn("query_id", F.col("query_id") - 1))


def _failed(**bad: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in bad.items()) + "], lambda x: x IS NOT NULL), ';')"


_LOW = "lower(coalesce(actual_response, ''))"


def _checked(v, rules):
    return V.run_rules(v.cases, rules).select("id", F.array_join("failed", ";").alias("failed"))


@query("v3_coverage", "SELECT id, " + _failed(
    must_cover_both_sides=f"expected_mode = 'compare' AND NOT (contains({_LOW}, 'the') AND contains({_LOW}, 'that'))",
    must_cover_compare_multi=f"expected_mode = 'compare' AND CAST(contains({_LOW}, 'the') AS INT) + CAST(contains({_LOW}, 'that') AS INT) + CAST(contains({_LOW}, 'with') AS INT) < 3",
    must_include_comparison_axis=f"expected_mode = 'compare' AND NOT regexp_matches({_LOW}, 'with|but')", must_answer_how_or_why=f"expected_mode = 'chat' AND NOT regexp_matches({_LOW}, 'for|there')",
) + " AS failed FROM <cases>")
def _(v):
    return _checked(v, C.coverage_rules(F.col("actual_response"), F.col("expected_mode"), ["the", "that", "with"], contrast="with|but", causal="for|there"))


@query("v4_restrictions", "SELECT id, " + _failed(
    must_not_leak_forbidden_terms=f"expected_mode = 'chat' AND regexp_matches({_LOW}, ' la ')", must_not_have_examples=f"critical AND regexp_matches({_LOW}, 'there|here')",
) + " AS failed FROM <cases>")
def _(v):
    return _checked(v, C.restriction_rules(F.col("actual_response"), {"must_not_leak_forbidden_terms": (F.col("expected_mode") == "chat", " la "), "must_not_have_examples": (F.col("critical"), "there|here")}))


@query("v6_layout", "SELECT id, " + _failed(
    must_match_summary_contract="expected_mode = 'summary' AND trim(actual_response) <> '' AND (contains(actual_response, 'All rights') OR contains(actual_response, 'The '))", must_match_chat_contract="expected_mode = 'chat' AND trim(actual_response) <> '' AND contains(actual_response, 'Licensed')",
) + " AS failed FROM <cases>")
def _(v):
    return _checked(v, C.layout_rules(F.col("actual_response"), F.col("expected_mode"), {"summary": ["All rights", "The "], "chat": ["Licensed"]}))


@query("v11_soft_flags", f"SELECT id, length(coalesce(actual_response, '')) < 120 AND NOT contains({_LOW}, 'the') AS generic_answer, expected_mode = 'compare' AND NOT (contains({_LOW}, 'the') AND contains({_LOW}, 'that')) AS missing_side, regexp_matches({_LOW}, 'all rights|cookie') AS generic_filler FROM <cases>")
def _(v):
    return C.soft_flags(v.cases, F.col("actual_response"), F.col("expected_mode"), ["the", "that"], ["the"], "all rights|cookie").select("id", "generic_answer", "missing_side", "generic_filler")


@query("g4_structural_errors", """
WITH k AS (SELECT source AS concept_id, CASE WHEN lang = 'en' THEN lang || (doc_id % 7) ELSE NULLIF(lang, 'de') END AS term FROM <documents>), x AS (SELECT concept_id, count(term) AS n, count(DISTINCT lower(term)) AS u, count(*) FILTER (trim(term) = '') AS blank FROM k GROUP BY 1),
e AS (SELECT concept_id, unnest([CASE WHEN concept_id IS NULL THEN 'no_id' END, CASE WHEN n = 0 THEN 'no_terms' END, CASE WHEN blank > 0 THEN 'blank_term' END, CASE WHEN u < n THEN 'repeated_term' END]) AS error FROM x) SELECT * FROM e WHERE error IS NOT NULL""")
def _(v):
    term = F.when(F.col("lang") == "en", F.concat("lang", (F.col("doc_id") % 7).cast("string"))).otherwise(F.nullif("lang", F.lit("de")))
    return C.structural_errors(v.documents.select(F.col("source").alias("concept_id"), term.alias("term")))


@query("r11_augmented_queries", rf"""
WITH t AS (SELECT query_id, unnest({_WORD}) AS term, unnest(range(len({_WORD}))) AS pos FROM <queries>), l AS (SELECT query_id, concept_id, min(pos) AS pos FROM t JOIN <concept_terms> USING (term) GROUP BY 1, 2),
kb AS (SELECT concept_id, 0 AS kind, 0 AS at, term FROM <concept_terms> UNION ALL SELECT concept_id, 1, pos, hint FROM <concept_hints>),
x AS (SELECT l.query_id, k.term, min((l.pos, l.concept_id, kind, k.at)) AS spot FROM l JOIN kb k USING (concept_id) JOIN <queries> q ON q.query_id = l.query_id WHERE NOT contains(lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))), k.term) GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(len(regexp_extract_all(term, '[a-z0-9]+'))) OVER (PARTITION BY query_id ORDER BY spot, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
m AS (SELECT query_id, string_agg(term, ' ' ORDER BY spot, term) AS more FROM r WHERE before < 18 GROUP BY 1)
SELECT q.query_id, query_text || coalesce(' ' || more, '') AS text FROM <queries> q LEFT JOIN m ON m.query_id = q.query_id""".replace(" AS at,", " AS spot_at,").replace("k.at", "k.spot_at"))
def _(v):
    linked = Q.linked_concepts(v.queries, v.concept_terms).select("query_id", F.posexplode(F.split("concepts", ",")).alias("pos", "concept_id"))
    return C.augmented_queries(v.queries, linked, v.concept_terms, v.concept_hints)


@query("r47_model_input", f"""
WITH {_LEX}, h AS (SELECT query_id, CASE WHEN rank <= 4 THEN 'primary' ELSE 'supporting' END AS section, id, rank FROM ranked WHERE rank <= 8),
o AS (SELECT query_id, lower(trim(source_excerpt)) AS key, min((section, rank, h.id, trim(source_excerpt))) AS x FROM h JOIN <chunks> k ON k.id = h.id WHERE trim(source_excerpt) <> '' GROUP BY 1, 2)
SELECT query_id, struct_extract(x, 1) AS section, count(*) AS n, substr(string_agg(struct_extract(x, 4), chr(10) ORDER BY x), 1, 8000) AS text FROM o GROUP BY 1, 2""".replace("\no AS", "\nonce AS").replace("FROM o GROUP", "FROM once GROUP"))
def _(v):
    h = hits(v, 8).select("query_id", F.when(F.col("rank") <= 4, "primary").otherwise("supporting").alias("section"), "id", "rank")
    return C.model_input(h, v.chunks, text_col="source_excerpt")
