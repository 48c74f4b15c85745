"""Queries over conversations (C1-C7), query classification (Q) and answer rules (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import conversations as C
from answerlens.operators import questions as Q
from answerlens.operators import quality_rules as V
from answerlens.plans.registry import query
from answerlens.plans.text_queries import terms_sql

#: Words that occur in the tables stand for follow-up words.
WORDS = {"simpler": "there here", "clarify": "with and", "deeper": "den und", "example": "la les"}


def _kind(col: str) -> str:
    return "CASE " + " ".join(f"WHEN len(list_intersect({col}, [{', '.join(repr(w) for w in line.split())}])) > 0 THEN '{k}'" for k, line in WORDS.items()) + " END"


@query("c1_outcomes", f"""
WITH m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content_text END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked,
  lead(role) OVER (PARTITION BY session_id ORDER BY seq) AS next_role, lead(content_text) OVER (PARTITION BY session_id ORDER BY seq) AS next_text FROM <messages>),
x AS (SELECT id, {terms_sql("coalesce(asked, '')")} AS a, {terms_sql('next_text')} AS b FROM m WHERE role = 'assistant' AND next_role = 'user'),
y AS (SELECT id, {_kind('b')} AS kind, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 9) > 0.6 ELSE false END AS r FROM x)
SELECT id, coalesce(kind, CASE WHEN r THEN 'rephrase' ELSE 'new_topic' END) AS follow_up_type, r AS was_rephrased, kind IS NULL AND NOT r AS changed_topic FROM y""")
def _(v):
    return C.outcomes(v.messages, WORDS)


@query("c2_follow_up_types", f"SELECT kind, count(*) AS n FROM (SELECT {_kind('t')} AS kind FROM (SELECT {terms_sql('content_text')} AS t FROM <messages> WHERE role = 'user')) GROUP BY 1")
def _(v):
    u = v.messages.filter("role = 'user'").select(C.follow_up_type(T.query_terms(F.col("content_text")), WORDS).alias("kind"))
    return u.groupBy("kind").agg(F.count("*").alias("n"))


@query("c3_session_page", """
WITH s AS (SELECT session_id, max(created_at) AS updated_at, count(*) AS turns FROM <messages> GROUP BY 1)
SELECT *, (SELECT count(*) FROM s) AS total FROM s ORDER BY updated_at DESC, session_id DESC LIMIT 50""")
def _(v):
    return C.session_page(v.messages)


@query("c4_transcript", "SELECT m.id, session_id, seq, role, coalesce(v.boost_reason, content_text) AS text FROM <messages> m LEFT JOIN <response_variants> v ON v.message_id = m.id AND m.role = 'assistant'")
def _(v):
    mine = v.messages.filter("role = 'assistant'").select(F.col("id").alias("message_id"))
    variants = v.response_variants.join(mine, "message_id", "left_semi").select("message_id", F.col("boost_reason").alias("answer"))
    return C.transcript(v.messages, variants)


@query("c5_purged", "SELECT id, session_id FROM <messages> WHERE session_id NOT IN (SELECT session_id FROM <messages> WHERE role = 'system')")
def _(v):
    return C.purge(v.messages, v.messages.filter("role = 'system'")).select("id", "session_id")


@query("c6_latest_feedback", """
WITH f AS (SELECT message_id % 50 AS message_id, created_at, message_id AS seq, course_thumb, helpfulness_rating * 2 - 3 AS helpfulness_rating FROM <feedback>)
SELECT message_id, max_by(course_thumb, (created_at, seq)) FILTER (course_thumb IS NOT NULL) AS thumb, max_by(helpfulness_rating, (created_at, seq)) FILTER (helpfulness_rating BETWEEN 1 AND 5) AS rating, CAST(max(seq) AS VARCHAR) AS note FROM f GROUP BY 1""")
def _(v):
    f = v.feedback.select((F.col("message_id") % 50).alias("message_id"), "created_at", F.col("message_id").alias("seq"), "course_thumb", (F.col("helpfulness_rating") * 2 - 3).alias("helpfulness_rating"), F.col("message_id").cast("string").alias("note"))
    return C.latest_feedback(f)


@query("c7_quiz_grades", r"""
WITH a AS (SELECT m.id, m.id % 200 AS chunk_id, CASE WHEN m.id % 2 = 0 THEN 'choice' ELSE 'short' END AS question_type, CASE WHEN m.id % 4 = 0 THEN 'src' || (m.id % 20) ELSE m.content_text END AS given FROM <messages> m WHERE role = 'user'),
x AS (SELECT a.id, question_type, lower(trim(given)) AS g, lower(trim(k.topic)) AS t, list_distinct(list_filter(regexp_extract_all(lower(k.clean_explanation), '[a-z0-9]+'), lambda w: length(w) >= 6)) AS words FROM a JOIN <chunks> k ON k.id = a.chunk_id),
y AS (SELECT *, len(list_filter(words, lambda w: contains(g, w))) AS hits FROM x)
SELECT id, CASE WHEN question_type = 'choice' THEN CASE WHEN g = t THEN 'exact' WHEN g <> '' AND contains(t, g) THEN 'contained' ELSE 'wrong' END WHEN hits >= 2 THEN 'good' WHEN hits > 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM y""")
def _(v):
    u = v.messages.filter("role = 'user'")
    a = u.select("id", (F.col("id") % 200).alias("chunk_id"), F.when(F.col("id") % 2 == 0, "choice").otherwise("short").alias("question_type"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("src"), (F.col("id") % 20).cast("string"))).otherwise(F.col("content_text")).alias("given"))
    return C.grade_answers(a, v.chunks)


PATTERNS = [("quiz", "q_the", "the .* the", 0.9), ("quiz", "q_of", "of the", 0.4), ("compare", "c_with", "with", 0.8), ("compare", "c_and", "and", 0.35), ("summary", "s_la", "la ", 0.7)]


def _family(fam: str) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN regexp_matches(lower(content_text), '{p}') THEN {w} ELSE 0.0 END" for f, _, p, w in PATTERNS if f == fam) + ", 0.0)"


@query("q1_modes", f"""
WITH s AS (SELECT id, CAST({_family('quiz')} AS DOUBLE) AS quiz, CAST({_family('compare')} AS DOUBLE) AS compare, CAST({_family('summary')} AS DOUBLE) AS summary FROM <messages> WHERE role = 'user'),
t AS (SELECT *, list_sort([quiz, compare, summary], 'DESC') AS o FROM s)
SELECT id, CASE WHEN quiz >= 0.32 THEN 'quiz' WHEN compare >= 0.32 THEN 'compare' WHEN summary >= 0.32 THEN 'summary' ELSE 'chat' END AS mode, o[2] >= 0.32 AND o[1] - o[2] <= 0.12 AS ambiguous,
  round(CASE WHEN o[2] >= 0.32 AND o[1] - o[2] <= 0.12 THEN 0.85 ELSE 1.0 END * o[1], 6) AS confidence FROM t""")
def _(v):
    u = v.messages.filter("role = 'user'").select("id", F.col("content_text").alias("text"))
    return Q.detect_modes(u, PATTERNS)


@query("q2_override", "SELECT id, CASE WHEN lower(trim(role)) IN ('user') THEN 'chat' ELSE 'summary' END AS mode, lower(trim(role)) IN ('user') AS overridden FROM <messages>")
def _(v):
    return Q.resolve_mode(v.messages.select("id", F.when(F.col("role") == "user", "chat").alias("user_mode"), F.lit("summary").alias("detected")))


@query("q5_concepts", r"""
WITH t AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term, unnest(range(len(regexp_extract_all(lower(query_text), '[a-z0-9]+')))) AS pos FROM <queries>), f AS (SELECT query_id, concept_id, min(pos) AS first_pos FROM t JOIN <concept_terms> USING (term) GROUP BY 1, 2)
SELECT query_id, string_agg(concept_id, ',' ORDER BY first_pos, concept_id) AS concepts, count(*) AS n FROM f GROUP BY 1""")
def _(v):
    return Q.linked_concepts(v.queries, v.concept_terms)


@query("q11_underspecified", f"SELECT query_id, len({terms_sql('query_text')}) < 20 AS underspecified FROM <queries>")
def _(v):
    return v.queries.select("query_id", (F.size(T.query_terms(F.col("query_text"))) < 20).alias("underspecified"))


@query("q12_no_match_kind", "SELECT id, CASE WHEN regexp_matches(lower(trim(content_text)), '^(the|la|der)') THEN 'greeting' WHEN length(trim(content_text)) < 80 THEN 'acknowledgement' ELSE 'off_topic' END AS kind FROM <messages> WHERE role = 'user'")
def _(v):
    return v.messages.filter("role = 'user'").select("id", Q.no_match_kind(F.col("content_text"), "^(the|la|der)", 80).alias("kind"))


@query("q13_keyword_spam", r"""
WITH t AS (SELECT query_id, len(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS n, len(list_filter(regexp_extract_all(lower(query_text), '[a-z0-9]+'), lambda t: t IN ('the', 'that', 'for', 'by', 'la', 'der', 'die'))) AS hits FROM <queries>)
SELECT query_id, n, hits, n <= 60 AND hits >= 0.1 * n AS spam FROM t""")
def _(v):
    return Q.keyword_spam(v.queries, v.concept_terms, most_tokens=60, share=0.1)


@query("v1_rules", """
SELECT id, array_to_string(list_filter([CASE WHEN length(trim(actual_response)) < 200 THEN 'must_have_length' END, CASE WHEN contains(lower(actual_response), ' la ') THEN 'must_not_leak_forbidden_terms' END,
  CASE WHEN NOT contains(lower(actual_response), 'the') THEN 'must_define_primary_concept' END, CASE WHEN NOT regexp_matches(actual_response, '[.]') THEN 'must_have_sentences' END], lambda x: x IS NOT NULL), ';') AS failed,
  CASE WHEN contains(lower(actual_response), ' la ') THEN 'fail' WHEN length(trim(actual_response)) < 200 OR NOT contains(lower(actual_response), 'the') OR NOT regexp_matches(actual_response, '[.]') THEN 'weak' ELSE 'pass' END AS severity FROM <cases>""")
def _(v):
    text = F.lower("actual_response")
    rules = {
        "must_have_length": F.length(F.trim("actual_response")) >= 200, "must_not_leak_forbidden_terms": ~F.contains(text, F.lit(" la ")),
        "must_define_primary_concept": F.contains(text, F.lit("the")), "must_have_sentences": F.col("actual_response").rlike("[.]"),
    }
    x = V.run_rules(v.cases, rules)
    return x.select("id", F.array_join("failed", ";").alias("failed"), V.severity(F.col("failed"), ["must_not_leak_forbidden_terms"]).alias("severity"))


@query("v7_repeated_lines", r"""
WITH l AS (SELECT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS line FROM <documents>)
SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, line FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def _(v):
    return V.repeated_lines(v.documents)


@query("v10_repair_paths", "SELECT id, CASE WHEN contains(error_categories, 'retrieval_leakage') THEN 'refetch' WHEN contains(error_categories, 'missing') THEN 'widen' END AS path FROM <cases>")
def _(v):
    return v.cases.select("id", V.first_repair(F.split("error_categories", ";"), {"retrieval_leakage": "refetch", "missing_required_concept": "widen"}).alias("path"))


@query("v13_cleaned", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(?m)^(?:All rights|Licensed|Released)[^\n]*$', '', 'g'), '\n{2,}', chr(10), 'g'))) AS cleaned FROM <documents>")
def _(v):
    return v.documents.select("doc_id", F.md5(V.clean(F.col("text"), r"^(?:All rights|Licensed|Released)[^\n]*$")).alias("cleaned"))


@query("v14_repeated_sentences", r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM <documents>)
SELECT doc_id, sentence, count(*) AS n FROM s WHERE length(sentence) > 6 GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(v):
    return V.repeated_sentences(v.documents, longest_short=6)
