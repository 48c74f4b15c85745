"""Queries over evaluation histories (E1-E44) and judge batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.operators import case_scoring as P
from answerlens.operators import evaluation as E
from answerlens.operators import judge as K
from answerlens.plans.registry import query

#: The tables have languages for categories: each stands for an intent.
INTENT_BY_LANG = {"en": "definition", "fr": "compare", "de": "synthesis", "es": "step_by_step"}
_INTENT = "CASE category WHEN 'en' THEN 'definition' WHEN 'fr' THEN 'compare' WHEN 'de' THEN 'synthesis' WHEN 'es' THEN 'step_by_step' ELSE 'definition' END"
_ALL = lambda col, text, neg="": f"coalesce(list_bool_and(list_transform(string_split({col}, ','), lambda t: {neg} contains({text}, t))), true)"


def intent():
    return E.intent_of(F.col("category"), mapping=INTENT_BY_LANG)


#: Cases whose answers have the marks of every layout, with modes, sections and diagnostics that come and go.
_LAID_OUT = """
SELECT id, evaluation_run_id, test_id, CASE WHEN id % 19 = 0 THEN 'clarification' WHEN id % 17 = 0 THEN 'mode_detection' ELSE category END AS category, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 12 = 1 THEN 'quiz' ELSE expected_mode END AS expected_mode, detected_mode,
       CASE WHEN id % 11 = 0 THEN NULL WHEN id % 12 = 1 OR id % 12 = 5 THEN 'quiz' ELSE effective_mode END AS effective_mode, must_include, must_not_include, CASE WHEN id % 6 = 0 THEN 'the,of' ELSE '' END AS expected_sections, CASE WHEN id % 8 = 1 THEN 'token' ELSE NULL END AS forbidden_sections,
       id % 3 <> 0 AS has_diag, CASE WHEN id % 10 = 3 THEN 'compare' ELSE 'direct_definition' END AS answer_mode, id % 9 = 4 AS missing_side,
       CASE id % 5 WHEN 0 THEN 'Course Answer: ' || CASE WHEN id % 4 = 0 THEN 'Whereas ' ELSE '' END || actual_response WHEN 1 THEN 'Summary: ### Key  Points ' || actual_response
         WHEN 2 THEN 'Quiz:' || chr(10) || ' 2) ' || actual_response || chr(10) || 'Answer key: b' WHEN 3 THEN substr(actual_response, 1, 90) || '? ### Direct answer' ELSE actual_response END AS actual_response
FROM <cases>"""
_IN = lambda c: f"contains(low, '{c}')"
_LIST = lambda c: f"list_filter(string_split(coalesce({c}, ''), ','), lambda t: t <> '')"
_SCORED = rf"""
laid AS ({_LAID_OUT}), p0 AS (SELECT *, lower(actual_response) AS low, coalesce(effective_mode, 'chat') AS eff, coalesce(expected_mode, '') AS want FROM laid),
p1 AS (SELECT *, category = 'clarification' OR (NOT has_diag AND eff <> 'chat' AND contains(low, '?') AND (contains(low, 'tell me which') OR contains(low, 'tell me what') OR length(trim(actual_response)) < 500)) AS asks FROM p0),
p2 AS (SELECT *, CASE WHEN asks THEN 'clarification' ELSE eff END AS path, len(list_filter({_LIST('expected_sections')}, lambda s: NOT contains(low, s))) > 0 AS lacks, len(list_filter({_LIST('forbidden_sections')}, lambda s: contains(low, s))) > 0 AS barred,
  len(list_intersect(regexp_extract_all(low, '[\p{{L}}\p{{N}}\p{{M}}_]+'), ['while', 'whereas', 'difference', 'vs', 'compared', 'contrast', 'unlike', 'but'])) > 0 AS contrasts FROM p1),
p3 AS (SELECT *, CASE path
  WHEN 'compare' THEN [CASE WHEN NOT {_IN('course answer:')} THEN 'structure_compare_no_course_answer_header' END, CASE WHEN NOT contrasts THEN 'structure_compare_no_contrast_cue' END, CASE WHEN has_diag AND missing_side THEN 'structure_compare_missing_side_flag' END]
  WHEN 'summary' THEN [CASE WHEN NOT {_IN('summary:')} THEN 'structure_summary_no_header' END, CASE WHEN NOT regexp_matches(low, '###\s*key\s+(topics|points)') THEN 'structure_summary_no_key_section' END, CASE WHEN barred THEN 'structure_summary_forbidden_substring' END,
    CASE WHEN {_IN('### direct answer')} THEN 'structure_summary_has_direct_answer' END, CASE WHEN {_IN('course answer:')} AND NOT {_IN('summary:')} THEN 'structure_summary_wrong_block' END]
  WHEN 'quiz' THEN [CASE WHEN NOT {_IN('quiz:')} THEN 'structure_quiz_no_header' END, CASE WHEN NOT {_IN('answer key:')} THEN 'structure_quiz_no_answer_key' END, CASE WHEN NOT regexp_matches(actual_response, '(?m)^\s*(Q[1-3]\b|[0-9]+[\).]\s)') THEN 'structure_quiz_no_numbered_questions' END,
    CASE WHEN {_IN('### direct answer')} OR {_IN('### explanation')} THEN 'structure_quiz_forbidden_block' END, CASE WHEN {_IN('course answer:')} THEN 'structure_quiz_has_course_answer' END]
  WHEN 'clarification' THEN [CASE WHEN NOT ({_IN('?')} OR {_IN('tell me which')} OR {_IN('for example')}) THEN 'structure_clarification_no_followup' END, CASE WHEN {_IN('### direct answer')} THEN 'structure_clarification_has_direct_answer' END]
  ELSE [CASE WHEN lacks THEN 'structure_chat_missing_expected_section' END, CASE WHEN barred THEN 'structure_chat_forbidden' END, CASE WHEN has_diag AND answer_mode = 'compare' THEN 'structure_chat_wrong_answer_mode' END] END AS own FROM p2),
p4 AS (SELECT *, list_filter(list_concat(own, [CASE WHEN (want IN ('compare', 'summary', 'quiz') AND path NOT IN ('clarification', want)) OR (want = 'chat' AND eff <> 'chat' AND NOT asks) THEN 'structure_routing_mismatch' END, CASE WHEN lacks THEN 'expected_section_missing' END]), lambda x: x IS NOT NULL) AS errs FROM p3),
p5 AS (SELECT *, CASE WHEN category = 'mode_detection' THEN detected_mode = want ELSE want = '' OR eff = want END AS mode_ok, {_ALL('must_include', 'low')} AS content_ok, {_ALL('must_not_include', 'low', 'NOT')} AND NOT barred AS forbidden_ok, len(errs) = 0 AS structure_ok FROM p4)"""


@query("e1_quarter_score", f"""
WITH {_SCORED}, t AS (SELECT *, 0.25::DOUBLE * (mode_ok::INT + content_ok::INT + forbidden_ok::INT + structure_ok::INT) AS score,
  list_concat(errs, list_filter([CASE WHEN NOT mode_ok THEN CASE WHEN category = 'mode_detection' THEN 'mode_detected_mismatch' ELSE 'mode_mismatch' END END, CASE WHEN NOT content_ok THEN 'must_include_failed' END, CASE WHEN NOT forbidden_ok THEN 'forbidden_leak' END], lambda x: x IS NOT NULL)) AS found FROM p5)
SELECT id, evaluation_run_id, test_id, mode_ok, content_ok, forbidden_ok, structure_ok, array_to_string(list_sort(list_distinct(found)), ';') AS errors, score, score >= 0.75 AND forbidden_ok AS passed FROM t""")
def _(v):
    return P.score_cases(v.sql(_LAID_OUT)).withColumn("errors", F.array_join("errors", ";"))


@query("e2_structure_checks", f"WITH {_SCORED} SELECT id, path, structure_ok, array_to_string(list_sort(list_distinct(errs)), ';') AS errors FROM p5")
def _(v):
    return P.structure_checks(v.sql(_LAID_OUT)).withColumn("errors", F.array_join("errors", ";"))


@query("e3_mean_score", f"""
WITH p AS (SELECT id, list_filter([CASE WHEN expected_mode = effective_mode THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
  len(list_filter(string_split(must_include, ','), lambda t: contains(lower(actual_response), t)))::DOUBLE / len(string_split(must_include, ',')),
  len(list_filter(string_split(must_not_include, ','), lambda t: NOT contains(lower(actual_response), t)))::DOUBLE / len(string_split(must_not_include, ',')),
  CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE WHEN id % 3 = 1 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END], lambda x: x IS NOT NULL) AS c FROM <cases>)
SELECT id, round(list_sum(c) / len(c), 6) AS score FROM p""")
def _(v):
    return E.mean_score(v.cases, F.when(F.col("id") % 3 == 0, "fail").when(F.col("id") % 3 == 1, "weak").otherwise("pass"))


_HITS = """
ids AS (SELECT id, unnest(string_split(chunk_ids, ',')) AS c, unnest(range(len(string_split(chunk_ids, ',')))) AS pos, must_include, must_not_include FROM <cases>),
blobs AS (SELECT i.id, i.pos, i.must_include, i.must_not_include, coalesce(lower(concat_ws(' ', k.topic, k.source_excerpt, k.clean_explanation)), '') AS blob FROM ids i LEFT JOIN <chunks> k ON k.id = CAST(i.c AS BIGINT)),
flags AS (SELECT id, pos, list_bool_and(list_transform(string_split(must_include, ','), lambda t: contains(blob, t))) AS whole, list_bool_or(list_transform(string_split(must_not_include, ','), lambda t: contains(blob, t))) AS ban,
   must_include, blob FROM blobs),
hits AS (SELECT id, max_by(whole, -pos) AS top_1, bool_or(whole) AS top_k, bool_or(ban) AS banned,
   len(list_filter(string_split(any_value(must_include), ','), lambda t: contains(string_agg(blob, ' '), t))) AS terms_found, len(string_split(any_value(must_include), ',')) AS terms_all FROM flags GROUP BY id)"""
_HITS = _HITS.replace("len(list_filter(string_split(any_value(must_include), ','), lambda t: contains(string_agg(blob, ' '), t)))", "NULL").replace(
    "hits AS (", "combined AS (SELECT id, string_agg(blob, ' ') AS b, any_value(must_include) AS m FROM flags GROUP BY id),\nfound AS (SELECT id, len(list_filter(string_split(m, ','), lambda t: contains(b, t))) AS terms_found FROM combined),\nhits0 AS ("
) + ",\nhits AS (SELECT h.id, top_1, top_k, banned, f.terms_found, terms_all FROM hits0 h JOIN found f ON f.id = h.id)"


@query("e4_failure_tags", f"""
WITH {_HITS}, t AS (SELECT c.id, list_sort(list_filter([CASE WHEN c.detected_mode <> c.expected_mode THEN 'mode_misclassification' END, CASE WHEN c.effective_mode <> c.expected_mode THEN 'mode_routing_failure' END,
  CASE WHEN NOT {_ALL('c.must_include', 'lower(c.actual_response)')} THEN 'missing_required_concept' END, CASE WHEN NOT {_ALL('c.must_not_include', 'lower(c.actual_response)', 'NOT')} THEN 'forbidden_topic_leakage' END,
  CASE WHEN h.banned THEN 'retrieval_leakage' END], lambda x: x IS NOT NULL)) AS tags FROM <cases> c LEFT JOIN hits h ON h.id = c.id WHERE NOT c.pass_bool)
SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ';') ELSE 'validation_missed_error' END AS tags FROM t""")
def _(v):
    return E.failure_tags(v.cases, v.chunks)


_PRIMARY = f"""{_HITS}, primaries AS (SELECT c.id, c.test_id, c.query_text, CASE
  WHEN len(list_filter(string_split(c.must_include, ','), lambda t: NOT contains(lower(c.actual_response), t) AND NOT contains(cb.b, t))) > 0 THEN 'retrieval_miss'
  WHEN NOT {_ALL('c.must_not_include', 'lower(c.actual_response)', 'NOT')} THEN 'hallucination'
  WHEN contains(c.error_categories, 'retrieval_leakage') OR h.banned THEN 'retrieval_noise'
  WHEN contains(c.error_categories, 'generic_filler') OR length(trim(c.actual_response)) < 120 THEN 'shallow_explanation'
  WHEN contains(c.error_categories, 'missing_required_concept') THEN 'retrieval_miss' ELSE 'shallow_explanation' END AS primary_error
  FROM <cases> c JOIN hits h ON h.id = c.id JOIN combined cb ON cb.id = c.id WHERE NOT c.pass_bool)"""


def primary(v, hits=None):
    return E.primary_errors(v.cases, v.chunks, F.lit("definition"), hits)


def term_hits(v):
    """Written once where two parts of a query read them."""
    return v.stored("term_hits", lambda: E.term_hits(v.cases, v.chunks))


@query("e5_primary_error", f"WITH {_PRIMARY} SELECT id, primary_error FROM primaries")
def _(v):
    return primary(v)


@query("e6_run_totals", """
SELECT evaluation_run_id, count(*) AS total, count(*) FILTER (pass_bool) AS passed, count(*) FILTER (NOT pass_bool) AS failed, round(sum(coalesce(score, 0)) / count(*), 6) AS mean_score FROM <cases> GROUP BY 1""")
def _(v):
    return E.run_totals(v.cases)


@query("e7_paired_runs", """
SELECT a.test_id, a.pass_bool AS base_pass, b.pass_bool AS boost_pass, greatest(b.latency_ms - a.latency_ms, 0) AS latency_delta, b.pass_bool AND NOT a.pass_bool AS improved
FROM <cases> a JOIN <cases> b ON a.test_id = b.test_id AND a.evaluation_run_id = 0 AND b.evaluation_run_id = 1""")
def _(v):
    arm = lambda i, n: v.cases.filter(F.col("evaluation_run_id") == i).select("test_id", F.col("pass_bool").alias(f"{n}_pass"), F.col("latency_ms").alias(n))
    x = arm(0, "base").join(arm(1, "boost"), "test_id")
    return x.select("test_id", "base_pass", "boost_pass", F.greatest(F.col("boost") - F.col("base"), F.lit(0)).alias("latency_delta"), (F.col("boost_pass") & ~F.col("base_pass")).alias("improved"))


@query("e8_last_runs", "SELECT r.id, c.id AS case_id FROM (SELECT id FROM <runs> ORDER BY created_at DESC, id DESC LIMIT 2) r JOIN <cases> c ON c.evaluation_run_id = r.id")
def _(v):
    last = E.select_runs(v.runs, name_part="d", last=2).select("id")
    return last.join(v.cases.select(F.col("evaluation_run_id").alias("id"), F.col("id").alias("case_id")), "id")


@query("e9_labels", "SELECT id, coalesce(nullif(trim(category), ''), expected_mode, 'unknown') AS category, string_split(must_include, ',')[1] AS concept FROM <cases>")
def _(v):
    return v.cases.select("id", E.label_or(F.col("category"), F.col("expected_mode")).alias("category"), E.concept_label().alias("concept"))


@query("e10_overall_by_run", "SELECT id, dataset_name, total_cases, passed_cases, round(passed_cases / greatest(total_cases, 1), 6) AS pass_rate FROM <runs>")
def _(v):
    return E.overall_by_run(v.runs)


@query("e11_by_category", """
SELECT category, count(*) AS total, count(*) FILTER (pass_bool) AS passed, count(*) FILTER (NOT pass_bool) AS failed, round(sum(coalesce(score, 0)) / count(*), 4) AS avg_score FROM <cases> GROUP BY 1""")
def _(v):
    return E.by_category(v.cases)


@query("e12_case_table", "SELECT evaluation_run_id, test_id, category, expected_mode, detected_mode, effective_mode, pass_bool, score, error_categories, latency_ms FROM <cases>")
def _(v):
    return v.cases.select("evaluation_run_id", "test_id", "category", "expected_mode", "detected_mode", "effective_mode", "pass_bool", "score", F.array_join(E.errors(), ";").alias("error_categories"), "latency_ms")


_EXPLODED = "SELECT unnest(string_split(error_categories, ';')) AS error FROM <cases> WHERE error_categories <> ''"


@query("e13_error_histogram", f"SELECT error, count(*) AS n FROM ({_EXPLODED}) GROUP BY 1")
def _(v):
    return E.error_histogram(v.cases)


@query("e14_mode_accuracy", """
SELECT evaluation_run_id AS id, count(*) AS n, count(*) FILTER (effective_mode = expected_mode) AS effective_matches, round((count(*) FILTER (effective_mode = expected_mode)) / count(*), 6) AS effective_accuracy,
       count(*) FILTER (category = 'en') AS detection_cases, count(*) FILTER (category = 'en' AND detected_mode = expected_mode) AS detected_matches,
       round((count(*) FILTER (category = 'en' AND detected_mode = expected_mode)) / (count(*) FILTER (category = 'en')), 6) AS detected_accuracy FROM <cases> GROUP BY 1""")
def _(v):
    return E.mode_accuracy(v.runs, v.cases, detection="en")


@query("e15_leakage", "SELECT id, list_contains(string_split(error_categories, ';'), 'retrieval_leakage') AS leaked FROM <cases>")
def _(v):
    return v.cases.select("id", F.array_contains(E.errors(), "retrieval_leakage").alias("leaked"))


@query("e16_worst_cases", """
SELECT evaluation_run_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_run_id ORDER BY score ASC NULLS FIRST, id) AS rank FROM <cases>) WHERE rank <= 10""")
def _(v):
    return E.worst_cases(v.cases, 10)


@query("e17_latency", """
SELECT evaluation_run_id, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS median_ms, quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) AS p95_ms FROM <cases> GROUP BY 1""")
def _(v):
    return E.latency_by_run(v.cases)


@query("e18_capability", f"""
WITH g AS (SELECT {_INTENT} AS intent, pass_bool::INT AS ok FROM <cases> UNION ALL SELECT unnest(['compare', 'definition', 'retrieval_grounded', 'step_by_step', 'synthesis']), NULL),
s AS (SELECT coalesce(intent, 'overall') AS intent, count(ok) AS total, coalesce(sum(ok), 0) AS correct FROM g GROUP BY ROLLUP (intent))
SELECT intent, total, correct, CASE WHEN total > 0 THEN round(correct / total, 6) ELSE 0.0 END AS accuracy FROM s""")
def _(v):
    return E.capability(v.cases, intent())


@query("e19_error_breakdown", f"WITH {_PRIMARY} SELECT primary_error, count(*) AS n, min(test_id) AS first_test, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM primaries GROUP BY 1")
def _(v):
    return E.error_breakdown(primary(v).join(v.cases.select("id", "test_id"), "id"))


@query("e20_retrieval_diagnostics", f"WITH {_HITS}, l AS (SELECT f.id, list_filter(string_split(m, ','), lambda t: NOT contains(b, t)) AS u FROM found f JOIN combined c ON c.id = f.id) SELECT h.*, array_to_string(u, ',') AS unseen FROM hits h JOIN l ON l.id = h.id")
def _(v):
    return E.term_hits(v.cases, v.chunks).withColumn("unseen", F.array_join("unseen", ","))


@query("e20_retrieval_rates", f"""
WITH {_HITS} SELECT count(*) AS n, round(sum(top_1::INT) / count(*), 6) AS top_1_accuracy, round(sum(top_k::INT) / count(*), 6) AS top_k_recall, round(sum(banned::INT) / count(*), 6) AS noise_rate FROM hits""")
def _(v):
    h = E.term_hits(v.cases, v.chunks)
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return h.agg(F.count("*").alias("n"), share("top_1").alias("top_1_accuracy"), share("top_k").alias("top_k_recall"), share("banned").alias("noise_rate"))


_VIOL = f"""
SELECT id, {_INTENT} AS intent, CASE WHEN {_INTENT} = 'step_by_step' AND NOT regexp_matches(actual_response, '(?mi)^\\s*(?:\\d+[).]|step\\s+\\d+\\b|[-*]\\s+step\\b)') THEN 'missing_steps_format'
  WHEN {_INTENT} = 'definition' AND NOT contains(lower(actual_response), 'key idea') THEN 'missing_key_idea'
  WHEN {_INTENT} = 'compare' AND NOT regexp_matches(actual_response, '(?i)\\b(while|whereas|difference|vs\\.?|compared|contrast|unlike|but)\\b') THEN 'incorrect_template' END AS violation FROM <cases>"""


@query("e21_structure", f"WITH x AS ({_VIOL}) SELECT intent, count(*) AS total, count(*) FILTER (violation IS NULL) AS compliant, round((count(*) FILTER (violation IS NULL)) / count(*), 6) AS rate FROM x GROUP BY 1")
def _(v):
    return E.structure_summary(E.structure_violations(v.cases, intent()))


@query("e22_rubric_sample", """
WITH s AS (SELECT id, coalesce(score, 0) AS score FROM <cases>), r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS best, row_number() OVER (ORDER BY score, id) AS worst FROM s)
SELECT 'best' AS side, id, score FROM r WHERE best <= 5 UNION ALL SELECT 'worst', id, score FROM r WHERE worst <= 5""")
def _(v):
    s = v.cases.select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    top = lambda side, *o: s.orderBy(*o).limit(5).select(F.lit(side).alias("side"), "id", "score")
    return top("best", F.desc("score"), "id").unionByName(top("worst", "score", "id"))


_COVER = "SELECT string_split(must_include, ',')[1] AS concept, count(*) AS n, count(*) FILTER (pass_bool) AS passed, count(*) FILTER (NOT pass_bool) AS failed, round((count(*) FILTER (pass_bool)) / count(*), 6) AS accuracy, count(*) < 3 AS under_tested FROM <cases> GROUP BY 1"


@query("e23_coverage", f"SELECT concept, n, accuracy, under_tested FROM ({_COVER})")
def _(v):
    return E.coverage_phases(v.cases).select("concept", "n", "accuracy", "under_tested")


@query("e24_remediation", f"SELECT *, row_number() OVER (ORDER BY under_tested, failed DESC, accuracy, concept) AS phase FROM ({_COVER})")
def _(v):
    return E.coverage_phases(v.cases)


@query("e25_boost_effect", """
SELECT count(*) AS paired, round(sum((b.pass_bool AND NOT a.pass_bool)::INT) / count(*), 6) AS improved_rate, round(avg(a.latency_ms), 2) AS base_ms, round(avg(b.latency_ms), 2) AS boost_ms
FROM <cases> a JOIN <cases> b ON a.test_id = b.test_id AND a.evaluation_run_id = 0 AND b.evaluation_run_id = 2""")
def _(v):
    arm = lambda i, n: v.cases.filter(F.col("evaluation_run_id") == i).select("test_id", F.col("pass_bool").alias(f"{n}_pass"), F.col("latency_ms").alias(n))
    x = arm(0, "base").join(arm(2, "boost"), "test_id")
    return x.agg(F.count("*").alias("paired"), F.round(F.count_if(F.col("boost_pass") & ~F.col("base_pass")) / F.count("*"), 6).alias("improved_rate"), F.round(F.avg("base"), 2).alias("base_ms"), F.round(F.avg("boost"), 2).alias("boost_ms"))


@query("e26_iteration_trend", "SELECT evaluation_run_id, " + ", ".join(f"coalesce(round(avg(CASE WHEN {_INTENT} = '{i}' THEN pass_bool::INT END), 6), 0.0) AS {i}" for i in E.INTENTS) + " FROM <cases> GROUP BY 1")
def _(v):
    return E.iteration_trend(v.cases, intent())


@query("e27_top_issues", f"""
WITH {_PRIMARY}, e AS (SELECT 1 AS priority, primary_error AS issue, count(*) AS n FROM primaries GROUP BY 2), r AS (SELECT 2 AS priority, 'low_top_1' AS issue, count(*) FILTER (NOT top_1) AS n FROM hits HAVING (count(*) FILTER (top_1)) < 0.8 * count(*)),
c AS (SELECT 4 AS priority, 'under_tested' AS issue, count(*) AS n FROM ({_COVER}) WHERE under_tested HAVING count(*) > 0)
SELECT priority, issue, n FROM (SELECT * FROM e UNION ALL SELECT * FROM r UNION ALL SELECT * FROM c) ORDER BY priority, n DESC, issue LIMIT 3""")
def _(v):
    e = primary(v, term_hits(v)).groupBy(F.lit(1).alias("priority"), F.col("primary_error").alias("issue")).agg(F.count("*").alias("n"))
    h = term_hits(v).agg(F.count_if(~F.col("top_1")).alias("n"), F.count("*").alias("all")).filter(F.col("all") - F.col("n") < 0.8 * F.col("all")).select(F.lit(2).alias("priority"), F.lit("low_top_1").alias("issue"), "n")
    c = E.coverage_phases(v.cases).agg(F.count_if("under_tested").alias("n")).filter("n > 0").select(F.lit(4).alias("priority"), F.lit("under_tested").alias("issue"), "n")
    return e.unionByName(h).unionByName(c).orderBy("priority", F.desc("n"), "issue").limit(3)


@query("e28_dataset_health", f"SELECT {_INTENT} AS intent, count(*) AS n FROM <cases> GROUP BY 1 HAVING count(*) < 100")
def _(v):
    return v.cases.groupBy(intent().alias("intent")).agg(F.count("*").alias("n")).filter("n < 100")


@query("e29_topk_by_intent", f"WITH {_HITS} SELECT {_INTENT} AS intent, count(*) AS n, round(sum(top_k::INT) / count(*), 6) AS hit_rate FROM <cases> c JOIN hits h ON h.id = c.id WHERE length(query_text) >= 12 GROUP BY 1")
def _(v):
    x = v.cases.filter(F.length("query_text") >= 12).select("id", intent().alias("intent")).join(E.term_hits(v.cases, v.chunks), "id")
    return x.groupBy("intent").agg(F.count("*").alias("n"), F.round(F.count_if("top_k") / F.count("*"), 6).alias("hit_rate"))


@query("e30_failure_modes", f"""
WITH {_PRIMARY}, t AS (SELECT DISTINCT id, tag FROM (SELECT id, unnest(string_split(error_categories, ';')) AS tag FROM <cases> WHERE NOT pass_bool AND error_categories <> '' UNION ALL SELECT id, primary_error FROM primaries))
SELECT tag, count(*) AS n FROM t GROUP BY 1""")
def _(v):
    return E.tag_counts(v.cases, primary(v))


@query("e31_representatives", """
WITH x AS (SELECT id, effective_mode, pass_bool AS ok, coalesce(score, 0) AS score FROM <cases>), y AS (SELECT *, row_number() OVER (PARTITION BY effective_mode, ok ORDER BY score, id) AS pos, count(*) OVER (PARTITION BY effective_mode, ok) AS n FROM x)
SELECT effective_mode, ok, id, score FROM y WHERE pos = floor(n / 2) + 1""")
def _(v):
    return E.representatives(v.cases)


@query("e32_forbidden_leakage", """
WITH t AS (SELECT id, chunk_ids, term, contains(lower(actual_response), term) AS a FROM (SELECT *, unnest(string_split(must_not_include, ',')) AS term FROM <cases>)),
i AS (SELECT id, term, unnest(string_split(chunk_ids, ',')) AS c FROM t WHERE NOT a),
s AS (SELECT DISTINCT i.id, i.term FROM i JOIN <chunks> k ON k.id = CAST(i.c AS BIGINT) WHERE contains(lower(concat_ws(' ', k.topic, k.source_excerpt, k.clean_explanation)), i.term)),
u AS (SELECT 'answer' AS place, term, count(*) AS n FROM t WHERE a GROUP BY 2 UNION ALL SELECT 'retrieval', term, count(*) FROM s GROUP BY 2)
SELECT place, term, n FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, term) AS r FROM u) WHERE r <= 15""")
def _(v):
    return E.forbidden_leakage(v.cases, v.chunks)


@query("e33_mode_scores", "SELECT effective_mode, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS min_score FROM <cases> GROUP BY 1")
def _(v):
    return E.mode_scores(v.cases)


@query("e34_top_errors_on_failures", "SELECT error, count(*) AS n FROM (SELECT unnest(string_split(error_categories, ';')) AS error FROM <cases> WHERE NOT pass_bool AND error_categories <> '') GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def _(v):
    return E.error_histogram(v.cases.filter("NOT pass_bool")).orderBy(F.desc("n"), "error").limit(5)


@query("e35_repeated_failures", """
SELECT dataset_name, test_id, count(DISTINCT evaluation_run_id) AS runs FROM <cases> c JOIN <runs> r ON r.id = c.evaluation_run_id WHERE NOT pass_bool GROUP BY 1, 2 HAVING count(DISTINCT evaluation_run_id) >= 2""")
def _(v):
    return E.repeated_failures(v.cases, v.runs)


@query("e36_run_detail", """
SELECT r.id, r.total_cases, c.category, count(*) AS n, round((count(*) FILTER (pass_bool)) / count(*), 6) AS pass_rate FROM <runs> r JOIN <cases> c ON c.evaluation_run_id = r.id GROUP BY ALL""")
def _(v):
    x = v.cases.groupBy(F.col("evaluation_run_id").alias("id"), "category").agg(F.count("*").alias("n"), F.round(F.count_if("pass_bool") / F.count("*"), 6).alias("pass_rate"))
    return v.runs.select("id", "total_cases").join(x, "id")


@query("e37_concept_digest", """
SELECT 'error' AS kind, error AS name, count(*) AS n FROM (SELECT unnest(string_split(error_categories, ';')) AS error FROM <cases> WHERE NOT pass_bool AND error_categories <> '' AND string_split(must_include, ',')[1] = 'the') GROUP BY 2
UNION ALL SELECT 'mode', effective_mode, count(*) FROM <cases> WHERE NOT pass_bool AND string_split(must_include, ',')[1] = 'the' GROUP BY 2""")
def _(v):
    x = v.cases.filter("NOT pass_bool").filter(E.concept_label() == "the")
    e = E.error_histogram(x).select(F.lit("error").alias("kind"), F.col("error").alias("name"), "n")
    return e.unionByName(x.groupBy(F.lit("mode").alias("kind"), F.col("effective_mode").alias("name")).agg(F.count("*").alias("n")))


_PAIRS = """pairs AS (SELECT a.id, (SELECT max_by(b.id, (b.created_at, b.id)) FROM <runs> b WHERE b.dataset_name = a.dataset_name AND b.id <> a.id) AS prev FROM <runs> a)"""


@query("e38_previous_run", f"WITH {_PAIRS} SELECT id, prev FROM pairs WHERE prev IS NOT NULL")
def _(v):
    return E.run_pairs(v.runs)


_METRICS = f"""{_PAIRS}, m AS (SELECT evaluation_run_id AS run, round(sum(coalesce(score, 0)) / count(*), 9) AS score, round((count(*) FILTER (list_contains(string_split(error_categories, ';'), 'retrieval_leakage'))) / count(*), 9) AS leak,
  round((count(*) FILTER (effective_mode <> expected_mode)) / count(*), 9) AS mode FROM <cases> GROUP BY 1)"""


@query("e39_run_regressions", f"""
WITH {_METRICS} SELECT p.id, p.prev, n.score AS score_now, w.score AS score_was, n.leak AS leak_now, w.leak AS leak_was, n.mode AS mode_now, w.mode AS mode_was,
  w.score > 0 AND (w.score - n.score) / w.score > 0.05 AS overall_drop, n.leak - w.leak > 0.001 AS leak_rise, n.mode - w.mode > 0.001 AS mode_rise,
  abs(n.score - w.score) > 1e-6 OR abs(n.leak - w.leak) > 1e-6 OR abs(n.mode - w.mode) > 1e-6 AS moved FROM pairs p JOIN m n ON n.run = p.id JOIN m w ON w.run = p.prev""")
def _(v):
    return E.regression_metrics(E.run_pairs(v.runs), v.cases)


@query("e40_category_drops", f"""
WITH {_PAIRS}, m AS (SELECT evaluation_run_id AS run, category, round(sum(coalesce(score, 0)) / count(*), 9) AS mean FROM <cases> GROUP BY 1, 2)
SELECT p.id, p.prev, n.category, n.mean AS now, w.mean AS was FROM pairs p JOIN m n ON n.run = p.id JOIN m w ON w.run = p.prev AND w.category = n.category WHERE w.mean > 0 AND (w.mean - n.mean) / w.mean > 0.1""")
def _(v):
    return E.category_drops(E.run_pairs(v.runs), v.cases)


_TRANS = f"""
WITH {_PAIRS} SELECT p.id, p.prev, n.test_id, CASE WHEN n.pass_bool THEN 'fail_to_pass' ELSE 'pass_to_fail' END AS transition, n.critical, w.score AS score_was, n.score AS score_now
FROM pairs p JOIN <cases> n ON n.evaluation_run_id = p.id JOIN <cases> w ON w.evaluation_run_id = p.prev AND w.test_id = n.test_id WHERE n.pass_bool <> w.pass_bool"""


@query("e41_newly_failing_critical", _TRANS + " AND n.critical AND NOT n.pass_bool")
def _(v):
    return E.transitions(E.run_pairs(v.runs), v.cases).filter("critical AND transition = 'pass_to_fail'")


@query("e43_transitions", _TRANS)
def _(v):
    return E.transitions(E.run_pairs(v.runs), v.cases)


_MODE = "coalesce(nullif(c.effective_mode, ''), nullif(c.detected_mode, ''), c.expected_mode)"


@query("k1_scope", f"SELECT {_MODE} AS mode, count(*) AS n FROM <cases> c WHERE {_MODE} IN ('chat', 'compare') GROUP BY 1")
def _(v):
    return K.in_scope(v.cases, ["chat", "compare"]).groupBy("mode").agg(F.count("*").alias("n"))


@query("k2_judge_input", f"WITH {_HITS}, e AS (SELECT id, substr(string_agg(blob, chr(10) || '---' || chr(10) ORDER BY pos), 1, 8000) AS evidence FROM blobs GROUP BY 1) SELECT c.id, query_text AS query, actual_response AS answer, evidence FROM <cases> c LEFT JOIN e ON e.id = c.id")
def _(v):
    return K.judge_input(v.cases, v.chunks)


@query("k4_token_budget", """
SELECT evaluation_run_id, case_result_id, tokens_estimated FROM (SELECT *, coalesce(sum(tokens_estimated) OVER (PARTITION BY evaluation_run_id ORDER BY case_result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM <critic>) WHERE used < 20000""")
def _(v):
    return K.within_budget(v.critic, 20_000).select("evaluation_run_id", "case_result_id", "tokens_estimated")


@query("k5_primary", """
SELECT id, CASE WHEN critic_score IS NULL THEN 'critic_pipeline_error' WHEN contains(error_categories, 'hallucination') THEN 'hallucination' WHEN contains(error_categories, 'steps') THEN 'missing_steps' WHEN critic_pass THEN NULL ELSE 'shallow_explanation' END AS primary_error FROM <critic>""")
def _(v):
    return K.primary_of(v.critic)


@query("k6_batch_completeness", """
WITH t AS (SELECT evaluation_run_id, count(*) AS targeted FROM <cases> GROUP BY 1), b AS (SELECT evaluation_run_id, critic_batch_id, count(*) AS judged, max(created_at) AS at FROM <critic> GROUP BY 1, 2)
SELECT t.evaluation_run_id, max_by(b.critic_batch_id, (b.at, b.critic_batch_id)) AS batch, max_by(b.judged, (b.at, b.critic_batch_id)) AS judged, any_value(t.targeted) AS targeted, max_by(b.judged, (b.at, b.critic_batch_id)) = any_value(t.targeted) AS complete
FROM t JOIN b ON b.evaluation_run_id = t.evaluation_run_id GROUP BY 1""")
def _(v):
    return K.latest_batches(v.critic, v.cases)


@query("k7_summary", """
SELECT evaluation_run_id, count(*) AS n, round((count(*) FILTER (critic_pass)) / count(*), 6) AS pass_rate, round(sum(coalesce(critic_score, 0)) / count(*), 6) AS mean_all, round(avg(critic_score), 6) AS mean_parsed, round(count(critic_score) / count(*), 6) AS parse_rate FROM <critic> GROUP BY 1""")
def _(v):
    return K.summary(v.critic)


@query("k8_case_vs_judge", "SELECT c.id, c.category, c.pass_bool, k.critic_pass, c.pass_bool <> k.critic_pass AS disagree FROM <cases> c JOIN <critic> k ON k.case_result_id = c.id")
def _(v):
    return K.against_judge(v.cases, v.critic)


@query("k9_overlay", "SELECT c.category, count(*) AS total, count(*) FILTER (k.critic_pass) AS passed, count(*) FILTER (NOT k.critic_pass) AS failed, round(sum(coalesce(k.critic_score, 0)) / count(*), 4) AS avg_score FROM <cases> c JOIN <critic> k ON k.case_result_id = c.id GROUP BY 1")
def _(v):
    return E.by_category(K.overlay(v.cases, v.critic))


@query("k10_triage", """
WITH f AS (SELECT k.*, CASE WHEN k.critic_score IS NULL THEN 'no_verdict' WHEN c.pass_bool THEN 'judge_only' WHEN contains(k.error_categories, 'hallucination') THEN 'grounding' ELSE 'content' END AS bucket FROM <critic> k JOIN <cases> c ON c.id = k.case_result_id WHERE NOT k.critic_pass),
s AS (SELECT bucket, count(*) AS n FROM f GROUP BY 1) SELECT bucket, n, round(n / sum(n) OVER (), 6) AS share, bucket = 'judge_only' AND n / sum(n) OVER () >= 0.45 AS rubric_risk FROM s""")
def _(v):
    return K.triage(v.cases, v.critic)


@query("k10_worst_of_bucket", """
WITH f AS (SELECT k.id, coalesce(k.critic_score, 0) AS score, CASE WHEN k.critic_score IS NULL THEN 'no_verdict' WHEN c.pass_bool THEN 'judge_only' WHEN contains(k.error_categories, 'hallucination') THEN 'grounding' ELSE 'content' END AS bucket
  FROM <critic> k JOIN <cases> c ON c.id = k.case_result_id WHERE NOT k.critic_pass)
SELECT bucket, id, score FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score, id) AS r FROM f) WHERE r <= 10""")
def _(v):
    return K.worst_of_buckets(v.cases, v.critic)


@query("k3_verdicts", """
SELECT id, round(CASE WHEN critic_score IS NULL THEN NULL WHEN id % 3 = 0 THEN (least(critic_score * 2, 1.0::DOUBLE) + 0.5::DOUBLE) / 2 ELSE critic_score END, 9) AS score,
  CASE WHEN critic_score IS NULL THEN NULL WHEN id % 3 = 0 THEN (least(critic_score * 2, 1.0::DOUBLE) + 0.5::DOUBLE) / 2 >= 0.68 ELSE critic_score >= 0.5 END AS passed,
  CASE WHEN critic_score IS NULL THEN 'critic_no_verdict' ELSE 'ok' END AS verdict FROM <critic>""")
def _(v):
    score = F.col("critic_score")
    means = F.concat(F.lit('Verdict: {"dimensions": {"a": '), (score * 2).cast("string"), F.lit(', "b": 0.5}} as asked'))
    plain = F.concat(F.lit('{"score": '), score.cast("string"), F.lit(', "pass": '), (score >= 0.5).cast("string"), F.lit("}"))
    raw = F.when(score.isNull(), "no verdict").when(F.col("id") % 3 == 0, means).otherwise(plain)
    return K.verdicts(v.critic.select("id", raw.alias("raw"))).withColumn("score", F.round("score", 9))
