"""Queries over retrieval logs (A1-A19) and exports of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.operators import logs as L
from answerlens.plans.registry import query

AS_OF = "2024-01-20 00:00:00"
_WIN = "created_at BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"
_TOKENS = "CASE WHEN token_usage_json IS NULL THEN 0 ELSE coalesce(CAST(json_extract_string(token_usage_json, '$.primary.usage.total_tokens') AS BIGINT), 0) END"
_PCT = "round(100.0 * {0} / {1}, 2)"


@query("a1_window", f"SELECT CAST(date_trunc('day', created_at) AS DATE) AS day, count(*) AS n FROM <retrieval_logs> WHERE {_WIN} GROUP BY 1")
def _(v):
    return L.in_window(v.retrieval_logs, AS_OF, 7).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


@query("a2_volume", "SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(*) < 5 AS insufficient_data FROM <retrieval_logs>")
def _(v):
    return L.volume(v.retrieval_logs)


@query("a3_retrieval_kpis", """
SELECT count(*) AS events, round(avg(confidence), 6) AS avg_confidence, round(avg(latency_ms), 6) AS avg_latency_ms,
       round(100.0 * sum(CASE WHEN num_chunks_hit = 0 OR is_off_topic THEN 1 ELSE 0 END) / count(*), 2) AS pct_no_result,
       round(100.0 * sum(CASE WHEN is_low_confidence THEN 1 ELSE 0 END) / count(*), 2) AS pct_low_confidence FROM <retrieval_logs>""")
def _(v):
    return L.retrieval_kpis(v.retrieval_logs)


@query("a4_breakdowns", """
SELECT 'query_type_v2' AS dimension, coalesce(query_type_v2, 'null') AS key, count(*) AS n FROM <retrieval_logs> GROUP BY 2
UNION ALL SELECT 'answer_mode', coalesce(answer_mode, 'null'), count(*) FROM <retrieval_logs> GROUP BY 2
UNION ALL SELECT 'retrieval_backend', coalesce(retrieval_backend, 'null'), count(*) FROM <retrieval_logs> GROUP BY 2""")
def _(v):
    return L.breakdown(v.retrieval_logs, "query_type_v2", "answer_mode", "retrieval_backend")


@query("a5_validation_states", "SELECT 'validation_passed' AS dimension, coalesce(CAST(validation_passed AS VARCHAR), 'null') AS key, count(*) AS n FROM <retrieval_logs> GROUP BY 2")
def _(v):
    return L.breakdown(v.retrieval_logs, "validation_passed")


@query("a6_severity", "SELECT coalesce(json_extract_string(validation_checks_json, '$.severity'), 'null') AS severity, count(*) AS n FROM <retrieval_logs> WHERE coalesce(trim(validation_checks_json), '') <> '' GROUP BY 1")
def _(v):
    return L.severity_counts(v.retrieval_logs)


@query("a7_boost_usage", "SELECT count(*) AS variants, count(*) FILTER (boost_used) AS boosted, round(100.0 * (count(*) FILTER (boost_used)) / count(*), 2) AS pct_boosted FROM <response_variants>")
def _(v):
    return L.boost_usage(v.response_variants)


@query("a7_boost_reasons", "SELECT 'boost_reason' AS dimension, coalesce(boost_reason, 'null') AS key, count(*) AS n FROM <response_variants> GROUP BY 2")
def _(v):
    return L.breakdown(v.response_variants, "boost_reason")


@query("a8_feedback", """
SELECT count(*) AS rows, count(*) FILTER (course_thumb = 'up') AS up, count(*) FILTER (course_thumb = 'down') AS down, count(*) FILTER (course_thumb IS NULL) AS none,
       round(avg(helpfulness_rating), 2) AS avg_helpfulness FROM <feedback>""")
def _(v):
    return L.feedback_summary(v.feedback)


@query("a9_outcomes", """
SELECT count(*) AS rows, count(course_thumb) AS known, CASE WHEN count(course_thumb) > 0 THEN round(100.0 * (count(*) FILTER (course_thumb = 'up')) / count(course_thumb), 2) END AS pct_resolved FROM <feedback>""")
def _(v):
    return L.outcome_summary(v.feedback.withColumn("answer_resolved", F.when(F.col("course_thumb").isNotNull(), F.col("course_thumb") == "up")))


@query("a10_low_confidence_page", """
SELECT id, created_at, substr(query_type_v2, 1, 800) AS question, confidence, count(*) OVER () AS total FROM <retrieval_logs> WHERE is_low_confidence ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""")
def _(v):
    return L.low_confidence_page(v.retrieval_logs.withColumnRenamed("query_type_v2", "user_question"), 50, 10)


def _top(where: str) -> str:
    return f"""
SELECT b.lecture_chunk_id, b.hits, c.topic, c.lecture_number FROM (
  SELECT h.lecture_chunk_id, count(*) AS hits FROM <retrieval_chunk_hits> h JOIN <retrieval_logs> l ON l.id = h.retrieval_log_id {where}
  GROUP BY 1 ORDER BY hits DESC, h.lecture_chunk_id LIMIT 25) b LEFT JOIN <chunks> c ON c.id = b.lecture_chunk_id"""


@query("a11_weak_chunks", _top("WHERE l.is_low_confidence"))
def _(v):
    return L.top_chunks(v.retrieval_chunk_hits, v.retrieval_logs, v.chunks)


@query("a11_top_chunks", _top(""))
def _(v):
    return L.top_chunks(v.retrieval_chunk_hits, v.retrieval_logs, v.chunks, low_confidence_only=False)


@query("a12_tokens", f"SELECT id, {_TOKENS} AS tokens FROM <response_variants>")
def _(v):
    return v.response_variants.select("id", L.total_tokens(F.col("token_usage_json")).alias("tokens"))


_DAYS = f"SELECT CAST(created_at AS DATE) AS day, count(*) AS variants, nullif(CAST(sum({_TOKENS}) AS BIGINT), 0) AS tokens, count(*) FILTER ({_TOKENS} > 0) AS variants_with_tokens FROM <response_variants> GROUP BY 1"


@query("a13_tokens_by_day", _DAYS)
def _(v):
    return L.tokens_by_day(v.response_variants)


@query("a14_providers", f"""
SELECT 'provider' AS dimension, coalesce(provider_name, 'null') AS key, count(*) AS n, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM <response_variants> GROUP BY 2
UNION ALL SELECT 'model', coalesce(model_name, 'null'), count(*), CAST(sum({_TOKENS}) AS BIGINT) FROM <response_variants> GROUP BY 2""")
def _(v):
    return L.provider_rollup(v.response_variants)


@query("a14_repeated_answers", "SELECT substr(sha256(actual_response), 1, 32) AS fingerprint, count(*) AS n, min(id) AS first_id FROM <cases> WHERE actual_response IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def _(v):
    return L.repeated_answers(v.cases, "actual_response")


@query("a15_cost", f"""
SELECT count(*) AS variants, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, CAST(100000 AS BIGINT) AS cap_tokens, sum({_TOKENS}) > 100000 AS over_cap,
       sum({_TOKENS}) >= 80000 AND NOT sum({_TOKENS}) > 100000 AS near_cap, round(sum({_TOKENS}) / 1000000.0 * 2.5, 4) AS usd FROM <response_variants>""")
def _(v):
    return L.cost_summary(v.response_variants, cap=100_000, usd_per_million=2.5)


@query("a16_spike", f"""
WITH days AS ({_DAYS}), x AS (SELECT day, coalesce(tokens, 0) AS tokens, lag(coalesce(tokens, 0)) OVER (ORDER BY day) AS before FROM days)
SELECT day, tokens, before FROM x WHERE before > 0 AND tokens >= before * 1.02 ORDER BY day LIMIT 1""")
def _(v):
    return L.token_spike(v.response_variants, 1.02)


@query("a17_thumbs_down", "SELECT count(*) FILTER (course_thumb = 'down') AS down, count(*) AS rows FROM <feedback>")
def _(v):
    return v.feedback.agg(F.count_if(F.col("course_thumb") == "down").alias("down"), F.count("*").alias("rows"))


@query("a18_boost_by_thumb", "SELECT v.boost_used, coalesce(f.course_thumb, 'none') AS thumb, count(*) AS n FROM <response_variants> v LEFT JOIN <feedback> f ON f.message_id = v.message_id GROUP BY 1, 2")
def _(v):
    return L.boost_by_thumb(v.response_variants, v.feedback)


@query("a19_low_confidence_by_topic", """
SELECT c.topic, count(*) AS hits, count(*) FILTER (l.is_low_confidence) AS low FROM <retrieval_chunk_hits> h JOIN <retrieval_logs> l ON l.id = h.retrieval_log_id JOIN <chunks> c ON c.id = h.lecture_chunk_id GROUP BY 1""")
def _(v):
    hits = v.retrieval_chunk_hits.join(v.retrieval_logs.select(F.col("id").alias("retrieval_log_id"), "is_low_confidence"), "retrieval_log_id").groupBy("lecture_chunk_id").agg(F.count("*").alias("hits"), F.count_if("is_low_confidence").alias("low"))
    return hits.join(v.chunks.select(F.col("id").alias("lecture_chunk_id"), "topic"), "lecture_chunk_id").groupBy("topic").agg(F.sum("hits").alias("hits"), F.sum("low").alias("low"))


@query("a19_chunk_feedback", """
SELECT h.lecture_chunk_id, count(*) FILTER (f.course_thumb = 'up') AS up, count(*) FILTER (f.course_thumb = 'down') AS down,
       round(CAST(count(*) FILTER (f.course_thumb = 'down') AS DOUBLE) / count(*), 6) AS down_rate
FROM <retrieval_chunk_hits> h JOIN <retrieval_logs> l ON l.id = h.retrieval_log_id JOIN <feedback> f ON f.message_id = l.message_id AND f.course_thumb IS NOT NULL GROUP BY 1""")
def _(v):
    return L.chunk_feedback(v.retrieval_chunk_hits, v.retrieval_logs, v.feedback)


@query("a19_margin_bins", """
WITH best AS (SELECT retrieval_log_id, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 2 THEN score END) AS second FROM <retrieval_chunk_hits> GROUP BY 1)
SELECT CAST(floor(round((top - coalesce(second, 0.0)) / (top + 1e-6) / 0.1, 6)) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (is_low_confidence) AS low FROM <retrieval_logs> l JOIN best ON best.retrieval_log_id = l.id GROUP BY 1""")
def _(v):
    return L.margin_bins(v.retrieval_logs, v.retrieval_chunk_hits)


@query("a19_latency", """
SELECT coalesce(retrieval_backend, 'null') AS backend, coalesce(query_type_v2, 'null') AS query_type, count(*) AS n, round(avg(latency_ms), 6) AS avg_ms,
       quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS p50_ms, quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) AS p95_ms FROM <retrieval_logs> GROUP BY 1, 2""")
def _(v):
    return L.latency_by_backend(v.retrieval_logs)


@query("s19_low_confidence_csv", """
SELECT id, created_at, substr(replace(replace(query_type_v2, chr(10), ' '), chr(13), ' '), 1, 2000) AS question, confidence FROM <retrieval_logs> WHERE is_low_confidence ORDER BY created_at DESC, id DESC LIMIT 5000""")
def _(v):
    low = v.retrieval_logs.filter("is_low_confidence").orderBy(F.desc("created_at"), F.desc("id")).limit(5000)
    return low.select("id", "created_at", F.substring(F.translate("query_type_v2", "\n\r", "  "), 1, 2000).alias("question"), "confidence")
