"""Views that give the driver's tables the shapes of a retrieval log, an evaluation history and a chunk corpus.

One SQL text per view runs in Spark and, as a common table expression, in the oracle engine. ``<name>`` stands for
another view or table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from answerlens.sources.stored import stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "chunks": """
SELECT doc_id AS id, lang || ':' || CAST(doc_id AS STRING) AS chunk_key, CAST(regexp_extract(source, '[0-9]+', 0) AS INT) AS lecture_number,
       source || ' — ' || lang AS topic, lang AS concept_family, CASE WHEN n_chars < 500 THEN 'overview' ELSE 'definition' END AS chunk_type,
       split_part(text, chr(10), 1) AS clean_explanation, text AS source_excerpt
FROM <documents>""",
    "queries": "SELECT item_id AS query_id, text AS query_text FROM <benchmark>",
    "packs": """
SELECT pack_id, CASE kind WHEN 0 THEN '{"lecture_id":' || CAST(number AS STRING) || ',"concepts":[' || a || ',' || b || ',' || c || ']}' WHEN 1 THEN '{"lecture_number":"' || CAST(number AS STRING) || '","concepts":' || a || '}' WHEN 2 THEN '{"topics":[' || a || ']}' WHEN 3 THEN '[' || b || ']' ELSE line END AS payload
FROM (SELECT pack_id, kind, number, line, CASE WHEN length(x) % 3 = 0 THEN '{"name":"' || x || '"}' WHEN length(x) % 3 = 1 THEN '"' || x || '"' ELSE CAST(length(x) AS STRING) END AS a,
  CASE WHEN length(y) % 3 = 0 THEN '{"name":"' || y || '"}' WHEN length(y) % 3 = 1 THEN '["' || y || '"]' ELSE 'null' END AS b, CASE WHEN length(z) % 2 = 0 THEN '{"name":"' || z || '"}' ELSE 'true' END AS c
  FROM (SELECT doc_id AS pack_id, n_chars % 5 AS kind, n_chars % 20 AS number, split_part(text, chr(10), 1) AS line, regexp_extract(split_part(text, ' ', 1), '^[A-Za-z]+', 0) AS x, regexp_extract(split_part(text, ' ', 2), '^[a-z]+', 0) AS y, regexp_extract(split_part(text, ' ', 3), '^[a-z]+', 0) AS z FROM <documents>) w) p""",
    "messages": """
SELECT conv_id * 100 + turn AS id, conv_id AS session_id, turn AS seq, role, text AS content_text,
       TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE AS created_at
FROM <conversations>""",
    "retrieval_logs": """
SELECT event_id AS id, user_id AS session_id, event_id AS message_id, ts AS created_at, value / (value + 50.0) AS confidence,
       value / (value + 50.0) < 0.35 AS is_low_confidence, event_type = 'error' AS is_off_topic, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 6 AS num_chunks_hit, event_type AS query_type_v2,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS answer_mode,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 <> 1 END AS validation_passed,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"severity":"' || CASE WHEN event_id % 5 = 1 THEN 'fail' WHEN event_id % 5 = 2 THEN 'weak' ELSE 'pass' END || '"}' END AS validation_checks_json,
       'keyword' AS retrieval_backend
FROM <events>""",
    "retrieval_chunk_hits": """
SELECT e.event_id * 3 + r.rank AS id, e.event_id AS retrieval_log_id, (e.event_id * 7 + r.rank * 13) % 200 AS lecture_chunk_id, r.rank, e.value / r.rank AS score
FROM <events> e CROSS JOIN (VALUES (1), (2), (3)) AS r(rank)""",
    "response_variants": """
SELECT event_id AS id, event_id AS message_id, ts AS created_at, event_type = 'purchase' AS boost_used,
       CASE WHEN event_type = 'purchase' THEN 'user_toggle' ELSE 'boost_disabled' END AS boost_reason,
       CASE WHEN event_type IN ('view', 'click') THEN 'rule_based' ELSE 'openai' END AS provider_name,
       CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'm' || CAST(user_id % 3 AS STRING) END AS model_name,
       CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE '{"primary":{"usage":{"total_tokens":' || regexp_extract(props, '[0-9]+', 0) || '}}}' END AS token_usage_json
FROM <events>""",
    "feedback": """
SELECT doc_id AS message_id, CASE WHEN quality = 1 THEN 'up' WHEN toxic = 1 THEN 'down' ELSE NULL END AS course_thumb,
       CASE WHEN toxic = 1 THEN 1 ELSE 2 + quality * 2 END AS helpfulness_rating, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '30' MINUTE AS created_at
FROM <labels>""",
    "cases": """
SELECT d.doc_id AS id, d.doc_id % 3 AS evaluation_run_id, 't' || CAST(CAST(floor(d.doc_id / 3) AS BIGINT) AS STRING) AS test_id, split_part(d.text, chr(10), 1) AS query_text, d.lang AS category,
       CASE WHEN d.doc_id % 4 = 0 THEN 'compare' WHEN d.doc_id % 4 = 1 THEN 'summary' ELSE 'chat' END AS expected_mode,
       CASE WHEN d.doc_id % 5 = 0 THEN 'chat' WHEN d.doc_id % 4 = 0 THEN 'compare' WHEN d.doc_id % 4 = 1 THEN 'summary' ELSE 'chat' END AS detected_mode,
       CASE WHEN d.doc_id % 6 = 0 THEN 'chat' WHEN d.doc_id % 4 = 0 THEN 'compare' WHEN d.doc_id % 4 = 1 THEN 'summary' ELSE 'chat' END AS effective_mode,
       CASE WHEN d.lang = 'en' THEN 'the,that' WHEN d.lang = 'de' THEN 'der' ELSE 'la' END AS must_include,
       CASE WHEN d.lang = 'en' THEN 'la' ELSE 'the' END AS must_not_include, CAST(floor(d.doc_id / 3) AS BIGINT) % 7 = 0 AS critical, l.quality = 1 AS pass_bool,
       CASE WHEN l.quality = 1 THEN CAST(1.0 AS DOUBLE) WHEN l.toxic = 1 THEN CAST(0.25 AS DOUBLE) WHEN d.doc_id % 2 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS score,
       CASE WHEN l.quality = 1 THEN '' WHEN l.toxic = 1 THEN 'retrieval_leakage;generic_filler' ELSE 'missing_required_concept' END AS error_categories,
       CAST(d.doc_id % 200 AS STRING) || ',' || CAST((d.doc_id * 7 + 3) % 200 AS STRING) AS chunk_ids, d.n_chars AS latency_ms, d.text AS actual_response
FROM <documents> d JOIN <labels> l ON l.doc_id = d.doc_id""",
    "runs": """
SELECT evaluation_run_id AS id, 'ds' AS dataset_name, COUNT(*) AS total_cases, SUM(CASE WHEN pass_bool THEN 1 ELSE 0 END) AS passed_cases,
       AVG(COALESCE(score, CAST(0 AS DOUBLE))) AS overall_score, TIMESTAMP '2024-01-01 00:00:00' + evaluation_run_id * INTERVAL '1' DAY AS created_at
FROM <cases> GROUP BY evaluation_run_id""",
    "critic": """
SELECT id, evaluation_run_id, id AS case_result_id, 'b' || CAST(evaluation_run_id AS STRING) AS critic_batch_id,
       CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS critic_score, id % 11 <> 0 AND id % 10 >= 7 AS critic_pass, category,
       CASE WHEN id % 11 = 0 THEN 'critic_no_verdict' WHEN id % 10 < 3 THEN 'hallucination;weak_evidence' WHEN id % 10 < 7 THEN 'incomplete_steps' ELSE '' END AS error_categories,
       id % 900 AS tokens_estimated, TIMESTAMP '2024-02-01 00:00:00' + id * INTERVAL '1' MINUTE AS created_at
FROM <cases>""",
    "concept_terms": "SELECT * FROM (VALUES ('c1','the'), ('c1','that'), ('c2','for'), ('c2','by'), ('c3','la'), ('c4','der'), ('c4','die')) AS t(concept_id, term)",
    "concept_lectures": """
SELECT DISTINCT t.concept_id, k.lecture_number
FROM (SELECT lecture_number, lower(split_part(clean_explanation, ' ', 2)) AS word FROM <chunks> UNION ALL SELECT lecture_number, lower(split_part(clean_explanation, ' ', 3)) AS word FROM <chunks>) k
JOIN <concept_terms> t ON t.term = k.word""",
    "word_concepts": """
SELECT DISTINCT substr(word, 1, 1) AS concept_id, word AS term
FROM (SELECT lower(split_part(query_text, ' ', 3)) AS word FROM <queries> UNION ALL SELECT lower(split_part(query_text, ' ', 6)) AS word FROM <queries>) w WHERE length(word) >= 5""",
    "many_concepts": """
SELECT DISTINCT substr(word, 1, 1) AS concept_id, word AS term
FROM (SELECT regexp_extract(lower(split_part(query_text, ' ', 3)), '^[a-z]+$', 0) AS word FROM <queries> UNION ALL SELECT regexp_extract(lower(split_part(query_text, ' ', 6)), '^[a-z]+$', 0) AS word FROM <queries> UNION ALL SELECT regexp_extract(lower(split_part(query_text, ' ', 8)), '^[a-z]+$', 0) AS word FROM <queries>
  UNION ALL SELECT regexp_extract(lower(split_part(query_text, ' ', 9)), '^[a-z]+$', 0) AS word FROM <queries>) w WHERE length(word) >= 4""",
    "concept_hints": "SELECT concept_id, row_number() OVER (PARTITION BY concept_id ORDER BY lecture_number DESC) - 1 AS pos, 'lecture ' || CAST(lecture_number AS STRING) AS hint FROM <concept_lectures>",
    "concept_edges": """
SELECT a.concept_id AS src, CASE WHEN b.concept_id < a.concept_id THEN 'prerequisite' ELSE 'related' END AS kind, -count(*) AS pos, b.concept_id AS dst
FROM <concept_lectures> a JOIN <concept_lectures> b ON a.lecture_number = b.lecture_number AND a.concept_id <> b.concept_id GROUP BY a.concept_id, b.concept_id""",
    "concept_axes": """
SELECT a.concept_id AS low, b.concept_id AS high, 'in ' || CAST(a.lecture_number AS STRING) AS axis
FROM <concept_lectures> a JOIN <concept_lectures> b ON a.lecture_number = b.lecture_number AND a.concept_id < b.concept_id""",
    "lecture_edges": """
SELECT DISTINCT a.lecture_number AS src, b.lecture_number AS dst
FROM (SELECT DISTINCT lecture_number FROM <chunks>) a JOIN (SELECT DISTINCT lecture_number FROM <chunks>) b ON abs(a.lecture_number - b.lecture_number) = 1""",
}
_NAME = re.compile(r"<(\w+)>")


class Views:
    """The driver's tables under sf_dir and the views over them, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
        self.seen: dict[str, DataFrame] = {}
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.seen:
            if name in TABLES:
                self.seen[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                self.seen[name] = self.sql(VIEWS[name])
        return self.seen[name]

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """make() as a written table, made once for this query."""
        if name not in self.kept:
            self.kept[name] = stored(make(), name)
        return self.kept[name]

    def sql(self, text: str) -> DataFrame:
        for name in set(_NAME.findall(text)):
            getattr(self, name).createOrReplaceTempView(f"al_{self.tag}_{name}")
        return self.spark.sql(_NAME.sub(lambda m: f"al_{self.tag}_{m[1]}", text))


def oracle(sql: str) -> str:
    """The text with every view it needs, directly or not, as a common table expression."""
    done: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in done:
                need(VIEWS[name])
                done.append(name)

    need(sql)
    plain = lambda text: _NAME.sub(lambda m: m[1], text).strip()
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in done)
    sql = plain(sql)
    if not ctes:
        return sql
    return f"WITH {ctes},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes}\n{sql}"
