"""Queries of payload flattening, the embedding job and written reports."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from answerlens.operators import evaluation as E
from answerlens.plans.registry import query
from answerlens.sources import corpus
from answerlens.sources.stored import shared_dir

_PAYLOADS = """
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role,
       CASE WHEN event_id % 10 = 1 THEN '{bad' WHEN event_id % 10 = 2 THEN NULL ELSE '{"confidence":0.' || CAST(event_id % 9 AS STRING) || ',"mode":"' || event_type || '","chunk_hits":[{"chunk_id":' || CAST(event_id AS STRING) || ',"score":1.5},{"chunk_id":' || CAST(user_id AS STRING)
         || ',"score":0.25}]' || CASE WHEN event_id % 4 = 0 THEN ',"variant":{"provider":"p' || CAST(user_id % 3 AS STRING) || '","boost_used":true}' ELSE '' END || '}' END AS payload_json
FROM <events>"""


@query("s16_payloads", """
WITH p AS (SELECT event_id AS message_id, event_id % 10 NOT IN (1, 2) AS fine, event_type, user_id FROM <events> WHERE event_id % 3 <> 0),
h AS (SELECT message_id, 1 AS rank, message_id AS chunk_id, 1.5::DOUBLE AS score FROM p WHERE fine UNION ALL SELECT message_id, 2, user_id, 0.25 FROM p WHERE fine)
SELECT p.message_id, CASE WHEN fine THEN round((p.message_id % 9) / 10.0::DOUBLE, 6) END AS confidence, CASE WHEN fine THEN event_type END AS mode, h.rank, h.chunk_id, h.score, CASE WHEN fine AND p.message_id % 4 = 0 THEN 'p' || (user_id % 3) END AS provider
FROM p LEFT JOIN h ON h.message_id = p.message_id""")
def _(v):
    t = corpus.flatten_payloads(v.sql(_PAYLOADS))
    x = t["logs"].join(t["hits"], "message_id", "left").join(t["variants"].select("message_id", "provider"), "message_id", "left")
    return x.withColumn("confidence", F.round("confidence", 6)).select("message_id", "confidence", "mode", "rank", "chunk_id", "score", "provider")


def _vowels(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in "aeiou"] for t in texts], dtype=np.float32).reshape(len(texts), 5)


_TEXT = "substr(clean_explanation, 1, 4000) || chr(10) || '---' || chr(10) || substr(source_excerpt, 1, 1500)"
_COUNTS = ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::INT" for c in "aeiou")


@query("s17_embedding_job", f"SELECT id, array_to_string([{_COUNTS}], ',') AS vector, 'vowels' AS model, 5 AS dim FROM (SELECT id, {_TEXT} AS t FROM <chunks>)")
def _(v):
    out = corpus.embed_chunks(v.chunks, _vowels, model="vowels")
    return out.select("id", F.array_join(F.col("embedding").cast("array<int>").cast("array<string>"), ",").alias("vector"), "model", "dim")


@query("s18_reports", """
SELECT 'by_category' AS report, category AS name, count(*) AS total FROM <cases> GROUP BY 2 UNION ALL SELECT 'run_totals', CAST(evaluation_run_id AS VARCHAR), count(*) FROM <cases> GROUP BY 2""")
def _(v):
    folder = f"{shared_dir(v.spark)}/reports-{uuid.uuid4().hex[:12]}"
    corpus.write_reports({"by_category": E.by_category(v.cases), "run_totals": E.run_totals(v.cases)}, folder)
    read = lambda name, key: v.spark.read.option("header", True).csv(f"{folder}/{name}").select(F.lit(name).alias("report"), F.col(key).alias("name"), F.col("total").cast("long").alias("total"))
    return read("by_category", "category").unionByName(read("run_totals", "evaluation_run_id"))
