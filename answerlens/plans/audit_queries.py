"""Queries of ingest (S1-S16) and knowledge-base audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import audit as A
from answerlens.plans.registry import query

_STOP = ["the", "and", "that", "les", "der"]


@query("s2_invalid_chunks", """
WITH k AS (SELECT id, id % 7 = 1 AS no_topic, id % 5 = 2 AS bad_key, id % 11 = 3 AS no_body, lecture_number < 3 AS bad_number FROM <chunks>)
SELECT id, array_to_string(list_filter([CASE WHEN no_topic THEN 'empty_heading' END, CASE WHEN bad_key THEN 'bad_key' END, CASE WHEN no_body THEN 'no_body' END, CASE WHEN bad_number THEN 'bad_number' END], lambda x: x IS NOT NULL), ';') AS rules FROM k WHERE no_topic OR bad_key OR no_body OR bad_number""")
def _(v):
    id_ = F.col("id")
    broken = v.chunks.select(
        "id", F.when(id_ % 7 == 1, " ").otherwise(F.col("topic")).alias("topic"), F.when(id_ % 5 == 2, F.concat("chunk_key", F.lit(" x"))).otherwise(F.col("chunk_key")).alias("chunk_key"),
        F.when(id_ % 11 != 3, F.col("source_excerpt")).alias("source_excerpt"), F.when(F.col("lecture_number") >= 3, F.col("lecture_number")).alias("lecture_number"),
    )
    return broken.select("id", F.array_join(A.invalid_rules(broken), ";").alias("rules")).filter("rules <> ''")


@query("s3_chunk_keys", r"""
SELECT id, CASE WHEN id % 3 = 0 THEN chunk_key ELSE printf('%d:%02d:%s', lecture_number, id % 40, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(clean_explanation), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', ''), ''), 'section')) END AS chunk_key FROM <chunks>""")
def _(v):
    return v.chunks.select("id", A.chunk_key(F.col("lecture_number"), F.col("clean_explanation"), (F.col("id") % 40).cast("int"), F.when(F.col("id") % 3 == 0, F.col("chunk_key"))).alias("chunk_key"))


@query("s4_duplicate_keys", "SELECT topic AS chunk_key, count(*) AS n FROM <chunks> GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return v.chunks.groupBy(F.col("topic").alias("chunk_key")).agg(F.count("*").alias("n")).filter("n > 1")


@query("s5_upsert", "SELECT id, CASE WHEN id % 10 = 0 THEN 'new' ELSE topic END AS topic FROM <chunks> UNION ALL SELECT -1 - id, 'added' FROM <chunks> WHERE id % 10 = 0")
def _(v):
    old = v.chunks.select("id", "topic")
    part = v.chunks.filter("id % 10 = 0")
    new = part.select("id", F.lit("new").alias("topic")).unionByName(part.select((F.lit(-1) - F.col("id")).alias("id"), F.lit("added").alias("topic")))
    return A.upsert(old, new, "id")


@query("s6_keywords", f"SELECT id, array_to_string(k[1:48], ',') AS keywords FROM (SELECT id, list_filter(w, lambda t, i: list_position(w, t) = i) AS k FROM (SELECT id, list_filter(regexp_extract_all(lower(clean_explanation), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t)) AS w FROM <chunks>))")
def _(v):
    return v.chunks.select("id", F.array_join(A.auto_keywords(F.col("clean_explanation"), _STOP), ",").alias("keywords"))


@query("s7_merged_keywords", r"""
WITH t AS (SELECT id, unnest(list_concat(regexp_extract_all(topic, '[A-Za-z0-9]+'), regexp_extract_all(clean_explanation, '[A-Za-z0-9]+'))) AS term, unnest(range(len(regexp_extract_all(topic, '[A-Za-z0-9]+')) + len(regexp_extract_all(clean_explanation, '[A-Za-z0-9]+')))) AS pos FROM <chunks>),
f AS (SELECT id, lower(term) AS low, min(pos) AS pos, min_by(term, pos) AS term FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM f)
SELECT id, string_agg(term, ',' ORDER BY r) AS keywords FROM r WHERE r <= 48 GROUP BY 1""")
def _(v):
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return A.merge_keywords(v.chunks.select("id", words("topic").alias("curated"), words("clean_explanation").alias("auto")), ["curated", "auto"])


@query("s8_chunk_types", "SELECT id, CASE lower(trim(topic)) WHEN 'src1 — en' THEN 'overview' ELSE CASE WHEN contains(lower(topic), 'src2') THEN 'example' WHEN contains(lower(topic), 'fr') THEN 'key_idea' ELSE 'definition' END END AS chunk_type FROM <chunks>")
def _(v):
    return v.chunks.select("id", A.chunk_type(F.col("topic"), {"src1 — en": "overview"}, [("src2", "example"), ("fr", "key_idea")]).alias("chunk_type"))


@query("s9_families", "SELECT k.id, f.family FROM <chunks> k LEFT JOIN (SELECT lecture_number, min(concept_family) AS family FROM <chunks> GROUP BY 1) f ON f.lecture_number = k.lecture_number")
def _(v):
    dim = v.chunks.groupBy("lecture_number").agg(F.min("concept_family").alias("family"))
    return v.chunks.select("id", "lecture_number").join(dim, "lecture_number", "left").select("id", "family")


@query("s11_intents", "SELECT category, CASE category WHEN 'compare' THEN 'compare' ELSE 'definition' END AS intent, count(*) AS n FROM <cases> GROUP BY 1")
def _(v):
    from answerlens.operators.evaluation import intent_of

    return v.cases.groupBy("category", intent_of(F.col("category")).alias("intent")).agg(F.count("*").alias("n"))


@query("s13_tolerant_json", """
SELECT id, CASE WHEN token_usage_json IS NULL OR NOT json_valid(token_usage_json || CASE WHEN id % 7 = 0 THEN '}' ELSE '' END) THEN 0 ELSE CAST(json_extract_string(token_usage_json, '$.primary.usage.total_tokens') AS BIGINT) END AS tokens FROM <response_variants>""")
def _(v):
    from answerlens.operators.logs import USAGE

    raw = F.when(F.col("id") % 7 == 0, F.concat(F.lit("{"), "token_usage_json")).otherwise(F.col("token_usage_json"))
    return v.response_variants.select("id", F.coalesce(F.from_json(raw, USAGE)["primary"]["usage"]["total_tokens"], F.lit(0)).alias("tokens"))


@query("s14_id_lists", "SELECT id, len(list_filter(list_transform(string_split(chunk_ids || ',x,7', ','), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)) AS n FROM <cases>")
def _(v):
    ids = F.transform(F.split(F.concat("chunk_ids", F.lit(",x,7")), ","), lambda x: x.try_cast("long"))
    return v.cases.select("id", F.size(F.array_compact(ids)).cast("long").alias("n"))


@query("s15_backfilled_keys", "SELECT id, CASE WHEN id % 4 = 0 THEN 'migrated-' || id ELSE chunk_key END AS chunk_key FROM <chunks>")
def _(v):
    key = F.when(F.col("id") % 4 != 0, F.col("chunk_key"))
    return v.chunks.select("id", F.coalesce(key, F.concat(F.lit("migrated-"), F.col("id").cast("string"))).alias("chunk_key"))


@query("g1_concept_coverage", """
WITH h AS (SELECT t.concept_id, count(DISTINCT k.id) AS n FROM <concept_terms> t JOIN <chunks> k ON contains(lower(concat_ws(' ', k.topic, k.source_excerpt)), t.term) GROUP BY 1)
SELECT c.concept_id, coalesce(n, 0) AS chunks, coalesce(n, 0) < 2 AS thin FROM (SELECT DISTINCT concept_id FROM <concept_terms>) c LEFT JOIN h ON h.concept_id = c.concept_id""")
def _(v):
    return A.chunks_per_concept(v.chunks, v.concept_terms)


_ISSUES = [("shouting", "!!"), ("table", " \\| "), ("marks", "###")]


@query("g2_item_issues", " UNION ALL ".join(f"SELECT id, '{n}' AS issue FROM <chunks> WHERE regexp_matches(source_excerpt, '{p}')" for n, p in _ISSUES))
def _(v):
    return A.pattern_issues(v.chunks, _ISSUES, "source_excerpt")


@query("g4_pack_errors", """
WITH j AS (SELECT pack_id, payload, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS v FROM <packs>),
l AS (SELECT *, CASE WHEN coalesce(json_extract_string(v, '$.lecture_id'), '') NOT IN ('', '0') THEN json_extract_string(v, '$.lecture_id') WHEN coalesce(json_extract_string(v, '$.lecture_number'), '') NOT IN ('', '0') THEN json_extract_string(v, '$.lecture_number') ELSE 'pack_' || pack_id END AS lecture FROM j),
c AS (SELECT pack_id, lecture, unnest(range(CAST(json_array_length(v, '$.concepts') AS BIGINT))) AS i, v FROM l WHERE json_type(v, '$.concepts') = 'ARRAY')
SELECT pack_id, lecture, '(pack)' AS label, CASE WHEN coalesce(json_type(v), '') <> 'OBJECT' THEN 'pack_not_object' ELSE 'pack_missing_concepts' END AS error FROM l WHERE coalesce(json_type(v), '') <> 'OBJECT' OR coalesce(json_type(v, '$.concepts'), '') <> 'ARRAY'
UNION ALL SELECT pack_id, lecture, 'concept_' || i, 'concept_not_object' FROM c WHERE json_type(v, '$.concepts[' || i || ']') <> 'OBJECT'""")
def _(v):
    return A.pack_errors(v.packs)


@query("g3_stripped_stubs", "SELECT id FROM <chunks> WHERE regexp_replace(source_excerpt, 'All rights reserved[.]', '', 'g') <> source_excerpt")
def _(v):
    return v.chunks.filter(A.strip_stub(F.col("source_excerpt"), "All rights reserved[.]") != F.col("source_excerpt")).select("id")


@query("g5_uncovered_lectures", "SELECT DISTINCT concept_family, lecture_number FROM <chunks> WHERE (lecture_number, concept_family) NOT IN (SELECT k.lecture_number, k.concept_family FROM <chunks> k JOIN <cases> c ON c.id = k.id AND c.critical)")
def _(v):
    dim = v.chunks.select("concept_family", "lecture_number").distinct()
    seen = v.chunks.join(v.cases.filter("critical").select("id"), "id", "left_semi").select("concept_family", "lecture_number").distinct()
    return dim.join(seen, ["concept_family", "lecture_number"], "left_anti")
