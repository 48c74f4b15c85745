"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import retrieval as R
from answerlens.plans.registry import query
from answerlens.plans.text_queries import FAMILY_SQL, terms_sql

_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_FIELDS = ["topic", "clean_explanation", "source_excerpt"]
_GRAM = "list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))"
#: Queries name the lecture that their id picks, so that every lecture bonus is exercised.
_Q = "(SELECT query_id, query_text || ' lecture ' || (query_id % 20) AS query_text FROM <queries>)"
_LEX = f"""
fields AS ({' UNION ALL '.join(f"SELECT id, {i} AS ord, '{f}' AS field, {_TOK.format(f)} AS w FROM <chunks>" for i, f in enumerate(_FIELDS))}),
lens AS (SELECT id, sum(len(w)) AS total FROM fields GROUP BY 1), q AS (SELECT query_id, {terms_sql('query_text')} AS terms, query_id % 20 AS lecture FROM {_Q}),
qt AS (SELECT query_id, unnest(terms) AS t, unnest(range(len(terms))) AS qpos FROM q), variants AS (SELECT query_id, qpos, unnest({FAMILY_SQL}) AS tok FROM qt),
tf AS (SELECT id, field, tok, count(*) AS n FROM (SELECT id, field, unnest(w) AS tok FROM fields) WHERE tok IN (SELECT tok FROM variants) GROUP BY ALL),
best AS (SELECT query_id, id, field, qpos, max(n) AS n FROM tf JOIN variants USING (tok) GROUP BY ALL),
tokens AS (SELECT query_id, id, sum(g) AS token_score, sum(CASE WHEN field = 'topic' THEN g ELSE 0 END) AS strong_score, count(DISTINCT qpos) AS matched FROM (
  SELECT *, (CASE field WHEN 'topic' THEN 3.0 WHEN 'clean_explanation' THEN 1.2 ELSE 1.0 END)::DOUBLE * (1.0::DOUBLE + 0.32::DOUBLE * least(n - 1, 2)) AS g FROM best) GROUP BY ALL),
asked AS (SELECT a.query_id, a.qpos AS gpos, 2 AS n, a.tok || ' ' || b.tok AS gram FROM variants a JOIN variants b ON a.query_id = b.query_id AND b.qpos = a.qpos + 1
  UNION ALL SELECT a.query_id, a.qpos, 3, a.tok || ' ' || b.tok || ' ' || c.tok FROM variants a JOIN variants b ON a.query_id = b.query_id AND b.qpos = a.qpos + 1 JOIN variants c ON a.query_id = c.query_id AND c.qpos = a.qpos + 2),
events AS (SELECT DISTINCT query_id, id, ord, field, n, gpos FROM (SELECT id, ord, field, unnest({_GRAM}) AS gram FROM fields) JOIN asked USING (gram)),
phrases AS (SELECT query_id, id, sum((CASE WHEN n = 2 THEN 1.05 ELSE 1.45 END)::DOUBLE * (CASE field WHEN 'topic' THEN 1.0 WHEN 'clean_explanation' THEN 0.55 ELSE 0.5 END)::DOUBLE) AS phrase_score, count(*) AS phrase_events
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY ord, n, gpos) AS r FROM events) WHERE r <= 5 GROUP BY ALL),
bonus AS (SELECT query_id, id, 2.85::DOUBLE AS lecture_bonus FROM q JOIN <chunks> ON lecture_number = lecture),
scored AS (SELECT query_id, id, coalesce(token_score, 0.0) AS token_score, coalesce(strong_score, 0.0) AS strong_score, coalesce(phrase_score, 0.0) AS phrase_score, coalesce(phrase_events, 0) AS phrase_events,
  coalesce(lecture_bonus, 0.0) AS lecture_bonus, coalesce(matched, 0) AS matched, round((coalesce(token_score, 0.0) + coalesce(phrase_score, 0.0) + coalesce(lecture_bonus, 0.0)) / (1.0::DOUBLE + 0.24::DOUBLE * ln(1 + total)), 9) AS score
  FROM tokens LEFT JOIN phrases USING (query_id, id) FULL JOIN bonus USING (query_id, id) JOIN lens USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)"""


def asked(v):
    return v.queries.select("query_id", F.concat("query_text", F.lit(" lecture "), (F.col("query_id") % 20).cast("string")).alias("query_text"))


def counted(v, k):
    """The first k chunks of each query with their scores and the number of all its hits, written once; hits(v, k) then are these."""
    return v.stored(f"hits{k}", lambda: R.counted_top_k(asked(v), v.chunks, k))


def hits(v, k):
    """The first k chunks of each query, written once; only they are, not the scores that they come from."""
    return v.stored(f"hits{k}", lambda: R.top_k(R.lexical_scores(asked(v), v.chunks), k).select("query_id", "id", "score", "rank"))


@query("r1_postings", f"WITH f AS ({' UNION ALL '.join(f'''SELECT id, '{f}' AS field, {_TOK.format(f)} AS w FROM <chunks>''' for f in _FIELDS)}) SELECT tok, field, count(*) AS n, count(DISTINCT id) AS chunks FROM (SELECT id, field, unnest(w) AS tok FROM f) GROUP BY 1, 2")
def _(v):
    return R.postings(v.chunks).groupBy("tok", "field").agg(F.count("*").alias("n"), F.countDistinct("id").alias("chunks"))


@query("r2_token_scores", f"WITH {_LEX} SELECT query_id, id, round(token_score, 6) AS token_score, round(strong_score, 6) AS strong_score, matched FROM tokens")
def _(v):
    return R.token_scores(R.query_table(asked(v)), v.chunks).select("query_id", "id", F.round("token_score", 6).alias("token_score"), F.round("strong_score", 6).alias("strong_score"), "matched")


@query("r3_phrase_scores", f"WITH {_LEX} SELECT query_id, id, round(phrase_score, 6) AS phrase_score, phrase_events FROM phrases")
def _(v):
    return R.phrase_scores(R.query_table(asked(v)), v.chunks).select("query_id", "id", F.round("phrase_score", 6).alias("phrase_score"), "phrase_events")


@query("r4_lexical_scores", f"WITH {_LEX} SELECT query_id, id, round(score, 6) AS score, lecture_bonus FROM scored")
def _(v):
    return R.lexical_scores(asked(v), v.chunks).select("query_id", "id", F.round("score", 6).alias("score"), "lecture_bonus")


@query("r5_lexical_topk", f"WITH {_LEX} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def _(v):
    return hits(v, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_CONF = f"""
WITH {_LEX}, b AS (SELECT r.*, k.lecture_number FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE rank = 1), s AS (SELECT query_id, score AS second FROM ranked WHERE rank = 2), h AS (SELECT query_id, count(*) AS hits FROM ranked GROUP BY 1),
x AS (SELECT q.query_id, coalesce(b.score, 0.0) AS top_score, coalesce(second, 0.0) AS second_score, (b.score - coalesce(second, 0.0)) / (b.score + 1e-6) AS margin, matched::DOUBLE / greatest(len(terms), 1) AS coverage, coalesce(hits, 0) AS hits,
  b.*, lecture_number = lecture AS hit FROM q LEFT JOIN b ON b.query_id = q.query_id LEFT JOIN s ON s.query_id = q.query_id LEFT JOIN h ON h.query_id = q.query_id),
c AS (SELECT *, 0.2 * score / (score + 14.0) + 0.22 * least(1.0, margin * 1.15) + 0.28 * coverage + 0.14 * least(1.0, phrase_events / 3.5) + 0.11 * least(1.0, (strong_score + 0.35 * phrase_score) / (token_score + phrase_score + 1e-6)) + CASE WHEN hit THEN 0.05 ELSE 0.0 END AS conf FROM x)
SELECT query_id, top_score, second_score, round(coalesce(margin, 0.0), 6) AS margin, round(coalesce(coverage, 0.0), 6) AS coverage, hits, round(CASE WHEN score IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN hit THEN greatest(conf, 0.44) ELSE conf END)) END, 6) AS confidence FROM c"""


@query("r6_confidence", _CONF)
def _(v):
    return R.confidence(asked(v), counted(v, 2), v.chunks)


@query("r7_diagnostics", f"WITH {_LEX} SELECT query_id, count(*) AS hits, round(max(score), 6) AS top_score, round(sum(token_score), 4) AS token_mass, sum(phrase_events) AS phrase_events FROM ranked GROUP BY 1")
def _(v):
    s = R.lexical_scores(asked(v), v.chunks).filter("score > 0")
    return s.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("top_score"), F.round(F.sum("token_score"), 4).alias("token_mass"), F.sum("phrase_events").alias("phrase_events"))


@query("r8_lecture_ranking", f"""
WITH {_LEX}, a AS (SELECT query_id, k.id FROM q JOIN <chunks> k ON k.lecture_number = q.lecture), x AS (SELECT a.query_id, a.id, coalesce(score, 0.0) AS score FROM a LEFT JOIN scored s ON s.query_id = a.query_id AND s.id = a.id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 20""")
def _(v):
    return R.lecture_ranking(R.lexical_scores(asked(v), v.chunks), asked(v), v.chunks, 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_DENSE = """
dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM <embeddings> a JOIN <embeddings> b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id))"""


def dense(v, k):
    vectors = v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.dense_top_k(vectors.filter("id % 50 = 0"), vectors, k)


@query("r9_dense_topk", f"WITH {_DENSE} SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def _(v):
    return dense(v, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("r10_hybrid", f"""
WITH {_LEX}, {_DENSE}, l AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS lex FROM ranked WHERE rank <= 40), d AS (SELECT query_id // 50 AS query_id, id, score AS cos FROM dense WHERE rank <= 40),
f AS (SELECT query_id, id, round(0.45 * coalesce(lex, 0.0) + 0.55 * coalesce(cos, 0.0), 9) AS score FROM l FULL JOIN d USING (query_id, id) WHERE query_id IN (SELECT query_id FROM l))
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def _(v):
    d = dense(v, 40).withColumn("query_id", (F.col("query_id") / 50).cast("long"))
    return R.hybrid(hits(v, 40), d, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_SIDES = "a AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 6 AND query_id % 2 = 0), b AS (SELECT query_id - 1 AS query_id, id, rank FROM ranked WHERE rank <= 6 AND query_id % 2 = 1)"


def sides(v):
    h = hits(v, 6)
    return h.filter("query_id % 2 = 0"), h.filter("query_id % 2 = 1").withColumn("query_id", F.col("query_id") - 1)


@query("r12_two_sided", f"""
WITH {_LEX}, {_SIDES}, m AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, least(coalesce(x.n, 0), coalesce(y.n, 0)) AS bothn FROM (SELECT query_id, max(rank) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT query_id, max(rank) AS n FROM b GROUP BY 1) y ON x.query_id = y.query_id),
u AS (SELECT query_id, id, min(CASE WHEN rank <= bothn THEN rank * 2 + side ELSE 1000 + side * 1000 + rank END) AS place FROM (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b) JOIN m USING (query_id) GROUP BY 1, 2)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM u) WHERE rank <= 8""")
def _(v):
    return R.interleave(*sides(v), 8)


_APPEND = "u AS (SELECT query_id, id, min(list * 1000 + rank) AS place FROM (SELECT query_id - query_id % 4 AS query_id, query_id % 4 AS list, id, rank FROM ranked WHERE rank <= 5) GROUP BY 1, 2)"


@query("r13_many_sided", f"WITH {_LEX}, {_APPEND} SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM u) WHERE rank <= 18")
def _(v):
    lists = hits(v, 5).select((F.col("query_id") - F.col("query_id") % 4).alias("query_id"), (F.col("query_id") % 4).alias("list"), "id", "rank")
    return R.append_lists(lists, 18)


@query("r14_merged_lists", f"""
WITH {_LEX}, {_SIDES}, u AS (SELECT query_id, id, min(place) AS place FROM (SELECT query_id, id, rank AS place FROM a UNION ALL SELECT query_id, id, 1000 + rank FROM b) GROUP BY 1, 2)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM u) WHERE rank <= 9""")
def _(v):
    a, b = sides(v)
    return R.append_lists(a.select("query_id", F.lit(0).alias("list"), "id", "rank").unionByName(b.select("query_id", F.lit(1).alias("list"), "id", "rank")), 9)


@query("r15_merged_diagnostics", f"WITH {_LEX}, {_SIDES}, u AS (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) SELECT query_id, count(DISTINCT u.id) AS chunks, min(rank) AS best, count(DISTINCT lecture_number) AS lectures FROM u JOIN <chunks> k ON k.id = u.id GROUP BY 1")
def _(v):
    a, b = sides(v)
    u = a.unionByName(b).join(v.chunks.select("id", "lecture_number"), "id")
    return u.groupBy("query_id").agg(F.countDistinct("id").alias("chunks"), F.min("rank").alias("best"), F.countDistinct("lecture_number").alias("lectures"))


_DIV = "x AS (SELECT r.query_id, r.id, r.rank, k.lecture_number, row_number() OVER (PARTITION BY query_id, lecture_number ORDER BY rank) > 1 AS again FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE rank <= 30)"


@query("r16_diversified", f"WITH {_LEX}, {_DIV} SELECT query_id, id, lecture_number, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, rank) AS place FROM x) WHERE place <= 12")
def _(v):
    return R.diversify(hits(v, 30), v.chunks, 12)


@query("r17_supporting", f"""
WITH {_LEX}, l AS (SELECT DISTINCT r.query_id, k.lecture_number FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE rank <= 5), n AS (SELECT DISTINCT query_id, dst AS lecture_number FROM l JOIN <lecture_edges> e ON e.src = l.lecture_number),
c AS (SELECT n.query_id, k.id, k.lecture_number FROM n JOIN <chunks> k ON k.lecture_number = n.lecture_number WHERE k.chunk_type = 'definition' AND NOT EXISTS (SELECT 1 FROM l WHERE l.query_id = n.query_id AND l.lecture_number = n.lecture_number))
SELECT query_id, id, lecture_number, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lecture_number, id) AS place FROM c) WHERE place <= 4""")
def _(v):
    return R.supporting(hits(v, 5), v.chunks, v.lecture_edges, ["definition"])


@query("r18_preferred_types", f"WITH {_LEX} SELECT r.query_id, r.id, r.rank, row_number() OVER (PARTITION BY query_id ORDER BY k.chunk_type <> 'overview', rank) AS place FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE rank <= 12")
def _(v):
    return R.prefer_types(hits(v, 12), v.chunks, ["overview"])


@query("r19_without_glossary", "SELECT id FROM <chunks> WHERE NOT regexp_matches(lower(concat_ws(' ', topic, substr(source_excerpt, 1, 200))), 'licen[cs]e|all rights')")
def _(v):
    return R.without_phrases(v.chunks, "licen[cs]e|all rights").select("id")


_ENT = f"""{_LEX}, cand AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 12), toks AS (SELECT id, unnest({_TOK.format("concat_ws(' ', topic, source_excerpt)")}) AS term FROM <chunks> WHERE id IN (SELECT id FROM cand)),
n AS (SELECT id, concept_id, count(*) AS hits FROM toks JOIN <concept_terms> USING (term) GROUP BY 1, 2), eh AS (SELECT c.*, concept_id, hits FROM cand c JOIN n ON n.id = c.id),
es AS (SELECT *, round(1.2::DOUBLE * hits - 0.45::DOUBLE * (sum(hits) OVER p - hits) - 1.1::DOUBLE * sum(CASE WHEN concept_id = 'c3' THEN hits ELSE 0 END) OVER p + 0.15::DOUBLE * hits / sum(hits) OVER p, 9) AS score FROM eh WINDOW p AS (PARTITION BY query_id, id))"""


def entities(v, keep=False):
    return R.entity_hits(hits(v, 12), v.chunks, v.concept_terms, keep)


@query("r22_entity_scores", f"WITH {_ENT} SELECT query_id, id, concept_id, hits, round(score, 6) AS score FROM es")
def _(v):
    return R.entity_scores(entities(v), ["c3"]).select("query_id", "id", "concept_id", "hits", F.round("score", 6).alias("score"))


_OF = "coalesce(sum(CASE WHEN concept_id = '{0}' THEN hits END), 0)"


@query("r23_concept_rerank", f"""
WITH {_ENT}, f AS (SELECT c.query_id, c.id, {_OF.format('c1')} AS own, {_OF.format('c3')} AS bad, coalesce(sum(hits), 0) AS total FROM cand c LEFT JOIN n ON n.id = c.id GROUP BY 1, 2),
sc AS (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE round(1.2::DOUBLE * own - 0.45::DOUBLE * (total - own) - 1.1::DOUBLE * bad + 0.15::DOUBLE * own / total, 9) END AS score FROM f)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM sc""")
def _(v):
    return R.concept_rerank(entities(v, keep=True), "c1", ["c3"])


@query("r24_purity", f"""
WITH {_ENT}, g AS (SELECT c.query_id, c.id, c.rank, coalesce(bool_or(concept_id = 'c1'), false) AS own, coalesce(bool_or(concept_id = 'c2'), false) AS bad FROM cand c LEFT JOIN n ON n.id = c.id GROUP BY 1, 2, 3), t AS (SELECT *, CASE WHEN own AND NOT bad THEN 1 WHEN NOT bad THEN 2 ELSE 3 END AS tier FROM g),
b AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM t) SELECT query_id, id, rank, tier FROM b WHERE best = 3 OR tier <= best""")
def _(v):
    return R.purity_tiers(entities(v, keep=True), "c1", "c2")


@query("r26_bundles", f"""
WITH {_ENT}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY score DESC, id) AS place FROM es)
SELECT query_id, concept_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids, round(max(score), 6) AS support, max(score) < 0.15 AS low_support FROM p WHERE place <= 4 GROUP BY 1, 2""")
def _(v):
    return R.bundles(R.entity_scores(entities(v), ["c3"])).withColumn("support", F.round("support", 6))


@query("r27_bundles_multi", f"""
WITH {_ENT}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, concept_id ORDER BY score DESC, id) AS place FROM es)
SELECT query_id, concept_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids, round(max(score), 6) AS support FROM p WHERE place <= 3 GROUP BY 1, 2""")
def _(v):
    return R.bundles(R.entity_scores(entities(v), ["c3"]), per_side=3).select("query_id", "concept_id", "ids", F.round("support", 6).alias("support"))


@query("r33_complete_evidence", f"WITH {_ENT} SELECT query_id, count(DISTINCT concept_id) AS concepts, count(DISTINCT concept_id) >= 3 AS complete FROM cand c LEFT JOIN n ON n.id = c.id GROUP BY 1")
def _(v):
    return R.complete_evidence(entities(v, keep=True), 3)


@query("r37_keyword_sets", f"""
WITH {_LEX}, {_SIDES}, w AS (SELECT id, unnest({terms_sql('topic')}) AS w FROM <chunks>), x AS (SELECT query_id, list_distinct(list(w)) AS a FROM a JOIN w USING (id) GROUP BY 1), y AS (SELECT query_id, list_distinct(list(w)) AS b FROM b JOIN w USING (id) GROUP BY 1),
z AS (SELECT query_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM x FULL JOIN y USING (query_id))
SELECT query_id, array_to_string(list_sort(list_intersect(a, b))[1:12], ',') AS shared, array_to_string(list_sort(list_filter(a, lambda t: NOT list_contains(b, t)))[1:12], ',') AS only_a, array_to_string(list_sort(list_filter(b, lambda t: NOT list_contains(a, t)))[1:12], ',') AS only_b FROM z""")
def _(v):
    return R.keyword_sets(*sides(v), v.chunks)


@query("r38_catalogue", "SELECT lecture_number, trim(string_split(min_by(topic, id), '—')[1]) AS title, count(*) AS sections, min(id) AS first_id FROM <chunks> GROUP BY 1")
def _(v):
    return R.catalogue(v.chunks)


@query("r39_topic_scoped", f"WITH {_ENT} SELECT DISTINCT query_id, id, rank FROM eh WHERE concept_id IN ('c1', 'c2')")
def _(v):
    h = hits(v, 12).select("query_id", "id", "rank")
    found = entities(v).filter("concept_id IN ('c1', 'c2')").select("query_id", "id").distinct()
    return h.join(found, ["query_id", "id"], "left_semi")


@query("r42_concept_pairs", "SELECT least(low, high) AS low, greatest(low, high) AS high, count(DISTINCT axis) AS axes FROM <concept_axes> GROUP BY 1, 2")
def _(v):
    return v.concept_axes.groupBy(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).agg(F.countDistinct("axis").alias("axes"))


def _recap_sql(ranked: str) -> str:
    first = "string_split(trim(coalesce(nullif(trim(clean_explanation), ''), source_excerpt, '')), chr(10))[1]"
    return f"""x AS (SELECT key, trim(coalesce(topic, '')) AS topic, {first} AS first, lecture_number, row_number() OVER (PARTITION BY key ORDER BY place, k.id) AS place FROM ({ranked}) r JOIN <chunks> k ON k.id = r.id),
w AS (SELECT key, count(DISTINCT lecture_number) AS lectures FROM x GROUP BY 1), lead AS (SELECT key, trim(string_split(topic, '—')[1]) AS title, trim(substr(first, 1, 720)) AS main_line FROM x WHERE place = 1),
told AS (SELECT key, string_agg(topic || ': ' || substr(first, 1, 320), chr(10) ORDER BY place) AS supporting FROM x WHERE place <= 10 AND topic <> '' AND first <> '' GROUP BY 1),
heads AS (SELECT key, trim(string_split(topic, '—')[1]) AS head, min(place) AS place FROM x WHERE place <= 8 AND trim(string_split(topic, '—')[1]) <> '' GROUP BY 1, 2), six AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS r FROM heads),
named AS (SELECT key, string_agg(head, ', ' ORDER BY place) AS topics FROM six WHERE r <= 6 GROUP BY 1)
SELECT w.key, title, main_line, md5(coalesce(supporting, '')) AS supporting, coalesce(topics, '') AS topics, lectures FROM w JOIN lead USING (key) LEFT JOIN told USING (key) LEFT JOIN named USING (key)"""


def _told(out):
    lines = F.array_join(F.transform("supporting", lambda r: F.concat(r["topic"], F.lit(": "), r["line"])), "\n")
    return out.select("key", "title", "main_line", F.md5(lines).alias("supporting"), F.array_join("topics", ", ").alias("topics"), "lectures")


@query("r46_recap", "WITH " + _recap_sql("SELECT lecture_number AS key, id, 0 AS place FROM <chunks>"))
def _(v):
    return _told(R.recaps(v.chunks.select(F.col("lecture_number").alias("key"), "id", F.lit(0).alias("rank")), v.chunks))


@query("r46_topic_recap", f"WITH {_LEX}, " + _recap_sql("SELECT query_id AS key, id, rank AS place FROM ranked WHERE rank <= 8"))
def _(v):
    return _told(R.recaps(hits(v, 8).withColumnRenamed("query_id", "key"), v.chunks))
