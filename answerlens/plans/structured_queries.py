"""Queries of structured questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import constraints as C
from answerlens.operators import retrieval as R
from answerlens.operators import selection as Y
from answerlens.operators import structured as S
from answerlens.plans.registry import query
from answerlens.plans.retrieval_queries import _LEX, _Q, asked, hits
from answerlens.plans.routing_queries import _ROUTED, _TEXTS, PATTERNS
from answerlens.plans.text_queries import terms_sql, units_sql

_NAMED = r"""
words AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term, unnest(range(len(regexp_extract_all(lower(query_text), '[a-z0-9]+')))) AS pos FROM <queries>),
named AS (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY min(pos), concept_id) AS place FROM words JOIN <concept_terms> USING (term) GROUP BY query_id, concept_id)"""


@query("q7_concept_scope", f"""
WITH {_NAMED}, own AS (SELECT query_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(query_text), '(?:lecture|lec|week|class)\\s*#?\\s*([0-9]{{1,6}})', 1), lambda x: CAST(x AS INT)))) AS ns FROM <queries>),
scope AS (SELECT query_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS lectures FROM (SELECT query_id, unnest(ns) AS n FROM own UNION SELECT query_id, lecture_number FROM named JOIN <concept_lectures> USING (concept_id)) GROUP BY 1),
given AS (SELECT query_id, hint, min(place * 100 + pos) AS spot FROM named JOIN <concept_hints> USING (concept_id) WHERE pos < 4 GROUP BY 1, 2),
told AS (SELECT query_id, string_agg(hint, '|' ORDER BY spot, hint) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, hint) AS r FROM given) WHERE r <= 12 GROUP BY 1)
SELECT q.query_id, coalesce(lectures, '') AS lectures, coalesce(hints, '') AS hints FROM <queries> q LEFT JOIN scope USING (query_id) LEFT JOIN told USING (query_id)""")
def _(v):
    x = S.concept_scope(v.queries, v.concept_terms, v.concept_lectures, v.concept_hints)
    return x.select("query_id", F.array_join(F.col("lectures").cast("array<string>"), ",").alias("lectures"), F.array_join("hints", "|").alias("hints"))


@query("q7_named_phrases", r"""
WITH terms AS (SELECT 'p' || (query_id % 5) AS concept_id, split_part(query_text, ' ', 2) || ' ' || split_part(query_text, ' ', 3) || ' ' || split_part(query_text, ' ', 4) AS term FROM <queries> WHERE query_id % 3 = 0
  UNION ALL SELECT 'q' || (query_id % 4), split_part(query_text, ' ', 2) || '-' || split_part(query_text, ' ', 3) || ' ' || split_part(query_text, ' ', 4) || ' ' || split_part(query_text, ' ', 5) FROM <queries> WHERE query_id % 3 = 1
  UNION ALL SELECT 's' || (query_id % 3), split_part(query_text, ' ', 2) FROM <queries>),
ph AS (SELECT DISTINCT concept_id, regexp_extract_all(lower(term), '[a-z0-9]+') AS p FROM terms WHERE len(regexp_extract_all(lower(term), '[a-z0-9]+')) > 0), q AS (SELECT query_id, regexp_extract_all(lower(query_text), '[a-z0-9]+') AS w FROM <queries>),
at AS (SELECT query_id, concept_id, len(p) AS n, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS pos FROM q CROSS JOIN ph),
f AS (SELECT query_id, concept_id, min((pos, -n)) AS spot FROM at GROUP BY 1, 2) SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, concept_id) AS place FROM f""".replace("at AS (SELECT", "seen AS (SELECT").replace("FROM at GROUP", "FROM seen GROUP"))
def _(v):
    word = lambda n: F.split_part("query_text", F.lit(" "), F.lit(n))
    q, name = v.queries, lambda k, n: F.concat(F.lit(k), (F.col("query_id") % n).cast("string")).alias("concept_id")
    three = q.filter("query_id % 3 = 0").select(name("p", 5), F.concat_ws(" ", word(2), word(3), word(4)).alias("term"))
    four = q.filter("query_id % 3 = 1").select(name("q", 4), F.concat(word(2), F.lit("-"), word(3), F.lit(" "), word(4), F.lit(" "), word(5)).alias("term"))
    return S.named_concepts(q, three.unionByName(four).unionByName(q.select(name("s", 3), word(2).alias("term"))))


_TYPED = _ROUTED.split("heads AS (")[0].strip().rstrip(",")
_INTENT = f"CASE WHEN type = 'compare' AND len(e) > 2 THEN '{S.MANY_SIDES}' " + " ".join(f"WHEN type = '{t}' THEN '{i}'" for t, i in S.INTENTS.items()) + f" ELSE '{S.INTENTS['general']}' END"
_STEPS = "CASE intent " + " ".join("WHEN '{}' THEN '{}'".format(k, " | ".join(v)) for k, v in S.STEPS.items()) + " ELSE '{}' END".format(" | ".join(S.STEPS[S.INTENTS["general"]]))


def plans(v):
    """Answer plans of the queries' own types and sides."""
    texts = v.sql(_TEXTS)
    sides = C.compare_entities(texts, sides=r"\s+(?:with|that)\s+", listing="^$", clause=r"(?s)\s+for\s.*$")
    return S.answer_plans(Y.query_types(texts, PATTERNS).withColumnRenamed("type", "query_type"), sides)


@query("q9_answer_plans", f"WITH {_TYPED}, p AS (SELECT query_id, {_INTENT} AS intent, CASE type WHEN 'vague_followup' THEN 'simplified' WHEN 'quiz' THEN 'quiz' ELSE 'teaching' END AS style FROM routed) SELECT query_id, intent, {_STEPS} AS steps, style FROM p")
def _(v):
    return plans(v).withColumn("steps", F.array_join("steps", " | "))


_SUB = _LEX.replace(_Q, "(SELECT concept_id AS query_id, string_agg(term, ' ' ORDER BY term) AS query_text FROM <many_concepts> GROUP BY 1)").replace("query_id % 20 AS lecture", "-1 AS lecture")


@query("r21_fan_out", f"""
WITH {_LEX}, {_NAMED.replace('<concept_terms>', '<many_concepts>')}, plans AS (WITH {_TYPED} SELECT query_id, {_INTENT} AS intent FROM routed), sub AS (WITH {_SUB} SELECT query_id AS concept_id, id, rank AS sub FROM ranked WHERE rank <= 5),
x AS (SELECT query_id, id, 0 AS place, rank AS sub FROM ranked WHERE rank <= 10
  UNION ALL SELECT n.query_id, s.id, n.place, s.sub FROM named n JOIN sub s USING (concept_id) WHERE n.place <= 3 AND n.query_id IN (SELECT query_id FROM named WHERE place = 3) AND n.query_id NOT IN (SELECT query_id FROM plans WHERE intent IN ('compare', 'compare_multi', 'lecture_summary', 'teaching_plus_check'))),
f AS (SELECT query_id, id, min(place * 1000 + sub) AS spot FROM x GROUP BY 1, 2)
SELECT query_id, id, rank, spot >= 1000 AS added FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, id) AS rank FROM f) WHERE rank <= 40""")
def _(v):
    # queries and concepts are asked for in one pass over the chunks
    of_queries, of_concepts = asked(v), S.concept_questions(v.many_concepts)
    none = lambda df: F.lit(None).cast(df.schema["query_id"].dataType)
    both = lambda df, q, c: df.select(F.struct(q.alias("query_id"), c.alias("concept_id")).alias("query_id"), "query_text")
    every = both(of_queries, F.col("query_id"), none(of_concepts)).unionByName(both(of_concepts, none(of_queries), F.col("query_id")))
    found = v.stored("hits_of_both", lambda: R.top_k(R.lexical_scores(every, v.chunks), 10).select("query_id.query_id", "query_id.concept_id", "id", "rank"))
    base, told = found.filter("query_id IS NOT NULL").select("query_id", "id", "rank"), found.filter("concept_id IS NOT NULL").select("concept_id", "id", "rank")
    return S.fan_out(base, v.queries, v.many_concepts, v.chunks, intents=plans(v), told=told)


@query("r42_concept_lookups", """
WITH ids AS (SELECT DISTINCT concept_id FROM <concept_terms>), pairs AS (SELECT x.concept_id AS a, y.concept_id AS b FROM ids x JOIN ids y ON x.concept_id <> y.concept_id),
e AS (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY pos, dst) AS r FROM <concept_edges>),
p AS (SELECT src, string_agg(dst, ',' ORDER BY r) AS prerequisites FROM e WHERE kind = 'prerequisite' GROUP BY 1), l AS (SELECT src, string_agg(dst, ',' ORDER BY r) AS related FROM e WHERE kind = 'related' AND r <= 5 GROUP BY 1),
x AS (SELECT low, high, string_agg(DISTINCT axis, ',' ORDER BY axis) AS axes FROM <concept_axes> GROUP BY 1, 2)
SELECT a, b, coalesce(prerequisites, '') AS prerequisites, coalesce(related, '') AS related, coalesce(axes, '') AS axes
FROM pairs LEFT JOIN p ON p.src = a LEFT JOIN l ON l.src = a LEFT JOIN x ON x.low = least(a, b) AND x.high = greatest(a, b)""")
def _(v):
    ids = v.concept_terms.select(F.col("concept_id").alias("a")).distinct()
    pairs = ids.join(ids.withColumnRenamed("a", "b"), F.col("a") != F.col("b"))  # of the concepts of a knowledge base
    out = S.concept_lookups(pairs, v.concept_edges, v.concept_axes)
    return out.select("a", "b", *[F.array_join(c, ",").alias(c) for c in ("prerequisites", "related", "axes")])


_AXES = ["the role of that", "for whom and by what", "con el que", "an is"]
_NORM = "lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))"


@query("r30_axis_lines", f"""
WITH {_LEX}, l AS (SELECT query_id AS key, r.rank AS pos, k.clean_explanation AS line FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE r.rank <= 6), n AS (SELECT *, {_NORM} AS norm FROM l),
u AS (SELECT DISTINCT key, norm, true AS used FROM n WHERE pos = 1 OR key % 3 = 0), f AS (SELECT key, norm AS first_norm FROM n WHERE pos = 1), axes AS (SELECT unnest({_AXES}) AS axis),
x AS (SELECT n.*, axis, coalesce(used, false) AS used, first_norm, list_filter(regexp_extract_all(lower(axis), '[a-z]+'), lambda w: length(w) > 2) AS words, regexp_extract_all(lower(line), '[a-z0-9]+') AS toks FROM n LEFT JOIN u USING (key, norm) JOIN f USING (key) CROSS JOIN axes),
o AS (SELECT *, CASE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(words, lambda w: list_contains(toks, w)))::DOUBLE / len(words) END AS overlap FROM x),
c AS (SELECT *, CASE WHEN NOT used AND overlap > 0 THEN 0 WHEN NOT used THEN 1 WHEN overlap > 0 THEN 2 WHEN norm <> first_norm THEN 3 ELSE 4 END AS kind FROM o)
SELECT key AS query_id, axis, md5(line) AS line, round(overlap, 6) AS overlap FROM (
  SELECT *, row_number() OVER (PARTITION BY key, axis ORDER BY kind, CASE WHEN kind < 2 THEN -overlap END, CASE WHEN kind < 2 THEN -length(line) END, pos) AS r FROM c) WHERE r = 1""")
def _(v):
    lines = hits(v, 6).join(v.chunks.select("id", "clean_explanation"), "id").select(F.col("query_id").alias("key"), F.col("rank").alias("pos"), F.col("clean_explanation").alias("line"))
    axes = v.queries.select(F.col("query_id").alias("key"), F.explode(F.array(*map(F.lit, _AXES))).alias("axis"))
    out = S.axis_lines(lines, axes, lines.filter("pos = 1 OR key % 3 = 0").select("key", "line"))
    return out.select(F.col("key").alias("query_id"), "axis", F.md5("line").alias("line"), F.round("overlap", 6).alias("overlap"))


_TERMS = terms_sql("query_text")


@query("q6_expanded", f"""
WITH qt AS (SELECT query_id, query_text, unnest({_TERMS}) AS t, unnest(range(len({_TERMS}))) AS pos FROM <queries>), known AS (SELECT DISTINCT unnest(regexp_extract_all(term, '[a-z0-9]+')) AS term FROM <word_concepts>),
p AS (SELECT DISTINCT t, term, levenshtein(t, term) AS d FROM qt JOIN known ON abs(length(t) - length(term)) <= 2 WHERE length(t) >= 5 AND t NOT IN (SELECT term FROM known) AND levenshtein(t, term) <= CASE WHEN length(t) < 8 THEN 1 ELSE 2 END),
fix AS (SELECT t, min_by(term, (d, term)) AS fixed FROM p GROUP BY 1), c AS (SELECT query_id, query_text, pos, fixed, coalesce(fixed, t) AS term FROM qt LEFT JOIN fix USING (t)),
a AS (SELECT DISTINCT x.term, y.term AS alias FROM <concept_terms> x JOIN <concept_terms> y ON x.concept_id = y.concept_id AND x.term <> y.term),
w AS (SELECT query_id, 0 AS kind, alias, min(pos) AS pos FROM c JOIN a USING (term) WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.query_id = c.query_id AND z.term = a.alias) GROUP BY 1, 2, 3
  UNION ALL SELECT query_id, 1, fixed, min(pos) FROM c WHERE fixed IS NOT NULL AND NOT contains(lower(query_text), fixed) GROUP BY 1, 2, 3),
s AS (SELECT query_id, string_agg(alias, ' ' ORDER BY kind, pos, alias) AS words FROM w GROUP BY 1)
SELECT q.query_id, md5(query_text || CASE WHEN words IS NULL THEN '' ELSE ' ' || words END || CASE WHEN lower(trim(strip_accents(query_text))) <> lower(trim(query_text)) THEN ' ' || trim(strip_accents(query_text)) ELSE '' END) AS expanded FROM <queries> q LEFT JOIN s USING (query_id)""")
def _(v):
    a, b = v.concept_terms, v.concept_terms.withColumnRenamed("term", "alias")
    aliases = a.join(b, "concept_id").filter("term <> alias").select("term", "alias")
    known = v.word_concepts.select(F.explode(F.regexp_extract_all("term", F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).distinct()
    out = S.expanded_queries(v.queries, aliases, known)
    return out.select("query_id", F.md5("expanded").alias("expanded"))


_HOLDS = "len(list_filter(regexp_extract_all(lower(line), '[a-z0-9]+'), lambda t: t = '{0}'))"


@query("r29_tiered_lines", f"""
WITH {_LEX}, u AS (SELECT query_id AS key, rank, {units_sql('source_excerpt')} AS u FROM ranked r JOIN <chunks> k ON k.id = r.id WHERE r.rank <= 8),
l AS (SELECT key, rank * 1000000 + unnest(range(len(u))) AS pos, unnest(u) AS line FROM u),
t AS (SELECT *, CASE WHEN {_HOLDS.format('the')} + {_HOLDS.format('de')} = 0 AND {_HOLDS.format('on')} + {_HOLDS.format('of')} = 0 THEN 1 WHEN {_HOLDS.format('the')} + {_HOLDS.format('de')} = 0 THEN 2 ELSE 3 END AS tier,
  round({_HOLDS.format('in')} + {_HOLDS.format('la')} - 0.35::DOUBLE * (contains(lower(line), 'of the')::INT + contains(lower(line), 'in the')::INT) / greatest(len(regexp_extract_all(lower(line), '\\S+')) / 20.0::DOUBLE, 1.0), 9) AS score FROM l),
b AS (SELECT *, min(tier) OVER (PARTITION BY key) AS best FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, length(line), pos) AS spot FROM b WHERE tier = best),
d AS (SELECT key, tier, min((spot, line)) AS x FROM o WHERE tier < 3 OR spot <= 16 GROUP BY key, tier, substr(lower(trim(line)), 1, 240)), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY struct_extract(x, 1)) AS place FROM d)
SELECT key AS query_id, md5(trim(struct_extract(x, 2))) AS line, tier, place, tier = 3 AS provisional FROM p WHERE place <= 8""")
def _(v):
    cut = hits(v, 8).join(v.chunks.select("id", "source_excerpt"), "id").select("query_id", "rank", F.posexplode(T.units(F.col("source_excerpt"))).alias("pos", "line"))
    lines = cut.select(F.col("query_id").alias("key"), (F.col("rank").cast("long") * 1_000_000 + F.col("pos")).alias("pos"), "line")
    out = S.tiered_lines(lines, ["in", "la"], ["on", "of"], ["the", "de"], ["of the", "in the"])
    return out.select(F.col("key").alias("query_id"), F.md5("line").alias("line"), "tier", "place", "provisional")
