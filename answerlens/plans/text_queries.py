"""Queries over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.plans.registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in [*T.STOPWORDS, *T.TWO_LETTER_NOISE]) + "]"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_TERMS = f"list_filter({_TOK}, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"
FILLER = ["the", "of the", "that is", "in the"]


def terms_sql(c: str) -> str:
    return _TERMS.format(c)


@query("t1_tokens", f"SELECT doc_id, len({_TOK.format('text')}) AS n, array_to_string({_TOK.format('text')}, ' ') AS joined FROM <documents>")
def _(v):
    return v.documents.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"), F.array_join(T.tokens(F.col("text")), " ").alias("joined"))


@query("t2_query_terms", f"SELECT query_id, array_to_string({terms_sql('query_text')}, ' ') AS terms FROM <queries>")
def _(v):
    return v.queries.select("query_id", F.array_join(T.query_terms(F.col("query_text")), " ").alias("terms"))


_STEM = """CASE WHEN length(t) <= 2 THEN t WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 4 AND t LIKE '%es' AND t NOT LIKE '%ses' THEN left(t, length(t) - 2)
 WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) WHEN length(t) > 7 AND t LIKE '%ing' THEN left(t, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, length(t) - 2) ELSE t END"""
_VOCAB = f"SELECT DISTINCT unnest({_TOK.format('text')}) AS t FROM <documents>"


def vocabulary(v):
    return v.documents.select(F.explode(T.tokens(F.col("text"))).alias("t")).distinct()


@query("t3_stems", f"SELECT t, {_STEM} AS stem FROM ({_VOCAB})")
def _(v):
    return vocabulary(v).select("t", T.light_stem(F.col("t")).alias("stem"))


_PLURAL = "(t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) >= 5)"
FAMILY_SQL = f"""list_distinct(list_filter([t, {_STEM}, CASE WHEN {_PLURAL} THEN left(t, length(t) - 1) END, CASE WHEN {_PLURAL} AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' END,
 CASE WHEN length(t) >= 6 AND t NOT LIKE '%s' THEN t || 's' END, CASE WHEN NOT {_PLURAL} AND length(t) > 4 AND t LIKE '%y' AND substr(t, length(t) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(t, length(t) - 1) || 'ies' END,
 CASE t WHEN 'backprop' THEN 'backpropagation' WHEN 'mfcc' THEN 'mfccs' END, CASE t WHEN 'backprop' THEN 'backpropagation' WHEN 'mfcc' THEN 'mfcc' END], lambda x: x IS NOT NULL AND x <> ''))"""


@query("t4_families", f"SELECT t, array_to_string(list_sort({FAMILY_SQL}), ' ') AS forms FROM ({_VOCAB})")
def _(v):
    return vocabulary(v).select("t", F.array_join(F.array_sort(T.family(F.col("t"))), " ").alias("forms"))


@query("t5_lecture_numbers", "SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(q), '(?:lecture|lec|week|class)\\s*#?\\s*([0-9]{1,6})', 1), lambda x: CAST(x AS INT)))), ',') AS numbers FROM (SELECT id, 'Lecture ' || lecture_number || ' ' || topic || ' week ' || (id % 9) AS q FROM <chunks>)")
def _(v):
    q = v.chunks.select("id", F.concat(F.lit("Lecture "), "lecture_number", F.lit(" "), "topic", F.lit(" week "), (F.col("id") % 9).cast("string")).alias("q"))
    return q.select("id", F.array_join(T.lecture_numbers(F.col("q")).cast("array<string>"), ",").alias("numbers"))


@query("t6_lecture_ranges", """
SELECT id, array_to_string(CASE id % 6 WHEN 0 THEN range(n, n + id % 4 + 1) WHEN 2 THEN range(n, n + 6) WHEN 4 THEN range(n, n + 1201) WHEN 5 THEN range(0, n + 1) ELSE [] END, ',') AS numbers
FROM (SELECT id, lecture_number::BIGINT AS n FROM <chunks>)""")
def _(v):
    n = lambda k=0: (F.col("lecture_number") + k).cast("string")
    texts = [
        F.concat(F.lit("lectures "), n(), F.lit(" through "), (F.col("lecture_number") + F.col("id") % 4).cast("string")), F.concat(F.lit("scores "), n(), F.lit("-"), n(3), F.lit(" at home")),
        F.concat(F.lit("Week "), n(), F.lit("—"), n(2), F.lit(" and lec. "), n(1), F.lit(" to "), n(5)), F.concat(F.lit("lecture "), n(3), F.lit(" to "), n()),
        F.concat(F.lit("weeks "), n(), F.lit(" – "), n(1200)), F.concat(F.lit("LEC 0-"), n(), F.lit(", lecture 5 or 6, and lecture 99999999999999999999-3")),
    ]
    q = v.chunks.select("id", F.get(F.array(*texts), (F.col("id") % 6).cast("int")).alias("q"))
    return q.select("id", F.array_join(T.lecture_range(F.col("q")).cast("array<string>"), ",").alias("numbers"))


@query("t7_query_grams", f"""
WITH t AS (SELECT query_id, {terms_sql('query_text')} AS w FROM <queries>)
SELECT query_id, 2 AS n, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) AS gram FROM t UNION ALL
SELECT query_id, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM t""")
def _(v):
    t = v.queries.select("query_id", T.query_terms(F.col("query_text")).alias("w"))
    two, three = (t.select("query_id", F.lit(n).alias("n"), F.explode(T.grams(F.col("w"), n)).alias("gram")) for n in (2, 3))
    return two.unionByName(three)


@query("t8_fold", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM <documents>")
def _(v):
    return v.documents.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("t9_typos", f"""
WITH v AS (SELECT DISTINCT unnest({_TOK.format('query_text')}) AS term FROM <queries>), w AS (SELECT t AS word FROM ({_VOCAB}) WHERE length(t) >= 5 AND t NOT IN (SELECT term FROM v)),
p AS (SELECT word, term, levenshtein(word, term) AS d FROM w JOIN v ON abs(length(word) - length(term)) <= 2 WHERE levenshtein(word, term) <= CASE WHEN length(word) < 8 THEN 1 ELSE 2 END)
SELECT word, min_by(term, (d, term)) AS term, min(d) AS distance FROM p GROUP BY 1""")
def _(v):
    known = v.queries.select(F.explode(T.tokens(F.col("query_text"))).alias("term"))
    return T.correct_typos(vocabulary(v).withColumnRenamed("t", "word"), known)


@query("t10_alias_expansion", f"""
WITH t AS (SELECT query_id AS id, unnest({terms_sql('query_text')}) AS term, unnest(range(len({terms_sql('query_text')}))) AS pos FROM <queries>),
a AS (SELECT x.term, y.term AS alias FROM <concept_terms> x JOIN <concept_terms> y ON x.concept_id = y.concept_id AND x.term <> y.term),
w AS (SELECT id, 0 AS kind, pos, term AS word FROM t UNION ALL SELECT id, 1, pos, a.alias FROM t JOIN a ON a.term = t.term), f AS (SELECT id, word, min((kind, pos)) AS place FROM w GROUP BY 1, 2)
SELECT id, string_agg(word, ' ' ORDER BY place, word) AS terms FROM f GROUP BY 1""")
def _(v):
    a, b = v.concept_terms, v.concept_terms.withColumnRenamed("term", "alias")
    aliases = a.join(b, "concept_id").filter("term <> alias").select("term", "alias")
    q = v.queries.select(F.col("query_id").alias("id"), T.query_terms(F.col("query_text")).alias("terms"))
    return T.expand_aliases(q, aliases).select("id", F.array_join("terms", " ").alias("terms"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_LINES_OF = "list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def units_sql(c: str) -> str:
    lines = _LINES_OF.format(c)
    return f"CASE WHEN len({lines}) = 1 AND length({lines}[1]) > 200 THEN {_SENTENCES.format(f'trim({c})')} ELSE {lines} END"


@query("t11_units", f"SELECT doc_id, unnest(range(len(u)))::INT AS pos, unnest(u) AS unit FROM (SELECT doc_id, {units_sql('text')} AS u FROM <documents>)")
def _(v):
    return v.documents.select("doc_id", F.posexplode(T.units(F.col("text"))).alias("pos", "unit"))


@query("t12_term_hits", f"SELECT doc_id, len(list_filter({_TOK.format('text')}, lambda t: t = 'the')) AS the_hits, contains(lower(text), 'of the')::INT AS phrase_hits FROM <documents>")
def _(v):
    return v.documents.select("doc_id", T.term_hits(F.col("text"), "the").cast("long").alias("the_hits"), T.term_hits(F.col("text"), "of the").alias("phrase_hits"))


@query("t13_duplicate_lines", "SELECT line, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS line FROM <documents>) WHERE line <> '' GROUP BY 1 HAVING count(*) > 1")
def _(v):
    lines = v.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", T.normal_line(F.col("x")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("t14_fingerprints", "SELECT doc_id, substr(sha256(text), 1, 32) AS fingerprint FROM <documents>")
def _(v):
    return v.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("fingerprint"))


@query("t15_turn_overlap", f"""
WITH x AS (SELECT id, {terms_sql('content_text')} AS a, {terms_sql("coalesce(lag(content_text) OVER (PARTITION BY session_id ORDER BY seq), '')")} AS b FROM <messages>)
SELECT id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 9) ELSE 0.0 END AS overlap FROM x""")
def _(v):
    from pyspark.sql import Window as W

    x = v.messages.select("id", T.query_terms(F.col("content_text")).alias("a"), T.query_terms(F.lag("content_text").over(W.partitionBy("session_id").orderBy("seq"))).alias("b"))
    return x.select("id", F.round(T.overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


@query("t16_one_line", "SELECT id, substr(array_to_string(list_filter(list_transform(string_split(content_text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), ' || '), 1, 2500) AS line FROM <messages>")
def _(v):
    return v.messages.select("id", T.one_line(F.col("content_text")).alias("line"))


@query("t17_topic_head", "SELECT id, trim(string_split(topic, '—')[1]) AS head FROM <chunks>")
def _(v):
    return v.chunks.select("id", T.topic_head(F.col("topic")).alias("head"))


@query("t18_filler", "SELECT doc_id, round((" + " + ".join(f"contains(lower(text), '{p}')::INT" for p in FILLER) + ") / greatest(len(regexp_extract_all(lower(text), '[^ \\t\\n\\x0b\\f\\r]+')) / 20.0, 1.0), 9) AS filler FROM <documents>")
def _(v):
    return v.documents.select("doc_id", F.round(T.filler_score(F.col("text"), FILLER), 9).alias("filler"))


ROLES = [("definition", "^The "), ("example", "for "), ("relevance", "with "), ("key_idea", " is "), ("mechanism", "by ")]


@query("t19_sentence_roles", "WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM <documents>) SELECT CASE " + " ".join(f"WHEN regexp_matches(unit, '{p}') THEN '{n}'" for n, p in ROLES) + " ELSE 'other' END AS role, count(*) AS n FROM u GROUP BY 1")
def _(v):
    u = v.documents.select(F.explode(F.split("text", "\n")).alias("unit"))
    return u.groupBy(T.first_matching(F.col("unit"), ROLES, "other").alias("role")).agg(F.count("*").alias("n"))


@query("t20_rates", "SELECT source, count(*) AS n, round(100.0 * (count(*) FILTER (lang = 'en')) / count(*), 2) AS pct_en FROM <documents> GROUP BY 1")
def _(v):
    from answerlens.functions.columns import percent

    return v.documents.groupBy("source").agg(F.count("*").alias("n"), percent(F.count_if(F.col("lang") == "en"), F.count("*")).alias("pct_en"))
