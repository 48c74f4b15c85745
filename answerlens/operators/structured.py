"""Structured queries: what a query's type asks for, the concepts it names, and what is known of those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import retrieval as R

# The answer intent of a query type, and the steps of an intent.
INTENTS = {
    "definition": "direct_definition", "compare": "compare", "summary": "lecture_summary", "synthesis": "cross_lecture_synthesis",
    "lecture_specific": "scoped_explanation", "quiz": "teaching_plus_check", "vague_followup": "simplified_reteach", "general": "multi_step_explanation",
}
STEPS = {
    "direct_definition": ["Give a direct definition", "Explain how it works in the course context", "Explain why it matters"],
    "compare": ["Define concept A", "Define concept B", "Compare along key axes", "State why the distinction matters"],
    "lecture_summary": ["Identify requested lecture/topic scope", "List main concepts", "Explain connections among them"],
    "cross_lecture_synthesis": ["Summarize each lecture or concept briefly", "Identify shared thread", "Explain progression or dependency"],
    "scoped_explanation": ["Respect requested lecture scope", "Answer with scoped concepts unless prerequisites are needed"],
    "teaching_plus_check": ["Answer directly", "Teach the reasoning", "Mention common confusion if helpful"],
    "simplified_reteach": ["Restate answer in plainer language", "Use one analogy", "Use one concrete example"],
    "multi_step_explanation": ["Define concept", "Explain mechanism", "Explain purpose or motivation", "Optional example"],
}
# The intent of comparisons with more than two sides, and the intents that don't fan out.
MANY_SIDES = "compare_multi"
NO_FAN_OUT = ["compare", "compare_multi", "lecture_summary", "teaching_plus_check"]
# Lines of a tier, and the characters by which they are told apart.
TIER_LINES, TIER_KEY = 8, 240
# Hints of a concept and of all, concepts of a fan-out and its hits per concept, related names.
HINTS_EACH, HINTS, FAN_OUT, FAN_HITS, RELATED = 4, 12, 3, 5, 5


def answer_plans(typed: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(query_id, intent, steps, style) of (query_id, query_type); an unknown or null type is general.

    entities (query_id, entity) are the sides of comparisons: more than two are an intent of their own, with general steps.
    """
    intents = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    steps = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind = F.coalesce(F.lower("query_type"), F.lit(""))
    x = typed.withColumn("intent", F.coalesce(F.try_element_at(intents, kind), F.lit(INTENTS["general"])))
    if entities is not None:
        x = x.join(entities.groupBy("query_id").agg(F.count("*").alias("sides")), "query_id", "left").withColumn("intent", F.when((kind == "compare") & (F.col("sides") > 2), MANY_SIDES).otherwise(F.col("intent")))
    style = F.when(kind == "vague_followup", "simplified").when(kind == "quiz", "quiz").otherwise("teaching")
    return x.select("query_id", "intent", F.coalesce(F.try_element_at(steps, F.col("intent")), F.array(*map(F.lit, STEPS[INTENTS["general"]]))).alias("steps"), style.alias("style"))


def named_concepts(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, concept_id, place): the concepts whose terms, of any number of words, stand in a query.

    They are numbered by their first place, at one place the longer term first, then by id.
    """
    found = T.phrase_places(queries, terms).groupBy("query_id", "concept_id").agg(F.min(F.struct("pos", (-F.col("n")).alias("n"))).alias("at"))
    return found.select("query_id", "concept_id", F.row_number().over(W.partitionBy("query_id").orderBy("at", "concept_id")).alias("place"))


def concept_scope(queries: DataFrame, terms: DataFrame, lectures: DataFrame, hints: DataFrame) -> DataFrame:
    """(query_id, lectures, hints): all lectures that a query or its concepts name, and its concepts' first hints.

    lectures is (concept_id, lecture_number), hints (concept_id, pos, hint). Four hints of a concept count, each hint
    once, concepts in order, twelve in all. Queries without lectures or concepts have empty arrays.
    """
    named = named_concepts(queries, terms)
    own = queries.select("query_id", F.explode(T.lecture_numbers(F.col("query_text"))).alias("n"))
    scope = own.unionByName(named.join(lectures, "concept_id").select("query_id", F.col("lecture_number").alias("n")))
    scope = scope.groupBy("query_id").agg(F.array_sort(F.collect_set("n")).alias("lectures"))
    given = named.join(hints.filter(F.col("pos") < HINTS_EACH), "concept_id").groupBy("query_id", "hint").agg(F.min(F.struct("place", "pos")).alias("at"))
    given = given.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("at", "hint"))).filter(F.col("r") <= HINTS)
    given = given.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "hint"))), lambda x: x["hint"]).alias("hints"))
    x = queries.select("query_id").join(scope, "query_id", "left").join(given, "query_id", "left")
    return x.select("query_id", F.coalesce("lectures", F.array().cast("array<int>")).alias("lectures"), F.coalesce("hints", F.array().cast("array<string>")).alias("hints"))


def concept_lookups(pairs: DataFrame, edges: DataFrame, axes: DataFrame) -> DataFrame:
    """(a, b, prerequisites, related, axes) of pairs (a, b).

    edges is (src, kind, pos, dst) with kinds prerequisite and related; prerequisites and the first five related are
    those of a, in order. axes is (low, high, axis): those of the pair in either order, sorted.
    """
    e = edges.join(pairs.select(F.col("a").alias("src")).distinct(), "src", "left_semi")
    e = e.withColumn("r", F.row_number().over(W.partitionBy("src", "kind").orderBy("pos", "dst"))).filter((F.col("kind") == "prerequisite") | (F.col("r") <= RELATED))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("r", "dst")))), lambda x: x["dst"])
    known = e.groupBy(F.col("src").alias("a")).agg(of("prerequisite").alias("prerequisites"), of("related").alias("related"))
    x = axes.groupBy(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).agg(F.array_sort(F.collect_set("axis")).alias("axes"))
    none = F.array().cast("array<string>")
    out = pairs.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).join(x, ["low", "high"], "left").join(known, "a", "left")
    return out.select("a", "b", *[F.coalesce(c, none).alias(c) for c in ("prerequisites", "related", "axes")])


def concept_questions(terms: DataFrame) -> DataFrame:
    """(query_id, query_text): each concept, asked for by its terms."""
    return terms.groupBy(F.col("concept_id").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("query_text"))


def fan_out(hits: DataFrame, queries: DataFrame, terms: DataFrame, chunks: DataFrame, *, top_k: int = 10, least: int = FAN_OUT, intents: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """hits (query_id, id, rank) with, for queries of ``least`` concepts or more, the hits of the first three added.

    intents is (query_id, intent); queries that compare, sum up a lecture or ask a quiz stay as they are.

    A concept is asked for by its terms, once for all queries; what is new is added behind, concept by concept, up to
    four times ``top_k`` in all. told (concept_id, id, rank) are the hits of concept_questions, where they are there already.
    """
    named = named_concepts(queries, terms)
    many = named.groupBy("query_id").agg(F.max("place").alias("n")).filter(F.col("n") >= least)
    if intents is not None:
        many = many.join(intents.filter(F.col("intent").isin(NO_FAN_OUT)), "query_id", "left_anti")
    named = named.filter(F.col("place") <= FAN_OUT).join(many, "query_id", "left_semi")
    if told is None:
        told = R.top_k(R.lexical_scores(concept_questions(terms), chunks), FAN_HITS).withColumnRenamed("query_id", "concept_id")
    sub = told.filter(F.col("rank") <= FAN_HITS).select("concept_id", "id", F.col("rank").alias("sub"))
    more = named.join(sub, "concept_id").select("query_id", "id", "place", "sub")
    every = hits.select("query_id", "id", F.lit(0).alias("place"), F.col("rank").alias("sub")).unionByName(more)
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("place", "sub")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("at", "id")))
    return ranked.filter(F.col("rank") <= 4 * top_k).select("query_id", "id", "rank", (F.col("at.place") > 0).alias("added"))


def axis_lines(lines: DataFrame, axes: DataFrame, avoid: DataFrame) -> DataFrame:
    """(key, axis, line, overlap): for each axis of a key its best line.

    lines is (key, pos, line), axes (key, axis), avoid (key, line) the lines that are used already. overlap is the share
    of the axis' words of three letters or more that stand in the line. The best line shares most words, the longest
    first, and isn't used; without one, the longest that isn't used. Where all are used: the first that shares a word,
    then the first that differs from the key's first line, then that. Lines are compared in lower case with single
    spaces; a key without lines has no row.
    """
    norm = T.normal_line(F.col("line"))
    used = avoid.select("key", norm.alias("norm")).distinct().withColumn("used", F.lit(True))
    x = lines.withColumn("norm", norm).join(used, ["key", "norm"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    x = x.withColumn("first", F.first("norm").over(W.partitionBy("key").orderBy("pos"))).withColumn("toks", T.tokens(F.col("line")))
    words = F.filter(F.regexp_extract_all(F.lower("axis"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    x = x.join(axes.select("key", "axis", words.alias("words")), "key")
    hits = F.size(F.filter("words", lambda w: F.array_contains("toks", w)))
    x = x.withColumn("overlap", F.when(F.size("words") > 0, hits / F.size("words")).otherwise(0.0))
    shares = F.col("overlap") > 0
    kind = F.when(~F.col("used"), F.when(shares, 0).otherwise(1)).when(shares, 2).when(F.col("norm") != F.col("first"), 3).otherwise(4)
    fresh = kind < 2
    order = W.partitionBy("key", "axis").orderBy(kind, F.when(fresh, -F.col("overlap")), F.when(fresh, -F.length("line")), "pos")
    return x.withColumn("r", F.row_number().over(order)).filter("r = 1").select("key", "axis", "line", "overlap")


def expanded_queries(queries: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, expanded): the text, aliases of its corrected terms, corrections, and its folded form if that differs.

    aliases is (term, alias), known (term) the words that typos are corrected to. Aliases that are terms already are left
    out; aliases and corrections come in the order of the terms, each once.
    """
    q = queries.select("query_id", "query_text", T.query_terms(F.col("query_text")).alias("terms"))
    toks = q.select("query_id", "query_text", F.posexplode("terms").alias("pos", "t"))
    fixes = T.correct_typos(toks.select(F.col("t").alias("word")).distinct(), known).select(F.col("word").alias("t"), F.col("term").alias("fixed"))
    toks = toks.join(fixes, "t", "left").withColumn("term", F.coalesce("fixed", "t"))
    has = toks.select("query_id", F.col("term").alias("alias")).distinct()
    extra = toks.join(aliases.select("term", "alias").distinct(), "term").select("query_id", "alias", "pos").join(has, ["query_id", "alias"], "left_anti")
    fixed = toks.filter(F.col("fixed").isNotNull() & ~F.contains(F.lower("query_text"), F.col("fixed"))).select("query_id", F.col("fixed").alias("alias"), "pos")
    words = extra.withColumn("kind", F.lit(0)).unionByName(fixed.withColumn("kind", F.lit(1))).groupBy("query_id", "kind", "alias").agg(F.min("pos").alias("pos"))
    words = words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "alias"))), lambda x: x["alias"]).alias("words"))
    folded = F.trim(T.fold(F.col("query_text")))
    other = F.when((folded != "") & (F.lower(folded) != F.lower(F.trim("query_text"))), folded)
    return q.join(words, "query_id", "left").select("query_id", F.concat_ws(" ", "query_text", F.array_join("words", " "), other).alias("expanded"))


def tiered_lines(lines: DataFrame, own: list[str], peers: list[str], forbidden: list[str], fillers: list[str], *, most: int = TIER_LINES) -> DataFrame:
    """(key, line, tier, place, provisional) of (key, pos, line): the first ``most`` lines of the best tier that a key has.

    Tier 1 has neither forbidden nor peer terms, tier 2 no forbidden ones, tier 3 is all that is left, which is provisional.
    Lines stand by hits of their own terms less 0.35 of their filler score, the shorter first, then as they came; of lines
    that agree in their first 240 characters, whatever the case, the first counts. Of tier 3 the first sixteen are looked at.
    """
    held = lambda terms: sum((T.term_hits(F.col("line"), t) for t in terms), F.lit(0))
    tier = F.when((held(forbidden) == 0) & (held(peers) == 0), 1).when(held(forbidden) == 0, 2).otherwise(3)
    score = F.round(held([t for t in own if len(t) >= 2]) - 0.35 * T.filler_score(F.col("line"), fillers), 9)
    x = lines.withColumn("tier", tier).withColumn("score", score).withColumn("best", F.min("tier").over(W.partitionBy("key"))).filter("tier = best")
    x = x.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), F.length("line"), "pos"))).filter((F.col("tier") < 3) | (F.col("at") <= max(2 * most, 8)))
    once = x.groupBy("key", "tier", F.substring(F.lower(F.trim("line")), 1, TIER_KEY).alias("told")).agg(F.min(F.struct("at", "line")).alias("x")).filter("told <> ''")
    out = once.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("x.at"))).filter(F.col("place") <= most)
    return out.select("key", F.trim("x.line").alias("line"), "tier", "place", (F.col("tier") == 3).alias("provisional"))
