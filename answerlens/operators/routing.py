"""Retrieval by the type of a query: one plan in which every query has its strategy and all sub-queries are scored at once.

A strategy is a row of parameters: how many hits each sub-query gives, how the lists are merged, how many rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.operators import retrieval as R

# Hits of a summary, sides of a comparison, extra terms of a synthesis, and types that stand first or support.
SUMMARY_MOST, SIDES, EXTRAS = 48, 8, 4
PREFERRED, SUPPORT_TYPES = ["definition", "process"], ["definition", "process", "overview"]
#: Strategy: (hits per sub-query, rows that are merged, rows that stay), as functions of top_k; None: all.
LIMITS = {
    "focused": (lambda k: min(k, 5), None, None), "sides_many": (lambda k: max(k, 4), None, lambda k: max(3 * k, 18)), "sides_two": (lambda k: max(k, 3), None, lambda k: k),
    "spread": (lambda k: k + 2, None, lambda k: k), "lecture": (lambda k: min(SUMMARY_MOST, max(k, 20)), None, None), "broad": (lambda k: k + 3, None, lambda k: k),
    "threads": (lambda k: k + 4, lambda k: 2 * (k + 4), lambda k: k), "plain": (lambda k: k, None, None), "supported": (lambda k: min(k, 5), None, None),
}


def _limit(which: int, top_k: int) -> Column:
    return F.create_map(*[x for name, f in LIMITS.items() for x in (F.lit(name), F.lit(f[which](top_k) if f[which] else 1 << 30))])[F.col("strategy")]


def strategies(typed: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """typed (query_id, type, lectures) with ``strategy``; entities is (query_id, pos, entity).

    Comparisons go by their number of sides; summaries and quizzes of exactly one lecture that has chunks stay inside it.
    """
    sides = entities.groupBy("query_id").agg(F.count("*").alias("sides"))
    known = chunks.select(F.col("lecture_number").alias("lecture")).distinct().withColumn("known", F.lit(True))
    x = typed.join(sides, "query_id", "left").withColumn("lecture", F.when(F.size("lectures") == 1, F.get("lectures", F.lit(0)))).join(known, "lecture", "left")
    n, inside = F.coalesce("sides", F.lit(0)), F.col("known") & F.col("type").isin("summary", "quiz")
    strategy = (
        F.when((F.col("type") == "compare") & (n >= 3), "sides_many").when((F.col("type") == "compare") & (n == 2), "sides_two").when(F.col("type") == "compare", "spread")
        .when(inside, "lecture").when(F.col("type") == "summary", "broad").when(F.col("type").isin("definition", "quiz"), "focused").when(F.col("type") == "synthesis", "threads")
        .when(F.col("type") == "lecture_specific", "plain").otherwise("supported")
    )
    return x.select(*typed.columns, strategy.alias("strategy"))


def synthesis_terms(typed: DataFrame, edges: DataFrame, lecture_terms: DataFrame) -> DataFrame:
    """(query_id, extra): the first terms of a query's lectures and of those next to them, in lecture order, each once, four at most."""
    own = typed.select("query_id", F.explode("lectures").alias("src"))
    near = own.join(edges, "src").select("query_id", F.col("dst").alias("lecture_number")).unionByName(own.select("query_id", F.col("src").alias("lecture_number")))
    first = near.join(lecture_terms, "lecture_number").groupBy("query_id", "term").agg(F.min("lecture_number").alias("at"))
    first = first.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("at", "term"))).filter(F.col("r") <= EXTRAS)
    return first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("extra"))


def sub_queries(routed: DataFrame, entities: DataFrame, extras: DataFrame) -> DataFrame:
    """(query_id, strategy, sub, augment, lecture, query_text): what each strategy asks for.

    routed has query_id, query_text, lectures, strategy. Sides ask for their entity after the query's first lecture, a
    lecture's summary for its own words after the lecture, a synthesis once more with ``extras``. augment marks texts
    that take alias terms.
    """
    first = F.get("lectures", F.lit(0))
    named = F.when(first.isNotNull(), F.concat(F.lit("lecture "), first.cast("string"), F.lit(" "))).otherwise("")
    sided = F.col("strategy").isin("sides_many", "sides_two")
    inside = F.col("strategy") == "lecture"
    whole = routed.filter(~sided).select("query_id", "strategy", F.lit(0).alias("sub"), (~F.col("strategy").isin("spread", "lecture")).alias("augment"), F.when(inside, first).alias("lecture"), F.when(inside, F.concat(named, F.trim("query_text"))).otherwise(F.col("query_text")).alias("query_text"))
    more = routed.filter("strategy = 'threads'").join(extras, "query_id").select("query_id", "strategy", F.lit(1).alias("sub"), F.lit(True).alias("augment"), F.lit(None).cast("int").alias("lecture"), F.concat_ws(" ", "query_text", "extra").alias("query_text"))
    sides = routed.filter(sided).join(entities.filter(F.col("pos") < SIDES), "query_id").select("query_id", "strategy", F.col("pos").cast("int").alias("sub"), F.lit(True).alias("augment"), F.lit(None).cast("int").alias("lecture"), F.trim(F.concat(named, F.trim("entity"))).alias("query_text"))
    return whole.unionByName(more).unionByName(sides)


def sub_scores(subs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lexical scores of all sub-queries in one pass; query_id is the struct (query_id, sub). A set lecture filters."""
    tagged = subs.select(F.struct("query_id", "sub").alias("query_id"), "query_text", "lecture")
    s = R.lexical_scores(tagged.select("query_id", "query_text"), chunks)
    inside = tagged.filter("lecture IS NOT NULL").select("query_id", "lecture")
    return s.join(inside, "query_id", "left").join(chunks.select("id", "lecture_number"), "id").filter("lecture IS NULL OR lecture = lecture_number").drop("lecture", "lecture_number")


def route(subs: DataFrame, scores: DataFrame, chunks: DataFrame, edges: DataFrame, *, glossary: str, top_k: int = 5) -> DataFrame:
    """(query_id, strategy, section, place, id): main and supporting chunks of each query, by its strategy.

    scores are those of sub_scores. Two sides interleave, other lists follow each other, each chunk where it comes first;
    definitions put preferred types first; comparisons without sides and syntheses spread over lectures. Chunks that
    match ``glossary`` in their topic or first characters go after the cut (not from a synthesis). Ties go to the smaller id.
    """
    tag = subs.select(F.struct("query_id", "sub").alias("query_id"), "strategy").withColumn("k", _limit(0, top_k))
    most = max(f[0](top_k) for f in LIMITS.values())
    lists = R.top_k(scores, most).select("query_id", "id", "rank").join(tag, "query_id").filter("rank <= k").select("query_id.query_id", "query_id.sub", "strategy", "id", "rank")
    own = chunks.join(lists.select("id").distinct(), "id", "left_semi")
    lists = lists.join(own.select("id", "lecture_number", "chunk_type", _meta(glossary).alias("meta")), "id")

    q = W.partitionBy("query_id")
    length = lambda s: F.coalesce(F.max(F.when(F.col("sub") == s, F.col("rank"))).over(q), F.lit(0))
    lists = lists.withColumn("both", F.least(length(0), length(1)))
    paired = (F.col("strategy") == "sides_two") & (F.col("rank") <= F.col("both"))
    later = F.when(F.col("strategy") == "sides_two", F.lit(1)).when((F.col("strategy") == "focused") & ~F.col("chunk_type").isin(PREFERRED), 1).otherwise(0)
    at = F.when(paired, F.struct(F.lit(0).alias("x"), F.col("rank").alias("y"), F.col("sub").alias("z"))).otherwise(F.struct(later.alias("x"), F.col("sub").alias("y"), F.col("rank").alias("z")))
    first = lists.groupBy("query_id", "strategy", "id").agg(F.min(at).alias("at"), F.first("lecture_number").alias("lecture_number"), F.first("meta").alias("meta"))
    first = first.withColumn("p", F.row_number().over(q.orderBy("at", "id"))).filter(F.col("p") <= _limit(1, top_k))

    cut = _limit(2, top_k)
    again = F.row_number().over(W.partitionBy("query_id", "lecture_number").orderBy("p")) > 1
    first = first.withColumn("again", again).withColumn("n", F.count("*").over(q))
    first = first.withColumn("lectures", F.sum((~F.col("again")).cast("int")).over(q))
    spread = F.col("strategy").isin("spread", "threads") & (F.col("n") > cut) & ~((F.col("strategy") == "threads") & (F.col("lectures") >= F.least(cut, F.col("n"))))
    kept = first.withColumn("place", F.row_number().over(q.orderBy(F.when(spread, F.col("again")).otherwise(False), "p"))).filter(F.col("place") <= cut)
    kept = kept.filter((F.col("strategy") == "threads") | ~F.col("meta"))
    main = kept.select("query_id", "strategy", F.lit("main").alias("section"), F.row_number().over(q.orderBy("place")).alias("place"), "id")
    fans = main.filter(F.col("strategy").isin("threads", "supported"))
    more = R.supporting(fans, chunks, edges, SUPPORT_TYPES).join(fans.select("query_id", "strategy").distinct(), "query_id")
    return main.unionByName(more.select("query_id", "strategy", F.lit("supporting").alias("section"), "place", "id"))


def _meta(pattern: str, head: int = 200) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(F.substring("clean_explanation", 1, head)).rlike(pattern) | low(F.col("topic")).rlike(pattern)


def route_confidence(subs: DataFrame, scores: DataFrame, chunks: DataFrame, *, top_k: int = 5) -> DataFrame:
    """(query_id, strategy, subs, confidence): of sides the least confident one, else that of the first sub-query.

    Many sides are read in order until five times top_k different chunks are found; later ones don't count.
    """
    tagged = subs.select(F.struct("query_id", "sub").alias("query_id"), "query_text")
    each = R.confidence(tagged, scores, chunks).select("query_id.query_id", "query_id.sub", "confidence").join(subs.select("query_id", "sub", "strategy"), ["query_id", "sub"])
    per = LIMITS["sides_many"][0](top_k)
    sided = subs.filter("strategy = 'sides_many'").select(F.struct("query_id", "sub").alias("query_id"))
    new = R.top_k(scores.join(sided, "query_id", "left_semi"), per).select("query_id.query_id", "query_id.sub", "id").groupBy("query_id", "id").agg(F.min("sub").alias("sub"))
    new = new.groupBy("query_id", "sub").agg(F.count("*").alias("new"))
    before = F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(W.partitionBy("query_id").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.join(new, ["query_id", "sub"], "left").withColumn("before", before)
    counts = F.when(F.col("strategy") == "sides_many", F.col("before") < 5 * top_k).otherwise((F.col("strategy") == "sides_two") | (F.col("sub") == 0))
    return each.filter(counts).groupBy("query_id", "strategy").agg(F.count("*").alias("subs"), F.min("confidence").alias("confidence"))
