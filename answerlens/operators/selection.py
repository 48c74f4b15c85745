"""Choosing evidence from candidate chunks: constraint deltas, lines per role, one-liners, quiz items and gates.

``candidates`` are hits (query_id, id, rank). Terms are words, compared with the tokens of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions import text as T

# Weights and caps of the constraint delta.
TOPIC_GAIN, BODY_GAIN, BODY_CAP = 1.5, 0.6, 3.0
TOPIC_LOSS, BODY_LOSS, LOSS_CAP = 1.2, 0.4, 1.6
ON_LECTURE, OFF_LECTURE, DROP_AT = 0.8, 0.6, -2.0
LOW_CONFIDENCE, RELAXED = 0.35, 0.55


def _words(terms: list[str]) -> Column:
    return F.array(*[F.lit(t.lower()) for t in terms]) if terms else F.array().cast("array<string>")


def present(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text."""
    return F.size(F.array_intersect(T.tokens(c), _words(terms)))


def constraint_rerank(candidates: DataFrame, chunks: DataFrame, targets: list[str], forbidden: list[str], lectures: DataFrame | None = None) -> DataFrame:
    """(query_id, id, delta, place): target terms lift, forbidden ones lower; hopeless chunks without a target go."""
    body = F.concat_ws(" ", "clean_explanation", "source_excerpt")
    c = chunks.join(candidates.select("id").distinct(), "id", "left_semi").select("id", "lecture_number", present(F.col("topic"), targets).alias("at"), present(body, targets).alias("ab"), present(F.col("topic"), forbidden).alias("ft"), present(body, forbidden).alias("fb"))
    x = candidates.select("query_id", "id", "rank").join(c, "id")
    delta = TOPIC_GAIN * F.col("at") + F.least(BODY_GAIN * F.col("ab"), F.lit(BODY_CAP)) - TOPIC_LOSS * F.col("ft") - F.least(BODY_LOSS * F.col("fb"), F.lit(LOSS_CAP))
    if lectures is not None:
        x = x.join(lectures.withColumnRenamed("lecture_number", "wanted"), "query_id", "left")
        delta = delta + F.when(F.col("wanted") == F.col("lecture_number"), ON_LECTURE).when(F.col("wanted").isNotNull() & F.col("lecture_number").isNotNull() & (F.col("at") + F.col("ab") == 0), -OFF_LECTURE).otherwise(0.0)
    x = x.withColumn("delta", F.round(delta, 9)).filter((F.col("delta") > DROP_AT) | (F.col("at") + F.col("ab") > 0))
    return x.select("query_id", "id", "delta", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("delta"), "rank")).alias("place"))


def lines_of(candidates: DataFrame, chunks: DataFrame, shortest: int = 20) -> DataFrame:
    """(query_id, id, rank, pos, line): trimmed lines of the candidates' excerpts."""
    lines = F.transform(F.split("source_excerpt", "\n"), lambda x: F.trim(x))
    c = chunks.join(candidates.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(lines).alias("pos", "line")).filter(F.length("line") >= shortest)
    return candidates.select("query_id", "id", "rank").join(c, "id")


def allowed_lines(lines: DataFrame, targets: list[str], forbidden: list[str], most: int = 5) -> DataFrame:
    """Lines with a target and no forbidden term, each text once per query, the first ones by rank and place."""
    pure = lines.filter((present(F.col("line"), targets) > 0) & (present(F.col("line"), forbidden) == 0))
    once = pure.groupBy("query_id", F.substring(F.lower("line"), 1, 200).alias("key")).agg(F.min(F.struct("rank", "pos", "id", "line")).alias("x"))
    w = W.partitionBy("query_id").orderBy("x.rank", "x.pos", "x.id")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "place", "x.id", "x.line")


def role_lines(lines: DataFrame, roles: list[tuple[str, str]], targets: list[str], per_role: int = 2) -> DataFrame:
    """(query_id, role, id, pos, place): the lines of each role with the most target terms, then the shorter."""
    x = lines.withColumn("role", T.first_matching(F.col("line"), roles, "other")).filter("role <> 'other'").withColumn("hits", present(F.col("line"), targets))
    w = W.partitionBy("query_id", "role").orderBy(F.desc("hits"), F.length("line"), "id", "pos")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_role).select("query_id", "role", "id", "pos", "place")


def defining_line(lines: DataFrame, cue: str, targets: list[str], forbidden: list[str]) -> DataFrame:
    """(query_id, id, pos, score): the best line by cue, target terms and forbidden terms."""
    score = F.when(F.col("line").rlike(cue), 2).otherwise(0) + present(F.col("line"), targets) - 3 * present(F.col("line"), forbidden)
    x = lines.withColumn("score", score)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")
    return x.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", "id", "pos", "score")


def one_liners(lines: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, line, named): the first line that names the entity, else the first line."""
    x = lines.withColumn("named", present(F.col("line"), names) > 0)
    first = x.groupBy("query_id").agg(F.min(F.struct((~F.col("named")).alias("no"), "rank", "pos", "id", "line")).alias("x"))
    return first.select("query_id", "x.line", (~F.col("x.no")).alias("named"))


def pick_by_topic(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, picked, fallback): chunks whose topic contains the one asked for; one that none contains falls back to all."""
    by_topic = chunks.groupBy(F.lower("topic").alias("topic")).agg(F.count("*").alias("n"))
    asked = wanted.select("query_id", F.lower(F.trim("needle")).alias("term"))
    pairs = T.containing(by_topic.select(F.col("topic").alias("id"), F.col("topic").alias("text")), asked.select("term"))
    hit = asked.join(pairs.withColumnRenamed("id", "topic"), "term").join(by_topic, "topic").groupBy("query_id").agg(F.sum("n").alias("n"))
    total = chunks.agg(F.count("*")).scalar()
    return wanted.join(hit, "query_id", "left").select("query_id", F.coalesce("n", total).alias("picked"), F.col("n").isNull().alias("fallback"))


def quiz_items(chunks: DataFrame, seed: int, per_lecture: int = 1) -> DataFrame:
    """One seeded chunk per lecture with three other topics as wrong answers; the same seed gives the same items."""
    drawn = lambda c: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")), 256)
    w = W.partitionBy("lecture_number").orderBy(drawn("id"), "id")
    item = chunks.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_lecture).select("id", "lecture_number", "topic")
    # an item leaves out at most its own topic, so three of the first four are left
    topics = chunks.select(F.col("topic").alias("other")).filter("other IS NOT NULL").distinct().select(drawn("other").alias("h"), "other")
    topics = topics.orderBy("h", "other").limit(4).agg(F.array_sort(F.collect_list(F.struct("h", "other"))).alias("all"))
    wrong = F.slice(F.filter(F.transform("all", lambda x: x["other"]), lambda t: t != F.col("topic")), 1, 3)
    return item.join(F.broadcast(topics)).select("id", "lecture_number", "topic", F.array_join(wrong, " | ").alias("wrong"))


def low_confidence(confidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, low): confidence below 0.35, or below 0.55 of that where the target occurs in the evidence."""
    x = confidence.join(evidence.select("query_id").distinct().withColumn("seen", F.lit(True)), "query_id", "left")
    return x.select("query_id", (F.col("confidence") < F.when(F.col("seen"), LOW_CONFIDENCE * RELAXED).otherwise(LOW_CONFIDENCE)).alias("low"))


def gates(queries: DataFrame) -> DataFrame:
    """(query_id, gate) from (hits, spam, low, complete): the first gate that applies."""
    gate = F.when(F.col("hits") == 0, "empty").when(F.col("spam"), "spam").when(F.col("low") & (F.col("targets") == 0), "low_confidence_no_target").when(~F.col("complete"), "incomplete").when(F.col("low"), "retry_wider").otherwise("answer")
    return queries.select("query_id", gate.alias("gate"))


def query_types(queries: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(query_id, type): eight classes by ordered rules over the text, its lectures and its tokens."""
    low, lec = F.lower("query_text"), F.size(T.lecture_numbers(F.col("query_text")))
    is_ = lambda name: low.rlike(patterns[name]) if name in patterns else F.lit(False)
    kind = (
        F.when(is_("quiz"), "quiz").when(is_("compare"), "compare").when(is_("summary"), "summary").when((F.size(T.lecture_spans(F.col("query_text"))) > 0) | is_("synthesis") | (lec >= 2), "synthesis")
        .when((F.size(T.tokens(F.col("query_text"))) <= 3) & is_("vague"), "vague_followup").when(lec == 1, "lecture_specific").when(is_("definition"), "definition").otherwise("general")
    )
    return queries.select("query_id", kind.alias("type"))


def grounded(answer: Column, targets: list[str], must_name: Column) -> Column:
    """Names a lecture or a target; else long enough, unless the intent asks for a name."""
    named = F.contains(F.lower(answer), F.lit("lecture")) | (present(answer, targets) > 0)
    return named | (~must_name & (F.length(answer) > 200))


def concept_pure(answer: Column, targets: list[str], forbidden: list[str]) -> Column:
    """At most one line has a forbidden term and no target, and a target stands somewhere if a forbidden term does."""
    bad = F.size(F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: (F.size(F.array_intersect(T.tokens(x), _words(forbidden))) > 0) & (F.size(F.array_intersect(T.tokens(x), _words(targets))) == 0)))
    return (bad < 2) & ((present(answer, forbidden) == 0) | (present(answer, targets) > 0))


def distinct_evidence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, distinct): whether the first three lines of two sides differ as sets; an empty side passes."""
    three = lambda x, name: x.filter("place <= 3").groupBy("query_id").agg(F.array_sort(F.collect_set(T.normal_line(F.col("line")))).alias(name))
    x = three(a, "x").join(three(b, "y"), "query_id", "full")
    return x.select("query_id", F.coalesce(F.col("x") != F.col("y"), F.lit(True)).alias("distinct"))
