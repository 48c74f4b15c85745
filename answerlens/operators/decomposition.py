"""Sub-questions of a query: rows from templates by its type, the entities, lectures and concepts that it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The texts of sub-questions.
SIMPLER = "Re-explain the previous topic in simpler terms."
WHAT = "What is {}?"
MANY_DIFFER, MANY_MATTER = "How do {} differ along role, computation, and typical use?", "Why do these distinctions matter for speech / ML in this course?"
TWO_DIFFER, TWO_MATTER = "How do {} and {} differ in purpose and use?", "Why does the distinction matter for speech / ML in this course?"
LECTURE_ABOUT, SECTIONS_TIE = "What is {} mainly about?", "What concepts tie these sections together?"
LECTURE_CORE, LECTURES_CONNECT = "Core ideas from lecture {}: {}", "What progression or dependency connects these lectures?"
OPEN_QUESTION = "Answer the student's question using course definitions and mechanisms."
RELATE = "How do {} and {} relate?"
# Entities named in one question, lectures of a synthesis without its own, questions known of a concept.
JOINED, LECTURES, KNOWN = 6, 6, 3


def _filled(template: str, *parts: Column) -> Column:
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *parts)


def _rows(df: DataFrame, block: int, pos: Column, text: Column, purpose: str, concept: Column | None = None, scope: Column | None = None) -> DataFrame:
    concept, scope = F.lit(None).cast("string") if concept is None else concept, F.array().cast("array<int>") if scope is None else F.coalesce(scope, F.array().cast("array<int>"))
    return df.select("query_id", F.lit(block).alias("block"), pos.cast("int").alias("pos"), text.alias("text"), F.lit(purpose).alias("purpose"), concept.alias("concept_id"), scope.alias("scope"))


def sub_questions(typed: DataFrame, entities: DataFrame, named: DataFrame, concepts: DataFrame, aliases: DataFrame, scopes: DataFrame, known: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, place, text, purpose, concept_id, scope): what has to be answered for a query, in order.

    typed is (query_id, type, lectures), entities (query_id, pos, entity), named (query_id, place, concept_id) the concepts
    that a query names, concepts (concept_id, name), aliases (concept_id, term), scopes (concept_id, lecture_number),
    known (concept_id, pos, question), titles (lecture_number, title).

    A vague follow-up asks for simpler words. A comparison asks for each side (the concept whose term is the side's text or
    first word, the smaller id of several), their difference and why it matters; a summary for each of its lectures; a
    synthesis for each lecture, or for the first six of its concepts, and what connects them. Comparisons and summaries
    without sides or lectures, and all other types, ask the first three questions known of the first concept, or what it
    is, or a general question where no concept is named; and how the first two concepts relate.
    """
    lectures = scopes.groupBy("concept_id").agg(F.array_sort(F.collect_set("lecture_number")).alias("scope"))
    names = named.join(concepts, "concept_id").join(lectures, "concept_id", "left")
    sides = entities.groupBy("query_id").agg(F.count("*").alias("sides"))
    t = typed.join(sides, "query_id", "left").withColumn("sides", F.coalesce("sides", F.lit(0)))
    branch = (
        F.when(F.col("type") == "vague_followup", "vague").when((F.col("type") == "compare") & (F.col("sides") > 2), "many").when((F.col("type") == "compare") & (F.col("sides") == 2), "two")
        .when((F.col("type") == "summary") & (F.size("lectures") > 0), "summary").when(F.col("type") == "synthesis", "synthesis").otherwise("concept")
    )
    t = t.select("query_id", "lectures", branch.alias("branch"))
    of = lambda *b: t.filter(F.col("branch").isin(*b))
    zero = F.lit(0)
    parts = [_rows(of("vague").join(named.filter("place = 1").select("query_id", "concept_id"), "query_id", "left"), 0, zero, F.lit(SIMPLER), "define", F.col("concept_id"))]

    e = of("many", "two").select("query_id", "branch").join(entities, "query_id").withColumn("entity", F.trim("entity"))
    kb = aliases.select(F.lower("term").alias("key"), F.col("concept_id").alias("cid")).groupBy("key").agg(F.min("cid").alias("cid"))
    full, head = F.lower("entity"), F.lower(F.split("entity", r"\s+")[0])
    e = e.withColumn("key", full).join(kb, "key", "left").withColumnRenamed("cid", "whole").withColumn("key", head).join(kb, "key", "left")
    e = e.withColumn("concept_id", F.coalesce("whole", "cid")).drop("whole", "cid", "key").join(lectures, "concept_id", "left")
    parts.append(_rows(e, 0, F.col("pos"), _filled(WHAT, F.col("entity")), "compare_side", F.col("concept_id"), F.col("scope")))
    listed = e.groupBy("query_id", "branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]).alias("e"))
    several, pair = listed.filter("branch = 'many'"), listed.filter("branch = 'two'")
    parts += [_rows(several, 1, zero, _filled(MANY_DIFFER, F.array_join(F.slice("e", 1, JOINED), ", ")), "mechanism"), _rows(several, 2, zero, F.lit(MANY_MATTER), "connection")]
    parts += [_rows(pair, 1, zero, _filled(TWO_DIFFER, F.get("e", F.lit(0)), F.get("e", F.lit(1))), "mechanism"), _rows(pair, 2, zero, F.lit(TWO_MATTER), "connection")]

    own = of("summary", "synthesis").select("query_id", "branch", F.explode("lectures").alias("n"))
    lent = of("synthesis").filter(F.size("lectures") == 0).select("query_id", "branch").join(names, "query_id").select("query_id", "branch", F.explode("scope").alias("n")).distinct()
    lent = lent.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("n"))).filter(F.col("r") <= LECTURES).drop("r")
    asked = own.unionByName(lent).join(titles.withColumnRenamed("lecture_number", "n"), "n", "left").withColumn("title", F.coalesce("title", _filled("Lecture {}", F.col("n").cast("string"))))
    one = F.array("n")
    parts.append(_rows(asked.filter("branch = 'summary'"), 0, F.col("n"), _filled(LECTURE_ABOUT, F.col("title")), "lecture_anchor", scope=one))
    parts.append(_rows(asked.filter("branch = 'synthesis'"), 0, F.col("n"), _filled(LECTURE_CORE, F.col("n").cast("string"), F.col("title")), "lecture_anchor", scope=one))
    parts += [_rows(of("summary"), 1, zero, F.lit(SECTIONS_TIE), "connection"), _rows(of("synthesis"), 1, zero, F.lit(LECTURES_CONNECT), "connection")]

    c = of("concept").select("query_id").join(names.filter("place = 1"), "query_id", "left")
    q = known.withColumn("r", F.row_number().over(W.partitionBy("concept_id").orderBy("pos", "question"))).filter(F.col("r") <= KNOWN).select("concept_id", "r", "question")
    text = F.coalesce("question", F.when(F.col("name").isNotNull(), _filled(WHAT, F.col("name"))), F.lit(OPEN_QUESTION))
    parts.append(_rows(c.join(q, "concept_id", "left"), 0, F.coalesce("r", zero), text, "define", F.col("concept_id"), F.col("scope")))
    two = of("concept").select("query_id").join(names.filter("place <= 2"), "query_id").groupBy("query_id").agg(F.max(F.when(F.col("place") == 1, F.col("name"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("name"))).alias("b"))
    parts.append(_rows(two.filter("b IS NOT NULL"), 1, zero, _filled(RELATE, F.col("a"), F.col("b")), "connection"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("block", "pos")).alias("place"), "text", "purpose", "concept_id", "scope")
