"""Outcomes and pages of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions import text as T

# Words of follow-ups, in the order in which they decide.
FOLLOW_UPS = {
    "simpler": "simpler simple easier basic dumb layman",
    "clarify": "clarify explain again confused unclear rephrase repeat elaborate",
    "deeper": "deeper detail more expand further depth",
    "example": "example instance sample show demonstrate",
}
REPHRASED = 0.6


def follow_up_type(terms: Column, words: dict[str, str] | None = None) -> Column:
    out = None
    for kind, line in (words or FOLLOW_UPS).items():
        cond = F.arrays_overlap(terms, F.array(*[F.lit(w) for w in line.split()]))
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out


def outcomes(messages: DataFrame, words: dict[str, str] | None = None, rephrased_above: float = REPHRASED) -> DataFrame:
    """One row per assistant turn that a user turn follows: what the follow-up says about the answer.

    Among several assistant turns before a user turn the last counts. The user turn before is the last one not after it.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    user = F.when(F.col("role") == "user", F.col("content_text"))
    x = messages.select("id", "session_id", "seq", "role", "content_text", F.last(user, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("asked"), F.lead("role").over(w).alias("next_role"), F.lead("content_text").over(w).alias("next_text"))
    x = x.filter("role = 'assistant' AND next_role = 'user'").select("id", T.query_terms(F.col("asked")).alias("a"), T.query_terms(F.col("next_text")).alias("b"))
    kind = follow_up_type(F.col("b"), words)
    rephrased = F.round(T.overlap(F.col("a"), F.col("b")), 9) > rephrased_above
    return x.select("id", F.coalesce(kind, F.when(rephrased, "rephrase").otherwise("new_topic")).alias("follow_up_type"), rephrased.alias("was_rephrased"), (kind.isNull() & ~rephrased).alias("changed_topic"))


def session_page(messages: DataFrame, per_page: int = 50, page: int = 0) -> DataFrame:
    """Sessions by their last message, newest first, one page with the number of all."""
    s = messages.groupBy("session_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("turns"))
    total = s.agg(F.count("*").alias("total"))
    return s.orderBy(F.desc("updated_at"), F.desc("session_id")).offset(page * per_page).limit(per_page).join(F.broadcast(total))


def transcript(messages: DataFrame, variants: DataFrame) -> DataFrame:
    """Turns with the stored variant's text in place of the message's where there is one."""
    return messages.join(variants.select(F.col("message_id").alias("id"), "answer"), "id", "left").select("id", "session_id", "seq", "role", F.coalesce("answer", "content_text").alias("text"))


def purge(rows: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of sessions that aren't purged; rows without a session stay."""
    return rows.join(sessions.select(key).distinct(), key, "left_anti")


def latest_feedback(feedback: DataFrame, cut: int = 2000) -> DataFrame:
    """The last write per message; a rating outside 1 to 5 is dropped, an earlier valid one then counts."""
    rating = F.when(F.col("helpfulness_rating").between(1, 5), F.col("helpfulness_rating"))
    last = lambda c: F.max(F.when(c.isNotNull(), F.struct("created_at", "seq", c.alias("x"))))["x"]
    return feedback.groupBy("message_id").agg(last(F.col("course_thumb")).alias("thumb"), last(rating).alias("rating"), last(F.substring("note", 1, cut)).alias("note"))


def grade_answers(answers: DataFrame, chunks: DataFrame, at_least: int = 2) -> DataFrame:
    """(id, verdict): exact, contained or wrong for a choice; a short answer by the long words of the explanation it has."""
    x = answers.join(chunks.select(F.col("id").alias("chunk_id"), "topic", "clean_explanation"), "chunk_id")
    given = F.lower(F.trim("given"))
    long_words = F.array_distinct(F.filter(T.tokens(F.col("clean_explanation")), lambda t: F.length(t) >= 6))
    hits = F.size(F.filter(long_words, lambda t: F.contains(given, t)))
    choice = F.when(given == F.lower(F.trim("topic")), "exact").when((given != "") & F.contains(F.lower("topic"), given), "contained").otherwise("wrong")
    return x.select("id", F.when(F.col("question_type") == "choice", choice).otherwise(F.when(hits >= at_least, "good").when(hits > 0, "partial").otherwise("wrong")).alias("verdict"))
