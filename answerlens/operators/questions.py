"""Classification of query tables: modes, concepts, spam and what to do without a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions import text as T

MODES = ["quiz", "compare", "summary"]
THRESHOLD, CLOSE, DAMPED = 0.32, 0.12, 0.85


def detect_modes(queries: DataFrame, patterns: list[tuple[str, str, str, float]]) -> DataFrame:
    """(id, mode, ambiguous, confidence) from (family, tag, pattern, weight): the first family, in order, at the threshold."""
    low = F.lower(F.coalesce("text", F.lit("")))
    for m in MODES:
        own = [F.when(low.rlike(p), w).otherwise(0.0) for f, _, p, w in patterns if f == m]
        queries = queries.withColumn(m, reduce(F.greatest, own, F.lit(0.0)) if own else F.lit(0.0))
    mode = F.coalesce(*[F.when(F.col(m) >= THRESHOLD, m) for m in MODES], F.lit("chat"))
    order = F.sort_array(F.array(*MODES), asc=False)
    close = (order[1] >= THRESHOLD) & (order[0] - order[1] <= CLOSE)
    return queries.select("id", mode.alias("mode"), close.alias("ambiguous"), F.round(F.when(close, DAMPED).otherwise(1.0) * order[0], 6).alias("confidence"))


def resolve_mode(queries: DataFrame, allowed: tuple = ("chat", "quiz", "compare", "summary")) -> DataFrame:
    own = F.lower(F.trim("user_mode"))
    fine = F.coalesce(own.isin(*allowed), F.lit(False))
    return queries.select("id", F.when(fine, own).otherwise(F.col("detected")).alias("mode"), fine.alias("overridden"))


def linked_concepts(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, concepts, n): concepts whose terms, of any number of words, a query names, by first place."""
    first = T.phrase_places(queries, terms).groupBy("query_id", "concept_id").agg(F.min("pos").alias("pos"))
    out = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "concept_id"))).alias("x"))
    return out.select("query_id", F.array_join(F.transform("x", lambda r: r["concept_id"]), ",").alias("concepts"), F.size("x").cast("long").alias("n"))


def no_match_kind(c: Column, greeting: str, short: int) -> Column:
    return F.when(F.lower(F.trim(c)).rlike(greeting), "greeting").when(F.length(F.trim(c)) < short, "acknowledgement").otherwise("off_topic")


def keyword_spam(queries: DataFrame, terms: DataFrame, *, most_tokens: int = 6, share: float = 0.6) -> DataFrame:
    """(query_id, n, hits, spam): short queries whose tokens are mostly concept terms."""
    t = queries.select("query_id", T.tokens(F.col("query_text")).alias("toks"))
    one = terms.select(F.lower("term").alias("term")).distinct()
    hits = t.select("query_id", F.explode("toks").alias("term")).join(one, "term").groupBy("query_id").agg(F.count("*").alias("hits"))
    x = t.select("query_id", F.size("toks").cast("long").alias("n")).join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return x.withColumn("spam", (F.col("n") <= most_tokens) & (F.col("hits") >= F.lit(share) * F.col("n")))
