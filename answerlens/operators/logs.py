"""Roll-ups over retrieval logs, answer variants, chunk hits and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions.columns import percent, rate

USAGE = "primary struct<usage:struct<total_tokens:bigint,totalTokenCount:bigint>>, boost struct<usage:struct<total_tokens:bigint,totalTokenCount:bigint>>"


def in_window(logs: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the ``days`` (held to 1-365) up to ``as_of``, both ends included."""
    until = F.lit(as_of).cast("timestamp_ntz")
    days = max(1, min(int(days), 365))
    return logs.filter(F.col(column).cast("timestamp_ntz").between(until - F.expr(f"INTERVAL '{days}' DAY"), until))


def volume(logs: DataFrame, enough: int = 5) -> DataFrame:
    return logs.agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions")).withColumn("insufficient_data", F.col("events") < enough)


def retrieval_kpis(logs: DataFrame) -> DataFrame:
    n = F.count("*")
    return logs.agg(
        n.alias("events"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        percent(F.count_if((F.col("num_chunks_hit") == 0) | F.col("is_off_topic")), n).alias("pct_no_result"), percent(F.count_if("is_low_confidence"), n).alias("pct_low_confidence"),
    )


def breakdown(rows: DataFrame, *columns: str) -> DataFrame:
    """(dimension, key, n): counts by each column in one pass, null being a key of its own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("key")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.key").agg(F.count("*").alias("n"))


def severity_counts(logs: DataFrame, column: str = "validation_checks_json") -> DataFrame:
    found = logs.filter(F.coalesce(F.trim(column), F.lit("")) != "").select(F.get_json_object(column, "$.severity").alias("severity"))
    return found.groupBy(F.coalesce("severity", F.lit("null")).alias("severity")).agg(F.count("*").alias("n"))


def boost_usage(variants: DataFrame) -> DataFrame:
    n = F.count("*")
    return variants.agg(n.alias("variants"), F.count_if("boost_used").alias("boosted"), percent(F.count_if("boost_used"), n).alias("pct_boosted"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    thumb = lambda x: F.count_if(F.col("course_thumb") == x)
    return feedback.agg(F.count("*").alias("rows"), thumb("up").alias("up"), thumb("down").alias("down"), F.count_if(F.col("course_thumb").isNull()).alias("none"), F.round(F.avg("helpfulness_rating"), 2).alias("avg_helpfulness"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    known = F.count("answer_resolved")
    return outcomes.agg(F.count("*").alias("rows"), known.alias("known"), percent(F.count_if("answer_resolved"), known).alias("pct_resolved"))


def low_confidence_page(logs: DataFrame, limit: int, offset: int = 0, cut: int = 800) -> DataFrame:
    """One page of low-confidence questions, newest first, with the number of all of them."""
    low = logs.filter("is_low_confidence")
    total = low.agg(F.count("*").alias("total"))
    page = low.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(max(1, min(limit, 500)))
    return page.select("id", "created_at", F.substring("user_question", 1, cut).alias("question"), "confidence").crossJoin(F.broadcast(total))


def top_chunks(hits: DataFrame, logs: DataFrame, chunks: DataFrame, k: int = 25, *, low_confidence_only: bool = True) -> DataFrame:
    """The k chunks that occur most in (low-confidence) retrievals, with topic and lecture; ties go to the smaller id."""
    logs = logs.filter("is_low_confidence") if low_confidence_only else logs
    counts = hits.join(logs.select(F.col("id").alias("retrieval_log_id")), "retrieval_log_id").groupBy("lecture_chunk_id").agg(F.count("*").alias("hits"))
    best = counts.orderBy(F.desc("hits"), "lecture_chunk_id").limit(k)
    named = chunks.select(F.col("id").alias("lecture_chunk_id"), "topic", "lecture_number")
    return named.join(F.broadcast(best), "lecture_chunk_id", "right").select("lecture_chunk_id", "hits", "topic", "lecture_number")


def total_tokens(usage: Column) -> Column:
    """Tokens of the primary and the boost answer from a usage JSON; anything but whole numbers counts as 0."""
    x = F.from_json(usage, USAGE)
    of = lambda b: F.coalesce(x[b]["usage"]["total_tokens"], x[b]["usage"]["totalTokenCount"], F.lit(0))
    return F.coalesce(of("primary") + of("boost"), F.lit(0))


def tokens_by_day(variants: DataFrame) -> DataFrame:
    t = variants.filter("created_at IS NOT NULL").select(F.to_date("created_at").alias("day"), total_tokens(F.col("token_usage_json")).alias("t"))
    return t.groupBy("day").agg(F.count("*").alias("variants"), F.nullif(F.sum("t"), F.lit(0)).alias("tokens"), F.count_if(F.col("t") > 0).alias("variants_with_tokens"))


def provider_rollup(variants: DataFrame) -> DataFrame:
    t = variants.withColumn("t", total_tokens(F.col("token_usage_json")))
    pairs = F.array(F.struct(F.lit("provider").alias("dimension"), F.coalesce("provider_name", F.lit("null")).alias("key")), F.struct(F.lit("model").alias("dimension"), F.coalesce("model_name", F.lit("null")).alias("key")))
    return t.select(F.explode(pairs).alias("x"), "t").groupBy("x.dimension", "x.key").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def repeated_answers(answers: DataFrame, text: str, at_least: int = 2) -> DataFrame:
    found = answers.filter(F.col(text).isNotNull()).groupBy(fingerprint(F.col(text)).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return found.filter(F.col("n") >= at_least)


def cost_summary(variants: DataFrame, *, cap: int | None = None, warn: float = 0.8, usd_per_million: float | None = None) -> DataFrame:
    limit = F.lit(cap).cast("long")
    at = F.lit(int(cap * warn) if cap else None).cast("long")
    out = variants.agg(F.count("*").alias("variants"), F.sum(total_tokens(F.col("token_usage_json"))).alias("tokens"))
    return out.select(
        "variants", "tokens", limit.alias("cap_tokens"), F.coalesce(F.col("tokens") > limit, F.lit(False)).alias("over_cap"),
        F.coalesce((F.col("tokens") >= at) & ~(F.col("tokens") > limit), F.lit(False)).alias("near_cap"), F.round(F.col("tokens") / 1e6 * F.lit(usd_per_million).cast("double"), 4).alias("usd"),
    )


def token_spike(variants: DataFrame, ratio: float = 2.5) -> DataFrame:
    """The first listed day whose tokens are ``ratio`` times those of the listed day before, if that has any."""
    days = tokens_by_day(variants).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    days = days.withColumn("before", F.lag("tokens").over(W.orderBy("day")))  # one row per day
    return days.filter((F.col("before") > 0) & (F.col("tokens") >= F.col("before") * ratio)).orderBy("day").limit(1).select("day", "tokens", "before")


def boost_by_thumb(variants: DataFrame, feedback: DataFrame) -> DataFrame:
    both = variants.join(feedback.select("message_id", "course_thumb"), "message_id", "left")
    return both.groupBy("boost_used", F.coalesce("course_thumb", F.lit("none")).alias("thumb")).agg(F.count("*").alias("n"))


def chunk_feedback(hits: DataFrame, logs: DataFrame, feedback: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Per chunk: retrievals, thumbs up and down of the answers it was retrieved for, share of thumbs down."""
    logs = logs.select(F.col("id").alias("retrieval_log_id"), "message_id").join(feedback.filter("course_thumb IS NOT NULL").select("message_id", "course_thumb"), "message_id")
    out = hits.join(logs, "retrieval_log_id").groupBy("lecture_chunk_id").agg(F.count_if(F.col("course_thumb") == "up").alias("up"), F.count_if(F.col("course_thumb") == "down").alias("down"))
    return out.withColumn("down_rate", rate(F.col("down"), F.col("up") + F.col("down")))


def margin_bins(logs: DataFrame, hits: DataFrame, width: float = 0.1) -> DataFrame:
    """Logs by the margin between their two best hits (share of the best score), with the rate of low confidence."""
    best = hits.groupBy("retrieval_log_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    m = logs.join(best, logs["id"] == best["retrieval_log_id"]).withColumn("margin", (F.col("top") - F.coalesce("second", F.lit(0.0))) / (F.col("top") + 1e-6))
    return m.groupBy(F.floor(F.round(F.col("margin") / width, 6)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.count_if("is_low_confidence").alias("low"))


def latency_by_backend(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.coalesce("retrieval_backend", F.lit("null")).alias("backend"), F.coalesce("query_type_v2", F.lit("null")).alias("query_type")).agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.percentile("latency_ms", 0.5).alias("p50_ms"), F.percentile("latency_ms", 0.95).alias("p95_ms")
    )
