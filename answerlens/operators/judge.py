"""Judge batches: which cases to judge, what the judge reads, and what its verdicts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.operators.evaluation import retrieved_text


def in_scope(cases: DataFrame, modes: list[str]) -> DataFrame:
    mode = F.coalesce(F.nullif("effective_mode", F.lit("")), F.nullif("detected_mode", F.lit("")), "expected_mode")
    return cases.withColumn("mode", mode).filter(F.col("mode").isin(modes))


def judge_input(cases: DataFrame, chunks: DataFrame, cut: int = 8000) -> DataFrame:
    """(id, query, answer, evidence): evidence texts in retrieval order, joined and cut."""
    texts = retrieved_text(cases, chunks).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "blob"))).alias("x"))
    evidence = F.substring(F.array_join(F.transform("x", lambda r: r["blob"]), "\n---\n"), 1, cut)
    return cases.select("id", F.col("query_text").alias("query"), F.col("actual_response").alias("answer")).join(texts.select("id", evidence.alias("evidence")), "id", "left")


def verdicts(raw: DataFrame, text_col: str = "raw", pass_at: float = 0.68) -> DataFrame:
    """Judge text -> (id, score, passed, verdict): the first braced JSON; dimensions held to 0-1, their mean standing in for
    a missing score and ``pass_at`` for a missing decision. Text without JSON has no verdict.
    """
    js = F.regexp_extract(text_col, r"(?s)(\{.*\})", 1)
    x = F.from_json(js, "score double, pass boolean, dimensions map<string,double>, errors array<string>")
    dims = F.transform(F.map_values(x["dimensions"]), lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))
    mean = F.when(F.size(dims) > 0, F.aggregate(dims, F.lit(0.0), lambda a, d: a + d) / F.size(dims))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["score"]))  # least and greatest skip nulls
    score = F.when(x["score"].isNotNull(), held).otherwise(mean)
    return raw.select("id", score.alias("score"), F.coalesce(x["pass"], score >= pass_at).alias("passed"), F.when(score.isNull(), "critic_no_verdict").otherwise("ok").alias("verdict"))


def within_budget(rows: DataFrame, cap: int) -> DataFrame:
    """Cases in order while the tokens before them stay below the cap."""
    w = W.partitionBy("evaluation_run_id").orderBy("case_result_id").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("used", F.coalesce(F.sum("tokens_estimated").over(w), F.lit(0))).filter(F.col("used") < cap)


def primary_of(critic: DataFrame) -> DataFrame:
    has = lambda x: F.contains("error_categories", F.lit(x))
    return critic.select("id", F.when(F.col("critic_score").isNull(), "critic_pipeline_error").when(has("hallucination"), "hallucination").when(has("steps"), "missing_steps").when(~F.col("critic_pass"), "shallow_explanation").alias("primary_error"))


def latest_batches(critic: DataFrame, cases: DataFrame) -> DataFrame:
    b = critic.groupBy("evaluation_run_id", "critic_batch_id").agg(F.count("*").alias("judged"), F.max("created_at").alias("at"))
    b = b.groupBy("evaluation_run_id").agg(F.max(F.struct("at", "critic_batch_id", "judged")).alias("x"))
    t = cases.groupBy("evaluation_run_id").agg(F.count("*").alias("targeted"))
    return t.join(b, "evaluation_run_id").select("evaluation_run_id", F.col("x.critic_batch_id").alias("batch"), F.col("x.judged").alias("judged"), "targeted", (F.col("x.judged") == F.col("targeted")).alias("complete"))


def summary(critic: DataFrame) -> DataFrame:
    n = F.count("*")
    return critic.groupBy("evaluation_run_id").agg(
        n.alias("n"), F.round(F.count_if("critic_pass") / n, 6).alias("pass_rate"), F.round(F.sum(F.coalesce("critic_score", F.lit(0.0))) / n, 6).alias("mean_all"),
        F.round(F.avg("critic_score"), 6).alias("mean_parsed"), F.round(F.count("critic_score") / n, 6).alias("parse_rate"),
    )


def _judged(cases: DataFrame, critic: DataFrame) -> DataFrame:
    k = critic.select(F.col("case_result_id").alias("id"), "critic_score", "critic_pass", F.col("error_categories").alias("critic_errors"))
    return cases.join(k, "id")


def against_judge(cases: DataFrame, critic: DataFrame) -> DataFrame:
    return _judged(cases, critic).select("id", "category", "pass_bool", "critic_pass", (F.col("pass_bool") != F.col("critic_pass")).alias("disagree"))


def overlay(cases: DataFrame, critic: DataFrame) -> DataFrame:
    """Cases with the judge's score and outcome in place of the rules'."""
    return _judged(cases, critic).withColumn("score", F.col("critic_score")).withColumn("pass_bool", F.col("critic_pass")).drop("critic_score", "critic_pass", "critic_errors")


def _bucket() -> Column:
    return F.when(F.col("critic_score").isNull(), "no_verdict").when(F.col("pass_bool"), "judge_only").when(F.contains("critic_errors", F.lit("hallucination")), "grounding").otherwise("content")


def triage(cases: DataFrame, critic: DataFrame, risk: float = 0.45) -> DataFrame:
    g = _judged(cases, critic).filter("NOT critic_pass").groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return g.select("bucket", "n", F.round(share, 6).alias("share"), ((F.col("bucket") == "judge_only") & (share >= risk)).alias("rubric_risk"))


def worst_of_buckets(cases: DataFrame, critic: DataFrame, k: int = 10) -> DataFrame:
    x = _judged(cases, critic).filter("NOT critic_pass").select("id", F.coalesce("critic_score", F.lit(0.0)).alias("score"), _bucket().alias("bucket"))
    return x.withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("score", "id"))).filter(F.col("r") <= k).drop("r")
