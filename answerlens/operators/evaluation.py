"""Scoring of evaluation cases and roll-ups over evaluation histories.

Cases are rows with id, evaluation_run_id, test_id, category, expected/detected/effective mode, must_include and
must_not_include (comma lists), pass_bool, score (may be null), error_categories (semicolon list), chunk_ids (comma
list), latency_ms and actual_response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions.columns import label_or, rate, terms

# Suite category -> intent, and the five intents.
CATEGORY_INTENT = {
    "definitions": "definition", "direct_answer_accuracy": "definition", "compare": "compare", "summary": "step_by_step", "quiz": "step_by_step",
    "synthesis": "synthesis", "retrieval_purity": "retrieval_grounded", "mode_detection": "definition", "clarification": "definition", "adversarial": "definition",
}
INTENTS = ["compare", "definition", "retrieval_grounded", "step_by_step", "synthesis"]
PASS_SCORE, QUARTER = 0.75, 0.25
STEPS = r"(?mi)^\s*(?:\d+[\).]|step\s+\d+\b|[-*]\s+step\b)"
CONTRAST = r"(?i)\b(while|whereas|difference|vs\.?|compared|contrast|unlike|but)\b"


def errors(c: str = "error_categories") -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "")


def _passed() -> Column:
    return F.coalesce(F.col("pass_bool"), F.lit(False))


def intent_of(category: Column, explicit: Column | None = None, mapping: dict | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in (mapping or CATEGORY_INTENT).items() for x in kv])
    found = F.coalesce(m[F.lower(F.trim(F.coalesce(category, F.lit(""))))], F.lit("definition"))
    return found if explicit is None else F.coalesce(F.nullif(F.lower(F.trim(explicit)), F.lit("")), found)


def mean_score(cases: DataFrame, severity: Column) -> DataFrame:
    """The mean of the components that apply: mode, required terms, forbidden terms and severity (fail 0, weak 0.7)."""
    answer = F.lower(F.coalesce("actual_response", F.lit("")))
    need, ban = terms(F.col("must_include")), terms(F.col("must_not_include"))
    share = lambda xs, hit: F.size(F.filter(xs, hit)).cast("double") / F.size(xs)
    parts = F.array_compact(F.array(
        F.when(F.col("expected_mode").isNotNull(), (F.col("expected_mode") == F.col("effective_mode")).cast("double")),
        F.when(F.size(need) > 0, share(need, lambda t: F.contains(answer, t))), F.when(F.size(ban) > 0, share(ban, lambda t: ~F.contains(answer, t))),
        F.when(severity == "fail", 0.0).when(severity == "weak", 0.7).when(severity == "pass", 1.0),
    ))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return cases.select("id", F.round(F.when(F.size(parts) > 0, mean).otherwise(0.0), 6).alias("score"))


def _blob() -> Column:
    return F.lower(F.concat_ws(" ", "topic", "source_excerpt", "clean_explanation"))


def retrieved_text(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, pos, chunk text): the chunks of each case in their order; ids that aren't numbers are left out."""
    ids = cases.select("id", F.posexplode(F.split(F.coalesce("chunk_ids", F.lit("")), ",")).alias("pos", "c")).select("id", "pos", F.trim("c").try_cast("long").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    return ids.join(chunks.select(F.col("id").alias("chunk_id"), _blob().alias("blob")), "chunk_id", "left").select("id", "pos", "chunk_id", F.coalesce("blob", F.lit("")).alias("blob"))


def term_hits(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, top_1, top_k, banned, terms_found, terms_all, unseen): flags of a case's retrieved chunks against its terms.

    Cases and chunks are read once each; a case's terms go along with its chunk ids, and texts end with the comparison.
    """
    ids = cases.select("id", terms(F.col("must_include")).alias("need"), terms(F.col("must_not_include")).alias("ban"), F.posexplode(F.split(F.coalesce("chunk_ids", F.lit("")), ",")).alias("pos", "c"))
    ids = ids.select("id", "need", "ban", "pos", F.trim("c").try_cast("long").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    x = ids.join(chunks.select(F.col("id").alias("chunk_id"), _blob().alias("blob")), "chunk_id", "left").withColumn("blob", F.coalesce("blob", F.lit("")))
    hit = x.select("id", "need", "pos", F.transform("need", lambda t: F.contains("blob", t)).alias("has"), F.exists("ban", lambda t: F.contains("blob", t)).alias("banned"))
    # a contains() on the joined row: names are resolved as columns
    full = F.size("has") > 0
    g = hit.withColumn("whole", full & F.forall("has", lambda b: b)).groupBy("id").agg(
        F.max_by("whole", -F.col("pos")).alias("top_1"), F.bool_or("whole").alias("top_k"), F.bool_or("banned").alias("banned"), F.collect_list("has").alias("rows"), F.first("need").alias("need")
    )
    g = g.withColumn("seen", F.transform("need", lambda t, i: F.exists("rows", lambda r: F.get(r, i))))
    found = F.size(F.filter("seen", lambda b: b))
    return g.select("id", "top_1", "top_k", "banned", found.alias("terms_found"), F.size("need").alias("terms_all"), F.filter("need", lambda t, i: ~F.get("seen", i)).alias("unseen"))


def failure_tags(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, tags): canonical tags of failed cases, sorted; one that has none is a missed error."""
    answer = F.lower(F.coalesce("actual_response", F.lit("")))
    x = cases.filter(~_passed()).join(term_hits(cases, chunks).select("id", "banned"), "id", "left")
    tag = lambda cond, name: F.when(cond, F.lit(name))
    tags = F.array_sort(F.array_distinct(F.array_compact(F.array(
        tag(F.coalesce(F.col("detected_mode"), F.lit("")) != F.col("expected_mode"), "mode_misclassification"), tag(F.coalesce(F.col("effective_mode"), F.lit("")) != F.col("expected_mode"), "mode_routing_failure"),
        tag(F.exists(terms(F.col("must_include")), lambda t: ~F.contains(answer, t)), "missing_required_concept"), tag(F.exists(terms(F.col("must_not_include")), lambda t: F.contains(answer, t)), "forbidden_topic_leakage"),
        tag(F.col("banned"), "retrieval_leakage"),
    ))))
    return x.select("id", F.array_join(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("validation_missed_error"))), ";").alias("tags"))


def primary_errors(cases: DataFrame, chunks: DataFrame, intent: Column, hits: DataFrame | None = None) -> DataFrame:
    """(id, primary_error) of failed cases: the first rule that holds. hits are their term_hits, if already there."""
    answer = F.lower(F.coalesce("actual_response", F.lit("")))
    need = terms(F.col("must_include"))
    hits = term_hits(cases, chunks) if hits is None else hits
    x = cases.filter(~_passed()).join(hits.select("id", "banned", "unseen"), "id", "left")
    lacking = F.exists(F.when(F.col("banned").isNull(), need).otherwise(F.col("unseen")), lambda t: ~F.contains(answer, t))
    e = errors()
    has = lambda name: F.array_contains(e, name)
    kind = (
        F.when(lacking, "retrieval_miss").when(F.exists(terms(F.col("must_not_include")), lambda t: F.contains(answer, t)), "hallucination")
        .when(has("retrieval_leakage") | F.coalesce("banned", F.lit(False)), "retrieval_noise").when(F.arrays_overlap(e, F.array(*[F.lit(t) for t in ("quiz_not_rendered", "summary_wrong_scope", "compare_entity_collapse", "compare_asymmetry", "scaffold_leakage")])), "template_misuse")
        .when(F.exists(e, lambda t: t.startswith("structure_")) | has("expected_section_missing") | has("missing_section"), "structure_failure")
        .when((intent == "step_by_step") & ~F.col("actual_response").rlike(STEPS), "missing_steps").when(has("generic_filler") | (F.length(F.trim(F.coalesce("actual_response", F.lit("")))) < 120), "shallow_explanation")
        .when(has("missing_required_concept") | has("must_include_failed"), "retrieval_miss").when(has("forbidden_topic_leakage") | has("forbidden_leak"), "hallucination").otherwise("shallow_explanation")
    )
    return x.select("id", kind.alias("primary_error"))


def run_totals(cases: DataFrame) -> DataFrame:
    p = F.count_if(_passed())
    return cases.groupBy("evaluation_run_id").agg(F.count("*").alias("total"), p.alias("passed"), (F.count("*") - p).alias("failed"), F.round(F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*"), 6).alias("mean_score"))


def select_runs(runs: DataFrame, *, name_part: str = "", last: int | None = None) -> DataFrame:
    found = runs.filter(F.contains(F.lower("dataset_name"), F.lit(name_part.lower()))) if name_part else runs
    if last is None:
        return found
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(last)


def overall_by_run(runs: DataFrame) -> DataFrame:
    return runs.select("id", "dataset_name", "total_cases", "passed_cases", F.round(F.col("passed_cases") / F.greatest("total_cases", F.lit(1)), 6).alias("pass_rate"))


def by_category(cases: DataFrame) -> DataFrame:
    """A null score adds nothing but counts in the mean."""
    p = F.count_if(_passed())
    return cases.groupBy(label_or(F.col("category"), F.col("expected_mode")).alias("category")).agg(
        F.count("*").alias("total"), p.alias("passed"), (F.count("*") - p).alias("failed"), F.round(F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*"), 4).alias("avg_score")
    )


def error_histogram(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode(errors()).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def mode_accuracy(runs: DataFrame, cases: DataFrame, detection: str = "mode_detection") -> DataFrame:
    c = cases.filter("expected_mode IS NOT NULL").groupBy("evaluation_run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("effective_mode") == F.col("expected_mode")).alias("effective_matches"),
        F.count_if(F.col("category") == detection).alias("detection_cases"), F.count_if((F.col("category") == detection) & (F.col("detected_mode") == F.col("expected_mode"))).alias("detected_matches"),
    )
    out = runs.select("id").join(c, runs["id"] == c["evaluation_run_id"], "left").na.fill(0, ["n", "effective_matches", "detection_cases", "detected_matches"])
    acc = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return out.select("id", "n", "effective_matches", acc("effective_matches", "n").alias("effective_accuracy"), "detection_cases", "detected_matches", acc("detected_matches", "detection_cases").alias("detected_accuracy"))


def worst_cases(cases: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("evaluation_run_id").orderBy(F.asc_nulls_first("score"), "id")
    return cases.select("evaluation_run_id", "id", "score", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def latency_by_run(cases: DataFrame) -> DataFrame:
    return cases.filter("latency_ms IS NOT NULL").groupBy("evaluation_run_id").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.percentile("latency_ms", 0.5).alias("median_ms"), F.percentile("latency_ms", 0.95).alias("p95_ms"))


def capability(cases: DataFrame, intent: Column, intents: list[str] | None = None) -> DataFrame:
    """Accuracy by intent, every listed intent having a row, and over all of them (intent 'overall')."""
    g = cases.select(intent.alias("intent"), _passed().cast("long").alias("ok"))
    spark = cases.sparkSession
    dim = spark.createDataFrame([(i,) for i in intents or INTENTS], "intent string")
    g = g.unionByName(dim.select("intent", F.lit(None).cast("long").alias("ok")))
    out = g.rollup("intent").agg(F.count("ok").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"))
    return out.select(F.coalesce("intent", F.lit("overall")).alias("intent"), "total", "correct", rate(F.col("correct"), F.col("total")).alias("accuracy"))


def error_breakdown(failed: DataFrame) -> DataFrame:
    """(primary_error, n, share, first_test) over failed cases with their primary error."""
    g = failed.groupBy("primary_error").agg(F.count("*").alias("n"), F.min("test_id").alias("first_test"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), 2))


def structure_violations(cases: DataFrame, intent: Column) -> DataFrame:
    """(intent, violation): one row per rule that a case breaks."""
    text = F.coalesce("actual_response", F.lit(""))
    v = F.array_compact(F.array(
        F.when((intent == "step_by_step") & ~text.rlike(STEPS), F.lit("missing_steps_format")), F.when((intent == "definition") & ~F.contains(F.lower(text), F.lit("key idea")), F.lit("missing_key_idea")),
        F.when((intent == "compare") & ~text.rlike(CONTRAST), F.lit("incorrect_template")),
    ))
    return cases.select("id", intent.alias("intent"), v.alias("violations"))


def structure_summary(violations: DataFrame) -> DataFrame:
    ok = F.count_if(F.size("violations") == 0)
    return violations.groupBy("intent").agg(F.count("*").alias("total"), ok.alias("compliant")).withColumn("rate", rate(F.col("compliant"), F.col("total")))


def concept_label(coverage: Column | None = None) -> Column:
    first = F.get(terms(F.col("must_include")), F.lit(0))
    return label_or(coverage if coverage is not None else F.lit(None).cast("string"), F.coalesce(first, F.lit("")), F.lower(F.col("category")), F.lower(F.col("expected_mode")))


def coverage_phases(cases: DataFrame, *, min_cases: int = 3, by_volume: bool = False) -> DataFrame:
    """Concepts in the order to mend them: sampled ones first, by failures, accuracy and name (or by volume)."""
    g = cases.groupBy(concept_label().alias("concept")).agg(F.count("*").alias("n"), F.count_if(_passed()).alias("passed"))
    g = g.withColumn("failed", F.col("n") - F.col("passed")).withColumn("accuracy", rate(F.col("passed"), F.col("n"))).withColumn("under_tested", F.col("n") < min_cases)
    order = [F.col("under_tested"), F.desc("n"), F.col("concept")] if by_volume else [F.col("under_tested"), F.desc("failed"), F.col("accuracy"), F.col("concept")]
    return g.withColumn("phase", F.row_number().over(W.orderBy(*order)))  # one row per concept


def iteration_trend(cases: DataFrame, intent: Column) -> DataFrame:
    x = cases.select("evaluation_run_id", intent.alias("intent"), _passed().cast("double").alias("ok"))
    out = x.groupBy("evaluation_run_id").pivot("intent", INTENTS).agg(F.round(F.avg("ok"), 6))
    return out.na.fill(0.0, INTENTS)


def tag_counts(cases: DataFrame, primary: DataFrame) -> DataFrame:
    """Failed cases by the union of their tags and primary error, each case once per name."""
    x = cases.filter(~_passed()).join(primary, "id", "left")
    return x.select(F.explode(F.array_union(errors(), F.array_compact(F.array("primary_error")))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def representatives(cases: DataFrame) -> DataFrame:
    """The middle case by score of each mode and outcome."""
    p = W.partitionBy("effective_mode", "ok")
    x = cases.select("id", "effective_mode", _passed().alias("ok"), F.coalesce("score", F.lit(0.0)).alias("score"))
    x = x.withColumn("at", F.row_number().over(p.orderBy("score", "id"))).withColumn("n", F.count("*").over(p))
    return x.filter(F.col("at") == F.floor(F.col("n") / 2) + 1).select("effective_mode", "ok", "id", "score")


def forbidden_leakage(cases: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """(place, term, n): forbidden terms in answers, else in retrieved chunks only; the k most frequent of each place."""
    t = cases.select("id", F.lower(F.coalesce("actual_response", F.lit(""))).alias("answer"), F.explode(F.array_distinct(terms(F.col("must_not_include")))).alias("term"))
    t = t.select("id", "term", F.contains("answer", "term").alias("in_answer"))
    seen = retrieved_text(cases, chunks).join(t.filter("NOT in_answer"), "id").filter(F.contains("blob", "term")).select("id", "term").distinct().select(F.lit("retrieval").alias("place"), "term")
    both = t.filter("in_answer").select(F.lit("answer").alias("place"), "term").unionByName(seen).groupBy("place", "term").agg(F.count("*").alias("n"))
    return both.withColumn("r", F.row_number().over(W.partitionBy("place").orderBy(F.desc("n"), "term"))).filter(F.col("r") <= k).drop("r")


def mode_scores(cases: DataFrame) -> DataFrame:
    return cases.groupBy("effective_mode").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("min_score"))


def repeated_failures(cases: DataFrame, runs: DataFrame, at_least: int = 2) -> DataFrame:
    x = cases.filter(~_passed()).join(runs.select(F.col("id").alias("evaluation_run_id"), "dataset_name"), "evaluation_run_id")
    return x.groupBy("dataset_name", "test_id").agg(F.countDistinct("evaluation_run_id").alias("runs")).filter(F.col("runs") >= at_least)


def run_pairs(runs: DataFrame) -> DataFrame:
    """(id, prev): each run and the newest other run of its data set, which may be newer."""
    a, b = runs.select("id", "dataset_name"), runs.select(F.col("id").alias("other"), "dataset_name", "created_at")
    two = b.withColumn("r", F.row_number().over(W.partitionBy("dataset_name").orderBy(F.desc("created_at"), F.desc("other")))).filter("r <= 2")
    return a.join(two, "dataset_name").filter("id <> other").groupBy("id").agg(F.min_by("other", "r").alias("prev"))


def _per_run(cases: DataFrame) -> DataFrame:
    tags = errors()
    return cases.groupBy("evaluation_run_id").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.count("*").alias("n"), F.count_if(F.array_contains(tags, "retrieval_leakage")).alias("leaks"),
        F.count_if(F.col("effective_mode") != F.col("expected_mode")).alias("mode_fails"),
    )


def regression_metrics(pairs: DataFrame, cases: DataFrame, *, drop: float = 0.05, rise: float = 0.001, moved: float = 1e-6) -> DataFrame:
    """Headline metrics of each run against its previous one, with flags of a regression and of any movement."""
    m = _per_run(cases).select("evaluation_run_id", F.round(F.col("s") / F.col("n"), 9).alias("score"), F.round(F.col("leaks") / F.col("n"), 9).alias("leak"), F.round(F.col("mode_fails") / F.col("n"), 9).alias("mode"))
    now = m.select(F.col("evaluation_run_id").alias("id"), *[F.col(c).alias(f"{c}_now") for c in ("score", "leak", "mode")])
    was = m.select(F.col("evaluation_run_id").alias("prev"), *[F.col(c).alias(f"{c}_was") for c in ("score", "leak", "mode")])
    x = pairs.join(now, "id").join(was, "prev")
    diff = lambda c: F.abs(F.col(f"{c}_now") - F.col(f"{c}_was")) > moved
    return x.select(
        "id", "prev", "score_now", "score_was", "leak_now", "leak_was", "mode_now", "mode_was",
        ((F.col("score_was") > 0) & ((F.col("score_was") - F.col("score_now")) / F.col("score_was") > drop)).alias("overall_drop"),
        (F.col("leak_now") - F.col("leak_was") > rise).alias("leak_rise"), (F.col("mode_now") - F.col("mode_was") > rise).alias("mode_rise"), (diff("score") | diff("leak") | diff("mode")).alias("moved"),
    )


def category_drops(pairs: DataFrame, cases: DataFrame, drop: float = 0.10) -> DataFrame:
    m = cases.groupBy("evaluation_run_id", label_or(F.col("category"), F.col("expected_mode")).alias("category")).agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*"), 9).alias("mean"))
    now = m.select(F.col("evaluation_run_id").alias("id"), "category", F.col("mean").alias("now"))
    was = m.select(F.col("evaluation_run_id").alias("prev"), "category", F.col("mean").alias("was"))
    x = pairs.join(now, "id").join(was, ["prev", "category"])
    return x.filter((F.col("was") > 0) & ((F.col("was") - F.col("now")) / F.col("was") > drop)).select("id", "prev", "category", "now", "was")


def transitions(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, prev, test_id, transition, critical, scores) of tests whose outcome changed."""
    c = cases.select("evaluation_run_id", "test_id", _passed().alias("ok"), "score", "critical")
    now = c.select(F.col("evaluation_run_id").alias("id"), "test_id", F.col("ok").alias("ok_now"), F.col("score").alias("score_now"), "critical")
    was = c.select(F.col("evaluation_run_id").alias("prev"), "test_id", F.col("ok").alias("ok_was"), F.col("score").alias("score_was"))
    x = pairs.join(now, "id").join(was, ["prev", "test_id"]).filter("ok_now <> ok_was")
    return x.select("id", "prev", "test_id", F.when(F.col("ok_now"), "fail_to_pass").otherwise("pass_to_fail").alias("transition"), "critical", "score_was", "score_now")
