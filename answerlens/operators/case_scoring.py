"""The score of an evaluation case: a quarter each for mode, required terms, no forbidden term and structure.

Cases are rows with id, evaluation_run_id, test_id, category, expected_mode, detected_mode, effective_mode, must_include and
must_not_include (comma lists) and actual_response; expected_sections and forbidden_sections (comma lists), has_diag (whether
the pipeline left diagnostics), answer_mode and missing_side from those may be there too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.columns import terms
from answerlens.operators.evaluation import PASS_SCORE, QUARTER

# Words that show a contrast, marks of each layout, modes that a chat answer must not have, the length of a question back.
CONTRAST_WORDS = ["while", "whereas", "difference", "vs", "compared", "contrast", "unlike", "but"]
KEY_SECTION, NUMBERED = r"(?i)###\s*key\s+(topics|points)", r"(?md)^\s*(Q[1-3]\b|[0-9]+[\).]\s)"
ASKS_BACK, FOLLOW_UP = ["tell me which", "tell me what"], ["?", "tell me which", "for example"]
NOT_CHAT = ["lecture_summary", "teaching_plus_check", "compare", "compare_multi"]
MODES, SHORT_QUESTION = ["compare", "quiz", "summary"], 500
_OPTIONAL = {"expected_sections": "string", "forbidden_sections": "string", "has_diag": "boolean", "answer_mode": "string", "missing_side": "boolean"}


def _mode(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _prepared(cases: DataFrame) -> DataFrame:
    for name, kind in _OPTIONAL.items():
        if name not in cases.columns:
            cases = cases.withColumn(name, F.lit(None).cast(kind))
    x = cases.withColumn("text", F.coalesce("actual_response", F.lit(""))).withColumn("low", F.lower("text")).withColumn("diag", F.coalesce("has_diag", F.lit(False)))
    # without a mode an answer is a chat
    x = x.withColumn("effective", F.coalesce(F.nullif(_mode("effective_mode"), F.lit("")), F.lit("chat"))).withColumn("expected", _mode("expected_mode"))
    has = lambda marks: reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(m)) for m in marks])
    asks = ~F.col("diag") & F.col("effective").isin(MODES) & F.contains("text", F.lit("?")) & (has(ASKS_BACK) | (F.length(F.trim("text")) < SHORT_QUESTION))
    x = x.withColumn("asks", F.coalesce(F.col("category") == "clarification", F.lit(False)) | asks)
    return x.withColumn("path", F.when(F.col("asks"), "clarification").when(F.col("effective").isin(MODES), F.col("effective")).otherwise("chat"))


def _structure(x: DataFrame) -> Column:
    """Names of the rules of its path that an answer breaks."""
    low, text = F.col("low"), F.col("text")
    has = lambda m: F.contains(low, F.lit(m))
    barred = F.exists(terms(F.col("forbidden_sections")), lambda s: F.contains(low, s))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    rules = {
        "compare": {
            "no_course_answer_header": ~has("course answer:"), "no_contrast_cue": ~F.arrays_overlap(words, F.array(*map(F.lit, CONTRAST_WORDS))), "missing_side_flag": F.col("diag") & F.coalesce("missing_side", F.lit(False)),
        },
        "summary": {
            "no_header": ~has("summary:"), "no_key_section": ~text.rlike(KEY_SECTION), "forbidden_substring": barred, "has_direct_answer": has("### direct answer"), "wrong_block": has("course answer:") & ~has("summary:"),
        },
        "quiz": {
            "no_header": ~has("quiz:"), "no_answer_key": ~has("answer key:"), "no_numbered_questions": ~text.rlike(NUMBERED), "forbidden_block": has("### direct answer") | has("### explanation"), "has_course_answer": has("course answer:"),
        },
        "clarification": {"no_followup": ~reduce(lambda a, b: a | b, [has(m) for m in FOLLOW_UP]), "has_direct_answer": has("### direct answer")},
        "chat": {
            "missing_expected_section": F.exists(terms(F.col("expected_sections")), lambda s: ~F.contains(low, s)), "forbidden": barred, "wrong_answer_mode": F.col("diag") & F.coalesce(F.col("answer_mode").isin(NOT_CHAT), F.lit(False)),
        },
    }
    return F.array_compact(F.array(*[F.when((F.col("path") == p) & bad, F.lit(f"structure_{p}_{name}")) for p, names in rules.items() for name, bad in names.items()]))


def structure_checks(cases: DataFrame) -> DataFrame:
    """(id, path, structure_ok, errors): the layout an answer is held to, and the rules of it that it breaks, in order.

    A case of clarification, or, without diagnostics, a mode's answer that asks back, is a clarification; else the effective
    mode decides, chat where there is none. An expected mode needs a path that fits it (structure_routing_mismatch), and
    expected sections must stand in any answer (expected_section_missing).
    """
    x = _prepared(cases)
    wrong = (F.col("expected").isin(MODES) & ~F.col("path").isin("clarification") & (F.col("path") != F.col("expected"))) | ((F.col("expected") == "chat") & (F.col("effective") != "chat") & ~F.col("asks"))
    lacks = F.exists(terms(F.col("expected_sections")), lambda s: ~F.contains(F.col("low"), s))
    more = F.array_compact(F.array(F.when(wrong, F.lit("structure_routing_mismatch")), F.when(lacks, F.lit("expected_section_missing"))))
    found = F.array_sort(F.array_distinct(F.concat(_structure(x), more)))
    return x.withColumn("errors", found).select("id", "path", (F.size("errors") == 0).alias("structure_ok"), "errors")


def score_cases(cases: DataFrame) -> DataFrame:
    """(id, evaluation_run_id, test_id, mode_ok, content_ok, forbidden_ok, structure_ok, errors, score, passed).

    Without an expected mode the mode fits, and an answer without a mode is a chat; cases of mode_detection compare the
    detected mode. Forbidden sections count as forbidden terms. A case passes at 0.75 without a forbidden term.
    """
    x = _prepared(cases)
    detects = F.coalesce(F.col("category") == "mode_detection", F.lit(False))
    mode = F.when(detects, _mode("detected_mode") == F.col("expected")).otherwise((F.col("expected") == "") | (F.col("effective") == F.col("expected")))
    content = F.forall(terms(F.col("must_include")), lambda t: F.contains(F.col("low"), t))
    clean = ~F.exists(F.concat(terms(F.col("must_not_include")), terms(F.col("forbidden_sections"))), lambda t: F.contains(F.col("low"), t))
    x = x.select("id", "evaluation_run_id", "test_id", mode.alias("mode_ok"), content.alias("content_ok"), clean.alias("forbidden_ok"), detects.alias("detects"))
    x = x.join(structure_checks(cases), "id")
    failed = F.array_compact(F.array(
        F.when(~F.col("mode_ok"), F.when(F.col("detects"), F.lit("mode_detected_mismatch")).otherwise(F.lit("mode_mismatch"))), F.when(~F.col("content_ok"), F.lit("must_include_failed")), F.when(~F.col("forbidden_ok"), F.lit("forbidden_leak")),
    ))
    score = sum((F.col(c).cast("int") for c in ("mode_ok", "content_ok", "forbidden_ok", "structure_ok")), F.lit(0)) * QUARTER
    out = x.withColumn("errors", F.array_sort(F.array_distinct(F.concat("errors", failed)))).withColumn("score", score)
    return out.select("id", "evaluation_run_id", "test_id", "mode_ok", "content_ok", "forbidden_ok", "structure_ok", "errors", "score", ((F.col("score") >= PASS_SCORE) & F.col("forbidden_ok")).alias("passed"))
