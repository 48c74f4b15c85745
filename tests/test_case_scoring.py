"""Scores and layout rules of evaluation cases on the cases that the rules name."""

from answerlens.operators import case_scoring as P

SCHEMA = "id long, category string, expected_mode string, detected_mode string, effective_mode string, must_include string, must_not_include string, actual_response string, expected_sections string, forbidden_sections string, has_diag boolean, answer_mode string, missing_side boolean"


def _case(i, text, mode="chat", expected=None, category="definitions", detected=None, need="", ban="", sections="", barred="", diag=True, answer_mode=None, missing=False):
    return (i, category, expected, detected, mode, need, ban, text, sections, barred, diag, answer_mode, missing)


def _score(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS evaluation_run_id", "'t' AS test_id")
    return {r.id: r for r in P.score_cases(df).collect()}, {r.id: r.path for r in P.structure_checks(df).collect()}


def test_modes(spark):
    got, _ = _score(spark, [
        _case(1, "x", mode=None), _case(2, "x", mode=None, expected="chat"), _case(3, "x", mode="quiz", expected="Chat "), _case(4, "x", category="mode_detection", detected="quiz", expected="quiz", mode="chat"),
        _case(5, "x", category="mode_detection", detected=None, expected="quiz"), _case(6, None, mode=" ", expected=""),
    ])
    assert [got[i].mode_ok for i in range(1, 7)] == [True, True, False, True, False, True]
    assert "mode_mismatch" in got[3].errors and "mode_detected_mismatch" in got[5].errors


def test_layouts(spark):
    got, path = _score(spark, [
        _case(1, "Course Answer: a while b", mode="compare", expected="compare"), _case(2, "butter, no cue", mode="compare"), _case(3, "Course Answer: a vs. b", mode="compare", missing=True), _case(4, "Summary:\n### Key topics\nx", mode="summary"),
        _case(5, "Course answer: ### direct answer", mode="summary", barred="direct"), _case(6, "Quiz:\nQ1 what\nAnswer key: a", mode="quiz"), _case(7, "Quiz:\n1) what\n### Explanation\nCourse answer: x", mode="quiz"),
        _case(8, "Which one?", mode="quiz", diag=False), _case(9, "plain", category="clarification"), _case(10, "plain", answer_mode="compare", sections="plain,more"), _case(11, "Which one?", mode="quiz", diag=True),
        _case(12, "x" * 600 + "? Tell me which", mode="compare", diag=False), _case(13, "x" * 600 + "?", mode="compare", diag=False), _case(14, "fine", expected="summary"),
    ])
    assert [path[i] for i in range(1, 15)] == ["compare", "compare", "compare", "summary", "summary", "quiz", "quiz", "clarification", "clarification", "chat", "quiz", "clarification", "compare", "chat"]
    assert got[1].errors == got[4].errors == got[6].errors == got[8].errors == got[12].errors == []
    assert got[2].errors == ["structure_compare_no_contrast_cue", "structure_compare_no_course_answer_header"] and got[3].errors == ["structure_compare_missing_side_flag"]
    assert got[5].errors == ["forbidden_leak", "structure_summary_forbidden_substring", "structure_summary_has_direct_answer", "structure_summary_no_header", "structure_summary_no_key_section", "structure_summary_wrong_block"]
    assert got[7].errors == ["structure_quiz_forbidden_block", "structure_quiz_has_course_answer", "structure_quiz_no_answer_key"] and got[9].errors == ["structure_clarification_no_followup"]
    assert got[10].errors == ["expected_section_missing", "structure_chat_missing_expected_section", "structure_chat_wrong_answer_mode"]
    assert got[14].errors == ["mode_mismatch", "structure_routing_mismatch"] and (got[14].score, got[14].passed) == (0.5, False)


def test_three_quarters_pass_unless_something_forbidden_stands_there(spark):
    got, _ = _score(spark, [_case(1, "alpha beta", need="alpha,gamma"), _case(2, "alpha beta", need="Alpha", ban="BETA"), _case(3, "alpha beta", need="alpha", barred="beta"), _case(4, "alpha beta", need=" alpha , ", ban="")])
    assert [(got[i].score, got[i].passed) for i in range(1, 5)] == [(0.75, True), (0.75, False), (0.5, False), (1.0, True)]
