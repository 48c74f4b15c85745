"""Contracts of answers by the default cues, on small tables."""

from pyspark.sql import functions as F

from answerlens.operators import answer_contracts as A
from answerlens.operators import quality_rules as V

NAMES = [("cnn", 0, "Convolutional Network"), ("cnn", 1, "cnns"), ("cnn", 2, "ConvNet"), ("rnn", 0, "Recurrent Network"), ("rnn", 1, "rnn"), ("pca", 0, "Principal Components"), ("pca", 1, "pca"), ("x", 0, "x")]


def names(spark):
    return spark.createDataFrame(NAMES, "concept_id string, pos int, label string")


def judge(spark, rules, answers, labels=(), **flags):
    a = spark.createDataFrame(answers, "id int, intent string, answer string, lectures array<int>")
    for flag in ("no_examples", "intuition_only"):
        a = a.withColumn(flag, F.lit(flags.get(flag)).cast("boolean"))
    slots = A.named_slots(a, spark.createDataFrame(list(labels), "id int, role string, slot int, label string"))
    return {r.id: list(r.failed) for r in V.run_rules(slots, rules).collect()}


def test_sides_are_named_by_words_singular_or_concept(spark):
    e = spark.createDataFrame([(1, 0, "CNNs in this class."), (1, 1, "rnn cells?"), (1, 2, "kernels"), (1, 3, "gloss"), (2, 0, None), (2, 1, " ")], "id int, pos int, entity string")
    got = {}
    for r in A.side_labels(e, names(spark)).collect():
        got.setdefault((r.id, r.slot), set()).add(r.label)
    assert got[1, 0] >= {"cnns in this class.", "cnns", "convolutional network", "convnet"}
    assert got[1, 1] >= {"rnn cells", "recurrent network", "rnn"}  # by its first word
    assert got[1, 2] >= {"kernels", "kernel"} and "glos" not in got[1, 3]
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)}


def test_comparisons_need_their_sides_and_a_contrast(spark):
    two = [(i, "side", s, x) for i in (1, 2, 3) for s, x in ((0, "cnn"), (0, "convnet"), (1, "rnn"))]
    many = [(i, "side", s, x) for i in (4, 5) for s, x in enumerate("aa bb cc dd ee".split())]
    answers = [
        (1, "compare", "A ConvNet sees patches, whereas an RNN reads in order.", None), (2, "compare", "A CNN sees patches.", None), (3, "compare", "cnn and rnn along the axis of Memory", None),
        (4, "compare_multi", "aa bb cc dd, unlike others", None), (5, "compare_multi", "aa bb cc, unlike others", None), (6, "compare", "However", None), (7, "compare", None, None),
    ]
    got = judge(spark, A.coverage_contract(), answers, [*two, *many, (3, "axis", 0, "memory")])
    assert got == {1: [], 2: ["must_cover_both_sides", "must_include_comparison_axis"], 3: [], 4: [], 5: ["must_cover_compare_multi"], 6: [], 7: ["must_include_comparison_axis"]}


def test_summaries_name_a_main_concept_of_a_known_lecture(spark):
    asked = spark.createDataFrame([(1, 3), (1, 9), (2, 3), (3, 8), (4, 5)], "id int, lecture_number int")
    mains = spark.createDataFrame([(3, 1, "pca"), (3, 7, "rnn"), (9, 1, "rnn"), (5, 1, "none")], "lecture_number int, place int, concept_id string")
    labels = [tuple(r) for r in A.anchor_labels(asked, mains, names(spark)).collect()]
    got = judge(spark, A.coverage_contract(), [(i, "lecture_summary", t, [3]) for i, t in ((1, "PCA rotates"), (2, "about an rnn"), (3, "unknown lecture"), (4, "known, without names"))], labels)
    assert got == {1: [], 2: ["must_cover_main_anchors"], 3: [], 4: ["must_cover_main_anchors"]}  # the seventh concept doesn't count


def test_several_lectures_and_reasons(spark):
    answers = [
        (1, "cross_lecture_synthesis", "Attention came later", [1, 2]), (2, "cross_lecture_synthesis", "Lecture 2 follows", [1, 2]), (3, "cross_lecture_synthesis", "it goes on", [1]), (4, "cross_lecture_synthesis", "x" * 401, [1]),
        (5, "scoped_explanation", "It works because of order", [1]), (6, "multi_step_explanation", "It works", None), (7, "multi_step_explanation", "Steps", None), (8, None, None, None),
    ]
    got = judge(spark, A.coverage_contract(), answers)
    assert got == {1: ["must_include_multiple_lectures"], 2: [], 3: ["must_name_connecting_concepts"], 4: [], 5: [], 6: ["must_answer_how_or_why"], 7: [], 8: []}


def test_peers_of_the_only_concept_are_forbidden(spark):
    linked = spark.createDataFrame([(1, "cnn", 1), (2, "cnn", 1), (2, "rnn", 2), (3, "cnn", 1)], "id int, concept_id string, place int")
    peers = spark.createDataFrame([("cnn", "rnn"), ("cnn", "cnn"), ("rnn", "pca")], "concept_id string, peer_id string")
    x = A.forbidden_labels(linked, peers, names(spark))
    assert sorted((r.id, r.label) for r in x.collect()) == [(1, "recurrent network"), (3, "recurrent network")]  # "rnn" is short
    labels = [tuple(r) for r in x.collect()]
    answers = [(1, "direct_definition", "unlike a Recurrent Network", None), (2, "direct_definition", "a recurrent network", None), (3, "compare", "a recurrent network", None)]
    assert judge(spark, A.restriction_contract(), answers, labels) == {1: ["must_not_leak_forbidden_terms"], 2: [], 3: []}


def test_limits_hold_only_where_asked(spark):
    answers = [(1, "direct_definition", "For example, the Gradient", None), (2, "lecture_summary", "This lecture thread builds definitions", None), (3, "direct_definition", "This lecture thread builds definitions", None), (4, "direct_definition", None, None)]
    both = judge(spark, A.restriction_contract(), answers, no_examples=True, intuition_only=True)
    assert both[1] == ["must_not_have_examples_when_blocked", "must_not_have_technical_when_intuition_only"]
    assert judge(spark, A.restriction_contract(), answers) == {1: [], 2: ["must_not_be_boilerplate_summary"], 3: [], 4: []}


def test_layouts_and_labels(spark):
    linked = spark.createDataFrame([(1, "cnn", 1), (1, "rnn", 2), (1, "pca", 3), (2, "cnn", 1)], "id int, concept_id string, place int")
    sides = spark.createDataFrame([(1, 0, "Recurrent network"), (1, 1, "kernel"), (3, 0, "")], "id int, pos int, entity string")
    labels = [tuple(r) for r in A.plain_labels(sides, linked, names(spark)).collect()]
    assert sorted(x[2:] for x in labels if x[0] == 1) == [(1, "convolutional network"), (2, "recurrent network"), (3, "kernel"), (4, "principal components")]
    labels += [(i, "label", s, x) for i in (4, 5) for s, x in ((1, "aa"), (2, "bb"), (3, "cc"))] + [(6, "label", s, x) for s, x in ((1, "aa"), (2, "bb"))] + [(6, "side", 0, "qq"), (6, "side", 1, "bb")]
    answers = [
        (1, "compare", "convolutional network and kernel", None), (2, "compare", "one label only", None), (4, "compare_multi", "aa and cc", None), (5, "compare_multi", "cc", None), (6, "compare", "aa bb", None),
        (7, "teaching_plus_check", "Quiz\n### Why it matters", None), (8, "lecture_summary", "### Why it matters", None), (9, "lecture_summary", "Course Answer: x", None), (10, "teaching_plus_check", None, None),
    ]
    c, q, s = "must_match_compare_contract", "must_match_quiz_contract", "must_match_summary_contract"
    assert judge(spark, A.layout_contract(), answers, labels) == {1: [c], 2: [], 4: [], 5: [c], 6: [c], 7: [q], 8: [], 9: [s], 10: []}


def test_axes_of_the_first_pair(spark):
    linked = spark.createDataFrame([(1, "rnn", 1), (1, "cnn", 2), (1, "pca", 3), (2, "cnn", 1)], "id int, concept_id string, place int")
    axes = spark.createDataFrame([("cnn", "rnn", "Memory"), ("pca", "rnn", "rank"), ("cnn", "cnn", "same")], "low string, high string, axis string")
    assert [(r.id, r.label) for r in A.axis_labels(linked, axes).collect()] == [(1, "memory")]


def test_empty_tables_and_repeated_rows(spark):
    none = judge(spark, A.coverage_contract(), [(1, "compare", "x", None)], [])
    assert none == {1: ["must_include_comparison_axis"]}
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x")], "id int, answer string")
    labels = spark.createDataFrame([(1, "side", 0, "x"), (None, "side", 0, "x")], "id int, role string, slot int, label string")
    assert [(r.id, len(r.asked), len(r.named)) for r in A.named_slots(a, labels).orderBy(F.col("id").asc_nulls_last()).collect()] == [(1, 1, 0), (1, 1, 0), (None, 0, 0)]
    assert A.named_slots(a.limit(0), labels).count() == 0
