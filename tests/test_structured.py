"""Structured queries on the cases that the rules name."""

from answerlens.functions import text as T
from answerlens.operators import retrieval as R
from answerlens.operators import structured
from pyspark.sql import functions as F


def test_fold_follows_the_compatibility_rule(spark):
    rows = [("naïve façade",), ("ő ş ě Ø",), ("ＡＢＣ１",), ("ﬁle ½",), ("é",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(T.fold(F.col("t")).alias("x")).collect()]
    assert got == ["naive facade", "o s e Ø", "ABC1", "file 1⁄2", "e", None]


def test_answer_plans_of_known_and_unknown_types(spark):
    df = spark.createDataFrame([(1, "compare"), (2, "Quiz"), (3, None), (4, "poem")], "query_id long, query_type string")
    got = {r.query_id: (r.intent, len(r.steps)) for r in structured.answer_plans(df).collect()}
    assert got == {1: ("compare", 4), 2: ("teaching_plus_check", 3), 3: ("multi_step_explanation", 4), 4: ("multi_step_explanation", 4)}


def test_scope_hints_and_lookups(spark):
    q = spark.createDataFrame([(1, "compare mfcc with pitch in lecture 3"), (2, "hello")], "query_id long, query_text string")
    terms = spark.createDataFrame([("m", "mfcc"), ("p", "pitch"), ("p", "tone")], "concept_id string, term string")
    lectures = spark.createDataFrame([("m", 7), ("p", 3), ("p", 5)], "concept_id string, lecture_number int")
    hints = spark.createDataFrame([("m", i, f"h{i}") for i in range(6)] + [("p", 0, "h1"), ("p", 1, "p1")], "concept_id string, pos int, hint string")
    got = {r.query_id: (r.lectures, r.hints) for r in structured.concept_scope(q, terms, lectures, hints).collect()}
    assert got == {1: ([3, 5, 7], ["h0", "h1", "h2", "h3", "p1"]), 2: ([], [])}
    edges = spark.createDataFrame([("a", "related", i, f"r{i}") for i in range(7)] + [("a", "prerequisite", 0, "z")], "src string, kind string, pos int, dst string")
    axes = spark.createDataFrame([("b", "a", "role"), ("a", "b", "input")], "low string, high string, axis string")
    got = {(r.a, r.b): (r.prerequisites, r.related, r.axes) for r in structured.concept_lookups(spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"), edges, axes).collect()}
    assert got == {("a", "b"): (["z"], ["r0", "r1", "r2", "r3", "r4"], ["input", "role"]), ("b", "a"): ([], [], ["input", "role"])}


def test_axis_lines_prefer_shared_words_and_unused_lines(spark):
    lines = spark.createDataFrame([("k", 1, "The role of memory"), ("k", 2, "role and output here"), ("k", 3, "nothing of it at all, but long"), ("u", 1, "Only line")], "key string, pos int, line string")
    axes = spark.createDataFrame([("k", "role and output"), ("k", "cost"), ("u", "cost"), ("none", "cost")], "key string, axis string")
    avoid = spark.createDataFrame([("k", "ROLE  and output here"), ("u", "only line")], "key string, line string")
    got = {(r.key, r.axis): (r.line, round(r.overlap, 3)) for r in structured.axis_lines(lines, axes, avoid).collect()}
    assert got == {("k", "role and output"): ("The role of memory", 0.333), ("k", "cost"): ("nothing of it at all, but long", 0.0), ("u", "cost"): ("Only line", 0.0)}


def test_tiers_of_lines(spark):
    rows = [("a", 1, "alpha only"), ("a", 2, "alpha beta"), ("a", 3, "alpha alpha line"), ("b", 1, "beta here"), ("b", 2, "bad line"), ("c", 1, "bad alpha")]
    df = spark.createDataFrame(rows, "key string, pos int, line string")
    got = [(r.key, r.line, r.tier, r.place, r.provisional) for r in structured.tiered_lines(df, ["alpha"], ["beta"], ["bad"], ["of the"]).orderBy("key", "place").collect()]
    assert got == [("a", "alpha alpha line", 1, 1, False), ("a", "alpha only", 1, 2, False), ("b", "beta here", 2, 1, False), ("c", "bad alpha", 3, 1, True)]


def test_expanded_queries(spark):
    q = spark.createDataFrame([(1, "explain backprp in naïve nets"), (2, "plain words")], "query_id long, query_text string")
    aliases = spark.createDataFrame([("backprop", "backpropagation"), ("nets", "networks")], "term string, alias string")
    known = spark.createDataFrame([("backprop",)], "term string")
    got = {r.query_id: r.expanded for r in structured.expanded_queries(q, aliases, known).collect()}
    assert got == {1: "explain backprp in naïve nets backpropagation networks backprop explain backprp in naive nets", 2: "plain words"}


def test_fan_out_adds_behind_and_once(spark):
    chunks = spark.createDataFrame([(i, 1, t, t) for i, t in enumerate(["alpha text", "beta text", "gamma text", "delta"])], "id long, lecture_number int, topic string, source_excerpt string")
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta")], "query_id long, query_text string")
    terms = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "gamma")], "concept_id string, term string")
    hits = spark.createDataFrame([(1, 3, 1), (1, 0, 2), (2, 3, 1)], "query_id long, id long, rank int")
    got = [(r.query_id, r.id, r["rank"], r.added) for r in structured.fan_out(hits, q, terms, chunks).orderBy("query_id", "rank").collect()]
    assert got == [(1, 3, 1, False), (1, 0, 2, False), (1, 1, 3, True), (1, 2, 4, True), (2, 3, 1, False)]


def test_fan_out_reads_hits_of_concepts_that_are_there(spark):
    chunks = spark.createDataFrame([(i, 1, t, t) for i, t in enumerate(["alpha text", "beta text", "gamma text", "delta"])], "id long, lecture_number int, topic string, source_excerpt string")
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta")], "query_id long, query_text string")
    terms = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "gamma")], "concept_id string, term string")
    hits = spark.createDataFrame([(1, 3, 1), (1, 0, 2), (2, 3, 1)], "query_id long, id long, rank int")
    rows = lambda **x: [tuple(r) for r in structured.fan_out(hits, q, terms, chunks, **x).orderBy("query_id", "rank").collect()]
    told = R.top_k(R.lexical_scores(structured.concept_questions(terms), chunks), 10).withColumnRenamed("query_id", "concept_id").localCheckpoint()
    assert rows(told=told) == rows()
    plan = structured.fan_out(hits, q, terms, chunks, told=told)._jdf.queryExecution().sparkPlan().toString()
    assert "source_excerpt" not in plan  # chunks aren't scored again


def test_r21_scores_once(spark, monkeypatch):
    from answerlens.plans import catalog

    passes, pairs = [], R._pairs
    monkeypatch.setattr(R, "_pairs", lambda *a: passes.append(1) or pairs(*a))
    assert catalog.queries()["r21_fan_out"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(passes) == 1


def test_aliases_of_any_length_in_order(spark):
    q = spark.createDataFrame([(1, "The hidden Markov model of speech"), (2, "markov chain; hidden-markov-model!"), (3, None), (4, "hidden")], "query_id long, query_text string")
    terms = spark.createDataFrame([("h", "hidden markov model"), ("m", "Markov"), ("g", "hidden"), ("g", "the hidden markov model of speech and more"), ("m", "markov"), ("e", ""), ("e", None)], "concept_id string, term string")
    got = {}
    for r in structured.named_concepts(q, terms).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.concept_id)
    # at one place the longer term stands first
    assert got == {1: ["h", "g", "m"], 2: ["m", "h", "g"], 4: ["g"]}
    assert structured.named_concepts(q, terms.limit(0)).count() == 0


def test_comparisons_do_not_fan_out(spark):
    chunks = spark.createDataFrame([(i, 1, t, t) for i, t in enumerate(["alpha text", "beta text", "gamma text"])], "id long, lecture_number int, topic string, source_excerpt string")
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma")], "query_id long, query_text string")
    terms = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "gamma")], "concept_id string, term string")
    hits = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "query_id long, id long, rank int")
    intents = spark.createDataFrame([(1, "compare"), (2, "direct_definition")], "query_id long, intent string")
    got = structured.fan_out(hits, q, terms, chunks, intents=intents).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 1, 2: 3}


def test_styles_and_many_sides(spark):
    df = spark.createDataFrame([(1, "compare"), (2, "quiz"), (3, "vague_followup"), (4, "compare")], "query_id long, query_type string")
    sides = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (4, "a"), (4, "b")], "query_id long, entity string")
    got = {r.query_id: (r.intent, r.style, len(r.steps)) for r in structured.answer_plans(df, sides).collect()}
    assert got == {1: ("compare_multi", "teaching", 4), 2: ("teaching_plus_check", "quiz", 3), 3: ("simplified_reteach", "simplified", 3), 4: ("compare", "teaching", 4)}


def test_tiers_drop_repeats_and_stop(spark):
    rows = [("a", i, f"alpha line {i % 12:02}") for i in range(30)] + [("a", 40, "ALPHA LINE 00"), ("c", 1, "  ")] + [("d", i, f"bad line {i:02}") for i in range(20)]
    df = spark.createDataFrame(rows, "key string, pos int, line string")
    got = structured.tiered_lines(df, ["alpha"], ["beta"], ["bad"], ["of the"]).orderBy("key", "place").collect()
    assert [r.line for r in got if r.key == "a"] == [f"alpha line {i:02}" for i in range(8)] and [r.key for r in got].count("d") == 8 and {r.provisional for r in got if r.key == "d"} == {True}
    assert not [r for r in got if r.key == "c"]


def test_lecture_ranges_need_a_lecture_and_have_no_cap(spark):
    rows = ["lectures 13 through 15", "scores 3-5 at home", "weeks 3—5 and lec. 4 to 6", "Lecture 5 to 3", "lecture 3 to 1200", "week 99999999999999999999 to 99999999999999999999", None, "lec 2–2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.x for r in df.select("i", T.lecture_range(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [[13, 14, 15], [], [3, 4, 5, 6], [], list(range(3, 1201)), [], [], [2]]
    wide = spark.createDataFrame([("lecture 1 to 900000000000",)], "t string").select(T.lecture_spans(F.col("t")).alias("s")).first()
    assert [(x.low, x.high) for x in wide.s] == [(1, 900000000000)]
