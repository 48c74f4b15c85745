"""Retrieval by type, line sides, secondary texts and sub-questions on the cases that the rules name."""

from pyspark.sql import functions as F

from answerlens.functions import text as T
from answerlens.operators import decomposition as D
from answerlens.operators import retrieval as R
from answerlens.operators import routing as X
from answerlens.operators import secondary as Y
from answerlens.operators import sides as L

CHUNKS = "id long, lecture_number int, chunk_type string, topic string, clean_explanation string, source_excerpt string"
TYPED = "query_id long, query_text string, type string, lectures array<int>"


def _chunks(spark):
    rows = [(i, 1 + i % 4, ["overview", "definition", "example"][i % 3], t, t, t) for i, t in enumerate(
        ["alpha start", "alpha middle", "alpha end", "beta start", "beta middle", "gamma words", "alpha beta gamma", "retrieval glossary alpha", "delta delta", "beta gamma", "alpha again here", "beta again here"])]
    return spark.createDataFrame(rows, CHUNKS)


def _routed(spark, queries, entities, top_k=3):
    chunks = _chunks(spark)
    typed = spark.createDataFrame(queries, TYPED)
    sides = spark.createDataFrame(entities, "query_id long, pos int, entity string")
    edges = spark.createDataFrame([(a, b) for a in range(1, 5) for b in range(1, 5) if abs(a - b) == 1], "src int, dst int")
    terms = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma"), (4, "delta")], "lecture_number int, term string")
    x = X.strategies(typed, sides, chunks)
    subs = X.sub_queries(x, sides, X.synthesis_terms(x, edges, terms))
    scores = X.sub_scores(subs, chunks)
    rows = X.route(subs, scores, chunks, edges, glossary="retrieval glossary", top_k=top_k).orderBy("query_id", "section", "place").collect()
    out = {}
    for r in rows:
        out.setdefault((r.query_id, r.section), []).append(r.id)
    return {r.query_id: r.strategy for r in x.collect()}, out, {r.query_id: (r.subs, r.confidence) for r in X.route_confidence(subs, scores, chunks, top_k=top_k).collect()}, {(r.query_id, r.sub): r.query_text for r in subs.collect()}


def test_every_type_has_its_strategy(spark):
    q = [
        (1, "what is alpha", "definition", []), (2, "alpha versus beta", "compare", [2]), (3, "alpha beta gamma", "compare", []), (4, "compare alpha", "compare", []), (5, "alpha", "summary", [3]), (6, "beta", "summary", []),
        (7, "beta", "summary", [99]), (8, "alpha", "synthesis", [1, 2]), (9, "alpha", "lecture_specific", [1]), (10, "alpha", "quiz", [3]), (11, "alpha", "quiz", []), (12, "more", "vague_followup", []), (13, "beta", "general", []),
    ]
    e = [(2, 0, "alpha"), (2, 1, "beta"), (3, 0, "alpha"), (3, 1, "beta"), (3, 2, "gamma")]
    strategy, rows, conf, texts = _routed(spark, q, e)
    assert strategy == {1: "focused", 2: "sides_two", 3: "sides_many", 4: "spread", 5: "lecture", 6: "broad", 7: "broad", 8: "threads", 9: "plain", 10: "lecture", 11: "focused", 12: "supported", 13: "supported"}
    # an obvious note about the notes never stands among the main rows, but for a synthesis
    assert all(7 not in v for (i, _), v in rows.items() if i != 8)
    # a lecture's summary stays inside it, whatever matches elsewhere
    lecture = {i: 1 + i % 4 for i in range(12)}
    assert {lecture[i] for i in rows[5, "main"]} == {3} == {lecture[i] for i in rows[10, "main"]}
    # both sides of a comparison, turn by turn; many sides one after the other
    assert texts[2, 0] == "lecture 2 alpha" and texts[2, 1] == "lecture 2 beta" and conf[2][0] == 2 and conf[3][0] == 3
    text = {r.id: r.topic for r in _chunks(spark).collect()}
    assert any("alpha" in text[i] for i in rows[2, "main"]) and any("beta" in text[i] for i in rows[2, "main"]) and len(rows[2, "main"]) == 3
    assert {"alpha", "beta", "gamma"} <= {w for i in rows[3, "main"] for w in text[i].split()}
    # definitions put definitions first
    kinds = [["overview", "definition", "example"][i % 3] == "definition" for i in rows[1, "main"]]
    assert kinds == sorted(kinds, reverse=True) and len(kinds) <= 3
    # a synthesis asks once more with the terms of its lectures and those next to them, and has supporting rows from elsewhere
    assert texts[8, 1] == "alpha alpha beta gamma" and len(rows[8, "main"]) == 3
    near = {lecture[i] for i in rows[8, "main"]}
    assert all(lecture[i] not in near for i in rows.get((8, "supporting"), []))
    assert (12, "main") not in rows and conf[12] == (1, 0.0)


def test_spread_takes_every_lecture_before_a_second_row(spark):
    _, rows, _, _ = _routed(spark, [(1, "alpha beta", "compare", [])], [], top_k=4)
    lectures = [1 + i % 4 for i in rows[1, "main"]]
    assert len(rows[1, "main"]) == 4 and len(set(lectures)) == 4


def _labels(spark, lines, **terms):
    t = spark.createDataFrame([("k", terms.get("a", []), terms.get("b", []), terms.get("not_a", []), terms.get("not_b", []))], "key string, a array<string>, b array<string>, not_a array<string>, not_b array<string>")
    units = spark.createDataFrame([("k", s, 1, i, u) for i, (s, u) in enumerate(lines)], "key string, side string, rank int, pos int, unit string")
    return units, t


def test_line_labels(spark):
    lines = ["Bias is bias", "variance only", "bias and variance", "bias bias bias variance", "bias with noise", "noise", "", "Biases", "the winner-take-all rule", "BIAS bias variance"]
    units, t = _labels(spark, [("a", x) for x in lines], a=["bias", "winner-take-all"], b=["variance"], not_a=["noise"])
    got = [r.label for r in L.line_labels(units, t).orderBy("pos").collect()]
    # 1 of 3 is below the ratio, 1 of 2 too
    assert got == ["a", "b", "shared", "a", "forbidden_a", "skip", "skip", "skip", "a", "a"]


def test_line_sides_cut_and_order(spark):
    lines = [("a", f"alias line {i}") for i in range(10)] + [("a", "bias stands here"), ("a", "ALIAS line 0"), ("b", "bias and variance"), ("a", "variance with bias"), ("a", "variance and bias"), ("a", "bias noise")]
    names = ["n1", "n2", "n3", "n4", "n5", "bias", "alias"]
    units, t = _labels(spark, lines, a=names, b=["variance"], not_a=["noise"])
    got = {}
    for r in L.line_sides(units, t, most=11).orderBy("side", "kind", "place").collect():
        got.setdefault((r.side, r.kind), []).append(r.line)
    # alias is the seventh term, so the line that names bias comes first
    assert got["a", "core"] == ["bias stands here", *[f"alias line {i}" for i in range(10)]]
    assert got["both", "shared"] == ["variance with bias", "variance and bias", "bias and variance"] and got["a", "forbidden"] == ["noise"]
    assert ("b", "core") not in got
    assert L.line_sides(units, t).filter("kind = 'core'").count() == L.LINES


def test_weak_sides_fall_back(spark):
    pairs = spark.createDataFrame([(k,) for k in "vwxyz"], "key string")
    lines = [("v", "a", "one"), ("v", "b", "two"), ("w", "a", "Same  line"), ("w", "b", "same line"), ("x", "a", "only"), ("y", "a", "one"), ("y", "b", "two")]
    lines = spark.createDataFrame([(k, s, "core", 1, t) for k, s, t in lines] + [("x", "both", "shared", 1, "t")], "key string, side string, kind string, place int, line string")
    support = spark.createDataFrame([(k, s, 0.1 if k == "y" and s == "b" else 0.5) for k in "vwxy" for s in "ab"], "key string, side string, support double")
    assert {r.key: r.fallback for r in L.needs_fallback(pairs, lines, support).collect()} == {"v": False, "w": True, "x": True, "y": True, "z": True}


def _check(spark, text, lines, terms=(), relational=False, external=True):
    texts = spark.createDataFrame([(1, text, relational, external)], "id long, secondary string, relational boolean, external boolean")
    out = Y.check_secondary(texts, spark.createDataFrame([(1, x) for x in lines], "id long, line string"), spark.createDataFrame([(1, x) for x in terms], "id long, term string"))
    (r,) = out.collect()
    return r


def test_secondary_texts(spark):
    allowed = ["Softmax maps logits into probabilities."]
    fine = _check(spark, "Boosted Explanation:\n\nNormalization exponentials stabilize logits numerically.", [], external=False)
    assert fine.reason is None and fine.clean_text.startswith("Boosted Explanation:\n\nNormalization")
    assert _check(spark, " \n ", allowed).reason == "empty_boost" and _check(spark, None, allowed).reason == "empty_boost"
    assert _check(spark, "Boosted Explanation:\n\nSoftmax maps logits.\nRocket staging uses hydrolox fuels unrelated to lecture classification pipelines.", allowed).reason == "unmarked_external"
    many = "Boosted Explanation:\n\nSoftmax maps logits into probabilities.\n" + "".join(f"More generally softmax {x}.\n" for x in ("behaves smoothly", "preserves uncertainty", "drops excess wording"))
    got = _check(spark, many, allowed)
    assert got.reason is None and "preserves uncertainty" in got.clean_text and "drops excess wording" not in got.clean_text and got.kept == 4
    assert _check(spark, "Softmax maps logits.\nMore generally Melbins correlate spectra.\nMore generally Cryptoz diverge oddly.\n", allowed).reason == "too_many_new_terms"
    assert _check(spark, "Softmax maps. Noise here.", allowed, ["softmax", "noise"]).reason == "all_sentences_forbidden"
    assert _check(spark, "Softmax maps logits. Noise here.", allowed, ["noise"]).clean_text == "Boosted Explanation:\n\nSoftmax maps logits."
    assert _check(spark, "Softmax maps logits.", allowed, ["boosted"]).reason == "forbidden_after_strip"
    assert _check(spark, "Softmax maps logits. Logits again.", allowed, ["logits. logits"]).reason == "forbidden_after_strip"
    assert _check(spark, "Softmax maps logits.", allowed, ["oft", "log"]).reason == "forbidden_term:log" and _check(spark, "Softmax maps logits.", allowed, ["log"], relational=True).reason is None


def test_shallow_answers_and_fallback_lines(spark):
    texts = ["Course Answer:\n\nThis is a long enough first line about CNNs for unit test.\n- Second line continues the course material.", "Course Answer:\n\nok", "", None, "\n".join(f"line number {i} here" for i in range(9)), "y" * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = [r.x for r in df.select("id", Y.fallback_lines(F.col("t")).alias("x")).orderBy("id").collect()]
    assert got[0] == ["This is a long enough first line about CNNs for unit test.", "Second line continues the course material."]
    assert got[1:4] == [["ok"], [], []] and len(got[4]) == 5 and got[5] == ["y" * 400]
    shallow = spark.createDataFrame([("short", 3), ("x" * 601, 3), ("x" * 601, 1)], "t string, n int").select(Y.is_shallow(F.col("t"), F.col("n")).alias("s")).collect()
    assert [r.s for r in shallow] == [True, False, True]


def test_sub_questions_of_every_type(spark):
    typed = [(1, "vague_followup", []), (2, "compare", []), (3, "compare", []), (4, "compare", []), (5, "summary", [3, 7]), (6, "summary", []), (7, "synthesis", [7, 3]), (8, "synthesis", []), (9, "definition", []), (10, "general", []), (11, "quiz", []), (12, "lecture_specific", [3])]
    sides = [(2, 0, "Mfcc"), (2, 1, "pitch curve"), (3, 0, "mfcc"), (3, 1, "pitch"), (3, 2, "tone")]
    named = [(1, 1, "m"), (4, 1, "m"), (6, 1, "p"), (8, 1, "m"), (8, 2, "p"), (9, 1, "m"), (9, 2, "p"), (11, 1, "q")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = D.sub_questions(
        df(typed, "query_id long, type string, lectures array<int>"), df(sides, "query_id long, pos int, entity string"), df(named, "query_id long, place int, concept_id string"), df([("m", "MFCC"), ("p", "Pitch"), ("q", "Q")], "concept_id string, name string"),
        df([("m", "mfcc"), ("p", "pitch"), ("z", "pitch")], "concept_id string, term string"), df([("m", 3), ("p", 5), ("p", 2)], "concept_id string, lecture_number int"), df([("p", i, f"Pitch {i}?") for i in range(5)], "concept_id string, pos int, question string"),
        df([(3, "Sound")], "lecture_number int, title string"),
    )
    got = {}
    for r in out.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.text, r.purpose, r.concept_id, r.scope))
    text = {k: [x[0] for x in v] for k, v in got.items()}
    assert got[1] == [(D.SIMPLER, "define", "m", [])]
    assert got[2][:2] == [("What is Mfcc?", "compare_side", "m", [3]), ("What is pitch curve?", "compare_side", "p", [2, 5])] and text[2][2:] == ["How do Mfcc and pitch curve differ in purpose and use?", D.TWO_MATTER]
    assert text[3][3:] == ["How do mfcc, pitch, tone differ along role, computation, and typical use?", D.MANY_MATTER] and got[3][2][2] is None
    assert text[4] == ["What is MFCC?"] and text[6] == ["Pitch 0?", "Pitch 1?", "Pitch 2?"] and text[11] == ["What is Q?"]
    assert got[5][:2] == [("What is Sound mainly about?", "lecture_anchor", None, [3]), ("What is Lecture 7 mainly about?", "lecture_anchor", None, [7])] and text[5][2] == D.SECTIONS_TIE
    assert text[7] == ["Core ideas from lecture 3: Sound", "Core ideas from lecture 7: Lecture 7", D.LECTURES_CONNECT]
    assert text[8] == ["Core ideas from lecture 2: Lecture 2", "Core ideas from lecture 3: Sound", "Core ideas from lecture 5: Lecture 5", D.LECTURES_CONNECT]
    assert text[9] == ["What is MFCC?", "How do MFCC and Pitch relate?"] and text[10] == text[12] == [D.OPEN_QUESTION]


def test_sub_scores_equal_scores_of_each_query_alone(spark):
    subs = spark.createDataFrame([(1, "plain", 0, False, None, "alpha beta"), (1, "plain", 1, False, None, "beta"), (2, "lecture", 0, False, 3, "lecture 3 alpha")], "query_id long, strategy string, sub int, augment boolean, lecture int, query_text string")
    got = {(r.query_id.query_id, r.query_id.sub, r.id): r.score for r in X.sub_scores(subs, _chunks(spark)).collect()}
    for q, s, lecture, text in ((1, 0, None, "alpha beta"), (1, 1, None, "beta"), (2, 0, 3, "lecture 3 alpha")):
        alone = R.lexical_scores(spark.createDataFrame([(9, text)], "query_id long, query_text string"), _chunks(spark))
        assert {i: x for (a, b, i), x in got.items() if (a, b) == (q, s)} == {r.id: r.score for r in alone.collect() if lecture is None or 1 + r.id % 4 == lecture}


def test_units_of_one_long_line(spark):
    long = "First sentence is here. " * 12
    df = spark.createDataFrame([("a\n\n b ",), (long,), (None,)], "t string")
    assert [len(r.u) for r in df.select(T.units(F.col("t")).alias("u")).collect()] == [2, 12, 0]
