"""Small tables against the rows they should give, with the default patterns."""

from pyspark.sql import functions as F

from answerlens.operators import constraints as C


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")


def test_compare_entities(spark):
    q = asked(spark, "Compare bagging vs. boosting?", "compare a, b and c", "What is the difference between PCA versus LDA: which?", "what is attention", None, "")
    got = {}
    for r in C.compare_entities(q).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["entity"])
    assert got == {0: ["bagging", "boosting"], 1: ["a", "b", "c"], 2: ["PCA", "LDA"]}


def test_two_sides_in_other_words(spark):
    q = asked(spark, "How is a CNN different from an RNN?", "What is the difference between bias and variance in this course", "compare PCA and LDA", "Contrast x or y for the exam", "how is life", "Comparison of them")
    got = {}
    for r in C.compare_entities(q).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["entity"])
    assert got == {0: ["a CNN", "an RNN"], 1: ["bias", "variance"], 2: ["PCA", "LDA"], 3: ["x", "y"]}


def test_augmented_queries_add_terms_then_hints_once(spark):
    q = asked(spark, "the mfcc of speech", "pitch", None)
    linked = spark.createDataFrame([(0, 0, "m"), (0, 1, "p"), (1, 0, "p")], "query_id int, pos int, concept_id string")
    terms = spark.createDataFrame([("m", "MFCC"), ("m", "cepstral coefficients"), ("p", "pitch"), ("p", "f0 curve")], "concept_id string, term string")
    hints = spark.createDataFrame([("m", 0, "coefficients"), ("m", 1, "lecture 4 slides"), ("p", 0, "f0 curve slides")], "concept_id string, pos int, hint string")
    got = {r.query_id: r.text for r in C.augmented_queries(q, linked, terms, hints).collect()}
    # all words of "coefficients" and of "f0 curve slides" are there by then
    assert got == {0: "the mfcc of speech cepstral coefficients lecture 4 slides f0 curve pitch", 1: "pitch f0 curve f0 curve slides", 2: ""}
    assert C.augmented_queries(q, linked, terms, hints, most=2).filter("query_id = 0").first().text == "the mfcc of speech cepstral coefficients"


def test_compare_entities_drop_trailing_clauses(spark):
    q = asked(spark, "rnn vs transformers in this course")
    assert [r["entity"] for r in C.compare_entities(q).orderBy("pos").collect()] == ["rnn", "transformers"]


def test_response_constraints(spark):
    q = asked(spark, "Explain it briefly. Do not mention CNNs, RNNs or CNNs. Give 3 ways", "give 40 ways", None)
    out = C.response_constraints(q, {"brief": "(?i)brief"}, r"(?i)give\s+(\d+)", [r"(?i)do not mention ([^.]+)"]).orderBy("query_id").collect()
    assert [tuple(r)[1:] for r in out] == [(True, 3, "cnns; rnns"), (False, None, ""), (False, None, "")]


def test_targets_are_not_forbidden(spark):
    terms = spark.createDataFrame([("a", "x"), ("a", "Y"), ("b", "y"), ("b", "z")], "concept_id string, term string")
    peers = spark.createDataFrame([("a", "b")], "concept_id string, peer_id string")
    linked = spark.createDataFrame([(1, "a"), (1, "a")], "query_id int, concept_id string")
    assert {tuple(r) for r in C.term_roles(linked, terms, peers).collect()} == {(1, "x", "target", False), (1, "y", "target", False), (1, "z", "forbidden", False)}
    assert C.term_roles(linked.limit(0), terms, peers).count() == 0


def test_rules_gate_on_kind_and_nulls(spark):
    a = spark.createDataFrame([("compare", "x but y"), ("compare", "x"), ("chat", None)], "kind string, answer string")
    rules = C.coverage_rules(F.col("answer"), F.col("kind"), ["x", "y"], contrast="but", causal="because")
    out = a.select(*[ok.alias(n) for n, ok in rules.items()]).collect()
    assert [tuple(r) for r in out] == [(True, True, True, True), (False, True, False, True), (True, True, True, False)]


def test_shared_lines_need_both_sides(spark):
    a = spark.createDataFrame([(1, 1, "one"), (2, 1, "only a")], "query_id int, place int, line string")
    b = spark.createDataFrame([(1, 1, " One "), (1, 2, "two")], "query_id int, place int, line string")
    assert [tuple(r) for r in C.shared_lines(a, b).orderBy("place").collect()] == [(1, 1, "one"), (1, 2, "two")]


def test_augmentation_adds_what_a_query_lacks(spark):
    q = asked(spark, "What is PCA", "pca is principal component", "nothing", None)
    terms = spark.createDataFrame([("p", "pca"), ("p", "component principal"), ("p", "eigen vectors"), ("p", None)], "concept_id string, term string")
    linked = spark.createDataFrame([(0, 0, "p"), (1, 0, "p")], "query_id int, pos int, concept_id string")
    got = {r["query_id"]: r["text"] for r in C.augmented_queries(q, linked, terms).collect()}
    assert got == {0: "What is PCA component principal eigen vectors", 1: "pca is principal component eigen vectors", 2: "nothing", 3: ""}
    assert {r["query_id"]: r["text"] for r in C.augmented_queries(q, linked, terms, most=1).collect()}[0] == "What is PCA component principal"


def test_model_input_has_each_text_once(spark):
    chunks = spark.createDataFrame([(1, "One"), (2, " one "), (3, "Two"), (4, None)], "id int, clean_explanation string")
    hits = spark.createDataFrame([(9, "primary", 3, 2), (9, "primary", 1, 1), (9, "supporting", 2, 3), (9, "supporting", 4, 4)], "query_id int, section string, id int, rank int")
    assert [tuple(r) for r in C.model_input(hits, chunks).collect()] == [(9, "primary", 2, "One\nTwo")]
