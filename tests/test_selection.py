"""Quiz items take the first topics only; tables that grow with the queries aren't broadcast by a hint."""

from answerlens.operators import retrieval as R
from answerlens.operators import selection as S


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_quiz_items_have_three_of_four_topics(spark):
    rows = [(i, i % 9, None if i % 7 == 0 else f"t{i % 6}") for i in range(60)]
    got = S.quiz_items(spark.createDataFrame(rows, "id long, lecture_number int, topic string"), 5)
    order = [r.topic for r in spark.createDataFrame([(f"t{i}",) for i in range(6)], "topic string").selectExpr("topic", "sha2(concat('5:', topic), 256) AS h").orderBy("h").collect()]
    for r in got.collect():
        assert r.wrong == (" | ".join([t for t in order if t != r.topic][:3]) if r.topic else "")
    assert "Limit 4" in _plan(got)


def test_lectures_of_queries_are_not_broadcast_by_a_hint(spark):
    queries = spark.createDataFrame([(1, "alpha lecture 2")], "query_id long, query_text string")
    chunks = spark.createDataFrame([(1, 2, "alpha", "alpha")], "id long, lecture_number int, topic string, source_excerpt string")
    scores = R.lexical_scores(queries, chunks)
    assert "broadcast" not in _plan(scores) + _plan(R.lecture_ranking(scores, queries, chunks, 3))
