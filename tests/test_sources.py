import json

from answerlens.operators import audit
from answerlens.plans.fixtures import Views
from answerlens.sources import corpus

SF = "/root/testdata/sf0.001"


def put(tmp_path, name, data):
    (tmp_path / name).write_text(json.dumps(data))
    return str(tmp_path / name)


def test_sections_keep_their_place(spark, tmp_path):
    docs = Views(spark, SF).chunks.orderBy("id").limit(30).collect()
    lectures = [{"lecture_number": n, "title": f"L{n}", "sections": [{"heading": d.topic, "content": [d.clean_explanation], "source_excerpt": d.source_excerpt} for d in docs if d.lecture_number == n]} for n in {d.lecture_number for d in docs}]
    rows = corpus.read_sections(spark, put(tmp_path, "c.json", {"title": "t", "lectures": lectures})).collect()
    assert len(rows) == len(docs)
    assert all(lec["sections"][r.section_index]["source_excerpt"] == r.source_excerpt for r in rows for lec in lectures if lec["lecture_number"] == r.lecture_number)


def test_cases_are_checked(spark, tmp_path):
    ok, bad = corpus.read_cases(spark, put(tmp_path, "s.json", {"name": "s", "cases": [{"id": "a", "query": "q"}, {"id": "", "query": "q"}, {"id": "b", "query": "q", "expected_mode": "poem"}, {"id": "c", "query": " Q ", "expected_mode": " Quiz "}]}))
    assert sorted(r.id for r in ok.collect()) == ["a", "c"] and bad.count() == 2


def test_concepts(spark, tmp_path):
    t = corpus.read_concepts(spark, put(tmp_path, "k.json", {"concepts": [{"id": "a", "name": "A", "aliases": ["x", "y"], "lecture_scope": [1], "prerequisites": ["b"], "related": ["c", "d"]}]}))
    assert {k: v.count() for k, v in t.items()} == {"concepts": 1, "aliases": 2, "lectures": 1, "edges": 3}


def test_payloads(spark):
    p = json.dumps({"confidence": 0.5, "chunk_hits": [{"chunk_id": 3, "score": 1.0}, {"chunk_id": 4, "score": 0.5}], "variant": {"provider": "x"}})
    m = spark.createDataFrame([(1, "assistant", p), (2, "assistant", "{bad"), (3, "user", p)], "id long, role string, payload_json string")
    t = corpus.flatten_payloads(m)
    assert [t[k].count() for k in ("logs", "hits", "variants")] == [2, 2, 1]


def test_embeddings_and_reports(spark, tmp_path):
    chunks = Views(spark, SF).chunks
    e = corpus.embed_chunks(chunks)
    assert e.count() == chunks.count() and {len(r.embedding) for r in e.collect()} == {64}
    corpus.write_reports({"a": e.groupBy("dim").count()}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 1


def test_upsert_and_rules(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    assert sorted(map(tuple, audit.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    bad = spark.createDataFrame([(1, None, "k k", " ", -1)], "id int, topic string, chunk_key string, source_excerpt string, lecture_number int")
    assert bad.select(audit.invalid_rules(bad).alias("r")).first().r == ["empty_heading", "bad_key", "no_body", "bad_number"]
