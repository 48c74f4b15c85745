"""Structure of concept packs."""

from answerlens.operators import audit as A


def test_pack_errors(spark):
    packs = spark.createDataFrame(
        [
            (1, '{"lecture_id":"L1","concepts":[{"a":1},"x",null,3,[1],{}]}'), (2, '{"lecture_number":7}'), (3, "[1]"), (4, "no json"), (5, None), (6, '{"lecture_id":0,"lecture_number":4,"concepts":{"a":1}}'),
            (7, '{"concepts":[]}'), (8, '{"lecture_id":"","concepts":null}'), (9, ""), (7, '{"concepts":[1]}'), (None, '{"concepts":[{"ok":1}]}'),
        ], "pack_id int, payload string",
    )
    got = sorted(tuple(r) for r in A.pack_errors(packs).collect())
    assert got == [
        *[(1, "L1", f"concept_{i}", "concept_not_object") for i in (1, 2, 3, 4)], (2, "7", "(pack)", "pack_missing_concepts"), (3, "pack_3", "(pack)", "pack_not_object"), (4, "pack_4", "(pack)", "pack_not_object"),
        (5, "pack_5", "(pack)", "pack_not_object"), (6, "4", "(pack)", "pack_missing_concepts"), (7, "pack_7", "concept_0", "concept_not_object"), (8, "pack_8", "(pack)", "pack_missing_concepts"), (9, "pack_9", "(pack)", "pack_not_object"),
    ]
    assert A.pack_errors(packs.limit(0)).count() == 0
