"""One row of each group of near-duplicates, with null ids and repeated rows among them."""

import random

import corpus_pipeline as p


def test_near_dedup_keeps_one_row_of_a_group(spark, docs):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = f"{a} more"
    rows = [(5, a), (3, near), (None, a), (None, a), (7, b), (7, b), (None, c), (None, c), (8, d), (8, e), (9, f), (2, None), (2, ""), (None, None)]
    kept = p.near_dedup(spark, docs(rows).repartition(3), "")
    assert kept.columns == docs(rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, near), (7, b), (None, c), (8, d), (8, e), (9, f), (2, None), (2, ""), (None, None)], key=str)
