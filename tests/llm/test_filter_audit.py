"""The filter audit against brute force over all orders, with nulls, repeats, copies and empty tables."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from answerlens.llm.filter_audit import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique, good, toxic)} of rows (doc_id, text, source)."""
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        good, toxic = any(a == i and b == 1 for a, b, _ in labels), any(a == i and c == 1 for a, _, c in labels)
        fails.append((s or "", {x for x in f if f[x]}, good and i is not None, toxic and i is not None))
    out, shapley = {}, {}
    for part in {x[0] for x in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        for o in map("".join, permutations("ABCDE")):
            for k, x in enumerate(o):
                gone = set(o[:k])
                here = [r for r in own if x in r[0] and not r[0] & gone]
                out[part, o, k + 1] = (
                    sum(not r[0] & (gone | {x}) for r in own), len(here), sum(x in r[0] and bool(r[0] & gone) for r in own),
                    sum(r[0] == {x} for r in own), sum(r[1] for r in here), sum(r[2] for r in here),
                )
                shapley[part, x] = shapley.get((part, x), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = lambda n, k: " ".join(rng.choice(["low", "mid", "Cap", "UP", "x#y", "naïve", "w"][:k]) + str(rng.randrange(400) if rng.random() < 0.7 else "") for _ in range(n))
    texts = [None, "", *[words(n, k) for n in (0, 1, 199, 200, 201, 400) for k in (1, 3, 4, 6)]]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(90)]
    docs += [(7, texts[8], "s1")] * 3 + [(8, texts[8], "s1"), (6, texts[8], "s2"), (None, texts[8], "s1"), (70, "same " * 300, "s1"), (71, "same " * 300, "s2"), (72, "Same " * 300, "s2")]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(50)] + [(999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({n: F.lit("x") for n in ("part", "mask", "digest", "cells", "words", "good", "a.b")})
    out = filter_audit(d, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    want = brute(docs, labels)
    assert len(out) == len(got) == len(want) == 3 * 600 and got == want


def test_empty_tables_and_the_session_limit(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    none, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)
    assert filter_audit(none, labels).count() == 0
    one = filter_audit(spark.createDataFrame([(1, "few words", "s")], none.schema), labels).collect()
    assert len(one) == 600 and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1} and {r.shapley for r in one if r.filter_order[r.step - 1] == "B"} == {0}
    assert spark.conf.get(limit) == before
