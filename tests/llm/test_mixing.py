"""The tilt against a numpy solution of the dual, hot groups and edges of the mix."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import mixing
from answerlens.llm.scratch import Scratch


def dual(sizes, target, most=mixing.MOST):
    """lambda by bisection: the sum of size * min(most, exp(lambda * size / mean)) is the target."""
    x, mean = np.array(sizes, float), np.mean([s for s in sizes if s > 0])
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            lo, hi = (mid, hi) if (x * np.minimum(most, np.exp(mid * x / mean))).sum() < target else (lo, mid)
    return np.minimum(most, np.exp(lo * x / mean))


def test_rates_equal_a_numpy_solution_of_the_dual(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice((0, 1, 3, 10, 10, 50, 400)), 1) for s in ("a", "b", "c", None) for _ in range({"a": 90, "b": 120, "c": 100, None: 60}[s])]
    classes = spark.createDataFrame(rows, "source string, size long, docs long").groupBy("source", "size").agg(F.sum("docs").alias("docs"))
    scratch = Scratch(spark)
    got = collections.defaultdict(dict)
    target = {}
    for r in mixing.class_rates(scratch.save(classes, "classes"), scratch).collect():
        got[r.source][r.size] = r.rate
        target[r.source] = r.target
    tilted = 0
    for s in got:
        sizes = [z for t, z, _ in rows if t == s]
        assert abs(sum(z * got[s][z] for z in sizes) - target[s]) <= 1e-5 * target[s]
        if target[s] < mixing.MOST * sum(sizes):
            tilted += 1
            assert [got[s][z] for z in sizes] == pytest.approx(list(dual(sizes, target[s])), abs=1e-5)
            assert len({round(r, 6) for r in got[s].values()}) > 2
    assert tilted >= 2


def test_hot_groups_ties_nulls_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 16)
    rows = [(None, "a b c", "x")] * 300 + [(i, "a b c", "x") for i in range(300)] + [(i % 7, "long " * 40, "y") for i in range(200)] + [(1, None, "y"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("s")).withColumn("target", F.lit(1)).withColumn("n", F.lit(2)).withColumn("a.b", F.lit(3)).withColumn("row", F.lit(4))
    got = mixing.mix_sources(df, keep=True)
    assert got.select("row.*").columns == df.columns
    kept = got.collect()
    assert len(kept) == len(rows) and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in kept)
    taken, targets = collections.Counter(), {}
    for r in kept:
        taken[r.row.source] += r.taken
        targets[r.row.source] = r.target
    assert all(abs(taken[s] - targets[s]) <= 40 for s in targets)
    again = mixing.mix_sources(df.repartition(5)).select("doc_id", "size", "taken", "target").collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in got.select("doc_id", "size", "taken", "target").collect())
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_one_long_text_and_no_words(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "b"), (3, "", "c"), (4, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.taken, r.target) for r in mixing.mix_sources(df).collect()}
    assert got[1][0] == 300_000 and got[1][1] in (0, 300_000) or got[1][1] == 600_000
    assert got[2][1] == 3 and got[2][2] == 3.0 and got[3][1:] == (0, 0.0) and got[4][1:] == (0, 0.0)
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix_sources(none).collect()] == [(0, 0), (0, 0)]
