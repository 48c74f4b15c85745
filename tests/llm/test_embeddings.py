import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    fine = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, la) in enumerate(fine):
        for j, w, lb in fine[a + 1 :]:
            if la == lb and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i in links:
            m = min([comp[i], *[comp[j] for j in links[i]]])
            changed |= m != comp[i]
            comp[i] = m
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def make(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.2, 1.0], n)[:, None]
    rows = [(i, [float(np.float32(y)) for y in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]
    same = rows[7][1]
    rows += [(n + i, same, rows[7][2]) for i in range(60)]
    rows += [(n + 100, None, 1), (n + 101, [0.0] * dim, 1), (n + 102, [float("nan")] + [1.0] * (dim - 1), 1), (n + 103, same, None), (n + 104, [None] + same[1:], 1), (n + 105, [], 1), (n + 106, [1.0, 2.0], 1), (n + 107, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("share,block", [(8, 2048), (0.5, 16)])
def test_links_and_groups_equal_brute_force(spark, monkeypatch, share, block):
    monkeypatch.setattr(em, "ROOT_SHARE", share)
    monkeypatch.setattr(em, "BLOCK", block)
    rows = make()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA), spark).collect()}
    want = brute(rows)
    assert sum(v[0] for v in want.values()) > 3000
    assert {i for i in want if got[i] != want[i]} == set()


def test_empty_and_null_ids(spark):
    assert em.embedding_near_duplicates(spark.createDataFrame([], SCHEMA), spark).count() == 0
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted((tuple(r) for r in em.embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA), spark).collect()), key=str)
    assert got == [(3, 1, 3, True), (None, 0, None, False), (None, 1, 3, False)]


def test_cells_at_every_size(spark):
    assert [em.cell_count(n) for n in (0, 59, 1186, 5681, 10**8)] == [2, 2, 4, 9, 1250]
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = em._unit([r.embedding for r in rows])
    centres = em.fit_cells(x, em.cell_count(59))
    home = np.argmax(x @ centres.T, axis=1)
    assert len(centres) == 2 and set(home) == {0, 1}


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "a", 5), (2, [1.0, 0.0], 1, None, 6)], SCHEMA + ", id string, n_links int").withColumn("a.b", F.lit(1)).withColumn("v", F.lit(0)).withColumn("cell", F.lit("x"))
    assert sorted(map(tuple, em.embedding_near_duplicates(df, spark).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
