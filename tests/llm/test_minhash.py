import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import minhash
from answerlens.llm.scratch import Scratch


def sets_of(docs):
    out = {}
    for d, t in docs:
        w = [x.lower() for x in (t or "").encode().split()]
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(docs):
    s = sets_of(docs)
    up = {d: d for d in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d), find(d) == d) for d in s}


def near_copies(n, words=120, edits=7, seed=1):
    """Copies of one text with random edits: many pairs stay below the threshold, so groups fall into parts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


TEXTS = ["", "   ", "one two", "One  TWO", "a b c d e", "A b c d E", "a b c d e f", "é à î ô û ç", "x " * 3000, "x " * 3001, "word" * 20000]


@pytest.mark.parametrize("block", [512, 16])
def test_groups_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = TEXTS + near_copies(80) + near_copies(60, words=12, edits=3, seed=2) + near_copies(40, words=300, edits=20, seed=3) + ["same text of seven words in all"] * 20
    random.Random(4).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_near_duplicates(docs(texts), spark).collect()}
    assert got == brute(list(enumerate(texts)))


def test_nulls_repeats_and_empty(spark, docs):
    rows = [(1, None), (None, None), (None, "p q r s t u"), (4, "p q r s t u"), (4, "p q r s t u"), (7, "p q r s t u"), (None, "only here and in no other place")]
    got = [tuple(r) for r in minhash.minhash_near_duplicates(docs(rows), spark).collect()]
    want = [(1, 0, 1, True), (None, 0, None, False), (None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (None, 3, None, False)]
    assert collections.Counter(got) == collections.Counter(want)
    assert minhash.minhash_near_duplicates(docs([]), spark).count() == 0


def test_estimate_follows_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
        b = np.sort(np.concatenate([a[: int(len(a) * share)], np.unique(rng.integers(0, 2**63, int(4000 * (1 - share)), dtype=np.uint64))]))
        r = minhash.registers(np.concatenate([np.sort(a), b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash.estimate(r[0], r[1]) - true) < 0.15


def test_places_of_ids_are_even_for_row_numbers_too():
    rows = np.concatenate([(np.int64(p) << 33) + np.arange(2000) for p in range(40)])
    for ids in (rows, np.arange(80_000), -np.arange(1, 80_001), np.arange(80_000) << 40):
        assert len(np.unique(minhash._slots(ids))) > 0.98 * len(ids)


def test_sets_of_many_ids_come_by_a_join(spark, docs):
    d = docs([f"{i} one two three four five six" for i in range(200)] + [(None, "null id here")]).select(F.col("doc_id").alias("id"), "text")
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "id long")
    scratch = Scratch(spark)
    picked = {r["id"]: r["items"] for r in minhash._sets_of(d, ids, spark, scratch, 5).collect()}
    # 67 ids on 64 places: too many to pick by
    joined = {r["id"]: r["items"] for r in minhash._sets_of(d, ids, spark, scratch, 5, bits=6).collect()}
    assert picked == joined and sorted(picked) == list(range(0, 200, 3))
    assert minhash._id_bits(ids, 6) is None and minhash._id_bits(ids, minhash.ID_BITS) is not None


def test_results_stay_when_other_tables_go(spark, docs):
    scratch = Scratch(spark)
    a, b = (scratch.save(docs(["x", "y"]), n) for n in "ab")
    paths = dict(scratch.paths)
    scratch.keep(b)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    assert not there(paths[id(a)]) and there(paths[id(b)]) and b.count() == 2
    scratch.close()
    assert not there(paths[id(b)])
