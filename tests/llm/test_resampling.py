"""Importance resampling against a plain version, with long texts, nulls, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from answerlens.llm import resampling as rs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % rs.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, bench, drawn):
    """Rows (doc_id, n_features, weight, score) and the number drawn."""
    raw, target = collections.Counter(b for _, t in docs for b in features(t)[1]), collections.Counter(b for t in bench for b in features(t)[1])
    s, t = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    return rows, drawn * sum(r[-1] for r in rows) // 100


def test_crc_of_slices():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    size = np.concatenate([rng.integers(0, 40, 300), [rs.WIDE, rs.WIDE + 1, 1000]])
    start = np.array([rng.integers(0, 5001 - n) for n in size])
    assert rs.crc_of_slices(data, start, size).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start, size, strict=True)]


def test_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["Al", "be", "çé", "İ", "ß9", "日本", "x" * 150, "d"]) + str(rng.randrange(9))
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n\n", "_", "\x00", "-"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(300)] + [(300, None), (301, ""), (302, text(90_000)), (None, text(40)), (None, None), (303, "A" * 700_000 + " b " + "c" * 300)]
    docs += [(400, docs[5][1] + text(30))] * 6
    bench = [text(30) for _ in range(20)] + [None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("words", "score", "rank", "p", "i", "n", "long_enough", "a.b")}).repartition(5)
    b = spark.createDataFrame([(t,) for t in bench], "text string")
    got = rs.importance_resample(d, b, spark, drawn=50).collect()
    want, k = brute(docs, bench, 50)
    assert sorted((r[:4] for r in want), key=repr) == sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr)
    order = sorted((r for r in want if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert k > 60 and [(r["rank"], r.doc_id, r.score) for r in drawn] == [(n + 1, r[0], r[3]) for n, r in enumerate(order[:k])]


def test_blocks_of_a_long_text_have_its_features(monkeypatch):
    rng = random.Random(1)
    text = " ".join("w" * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(4000))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    monkeypatch.setattr(rs, "CHUNK", 700)
    parts = list(rs.batch_buckets(data, np.array([0, len(data)]), buckets=rs.BUCKETS, longest=3))
    assert len(parts) > 20 and sum(int(x[-1][0]) for x in parts) == 4000
    assert sorted(np.concatenate([x[2] for x in parts]).tolist()) == sorted(features(text)[1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rs.importance_resample(none, none.select("text"), spark).count() == 0
    one = rs.importance_resample(spark.createDataFrame([(1, "a b")], none.schema), none.select("text"), spark).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(3, None)]
