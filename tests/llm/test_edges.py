"""Empty tables, repeated rows, clashing column names and long texts, and brute force for the classifier and the pipeline."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from answerlens.llm import decontaminate, licenses, mixing, pii, quality, substrings, tokens, warc
from answerlens.llm.minhash import minhash_near_duplicates
from answerlens.llm.scratch import shared_dir


def clashing(df, *names):
    return df.withColumns({n: F.lit("x") for n in (*names, "a.b")})


def test_token_counts_edges(spark, docs):
    vocabulary = tokens.load_vocabulary(tokens.DEFAULT_MODEL)
    d = clashing(docs([(1, "a b"), (1, "a b"), (None, None), (2, "word " * 300_000)]), "n_tokens", "token_score", "row", "score")
    out = tokens.token_counts(d, spark, vocabulary=vocabulary)
    assert sorted(out.columns) == sorted(d.columns)
    got = [(r.doc_id, r.n_tokens) for r in out.collect()]
    assert got.count((1, got[0][1])) == 2 and (None, 0) in got and max(n for _, n in got) >= 300_000
    assert tokens.token_counts(d.limit(0), spark, vocabulary=vocabulary).count() == 0


def test_quality_edges_and_clashes(spark, docs):
    d = clashing(docs([(1, "good words"), (1, "good words"), (2, None), (3, "x " * 300_000)]), "score", "row", "label", "shard")
    w = np.zeros(1 << quality.BITS)
    w[0] = 1.0
    out = quality.score_quality(d, w, spark)
    assert sorted(out.columns) == sorted(d.columns) and {r.score for r in out.collect()} == {round(float(1 / (1 + np.exp(-1.0))), 9)}
    assert quality.score_quality(d.limit(0), w, spark).count() == 0
    assert not quality.train_quality(d.limit(0), spark.createDataFrame([], "doc_id long, quality int"), spark).any()


def test_many_rows_of_one_id_teach_once(spark, docs):
    rows = [(i, f"good {i} words") for i in range(1, 40)] + [(50 + i, f"bad {i} words") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 50), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    once = quality.train_quality(docs(rows), labels, spark)
    assert (once == quality.train_quality(docs(rows + rows[:10] * 500), labels, spark)).all()
    # texts that share an id: one of them is read
    assert (quality.train_quality(docs([(1, "a b"), (1, "c d")]), labels, spark) != 0).sum() == 5  # four slots and the bias


def test_ftrl_equals_a_dense_version():
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"turn": np.arange(30), "label": rng.integers(0, 2, 30).astype(float)})
    rows["slots"] = [np.unique(rng.integers(1, 40, 12)) for _ in range(30)]
    rows["counts"] = [rng.integers(1, 4, len(s)) for s in rows["slots"]]
    got = quality._ftrl(rows)
    z, n, size = np.zeros(40), np.zeros(40), 40
    weights = lambda: np.array([0.0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2) for i in range(size)])
    for _ in range(quality.EPOCHS):
        for s, c, y in zip(rows["slots"], rows["counts"], rows["label"], strict=True):
            x = np.zeros(size)
            x[s] = c / c.sum() ** 0.5
            x[0] = 1.0
            w = weights()
            g = (1 / (1 + np.exp(-w @ x)) - y) * x
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA
            z, n = z + g - sigma * w, n + g * g
    want = weights()
    assert dict(zip(got["slot"], got["w"], strict=True)) == pytest.approx({i: w for i, w in enumerate(want) if w})


def test_licences_clashes_and_long_texts(spark, docs):
    d = clashing(docs(["x " * 200_000 + "all rights reserved", None]), "key", "n_words", "template", "words", "id", "h", "pos")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word) for r in licenses.license_labels(d, spark).collect()}
    assert got == {0: (200_003, 1, 200_000), 1: (0, 0, None)}


def test_archives_clashes_and_long_pages(spark):
    pages = clashing(spark.createDataFrame([(1, "u", "é" * 1_000_000), (2, "u", None)], "page_id long, url string, html string"), "digest", "last", "bundle", "refers_to")
    manifest = warc.write_archives(pages, spark, f"{shared_dir(spark)}/warc-{random.random()}")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(manifest).collect()) == [(1, 2_000_000), (2, 0)]


def test_two_attempts_of_a_task_leave_two_bundles(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = f"{shared_dir(spark)}/warc-{random.random()}"
    first, second = warc.write_archives(pages, spark, folder), warc.write_archives(pages.orderBy(F.desc("page_id")), spark, folder)
    assert {r.bundle for r in first.collect()}.isdisjoint({r.bundle for r in second.collect()})
    for m in (first, second):
        assert sorted(r.payload for r in warc.read_archives(m).collect()) == sorted(f"page {i}".encode() for i in range(20))


def test_near_duplicates_and_repeats_ignore_other_columns(spark, docs):
    d = clashing(docs(["a b c d e f g", "a b c d e f g", None]), "id", "n", "sig", "component", "hub")
    assert sorted((r.doc_id, r.component_id) for r in minhash_near_duplicates(d, spark).collect()) == [(0, 0), (1, 0), (2, 2)]
    long = "".join(chr(97 + i % 23) + str(i) for i in range(60_000))
    d = clashing(docs([long, long]), "doc", "p", "runs", "a", "s")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.cut_repeats(d, spark).collect()) == [(0, 0), (1, len(long))]


def test_pipeline_with_nulls_repeats_and_clashing_columns(spark, docs, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = " ".join(word() for _ in range(20))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(20, base[0] + " more"), (20, base[0] + " more"), (None, base[1]), (30, f"{text(30)} {item}"), (31, text(30) + " mail me@host.org now"), (40, None), (41, "")]
    d = clashing(docs(rows), "size", "copy", "copies", "source_size", "target", "row", "__n", "id", "score")
    sf = str(tmp_path)
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = p.run(spark, sf).collect()

    # brute force over what the classifier keeps (all labels are good, so all rows)
    kept = [(i, t) for i, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for _, t in kept)]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for k, g in enumerate(group):
        order = (kept[k][0] is None, kept[k][0] if kept[k][0] is not None else 0)
        if g not in best or order < best[g][0]:
            best[g] = (order, k)
    left = [kept[k] for _, k in best.values()]
    left = [(i, t) for i, t in left if item not in (t or "")]
    left = [(i, None if t is None else re.sub(r"[\w.]+@[\w.]+\w", "[EMAIL]", t)) for i, t in left]
    words = lambda t: len((t or "").split())
    assert {(r.doc_id, r.text) for r in out} <= set(left)
    copies = collections.Counter((r.doc_id, r.text) for r in out)
    assert all(1 <= n <= mixing.MOST for n in copies.values()) and all(r.copies == copies[r.doc_id, r.text] for r in out)
    by_source = collections.defaultdict(int)
    for r in out:
        by_source[r.source] += words(r.text)
    targets = {r.source: r.target for r in out}
    assert all(abs(by_source[s] - targets[s]) <= 61 for s in targets)
    assert sum(words(t) for _, t in left) == pytest.approx(sum(targets.values()))
    empty = f"{sf}/none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert p.run(spark, empty).count() == 0


def test_masking_and_decontamination_keep_clashing_columns(spark, docs):
    d = clashing(docs(["hi a@b.co"]), "pii_spans", "start", "kind", "item_id", "id")
    assert pii.mask_pii(d).columns == d.columns
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert decontaminate.drop_contaminated(d, bench, spark).columns == d.columns
