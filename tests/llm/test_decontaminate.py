"""Passages with inserted and deleted words, up to the accepted share of edits."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import decontaminate as dc


def _words(rng, n):
    return [rng.getrandbits(62) | 1 for _ in range(n)]


def _closest(item, text, most):
    """Brute force: the smallest edit distance of the item to any stretch of the text."""
    return min(dc.edit_distance(item, text[i:j], most) for i in range(len(text) + 1) for j in range(i, len(text) + 1))


def test_insertions_and_deletions_up_to_the_limit(spark, docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, rows, most = [], [], {}
    for n, kind, middle in [(20, "d", True), (20, "i", True), (20, "d", False), (20, "i", False), (40, "d", False), (40, "i", False), (60, "d", False), (7, "d", True)] * 12:
        item = [word() for _ in range(n)]
        w, k = list(item), max(1, int(dc.EDITED * n))
        for _ in range(k):
            at = n // 2 if middle else rng.randrange(1, len(w) - 1)
            if kind == "d":
                del w[at]
            else:
                w.insert(at, word())
        most[len(items)] = k
        rows.append((len(items), " ".join([word() for _ in range(30)] + w + [word() for _ in range(30)])))
        items.append(" ".join(item))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.benchmark_matches(docs(rows), bench, spark).collect()}
    assert all(r.doc_id == r.item_id and 0 < r.distance <= most[r.doc_id] for r in got.values())
    assert len(got) >= 0.95 * len(rows)


def test_the_stretch_is_the_closest_of_the_text():
    rng = random.Random(4)
    for case in range(150):
        pool = _words(rng, 3 if case % 2 else 40)
        item, text = (np.array([rng.choice(pool) for _ in range(n)], dtype=np.uint64) for n in (rng.randrange(1, 8), rng.randrange(0, 12)))
        most = rng.randrange(4)
        best, want = dc.best_stretch(item, text, most), _closest(item, text, most)
        assert (best is None) == (want > most)
        if best:
            dist, first, end = best
            assert dist == want == dc.edit_distance(item, text[first:end], most) and 0 <= first <= end <= len(text)


def _edited(rng, words, edits, kinds):
    w = list(words)
    for at in sorted(rng.sample(range(len(w)), edits), reverse=True):
        kind = rng.choice(kinds)
        if kind == "s":
            w[at] = rng.getrandbits(62) | 1
        elif kind == "d":
            del w[at]
        else:
            w.insert(at, rng.getrandbits(62) | 1)
    return w


def _found(items, texts):
    held = dc.Items(list(enumerate(items)))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return {(m[0], m[1]) for m in dc._matches(np.array(sum(texts, []), dtype=np.uint64), at, held)}


@pytest.mark.parametrize("n,least", [(5, 1.0), (7, 1.0), (9, 1.0), (13, 0.99), (14, 0.99), (20, 0.99), (40, 0.99), (60, 0.99), (200, 0.99)])
@pytest.mark.parametrize("kinds", ["s", "d", "i", "sdi"])
def test_recall_with_all_accepted_edits(n, least, kinds):
    rng = random.Random(n)
    items = [_words(rng, n) for _ in range(150)]
    texts = [_words(rng, 20) + _edited(rng, x, int(dc.EDITED * n), kinds) + _words(rng, 20) for x in items]
    got = _found(items, texts)
    assert sum((i, i) in got for i in range(150)) >= least * 150


def test_every_single_edit_of_a_short_item_is_found():
    rng = random.Random(3)
    for n in (7, 8, 9, 11):
        items, texts = [], []
        for at in range(n):
            for kind in "sdi":
                item = _words(rng, n)
                w = list(item)
                w[at : at + (kind != "i")] = [] if kind == "d" else _words(rng, 1)
                items.append(item)
                texts.append(_words(rng, 12) + w + _words(rng, 12))
        assert {(i, i) for i in range(len(items))} <= _found(items, texts)


def test_documents_equal_brute_force(spark, docs):
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    items = [[rng.choice(pool) for _ in range(rng.randrange(1, 22))] for _ in range(25)]
    texts = []
    for d in range(60):
        w = list(rng.choice(items))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(pool)]])
        texts.append([rng.choice(pool) for _ in range(rng.randrange(15))] + w + [rng.choice(pool) for _ in range(rng.randrange(15))])
    number = {w: i + 1 for i, w in enumerate(pool)}
    as_numbers = lambda x: np.array([number[w] for w in x], dtype=np.uint64)
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            most = int(dc.EDITED * len(x))
            best = dc._last_row(as_numbers(x), as_numbers(t)[None, :], True).min()
            if best <= most:
                want[d, i] = best
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.benchmark_matches(docs([" ".join(t) for t in texts]), bench, spark).collect()}
    assert len(want) > 100 and got == want


def test_repeats_clashes_long_texts_and_empty_tables(spark, docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = " ".join(word() for _ in range(20))
    long = " ".join(word() for _ in range(200_000)) + " " + item
    d = docs([(1, long), (2, item), (2, item), (2, f"{item.split(' ', 1)[1]}"), (3, None), (4, "")]).withColumn("item_id", F.lit("x")).withColumn("id", F.lit(None)).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(7, item, 1), (7, item, 2), (None, item, 3)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, str(r.item_id), r.first_word, r.end_word, r.distance) for r in dc.benchmark_matches(d, bench, spark).collect())
    assert got == [(1, "7", 200_000, 200_020, 0), (1, "None", 200_000, 200_020, 0), (2, "7", 0, 20, 0), (2, "None", 0, 20, 0)]
    assert sorted(r.doc_id for r in dc.drop_contaminated(d, bench, spark).collect()) == [3, 4] and dc.drop_contaminated(d, bench, spark).columns == d.columns
    assert dc.benchmark_matches(d.limit(0), bench, spark).count() == dc.benchmark_matches(d, bench.limit(0), spark).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_unedited_short_items_are_always_found(n):
    rng = random.Random(70 + n)
    items = [_words(rng, n) for _ in range(1500)]
    texts = [_words(rng, 3) + x + _words(rng, 3) for x in items]
    assert {(i, i) for i in range(1500)} <= _found(items, texts)
    twice = [[w, w] for w in _words(rng, 50)]
    assert {(i, i) for i in range(50)} <= _found(twice, [_words(rng, 2) + x + _words(rng, 2) for x in twice])


def test_repetitive_texts_and_items_cost_little_and_give_the_first_place():
    rng = random.Random(8)
    line = _words(rng, 5)
    started = time.monotonic()
    for item, text in ((line * 8, line * 800), (line[:1] * 40, line[:1] * 4000), (line * 3, [*_words(rng, 9), *line * 2000])):
        held = dc.Items([(1, item)])
        got = list(dc._matches(np.array(text, dtype=np.uint64), np.array([0, len(text)]), held))
        assert [(m[0], m[1], m[4], m[5]) for m in got] == [(0, 1, 0, 0)]
        assert text[got[0][2] : got[0][3]] == item and got[0][2] == (9 if text[:5] != line and len(set(text)) > 1 else 0)
    assert time.monotonic() - started < 20


def test_a_large_benchmark_takes_passes(spark, docs, monkeypatch):
    rng = random.Random(5)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(30)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(dc, "PASS_WORDS", 50)
    got = {(r.doc_id, r.item_id) for r in dc.benchmark_matches(docs(["start " + x + " end" for x in items]), bench, spark).collect()}
    assert got == {(i, i) for i in range(30)}
