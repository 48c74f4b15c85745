"""Language filters: held-out accuracy, Bloom filters against plain sets, edges."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import language as lang

SF = "/root/testdata/sf0.001"


def _codes(text):
    data = text.encode()
    return lang.characters(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))


def _plain_ngrams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return [p[i : i + n] for w in words for n in lang.SIZES for p in ([f" {w} "] if n > 1 else [w]) for i in range(len(p) - n + 1)]


def test_held_out_rows(spark):
    out = lang.op12_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r.lang == r.lang_pred for r in out if r.held_out]
    assert len(held) > 50 and sum(held) >= 0.97 * len(held)


def test_ngrams_equal_a_plain_version():
    for text in ["Ab, cd!", "é", "", "12 x", "naïve  Zürich's", "a b c"]:
        codes, at, _ = _codes(text)
        want = _plain_ngrams(text)
        got, _ = lang.ngrams(codes, at)
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
        hashed = {}
        for w in want:  # the same string has the same hash, whatever stands around it
            single, _ = lang.ngrams(np.array([ord(c) for c in w], dtype=np.uint32), np.array([0, len(w)]), (len(w),))
            hashed[w] = int(single[0])
        assert sorted(got.tolist()) == sorted(hashed[w] for w in want)


def test_filters_hold_the_characteristic_ngrams_and_chance_is_taken_off(spark):
    rng = random.Random(5)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    texts = {k: [" ".join("".join(rng.choice(v) for _ in range(rng.randrange(1, 7))) for _ in range(30)) for _ in range(40)] for k, v in letters.items()}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    model = lang.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark, slot_bits=13)
    assert model.languages == ["aa", "bb", "cc"] and model.table.shape == (1 << 13, 1) and (model.chance > 0).all()
    seen, n = {}, {}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            n[k] = n.get(k, 0) + 1
            for g in set(_plain_ngrams(t)):
                seen.setdefault(g, {}).setdefault(k, 0)
                seen[g][k] += 1
    member = {}
    for g, by in seen.items():
        share = {k: c / n[k] for k, c in by.items()}
        member[g] = {k for k, s in share.items() if s >= lang.CHARACTERISTIC * max(share.values())}
    extra = total = 0
    for g, langs in member.items():
        h, _ = lang.ngrams(np.array([ord(c) for c in g], dtype=np.uint32), np.array([0, len(g)]), (len(g),))
        mask = int(model.masks(h)[0, 0])
        found = {k for b, k in enumerate(model.languages) if mask >> b & 1}
        assert langs <= found
        extra, total = extra + len(found - langs), total + 3 - len(langs)
    assert extra / total == pytest.approx(model.chance.mean(), abs=0.05)
    # a text of unknown n-grams: what the filters let through by chance is taken off
    codes, at, _ = _codes(" ".join("".join(chr(rng.randrange(0x400, 0x450)) for _ in range(6)) for _ in range(3000)))
    grams, row = lang.ngrams(codes, at)
    hits = model.hits(grams, row, 1)
    assert hits.sum() > 0 and model.shares(hits, np.array([len(grams)])).max() < 0.02


def test_more_than_eight_languages(spark):
    rows = [(10 * i + j, (chr(97 + i) * 3 + " ") * 5, f"l{i:02}") for i in range(20) for j in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.train_languages(d, spark, slot_bits=12)
    assert model.table.shape == (1 << 12, 3)
    assert all(r.lang == r.lang_pred and r.score > 0.9 for r in lang.predict_language(d, model, spark).collect())


def test_edges(spark):
    long = "hello world " * 300_000 + "x" * 2_100_000
    rows = [(1, "hello world", "en"), (1, "hello world", "en"), (2, "guten tag", "de"), (3, None, "en"), (4, "", None), (5, "123 #!", "de"), (None, "bonjour", "fr"), (6, "привет", None), (7, long, None), (8, "ñ", "es"), (9, "guten abend", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit("x") for n in ("score", "row", "Lang_Pred", "id", "hash", "cut", "gram", "a.b")})
    model = lang.train_languages(d, spark, slot_bits=14)
    out = lang.predict_language(d, model, spark)
    assert sorted(c.lower() for c in out.columns) == sorted(c.lower() for c in d.columns)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert "fr" not in model.languages and all(zlib.crc32(str(i).encode()) % 3 != 1 or k not in ("es",) for i, _, k in rows if k in model.languages)
    assert got[3, None] == got[4, ""] == got[5, "123 #!"] == ("und", 0.0)
    assert got[6, "привет"] == (model.languages[0], 0.0) and got[7, long][0] == "en"
    assert lang.predict_language(d.limit(0), model, spark).count() == 0
    empty = lang.train_languages(d.limit(0), spark, slot_bits=12)
    assert {(r.lang_pred, r.score) for r in lang.predict_language(d, empty, spark).collect()} == {("und", 0.0)}
