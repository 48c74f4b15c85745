"""Small cases of token counts, decontamination, licences, archives, mixing, quality and the pipeline."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import decontaminate as dc
from answerlens.llm import licenses, mixing, quality, tokens, warc
from answerlens.llm.scratch import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary(tokens.DEFAULT_MODEL)


def test_token_counts_equal_the_public_unigram_model(spark, docs, vocabulary):
    from tokenizers import Tokenizer, models

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.DEFAULT_MODEL)
    model = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    texts = [None, "", " ", "a  b", "hello   world\nnew line\n\n", "naïve 🙂🙂 ŝ漢字", "▁▁ x", "tab\there", "word" * 3000] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(texts), spark, vocabulary=vocabulary).collect()}
    want = {i: len(model.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}
    assert got == want


def brute_viterbi(text, vocabulary, unknown):
    score = dict(vocabulary)
    best = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in score:
                s, n = best[start][0] + score[piece], best[start][1] + 1
            elif end - start == 1:
                s, n = best[start][0] + unknown, best[start][1] + len(piece.encode())
            else:
                continue
            if end not in best or s > best[end][0]:
                best[end] = (s, n)
    return best[len(text)][1], best[len(text)][0]


def test_ties_and_crossing_pieces_equal_brute_force():
    rng = random.Random(3)
    for case in range(40):
        vocabulary = [("".join(rng.choice("ab▁é") for _ in range(rng.randrange(1, 5))), float(-rng.randrange(3))) for _ in range(12)]
        vocabulary = list(dict(vocabulary).items())
        counter = tokens.UnigramCounter(vocabulary)
        for _ in range(20):
            text = "".join(rng.choice("ab é\n") for _ in range(rng.randrange(1, 12)))
            assert counter.count(text) == brute_viterbi("▁" + text.replace(" ", "▁"), vocabulary, counter.unknown), (vocabulary, text)


def test_benchmark_passages_exact_and_edited(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(40)) for _ in range(30)]
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for d in range(240):
        w = items[d % 30].split()
        if d % 3 == 1:
            for _ in range(4):
                k = rng.randrange(3)
                at = rng.randrange(len(w))
                if k == 0:
                    w[at] = word()
                elif k == 1:
                    del w[at]
                else:
                    w.insert(at, word())
        if d % 3 < 2:
            rows.append((d, f"{text(60)} {' '.join(w).upper() if d % 2 else ' '.join(w)}\n{text(20)}"))
            want.add((d, d % 30))
        else:
            rows.append((d, text(120)))
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, ""), (102, "one two")], "item_id long, text string")
    rows += [(500, None), (501, ""), (None, items[0]), (502, "see One Two here")]
    got = {(r.doc_id, r.item_id): r.distance for r in dc.benchmark_matches(docs(rows), bench, spark).collect()}
    assert set(got) <= want | {(None, 0), (502, 102)} and (None, 0) in got and (502, 102) in got
    assert all(got.get((d, i)) == 0 for d, i in want if d % 3 == 0)
    near = {x for x in want if x[0] % 3 == 1}
    assert len(near & set(got)) >= 0.9 * len(near)
    kept = {r.doc_id for r in dc.drop_contaminated(docs(rows), bench, spark).collect()}
    assert {d for d, _ in rows if d is not None and d % 3 == 2} <= kept and None not in kept


def test_edit_distance():
    a = np.array([1, 2, 3, 4, 5], dtype=np.uint64)
    assert dc.edit_distance(a, a, 2) == 0 and dc.edit_distance(a, a[1:], 2) == 1 and dc.edit_distance(a, a[::-1].copy(), 2) == 3


def license_rows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences_equal_brute_force(spark, docs):
    texts = [None, "", "cc", "CC BY", "cc-by cc by CC, by", "All rights reserved. all  RIGHTS\nreserved", "General public general public license license", "all rights all rights reserved", "İ K cc by é", "x " * 20000 + "cc by"]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy of the software", "Licensed under the Apache License, Version 2.0."]
    rows = licenses.license_labels(docs(texts), spark).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_rows(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in rows}
    assert found[10] == "mit" and found[11] == "apache"


def test_licences_of_repeated_rows_and_null_ids(spark, docs):
    d = docs([(1, "cc by"), (1, "cc by"), (None, "cc by x"), (1, "nothing")])
    assert sorted((str(r.doc_id), r.n_base) for r in licenses.license_labels(d, spark).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert licenses.license_labels(docs([]), spark).count() == 0


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}", "same" if i % 3 == 0 else (None if i % 7 == 0 else f"page {i} é" * (i % 50))) for i in range(200)] + [(None, None, "same"), (500, "a\r\nb", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"{shared_dir(spark)}/warc-{random.random()}"
    manifest = warc.write_archives(pages, spark, folder)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    for i, url, h in rows:
        r, p, last = got[i], (h or "").encode(), max(x for x in groups[h or ""] if x is not None)
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
        assert r.payload == (p if i == last else b"")
    some = manifest.filter(F.col("record").isin("urn:page:10", "urn:page:11"))
    assert sorted(r.page_id for r in warc.read_archives(some).collect()) == [10, 11]
    assert warc.read_archives(warc.write_archives(pages.limit(0), spark, folder + "-none")).count() == 0


def test_mix_targets(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 40, 300)))), f"s{min(rng.randrange(9), 3)}" if i % 17 else None) for i in range(1500)] + [(5000, "w " * 4000, "s0"), (5001, None, "zero"), (None, "a b", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left, w = sum(size.values()) - sum(3 * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 3 * size[s]} - capped
        if not over:
            break
        capped |= over
    by_size = {v: k for k, v in size.items()}
    taken = collections.Counter()
    for r in got:
        s = by_size[r.source_size]
        taken[s] += r.taken
        assert abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], 150) for s in names) and len(got) == len(rows)
    assert sorted(map(str, mixing.mix_sources(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_quality_learns_and_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    w = quality.train_quality(docs, labels, spark)
    flipped = labels.withColumn("quality", F.when(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(w, quality.train_quality(docs, flipped, spark))
    s = {r.doc_id: r.score for r in quality.score_quality(docs, w, spark, columns=["doc_id"]).collect()}
    held = [(s[r.doc_id], r.quality) for r in labels.filter("crc32(CAST(doc_id AS STRING)) % 5 = 0").collect()]
    good, bad = [x for x, q in held if q == 1], [x for x, q in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    assert np.mean([x >= quality.THRESHOLD for x in good]) > 0.97


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = docs([None, "", "text", "é" * 5000])
    w = quality.train_quality(d, none, spark)
    assert {r.score for r in quality.score_quality(d, w, spark).collect()} == {0.5}
    assert quality.score_quality(d, w, spark).columns == [*d.columns, "score"]


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, before = {}, docs
    for name, stage in p.STAGES:
        after = stage(spark, before, SF)
        seen[name] = after.cache()
        if name != "mixing":
            assert after.columns == docs.columns
        before = after
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mixing"]
    count = {k: v.count() for k, v in seen.items()}
    assert docs.count() >= count["quality"] >= count["near_dedup"] >= count["decontaminate"] == count["pii"]
    ids = {r.doc_id for r in seen["pii"].collect()}
    assert {r.doc_id for r in seen["mixing"].collect()} <= ids
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, seen["mixing"].collect()))
