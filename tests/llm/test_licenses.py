"""Statements whose word pairs lie on neighbouring diagonals."""

import random
import re

import pytest

from answerlens.llm import licenses


def _shares(text, statement):
    """Brute force: of each run of diagonals at most NEIGHBOUR apart, the longest ordered chain of pairs within a bounded stretch."""
    words, want = re.findall(r"[0-9a-z]+", text.lower()), statement.split()
    at = sorted((p - q, q) for p in range(len(words) - 1) for q in range(len(want) - 1) if words[p : p + 2] == want[q : q + 2])
    runs = []
    for d, q in at:
        if not runs or d - runs[-1][0] > licenses.NEIGHBOUR:
            runs.append([d, []])
        runs[-1][0] = d
        runs[-1][1].append((d + q, q))
    out = []
    for _, votes in runs:
        most = 0
        for p0, _ in votes:
            inside = sorted(v for v in votes if p0 <= v[0] <= p0 + len(want) - 2 + int(licenses.LONGER * len(want)))
            chains = {}
            for p, q in inside:
                chains[p, q] = 1 + max((c for (a, b), c in chains.items() if a < p and b < q), default=0)
            most = max([most, *chains.values()])
        out.append(most / (len(want) - 1))
    return out


def test_spans_are_bounded_and_in_order(spark, docs):
    far = "he released under " + "under the " * 60 + "big mit license"
    mixed = "mit license x released under x the mit"
    texts = [far, "under the big mit license", mixed, far + " and is released under the mit license", "the mit license released under the mit license"]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_labels(docs(texts), spark).collect()}
    assert got[0] == got[1] == got[2] == ("", 0.0) and got[3] == got[4] == ("mit", 1.0)
    assert max(_shares(far, "released under the mit license")) < licenses.SHARE


def test_pairs_of_single_votes_count(spark, docs):
    texts = ["released under the permissive mit license", "Mozilla Public License, version number 2.0", "released under mit license", "the mit license"]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_labels(docs(texts), spark).collect()}
    assert got[0] == ("mit", pytest.approx(0.75)) and got[1] == ("mpl", pytest.approx(0.8))
    assert got[2] == got[3] == ("", 0.0)


def test_a_pair_on_two_diagonals_counts_once(spark, docs):
    (got,) = licenses.license_labels(docs(["a b a b"]), spark, phrases=[], statements=[("a b a q", "x")]).collect()
    assert (got.labels, got.score) == ("", 0.0) and _shares("a b a b", "a b a q") == [pytest.approx(2 / 3)]


def test_statements_equal_brute_force(spark, docs):
    rng, texts = random.Random(8), []
    for _ in range(120):
        words = [w for _ in range(rng.randrange(1, 4)) for w in rng.choice(licenses.STATEMENTS)[0].split()]
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["other"], [rng.choice(words)]])
        texts.append(" ".join(words))
    for _ in range(80):  # few words, so that chains of diagonals are long
        words = licenses.STATEMENTS[1][0].split()
        cuts = [rng.randrange(len(words)) for _ in range(rng.randrange(1, 9))]
        texts.append(" ".join(w for i in cuts for w in words[i : i + rng.randrange(1, 5)]))
    for r in licenses.license_labels(docs(texts), spark, phrases=[]).collect():
        found = {(label, s) for statement, label in licenses.STATEMENTS for s in _shares(texts[r.doc_id], statement) if s >= licenses.SHARE}
        assert r.labels == ",".join(sorted({label for label, _ in found}))
        assert r.score == pytest.approx(max((s for _, s in found), default=0.0))
