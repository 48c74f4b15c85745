import hashlib
import random

from answerlens.llm import substrings


def brute(rows, length=100):
    seen, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (d, i)) != (d, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def make_texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(6)]
    base = text(300)
    out = [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "a" * 500, "ab" * 300, base, base, base[:99], base[1:101], "é" * 80]
    for i in range(60):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s))
            parts += [s[cut : cut + rng.choice((90, 100, 101, 107, 110, 130, 1000))], text(rng.randrange(20))]
        out.append("".join(parts))
    for _ in range(25):
        b = list(base)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        out.append("".join(b))
    return out


def test_equals_brute_force(spark, docs):
    for seed in (0, 1):
        rows = list(enumerate(make_texts(seed)))
        got = {r.doc_id: tuple(r)[1:] for r in substrings.cut_repeats(docs([t for _, t in rows]), spark).collect()}
        want = brute(rows)
        assert {d for d in want if got[d] != want[d]} == set()


def test_chunk_borders_dont_matter(spark, docs, monkeypatch):
    from answerlens.llm import bytehash

    plain = bytehash.chunks
    monkeypatch.setattr(bytehash, "chunks", lambda offsets, limit=0: plain(offsets, 3000))
    rows = list(enumerate(make_texts(2)))
    got = {r.doc_id: tuple(r)[1:] for r in substrings.cut_repeats(docs([t for _, t in rows]).repartition(3), spark).collect()}
    assert got == brute(rows)


def test_null_ids_repeated_rows_and_empty(spark, docs):
    t = "q" * 50 + "".join(chr(97 + i % 26) for i in range(200))
    got = sorted((tuple(r) for r in substrings.cut_repeats(docs([(5, t), (5, t), (None, t), (6, t)]), spark).collect()), key=str)
    assert [(r[0], r[2]) for r in got] == [(5, 174), (5, 174), (6, 250), (None, 0)]
    assert substrings.cut_repeats(docs([]), spark).count() == 0
