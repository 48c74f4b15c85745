"""Benchmark passages in documents, by CGK embeddings and bit-sampling LSH.

The CGK random walk reads a window symbol by symbol (here words) and repeats a symbol or moves on by a random bit of
(step, symbol), which maps edit distance to Hamming distance. Every start of every text is embedded, forwards and, from
every end, backwards; a window whose embedding agrees with that of an item on all sampled steps, for any walk and any
sample, is a candidate, and an exact alignment decides.

Walks of a text don't depend on a window's length as long as they stay inside it, so one walk from each word serves the
items of all lengths. Long items are cut into parts of 10 to 13 words (7 to 9 for items of 14 to 19 words): one part at
least has no more than one of the accepted edits, and each part is looked up as an item of its own. An edit desynchronises
what follows it in the direction of the walk only, so forward and backward walks find it from both sides. Items of up to six
words, of which none may be edited, are read by one walk that always moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm import bytehash as bh

#: Share of an item's words that may be edited.
EDITED = 0.15
#: Independent walks in each direction, and the walk that always moves on, for items that must stand unedited.
WALKS = 4
STRAIGHT = 2 * WALKS
#: Ends of stretches that are traced back at a time.
ENDS = 4096
#: Steps whose symbols a sample compares, for parts of up to 9 words and for longer ones; each walk has all samples.
SHORT = ((0, 2, 4), (1, 3, 5))
LONG = ((0, 2, 4, 7), (1, 3, 5, 8), (2, 4, 6, 9))
#: Different words that a sample must stand on to be looked up (a walk that lingers says too little), and the same for
#: short items in one part, which no other part can find.
LEAST, LEAST_ALONE = 3, 2
#: Words of the longest part, of the longest that takes the short samples, and of items that must stand unedited.
PART, SHORT_PART, WHOLE = 13, 9, 6
#: Words of benchmark items that one pass holds in each worker; a larger benchmark takes more passes.
PASS_WORDS = 2_000_000


def samples_of(words: int) -> tuple[tuple[int, ...], ...]:
    """The samples for a part of so many words; one of up to WHOLE words is compared on steps that stay inside it."""
    if words <= WHOLE:
        return (tuple(range(words)),)
    return SHORT if words <= SHORT_PART else LONG


def parts_of(n: int) -> list[tuple[int, int]]:
    """(first, end) of the parts of an item of n words."""
    k = max(1, -(-n // PART))
    edges = [n * i // k for i in range(k + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def step_bits(words: np.ndarray, walk: int) -> np.ndarray:
    """32 bits per word: whether the walk moves on from the word at steps 0 to 31."""
    if walk == STRAIGHT:
        return np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    return (bh.mix(words + bh._STEP[40 + walk]) >> np.uint64(32)).astype(np.uint32)


def walk_from(words: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
    """For each step, the place (from 0) that the walk from each word has reached; the array's last words are padding."""
    bits, at, out = step_bits(words, walk), np.arange(len(words) - steps, dtype=np.int32), []
    for t in range(steps):
        out.append(at)
        if t + 1 < steps:
            step = bits.take(at, mode="clip")
            step >>= np.uint32(t)
            step &= np.uint32(1)
            at = at + step.view(np.int32)
    return out


class Items:
    """A block of benchmark items with the keys of their parts; at most PASS_WORDS words unless one item is longer."""

    def __init__(self, rows: list[tuple[int, list[int]]], edited: float = EDITED):
        self.ids = [r[0] for r in rows]
        self.words = [np.array(r[1], dtype=np.int64).view(np.uint64) for r in rows]
        self.most = [int(edited * len(w)) for w in self.words]
        # (sample) -> per walk and direction: keys in order, item and place of the part's border of each, tables of bits
        found: dict[tuple, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            for first, end in parts_of(len(w)):
                alone = end - first == len(w) <= SHORT_PART
                for sample in samples_of(end - first):
                    for walk in [STRAIGHT] if len(w) <= WHOLE else range(2 * WALKS):
                        part, place = (w[first:end], first) if walk % 2 == 0 else (w[first:end][::-1], end)
                        at = _walk_of(part, walk, sample[-1] + 1)
                        if at[-1] < len(part) and len({at[t] for t in sample}) >= min(len(sample), LEAST_ALONE if alone else LEAST):
                            symbols = part[np.array([at[t] for t in sample])]
                            key = int(_key([symbols[k : k + 1] for k in range(len(sample))])[0])
                            found.setdefault((walk, sample), []).append((key, int(symbols[0]), i, place))
        self.bits = max(16, int(math.log2(max(1, *map(len, found.values()), 1))) + 6)
        self.index = {k: _Lookup(v, self.bits) for k, v in sorted(found.items())}
        self.steps = max((sample[-1] + 1 for _, sample in found), default=1)


def _walk_of(part: np.ndarray, walk: int, steps: int) -> list[int]:
    bits, at, out = step_bits(part, walk), 0, []
    for t in range(steps):
        out.append(at)
        at += int(bits[at] >> np.uint32(t)) & 1 if at < len(part) else 0
    return out


def _key(symbols: list[np.ndarray]) -> np.ndarray:
    return bh.mix(sum(x * bh._STEP[k + 8] for k, x in enumerate(symbols)))


class _Lookup:
    """Keys of one walk and sample, with tables of bits that rule out most first symbols and keys before the search."""

    def __init__(self, rows: list[tuple[int, int, int, int]], bits: int):
        order = sorted(range(len(rows)), key=lambda k: rows[k])
        key, first = (np.array([rows[k][c] for k in order], dtype=np.uint64) for c in (0, 1))
        self.key = key
        self.item, self.place = (np.array([rows[k][c] for k in order], dtype=np.int64) for c in (2, 3))
        self.shift = np.uint64(64 - bits)
        self.maybe_first, self.maybe_key = (np.zeros(1 << bits, dtype=bool) for _ in range(2))
        self.maybe_first[first >> self.shift] = True
        self.maybe_key[key >> self.shift] = True

    def find(self, words: np.ndarray, high: np.ndarray, at: list[np.ndarray], sample: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, place) of the walks whose sampled symbols equal those of a part; high: the words' first bits."""
        start = np.flatnonzero(self.maybe_first.take(high, mode="clip").take(at[sample[0]], mode="clip"))
        key = _key([words[at[t][start]] for t in sample])
        some = self.maybe_key[key >> self.shift]
        start, key = start[some], key[some]
        low, high = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        each = np.repeat(np.arange(len(key)), high - low)
        row = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return start[each], self.item[row], self.place[row]


def candidates(words: np.ndarray, at: np.ndarray, items: Items) -> np.ndarray:
    """Rows (document, item, start), each once: where an item would start if nothing before the agreeing part is edited."""
    n, out = len(words), [np.zeros((0, 3), np.int64)]
    padding = np.zeros(items.steps, dtype=np.uint64)
    lines = [np.concatenate([x, padding]) for x in (words, words[::-1])]
    highs = [(x >> np.uint64(64 - items.bits)).astype(np.int32) for x in lines]
    for walk in range(2 * WALKS + 1):
        samples = [s for w, s in items.index if w == walk]
        if not samples:
            continue
        line, high = lines[walk % 2], highs[walk % 2]
        reached = walk_from(line, walk, items.steps)
        for sample in samples:
            start, item, place = items.index[walk, sample].find(line, high, reached, sample)
            word = start if walk % 2 == 0 else n - 1 - start
            doc = np.searchsorted(at, word, side="right") - 1
            out.append(np.stack([doc, item, word - place if walk % 2 == 0 else word + 1 - place], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to insert, delete or replace; most + 1 if that is more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    step = np.arange(len(b) + 1)
    row = step.copy()
    for i, x in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return most + 1
    return int(row[-1])


def _last_row(item: np.ndarray, texts: np.ndarray, free: bool) -> np.ndarray:
    """Edit distances of the whole item to each text's first 0, 1, ... words, or to the best stretch that ends there."""
    step = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), len(step)), dtype=np.int64) + (0 if free else step)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != x))
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row


def best_stretch(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, first, end) of the stretch of the text closest to the item, None if that is further than ``most``.

    Of equally close stretches the one whose length is nearest to the item's, then the first.
    """
    row = _last_row(item, text[None, :], True)[0]
    dist = int(row.min())
    if dist > most:
        return None
    ends, best = np.flatnonzero(row == dist), None
    for some in np.array_split(ends, len(ends) // ENDS + 1):
        # backwards from each end; what lies before the text's first word is never part of a stretch
        back = some[:, None] - 1 - np.arange(min(len(text), len(item) + dist))[None, :]
        size = _last_row(item[::-1], text[np.maximum(back, 0)], False) if len(text) else np.full((len(some), 1), dist)
        which, n = np.nonzero((size == dist) & (np.arange(size.shape[1])[None, :] <= some[:, None]))
        off, first, end = np.abs(n - len(item)), some[which] - n, some[which]
        for k in np.lexsort((end, first, off))[:1]:
            found = (int(off[k]), int(first[k]), int(end[k]))
            best = found if best is None else min(best, found)
        if best and best[0] == 0:  # later ends give later stretches
            break
    return dist, best[1], best[2]


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for batch in batches:
            data, offsets = bh.text_bytes(batch.column(1))
            for i, j in bh.chunks(offsets):
                words, at = bh.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = list(_matches(words, at, items))
                docs, item, start, end, dist, off = ([x[k] for x in found] for k in range(6))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(docs, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(dist, pa.int32()), pa.array(off, pa.int64())], ["id", "item_id", "first_word", "end_word", "distance", "off"])

    return run


def _matches(words: np.ndarray, at: np.ndarray, items: Items) -> Iterator[tuple]:
    """The closest stretch of each region; regions of one item in one text that overlap are aligned as one."""
    for d, i, first, end in _regions(candidates(words, at, items), at, items):
        most, n = items.most[i], len(items.words[i])
        # each word of the item that isn't edited stands in the region
        if np.isin(items.words[i], words[first:end]).sum() < n - most:
            continue
        best = best_stretch(items.words[i], words[first:end], most)
        if best:
            yield d, items.ids[i], int(first - at[d]) + best[1], int(first - at[d]) + best[2], best[0], abs(best[2] - best[1] - n)


def _regions(found: np.ndarray, at: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first, end) around the candidates, which come in order."""
    if not len(found):
        return
    d, i, s = found.T
    most, n = np.array(items.most)[i], np.array([len(w) for w in items.words])[i]
    first, end = np.maximum(at[d], s - most), np.minimum(at[d + 1], s + n + most)
    inside = first < end
    d, i, first, end = d[inside], i[inside], first[inside], end[inside]
    if len(d):
        new = np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (first[1:] > end[:-1]))
        start = np.flatnonzero(new)
        yield from zip(d[start].tolist(), i[start].tolist(), first[start].tolist(), np.maximum.reduceat(end, start).tolist(), strict=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, at = bh.word_hashes(*bh.text_bytes(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "words"])


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, spark: SparkSession, *, edited: float = EDITED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance): where a document holds a benchmark item.

    A stretch of words, of any length, matches when at most ``edited`` of the item's words (lower-cased, split at white
    space) are inserted, deleted or replaced. Of one document and item the closest stretch is returned, of equally
    close ones that whose length is nearest to the item's, then the first. Items of up to six words must stand unedited and
    are always found; longer ones are found with the chances that the README gives, and have the exact distance there.

    The benchmark is read in passes of at most PASS_WORDS words, so its size in a worker is bounded; documents are
    never shuffled. Null or empty texts and items match nothing; rows that share a doc_id are one document and the
    closest of all is returned; a null doc_id is one document as well; null item ids are matched like others. Repeated
    items are found once per id. Other columns are ignored, whatever their names; an empty table, of documents or of the
    benchmark, gives no rows.
    """
    hashed = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("t")).mapInArrow(_hashed, "id long, words array<long>").filter("size(words) > 0")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out, block, held = None, [], 0
    for row in chain(hashed.orderBy("id", F.xxhash64("words")).toLocalIterator(), [None]):
        if block and (row is None or held + len(row.words) > PASS_WORDS):
            part = docs.mapInArrow(_search(spark.sparkContext.broadcast(Items(block, edited))), "id long, item_id long, first_word long, end_word long, distance int, off long")
            out, block, held = part if out is None else out.unionByName(part), [], 0
        if row is not None:
            block.append((row.id, row.words))
            held += len(row.words)
    if out is None:
        out = spark.createDataFrame([], "id long, item_id long, first_word long, end_word long, distance int, off long")
    best = out.groupBy("id", "item_id").agg(F.min(F.struct("distance", "off", "first_word", "end_word")).alias("x"))
    return best.select(F.col("id").alias("doc_id"), "item_id", "x.first_word", "x.end_word", "x.distance")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, spark: SparkSession, **params) -> DataFrame:
    """documents without those that hold a benchmark item; rows with a null doc_id go only if one of them matches."""
    found = benchmark_matches(documents, benchmark, spark, **params).select(F.col("doc_id").alias("__found")).distinct()
    return documents.join(found, documents[params.get("id_col", "doc_id")].eqNullSafe(found["__found"]), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)
