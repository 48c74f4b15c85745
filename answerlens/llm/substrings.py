"""Removal of repeated byte strings: every byte covered by a 100-byte string that also starts earlier.

Each 100-byte window has one anchor, its smallest hashed 24-gram (the last of equal ones); equal windows have equal
anchors at equal places. Consecutive windows of one anchor form a run, about 39 windows long, and runs are what is
shuffled. A run that occurs earlier as a whole is removed as a whole. Where runs of one anchor differ, they are cut into
cells of up to eight windows; the windows of a cell share a core of 93 bytes, so only cells whose core occurs in another
cell too have windows to compare one by one. This stands in for the column-wise suffix array (see README), which needs a round over the
whole collection per byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.llm import bytehash as bh
from answerlens.llm.scratch import Scratch

LENGTH, GRAM = 100, 24
RUN = "a long, s long, doc long, p long"
#: Windows of a cell, by their distance to the anchor.
CELL = 8


def _anchors(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of its smallest, the last of equal ones."""
    at, span = np.arange(len(v), dtype=np.int32), 1

    def join(v, at, shift):
        right = v[shift:] <= v[:-shift]
        return np.where(right, v[shift:], v[:-shift]), np.where(right, at[shift:], at[:-shift])

    while span * 2 <= width:
        v, at = join(v, at, span)
        span *= 2
    if width > span:
        v, at = join(v, at, width - span)
    return at


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, run hash, anchor) of all runs; start is counted from the row's first byte."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    sums = bh.prefix(data)
    pos = np.arange(len(data) - gram + 1)
    v = bh.slice_hash(sums, pos, pos + gram)
    at = _anchors(v, length - gram + 1)
    valid = np.zeros(n + 1, dtype=np.int32)
    rows = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows + 1] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    edge = np.ones(n + 1, dtype=bool)
    edge[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    edge[offsets[rows]] = True
    edge[n] = True
    start = np.flatnonzero(edge)
    start, end = start[:-1], start[1:]
    seen = valid[start]
    start, end = start[seen], end[seen]
    anchor = at[start]
    whole = bh.mix(bh.slice_hash(sums, start, end + length - 1) + (anchor - start).astype(np.uint64) * bh._STEP[20])
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start - offsets[row], end - start, v[anchor], whole, anchor


def _first_here(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for rows that stand later than an equal key in these rows."""
    order = np.lexsort((start, doc, *keys))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = (doc[order] != doc[order][head]) | (start[order] != start[order][head])
    out = np.zeros(len(order), dtype=bool)
    out[order] = later
    return out


def _emit(a, s, doc, start, n) -> pa.RecordBatch:
    """Runs that stand later than an equal one of the same batch are known to go: they travel under their own key."""
    gone = _first_here([s, a], doc, start)
    a = np.where(gone, bh.mix(doc.view(np.uint64) * bh._STEP[1] + start.astype(np.uint64)), a)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(doc), pa.array((start << 8) | (n << 1) | gone)], ["a", "s", "doc", "p"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = bh.text_bytes(batch.column(1))
        parts = []
        for i, j in bh.chunks(offsets):
            row, start, n, a, s, _ = window_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append((a, s, ids[i + row], start, n))
        if parts:
            yield _emit(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the runs listed per text: keyed by core, with a hash of the whole cell and of each window."""
    for batch in batches:
        ids = batch.column(0).to_numpy().astype(np.int64)
        data, offsets = bh.text_bytes(batch.column(1))
        lists = batch.column(2)
        at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy()
        parts = []
        for i, j in bh.chunks(offsets):
            text, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            row, start, n, _, _, anchor = window_runs(text, base)
            known = np.repeat(np.arange(i, j), np.diff(at[i : j + 1])), flat[at[i] : at[j]] >> 8
            listed = np.isin((row + i) * (1 << 40) + start, known[0] * (1 << 40) + known[1])
            row, start, n, anchor = row[listed], start[listed] + base[row[listed]], n[listed], anchor[listed]
            low, high = (anchor - (start + n - 1)) // CELL, (anchor - start) // CELL
            each = np.repeat(np.arange(len(row)), high - low + 1)
            cell = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            first = np.maximum(start[each], anchor[each] - cell * CELL - CELL + 1)
            last = np.minimum(start[each] + n[each] - 1, anchor[each] - cell * CELL)
            sums = bh.prefix(text)
            core = bh.slice_hash(sums, anchor[each] - cell * CELL, anchor[each] - cell * CELL - CELL + 1 + LENGTH)
            key = bh.mix(core + cell.astype(np.uint64) * bh._STEP[21])
            whole = bh.mix(bh.slice_hash(sums, first, last + LENGTH) + (anchor[each] - first).astype(np.uint64) * bh._STEP[22])
            size = last - first + 1
            pos = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            windows = np.split(bh.slice_hash(sums, pos, pos + LENGTH).view(np.int64), np.cumsum(size)[:-1]) if len(size) else []
            parts.append((key, whole, ids[row[each] + i], first - base[row[each]], size, windows))
        if parts:
            a, s, doc, start, n = (np.concatenate([p[k] for p in parts]) for k in range(5))
            out = _emit(a, s, doc, start, n)
            windows = [w for p in parts for w in p[5]]
            gone = out.column("p").to_numpy() & 1  # cells that go anyway need no windows
            windows = [w[:0] if g else w for w, g in zip(windows, gone, strict=True)]
            begin = np.concatenate([[0], np.cumsum(np.where(gone, 0, n))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(np.concatenate([*windows, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*out.columns, lists], ["a", "s", "doc", "p", "w"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bh.text_bytes(batch.column(1))
        out = []
        for i, runs in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            size = len(text)
            if not runs:
                out.append((size, 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                continue
            p = np.array(runs, dtype=np.int64)
            edge = np.zeros(size + 1, dtype=np.int32)
            np.add.at(edge, np.minimum(p >> 8, size), 1)
            np.add.at(edge, np.minimum((p >> 8) + ((p >> 1) & 127) + LENGTH - 1, size), -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((size, int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _judged(runs: DataFrame) -> DataFrame:
    """Each run with ``first``: no equal run stands earlier, and ``split``: another run has its anchor."""
    equal, anchor = W.partitionBy("a", "s"), W.partitionBy("a")
    first = F.min(F.struct("doc", "p")).over(equal)
    x = runs.withColumn("m", first).withColumn("lo", F.min("s").over(anchor)).withColumn("hi", F.max("s").over(anchor))
    known = F.col("p").bitwiseAND(1) == 1
    is_first = ~known & (F.col("doc") == F.col("m.doc")) & (F.col("p") == F.col("m.p"))
    return x.select(*[c for c in runs.columns if c != "s"], is_first.alias("first"), (F.col("lo") < F.col("hi")).alias("split"))


def repeated_runs(documents: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, p): where strings that also start earlier stand; p is start * 256 + windows * 2 (+ 1)."""
    scratch = Scratch(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc IS NOT NULL AND octet_length(text) >= 100")
    runs = scratch.save(_judged(docs.mapInArrow(_runs, RUN)).filter("NOT first OR split").select("doc", "p", "first"), "runs", wait=3)
    split = runs.filter("first").groupBy("doc").agg(F.collect_set("p").alias("runs"))
    cells = _judged(docs.join(split, "doc").select("doc", "text", "runs").mapInArrow(_cells, RUN + ", w array<long>")).filter("NOT first OR split")
    cells = scratch.save(cells.select("a", "doc", "p", "first", F.when(F.col("first"), F.col("w")).alias("w")), "cells", wait=3)
    windows = cells.filter("first").select("a", "doc", F.shiftright("p", 8).alias("start"), F.posexplode("w").alias("i", "s"))
    windows = windows.select("a", "s", "doc", F.shiftleft(F.col("start") + F.col("i"), 8).bitwiseOR(F.lit(2)).alias("p"))
    single = _judged(windows).filter("NOT first").select("doc", "p")
    parts = [x.filter("NOT first").select("doc", "p") for x in (runs, cells)]
    return scratch.save(parts[0].unionByName(parts[1]).unionByName(single), "repeated", wait=3)


def cut_repeats(documents: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (SHA-256 of the remaining bytes).

    A byte goes when a 100-byte string over it also starts earlier: in a smaller doc_id, or in the same text further
    left; overlaps count and strings are judged on the input. A null text is empty; texts under 100 bytes lose
    nothing. Rows that repeat a doc_id must repeat its text, and are one document. Rows with a null doc_id are neither
    cut nor compared with. Other columns are ignored; an empty table gives no rows.

    Equal runs of one Arrow batch are settled before the shuffle, so a passage that a third of the documents share
    sends one row per batch and run.
    """
    runs = repeated_runs(documents, spark, id_col=id_col, text_col=text_col).groupBy("doc").agg(F.collect_set("p").alias("runs"))
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return docs.join(runs, "doc", "left").select("doc", "text", "runs").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)
