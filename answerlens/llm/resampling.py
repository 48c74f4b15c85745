"""Importance resampling towards a target distribution of hashed word n-grams, with CRCs computed as matrices.

The buckets are CRC-32 values of the features' bytes. A chunk of texts is written as words with one space between them, so
that each run of one to three words is a slice of bytes; its distinct features are grouped by length into matrices of
bytes, one feature a row, and the CRCs of a whole group advance together, column by column. The buckets are then
scattered back to the places where the features stand.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.llm import bytehash as bh
from answerlens.llm.scratch import Scratch

BUCKETS, LONGEST, MIN_WORDS, SEED = 10_000, 3, 20, 42
#: Documents drawn, in hundredths of those with at least MIN_WORDS words.
DRAWN = 5
#: Bytes of text that are turned into matrices at a time, and the length beyond which features go one by one.
CHUNK, WIDE = 1 << 18, 128

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc_of_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, all rows advancing by one column at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc_of_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start : start + size], by matrices of equal size; slices of over WIDE bytes are few and go one by one."""
    out = np.empty(len(start), dtype=np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, group in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if length > WIDE:
            out[group] = [zlib.crc32(data[s : s + length]) for s in start[group].tolist()]
        elif length:
            out[group] = crc_of_rows(np.lib.stride_tricks.sliding_window_view(data, length)[start[group]])
        else:
            out[group] = 0
    return out


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words with one byte of space after each, where each word starts and ends, and each row's first word."""
    data = bh.LOWER[data]
    start, end = bh.runs(_WORD[data], offsets)
    size = end - start
    new = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(new[-1], 0x20, dtype=np.uint8)
    inside = np.ones(new[-1], dtype=bool)
    inside[new[1:] - 1] = False
    out[inside] = data[_WORD[data]]
    return out, new[:-1], new[:-1] + size, np.searchsorted(start, offsets)


def buckets_of(data: np.ndarray, offsets: np.ndarray, *, buckets: int = BUCKETS, longest: int = LONGEST, seen: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a chunk of texts, the text of each feature, and the number of words of each text.

    Features that end within the first ``seen`` words are left out: an earlier block had them.
    """
    text, start, end, at = plain_words(data, offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first, last, rows = [], [], []
    for k in range(longest):
        whole = np.flatnonzero(row[: len(row) - k] == row[k:]) if len(row) > k else np.zeros(0, np.int64)
        whole = whole[whole + k >= seen]
        first.append(start[whole])
        last.append(end[whole + k])
        rows.append(row[whole])
    first, last, rows = (np.concatenate(x) for x in (first, last, rows))
    # distinct features: equal by two independent hashes of their bytes
    sums = [bh.prefix(text), bh.prefix(text ^ np.uint8(0x5A))]
    one, two = (bh.slice_hash(s, first, last) for s in sums)
    order = np.lexsort((two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    kept = order[new]
    found = crc_of_slices(text, first[kept], last[kept] - first[kept]) % np.uint32(buckets)
    return found[place].astype(np.int64), rows, np.diff(at)


def batch_buckets(data: np.ndarray, offsets: np.ndarray, *, buckets: int, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, buckets, row of each, words per row) of rows i to j; a longer text comes in several blocks of its words."""
    for i, j in bh.chunks(offsets, CHUNK):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) <= CHUNK:
            yield i, j, *buckets_of(part, at, buckets=buckets, longest=longest)
            continue
        start, end = bh.runs(_WORD[bh.LOWER[part]], at)
        a = 0
        while a < len(start):
            again = max(0, a - longest + 1)  # the features that cross the border of two blocks
            b = max(a + 1, int(np.searchsorted(start, start[again] + CHUNK)))
            block = part[start[again] : end[b - 1]]
            found, rows, _ = buckets_of(block, np.array([0, len(block)]), buckets=buckets, longest=longest, seen=a - again)
            yield i, j, found, rows, np.array([b - a])
            a = b


def _count(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, found, _, _ in batch_buckets(*bh.text_bytes(batch.column(0)), buckets=buckets, longest=longest):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts per bucket: tasks return one row per bucket, which are summed before the driver reads ``buckets`` rows."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's smoothed share in the target over that in the raw texts, rounded down."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _weigh(held, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = held.value
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for i, j, found, rows, n in batch_buckets(*bh.text_bytes(batch.column(1)), buckets=len(gains), longest=longest):
                words[i:j] += n
                features[i:j] += np.bincount(rows, minlength=j - i)
                weight[i:j] += np.rint(np.bincount(rows, weights=gains[found], minlength=j - i)).astype(np.int64)  # whole numbers below 2**53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "words", "n_features", "weight"])

    return run


def importance_resample(documents: DataFrame, target: DataFrame, spark: SparkSession, *, drawn: int = DRAWN, seed: int = SEED, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_features, weight, score, rank (1, 2, ... of the rows drawn, else null).

    weight sums the gains of a document's features, repeats counted, over the whole text; score adds Gumbel noise that
    follows seed and doc_id, so the highest scores are a draw without replacement by weight. ``drawn`` hundredths
    (rounded down) of the documents with at least ``min_words`` words are drawn, ties go to the smaller doc_id. Texts
    are read twice (to count buckets and to score), nothing but one narrow row per document is shuffled, and ranks come
    from a sort by ranges with a running count over its partitions, so no task ranks everything.

    Null and empty texts have no features and weight 0; a null doc_id draws as the empty string and stands after the other ids
    in ties. Rows that repeat a doc_id have equal noise; rows that repeat the text too are alike and any of them may
    stand first. With an empty target the gains only compare to the uniform distribution. Other columns are ignored,
    whatever their names; empty documents give no rows.
    """
    scratch = Scratch(spark)
    gains = bucket_gains(bucket_counts(documents, text_col=text_col, buckets=buckets, longest=longest), bucket_counts(target, text_col=target_text_col, buckets=buckets, longest=longest))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = docs.mapInArrow(_weigh(spark.sparkContext.broadcast(gains), longest), "doc_id long, words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    x = x.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("words") >= min_words).alias("long_enough"), F.monotonically_increasing_id().alias("n"))
    scores = scratch.save(x, "scores", scan=True)
    x = scores.orderBy(F.desc("long_enough"), F.desc("score"), F.asc_nulls_last("doc_id"), "n")
    x = x.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    x = scratch.save(x, "ordered", scan=True)
    before = F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = x.groupBy("p").agg(F.count("*").alias("n")).select("p", before.alias("before"))  # a row per partition of the sort
    take = drawn * (scores.agg(F.sum(F.col("long_enough").cast("long"))).first()[0] or 0) // 100
    scratch.keep(x)
    rank = F.col("before") + F.col("i") + 1
    return x.join(offsets, "p").select("doc_id", "n_features", "weight", "score", F.when(rank <= take, rank).alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)
