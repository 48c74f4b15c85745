"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are single words and word pairs hashed into 2**18 slots, a text's counts divided by the root of their number.
Words are runs of letters, runs of digits or runs of other marks, as written (case and marks tell much about quality).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm import bytehash as bh
from answerlens.llm.scratch import Scratch

BITS = 18
#: Most labelled rows that training reads (those with the smallest hash of their id), and shards it is dealt to.
SAMPLE, SHARDS = 16_384, 8
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.3

_KIND = np.full(256, 3, dtype=np.uint8)  # marks
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words and word pairs of each text, and where a text's begin."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data))
    seen = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
    start, end = start[seen], end[seen]
    word = bh.slice_hash(bh.prefix(data), start, end)
    at = np.searchsorted(start, offsets)
    slots = np.empty(2 * len(word), dtype=np.int64)
    slots[0::2] = (word >> np.uint64(64 - BITS)).astype(np.int64)
    pair = word.copy()
    pair[:-1] += word[1:] * bh._STEP[3]
    last = at[1:][np.diff(at) > 0] - 1
    pair[last] = word[last] + bh._STEP[5]
    slots[1::2] = (bh.mix(pair) >> np.uint64(64 - BITS)).astype(np.int64)
    return slots, 2 * at


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bh.text_bytes(batch.column(2))
        for i, j in bh.chunks(offsets):
            slots, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            each = [np.unique(slots[s:e], return_counts=True) for s, e in zip(at[:-1], at[1:], strict=True)]
            begin = np.concatenate([[0], np.cumsum([len(x) for x, _ in each])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(np.concatenate([*[x[k] for x in each], np.zeros(0, np.int64)]).astype(np.int32))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *lists], ["shard", "label", "slots", "counts"])


def _ftrl(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's weights, by FTRL-proximal updates in a fixed order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        return np.where(np.abs(z[i]) > L1, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    rows = rows.sort_values("turn")
    data = [(np.append(s, 0).astype(np.int64), np.append(c / np.sqrt(max(1, c.sum())), 1.0), y) for s, c, y in zip(rows["slots"], rows["counts"], rows["label"], strict=True)]
    for _ in range(EPOCHS):
        for i, x, y in data:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return pd.DataFrame({"slot": at.astype(np.int32), "w": w[at]})


def train_quality(documents: DataFrame, labels: DataFrame, spark: SparkSession, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights of 2**18 slots (slot 0 holds the bias too), the mean of the shards' models.

    Learns only from labelled rows whose crc32(id as text) modulo 5 is not 0, at most ``sample`` of them, those with
    the smallest hash of their id; of rows that share an id one is read, that with the smallest hash of id and text. Null
    ids, null labels and rows without a document are left out. Without any row all
    weights are 0 and every score is 0.5. The model is 2 MB whatever the input.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL AND crc32(CAST(id AS STRING)) % 5 <> 0")
    lab = lab.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.join(F.broadcast(lab), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("id", "text").alias("turn"), "text", "label")).alias("x")).select("x.*")
    rows = rows.select(F.struct(F.pmod("turn", F.lit(SHARDS)).alias("shard"), "turn").alias("shard"), "label", "text")
    rows = rows.mapInArrow(_train_rows, "shard struct<shard:long,turn:long>, label double, slots array<int>, counts array<int>")
    models = rows.select("shard.*", "label", "slots", "counts").groupBy("shard").applyInPandas(_ftrl, "slot int, w double")
    parts = Scratch(spark).save(models.groupBy("slot").agg((F.sum("w") / SHARDS).alias("w")), "weights")
    out = np.zeros(1 << BITS)
    for r in parts.toLocalIterator():
        out[r.slot] = r.w
    return out


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            data, offsets = bh.text_bytes(batch.column(1))
            scores = np.zeros(len(offsets) - 1)
            for i, j in bh.chunks(offsets):
                slots, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sums = np.concatenate([[0.0], np.cumsum(weights[slots])])
                scores[i:j] = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(1, np.diff(at))) + weights[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(scores, -30, 30))), 9))], ["row", "score"])

    return run


def score_quality(documents: DataFrame, weights: np.ndarray, spark: SparkSession, *, text_col: str = "text", score_col: str = "score", columns: list[str] | None = None) -> DataFrame:
    """documents (or only ``columns`` of it) with ``score_col``: the chance (0 to 1) that a text has label 1.

    The whole text is scored. Null and empty texts get the bias alone. No row moves and other columns stay as they are; a
    column of documents named as ``score_col`` is replaced. Repeated rows score alike; an empty table gives no rows.
    """
    kept = [c for c in columns or documents.columns if c.lower() != score_col.lower()]
    row = F.struct(F.lit(0).alias("__"), *[F.col("`" + c.replace("`", "``") + "`") for c in kept])
    schema = documents.select(row.alias("row"), F.lit(0.0).alias("score")).schema
    scored = documents.select(row.alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(_score(spark.sparkContext.broadcast(weights)), schema)
    return scored.select("row.*", F.col("score").alias(score_col)).drop("__")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark)
    scored = score_quality(docs, weights, spark, columns=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
