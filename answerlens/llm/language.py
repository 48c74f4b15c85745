"""Language identification with bit-sliced Bloom filters of character n-grams.

Every learned language has a Bloom filter of its characteristic n-grams, and the filters are stored sliced: one row of bits
per slot, one bit per language. The rows at the slots of an n-gram, combined by AND, name all languages that contain it at
once. A text's n-grams are counted per language from these masks; the share that a filter lets through by chance is known
from how full it is and is taken off, and the language with the largest corrected share decides.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.llm import bytehash as bh
from answerlens.llm.scratch import Scratch

#: Lengths of the n-grams in characters; a word's borders count as characters.
SIZES = (1, 2, 3, 4, 5)
#: Slots of a filter as a power of two, and slots of an n-gram: disjoint bits of its 64-bit hash.
SLOT_BITS, HASHES = 21, 3
#: Most training rows of a language (those with the smallest hash of id and text).
SAMPLE = 4_096
#: An n-gram belongs to a language where its share of texts is at least this part of that in the language that has most.
CHARACTERISTIC = 0.25
UNKNOWN = "und"


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point 2 for letters, 1 for marks that stand with letters, 0 for all else."""
    return np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), dtype=np.uint8)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points with 32 for all that isn't part of a word, one 32 before and after each row; where rows begin; whether a row has a letter."""
    parts, space = [], np.full(1, 32, dtype=np.uint32)
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        text = data[i:j].tobytes().decode("utf-8", "replace").lower()
        parts += [space, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts[1::2]])]).astype(np.int64)
    codes = np.concatenate([*parts, space])
    kind = _kinds()[codes]
    codes[kind == 0] = 32
    letters = np.concatenate([[0], np.cumsum(kind == 2)])
    return codes, at, letters[at[1:]] > letters[at[:-1]]


def ngrams(codes: np.ndarray, at: np.ndarray, sizes: tuple = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams inside words (with their borders) and the row of each."""
    word = codes != 32
    wide = codes.astype(np.uint64)
    grams, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in sizes:
        m = max(0, len(codes) - n + 1)
        inside = word[:m].copy() if n == 1 else word[:m] | word[1 : m + 1] if n == 2 else np.ones(m, dtype=bool)
        for k in range(1, n - 1):
            inside &= word[k : k + m]
        start = np.flatnonzero(inside)
        grams.append(bh.mix(sum((wide[start + k] * bh._STEP[k] for k in range(n)), np.zeros(len(start), np.uint64)) + np.uint64(n)))
        where.append(start)
    return np.concatenate(grams), np.searchsorted(at, np.concatenate(where), side="right") - 1


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) of rows i to j; a long text comes in several pieces, cut at a space where one is near."""
    for i, j in bh.chunks(offsets, 1 << 18):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) <= 1 << 20:
            yield i, j, part, at
            continue
        a = 0
        while a < len(part):
            b = min(len(part), a + (1 << 20))
            if b < len(part):
                gaps = np.flatnonzero(part[b - 4096 : b] == 32)
                b = b - 4096 + int(gaps[-1]) if len(gaps) else b
                while b > a + 1 and part[b] & 0xC0 == 0x80:  # not inside a character
                    b -= 1
            yield i, j, part[a:b], np.array([0, b - a])
            a = b


def _train_rows(sizes: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            langs = batch.column(0).to_pylist()
            data, offsets = bh.text_bytes(batch.column(1))
            for r, lang in enumerate(langs):
                own = [ngrams(*characters(x, at)[:2], sizes)[0] for *_, x, at in _pieces(data[offsets[r] : offsets[r + 1]], offsets[r : r + 2] - offsets[r])]
                found.setdefault(lang, []).append(np.unique(np.concatenate(own)))
            for lang, lists in found.items():
                gram, texts = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(texts.astype(np.int64))], ["lang", "gram", "texts"])

    return run


@dataclass
class LanguageFilters:
    """languages in order; table[slot] holds a bit per language; chance[l] is what language l's filter lets through of all else."""

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray
    sizes: tuple = SIZES
    hashes: int = HASHES

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Bytes of bits per n-gram: the languages that contain it."""
        bits = (len(self.table) - 1).bit_length()
        out = None
        for k in range(self.hashes):
            slot = ((grams >> np.uint64(bits * k)) & np.uint64(len(self.table) - 1)).astype(np.int64)
            out = self.table[slot] if out is None else out & self.table[slot]
        return out

    def hits(self, grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Per row and language, the n-grams whose mask has the language's bit."""
        masks = self.masks(grams)
        bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
        counts = [np.bincount(row * 256 + masks[:, b], minlength=rows * 256).reshape(rows, 256) @ bit for b in range(masks.shape[1])]
        return np.concatenate(counts, axis=1)[:, : len(self.languages)]

    def shares(self, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Share of a text's n-grams that a language contains, without those let through by chance."""
        n = np.maximum(n, 1)[:, None]
        return np.clip((hits - n * self.chance) / (n * np.maximum(1 - self.chance, 1e-9)), 0.0, 1.0)


def train_languages(documents: DataFrame, spark: SparkSession, *, sample: int = SAMPLE, sizes: tuple = SIZES, slot_bits: int = SLOT_BITS, characteristic: float = CHARACTERISTIC, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Filters learned from the rows whose language isn't null and whose crc32(id as text) modulo 3 isn't 1.

    At most ``sample`` different rows of a language are read, those with the smallest hash of id and text; rows that
    repeat one of them count with it. Null ids aren't learned from, null texts teach no n-gram. An n-gram goes into a
    language's filter if at least 1 in 1,000 of its rows (and one) have it, and their share is ``characteristic`` of the
    largest share in any language or more. The filters take 2**slot_bits bytes for every eight languages, whatever the
    input, and only they and a row per language reach the driver.
    """
    scratch = Scratch(spark)
    rows = documents.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND id IS NOT NULL AND crc32(CAST(CAST(id AS STRING) AS BINARY)) % 3 <> 1").withColumn("hash", F.xxhash64("id", "text"))
    first = rows.select("lang", "hash").distinct().withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("hash"))).filter(F.col("place") <= sample)
    cuts = scratch.save(first.groupBy("lang").agg(F.max("hash").alias("cut")), "cuts")  # a row per language
    taught = rows.join(cuts, "lang").filter("hash <= cut").select("lang", "text")
    counts = taught.mapInArrow(_train_rows(sizes), "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    sizes_of = taught.groupBy("lang").agg(F.count("*").alias("rows"))
    langs = [(r.lang, r.rows) for r in sizes_of.orderBy("lang").collect()]
    numbers = spark.createDataFrame([(name, n, i) for i, (name, n) in enumerate(langs)], "lang string, rows long, number int")
    share = F.col("texts") / F.col("rows")
    best = F.max(share).over(W.partitionBy("gram"))  # a row per language that has it
    kept = counts.join(numbers, "lang").withColumn("best", best).filter((share >= characteristic * F.col("best")) & (F.col("texts") >= 1 + F.floor(F.col("rows") / 1000)))
    slots = F.explode(F.array(*[F.shiftrightunsigned("gram", slot_bits * k).bitwiseAND((1 << slot_bits) - 1) for k in range(HASHES)]))
    # eight slots of one byte each make a number
    bits = kept.select(F.shiftright("number", 3).alias("byte"), (F.col("number") % 8).alias("bit"), slots.alias("slot"))
    packed = F.expr("bit_or(shiftleft(1L, CAST((slot & 7) * 8 + bit AS INT)))")
    found = scratch.save(bits.groupBy("byte", F.shiftright("slot", 3).alias("word")).agg(packed.alias("bits")), "filters")
    table = np.zeros((max(1, -(-len(langs) // 8)), 1 << (slot_bits - 3)), dtype=np.int64)
    for b in found.toArrow().to_batches():
        table[b.column("byte").to_numpy(), b.column("word").to_numpy()] = b.column("bits").to_numpy()
    scratch.close()
    table = np.ascontiguousarray(table.view(np.uint8).reshape(len(table), 1 << slot_bits).T)
    full = np.array([((table[:, i >> 3] >> (i & 7)) & 1).mean() for i in range(len(langs))])
    return LanguageFilters([name for name, _ in langs], table, full**HASHES, sizes)


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageFilters = held.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in batches:
            rows = batch.num_rows
            hits, n, letter = np.zeros((rows, len(model.languages))), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=bool)
            for i, j, part, offsets in _pieces(*bh.text_bytes(batch.column(1))):
                codes, at, has = characters(part, offsets)
                grams, row = ngrams(codes, at, model.sizes)
                hits[i:j] += model.hits(grams, row, j - i)
                n[i:j] += np.bincount(row, minlength=j - i)
                letter[i:j] |= has
            choice, score = np.full(rows, len(model.languages)), np.zeros(rows)
            if model.languages:
                shares = model.shares(hits, n)
                best = shares.argmax(axis=1)
                choice[letter] = best[letter]
                score = np.where(letter, shares[np.arange(rows), best] / np.maximum(shares.sum(axis=1), 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(choice)), pa.array(np.round(score, 9))], ["row", "lang_pred", "score"])

    return run


def predict_language(documents: DataFrame, model: LanguageFilters, spark: SparkSession, *, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """documents (or only ``columns`` of it) with lang_pred and score (0 to 1): the best language's part of all shares.

    Whole texts are read. ``und`` with score 0 stands for null texts and texts without a letter, and for all where nothing
    was learned. Of equal shares the first language in code point order wins; a text of unknown letters gets it too, with
    score 0. No row moves; columns named lang_pred or score are replaced, repeated rows are alike, an empty table gives
    no rows.
    """
    kept = [c for c in columns or documents.columns if c.lower() not in ("lang_pred", "score")]
    row = F.struct(F.lit(0).alias("__"), *[F.col("`" + c.replace("`", "``") + "`") for c in kept])
    schema = documents.select(row.alias("row"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    out = documents.select(row.alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)
    return out.select("row.*", "lang_pred", "score").drop("__")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    predicted = predict_language(docs, train_languages(docs, spark), spark, columns=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
