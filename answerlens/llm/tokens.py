"""Token counts of a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic programming keeps, per
position, only the best score and the number of pieces. Ties are settled as the tokenizer settles them: starts are
tried from left to right and a later one must be strictly better. No piece crosses the border before a word mark, so
words are counted one by one and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Fixed value: how far the score of an unknown character lies below the smallest score.
UNKNOWN_PENALTY = 10.0
MEMO = 200_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class UnigramCounter:
    """(pieces, score) of texts under a list of (piece, score); unknown characters count as their UTF-8 bytes."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        if len(self.machine):
            self.machine.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        known = {c for p, _ in vocabulary for c in p}
        crossing = any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        alone = "\n" not in known
        self.parts = None if crossing else re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo: dict[str, tuple[int, float]] = {}

    def _walk(self, text: str) -> tuple[int, float]:
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        ends = iter(self.machine.iter(text)) if len(self.machine) else iter(())
        ahead = next(ends, None)
        for i in range(n):
            top, pieces, single = None, 0, False
            while ahead is not None and ahead[0] == i:  # longest piece first: its start lies furthest left
                size, score = ahead[1]
                single |= size == 1
                s = best[i + 1 - size] + score
                if top is None or s > top:
                    top, pieces = s, count[i + 1 - size] + 1
                ahead = next(ends, None)
            if not single:
                s = best[i] + self.unknown
                if top is None or s > top:
                    top, pieces = s, count[i] + len(text[i].encode("utf-8", "surrogatepass"))
            best[i + 1], count[i + 1] = top, pieces
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if self.parts is None:
            return self._walk(text)
        memo, n, score = self.memo, 0, 0.0
        for part in self.parts.findall(text):
            got = memo.get(part)
            if got is None:
                got = self._walk(part)
                if len(part) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[part] = got
            n += got[0]
            score += got[1]
        return n, score


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file; control, unknown and byte pieces never match text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


def _counter(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or UnigramCounter(held.value)
            found = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["row", "n_tokens", "score"])

    return run


def token_counts(documents: DataFrame, spark: SparkSession, *, vocabulary: list[tuple[str, float]] | None = None, model: str = DEFAULT_MODEL, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """documents (or only ``columns``) with n_tokens and token_score of the best segmentation of each whole text.

    A space is written as the word mark and the text begins with one; nothing else is normalised. Characters outside
    the vocabulary are as many pieces as they have bytes. Null and empty texts have 0 tokens. Rows are independent of
    each other and none moves. The vocabulary (by default that of ``model``, read on the driver) is broadcast: its
    size is that of a tokenizer. Columns of documents named n_tokens or token_score are replaced; an empty table gives no
    rows.
    """
    held = spark.sparkContext.broadcast(vocabulary if vocabulary is not None else load_vocabulary(model))
    kept = [c for c in columns or documents.columns if c.lower() not in ("n_tokens", "token_score")]
    row = F.struct(F.lit(0).alias("__"), *[F.col("`" + c.replace("`", "``") + "`") for c in kept])
    schema = documents.select(row.alias("row"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("score")).schema
    out = documents.select(row.alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(_counter(held), schema)
    return out.select("row.*", "n_tokens", F.col("score").alias("token_score")).drop("__")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark, columns=["doc_id"])
