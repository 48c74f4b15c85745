"""Corpus cleaning: the training-data operators chained over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.decontaminate import drop_contaminated
from answerlens.llm.minhash import minhash_near_duplicates
from answerlens.llm.mixing import mix_sources
from answerlens.llm.pii import mask_pii
from answerlens.llm.quality import THRESHOLD, score_quality, train_quality
from answerlens.llm.scratch import Scratch

#: No SQL: a trained classifier and the rounding of rates aren't expressible. Tests compare run() with its stages chained, not
#: with a brute force of the whole run; near_dedup has planted groups, op1, op3, op4 and op9 have tests of their own.
ORACLE_SQL = None


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, trained on the labelled ones among them, scores at 0.3 or more."""
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark)
    return _columns(score_quality(docs, weights, spark, score_col="__score").filter(F.col("__score") >= THRESHOLD), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest doc_id.

    A null doc_id comes after all others; of rows that share the doc_id (or have none) that with the smallest hash of
    its text stays. So repeated rows go down to one, and rows without an id go where a copy of them stays. Rows that
    share a doc_id but not their text are documents of their own. Texts without words are never near-duplicates: all
    of their rows stay.
    """
    # written, so that a row has the same number wherever it is read
    rows = Scratch(spark).save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", scan=True)
    groups = minhash_near_duplicates(rows, spark, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct("no_id", "doc_id", "hash", "__row")
    names = rows.select("__row", "doc_id", F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("hash"))
    kept = names.join(groups, "__row").groupBy("component_id").agg(F.min(order).alias("x")).select("x.__row")
    return _columns(rows.join(kept, "__row", "left_semi"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind in place of personal data; n_chars follows the new text."""
    return _columns(mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the document's columns, copy from 1, copies, and its source's figures.

    Columns of docs with the names of those five are replaced.
    """
    figures = ["copy", "copies", "size", "source_size", "target"]
    mixed = mix_sources(docs, keep=True).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = ["row.`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() not in figures]
    return mixed.select(*[F.col(c) for c in kept], *figures)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name, scan=True)
    return STAGES[-1][1](spark, docs, sf_dir)
