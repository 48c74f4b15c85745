"""Filter interaction audit: what each of five quality filters removes, in every order of applying them.

A document becomes a mask of the filters that it fails; masks are counted per part of the corpus, and only these cells, at
most 32 a part, are audited. A recursive CTE starts with the empty prefix of each part and extends prefixes by every
unused letter: each level joins the part's mask cells again, carries the bits applied so far and emits that step's
figures. DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: The filters in bit order: A few words, B repeated words, C capitals, D marks, E copies of an earlier text.
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 200, 50, 2, "[#$%&*|]"

#: A level's figures over a part's cells; {before} are the bits applied earlier, l.bit is the bit of this step.
_SUM = "aggregate(filter(c.cells, x -> {where}), 0L, (s, x) -> s + x.{what})"
_HERE = "x.mask & {before} = 0 AND x.mask & l.bit <> 0"
_FIGURES = {
    "kept": ("x.mask & ({before} | l.bit) = 0", "n"), "removed": (_HERE, "n"), "redundant": ("x.mask & {before} <> 0 AND x.mask & l.bit <> 0", "n"),
    "unique_fails": ("x.mask = l.bit", "n"), "good_lost": (_HERE, "good"), "toxic_lost": (_HERE, "toxic"),
}


def failed_filters(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask): the bits of A to D, and a digest by which equal texts meet. One scan of the texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    x = x.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))  # a column, so that words are split once
    words = F.size("words")
    fails = [
        words < MIN_WORDS, 100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_SHARE * words,
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITAL_SHARE * F.length("text"), F.col("text").rlike(MARKS),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return x.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_cells(failed: DataFrame, labels: DataFrame, scratch: Scratch, *, id_col: str = "doc_id") -> DataFrame:
    """(part, cells): per part its masks with the number of documents, of good and of toxic ones; at most 32 entries each.

    E is decided on counts: of the rows that share a text, all fail it except those with the smallest doc_id, so copies
    are summed up by text, part and label first and a text with many copies is a few rows when its parts meet.
    """
    ones = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(ones("quality").alias("good"), ones("toxic").alias("toxic")).filter("doc_id IS NOT NULL AND good + toxic > 0")
    rows = failed.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("copies"))
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    named = rows.filter("doc_id IS NOT NULL").groupBy(*kind).agg(F.sum("copies").alias("n"), F.min(F.struct("doc_id", "copies")).alias("first"))
    named = scratch.save(named, "copies")
    lowest = named.groupBy("digest").agg(F.min("first.doc_id").alias("low"))
    first = F.when(F.col("first.doc_id") == F.col("low"), F.col("first.copies")).otherwise(0)
    named = named.join(lowest, "digest").select(*kind, F.explode(F.array(F.struct(first.alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") - first).alias("n"), F.lit(16).alias("e")))).alias("x"))
    named = named.select("part", F.col("mask").bitwiseOR(F.col("x.e")).alias("mask"), "good", "toxic", "x.n")
    nameless = rows.filter("doc_id IS NULL").select("part", "mask", "good", "toxic", F.col("copies").alias("n"))
    cells = named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def prefix_steps(cells: DataFrame, scratch: Scratch, *, letters: str = LETTERS) -> DataFrame:
    """(part, prefix, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of each prefix of each order.

    The recursion is written while the session's limit on recursive rows is lifted: it has 325 rows a part, each of which is
    part of the result, and stops by itself after as many levels as letters.
    """
    spark, before = cells.sparkSession, "(p.before | p.bit)"
    figures = {k: _SUM.format(where=where.format(before=before), what=what) for k, (where, what) in _FIGURES.items()}
    unused = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters)) + ")"
    query = f"""
WITH RECURSIVE steps(part, prefix, step, before, bit, letter, {', '.join(figures)}) AS (
  SELECT part, '', 0, 0, 0, '', {', '.join('0L' for _ in figures)} FROM {{cells}}
  UNION ALL
  SELECT p.part, concat(p.prefix, l.letter), p.step + 1, {before}, l.bit, l.letter, {', '.join(figures.values())}
  FROM steps p JOIN {{cells}} c ON c.part = p.part LATERAL VIEW explode({unused}) e AS l
  WHERE {before} & l.bit = 0
)
SELECT part, prefix, step, letter, {', '.join(figures)} FROM steps WHERE step > 0"""
    limit = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return scratch.save(spark.sql(query, cells=cells), "steps")
    finally:
        spark.conf.set(limit, old)


def order_steps(steps: DataFrame, *, letters: str = LETTERS) -> DataFrame:
    """The steps of every whole order: a prefix's figures serve all orders that begin with it. Adds filter_order and shapley."""
    spark, n = steps.sparkSession, len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    prefixes = spark.createDataFrame([(o[:k], o) for o in orders for k in range(1, n + 1)], "prefix string, filter_order string")  # n! * n rows
    ways = F.element_at(F.array(*[F.lit(math.factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    shapley = F.sum(F.col("removed") * ways).over(W.partitionBy("part", "letter"))  # over the 65 prefixes that end with the letter
    return steps.withColumn("shapley", shapley).join(F.broadcast(prefixes), "prefix")


def filter_audit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter_order and step (600 a part): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, and empty texts fail A (and B, C, D not); a null part is the empty string's. Of rows with
    equal texts those with the smallest doc_id pass E, so rows that repeat both pass or fail together; a row without a
    doc_id passes E, has no labels and makes nobody a copy. Labels with several rows of an id count if any row is 1;
    labels without a document count nowhere. Texts are compared by SHA-256 and read once. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession)
    failed = scratch.save(failed_filters(documents, id_col=id_col, text_col=text_col, part_col=part_col), "failed", scan=True)
    cells = scratch.save(mask_cells(failed, labels, scratch, id_col=id_col), "cells")
    steps = prefix_steps(cells, scratch)
    scratch.keep(steps)
    out = order_steps(steps)
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
