"""Rules over answer texts: which fail, how badly, and how to mend them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions import text as T


def run_rules(answers: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """answers with ``failed``: names of the rules that don't hold, in order; a rule that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return answers.withColumn("failed", failed)


def severity(failed: Column, critical: list[str]) -> Column:
    return F.when(F.arrays_overlap(failed, F.array(*[F.lit(c) for c in critical])), "fail").when(F.size(failed) > 0, "weak").otherwise("pass")


def first_repair(failed: Column, paths: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in paths.items() for x in kv])
    return F.get(F.array_compact(F.transform(failed, lambda x: m[x])), F.lit(0))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, repeated): how many different lines stand more than once in a text; a row operation, nothing moves."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.normal_line), lambda x: x != "")
    x = documents.select("doc_id", F.posexplode(lines).alias("pos", "line")).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n > 1")
    return x.groupBy("doc_id").agg(F.count("*").alias("repeated"))


def clean(c: Column, scaffold: str) -> Column:
    """Text without scaffold lines and runs of blank lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?m)" + scaffold, ""), "\n{2,}", "\n"))


def repeated_sentences(documents: DataFrame, at_least: int = 3, longest_short: int = 20) -> DataFrame:
    s = documents.select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")).filter(F.length("sentence") > longest_short)
    return s.groupBy("doc_id", "sentence").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
