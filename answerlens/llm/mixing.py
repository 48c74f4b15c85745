"""Mixing sources to target weights by entropy balancing.

Document rates are exponentially tilted by size: rate = exp(lambda * size / mean size), with one lambda per source and
``most`` as the largest rate. That is the solution, closest in entropy to taking each document once, of the constraint
that a source's rates times sizes give its target. lambda has no closed form: Newton steps solve the convex dual for all
sources at once, each step a distributed sum of size * rate and of its derivative over the documents (which are summed up
by source and size before). Rates are then rounded into whole copies by running sums. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and so most of a source's words times this.
MOST = 3
#: Mean number of rows that are ranked in one task's group.
CELL = 4096
#: Most Newton steps, the share of a target by which its sum may be off, and the steps that are taken between two writes.
NEWTON_STEPS, CLOSE, UNWRITTEN = 60, 1e-7, 5


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(classes: DataFrame, scratch: Scratch, *, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sid, source, source_size, filled, target) from (source, size, docs): one row per source, null being one too.

    sid is the source's place in code point order, null last; filled counts its documents with words. Targets share all
    words by weight, but stop at ``most`` times the source's words; what is over is shared again by weight until no
    source is above. The level of the shares is a number that a few sums over the sources find, and places come from
    the partitions of a sort, so nothing gathers all sources in one task.
    """
    s = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("docs")).otherwise(0)).alias("filled"))
    s = s.orderBy(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    s = scratch.save(s, "ordered", scan=True)
    before = F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = s.groupBy("p").agg(F.count("*").alias("n")).select("p", before.alias("before"))  # a row per partition of the sort
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = s.join(offsets, "p").withColumn("sid", F.col("before") + F.col("i")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    s = scratch.save(s.select("sid", "source", "source_size", "filled", "weight", "cap"), "sources")

    words, level, full = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, F.lit(False)
    while words:
        got = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        above = (words - got[0]) / got[1]
        if above == level:
            break
        level, full = above, F.lit(above) * F.col("weight") > F.col("cap")
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return scratch.save(s.select("sid", "source", "source_size", "filled", target.alias("target")), "targets")


def rate(size: Column, scale: Column, tilt: Column, most: int = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(tilt * size / scale))


def balance(classes: DataFrame, targets: DataFrame, scratch: Scratch, *, most: int = MOST) -> DataFrame:
    """(sid, tilt): the lambda of each source whose target lies between none and all of ``most`` times its words.

    Newton on the dual, whose gradient is target - sum(size * rate) and whose Hessian is the sum of size * size / mean
    over documents that aren't at ``most``. A step that would leave the interval that is known to hold the root halves
    it instead. Sums are decimals, so they don't depend on the order in which tasks end.
    """
    exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
    scale = F.col("source_size") / F.col("filled")
    state = targets.filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most))
    nothing = F.lit(None).cast("double")
    names = ["sid", "target", "scale", "tilt", "lo", "hi", "done"]
    state = scratch.save(state.select("sid", "target", scale.alias("scale"), F.lit(0.0).alias("tilt"), nothing.alias("lo"), nothing.alias("hi"), F.lit(False).alias("done")), "tilts")
    r, words = rate(F.col("size"), F.col("scale"), F.col("tilt"), most), F.col("docs") * F.col("size")
    slope = F.when(r < most, words * F.col("size") / F.col("scale") * r).otherwise(0.0)
    newton = F.when(F.col("slope") > 0, F.col("tilt") + F.col("gap") / F.col("slope"))
    inside = newton.isNotNull() & (F.abs(newton) < 1e6) & F.coalesce(newton > F.col("lo"), F.lit(True)) & F.coalesce(newton < F.col("hi"), F.lit(True))
    far = F.greatest(F.lit(1.0), F.abs("tilt"))
    other = F.when(F.col("hi").isNull(), F.col("tilt") + far).when(F.col("lo").isNull(), F.col("tilt") - far).otherwise((F.col("lo") + F.col("hi")) / 2)
    for _ in range(NEWTON_STEPS // UNWRITTEN):
        if state.filter("NOT done").isEmpty():
            break
        x, before = state, state
        for _ in range(UNWRITTEN):  # the state goes along as the key of the sums, so that each step reads the classes once
            x = classes.join(x, "sid").groupBy(*names).agg(exact(F.when(~F.col("done"), words * r)).alias("sum"), exact(F.when(~F.col("done"), slope)).alias("slope"))
            x = x.withColumn("gap", F.when(~F.col("done"), F.col("target") - F.col("sum")))
            x = x.withColumn("lo", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("hi")))
            x = x.withColumn("done", F.col("done") | (F.abs("gap") <= CLOSE * F.col("target")))
            x = x.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(other)).select(*names)
        state = scratch.save(x, "tilts")
        scratch.drop(before)
    return state.select("sid", "tilt")


def class_rates(classes: DataFrame, scratch: Scratch, *, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size, docs) with sid, source_size, target, rate and before: the sum of rates of the source's larger documents."""
    targets = source_targets(classes, scratch, weights=weights, most=most)
    t = targets.withColumnRenamed("source", "s")
    at = scratch.save(classes.join(t, classes["source"].eqNullSafe(t["s"])).select("sid", "source", "size", "docs", "source_size", "filled", "target"), "placed")
    tilts = balance(at.select("sid", "size", "docs"), targets, scratch, most=most)
    given = F.when(F.col("tilt").isNotNull(), rate(F.col("size"), F.col("source_size") / F.col("filled"), F.round("tilt", 10), most)).when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    at = at.join(tilts, "sid", "left").withColumn("rate", given)
    larger = W.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)  # over a source's distinct sizes
    before = F.coalesce(F.sum(F.col("docs") * F.col("rate")).over(larger), F.lit(0.0))
    return scratch.save(at.withColumn("before", before).select("sid", "source", "size", "docs", "source_size", "target", "rate", "before"), "rates")


def rank_cells(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (n, hash, sid, size, docs), written, with the cell of about CELL rows that each is ranked in.

    No source and size meets in one task: cells follow the hash, and for a hash that many rows share (repeats of one
    document, which are alike) the row.
    """
    many = rows.groupBy("hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > CELL)
    x = rows.join(many, "hash", "left").withColumn("own", F.when(F.col("copies").isNotNull(), F.col("hash")))
    salt = F.when(F.col("copies").isNull(), F.pmod("hash", F.ceil(F.col("docs") / CELL))).otherwise(F.pmod(F.xxhash64("n"), F.ceil(F.col("copies") / CELL)))
    return scratch.save(x.withColumn("own", F.coalesce("own", F.lit(0))).withColumn("salt", salt).drop("copies"), "cells")


def ranks(x: DataFrame) -> DataFrame:
    """Rows with their cells and ``rank``: a number from 1 to docs inside each (sid, size)."""
    cell = ["sid", "size", "own", "salt"]
    earlier = W.partitionBy("sid", "size").orderBy("own", "salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = x.groupBy(*cell).agg(F.count("*").alias("held")).select(*cell, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    ranked = x.withColumn("place", F.row_number().over(W.partitionBy(*cell).orderBy("hash", "n")))
    return ranked.join(offsets, cell).withColumn("rank", F.col("offset") + F.col("place"))


def mix_sources(documents: DataFrame, *, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Per row of documents: doc_id, size, source_size, target, taken, copies.

    size is the number of words, target the words that its source should give, copies the whole times (0 to ``most``)
    that the mix takes the document and taken its words times those. Documents of a source stand from large to small; a
    document's copies are the whole numbers that the running sum of rates passes, so a source misses its target by
    about half of its largest document at most. Ranks among documents of one size follow a hash of id and text, so
    reruns agree; rows that repeat both are alike. Null ids, repeated rows and ties are ordinary rows, null or empty
    texts have size 0 (and are taken once unless their source has no words: its target is 0 and nothing is taken).
    With ``keep`` the row's own columns, whatever their names, come along as the struct ``row``. An empty table gives no
    rows.
    """
    scratch = Scratch(documents.sparkSession)
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]
    text = F.col(text_col).cast("string")
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("hash"),
        F.monotonically_increasing_id().alias("n"), *([F.struct(*quoted).alias("row")] if keep else []),
    )
    rows = scratch.save(rows, "rows", scan=True)  # so that a row has the same number wherever it is read
    classes = scratch.save(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "classes")
    rates = class_rates(classes, scratch, weights=weights, most=most).withColumnsRenamed({"source": "s", "size": "z"})
    narrow = rows.drop("row").join(rates, rows["source"].eqNullSafe(rates["s"]) & (rows["size"] == rates["z"])).drop("source", "s", "z")
    cells = rank_cells(narrow, scratch)
    ranked = ranks(cells)
    passed = lambda k: F.floor(F.col("before") + (F.col("rank") - k) * F.col("rate") + 0.5)
    copies = F.greatest(F.lit(0), F.least(F.lit(most), passed(0) - passed(1))).cast("int")
    out = ranked.select("n", "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    scratch.keep(cells, rows) if keep else scratch.keep(cells)
    return out.join(rows.select("n", "row"), "n").drop("n") if keep else out.drop("n")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
