"""Licence statements in texts by diagonal voting.

Every rolling pair of words of a text is hashed and joined to the places where a template has the same pair. Pairs of
one template that keep their distance to it lie on one diagonal (text position less template position); a diagonal's
votes are counted, neighbouring diagonals are merged, and groups that hold enough of the template are candidates. A
candidate is verified: its votes must stand in the template's order, within a stretch of the text little longer than
the template. Each vote is verified on the words themselves, so a span holds what it says whatever the hashes do. A text
is read and split once. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.llm.scratch import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels, found wherever their words stand consecutively.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Statements of the method's own, found with up to 30 % of their word pairs missing.
STATEMENTS = [
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("mozilla public license version 2 0", "mpl"),
]
#: Share of a statement's pairs that a span must hold, how far apart diagonals may lie to be merged, and the share of a
#: statement's words by which a span may be longer than it.
SHARE, NEIGHBOUR, LONGER = 0.7, 2, 0.3


def lower_words(text: Column) -> Column:
    # lower() also changes letters beyond A-Z, but never to or from a letter of a template, nor at a word's border
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, phrases: list, statements: list) -> tuple[DataFrame, DataFrame]:
    """(template, label, exact, n) and its word pairs (template, at, ta, tb); their size is that of the lists given."""
    rows = [(i, label, exact, text.split(" ")) for i, (text, label, exact) in enumerate([(*p, True) for p in phrases] + [(*s, False) for s in statements])]
    t = spark.createDataFrame(rows, "template int, label string, exact boolean, twords array<string>").withColumn("n", F.size("twords"))
    return t.drop("twords"), t.select("template", F.posexplode(word_pairs("twords")).alias("at", "x")).select("template", "at", F.col("x.a").alias("ta"), F.col("x.b").alias("tb"))


def word_pairs(words: str) -> Column:
    """array<struct<a,b>> of a column of words."""
    fewer = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, F.lit(1), fewer).alias("a"), F.slice(words, F.lit(2), fewer).alias("b"))


def license_hits(documents: DataFrame, pairs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_words, template, at, diagonal): a row per verified vote, and one per row of documents without a template.

    key is a hash of the whole text. The row of the document itself comes out of the same pass as a pair of nulls, which
    stands for "no words" among the templates' pairs.
    """
    text = F.col(text_col).cast("string")
    # the words are a column, so that they are split once
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), lower_words(text).alias("words"))
    none = F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    grams = docs.select("id", "key", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(none), word_pairs("words"))).alias("pos", "x"))
    grams = grams.select("id", "key", "n_words", "pos", F.col("x.a").alias("a"), F.col("x.b").alias("b")).withColumn("h", F.xxhash64("a", "b"))
    row = pairs.sparkSession.range(1).select(F.lit(None).cast("int").alias("template"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("ta"), F.lit(None).cast("string").alias("tb"))
    known = pairs.unionByName(row).withColumn("h", F.xxhash64("ta", "tb"))
    hits = grams.join(F.broadcast(known), "h").filter(F.col("a").eqNullSafe(F.col("ta")) & F.col("b").eqNullSafe(F.col("tb")))
    return hits.select("id", "key", "n_words", "template", "at", (F.col("pos") - 1 - F.col("at")).alias("diagonal"))


def license_spans(hits: DataFrame, t: DataFrame) -> DataFrame:
    """(id, key, template, label, exact, start, n, share): one row per span in the hits of the templates t.

    A base phrase has one row per place where all its words stand; a statement one row per merged group of diagonals that
    holds a stretch with 70 % of its word pairs in order, the best one. Templates have at least two words;
    they are given in code, so broadcasting them is bounded. Null texts, empty texts and texts of one word have no
    spans. Rows that repeat id and text count once here.
    """
    votes = hits.filter("template IS NOT NULL").groupBy("id", "key", "template", "diagonal").agg(F.collect_set("at").alias("places"))  # of the template, so bounded by its length
    votes = votes.join(F.broadcast(t), "template")
    votes = Scratch(hits.sparkSession).save(votes, "votes")  # read by both kinds of spans
    whole = votes.filter("exact AND size(places) = n - 1").select("id", "key", "template", "label", "exact", F.col("diagonal").alias("start"), "n", F.lit(1.0).alias("share"))

    w = W.partitionBy("id", "key", "template").orderBy("diagonal")
    near = votes.filter("NOT exact").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOUR).cast("int"), F.lit(1)))
    near = near.withColumn("run", F.sum("new").over(w))
    group = ["id", "key", "template", "label", "exact", "n", "run"]
    near = near.select(*group, "diagonal", F.explode("places").alias("at"))
    likely = near.groupBy(*group).agg(F.size(F.collect_set("at")).alias("held")).filter(F.col("held") >= SHARE * (F.col("n") - 1))
    likely = near.join(likely.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("template").alias("t"), F.col("run").alias("r")), F.expr("id <=> i AND key = k AND template = t AND run = r"), "left_semi")
    best = verified_spans(likely.withColumn("pos", F.col("diagonal") + F.col("at")), group, t)
    return whole.unionByName(best.select("id", "key", "template", "label", "exact", "start", "n", "share"))


def verified_spans(votes: DataFrame, group: list[str], t: DataFrame) -> DataFrame:
    """The best stretch of each group of votes (pos in the text, at in the template) of templates of n words.

    From each vote on, the votes within the template's length and LONGER of it are read, and the longest chain among them
    whose places rise in the text and in the template is counted; the largest share counts, then the first start. A stretch
    holds a bounded number of votes, so nothing grows with the text but the number of stretches.
    """
    span = F.col("n") - 2 + F.floor(LONGER * F.col("n")).cast("int")
    # a range frame takes a constant, so the widest of all templates is read and cut to the template's own
    widest = t.agg(F.max(span)).first()[0] or 0
    w = W.partitionBy(*group).orderBy("pos").rangeBetween(0, widest)
    x = votes.withColumn("stretch", F.collect_list(F.struct("pos", "at")).over(w))
    x = x.withColumn("stretch", F.filter("stretch", lambda v: v["pos"] <= F.col("pos") + span))
    x = x.filter(F.size(F.array_distinct(F.transform("stretch", lambda v: v["at"]))) >= SHARE * (F.col("n") - 1))
    # of one place in the text the later places in the template first, so that a chain takes one of them; best[i] is the longest chain that ends at i
    order = F.array_sort(F.transform("stretch", lambda v: F.struct(v["pos"].alias("pos"), (-v["at"]).alias("back"))))
    zero = F.array_repeat(F.lit(0), F.col("n") - 1)
    longer = lambda best, v: F.transform(best, lambda c, i: F.when(i == -v["back"], F.greatest(c, 1 + F.coalesce(F.array_max(F.slice(best, 1, -v["back"])), F.lit(0)))).otherwise(c))
    x = x.withColumn("share", F.array_max(F.aggregate(order, zero, longer)) / (F.col("n") - 1)).filter(F.col("share") >= SHARE)
    return x.groupBy(*group).agg(F.max(F.struct("share", (-F.col("pos")).alias("back"))).alias("x")).select(*group, F.col("x.share").alias("share"), (-F.col("x.back")).alias("start"))


def license_labels(documents: DataFrame, spark: SparkSession, *, phrases: list | None = None, statements: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest starts (null
    without any), labels add those of the statements found; score is the largest share of a template that stands in
    the text. A null or empty text has zero words, no labels and score 0. Repeated rows get equal results, a null
    doc_id is kept. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    t, pairs = templates(spark, PHRASES if phrases is None else phrases, STATEMENTS if statements is None else statements)
    hits = Scratch(spark).save(license_hits(documents, pairs, id_col=id_col, text_col=text_col), "hits", scan=True)
    found = license_spans(hits, t)
    base = F.when(F.col("exact"), F.col("start"))
    found = found.groupBy("id", "key").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    rows = hits.filter("template IS NULL").select("id", "key", "n_words")
    same = rows["id"].eqNullSafe(found["id"]) & (rows["key"] == found["key"])
    return rows.join(found, same, "left").select(
        rows["id"].alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)
