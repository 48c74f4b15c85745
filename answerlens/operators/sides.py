"""Lines of evidence told apart for the two sides of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions import text as T

# How alike two scores must be for a shared line, lines that a side keeps, chunks of a side, terms that name a side.
SHARED_RATIO, LINES, CHUNKS, NAMES = 0.6, 8, 4, 6
# The least score of a side's best chunk, and the core lines that two sides are told apart by.
SUPPORT, TOLD = 0.15, 3


def hits_of(low: Column, words: Column, term: Column) -> Column:
    """How often a lower-case term stands in a text as a word; a phrase with a space counts once at most, single letters never."""
    often = F.size(F.filter(words, lambda w: w == term))
    marked = F.regexp_count(low, F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b")))
    return F.when(F.length(term) < 2, 0).when(F.contains(term, F.lit(" ")), F.contains(low, term).cast("int")).when(term.rlike(r"^[\p{L}\p{N}\p{M}_]+$"), often).otherwise(marked)


def _score(low: Column, words: Column, terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda s, t: s + hits_of(low, words, t))


def side_chunks(scored: DataFrame, pairs: DataFrame, most: int = CHUNKS) -> DataFrame:
    """(key, side, id, rank): the best chunks of each side of a pair, by its concept's score, ties by id.

    scored is (query_id, id, concept_id, score), pairs (key, a, b) the concepts of the sides.
    """
    sides = pairs.select("key", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("concept_id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("concept_id")))).alias("x")).select("key", "x.*")
    x = scored.select(F.col("query_id").alias("key"), "id", "concept_id", "score").join(sides, ["key", "concept_id"])
    rank = F.row_number().over(W.partitionBy("key", "side").orderBy(F.desc("score"), "id"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= most).select("key", "side", "id", "rank")


def unit_rows(chosen: DataFrame, chunks: DataFrame, text: str = "source_excerpt") -> DataFrame:
    """(key, side, rank, pos, unit): all units of the chosen chunks, whose texts alone are read."""
    units = chunks.join(chosen.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(T.units(F.col(text))).alias("pos", "unit"))
    return chosen.join(units, "id").select("key", "side", "rank", "pos", "unit")


def line_labels(units: DataFrame, terms: DataFrame, ratio: float = SHARED_RATIO) -> DataFrame:
    """units with label: a, b, shared, forbidden_a, forbidden_b or skip; both term sets are counted in one pass.

    terms is (key, a, b, not_a, not_b), arrays of lower-case terms in order; null arrays hold nothing. A unit is shared
    when both sides score and the smaller score is ``ratio`` of the larger or more, and no forbidden term stands in it;
    else it is the larger side's unless that side forbids it; a tie with a difference of nothing to tell is skipped.
    """
    none = F.array().cast("array<string>")
    x = units.join(terms.select("key", *[F.coalesce(c, none).alias(c) for c in ("a", "b", "not_a", "not_b")]), "key")
    x = x.withColumn("low", F.lower("unit")).withColumn("words", F.regexp_extract_all("low", F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)))
    low, words = F.col("low"), F.col("words")
    x = x.withColumn("sa", _score(low, words, F.col("a"))).withColumn("sb", _score(low, words, F.col("b")))
    bad = lambda c: F.filter(c, lambda t: hits_of(low, words, t) > 0)
    x = x.withColumn("bad_a", bad("not_a")).withColumn("bad_b", bad("not_b"))
    sa, sb, fine_a, fine_b = F.col("sa"), F.col("sb"), F.size("bad_a") == 0, F.size("bad_b") == 0
    alike = F.least(sa, sb) >= ratio * F.greatest(sa, sb)
    label = (
        F.when((sa >= 1) & (sb >= 1) & fine_a & fine_b & alike, "shared").when((sa >= 1) & (sa > sb) & fine_a, "a").when((sb >= 1) & (sb > sa) & fine_b, "b")
        .when(~fine_a & (sa > 0), "forbidden_a").when(~fine_b & (sb > 0), "forbidden_b").otherwise("skip")
    )
    return x.withColumn("label", label)


def line_sides(units: DataFrame, terms: DataFrame, *, ratio: float = SHARED_RATIO, most: int = LINES) -> DataFrame:
    """(key, side, kind, place, line): core lines of each side, shared lines (side both), forbidden terms that a side met.

    A side's own units, each text once, stand by its chunks' rank; the first that names one of the side's first six terms
    comes to the front, and ``most`` are kept. Shared lines are those of a's chunks, then of b's, each once. Of a
    forbidden unit the first term of its side's list counts. Equal texts are told by their lower-case trimmed form.
    """
    x = line_labels(units, terms, ratio)
    at = F.struct("rank", "pos", "unit")
    core = x.filter("label = side").withColumn("names", F.slice(F.when(F.col("side") == "a", F.col("a")).otherwise(F.col("b")), 1, NAMES))
    core = core.withColumn("named", F.exists("names", lambda t: hits_of(F.col("low"), F.col("words"), t) > 0))
    core = core.groupBy("key", "side", F.trim("low").alias("line")).agg(F.min(at).alias("at"), F.max("named").alias("named"))
    own = W.partitionBy("key", "side").orderBy("at")
    core = core.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= most)
    lead = F.min(F.when(F.col("named"), F.col("place"))).over(W.partitionBy("key", "side"))
    order = F.coalesce(F.col("place") != lead, F.lit(True))
    core = core.withColumn("order", order)
    core = core.select("key", "side", F.lit("core").alias("kind"), F.row_number().over(W.partitionBy("key", "side").orderBy("order", "place")).alias("place"), F.trim("at.unit").alias("line"))

    shared = x.filter("label = 'shared'").groupBy("key", F.trim("low").alias("line")).agg(F.min(F.struct("side", "rank", "pos", "unit")).alias("at"))
    shared = shared.select("key", F.lit("both").alias("side"), F.lit("shared").alias("kind"), F.row_number().over(W.partitionBy("key").orderBy("at")).alias("place"), F.trim("at.unit").alias("line"))

    met = x.filter("label = concat('forbidden_', side)").withColumn("term", F.get(F.when(F.col("side") == "a", F.col("bad_a")).otherwise(F.col("bad_b")), F.lit(0)))
    met = met.groupBy("key", "side", "term").agg(F.min(at).alias("at"))
    met = met.select("key", "side", F.lit("forbidden").alias("kind"), F.row_number().over(own).alias("place"), F.col("term").alias("line"))
    return core.unionByName(shared).unionByName(met)


def needs_fallback(pairs: DataFrame, lines: DataFrame, support: DataFrame, *, least: float = SUPPORT) -> DataFrame:
    """(key, fallback): whether a comparison's evidence is too weak to be told by lines.

    pairs is (key), lines those of line_sides, support (key, side, support) the best score of each side's chunks. It falls
    back where a side has no core line or support below ``least``, or where the first three core lines of both are the same.
    """
    first = lines.filter((F.col("kind") == "core") & (F.col("place") <= TOLD)).groupBy("key").pivot("side", ["a", "b"]).agg(F.array_sort(F.collect_set(T.normal_line(F.col("line")))))
    weak = support.groupBy("key").agg(F.min("support").alias("low"), F.count("*").alias("sides"))
    x = pairs.select("key").distinct().join(first, "key", "left").join(weak, "key", "left")
    empty = (F.coalesce(F.size("a"), F.lit(0)) < 1) | (F.coalesce(F.size("b"), F.lit(0)) < 1)
    return x.select("key", (empty | (F.col("a") == F.col("b")) | (F.coalesce("sides", F.lit(0)) < 2) | (F.col("low") < least)).alias("fallback"))
