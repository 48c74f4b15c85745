"""Coverage audits of a knowledge base, and the ingest rules of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions import text as T


def chunks_per_concept(chunks: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """(concept_id, chunks, thin): chunks that contain any term of a concept; every concept has a row."""
    t = terms.select("concept_id", F.lower("term").alias("term")).distinct()
    held = T.containing(chunks.select("id", F.concat_ws(" ", "topic", "source_excerpt").alias("text")), t.select("term"))
    hit = held.join(t, "term").groupBy("concept_id").agg(F.countDistinct("id").alias("chunks"))
    return t.select("concept_id").distinct().join(hit, "concept_id", "left").select("concept_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), (F.coalesce("chunks", F.lit(0)) < least).alias("thin"))


def pattern_issues(items: DataFrame, patterns: list[tuple[str, str]], field: str) -> DataFrame:
    """(id, issue): one row per pattern that an item breaks."""
    found = F.array_compact(F.array(*[F.when(F.col(field).rlike(p), F.lit(name)) for name, p in patterns]))
    return items.select("id", F.explode(found).alias("issue"))


def pack_errors(packs: DataFrame) -> DataFrame:
    """(pack_id, lecture, label, error) of concept packs (pack_id, payload as JSON text): errors of structure.

    A payload that is no JSON object (or null) is pack_not_object; one without a list of concepts pack_missing_concepts; each
    element of the list that is no object concept_not_object, labelled by its place from 0. A pack's lecture is its
    lecture_id, else its lecture_number, where they say something (not blank, 0 or false), else pack_ and its id. Repeated packs are judged each.
    """
    at = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    said = lambda name: F.when(~F.trim(at(name, "string")).isin("", "0", "false"), at(name, "string"))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    x = packs.select("pack_id", F.try_parse_json("payload").alias("v")).withColumn("listed", at("concepts", "array<variant>"))
    own = lambda error: F.array(F.struct(F.lit("(pack)").alias("label"), F.lit(error).alias("error")))
    bad = F.filter(F.transform("listed", lambda e, i: F.when(~is_object(e), F.concat(F.lit("concept_"), i.cast("string")))), lambda label: label.isNotNull())
    inner = F.transform(bad, lambda label: F.struct(label.alias("label"), F.lit("concept_not_object").alias("error")))
    found = F.when(~is_object(F.col("v")), own("pack_not_object")).when(F.col("listed").isNull(), own("pack_missing_concepts")).otherwise(inner)
    lecture = F.coalesce(said("lecture_id"), said("lecture_number"), F.concat(F.lit("pack_"), F.col("pack_id").cast("string")))
    return x.select("pack_id", lecture.alias("lecture"), F.explode(found).alias("e")).select("pack_id", "lecture", "e.label", "e.error")


def strip_stub(c: Column, stub: str) -> Column:
    return F.regexp_replace(c, stub, "")


def uncovered(dimension: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    return dimension.join(cases.select(key).distinct(), key, "left_anti")


def invalid_rules(chunks: DataFrame) -> Column:
    """Names of the rules that a chunk row breaks."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim("topic"), F.lit("")) == "", F.lit("empty_heading")), F.when(~F.coalesce(F.col("chunk_key"), F.lit("")).rlike("^[A-Za-z0-9:._-]+$"), F.lit("bad_key")),
        F.when(F.coalesce(F.trim("source_excerpt"), F.lit("")) == "", F.lit("no_body")), F.when(F.coalesce(F.col("lecture_number"), F.lit(-1)) < 0, F.lit("bad_number")),
    ))


def chunk_key(lecture: Column, heading: Column, index: Column, explicit: Column) -> Column:
    """The explicit key, else lecture:index:slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, 48), "-+$", ""), F.lit("")), F.lit("section"))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.format_string("%d:%02d:%s", lecture, index, slug))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key, and new's other rows appended."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


def auto_keywords(c: Column, stopwords: list[str], cap: int = 48) -> Column:
    drop = F.array(*[F.lit(x) for x in stopwords])
    return F.slice(F.array_distinct(F.filter(T.tokens(c), lambda t: (F.length(t) >= 3) & ~F.array_contains(drop, t))), 1, cap)


def merge_keywords(rows: DataFrame, lists: list[str], cap: int = 48) -> DataFrame:
    """(id, keywords): the lists in order, each word once whatever its case, first spelling kept."""
    x = rows.select("id", F.posexplode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])).alias("pos", "term")).filter(F.trim("term") != "")
    first = x.groupBy("id", F.lower("term").alias("low")).agg(F.min(F.struct("pos", "term")).alias("f"))
    first = first.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("f.pos"))).filter(F.col("r") <= cap)
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "f.term"))).alias("x")).select("id", F.array_join(F.transform("x", lambda y: y["term"]), ",").alias("keywords"))


def chunk_type(heading: Column, exact: dict[str, str], contains: list[tuple[str, str]], default: str = "definition") -> Column:
    low = F.lower(F.trim(heading))
    m = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
    rules = [F.when(F.contains(low, F.lit(part)), kind) for part, kind in contains]
    return F.coalesce(m[low], *rules, F.lit(default))
