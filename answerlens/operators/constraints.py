"""What a query asks of its answer: entities to compare, terms to use or avoid, limits on form, and rules that check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlens.functions import text as T

# Phrases that introduce a comparison, separate its sides and end an entity.
LEAD = r"(?i)^(?:compare|contrast|difference\s+between|what\s+is\s+the\s+difference\s+between)\s+"
SIDES = r"(?i)\s+(?:vs\.?|versus)\s+"
LISTING = r"(?is)(?:compare|contrast)\s+(.+)$"
CLAUSE = (
    r"(?i)\s+(?:in\s+(?:this|the|that|a|an|our|\w+(?:\s+\w+)*)\b|with\s+respect\s+to\b|for\s+(?:this|the|that|a|an|our|\w+(?:\s+\w+)*)\b|"
    r"according\s+to\b|within\b|during\b|regarding\b|when\s+(?:used|applied|training|doing)\b).*$"
)
DIFFERENT_FROM = r"(?is)\bhow\s+is\s+(.+?)\s+different\s+from\s+(.+?)\s*$"
PAIR = r"(?i)(?:difference|differ|compare|comparison|contrast|versus|vs\.?)\s+(?:between\s+)?(.+?)\s+(?:and|vs\.?|versus|or|&)\s+(.+)"
_EDGE = r"^\s+|[\s?.,;:]+$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _parts(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), _trimmed), lambda x: x != "")


def compare_entities(queries: DataFrame, *, sides: str = SIDES, listing: str = LISTING, clause: str = CLAUSE, different: str = DIFFERENT_FROM, pair: str = PAIR, most: int = 8) -> DataFrame:
    """(query_id, pos, entity): what a query compares, in order; queries that compare nothing have no rows.

    Two or more sides around a separator, else three or more items of a list after ``listing``, else the two sides of "how
    is one different from the other" (``different``) or of a comparison of one and the other (``pair``).
    """
    text = F.coalesce("query_text", F.lit(""))
    body = _trimmed(F.regexp_replace(F.trim(F.get(F.split(text, "[?]"), F.lit(0))), LEAD, ""))
    two, items = _parts(body, sides), _parts(F.regexp_extract(text, listing, 1), r",|\band\b")
    groups = lambda c, p: F.filter(F.array(*[_trimmed(F.regexp_replace(F.trim(F.regexp_extract(c, p, k)), LEAD, "")) for k in (1, 2)]), lambda x: x != "")
    apart, both = groups(body, different), groups(text, pair)
    found = F.when(F.size(two) >= 2, two).when(F.size(items) >= 3, items).when(F.size(apart) == 2, apart).when(F.size(both) == 2, both)
    name = lambda x: _trimmed(F.regexp_replace(F.get(F.split(F.regexp_replace(x, LEAD, ""), ":"), F.lit(0)), clause, ""))
    return queries.select("query_id", F.posexplode(F.filter(F.transform(F.slice(found, 1, most), name), lambda x: x != "")).alias("pos", "entity"))


def term_roles(linked: DataFrame, terms: DataFrame, peers: DataFrame) -> DataFrame:
    """(query_id, term, role, relational): terms of the linked concepts are targets, those of their peers forbidden.

    A term that is a target isn't forbidden; relational queries link two concepts or more. Terms and peers are
    knowledge-base tables, joined by concept; AQE broadcasts them while they are small.
    """
    kb = terms.select("concept_id", F.lower("term").alias("term")).distinct()
    pairs = linked.select("query_id", "concept_id").distinct()
    relational = pairs.groupBy("query_id").agg((F.count("*") >= 2).alias("relational"))
    target = pairs.join(kb, "concept_id").select("query_id", "term").distinct()
    other = pairs.join(peers, "concept_id").select("query_id", F.col("peer_id").alias("concept_id")).join(kb, "concept_id").select("query_id", "term").distinct()
    other = other.join(target, ["query_id", "term"], "left_anti")
    both = target.withColumn("role", F.lit("target")).unionByName(other.withColumn("role", F.lit("forbidden")))
    return both.join(relational, "query_id")


def response_constraints(queries: DataFrame, flags: dict[str, str], count: str, exclusions: list[str], most: int = 12) -> DataFrame:
    """(query_id, one boolean per flag, asked_count, forbidden): limits that a query states about its answer.

    ``count`` captures a number, kept from 1 to ``most``; ``exclusions`` capture a clause, split into topics of two or
    more letters, lower-cased, each once in order of the patterns.
    """
    text = F.coalesce("query_text", F.lit(""))
    n = F.regexp_extract(text, count, 1).try_cast("int")
    clauses = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in exclusions])
    topics = F.flatten(F.transform(clauses, lambda c: _parts(F.lower(c), r",|\s+or\s+|\s+and\s+")))
    forbidden = F.array_distinct(F.filter(topics, lambda x: F.length(x) >= 2))
    return queries.select("query_id", *[text.rlike(p).alias(k) for k, p in flags.items()], F.when(n.between(1, most), n).alias("asked_count"), F.array_join(forbidden, "; ").alias("forbidden"))


def complexity(queries: DataFrame) -> DataFrame:
    """(query_id, label) from (type, parts): complex with three parts or more, or when lectures or sides are combined."""
    return queries.select("query_id", F.when((F.coalesce("parts", F.lit(0)) >= 3) | F.col("type").isin("compare", "synthesis"), "complex").otherwise("simple").alias("label"))


def mentions(answer: Column, names: list[str]) -> Column:
    """How many of the names the text contains, whatever the case."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return sum((F.contains(low, F.lit(n.lower())).cast("int") for n in names), F.lit(0))


def coverage_rules(answer: Column, kind: Column, entities: list[str], *, contrast: str, causal: str, at_most: int = 4) -> dict[str, Column]:
    """Rules that gate on the kind of question: both sides, several entities, a contrast cue, how or why."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    compares = kind == "compare"
    return {
        "must_cover_both_sides": ~compares | (mentions(answer, entities[:2]) == len(entities[:2])), "must_cover_compare_multi": ~compares | F.lit(len(entities) < 3) | (mentions(answer, entities) >= min(len(entities), at_most)),
        "must_include_comparison_axis": ~compares | low.rlike(contrast), "must_answer_how_or_why": (kind != "chat") | low.rlike(causal),
    }


def restriction_rules(answer: Column, blocked: dict[str, tuple[Column, str]]) -> dict[str, Column]:
    """Rules by name from (gate, pattern): where the gate holds, the pattern must not stand in the answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return {name: ~F.coalesce(gate, F.lit(False)) | ~low.rlike(pattern) for name, (gate, pattern) in blocked.items()}


def layout_rules(answer: Column, kind: Column, markers: dict[str, list[str]]) -> dict[str, Column]:
    """Per kind, headings that its layout must not have; a blank answer passes."""
    text = F.coalesce(answer, F.lit(""))
    has = lambda marks: F.greatest(F.lit(False), *[F.contains(text, F.lit(m)) for m in marks])
    return {f"must_match_{k}_contract": (kind != k) | (F.trim(text) == "") | ~has(marks) for k, marks in markers.items()}


def soft_flags(answers: DataFrame, answer: Column, kind: Column, sides: list[str], targets: list[str], filler: str, short: int = 120) -> DataFrame:
    """answers with generic_answer, missing_side and generic_filler; none of them fails an answer."""
    text = F.coalesce(answer, F.lit(""))
    return (
        answers.withColumn("generic_answer", (F.length(text) < short) & (mentions(answer, targets) == 0))
        .withColumn("missing_side", (kind == "compare") & (mentions(answer, sides) < len(sides))).withColumn("generic_filler", F.lower(text).rlike(filler))
    )


def shared_lines(a: DataFrame, b: DataFrame, floor: int = 1, most: int = 5) -> DataFrame:
    """(query_id, place, line): lines of both sides, a's first, each text once, where both have ``floor`` lines or more."""
    enough = lambda x: x.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= floor).select("query_id")
    both = a.select("query_id", F.lit(0).alias("side"), "place", "line").unionByName(b.select("query_id", F.lit(1).alias("side"), "place", "line"))
    both = both.join(enough(a), "query_id", "left_semi").join(enough(b), "query_id", "left_semi")
    once = both.groupBy("query_id", F.lower(F.trim("line")).alias("key")).agg(F.min(F.struct("side", "place", "line")).alias("x"))
    listed = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("x"))
    return listed.select("query_id", F.posexplode(F.transform("x", lambda r: F.trim(r["line"]))).alias("at", "line")).select("query_id", (F.col("at") + 1).alias("place"), "line")


def structural_errors(concepts: DataFrame) -> DataFrame:
    """(concept_id, error): concepts without an id, without terms, or with a term that is blank or stands twice."""
    x = concepts.groupBy("concept_id").agg(F.count("term").alias("n"), F.countDistinct(F.lower("term")).alias("u"), F.count_if(F.trim("term") == "").alias("blank"))
    errors = F.array_compact(F.array(F.when(F.col("concept_id").isNull(), F.lit("no_id")), F.when(F.col("n") == 0, F.lit("no_terms")), F.when(F.col("blank") > 0, F.lit("blank_term")), F.when(F.col("u") < F.col("n"), F.lit("repeated_term"))))
    return x.select("concept_id", F.explode(errors).alias("error"))


def augmented_queries(queries: DataFrame, linked: DataFrame, terms: DataFrame, hints: DataFrame | None = None, most: int = 18) -> DataFrame:
    """(query_id, text): each query with the terms and hints of its linked concepts (query_id, pos, concept_id) that it lacks.

    hints is (concept_id, pos, hint). Concepts go in order, each with its terms, then its hints. A phrase whose text stands
    in the query, or whose words all stand there or in what was added before, is left out; once ``most`` words are added
    no more follow. Queries without any stay as they are. A query's phrases are those of its concepts, so they are few.
    """
    kb = terms.select("concept_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lower(F.trim("term")).alias("term"))
    if hints is not None:
        kb = kb.unionByName(hints.select("concept_id", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("at"), F.lower(F.trim("hint")).alias("term")))
    low = queries.select("query_id", T.normal_line(F.coalesce("query_text", F.lit(""))).alias("low"))
    x = linked.join(kb.filter(F.length("term") >= 2).distinct(), "concept_id").join(low, "query_id").filter(~F.contains("low", F.col("term")))
    order = F.struct("pos", "concept_id", "kind", "at", "term")
    x = x.groupBy("query_id", "low").agg(F.array_sort(F.collect_list(order)).alias("x")).withColumn("have", T.tokens(F.col("low")))
    x = x.withColumn("x", F.transform("x", lambda r: F.struct(r["term"].alias("term"), T.tokens(r["term"]).alias("words"))))
    start = F.struct(F.col("have").alias("have"), F.array().cast("array<string>").alias("more"), F.lit(0).alias("n"))

    def add(s, r):
        known = (F.size(r["words"]) > 0) & (F.size(F.array_except(r["words"], s["have"])) == 0)
        longer = F.struct(F.array_union(s["have"], r["words"]).alias("have"), F.concat(s["more"], F.array(r["term"])).alias("more"), (s["n"] + F.greatest(F.size(r["words"]), F.lit(1))).alias("n"))
        return F.when(known | (s["n"] >= most), s).otherwise(longer)

    more = x.select("query_id", F.array_join(F.aggregate("x", start, add)["more"], " ").alias("more")).filter("more <> ''")
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query_text", "more").alias("text"))


def model_input(hits: DataFrame, chunks: DataFrame, most_chars: int = 8000, text_col: str = "clean_explanation") -> DataFrame:
    """(query_id, section, n, text): texts of the hits (query_id, section, id, rank) by rank, each text once per query.

    A text that stands in two sections stays in the one that sorts first. Only texts of hits are read; a section's
    text is cut at ``most_chars`` characters, as a model's input is.
    """
    c = chunks.join(hits.select("id").distinct(), "id", "left_semi").select("id", F.trim(text_col).alias("line")).filter("line <> ''")
    once = hits.join(c, "id").groupBy("query_id", F.lower("line").alias("key")).agg(F.min(F.struct("section", "rank", "id", "line")).alias("x"))
    listed = once.groupBy("query_id", F.col("x.section").alias("section")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select("query_id", "section", F.size("x").cast("long").alias("n"), F.substring(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), 1, most_chars).alias("text"))
