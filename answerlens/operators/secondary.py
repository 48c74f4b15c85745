"""Checks of a second text that may only reword what the evidence of an answer says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.operators.sides import hits_of

# The heading of such texts, phrases that mark what comes from outside, and limits.
HEADING = "Boosted Explanation:"
MARKERS = ["a useful clarification is", "in standard speech processing terms", "in standard machine learning terms", "more generally"]
MARKED_MOST, NOVEL_MOST, SHORT_SENTENCE = 2, 1, 12
SHALLOW_CHARS, SHALLOW_LINES = 600, 2
ANSWER_HEADING, LINE_LEAST, LINE_MOST, LINES, WHOLE_MOST = "course answer:", 12, 400, 5, 800
_SENTENCE, _WORD = r"(?<=[.!?])\s+", r"[\p{L}\p{N}\p{M}_]+"


def is_shallow(answer: Column, n_lines: Column) -> Column:
    """Whether an answer is short enough, or its evidence thin enough, for a clarification from outside."""
    return (F.length(_strip(F.coalesce(answer, F.lit("")))) < SHALLOW_CHARS) | (n_lines <= SHALLOW_LINES)


def fallback_lines(answer: Column) -> Column:
    """Evidence where no line is left: the answer's first five lines of twelve characters or more, else its beginning."""
    body = _strip(F.coalesce(answer, F.lit("")))
    body = F.when(F.lower(body).startswith(ANSWER_HEADING), _strip(F.substring(body, len(ANSWER_HEADING) + 1, 1 << 30))).otherwise(body)
    lines = F.transform(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n"), lambda x: _strip(F.regexp_replace(_strip(x), "^[-*•]+", "")))
    lines = F.slice(F.transform(F.filter(lines, lambda x: F.length(x) >= LINE_LEAST), lambda x: F.substring(x, 1, LINE_MOST)), 1, LINES)
    return F.when(F.size(lines) > 0, lines).when(body != "", F.array(F.substring(body, 1, WHOLE_MOST))).otherwise(F.array().cast("array<string>"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _forbidden(text: Column, terms: Column) -> Column:
    low = F.lower(text)
    return F.exists(terms, lambda t: hits_of(low, F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), t) > 0)


def check_secondary(texts: DataFrame, evidence: DataFrame, forbidden: DataFrame, *, markers: list[str] | None = None) -> DataFrame:
    """(id, reason, kept, novel, clean_text): the first reason against a text, or the text as it may be shown.

    texts is (id, secondary, relational, external), evidence (id, line), forbidden (id, term). Sentences with a forbidden
    term are dropped first. Reasons in order: empty_boost; all_sentences_forbidden; forbidden_after_strip, a term that only
    stands in what is joined; forbidden_term:..., unless the question is relational, a term of three letters or more inside
    a word (the first in order); and, where external additions are allowed, unmarked_external, a sentence that neither
    begins with a marker nor has a quarter of its words in the evidence; too_many_new_terms, more than one proper name or
    acronym in the first two marked sentences that the evidence lacks. Without ``external`` the last two aren't asked.
    kept counts sentences left, novel the new names. Evidence and terms are summed up per id; null terms hold nothing.
    """
    marks = [m.lower() for m in (MARKERS if markers is None else markers)]
    said = evidence.groupBy("id").agg(F.lower(F.array_join(F.sort_array(F.collect_list("line")), " ")).alias("blob"))
    terms = forbidden.filter("term IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set(F.lower("term"))).alias("terms"))
    x = texts.select("id", "relational", "external", _strip(F.coalesce("secondary", F.lit(""))).alias("body")).join(said, "id", "left").join(terms, "id", "left")
    x = x.withColumn("blob", F.coalesce("blob", F.lit(""))).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    headed = F.lower("body").startswith(HEADING.lower().rstrip(":"))
    rest = F.when(headed, F.substring("body", len(HEADING) + 1, 1 << 30)).otherwise(F.col("body"))
    sentences = F.filter(F.transform(F.split(_strip(rest), _SENTENCE), _strip), lambda s: s != "")
    x = x.withColumn("kept", F.filter(sentences, lambda s: ~_forbidden(s, F.col("terms"))))
    x = x.withColumn("shown", F.concat(F.lit(HEADING + "\n\n"), F.array_join("kept", " ")))
    inside = F.get(F.filter("terms", lambda t: (F.length(t) > 2) & F.contains(F.lower("shown"), t)), F.lit(0))

    marked = lambda s: sum((F.lower(s).startswith(m).cast("int") for m in marks), F.lit(0)) > 0
    x = x.withColumn("unmarked", F.exists("kept", lambda s: ~marked(s) & ~_covered(s, F.col("blob"))))
    spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size("kept") - 1, F.lit(0))), lambda i: F.coalesce(marked(F.get("kept", i)), F.lit(False)))
    last = F.coalesce(F.get(spots, F.lit(MARKED_MOST - 1)), F.lit(1 << 30))
    x = x.withColumn("last", last).withColumn("capped", F.filter("kept", lambda s, i: ~marked(s) | (i <= F.col("last"))))
    names = F.filter(F.regexp_extract_all(F.array_join(F.filter("capped", marked), " "), F.lit(_WORD), F.lit(0)), lambda w: w.rlike("^([A-Z][a-z]{3,}|[A-Z]{2,})$"))
    novel = F.size(F.array_distinct(F.filter(F.transform(names, F.lower), lambda w: ~F.contains(F.col("blob"), w))))
    x = x.withColumn("novel", F.when(F.col("external"), novel).otherwise(0))
    reason = (
        F.when(F.col("body") == "", "empty_boost").when(F.size("kept") == 0, "all_sentences_forbidden").when(_forbidden(F.col("shown"), F.col("terms")), "forbidden_after_strip")
        .when(~F.col("relational") & inside.isNotNull(), F.concat(F.lit("forbidden_term:"), F.substring(inside, 1, 20))).when(F.col("external") & F.col("unmarked"), "unmarked_external")
        .when(F.col("novel") > NOVEL_MOST, "too_many_new_terms")
    )
    text = F.concat(F.lit(HEADING + "\n\n"), F.array_join(F.when(F.col("external"), F.col("capped")).otherwise(F.col("kept")), " "))
    return x.withColumn("reason", reason).select("id", "reason", F.size("kept").alias("kept"), "novel", F.when(F.col("reason").isNull(), text).alias("clean_text"))


def _covered(sentence: Column, blob: Column) -> Column:
    """Whether a quarter of a sentence's words of three letters or more, and one at least, stand in the evidence; short ones pass."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit("[a-z]{3,}"), F.lit(0))
    hits = F.size(F.filter(words, lambda w: F.contains(blob, w)))
    return (F.length(sentence) < SHORT_SENTENCE) | (F.size(words) == 0) | (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 4)))
