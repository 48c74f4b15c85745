"""Contracts of answers: what an answer must name, must not say and how it may be laid out, by the intent of its question.

What an answer has to name is a table of labels, (id, role, slot, label): any label of a slot stands for it. Labels come from
joins with the knowledge base; each answer meets its own labels once, in one join, and all rules read the slots it named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Cues of contrast and cause, words that connect lectures, headings and phrases that rules look for.
CONTRAST = r"(?i)\b(while|whereas|however|in contrast|unlike|compared to|difference|differs|rather than)\b"
CAUSAL = r"(?i)\b(because|so that|therefore|thus|by |in order to|why )\b"
CONNECTING = ["attention", "representation", "prediction", "compression", "lecture", "connect", "progression", "dependency", "sequence", "dynamic programming", "backpropagation"]
EXAMPLES = ["for example", "e.g.", "analogy"]
TECHNICAL = r"(?i)\b(gradient|backprop|epoch|loss function|matrix|layer norm|batch norm|weight decay)\b"
BOILERPLATE = ["this lecture thread", "builds definitions"]
QUIZ_HEADINGS = ["### Direct Answer", "### Explanation", "### Example / Intuition", "### Why it matters", "Course Answer:"]
SUMMARY_HEADINGS = ["### Direct Answer", "### Explanation", "Course Answer:"]
TRAILER = r"(?i)\s+(?:in this class|for this course)\.?\s*$"
COMPARES, EXPLAINS = ["compare", "compare_multi"], ["multi_step_explanation", "scoped_explanation"]
# Aliases of a side, concepts of a lecture and their aliases, aliases of a peer, shortest forbidden term, sides that are enough, a long answer.
SIDE_ALIASES, MAIN_CONCEPTS, MAIN_ALIASES, PEER_ALIASES, FORBIDDEN_OVER, SIDES_ENOUGH, LONG = 16, 6, 3, 6, 5, 4, 400


def _plain(c: Column) -> Column:
    cut = lambda x: F.regexp_replace(F.trim(x), "[?.,]+$", "")
    return cut(F.regexp_replace(cut(c), TRAILER, ""))


def side_labels(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(id, role, slot, label) of compared sides (id, pos, entity); names is (concept_id, pos, label), 0 the name, then aliases.

    A side is named by its own words, without course trailers, in the singular, or by the concept that has these words (else
    its first word) as name or alias: its name and first 16 aliases. Of several such concepts the smallest id counts. A
    blank side keeps its slot with no label, so it is never named.
    """
    e = entities.select("id", F.col("pos").alias("slot"), "entity", F.lower(_plain("entity")).alias("part"))
    singular = F.when((F.length("part") >= 5) & F.endswith("part", F.lit("s")) & ~F.endswith("part", F.lit("ss")), F.expr("substr(part, 1, length(part) - 1)"))
    own = e.select("id", "slot", F.explode(F.array(F.lower(F.trim("entity")), "part", singular)).alias("label"))
    keys = names.groupBy(F.lower(F.trim("label")).alias("key")).agg(F.min("concept_id").alias("concept_id"))
    wanted = e.select("id", "slot", F.posexplode(F.array("part", F.get(F.split("part", " "), F.lit(0)))).alias("at", "key")).filter("key <> ''")
    known = wanted.join(keys, "key").groupBy("id", "slot").agg(F.min(F.struct("at", "concept_id"))["concept_id"].alias("concept_id"))
    of_kb = known.join(names.filter(F.col("pos") <= SIDE_ALIASES), "concept_id").select("id", "slot", F.lower("label").alias("label"))
    return own.unionByName(of_kb).select("id", F.lit("side").alias("role"), "slot", "label").distinct()


def plain_labels(entities: DataFrame, linked: DataFrame, names: DataFrame) -> DataFrame:
    """(id, role, slot, label): what a comparison names, as written: the first two concepts of (id, concept_id, place from 1), the
    entities, further concepts; equal texts once, slots from 1."""
    concepts = linked.join(names.filter("pos = 0"), "concept_id").select("id", F.when(F.col("place") <= 2, F.col("place") - 3).otherwise(F.col("place") + 100).cast("long").alias("at"), "label")
    x = concepts.unionByName(entities.select("id", F.col("pos").cast("long").alias("at"), F.col("entity").alias("label")))
    x = x.withColumn("label", F.lower(F.trim("label"))).filter("label <> ''").groupBy("id", "label").agg(F.min("at").alias("at"))
    return x.select("id", F.lit("label").alias("role"), F.row_number().over(W.partitionBy("id").orderBy("at", "label")).alias("slot"), "label")


def anchor_labels(lectures: DataFrame, mains: DataFrame, names: DataFrame) -> DataFrame:
    """(id, role, slot, label): main concepts of the first lecture asked for, (id, lecture_number).

    mains is (lecture_number, place from 1, concept_id); six concepts count, each by its name and three aliases. A lecture in
    the table keeps a slot 0 without label, so that it counts as known.
    """
    first = lectures.groupBy("id").agg(F.min("lecture_number").alias("lecture_number"))
    known = first.join(mains.select("lecture_number").distinct(), "lecture_number", "left_semi").select("id", F.lit(0).alias("slot"), F.lit(None).cast("string").alias("label"))
    top = first.join(mains.filter(F.col("place") <= MAIN_CONCEPTS), "lecture_number").join(names.filter(F.col("pos") <= MAIN_ALIASES), "concept_id")
    return known.unionByName(top.select("id", F.col("place").cast("int").alias("slot"), F.lower("label").alias("label"))).select("id", F.lit("anchor").alias("role"), "slot", "label").distinct()


def forbidden_labels(linked: DataFrame, peers: DataFrame, names: DataFrame, over: int = FORBIDDEN_OVER) -> DataFrame:
    """(id, role, slot, label): names and six aliases of the peers (concept_id, peer_id), for questions linked to one concept only.

    Terms of ``over`` characters or fewer are left out; a concept isn't its own peer.
    """
    one = linked.groupBy("id").agg(F.countDistinct("concept_id").alias("n"), F.min("concept_id").alias("concept_id")).filter("n = 1")
    x = one.join(peers.filter("concept_id <> peer_id"), "concept_id").select("id", F.col("peer_id").alias("concept_id")).join(names.filter(F.col("pos") <= PEER_ALIASES), "concept_id")
    x = x.withColumn("label", F.lower(F.trim("label"))).filter(F.length("label") > over)
    return x.select("id", F.lit("forbidden").alias("role"), F.lit(0).alias("slot"), "label").distinct()


def axis_labels(linked: DataFrame, axes: DataFrame) -> DataFrame:
    """(id, role, slot, label): axes (low, high, axis) along which the first two concepts of (id, concept_id, place) are compared."""
    pair = linked.filter(F.col("place") <= 2).groupBy("id").agg(F.min("concept_id").alias("low"), F.max("concept_id").alias("high")).filter("low < high")
    return pair.join(axes, ["low", "high"]).select("id", F.lit("axis").alias("role"), F.lit(0).alias("slot"), F.lower("axis").alias("label")).distinct()


def named_slots(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answers (id, answer, ...) with ``asked`` and ``named``: arrays of (role, slot), all and those that the answer names.

    A label counts from two characters on, wherever it stands, whatever the case. Answers without labels, or without id, have
    empty arrays; repeated rows are judged each. An id's labels are its few sides, concepts and peers, so they fit a row.
    """
    kind = "array<struct<role:string,slot:int,label:string>>"
    per = labels.groupBy("id").agg(F.collect_set(F.struct("role", F.col("slot").cast("int").alias("slot"), F.trim("label").alias("label"))).alias("labels_"))
    x = answers.join(per, "id", "left").withColumn("labels_", F.coalesce("labels_", F.array().cast(kind)))
    low = F.lower(F.coalesce("answer", F.lit("")))
    slots = lambda c: F.array_distinct(F.transform(c, lambda r: F.struct(r["role"].alias("role"), r["slot"].alias("slot"))))
    found = F.filter("labels_", lambda r: (F.length(r["label"]) >= 2) & F.contains(low, r["label"]))
    return x.withColumn("asked", slots(F.col("labels_"))).withColumn("named", slots(found)).drop("labels_")


def _n(array: str, role: str, among: list[int] | None = None) -> Column:
    return F.size(F.filter(array, lambda r: (r["role"] == role) & (r["slot"].isin(among) if among is not None else F.lit(True))))


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[F.contains(text, F.lit(w)) for w in words])


def _parts() -> tuple[Column, Column]:
    return F.lower(F.coalesce("answer", F.lit(""))), F.coalesce("intent", F.lit(""))


def coverage_contract(contrast: str = CONTRAST, causal: str = CAUSAL, connecting: list[str] = CONNECTING) -> dict[str, Column]:
    """Rules over (answer, intent, lectures array) and named_slots: what an answer of this intent must name; others pass.

    Comparisons of two need both sides (fewer than two known sides pass), of three or more all, or four; each a cue or axis of contrast.
    Summaries name a main concept of the lecture, if it is known; several lectures need a lecture and, unless long, a word that connects.
    """
    low, intent = _parts()
    unless = lambda gate, ok: ~gate | ok
    sides = _n("asked", "side")
    return {
        "must_cover_both_sides": unless((intent == "compare") & (sides >= 2), _n("named", "side", [0, 1]) == 2),
        "must_cover_compare_multi": unless((intent == "compare_multi") & (sides >= 3), _n("named", "side") >= F.least(sides, F.lit(SIDES_ENOUGH))),
        "must_include_comparison_axis": unless(intent.isin(COMPARES), low.rlike(contrast) | (_n("named", "axis") > 0)),
        "must_cover_main_anchors": unless((intent == "lecture_summary") & (_n("asked", "anchor") > 0), _n("named", "anchor") > 0),
        "must_include_multiple_lectures": unless((intent == "cross_lecture_synthesis") & (F.size(F.coalesce("lectures", F.array().cast("array<int>"))) >= 2), F.contains(low, F.lit("lecture"))),
        "must_name_connecting_concepts": unless(intent == "cross_lecture_synthesis", (F.length(low) > LONG) | _any(low, connecting)),
        "must_answer_how_or_why": unless(intent.isin(EXPLAINS), low.rlike(causal) | F.contains(low, F.lit("step"))),
    }


def restriction_contract(examples: list[str] = EXAMPLES, technical: str = TECHNICAL, boilerplate: list[str] = BOILERPLATE) -> dict[str, Column]:
    """Rules over (answer, intent, no_examples, intuition_only) and named_slots: what an answer must not say.

    Forbidden terms bind answers that compare nothing; boilerplate is a summary with all of its phrases. A null flag is off.
    """
    low, intent = _parts()
    on = lambda flag: F.coalesce(flag, F.lit(False))
    every = F.least(F.lit(True), F.lit(True), *[F.contains(low, F.lit(p)) for p in boilerplate])
    return {
        "must_not_leak_forbidden_terms": intent.isin(COMPARES) | (_n("named", "forbidden") == 0),
        "must_not_have_examples_when_blocked": ~on("no_examples") | ~_any(low, examples),
        "must_not_have_technical_when_intuition_only": ~on("intuition_only") | ~low.rlike(technical),
        "must_not_be_boilerplate_summary": (intent != "lecture_summary") | ~every,
    }


def layout_contract(quiz: list[str] = QUIZ_HEADINGS, summary: list[str] = SUMMARY_HEADINGS) -> dict[str, Column]:
    """Rules over (answer, intent) and named_slots: layouts of quizzes and summaries, and the sides that a comparison must mention.

    A comparison with two sides needs both; with none, its first two labels; one of many at least two labels. With fewer than
    two labels nothing can be asked for.
    """
    _, intent = _parts()
    text = F.coalesce("answer", F.lit(""))
    two = F.when(_n("asked", "side") >= 2, _n("named", "side", [0, 1]) == 2).otherwise(_n("named", "label", [1, 2]) == 2)
    return {
        "must_match_quiz_contract": (intent != "teaching_plus_check") | ~_any(text, quiz),
        "must_match_summary_contract": (intent != "lecture_summary") | ~_any(text, summary),
        "must_match_compare_contract": ~intent.isin(COMPARES) | (_n("asked", "label") < 2) | F.when(intent == "compare", two).otherwise(_n("named", "label") >= 2),
    }
