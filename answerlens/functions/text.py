"""Text columns: tokens, query terms, stems, references, units and labels."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.sources.stored import stored

# Words that queries drop, and two-letter words that are noise.
STOPWORDS = """
what how why when where who whom which whose explain tells tell describe summary summarize overview about between difference different compare comparison versus vs
the a an is are was were be been being do does did done got get me my we us our you your they them their it its this that these those on of at in to for from by as if or not no
can could should would will may might must shall need just like lot really very much some any all each every into out up down over quiz give show teach help
please thanks thank hey hi hello okay ok briefly quickly
""".split()
TWO_LETTER_NOISE = "an as at be by do go he if in is it me my no of on or so to up us we am id ok ox".split()
ALIASES = {"backprop": ["backpropagation"], "mfcc": ["mfccs"]}

#: Compatibility forms without combining marks, by the Unicode rule.
_PLAIN = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if unicodedata.category(x) != "Mn") for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000}
FOLD_FROM = "".join(c for c, x in _PLAIN.items() if x != c and len(x) == 1)
FOLD_TO = "".join(x for c, x in _PLAIN.items() if x != c and len(x) == 1)
#: Latin characters that become several, such as ligatures, written as (character, plain form).
FOLD_LONG = [(c, x) for c, x in _PLAIN.items() if len(x) > 1 and (ord(c) < 0x250 or 0xFB00 <= ord(c) < 0xFB07)]


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(c: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens without stopwords, single letters and noisy two-letter words; order and repeats stay."""
    drop = F.array(*[F.lit(x) for x in [*(STOPWORDS if stopwords is None else stopwords), *TWO_LETTER_NOISE]])
    return F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(drop, t))


def light_stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substr(t, F.lit(1), n - k)
    return (
        F.when(n <= 2, t).when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & t.endswith("es") & ~t.endswith("ses"), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss"), cut(1)).when((n > 7) & t.endswith("ing"), cut(3)).when((n > 4) & t.endswith("ed"), cut(2)).otherwise(t)
    )


def family(t: Column) -> Column:
    """Every surface form that counts as the token: itself, its stem, aliases, singular or plural."""
    n = F.length(t)
    cut = lambda k: F.substr(t, F.lit(1), n - k)
    plural = t.endswith("s") & ~t.endswith("ss") & (n >= 5)
    forms = [
        t, light_stem(t), F.when(plural, cut(1)), F.when(plural & t.endswith("ies"), F.concat(cut(3), F.lit("y"))), F.when((n >= 6) & ~t.endswith("s"), F.concat(t, F.lit("s"))),
        F.when(~plural & (n > 4) & t.endswith("y") & ~F.substr(t, n - 1, F.lit(1)).isin(*"aeiou"), F.concat(cut(1), F.lit("ies"))),
    ]
    for word, others in ALIASES.items():
        for other in others:
            forms += [F.when(t == word, F.lit(other)), F.when(t == word, light_stem(F.lit(other)))]
    return F.array_distinct(F.filter(F.array_compact(F.array(*forms)), lambda x: x != ""))


def lecture_numbers(c: Column) -> Column:
    """Numbers after lecture, lec, week or class, ordered and distinct."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(?:lecture|lec|week|class)\s*#?\s*([0-9]{1,6})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


# How a range of lectures is written.
LECTURE_RANGE = r"(?i)(?:lecture|lec\.?|week)s?\s*([0-9]+)\s*(?:to|through|[-–—])\s*([0-9]+)"


def lecture_spans(c: Column) -> Column:
    """array<struct<low,high>> of ranges such as 'lectures 13 through 15' or 'week 3-5'; falling ranges, and numbers that no long holds, are left out."""
    text = F.coalesce(c, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LECTURE_RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(LECTURE_RANGE), F.lit(2)).alias("b"))
    spans = F.transform(pairs, lambda x: F.struct(x["a"].try_cast("long").alias("low"), x["b"].try_cast("long").alias("high")))
    return F.filter(spans, lambda x: x["low"] <= x["high"])


def lecture_range(c: Column) -> Column:
    """All numbers of the ranges in a text, sorted, each once. The list is as long as the ranges say; lecture_spans has the ranges alone."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(lecture_spans(c), lambda x: F.sequence(x["low"], x["high"])))))


def grams(terms: Column, n: int) -> Column:
    """Consecutive n-tuples of an array, joined by a space."""
    size = F.size(terms)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(terms, i, n), " "))).otherwise(F.array().cast("array<string>"))


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks, of the basic plane (beyond Latin, forms that become several stay)."""
    folded = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), FOLD_FROM, FOLD_TO)
    many = "[" + "".join(x for x, _ in FOLD_LONG) + "]"
    return F.when(c.rlike(many), reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLD_LONG, folded)).otherwise(folded)


def units(c: Column) -> Column:
    """Lines, or sentences where there is one line of over 200 characters; trimmed, blank ones dropped."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = F.filter(F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.size(lines) == 1) & (F.length(F.get(lines, F.lit(0))) > 200), sentences).otherwise(lines)


def normal_line(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def term_hits(c: Column, term: str) -> Column:
    """How often a single word stands in the text; a phrase counts once at most."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if " " in term:
        return F.contains(low, F.lit(term.lower())).cast("int")
    return F.size(F.filter(tokens(c), lambda t: t == term.lower()))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two term arrays, 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def one_line(c: Column, most: int = 2500) -> Column:
    """Paragraphs joined by a double bar, white space collapsed."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.substring(F.array_join(parts, " || "), 1, most)


def topic_head(c: Column) -> Column:
    return F.trim(F.get(F.split(c, "—"), F.lit(0)))


def filler_score(c: Column, phrases: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))
    words = F.size(F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0)))
    return hits / F.greatest(words / 20.0, F.lit(1.0))


def first_matching(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(default)


def correct_typos(words: DataFrame, vocabulary: DataFrame, *, shortest: int = 5) -> DataFrame:
    """(word, term, distance): the closest term of each unknown distinct word, by edit distance, ties by term.

    At most 1 edit for words under 8 letters, else 2. Pairs meet on deletion neighbourhoods: words within k edits share
    a string that k deletions leave, so there is an equi-join and no comparison of all pairs.
    """
    known = vocabulary.select(F.lower("term").alias("term")).filter(F.length("term") >= 1).distinct()
    w = words.select(F.lower("word").alias("word")).filter(F.length("word") >= shortest).distinct()
    w = w.join(known, w["word"] == known["term"], "left_anti")
    near = w.select("word", F.explode(deletions(F.col("word"))).alias("key")).join(known.select("term", F.explode(deletions(F.col("term"))).alias("key")), "key").select("word", "term").distinct()
    most = F.when(F.length("word") < 8, 1).otherwise(2)
    near = near.withColumn("d", F.levenshtein("word", "term")).filter(F.col("d") <= most)
    return near.groupBy("word").agg(F.min(F.struct("d", "term")).alias("x")).select("word", "x.term", F.col("x.d").alias("distance"))


def deletions(c: Column) -> Column:
    """The word and all forms that one or two deletions leave (two only from 7 letters on)."""
    drop = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(F.array().cast("array<string>"))
    one = drop(c)
    two = F.when(F.length(c) >= 6, F.flatten(F.transform(one, drop))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, two))


def expand_aliases(tokens_of: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, terms): tokens plus the words of their aliases, each once, tokens first."""
    t = tokens_of.select("id", F.posexplode("terms").alias("pos", "term"))
    more = t.join(aliases.select("term", "alias"), "term").select("id", "pos", F.posexplode(F.split(F.lower("alias"), " ")).alias("sub", "word"))
    all_words = t.select("id", F.lit(0).alias("kind"), "pos", F.lit(0).alias("sub"), F.col("term").alias("word")).unionByName(more.select("id", F.lit(1).alias("kind"), "pos", "sub", "word"))
    first = all_words.groupBy("id", "word").agg(F.min(F.struct("kind", "pos", "sub")).alias("at"))
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x")).select("id", F.transform("x", lambda r: r["word"]).alias("terms"))


def phrase_places(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, concept_id, pos, n): where a phrase of n words stands in a text, for phrases of any number of words.

    texts is (query_id, query_text), phrases (concept_id, term). A phrase is looked up by its first word, an equi-join with
    the places of the text, and the words that follow are compared in place. Repeated phrases count once.
    """
    index = phrases.select("concept_id", tokens(F.col("term")).alias("words")).filter(F.size("words") > 0).distinct().withColumn("first", F.get("words", F.lit(0)))
    longest = index.agg(F.max(F.size("words"))).first()[0] or 1
    toks = texts.select("query_id", tokens(F.col("query_text")).alias("toks"))
    places = toks.select("query_id", "toks", F.posexplode("toks").alias("pos", "first")).select("query_id", "pos", "first", F.slice("toks", F.col("pos") + 1, longest).alias("ahead"))
    found = places.join(index, "first").filter(F.slice("ahead", F.lit(1), F.size("words")) == F.col("words"))
    return found.select("query_id", "concept_id", "pos", F.size("words").alias("n"))


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term): which terms a text contains, anywhere in it, whatever the case; texts is (id, text), terms (term).

    Each term is looked up by the rarest of its grams of three characters (or by itself if it is shorter), an equi-join with
    the grams of the texts; what is found is verified. Blank terms are in no text. The looked-up grams are a written table,
    so that Spark knows their size when it picks the join.
    """
    low = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    t = terms.select(F.lower("term").alias("term")).filter(F.trim("term") != "").distinct().withColumn("n", F.least(F.length("term"), F.lit(3)))
    grams_of = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    by_size = lambda c: F.when(F.col("n") == 3, grams_of(c, 3)).when(F.col("n") == 2, grams_of(c, 2)).otherwise(grams_of(c, 1))
    asked = t.select("term", F.explode(F.array_distinct(by_size(F.col("term")))).alias("gram"))
    asked = stored(asked, "grams")
    sizes = sorted(r.n for r in asked.select(F.length("gram").alias("n")).distinct().collect()) or [3]  # three numbers at most
    held = low.select("id", F.explode(F.array_distinct(F.concat(*[grams_of(F.col("text"), n) for n in sizes]))).alias("gram"))
    counts = held.join(asked.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("count"))
    rarest = asked.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram")).alias("x"))
    rarest = stored(rarest.filter("x.count > 0").select("term", "x.gram"), "rarest")
    found = held.join(rarest, "gram").select("id", "term").distinct()
    return low.join(found, "id").filter(F.contains("text", F.col("term"))).select("id", "term")
