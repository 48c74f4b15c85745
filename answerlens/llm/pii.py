"""Personal data in texts: regular expressions propose, checksums confirm, nearby words adjust the score.

DataFrame functions only. A kind's matches and the gaps between them come from one pattern (``regexp_extract_all`` and
``split``), so positions are sums of lengths in code points and nothing leaves the JVM. Sums are folded block by block, and
a text is cut piece by piece: a text of megabytes with hundreds of thousands of matches takes seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, with possessive repeats (no backtracking, no deep recursion on long runs). A look
# behind keeps a search from starting inside a run that a start further left has already tried.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds: bank accounts by mod 97, keys that their issuers mark, and social security numbers and long hexadecimal
# strings only where a nearby word speaks of them.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KEY = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,80}|xox[abprs]-[A-Za-z0-9-]{10,80}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])"

#: kind, pattern, text that must occur for a match (a cheap test first), score of a match that its check confirms, context words
KINDS = [
    ("email", EMAIL, "@", 0.9, r"(?i)e-?mail|contact|write to"),
    ("ip", IP, ".", 0.7, r"(?i)\bip\b|address|host|server"),
    ("card", CARD, "", 0.8, r"(?i)card|visa|master|credit|pay"),
    ("phone", PHONE, "+", 0.7, r"(?i)phone|tel|call|mobile|fax"),
    ("iban", IBAN, "", 0.9, r"(?i)iban|bank|account|konto|compte"),
    ("ssn", SSN, "-", 0.4, r"(?i)ssn|social security|tax"),
    ("key", KEY, "", 0.9, r"(?i)key|token|secret"),
    ("secret", SECRET, "", 0.4, r"(?i)token|secret|passw|api.?key|auth|credential"),
]
BASE = ("email", "ip", "card", "phone")
#: Score that a span of an added kind needs, what a context word adds, and how far it may stand.
NEEDED, CONTEXT_GAIN, CONTEXT_CHARS = 0.5, 0.2, 40
#: Numbers of a block of a running sum, characters of a piece of a text.
BLOCK, LEAF = 64, 1024
SPAN = "struct<start:int,ord:int,kind:string,end:int,score:double>"
#: Fewer characters than a valid match of the kind has; most proposals end here.
SHORTEST = {"card": 14, "phone": 11, "ip": 7}


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the numbers, what join makes of all before it, from 0. ``values`` is a column, not an expression.

    A fold copies what it has gathered at every step, so only blocks are folded, and the blocks' totals.
    """
    last = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    count = F.greatest(F.ceil(F.size(values) / BLOCK), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    first = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), join)), F.array(F.lit(0)), last)
    each = F.arrays_zip(blocks.alias("b"), F.slice(first, F.lit(1), count.cast("int")).alias("f"))
    return F.flatten(F.transform(each, lambda x: F.slice(F.aggregate(x["b"], F.array(x["f"]), last), F.lit(1), F.size(x["b"]))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits has a valid Luhn check digit."""
    digit = lambda i: F.substr(digits, -i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2),
    )
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """True where a bank account number leaves 1 modulo 97."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, ch: F.when(ch == "", acc).when(ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97),
    )
    return rest == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(number(p)) > 3, False).otherwise(F.coalesce(number(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


def spans_of(found: Column, gaps: Column, steps: Column, kind: str, confirmed: float, context: str) -> Column:
    """array<struct<start,ord,kind,end,score>> of one kind; positions in code points, end exclusive.

    found, gaps (one more than matches) and steps (lengths of a gap and its match, null without any) are columns, not
    expressions, so that they are made once.
    """
    order = [k[0] for k in KINDS].index(kind)
    empty, reach = F.array().cast(f"array<{SPAN}>"), F.lit(CONTEXT_CHARS)
    # match, gap before it, and what stands around: the match and gap before, the gap, match and gap after
    rows = F.arrays_zip(
        running(steps, lambda a, b: a + b).alias("at"), found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"),
        F.concat(F.array(F.lit("")), found).alias("m0"), F.concat(F.array(F.lit("")), gaps).alias("g0"),
        F.slice(gaps, 2, F.size(gaps)).alias("g1"), F.slice(found, 2, F.size(gaps)).alias("m1"), F.slice(gaps, 3, F.size(gaps)).alias("g2"),
    )
    start = F.filter(rows, lambda x: F.coalesce(F.length(x["m"]) >= SHORTEST.get(kind, 1), F.lit(False)))

    def scored(x: Column) -> Column:
        left = F.right(F.concat(F.right(x["g0"], reach), x["m0"], F.right(x["g"], reach)), reach)
        right = F.left(F.concat(F.left(x["g1"], reach), F.coalesce(F.left(x["m1"], reach), F.lit("")), F.coalesce(F.left(x["g2"], reach), F.lit(""))), reach)
        near = F.when(F.concat(left, x["m"], right).rlike(context), CONTEXT_GAIN).otherwise(0.0)
        begin = (x["at"] + F.length(x["g"])).cast("int")
        # proposals that fail their check are gone by now, so confirmed kinds have that score
        score = F.least(F.lit(1.0), F.lit(confirmed) + near)
        return F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (begin + F.length(x["m"])).alias("end"), score.alias("score"))

    kept = F.transform(F.filter(start, lambda x: _valid(kind, x["m"])), scored)
    if kind not in BASE:  # base kinds stay whatever their score
        kept = F.filter(kept, lambda x: x["score"] >= NEEDED)
    return F.when(steps.isNotNull(), kept.cast(f"array<{SPAN}>")).otherwise(empty)


def pii_spans(documents: DataFrame, *, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """documents with ``spans_col``: array<struct<start, ord, kind, end, score>> by start, then kind.

    Base kinds (email, ip, card, phone) are all matches of their pattern, leftmost and not overlapping within the kind,
    that pass the kind's check; bank accounts, keys, social security numbers and secrets come on top where checksum and
    context words give a score of 0.5 or more. Context is up to 40 characters before and after a match, but not beyond
    the proposals of its kind next to it. Null and empty texts have no spans; every row is kept, whatever its other
    columns; a column of the name ``spans_col`` is replaced. Work is per row, so repeated rows and ties give equal
    results and no row moves; an empty table gives no rows.
    """
    text = F.coalesce(F.col("`" + text_col.replace("`", "``") + "`").cast("string"), F.lit(""))
    all_of = lambda pattern, hint: F.when(F.instr(text, hint) > 0 if hint else F.lit(True), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    m, g, steps = ({k[0]: f"__{k[0]}_{part}" for k in KINDS} for part in ("matches", "gaps", "steps"))
    lengths = lambda kind: F.zip_with(F.slice(g[kind], F.lit(1), F.size(m[kind])), F.col(m[kind]), lambda a, b: F.length(a) + F.length(b))
    out = documents.withColumns({m[kind]: all_of(pattern, hint) for kind, pattern, hint, *_ in KINDS})
    out = out.withColumns({g[kind]: F.when(F.size(m[kind]) > 0, F.split(text, pattern, -1)) for kind, pattern, *_ in KINDS})
    out = out.withColumns({name: F.when(F.col(g[kind]).isNotNull(), lengths(kind)) for kind, name in steps.items()})
    parts = [spans_of(F.col(m[kind]), F.col(g[kind]), F.col(steps[kind]), kind, score, context) for kind, _, _, score, context in KINDS]
    return out.withColumn(spans_col, F.array_sort(F.concat(*parts))).drop(*m.values(), *g.values(), *steps.values())


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, leaves: Column, spans: Column, ends: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all.

    ``leaves`` is the text in pieces of LEAF characters, ``ends`` the spans' ends. All are columns, not expressions, so that
    they are made once.
    """

    def cut(begin: Column, end: Column) -> Column:
        leaf = F.floor(begin / LEAF).cast("int")
        held = F.array_join(F.slice(leaves, leaf + 1, (F.ceil(end / LEAF) - leaf + 1).cast("int")), "")
        return F.substr(held, begin - leaf * LEAF + 1, end - begin)

    first = F.filter(F.arrays_zip(running(ends, lambda a, b: F.greatest(a, b)).alias("at"), spans.alias("x")), lambda x: x["x"]["start"] >= x["at"])
    pieces = F.transform(first, lambda x: F.concat(cut(x["at"], x["x"]["start"]), F.lit("["), F.upper(x["x"]["kind"]), F.lit("]")))
    rest = F.substr(text, F.array_max(ends) + 1)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def mask_pii(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """documents with personal data in the text replaced by its kind; a null text stays null, other columns stay."""
    spans, leaves, ends = "__pii_spans", "__pii_leaves", "__pii_ends"
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in documents.columns}
    out = pii_spans(documents, text_col=text_col, spans_col=spans)
    text = F.col("`" + text_col.replace("`", "``") + "`").cast("string")
    some = lambda c: F.when(F.size(spans) > 0, c)
    out = out.withColumns({leaves: some(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))), ends: some(F.transform(spans, lambda x: x["end"]))})
    return out.select(*[masked(q.cast("string"), F.col(leaves), F.col(spans), F.col(ends)).alias(c) if c == text_col else q for c, q in quoted.items()])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = found.select("doc_id", "pii_spans")
    of = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    base = listed(F.filter("pii_spans", lambda x: x["kind"].isin(*BASE)))
    # one score per span, in the order of spans
    scores = F.array_join(F.transform("pii_spans", lambda x: F.format_number(x["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"), scores.alias("scores"))
