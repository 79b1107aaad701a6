"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a built-in Spark expression. Positions are found without a position function: the
text is split at the matches of a pattern, and the lengths of pieces and matches add up to offsets.

The patterns are written with possessive quantifiers and look-behinds that admit the same leftmost
non-overlapping matches as their plain forms, yet run in linear time and without recursion on long
runs of digits, dots or letters.

Defined cases: a null text counts as empty and has no spans; repeated rows are treated one by one;
columns of the input other than the text pass through untouched, an existing ``spans`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import whole_text

# The span kinds in their order, their patterns, base scores and context words.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
}
#: A character every match has; texts without it skip the pattern.
HINTS = {"email": "@", "phone": "+", "ip": "."}
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "short_card": 0.4}
CONTEXT = {
    "email": "mail|contact|write|schreib|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobil|ruf|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "short_card": "card|visa|amex|credit|karte|carte|tarjeta",
}
CONTEXT_STEP = 0.3
#: A proposed span of an added kind needs this score; base kinds stay whatever their score is.
ACCEPT = 0.6
REACH = 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the Luhn check digit of those before."""
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number leaves remainder 1, letters read as 10 to 35."""
    bare = F.regexp_replace(hit, r"\x20", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))

    def step(rest, i):
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        # Leading zeros do not count.
        return F.forall(
            F.split(hit, r"\."),
            lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3)
            & (F.right(part, F.lit(3)).cast("int") <= 255),
        )
    if kind in ("card", "short_card"):
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def _placed(text: Column, pattern: str) -> Column:
    """Every match with its code-point offsets: array of (start, end, hit)."""
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), state).otherwise(
            F.struct(end.alias("at"), F.array_append(state["out"], found).alias("out"))
        )

    begin = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.aggregate(steps, begin, step, lambda state: state["out"])


def _spans(kind: str, text: Column) -> Column:
    def scored(x):
        left = F.greatest(x["start"] - REACH, F.lit(0))
        near = F.concat(
            F.substring(text, left + 1, x["start"] - left), F.lit(" "),
            F.substring(text, x["end"] + 1, F.lit(REACH)),
        )
        bonus = F.when(F.lower(near).rlike(CONTEXT[kind]), CONTEXT_STEP).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + bonus)
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"),
            score.alias("score"),
        )

    found = F.transform(F.filter(_placed(text, PATTERNS[kind]), lambda x: _confirmed(kind, x["hit"])), scored)
    if kind not in BASE_KINDS:
        found = F.filter(found, lambda x: x["score"] >= ACCEPT)
    worth = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike("[0-9]")
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return F.when(worth, found).otherwise(nothing)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: array of (kind, start, end, score), by kind as listed, then by start."""
    source = whole_text(text)
    return docs.withColumn("spans", F.concat(*[_spans(kind, source) for kind in KINDS]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``text`` by its kind in angle brackets; overlapping spans count from the first on."""
    source = whole_text(text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        piece = F.substring(source, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(
            s["end"].alias("at"), F.concat(state["out"], piece, F.lit("<"), s["kind"], F.lit(">")).alias("out")))

    def finish(state):
        return F.concat(state["out"], F.substring(source, (state["at"] + 1).cast("int"), F.length(source)))

    return docs.withColumn(text, F.aggregate(ordered, begin, step, finish))
