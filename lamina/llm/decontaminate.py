"""Benchmark decontamination by templates: re-parameterised questions match as well as verbatim ones.

Numbers, names and units become typed placeholders, and windows of the resulting tokens are joined by hash.
Matched windows of one document and item that lie at the same shift must fill their slots consistently: equal
values of the item stand for equal values of the document and the other way round.

Everything is a built-in Spark expression. Windows are only built where they can match: around the rarest word
of an item window (its anchor). A document needs ``m`` windows of an item to be contaminated, so it holds one of
any ``W - m + 1`` of the item's ``W`` windows: a first pass looks for the best-anchored so many windows and yields
candidate documents, a second one matches all windows in those. Only hits are shuffled, never texts.

Defined cases: null or empty texts and items match nothing; an item shorter than a window is one window of its
own length; a window without a literal word is left out, but an item that has no literal word at all matches by its
values verbatim; equal windows of several items match each of them;
repeated item rows count once, and texts that share an ``item_id`` are matched each on their own;
rows repeated with one ``doc_id`` count as one document; other columns are ignored by :func:`matches` and kept
by :func:`clean`, which also keeps rows whose ``doc_id`` is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import keep, small_side

WINDOW = 8
#: A document is contaminated by an item with this share of its windows, or this many of them.
SHARE = 0.5
ENOUGH = 6

# The typed placeholders' word lists.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years percent eur euro euros usd dollar dollars cent cents km/h mph kmh celsius "
    "grad stunde stunden minuten tage jahre heure heures jours ans hora horas días años"
).split()
#: Units only right after a number: words of their own otherwise.
SHORT_UNITS = ("in", "m", "g", "t", "l", "s", "h")
_WORD = r"(?:[0-9]++(?:[.,][0-9]++)*+|[\p{L}][\p{L}\p{N}]*+|[\p{N}]++)"
_RAW = r"[^\p{L}\p{N}]*+(?:[0-9]++(?:[.,][0-9]++)*+|[\p{L}][\p{L}\p{N}]*+|[\p{N}]++)"


#: Longest list of anchors that is written into the plan.
SHORT_LIST = 20_000
_SEPARATORS = r"^[^\p{L}\p{N}]++"


def raw_tokens(text: Column) -> Column:
    """Words and numbers, each with the separators before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RAW), F.lit(0))


def tokens(raw: Column, first: Column, item: bool = False) -> Column:
    """array of (canon, value, other, word): a placeholder and what it stands for, or a lower-case word and an empty value.

    ``other`` is a second placeholder that the token may be: a capitalised word that opens a sentence may be a name,
    and the first word of an item a unit after a number of the document.
    ``first`` is the place of the first raw token in its text; the text's first word opens a sentence. Whether a
    short word is a unit depends on the token before, so the first token of a slice is only right at a text's start."""
    def one(token, i):
        word = F.regexp_replace(token, _SEPARATORS, "")
        measured = token.rlike(r"^[\s\u00a0-]*\p{L}") & F.coalesce(F.get(raw, i - 1).rlike("[0-9]$"), F.lit(False))
        opens = (first + i == 0) | token.rlike(r"^[^\p{L}\p{N}]*?[.!?:\n]")
        canon = (F.when(word.rlike("^[0-9]"), "<number>")
                 .when(F.lower(word).isin(*UNITS) & (~F.lower(word).isin(*SHORT_UNITS) | measured), "<unit>")
                 .when(word.rlike(r"^\p{Lu}\p{Ll}") & ~opens, "<name>")
                 .otherwise(F.lower(word)))
        other = F.when(~canon.startswith("<") & word.rlike(r"^\p{Lu}\p{Ll}"), "<name>")
        if item:
            other = F.when((first + i == 0) & ~canon.startswith("<") & F.lower(word).isin(*SHORT_UNITS), "<unit>").otherwise(other)
        return F.struct(canon.alias("canon"), F.when(canon.startswith("<"), F.lower(word)).otherwise("").alias("value"),
                        other.alias("other"), F.lower(word).alias("word"))

    return F.transform(raw, one)


def readings(window: Column) -> Column:
    """Every reading of a window as an array of (canon, value), the one without second placeholders first."""
    def longer(done, t):
        plain = F.struct(t["canon"].alias("canon"), t["value"].alias("value"))
        second = F.struct(t["other"].alias("canon"), t["word"].alias("value"))
        choices = F.when(t["other"].isNull(), F.array(plain)).otherwise(F.array(plain, second))
        return F.flatten(F.transform(choices, lambda c: F.transform(done, lambda d: F.concat(d, F.array(c)))))

    kind = "array<array<struct<canon:string,value:string>>>"
    single = F.array(F.transform(window, lambda t: F.struct(t["canon"].alias("canon"), t["value"].alias("value")))).cast(kind)
    several = F.aggregate(window, F.array(F.array()).cast(kind), lambda done, t: longer(done, t).cast(kind))
    return F.when(F.exists(window, lambda t: t["other"].isNotNull()), several).otherwise(single)


def _literals(window: Column) -> Column:
    return F.filter(window, lambda t: ~t["canon"].startswith("<"))


def _template(window: Column) -> Column:
    """What equal windows have in common: placeholders and words, or the values where there is no word."""
    return F.when(F.size(_literals(window)) > 0, F.array_join(F.transform(window, lambda t: t["canon"]), " ")).otherwise(
        F.concat(F.lit("= "), F.array_join(F.transform(window, lambda t: t["value"]), " ")))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, variant, at, length, words, anchor, n_windows, place, plain, window, template, code) for every reading of a
    window that can match; ``plain`` is the one without second placeholders, ``variant`` stands for the text.

    ``words`` must all stand in a document that matches, ``anchor`` is one of them. ``place`` numbers the windows of
    an item from the best anchor on."""
    distinct = items.select("item_id", "text").distinct().withColumn("variant", F.xxhash64("text"))
    raw = distinct.select("item_id", "variant", raw_tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    taken = raw.select("item_id", "variant", tokens(F.col("raw"), F.lit(0), True).alias("tokens"))
    taken = taken.withColumn("worded", F.size(_literals(F.col("tokens"))) > 0)
    n = F.size("tokens")
    length = F.least(n, F.lit(WINDOW))
    spread = taken.withColumn("length", length).withColumn("at", F.explode(F.sequence(F.lit(0), n - length)))
    cut = spread.withColumn("window", F.slice("tokens", F.col("at") + 1, F.col("length"))).drop("tokens")
    literal = _literals(F.col("window"))
    # Words that are literal in every reading; if there are none, only readings with the anchor can match.
    strict = F.filter(literal, lambda t: t["other"].isNull())
    cut = cut.where((F.size(literal) > 0) | ~F.col("worded")).withColumn("words", F.array_distinct(
        F.when(F.size(strict) > 0, F.transform(strict, lambda t: t["canon"])).when(F.col("worded"), F.transform(literal, lambda t: t["canon"]))
        .otherwise(F.transform("window", lambda t: t["value"]))))
    # The anchor is the word that fewest items hold, the longer of equally rare ones.
    words = cut.select("item_id", "variant", "at", F.explode("words").alias("word"))
    rarity = words.groupBy("word").agg(F.countDistinct("item_id").alias("items"))
    ranked = words.join(rarity, "word").groupBy("item_id", "variant", "at").agg(
        F.min(F.struct("items", (-F.length("word")).alias("short"), "word")).alias("best"))
    item = Window.partitionBy("item_id", "variant")
    placed = cut.join(ranked, ["item_id", "variant", "at"]).select(
        *cut.columns, F.col("best.word").alias("anchor"), F.count("*").over(item).alias("n_windows"),
        F.row_number().over(item.orderBy("best", "at")).alias("place"))
    read = placed.select(*[c for c in placed.columns if c != "window"], F.posexplode(readings(F.col("window"))).alias("reading", "window"))
    read = read.where(~F.col("worded") | F.exists("window", lambda t: t["canon"] == F.col("anchor")))
    return read.withColumn("plain", F.col("reading") == 0).drop("worded", "reading").withColumn(
        "template", _template(F.col("window"))).withColumn("code", F.xxhash64("template"))


def needed(n_windows: Column) -> Column:
    """Matched windows that make a document contaminated."""
    return F.least(F.lit(ENOUGH), F.ceil(n_windows * SHARE))


def _found(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Windows of ``docs`` that equal one of ``known``: its columns, ``doc_id``, ``start`` and the window ``met``."""
    known = keep(known, "known-windows")
    n_known = known.count()
    source = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    placed = source.select("doc_id", raw_tokens(F.col("text")).alias("raw")).select("doc_id", "raw", F.posexplode("raw").alias("pos", "token"))
    lengths = known.select("anchor", "length").distinct()
    hits = (placed.withColumn("anchor", F.lower(F.regexp_replace("token", _SEPARATORS, ""))).drop("token")
            .join(small_side(lengths, n_known, 64), "anchor"))
    # Every window of that length around the anchor and the token before; from here on a row holds these tokens only,
    # not the text's.
    first = F.greatest(F.lit(0), F.col("pos") - F.col("length") + 1)
    last = F.least(F.col("pos"), F.size("raw") - F.col("length"))
    begin = F.greatest(F.lit(0), first - 1)
    near = hits.select("doc_id", "length", first.alias("first"), last.alias("last"), begin.alias("begin"),
                       F.slice("raw", begin + 1, F.col("length") * 2).alias("near")).where("first <= last")
    read = near.select("doc_id", "length", "first", "last", "begin", tokens(F.col("near"), F.col("begin")).alias("near"))
    starts = read.withColumn("start", F.explode(F.sequence("first", "last")))
    windows = starts.select("doc_id", "start", F.slice("near", F.col("start") - F.col("begin") + 1, F.col("length")).alias("met"))
    windows = windows.select("doc_id", "start", F.explode(readings(F.col("met"))).alias("met"))
    windows = windows.withColumn("code", F.xxhash64(_template(F.col("met"))))
    return windows.join(small_side(known, n_known, 1024), "code").where(F.col("template") == _template(F.col("met")))


def _candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of the documents that hold the anchor and all ``words`` of one of the best-anchored windows.

    With more than ``SHORT_LIST`` anchors the other words are not looked at: more candidates, the same result."""
    best = known.where(F.col("place") <= F.col("n_windows") - needed(F.col("n_windows")) + 1)
    asked = best.where("plain").groupBy("anchor").agg(F.collect_set("words").alias("asked"))
    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"))
    n_known, n_asked = known.count(), asked.count()
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    if n_asked > SHORT_LIST:
        return source.select("doc_id", F.explode(words).alias("anchor")).join(asked, "anchor", "left_semi").select("doc_id").distinct()
    # Each anchor of a text once, so that a long text is repeated for few rows only.
    short = F.array(*[F.lit(r["anchor"]) for r in asked.select("anchor").collect()]).cast("array<string>")
    present = source.select("doc_id", "text", F.explode(F.array_intersect(words, short)).alias("anchor"))
    hits = present.join(small_side(asked, n_known, 1024), "anchor")
    whole = F.exists("asked", lambda window: F.forall(window, lambda word: F.contains(F.col("text"), word)))
    return hits.where(whole).select("doc_id").distinct()


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, share): contaminated documents with the items found in them."""
    known = keep(item_windows(items), "item-windows")
    candidates = keep(_candidates(docs, known), "candidate-documents")
    joined = _found(docs.join(small_side(candidates, candidates.count(), 16), "doc_id", "left_semi"), known)
    slots = F.filter(
        F.zip_with("window", "met", lambda a, b: F.struct(a["canon"].alias("kind"), a["value"].alias("asked"), b["value"].alias("met"))),
        lambda s: s["kind"].startswith("<"))
    hits = joined.select("doc_id", "item_id", "variant", "at", "n_windows", "plain", (F.col("start") - F.col("at")).alias("shift"), slots.alias("slots"))
    # One alignment of an item in a document: at most one row a window of the item, the most literal reading. Sentence
    # openings that are read as names must agree like names; an alignment also counts by its plain readings alone.
    levels = hits.withColumn("level", F.explode(F.when(F.col("plain"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    hits = levels.groupBy("doc_id", "item_id", "variant", "shift", "level", "at").agg(
        F.max("n_windows").alias("n_windows"), F.min(F.struct(F.size("slots").alias("n"), "slots"))["slots"].alias("slots"))
    aligned = hits.groupBy("doc_id", "item_id", "variant", "shift", "level").agg(
        F.count("*").alias("windows"), F.max("n_windows").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))

    def distinct(*fields: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*[s[f].alias(f) for f in fields]))))

    consistent = (distinct("kind", "asked") == F.size("slots")) & (distinct("kind", "met") == F.size("slots"))
    enough = aligned.where(consistent & (F.col("windows") >= needed(F.col("n_windows"))))
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", (-F.col("n_windows")).alias("n"))).alias("best"))
    return best.select("doc_id", "item_id", "best.windows", (F.col("best.windows") / -F.col("best.n")).alias("share"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = keep(matches(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(small_side(bad, bad.count(), 16), "doc_id", "left_anti")
