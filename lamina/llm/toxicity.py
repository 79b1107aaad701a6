"""Toxicity by a weighted finite-state grammar over clauses.

Three small transducers are composed into one machine. The first tracks negation (its scope is the next
words), the second reported speech (to the end of the clause), the third a target of address. Words enter
as classes: insult, threat, target, negation, report or other. The machine turns them into events such as
``insult``, ``insult+target``, ``insult+negated`` or ``threat+target+reported``. A clause scores the weight
of each insulting word times the factor of its event, so an insult that is denied or quoted counts less.

What is learned: which words and word beginnings insult, how much they weigh (log odds), how much the
events count, and a small logistic correction for repetition and text length, from labelled rows only. Learning reads at most about ``max_labelled`` rows, picked by a hash
of the id, whatever the size of the corpus; scoring reads every row and whole texts.

Defined cases: a null text counts as empty; a text without a matched clause gets the base rate of such
texts; labels that are null or belong to no document are ignored, repeated ones count as toxic if any is;
without labels the fixed word list alone decides; repeated rows are scored one by one; other columns pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Learn from about this many labelled rows.
MAX_LABELLED = 20_000
#: A word or beginning becomes a terminal with this many toxic texts and this margin (log odds less two errors).
MIN_TOXIC = 5
MIN_MARGIN = 0.5
#: Terminals must also add this much to what earlier ones cover (a text counts half each time it is covered).
MIN_GAIN = 5.0
BEGINNINGS = range(3, 9)

# The closed word classes of the grammar and the general word list.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile "
    "dumb idiota imbécil estúpido estúpida idiotin dummkopf abschaum trottel imbécile crétin connard stupide"
).split()
THREATS = "kill killing hurt destroy umbringen töten vernichten tuer détruire matar destruir".split()
TARGETS = "you your he she they du ihr sie euch vous tu toi ils usted tú vosotros ustedes ellos".split()
NEGATIONS = "not never no nicht kein keine nie ne pas jamais nunca jamás ni isn aren wasn".split()
REPORTS = "said says wrote quoted called claims sagte schrieb nannte dit disait écrit dijo escribió llamó".split()
#: Share of an event's weight before any label is seen, and how many labelled texts that belief is worth.
PRIOR_FACTOR = {"negated": 0.3, "reported": 0.5, "target": 1.2}
PRIOR_TEXTS = 10
PRIOR_WEIGHT = 4.0

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"«»“”]")
_WORD = re.compile(r"[^\W\d_]+")
NEGATION_REACH = 3


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer; a symbol without an own rule stays as it is."""

    start: int
    rules: dict[tuple[int, str], tuple[int, str]]
    #: State after a symbol that has no rule.
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.rules.get((state, symbol)) or (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``."""
    numbers = {(first.start, second.start): 0}
    rules, todo = {}, [(first.start, second.start)]
    while todo:
        pair = todo.pop()
        for symbol in alphabet:
            a, middle = first.step(pair[0], symbol)
            b, out = second.step(pair[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                todo.append((a, b))
            rules[numbers[pair], symbol] = (numbers[a, b], out)
    return Transducer(0, rules)


ALPHABET = ["insult", "threat", "target", "negation", "report", "word", "end"]
_LOADED = ("insult", "threat")


def grammar() -> Transducer:
    """Negation, reported speech and target, composed in this order."""
    negation: dict = {}
    for left in range(NEGATION_REACH + 1):
        negation[left, "negation"] = (NEGATION_REACH, "word")
        negation[left, "end"] = (0, "end")
        for kind in _LOADED:
            negation[left, kind] = (max(0, left - 1), f"{kind}+negated" if left else kind)
    n = Transducer(0, negation, {k: max(0, k - 1) for k in range(NEGATION_REACH + 1)})
    after_n = [f"{k}{s}" for k in _LOADED for s in ("", "+negated")]
    report: dict = {(0, "report"): (1, "word"), (1, "report"): (1, "word"), (1, "end"): (0, "end")}
    report |= {(1, x): (1, f"{x}+reported") for x in after_n}
    r = Transducer(0, report)
    after_r = after_n + [f"{x}+reported" for x in after_n]
    target: dict = {(0, "target"): (1, "word"), (1, "target"): (1, "word"), (1, "end"): (0, "end")}
    target |= {(1, x): (1, f"{x}+target") for x in after_r}
    return compose(compose(n, r, ALPHABET), Transducer(0, target), ALPHABET)


@dataclass
class Model:
    """Terminals (whole words and beginnings) with log-odds weights, event factors and base rates."""

    words: dict[str, float]
    beginnings: dict[str, float]
    factors: dict[str, float]
    prior: float
    unmatched: float
    correction: tuple[float, ...] = (0.0,) * 6


class Reader:
    """Runs the grammar over texts; remembers the classes of words it has met."""

    MEMO = 500_000

    def __init__(self, model: Model):
        self.model, self.machine = model, grammar()
        closed = {"threat": THREATS, "target": TARGETS, "negation": NEGATIONS, "report": REPORTS}
        self.closed = {w: (kind, PRIOR_WEIGHT if kind == "threat" else 0.0) for kind, ws in closed.items() for w in ws}
        self.memo: dict[str, tuple[str, float]] = {}
        self.loaded: set[str] = set()

    def classify(self, word: str) -> tuple[str, float]:
        weight = self.model.words.get(word, 0.0)
        for n in BEGINNINGS:
            if n < len(word):
                weight = max(weight, self.model.beginnings.get(word[:n], 0.0))
        return ("insult", weight) if weight > 0 else self.closed.get(word, ("word", 0.0))

    def events(self, text: str) -> Counter:
        """Weight of every event of the text."""
        lower = text.lower()
        words = set(_WORD.findall(lower))
        if len(self.memo) > self.MEMO:
            self.memo.clear()
            self.loaded.clear()
        for word in words.difference(self.memo):
            self.memo[word] = kind = self.classify(word)
            if kind[0] in _LOADED:
                self.loaded.add(word)
        found: Counter = Counter()
        if self.loaded.isdisjoint(words):
            return found
        state, step, memo = self.machine.start, self.machine.step, self.memo
        for token in _TOKEN.findall(lower):
            kind, weight = memo[token] if token in memo else ("end", 0.0)
            state, out = step(state, kind)
            if weight and kind in _LOADED:
                found[out] += weight
        # A threat needs someone it is addressed to.
        for event in [e for e in found if e.startswith("threat") and "target" not in e]:
            del found[event]
        return found

    def features(self, text: str) -> tuple[float, ...] | None:
        """What the correction sees, the evidence of the matched clauses first; None without a match."""
        found = self.events(text)
        if not found:
            return None
        words = _WORD.findall(text.lower())
        loaded = [w for w in words if w in self.loaded]
        evidence = min(20.0, sum(w * self.factor(e) for e, w in found.items()))
        top = sorted((self.memo[w][1] for w in set(loaded)), reverse=True)
        return (evidence, 1.0, top[0], math.log(len(loaded)), math.log(len(top)), math.log(len(words)))

    def score(self, text: str) -> float:
        x = self.features(text)
        if x is None:
            return _logistic(self.model.unmatched)
        return _logistic(self.model.prior + x[0] + sum(a * b for a, b in zip(self.model.correction, x)))

    def factor(self, event: str) -> float:
        return self.model.factors.get(event) or prior_factor(event)


def prior_factor(event: str) -> float:
    out = 1.0
    for part in event.split("+")[1:]:
        out *= PRIOR_FACTOR[part]
    return out


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: F.Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of about ``max_labelled`` labelled documents that ``allowed`` admits, equal texts once."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    marks = marks.where(allowed)
    n = marks.count()
    # Hash values are spread evenly, so this share of their range holds max_labelled rows.
    share = min(1.0, max_labelled / n) if n else 1.0
    picked = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The picked labels are bounded by max_labelled, so they may be broadcast.
    rows = texts.join(F.broadcast(picked), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("same")).agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("same")


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if n < len(w)}


def fit(rows: DataFrame) -> Model:
    """Learn a model from (text, toxic) rows; see :func:`training_rows` for their bound."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                (pos if toxic else neg).update(_terms(text))
        terms = list(pos.keys() | neg.keys())
        yield pd.DataFrame({"term": terms, "pos": [pos[t] for t in terms], "neg": [neg[t] for t in terms]})

    counts = rows.mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    candidates = {}
    # Terms that stand out in a bounded sample: their number is bounded too.
    for r in counts.where((F.col("pos") >= MIN_TOXIC) & (F.col("pos") * (n_neg + 1) > F.col("neg") * (n_pos + 1))).toLocalIterator():
        weight = log_odds(r["pos"], r["neg"], n_pos, n_neg)
        margin = weight - 2 * math.sqrt(1 / (r["pos"] + 0.5) + 1 / (r["neg"] + 0.5))
        if margin > MIN_MARGIN:
            candidates[r["term"]] = (margin, weight)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"terms": [sorted(_terms(text) & candidates.keys())]})

    held: dict[str, list[int]] = {t: [] for t in candidates}
    for number, row in enumerate(rows.where("toxic = 1").select("text").mapInPandas(cover, "terms array<string>").collect()):
        for term in row["terms"]:
            held[term].append(number)
    worth, chosen = Counter(), {}
    for term in sorted(candidates, key=lambda t: (-candidates[t][0], len(t), t)):
        gain = sum(0.5 ** worth[d] for d in held[term])
        if gain >= MIN_GAIN:
            chosen[term] = candidates[term][1]
            worth.update(held[term])
    words = {w: PRIOR_WEIGHT for w in INSULTS} | {t: w for t, w in chosen.items() if t[-1] != "*"}
    model = Model(words, {t[:-1]: w for t, w in chosen.items() if t[-1] == "*"}, {},
                  log_odds(n_pos, n_neg, 1, 1), math.log(0.02))

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Reader(model), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for event in reader.events(text) or ["none"]:
                    seen[event, int(toxic)] += 1
        yield pd.DataFrame([(e, t, n) for (e, t), n in seen.items()], columns=["event", "toxic", "n"])

    seen = {(r["event"], r["toxic"]): r["n"] for r in rows.mapInPandas(observe, "event string, toxic int, n long")
            .groupBy("event", "toxic").agg(F.sum("n").alias("n")).collect()}
    plain = max(1.0, log_odds(seen.get(("insult", 1), 0), seen.get(("insult", 0), 0), n_pos, n_neg))
    for event in {e for e, _ in seen} - {"none"}:
        pos, neg = seen.get((event, 1), 0), seen.get((event, 0), 0)
        observed = max(0.0, min(1.2, log_odds(pos, neg, n_pos, n_neg) / plain))
        model.factors[event] = ((pos + neg) * observed + PRIOR_TEXTS * prior_factor(event)) / (pos + neg + PRIOR_TEXTS)
    model.unmatched = min(-0.1, math.log((seen.get(("none", 1), 0) + 0.5) / (seen.get(("none", 0), 0) + 25)))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for batch in batches:
            rows = [(x, int(t)) for x, t in zip(map(reader.features, batch["text"]), batch["toxic"]) if x is not None]
            yield pd.DataFrame({"x": [list(x) for x, _ in rows], "toxic": [t for _, t in rows]})

    # At most one short vector per sampled text.
    matched = rows.mapInPandas(describe, "x array<double>, toxic int").collect()
    if matched:
        x, y = np.array([r["x"] for r in matched]), np.array([r["toxic"] for r in matched], float)
        model.correction = tuple(_correction(x, y, model.prior + x[:, 0]))
    return model


def _correction(x: np.ndarray, y: np.ndarray, offset: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic coefficients beside a fixed offset, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), slope)
        beta += move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return beta


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model)
        for batch in batches:
            yield pd.Series([reader.score(t or "") for t in batch], dtype="float64")

    scored = docs.withColumn("score", run(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
