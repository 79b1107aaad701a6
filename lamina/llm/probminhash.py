"""Near-duplicate documents by ProbMinHash on weighted word shingles.

A shingle is five words, its weight how often the document has it. Each shingle starts a Poisson process whose
rate is its weight; the points fall on ``REGISTERS`` registers, every register keeps its earliest point and
remembers the shingle. A process stops as soon as its next point is later than the latest register (early
termination). The share of equal registers of two documents estimates their probability Jaccard similarity
(for shingles of equal weight, the Jaccard similarity of the sets).

Equal token sequences are grouped by hash first. Bands of registers propose candidates among the rest: inside a
bucket all members are compared with a pivot and linked; only members that are still in different groups go on
to the next pivots, four times as many each round, until every bucket holds one group or has no uncompared pair.
A group of n copies therefore costs about n comparisons, and no pair of different groups is skipped. A candidate
pair is verified with the exact similarity of its shingle weights.

Defined cases: documents without words take no part and are groups of their own; one with fewer than five words
is a single shingle; null texts count as empty; rows repeated with one ``doc_id`` share its group, and rows
whose ``doc_id`` is null are never grouped; other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lamina.llm.common import keep, small_side
from lamina.llm.graph import groups

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Pairs whose registers agree less are not verified; at a similarity of 0.8 the chance is below 1e-8.
LEAST_AGREEMENT = 0.6
MEMO = 300_000
_WORD = re.compile(r"\w+")
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """64-bit hashes of words, remembered, and of shingles."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def tokens(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def shingles(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingle hashes, how often each occurs)."""
        n = max(1, len(tokens) - WORDS + 1)
        code = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(tokens))):
            code = _mix(code * _GAMMA + tokens[k:k + n] + np.uint64(k + 1))
        found, weight = np.unique(code, return_counts=True)
        return found, weight.astype(np.float64)


def sketch(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every register the shingle whose process reached it first."""
    with np.errstate(over="ignore"):
        first = np.full(REGISTERS, np.inf)
        owner = np.zeros(REGISTERS, np.uint64)
        at = np.zeros(len(shingles))
        live = np.arange(len(shingles))
        drawn = 0
        while len(live):
            # Few processes draw several points at once.
            some = max(1, REGISTERS // len(live))
            seed = _mix(shingles[live, None] + _GAMMA * np.arange(drawn + 1, drawn + some + 1, dtype=np.uint64))
            drawn += some
            gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weights[live, None]
            times = at[live, None] + np.cumsum(gap, axis=1)
            place = (_mix(seed + _GAMMA) % np.uint64(REGISTERS)).astype(np.int64)
            t, p, s = times.ravel(), place.ravel(), np.repeat(shingles[live], some)
            order = np.argsort(t, kind="stable")[::-1]
            best = np.full(REGISTERS, np.inf)
            who = np.zeros(REGISTERS, np.uint64)
            best[p[order]], who[p[order]] = t[order], s[order]  # the earliest is written last
            better = best < first
            first[better], owner[better] = best[better], who[better]
            at[live] = times[:, -1]
            live = live[at[live] <= first.max()]
    return owner


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d), in one sort by the ratio b / a."""
    codes = np.union1d(a[0], b[0])
    x, y = np.zeros(len(codes)), np.zeros(len(codes))
    x[np.searchsorted(codes, a[0])], y[np.searchsorted(codes, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # Up to d's ratio (ties included) a's share is the larger one, beyond it b's.
    last = np.searchsorted(ratio, ratio, "right")
    below, above = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    common = (x > 0) & (y > 0)
    total = below[last[common]] / x[common] + (above[-1] - above[last[common]]) / y[common]
    return float((1 / total).sum())


_SHINGLER = Shingler()


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, registers, bands): two hashes of the token sequence and the sketch of each document with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = _SHINGLER.tokens(value)
                if not len(tokens):
                    continue
                owner = sketch(*Shingler.shingles(tokens))
                raw = tokens.tobytes()
                bands = [xxhash.xxh64_intdigest(owner[k * ROWS:(k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]
                rows.append((doc_id, xxhash.xxh64_intdigest(raw, 1) - (1 << 63), xxhash.xxh64_intdigest(raw, 2) - (1 << 63),
                             owner.astype("<u2").tobytes(), bands))
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "registers", "bands"])

    source = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, k1 long, k2 long, registers binary, bands array<long>")


def _weights(docs: DataFrame, ids: DataFrame, n_ids: int, text: str) -> DataFrame:
    """(doc_id, shingles, weights) of the named documents, each as one binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [Shingler.shingles(_SHINGLER.tokens(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([a.tobytes() for a, _ in pairs], pa.binary()),
                 pa.array([w.astype("<u4").tobytes() for _, w in pairs], pa.binary())], names=["doc_id", "shingles", "weights"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.join(small_side(ids, n_ids, 16), "doc_id", "left_semi").mapInArrow(
        run, "doc_id long, shingles binary, weights binary").dropDuplicates(["doc_id"])


@F.pandas_udf(BooleanType())
def _similar(sa: pd.Series, wa: pd.Series, sb: pd.Series, wb: pd.Series) -> pd.Series:
    def pair(s, w):
        return np.frombuffer(s, np.uint64), np.frombuffer(w, "<u4").astype(np.float64)

    return pd.Series([probability_jaccard(pair(a, x), pair(b, y)) >= SIMILARITY for a, x, b, y in zip(sa, wa, sb, wb)], dtype=bool)


@F.pandas_udf(BooleanType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    least = LEAST_AGREEMENT * REGISTERS
    return pd.Series([int((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).sum()) >= least for x, y in zip(a, b)], dtype=bool)


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id) of every document that has a near or exact copy; ``class_id`` is the smallest id of its group."""
    sketched = keep(sketches(docs, text), "sketches")
    same = sketched.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = same.select(F.col("rep").alias("doc_id"))
    # One row per distinct token sequence goes on.
    distinct = sketched.select("doc_id", "registers", "bands").join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = distinct.select("doc_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = keep(banded.join(shared, "bucket"), "buckets")
    ids = keep(members.select("doc_id").distinct(), "bucket-members")
    n_ids = ids.count()
    weights = keep(_weights(docs, ids, n_ids, text), "shingles")
    marks = keep(sketched.select("doc_id", "registers").join(small_side(ids, n_ids, 16), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "registers")

    links = None
    open_members = members.select("bucket", "doc_id", F.col("doc_id").alias("root"))
    pivots = 1
    while True:
        chosen = _pivots(open_members, pivots)
        pairs = chosen.join(open_members, "bucket").where(
            (F.col("pivot") != F.col("doc_id")) & (F.col("pivot_root") != F.col("root")))
        pairs = pairs.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
        near = (pairs.join(marks.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra")), "a")
                .join(marks.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb")), "b")
                .where(_agree("ra", "rb")).select("a", "b"))
        verified = (near.join(weights.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa")), "a")
                    .join(weights.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb")), "b")
                    .where(_similar("sa", "wa", "sb", "wb")).select("a", "b"))
        found = keep(verified if links is None else links.unionByName(verified), "links")
        rooted = groups(found)
        # Pivots have met every member; the others stay while their bucket holds several groups.
        rest = (open_members.drop("root").join(chosen.select("bucket", F.col("pivot").alias("doc_id")), ["bucket", "doc_id"], "left_anti")
                .join(rooted.withColumnRenamed("id", "doc_id"), "doc_id", "left")
                .select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root")))
        mixed = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
        left = keep(rest.join(mixed, "bucket", "left_semi"), "open-buckets")
        links, open_members, pivots = found, left, pivots * 4
        if not left.limit(1).count():
            break

    copies = sketched.select("doc_id", "k1", "k2").join(same, ["k1", "k2"])
    classed = copies.join(rooted.withColumnRenamed("id", "rep"), "rep", "left")
    out = classed.select("doc_id", F.coalesce("root", "rep").alias("class_id"), "n", F.col("root").isNotNull().alias("linked"))
    return out.where((F.col("n") > 1) | F.col("linked")).select("doc_id", "class_id").distinct()


def _pivots(members: DataFrame, most: int) -> DataFrame:
    """(bucket, pivot, pivot_root): up to ``most`` members a bucket, those of its smaller groups first."""
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot"))
    if most == 1:
        best = sizes.groupBy("bucket").agg(F.max_by(F.struct("pivot", "root"), F.struct("size", -F.col("pivot"))).alias("p"))
        return best.select("bucket", F.col("p.pivot").alias("pivot"), F.col("p.root").alias("pivot_root"))
    # One pivot a group and round; small groups are done soonest.
    order = Window.partitionBy("bucket").orderBy("size", "pivot")
    return (sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
            .select("bucket", "pivot", F.col("root").alias("pivot_root")))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``class_id`` to every row: the smallest ``doc_id`` of its group, its own without copies."""
    found = keep(near_groups(docs, text), "near-groups")
    joined = docs.drop("class_id").join(small_side(found, found.count(), 24), "doc_id", "left")
    return joined.select(*[c for c in docs.columns if c != "class_id"], F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with only the first document of every group."""
    found = keep(near_groups(docs, text).where(F.col("doc_id") != F.col("class_id")).select("doc_id"), "copies")
    return docs.join(small_side(found, found.count(), 16), "doc_id", "left_anti")
