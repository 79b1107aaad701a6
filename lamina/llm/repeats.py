"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier. Equal strings of that length choose the
same anchor inside them: the place of the smallest hash among their ``GRAM``-byte substrings. So a string can only
repeat if its anchor's substring occurs twice, and only such anchors, about one in forty bytes to begin with, are
sorted: each with the bytes around it, once for all strings that chose it (a block).

Tasks sort the suffixes that start at the anchors of their blocks and front-code them into runs, one for each
reducer. A reducer merges its runs with a loser tree that carries the length of the prefix every contender shares
with the last winner; two contenders are compared from where their known prefixes end, and a front-coded run
supplies that length for its next suffix. Neighbours in the merged order that share less than a string needs from
its anchor on rule the string out; the rest of a group is decided in document order by the bytes themselves.

Blocks that are equal as a whole are collapsed in the task that finds them, so thousands of copies reach a
reducer as one block a task. No more than blocks with the anchor's substring in common meet in a reducer group.

Defined cases: a null text counts as empty; rows with equal ``doc_id`` and text are one document; of several texts
with one ``doc_id`` the hash of the text decides which is earlier; a null ``doc_id`` comes before all others; texts
shorter than ``LENGTH`` stay whole; other columns pass and existing result columns are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import keep, small_side

LENGTH = 100
GRAM = 32
CHUNK_BYTES = 512 << 10
RUN_BLOCKS = 30_000
PART_BLOCKS = 200_000
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
_BASE = 0x9E3779B97F4A7C15
_FIRST_ID = -(1 << 63)


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place, by doubling the covered length."""
    x, factor, width = buf.astype(np.uint64) + np.uint64(1), _BASE, 1
    while width < GRAM:
        x = x[:-width] * np.uint64(factor) + x[width:]
        factor = factor * factor & (1 << 64) - 1
        width *= 2
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Leftmost place of the least value in every window."""
    val, at, width = values, np.arange(len(values), dtype=np.int32), 1
    while width < window:
        step = min(width, window - width)
        right = val[step:] < val[:-step]
        val, at = np.where(right, val[step:], val[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    return at


def find_blocks(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, anchor, hash) of all blocks of texts laid end to end."""
    if len(buf) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = _rolling(buf)
    anchor = _least(hashes, LENGTH - GRAM + 1)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, "right")
    inside = starts + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    starts, text, anchor = starts[inside], text[inside], anchor[inside]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return text[first], starts[first], starts[last], anchor[first].astype(np.int64), hashes[anchor[first]].view(np.int64)


def _chunks(batch: pa.RecordBatch):
    """Texts of a batch as bytes, in chunks of bounded size; a longer text is a chunk of its own."""
    rows, size = [], 0
    for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
        raw = text.encode()
        if rows and size + len(raw) > CHUNK_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((doc_id, mark, raw))
        size += len(raw)
    if rows:
        yield rows


def _located(rows: list[tuple]) -> tuple:
    buf = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    ends = np.cumsum([len(r[2]) for r in rows])
    return buf, ends, find_blocks(buf, ends)


def _source(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("doc_id"),
                       F.xxhash64(whole).alias("mark"), whole.alias("text"))


def repeated_anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram): hashes of anchors that occur more than once in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _chunks(batch):
                gram, n = np.unique(_located(rows)[2][4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.minimum(n, 2).astype(np.int32))], names=["gram", "n"])

    counted = _source(docs, text).mapInArrow(run, "gram long, n int")
    return counted.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


_BLOCK = "gram long, doc_id long, mark long, start long, n int, at int, raw binary"


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a block: its anchor's hash, its first string's start, how many strings, the anchor's offset, the bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _chunks(batch):
                buf, ends, (text_no, first, last, anchor, gram) = _located(rows)
                raw = buf.tobytes()
                base = np.concatenate([[0], ends])[text_no]
                ids = np.array([r[0] for r in rows], np.int64)
                marks = np.array([r[1] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram), pa.array(ids[text_no]), pa.array(marks[text_no]), pa.array(first - base),
                    pa.array((last - first + 1).astype(np.int32)), pa.array((anchor - first).astype(np.int32)),
                    pa.array([raw[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())], pa.binary()),
                ], names=["gram", "doc_id", "mark", "start", "n", "at", "raw"])

    return _source(docs, text).mapInArrow(run, _BLOCK)


_HEAD = struct.Struct("<qqqiiHHH")


def write_run(items: list[tuple]) -> bytes:
    """Front-code blocks sorted by their suffix (the bytes from the anchor on).

    An item is (suffix, prefix, doc_id, mark, start, n); of the suffix only what the one before lacks is written."""
    out, before = [], b""
    for suffix, prefix, doc_id, mark, start, n in items:
        same = common(before, suffix, 0)
        out += [_HEAD.pack(doc_id, mark, start, n, len(prefix), same, len(suffix) - same, 0), prefix, suffix[same:]]
        before = suffix
    return b"".join(out)


def read_run(data: bytes) -> Iterator[tuple]:
    """(prefix length shared with the item before, item) in order."""
    at, before = 0, b""
    while at < len(data):
        doc_id, mark, start, n, left, same, fresh, _ = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        prefix = data[at:at + left]
        before = before[:same] + data[at + left:at + left + fresh]
        at += left + fresh
        yield same, (before, prefix, doc_id, mark, start, n)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes; halving, each comparison in C."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """(prefix length shared with the item before, item) of all runs in order, by a loser tree.

    Every contender knows how much it shares with the last winner. Of two, the one that shares more is smaller; only
    if they share equally much are they compared, from that length on, and the loser then knows what it shares
    with the winner."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    shares = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), with the loser's share set."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = heads[a][1][0], heads[b][1][0]
        same = common(x, y, shares[a])
        first = x[same:same + 1] <= y[same:same + 1]
        win, lose = (a, b) if first else (b, a)
        shares[lose] = same
        return win, lose

    def climb(leaf: int) -> int:
        winner, node = leaf, (leaf + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = winner
                return -1
            winner, losers[node] = play(winner, losers[node])
            node //= 2
        return winner

    top = -1
    for leaf in range(k):
        top = max(top, climb(leaf)) if k > 1 else 0
    while k and heads[top] is not None:
        yield shares[top], heads[top][1]
        heads[top] = next(runs[top], None)
        shares[top] = heads[top][0] if heads[top] is not None else 0
        top = climb(top) if k > 1 else 0


def _decide(group: list[tuple], shares: list[int]) -> Iterator[tuple]:
    """(doc_id, mark, from, to) of the removed stretches of blocks with one anchor substring.

    ``shares[i]`` is the common prefix of block i's suffix with that of block i - 1."""
    reach = [max(shares[i], shares[i + 1] if i + 1 < len(group) else 0) for i in range(len(group))]
    whole, seen = set(), set()
    for i in sorted(range(len(group)), key=lambda i: group[i][2:5]):
        suffix, prefix, doc_id, mark, start, n = group[i]
        key = (len(prefix), n, prefix, suffix)
        if key in whole:
            yield doc_id, mark, start, start + n - 1 + LENGTH
            continue
        whole.add(key)
        raw, at = prefix + suffix, len(prefix)
        # String j takes LENGTH - (at - j) bytes from the anchor on; a neighbour must share as many.
        begin = None
        for j in range(n + 1):
            gone = False
            if j < n and LENGTH - (at - j) <= reach[i]:
                string = (at - j, raw[j:j + LENGTH])
                gone = string in seen
                seen.add(string)
            if gone and begin is None:
                begin = j
            elif not gone and begin is not None:
                yield doc_id, mark, start + begin, start + j - 1 + LENGTH
                begin = None


_GONE = "doc_id long, mark long, begin long, end long"


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, mark, begin, end): stretches to remove; ``mark`` is the hash of the document's text."""
    twice = keep(repeated_anchors(docs, text), "anchors")
    n_twice = twice.count()
    found = blocks(docs, text).join(small_side(twice, n_twice, 8), "gram")
    parts = max(1, -(-n_twice * 4 // PART_BLOCKS))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        size = 0

        def flush():
            for part, items in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([write_run(sorted(items.values()))], pa.binary())], names=["part", "run"])

        for batch in batches:
            gone = []
            columns = [batch.column(c).to_pylist() for c in ("gram", "doc_id", "mark", "start", "n", "at", "raw")]
            for gram, doc_id, mark, start, n, at, raw in zip(*columns):
                items = held.setdefault(gram % parts, {})
                item = (raw[at:], raw[:at], doc_id, mark, start, n)
                other = items.get((raw, at, n))
                if other is None:
                    items[raw, at, n] = item
                    size += 1
                    continue
                # Of equal blocks the later one is certainly repeated as a whole.
                if item[2:5] < other[2:5]:
                    items[raw, at, n], item = item, other
                if item[2:5] != other[2:5] or item is other:
                    gone.append(item[2:])
            if gone:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([b"".join(struct.pack("<qqqi", *g) for g in gone)], pa.binary())],
                    names=["part", "run"])
            if size >= RUN_BLOCKS:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    # Runs are few and large: one a reducer and about RUN_BLOCKS blocks.
    runs = found.mapInArrow(sort, "part int, run binary")
    runs = keep(runs, "suffix-runs")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group, shares = [], [], []
        for same, item in merge_runs([read_run(r) for r in pdf["run"]]):
            if same < GRAM and group:
                if len(group) > 1:
                    out += _decide(group, shares)
                group, shares = [], []
            shares.append(same if group else 0)
            group.append(item)
        if len(group) > 1:
            out += _decide(group, shares)
        return pd.DataFrame(out, columns=["doc_id", "mark", "begin", "end"], dtype="int64")

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run"):
                g = np.frombuffer(run.as_py(), np.dtype([("d", "<i8"), ("m", "<i8"), ("s", "<i8"), ("n", "<i4")]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g["d"]), pa.array(g["m"]), pa.array(g["s"]), pa.array(g["s"] + g["n"] - 1 + LENGTH)],
                    names=["doc_id", "mark", "begin", "end"])

    merged = runs.where("part >= 0").groupBy("part").applyInPandas(merge, _GONE)
    return merged.unionAll(runs.where("part < 0").select("run").mapInArrow(at_once, _GONE))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes that stay) to every row."""
    gone = keep(removed(docs, text).groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("begin", "end")).alias("_gone")), "removed")
    size = gone.select(F.sum(F.size("_gone") * 16 + 48)).first()[0] or 0
    plain = docs.drop(*RESULT)
    keyed = plain.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID))).withColumn(
        "_mark", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(small_side(gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_gone"), size, 1),
                        ["_id", "_mark"], "left").drop("_id", "_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("_gone").to_pylist()):
                raw = (value or "").encode()
                kept, at, n_spans, lost = [], 0, 0, 0
                stretches = []
                for b, e in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if stretches and b <= stretches[-1][1]:
                        stretches[-1][1] = max(stretches[-1][1], e)
                    else:
                        stretches.append([b, e])
                for b, e in stretches:
                    kept.append(raw[at:b])
                    at, n_spans, lost = e, n_spans + 1, lost + e - b
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((len(raw), lost, n_spans, hashlib.sha256(rest).hexdigest(), rest))
            names = [n for n in batch.schema.names if n != "_gone"]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(cols[i], pa.int64()) for i in range(3)),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=[*names, *RESULT])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema]
                       + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"])
    return joined.mapInArrow(run, schema)
