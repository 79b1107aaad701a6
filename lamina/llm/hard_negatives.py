"""Hard negatives by inner product, searched in a packed R-tree (sort-tile-recursive).

Packing: rows are sorted by label, by tiles of two coordinates and by a third one, and consecutive runs of at most
``BLOCK`` rows of one label become blocks; inside a block the same recursion over further coordinates packs leaves of
``LEAF`` rows. Blocks and leaves carry minimum bounding boxes. Tile borders come from a sample of ``SAMPLE`` rows with
the smallest checksums (they decide only how tight boxes are); every row is packed. The checksum ends the sort order,
so that equal vectors, however many, spread over blocks as well.

Search: a box gives an interval of inner products with an anchor, coordinate by coordinate. Anchors that share a
block travel together. Positives need the k best rows of the anchor's label; negatives need the k best rows of other
labels whose score lies in a window below each positive's score. Both are one search: boxes of blocks are tested
first, so that only blocks that can matter meet the anchors; these arrive best bound first, and within a block the
leaves are opened in the order of their bounds, until every leaf left lies outside all windows or strictly below
their k-th score (equal bounds may still hold a tie with a smaller id). Intervals and scores are exact integers.
The k-th score of an anchor's own block is known before the first block moves.

Defined cases: rows with a null id, a null label, a null vector or a null, NaN or infinite component take no part;
a vector shorter than others counts as if it ended in zeros; rows equal in id, label and vector count once; rows that
share an id but differ are separate rows, none of which is a partner of another; an anchor without positives, or a
positive without rows in its window, gives no row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import forget, keep

BLOCK = 2048
LEAF = 64
#: Leaves opened at a time, so that one product scores them.
OPENED = 8
#: Rows that tile borders are taken from, and tiles along each of two coordinates.
SAMPLE = 4096
SLICES = 16
#: Rows of a partition while packing, block boxes of a page, and (anchors, block) meetings of a task.
PACKED = 32 * BLOCK
PAGE = 1024
MEETINGS = 32
LOWEST, HIGHEST = -(1 << 62), 1 << 62
_WINDOWS = "array<struct<a:int,tag:int,low:bigint,high:bigint>>"


def usable(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, key, anchor): the rows that take part, components as floor(scale x)."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).cast("array<bigint>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .withColumn("key", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["vec_id", "label", "v"]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _spread(rows: DataFrame) -> list[tuple]:
    """(pos, low, high, variance) of every component; absent ones count as zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            if len(sizes) == 0 or sizes.max() == 0:
                continue
            m = _matrix(column, int(sizes.max()))
            f = m.astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.arange(m.shape[1]), m.min(axis=0), m.max(axis=0), f.sum(axis=0), (f * f).sum(axis=0),
                                       np.full(m.shape[1], len(m)))], names=["pos", "low", "high", "s", "q", "n"])

    found = (rows.select("v").mapInArrow(run, "pos long, low long, high long, s double, q double, n long").groupBy("pos")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("q").alias("q"),
                  F.sum("n").alias("n")).orderBy("pos").collect())  # one row per component
    return [(r.pos, min(r.low, 0), max(r.high, 0), r.q / r.n - (r.s / r.n) ** 2) for r in found]


def leaves(v: np.ndarray, axes: list[int], leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of ``v`` in leaves of at most ``leaf`` rows, by sort-tile-recursion over ``axes``."""
    def cut(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        if len(rows) <= leaf:
            return [rows]
        n = -(-len(rows) // leaf)
        slabs = int(np.ceil(n ** (1 / len(left))))
        size = leaf * -(-n // slabs)
        rows = rows[np.argsort(v[rows, left[0]], kind="stable")]
        return [x for at in range(0, len(rows), size) for x in cut(rows[at:at + size], left[1:] or left)]

    return cut(np.arange(len(v)), axes)


def _tile(c1: Column, c2: Column, sample: np.ndarray) -> Column:
    """Number of the tile of a row, from borders that the sample gives."""
    def place(borders: Column, x: Column) -> Column:
        return F.size(F.filter(borders, lambda b: b <= x))

    def borders(values: np.ndarray) -> list[int]:
        values = np.sort(values)
        return [int(values[len(values) * i // SLICES]) for i in range(1, SLICES)] if len(values) else []

    first = borders(sample[:, 0])
    if not first:
        return F.lit(0)
    at = np.searchsorted(np.array(first), sample[:, 0], side="right")
    empty = F.array().cast("array<bigint>")
    second = [borders(sample[at == i, 1]) for i in range(SLICES)]
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in own]) if own else empty for own in second])
    slice_ = place(F.array(*[F.lit(b).cast("long") for b in first]), c1)
    return slice_ * SLICES + place(F.get(inner, slice_), c2)


def pack(rows: DataFrame, spread: list[tuple], n: int) -> DataFrame:
    """One row a block: label, ids, vectors in leaf order, the sizes and boxes of the leaves, and its own box."""
    width = max(1, len(spread))
    axes = sorted(range(len(spread)), key=lambda i: (-spread[i][3], i)) or [0]
    top = max([1, *(max(-low, high) for _, low, high, _ in spread)])
    kind = next((t for t in (np.int16, np.int32) if top < np.iinfo(t).max), np.int64)
    c = [F.coalesce(F.get("v", F.lit(a)), F.lit(0)).cast("long") for a in (axes * 3)[:3]]
    sampled = rows.select("key", c[0].alias("c1"), c[1].alias("c2")).orderBy("key").limit(SAMPLE).select("c1", "c2").collect()
    tile = _tile(c[0], c[1], np.array(sampled, np.int64).reshape(-1, 2))
    order = ["label", "tile", "c3", "key"]
    dealt = (rows.withColumn("tile", tile).withColumn("c3", c[2]).repartitionByRange(max(1, -(-n // PACKED)), *order)
             .sortWithinPartitions(*order).select("label", "vec_id", "key", "anchor", "v"))
    inner = (axes[2:] + axes[:2])[:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def block(label: int, parts: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            ids, anchor, v = (np.concatenate(x) for x in zip(*parts))
            cuts = leaves(v, inner)
            at = np.concatenate(cuts)
            v = v[at].astype(kind)
            sizes = np.array([len(x) for x in cuts], np.int32)
            starts = np.cumsum(sizes) - sizes
            low, high = np.minimum.reduceat(v, starts, axis=0), np.maximum.reduceat(v, starts, axis=0)
            number += 1
            cells = [number - 1, label, int(anchor.sum()), ids[at].tobytes(), anchor[at].tobytes(), v.tobytes(), sizes.tobytes(),
                     low.tobytes(), high.tobytes(), low.min(axis=0).tobytes(), high.max(axis=0).tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, cells))], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("n_anchors", pa.int32()),
                            *[(x, pa.binary()) for x in ("ids", "anchor", "v", "sizes", "low", "high", "box_low", "box_high")]])
        held, have, now = [], 0, None
        for batch in batches:
            label = batch.column("label").to_numpy()
            ids = np.stack([batch.column(x).to_numpy() for x in ("vec_id", "key")], axis=1)
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            v = _matrix(batch.column("v"), width)
            at = 0
            while at < len(label):
                if have and (label[at] != now or have == BLOCK):
                    yield block(now, held)
                    held, have = [], 0
                now = int(label[at])
                same = label[at:at + BLOCK - have] == now
                to = at + (len(same) if same.all() else int(np.argmin(same)))
                held.append((ids[at:to], anchor[at:to], v[at:to]))
                have += to - at
                at = to
        if have:
            yield block(now, held)

    binaries = ", ".join(f"{x} binary" for x in ("ids", "anchor", "v", "sizes", "low", "high", "box_low", "box_high"))
    return keep(dealt.mapInArrow(run, f"block long, label long, n_anchors int, {binaries}"), "tree", "none").withColumn(
        "kind", F.lit(np.dtype(kind).name))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T; through doubles where every partial sum is exact in them."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[-1]
    if top < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of every query with every box."""
    q = q.astype(np.int64)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return _product(plus, low) + _product(minus, high), _product(plus, high) + _product(minus, low)


class Best:
    """The k best (score, id) of a window so far; ``least`` is the score that a newcomer must reach."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k, self.least = low, high, k, low
        self.found: list[tuple[int, int, int]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.nonzero((scores >= self.least) & (scores <= self.high))[0]
        if len(at) > self.k:
            # Only scores that the k-th best of the newcomers reaches can enter.
            s = scores[at]
            at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
        if len(at):
            both = self.found + [(-int(scores[i]), int(ids[i, 0]), int(ids[i, 1])) for i in at]
            self.found = sorted(both)[: self.k]
            if len(self.found) == self.k:
                self.least = max(self.least, -self.found[-1][0])


def best_first(q: np.ndarray, own: int, bests: list[Best], v: np.ndarray, ids: np.ndarray, starts: np.ndarray,
               ends: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
    """Open the leaves of one block in the order of their bounds until none can matter to any window."""
    low, high = np.array([b.low for b in bests])[:, None], np.array([b.high for b in bests])[:, None]
    # What a leaf can still give a window: nothing outside it, else its bound cut at the window's top.
    gives = np.where((least <= high) & (most >= low), np.minimum(most, high), LOWEST - 1)
    order = np.argsort(-gives.max(axis=0), kind="stable")
    for at in range(0, len(order), OPENED):
        now = order[at:at + OPENED]
        kth = np.array([b.least for b in bests])[:, None]
        if not (gives[:, order[at:]] >= kth).any():
            return
        now = now[(gives[:, now] >= kth).any(axis=0)]
        if len(now) == 0:
            continue
        at_rows = np.concatenate([np.arange(starts[i], ends[i]) for i in now])
        s = (v[at_rows] @ q) if v.dtype == np.float64 else v[at_rows].astype(np.int64) @ q
        s = s.astype(np.int64)
        other = ids[at_rows, 0] != own
        s, rows = s[other], at_rows[other]
        for b in bests:
            b.add(s, ids[rows])


def _open(row: dict, width: int) -> tuple:
    kind = np.dtype(row["kind"])
    ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
    v, low, high = (np.frombuffer(row[x], kind).reshape(-1, width) for x in ("v", "low", "high"))
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
    return ids, v, np.concatenate([[0], ends[:-1]]), ends, low, high


def _for_products(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where products stay exact, else as they are."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * v.shape[1]
    return (q.astype(np.float64), v.astype(np.float64)) if top < 2.0**52 else (q.astype(np.int64), v)


def anchors(tree: DataFrame, width: int, k: int) -> DataFrame:
    """(a_block, label, kind, a_ids, q, windows): the anchors of each block with the k-th score within it as floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v, starts, ends, low, high = _open(row, width)
                at = np.nonzero(np.frombuffer(row["anchor"], np.bool_))[0]
                least, most = intervals(v[at], low, high)
                q, w = _for_products(v[at], v)
                windows = []
                for a, i in enumerate(at):
                    best = Best(LOWEST, HIGHEST, k)
                    best_first(q[a], ids[i, 0], [best], w, ids, starts, ends, least[a], most[a])
                    windows.append({"a": a, "tag": 0, "low": best.least, "high": HIGHEST})
                out = {"a_block": row["block"], "label": row["label"], "kind": row["kind"], "a_ids": ids[at].tobytes(),
                       "q": v[at].tobytes(), "windows": windows}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    schema = pa.schema([("a_block", pa.int64()), ("label", pa.int64()), ("kind", pa.string()), ("a_ids", pa.binary()), ("q", pa.binary()),
                        ("windows", pa.list_(pa.struct([("a", pa.int32()), ("tag", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])))])
    return tree.where("n_anchors > 0").mapInArrow(
        run, f"a_block long, label long, kind string, a_ids binary, q binary, windows {_WINDOWS}")


def search(tree: DataFrame, asked: DataFrame, width: int, same_label: bool, k: int) -> DataFrame:
    """(a_block, a, tag, anchor_id, rank, vec_id, score): the k best rows in every window of ``asked``.

    Rows are of the anchors' own label, or of all others.
    """
    n_pages = max(1, -(-tree.count() // PAGE))
    boxes = tree.select("block", "label", "kind", "box_low", "box_high", F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page"))
    pages = boxes.groupBy("page").agg(F.collect_list(F.struct("block", "label", "box_low", "box_high")).alias("boxes"))
    dealt = asked.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))

    def grouped(windows: list[dict], n: int) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(n)]
        for w in windows:
            out[w["a"]].append(w)
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = np.dtype(row["kind"])
                q = np.frombuffer(row["q"], kind).reshape(-1, width)
                boxes = [b for b in row["boxes"] if (b["label"] == row["label"]) == same_label]
                if not boxes or not row["windows"]:
                    continue
                low, high = (np.frombuffer(b"".join(b[x] for b in boxes), kind).reshape(-1, width) for x in ("box_low", "box_high"))
                least, most = intervals(q, low, high)
                a, bottom, top = (np.array([w[x] for w in row["windows"]]) for x in ("a", "low", "high"))
                hit = (least[a] <= top[:, None]) & (most[a] >= bottom[:, None])
                bound = np.where(hit, np.minimum(most[a], top[:, None]), LOWEST).max(axis=0)
                need = np.nonzero(hit.any(axis=0))[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(need), row["a_block"])), pa.array(np.array([b["block"] for b in boxes])[need]), pa.array(bound[need])],
                    names=["a_block", "block", "bound"])

    pairs = keep(dealt.join(pages, "page").mapInArrow(meet, "a_block long, block long, bound long"), "meetings")
    n_pairs = pairs.count()
    lane = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-tree.count() // MEETINGS)))).alias("lane")
    data = tree.select("block", "ids", "v", "sizes", "low", "high")
    met = (pairs.join(asked, "a_block").join(data, "block")
           .select("a_block", lane, "bound", "kind", "a_ids", "q", "windows", "block", "ids", "v", "sizes", "low", "high")
           .repartition(max(1, -(-n_pairs // MEETINGS)), "a_block", "lane")
           .sortWithinPartitions("a_block", "lane", F.desc("bound"), "block"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of one lane come best bound first; what is found carries on from block to block.
        for (a_block, _), rows in groupby(rows_of(batches), key=lambda r: (r["a_block"], r["lane"])):
            bests = None
            for row in rows:
                if bests is None:
                    a_ids = np.frombuffer(row["a_ids"], np.int64).reshape(-1, 2)
                    asked_q = np.frombuffer(row["q"], np.dtype(row["kind"])).reshape(-1, width)
                    windows = grouped(row["windows"], len(a_ids))
                    bests = [[Best(w["low"], w["high"], k) for w in own] for own in windows]
                ids, v, starts, ends, low, high = _open(row, width)
                least, most = intervals(asked_q, low, high)
                q, x = _for_products(asked_q, v)
                for a, own in enumerate(bests):
                    if own:
                        best_first(q[a], a_ids[a, 0], own, x, ids, starts, ends, least[a], most[a])
            found = [(a_block, a, w["tag"], int(a_ids[a, 0]), i, -s, key) for a, own in enumerate(bests)
                     for w, b in zip(windows[a], own) for s, i, key in b.found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    schema = pa.schema([("a_block", pa.int64()), ("a", pa.int32()), ("tag", pa.int32()), ("anchor_id", pa.int64()),
                        ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.int64())])
    by_score = Window.partitionBy("a_block", "a", "tag").orderBy(F.desc("score"), "vec_id", "key")
    return (met.mapInArrow(run, "a_block long, a int, tag int, anchor_id long, vec_id long, score long, key long")
            .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).drop("key"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row with ``is_anchor``.

    ``vectors`` holds vec_id, label and embedding. Negatives score from ``low`` to ``high`` hundredths of the positive.
    """
    rows = keep(usable(vectors, is_anchor, scale), "vectors")
    spread = _spread(rows)
    width = max(1, len(spread))
    tree = pack(rows, spread, rows.count())
    asked = keep(anchors(tree, width, positives), "anchors", "none")
    forget(rows)
    near = keep(search(tree, asked, width, True, positives), "positives")
    # Whole numbers: s is in a window if low * positive <= 100 * s <= high * positive.
    part = "CAST({0}(CAST(score AS DECIMAL(20, 0)) * {1} / 100) AS BIGINT)"
    bounds = near.select("a_block", "a", F.col("rank").alias("tag"), F.expr(part.format("ceil", low)).alias("low"),
                         F.expr(part.format("floor", high)).alias("high"))
    windows = bounds.groupBy("a_block").agg(F.collect_list(F.struct("a", "tag", "low", "high")).alias("windows"))
    # A negative score has an empty window: nothing is both above half of it and below.
    windows = windows.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"]))
    far = search(tree, asked.drop("windows").join(windows, "a_block"), width, False, negatives)
    partners = near.select("a_block", "a", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(partners, ["a_block", "a", "tag"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
