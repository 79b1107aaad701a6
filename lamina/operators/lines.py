"""Lower envelopes of parabolas along lines, the building block of exact Euclidean transforms.

The squared distance from a cell to its nearest source is found axis by axis: each pass takes, on every line of
one axis, the minimum of ``(a - b) ** 2 + cost(b)``. The minimum is the lower envelope of equal parabolas, which
a stack finds in time linear in the line. Spark deals whole lines to tasks and sorts them; a task reads its
partition as a stream of Arrow batches and treats many lines at once, one position after the other, so a line
costs the same however far its sources are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Cost of a position that holds no source.
NOTHING = 1 << 62
#: Cells that are treated together; bounds the memory of a task.
CELLS = 1 << 20


def envelope(cost: np.ndarray, scale: np.ndarray | int = 1) -> np.ndarray:
    """Position of the best source for every position of every row of ``cost``, -1 in rows without a source.

    Minimises ``scale * (a - b) ** 2 + cost[row, b]`` in whole numbers. Of equal parabolas either may be named.
    """
    rows, length = cost.shape
    scale = np.broadcast_to(np.asarray(scale, np.int64), (rows,))
    stack = np.zeros((rows, length), np.int64)
    begin = np.zeros((rows, length), np.int64)
    top = np.full(rows, -1)
    for q in range(length):
        open_ = np.nonzero(cost[:, q] < NOTHING)[0]
        start = np.zeros(len(open_), np.int64)
        todo = np.nonzero(top[open_] >= 0)[0]
        while len(todo):
            r = open_[todo]
            p = stack[r, top[r]]
            rise = scale[r] * (q * q - p * p) + cost[r, q] - cost[r, p]
            # The first whole position at which the new parabola is the lower one.
            start[todo] = rise // (2 * scale[r] * (q - p)) + 1
            lower = start[todo] <= begin[r, top[r]]
            top[r[lower]] -= 1
            todo = todo[lower]
            gone = top[open_[todo]] < 0
            start[todo[gone]] = 0
            todo = todo[~gone]
        seen = start < length
        r, start = open_[seen], start[seen]
        top[r] += 1
        stack[r, top[r]] = q
        begin[r, top[r]] = np.maximum(start, 0)
    best = np.full((rows, length), -1)
    at = np.zeros(rows, np.int64)
    held = np.nonzero(top >= 0)[0]
    for x in range(length):
        more = held[at[held] < top[held]]
        more = more[begin[more, at[more] + 1] <= x]
        at[more] += 1
        best[held, x] = stack[held, at[held]]
    return best


def whole_lines(batches: Iterator[pa.RecordBatch], line: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts): whole lines of a sorted partition, many at a time; ``starts`` holds where each begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < CELLS // 4:
            continue
        rows, starts = _cut(held, line)
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last), starts[:-1]
        held = rows.slice(last).to_batches()
    if held:
        yield _cut(held, line)


def _cut(held: list[pa.RecordBatch], line: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    rows = pa.Table.from_batches(held)
    changed = np.zeros(rows.num_rows - 1, bool)
    for name in line:
        column = rows.column(name).combine_chunks()
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy() if not pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return rows, np.concatenate([[0], np.nonzero(changed)[0] + 1])


def grids(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(lines, width): lines of similar extent ``first .. last`` to be laid out in one grid of bounded size."""
    width = last - first + 1
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        widest = 1 << int(width[order[at]] - 1).bit_length()
        to = min(int(np.searchsorted(width[order], widest, "right")), at + max(1, CELLS // widest))
        yield order[at:to], int(width[order[to - 1]])
        at = to


def along_lines(
    rows: DataFrame, line: Sequence[str], axis: str, treat: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: StructType,
    tasks: int | None = None,
) -> DataFrame:
    """Apply ``treat(rows, starts)`` to whole lines, sorted along ``axis``; one shuffle, bounded memory.

    ``tasks`` is for few rows that give many: Spark would else merge them into one task.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_lines(batches, line):
            for out in treat(part, starts):
                yield from out.cast(arrow).to_batches(max_chunksize=1 << 16)

    dealt = rows.repartition(*line) if tasks is None else rows.repartition(tasks, *line)
    return dealt.sortWithinPartitions(*line, axis).mapInArrow(run, schema)
