"""Repair of conversation structure: the cheapest edits that make the roles alternate.

A repaired conversation is empty or an optional system row followed by user and assistant rows in turn, ending with
the assistant. Each row may be kept, given another role, or deleted; blank and duplicate rows must be deleted; rows
without text may be inserted anywhere. :data:`COSTS` holds what that costs. Of the cheapest sequences of edits the one
whose initials come first in ASCII order is taken.

A row is a symbol: the initial of its role and its fault. Equal consecutive symbols are collapsed to runs. The state
between rows is what the repaired conversation ends with so far, so a symbol is a 4 x 4 min-plus matrix, a run is a
power of it (binary powers are cached), and a stretch of rows is a product. That is associative: rows are sorted by
conversation and turn over *range* partitions, a conversation that reaches over several partitions becomes one small
product for each, and a second step chains those few products. The choices are unrolled stretch by stretch from the
costs still to come; only symbols, never texts, take part in all that, and identical rows travel once with a count.

:func:`repaired` then streams the texts of each conversation past its edits. A conversation of any length passes
through a task row by row; held in memory is one letter a row.

Defined cases: a null role or text is one space; rows without ``conv_id`` are one conversation; rows come by turn,
null turns first, then by role and a checksum of the text; an empty role has no initial and cannot be kept, like any
role that does not begin with s, u or a; identical rows are repeats of the first; a conversation without rows has no
result; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import keep

#: What the edits cost, and what a truncated row that stays adds.
COSTS = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
NO_WAY = 1 << 40
#: States: nothing yet, ends with system, with user, with assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: A stretch this long is unrolled with all its costs at hand; longer ones are halved first.
UNROLLED = 4096
FINE, TRUNCATED, GONE = range(3)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = np.array([(a, b) in ((0, 1), (1, 2), (2, 1)) for a in range(4) for b in range(4)]).reshape(4, 4)
ORDER = ["no_id", "conv", "has_turn", "at", "role", "sum"]


def options(symbol: int) -> list[tuple[int, str, int, int]]:
    """(state, initials, next state, cost): what can be done with a row, after up to two inserted rows."""
    initial, fault = divmod(symbol, 3)
    out = []
    for state in range(4):
        now, cost, letters = state, 0, ""
        for _ in range(3):
            out.append((state, letters + "D", now, cost + COSTS["delete"]))
            if fault != GONE:
                more = cost + (COSTS["truncated"] if fault == TRUNCATED else 0)
                out.append((state, letters + "R", _NEXT[now], more + COSTS["rerole"]))
                if (initial == 0 and now == EMPTY) or (initial == 1 and now != USER) or (initial == 2 and now == USER):
                    out.append((state, letters + "K", (SYSTEM, USER, ASSISTANT)[initial], more + COSTS["keep"]))
            now, cost, letters = _NEXT[now], cost + COSTS["insert"], letters + "I"
    return out


#: Costs still to come after the last row, and the rows that are inserted there.
TAIL = np.array([0, 2 * COSTS["insert"], COSTS["insert"], 0], np.int64)
TAIL_LETTERS = ("", "II", "I", "")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product; ``b`` is a matrix or a vector of costs to come."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(axis=1), NO_WAY)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NO_WAY)


class Machine:
    """Transitions of symbols, their binary powers and choices, each made once."""

    def __init__(self) -> None:
        self.options = {s: options(s) for s in range(12)}
        self.powers: dict[int, list[np.ndarray]] = {}
        self.choices: dict[tuple, list[tuple[str, int]]] = {}

    def power(self, symbol: int, k: int) -> np.ndarray:
        """The matrix of 2 ** k equal rows."""
        own = self.powers.setdefault(symbol, [])
        if not own:
            first = np.full((4, 4), NO_WAY, np.int64)
            for state, _, after, cost in self.options[symbol]:
                first[state, after] = min(first[state, after], cost)
            own.append(first)
        while len(own) <= k:
            own.append(times(own[-1], own[-1]))
        return own[k]

    def advance(self, symbol: int, n: int, to_come: np.ndarray) -> np.ndarray:
        """Costs to come before a run of ``n`` equal rows, of those after it (or the product with a matrix)."""
        for k in range(n.bit_length()):
            if n >> k & 1:
                to_come = times(self.power(symbol, k), to_come)
        return to_come

    def product(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.where(np.eye(4, dtype=bool), 0, NO_WAY).astype(np.int64)
        for s, n in zip(symbols[::-1].tolist(), counts[::-1].tolist()):
            out = self.advance(s, n, out)
        return out

    def _choice(self, symbol: int, to_come: np.ndarray) -> list[tuple[str, int]]:
        """(initials, next state) for every state: the cheapest, then the first in ASCII order."""
        least = int(to_come.min())
        key = (symbol, *(to_come - least).tolist())
        if key not in self.choices:
            best = [(NO_WAY * 4, "", 0)] * 4
            for state, letters, after, cost in self.options[symbol]:
                best[state] = min(best[state], (cost + int(to_come[after]) - least, letters, after))
            self.choices[key] = [x[1:] for x in best]
        return self.choices[key]

    def unroll(self, symbols: list[int], counts: list[int], state: int, to_come: np.ndarray) -> tuple[str, int]:
        """Initials of the edits of these runs from ``state`` on, and the state after them."""
        after = [to_come]
        for s, n in zip(symbols[::-1], counts[::-1]):
            after.append(self.advance(s, n, after[-1]))
        letters: list[str] = []
        for s, n, costs in zip(symbols, counts, after[-2::-1]):
            state = self._run(s, n, state, costs, letters)
        return "".join(letters), state

    def _run(self, symbol: int, n: int, state: int, to_come: np.ndarray, letters: list[str]) -> int:
        if n > UNROLLED:
            half = n // 2
            state = self._run(symbol, half, state, self.advance(symbol, n - half, to_come), letters)
            return self._run(symbol, n - half, state, to_come, letters)
        one, costs = self.power(symbol, 0), [to_come]
        for _ in range(n - 1):
            costs.append(times(one, costs[-1]))
        for after in reversed(costs):
            taken, state = self._choice(symbol, after)[state]
            letters.append(taken)
        return state


def _prepared(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        role.alias("role"), text.alias("text"), F.md5(text).alias("sum"))


def _symbols(rows: DataFrame) -> DataFrame:
    """One row for identical rows of a turn: their number, the first one's symbol and its faults."""
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    each = rows.select(*ORDER, number.alias("initial"), blank.alias("blank"), cut.alias("cut"))
    once = keep(each.groupBy(*ORDER, "initial", "blank", "cut").agg(F.count("*").alias("n")), "turns")
    turn = F.struct("has_turn", "at")
    seen = once.groupBy("no_id", "conv", "role", "sum").agg(F.min(turn).alias("first"))
    joined = once.join(seen, ["no_id", "conv", "role", "sum"]).withColumn("again", turn != F.col("first"))
    fault = F.when(F.col("blank") | F.col("again"), GONE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    return joined.select(*ORDER, "n", "initial", "blank", (F.col("again") & ~F.col("blank")).alias("again"), fault.alias("fault"))


_STRETCH = ("no_id boolean, conv {conv}, stretch long, whole boolean, runs binary, counts binary, product binary, n_blank long, n_again long, "
            "n_cut long, n_illegal long, first int, last int, low long, high long, n_turns long, cost long, audit string")


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def stretches(symbols: DataFrame) -> DataFrame:
    """Every conversation's stretch in each range partition: runs, counts, and for whole conversations the edits."""
    ddl = _STRETCH.format(conv=symbols.schema["conv"].dataType.simpleString())
    schema = _arrow(ddl, symbols.sparkSession)

    def closed(machine: Machine, key: tuple, number: int, whole: bool, parts: list[np.ndarray]) -> dict:
        initial, fault, n, blank, again, has_turn, at = (np.concatenate(x) for x in zip(*parts))
        # Repeats of a row follow it and must go.
        symbol = np.stack([initial * 3 + fault, initial * 3 + GONE], axis=1).reshape(-1)
        counts = np.stack([np.ones_like(n), n - 1], axis=1).reshape(-1)
        symbol, counts = symbol[counts > 0], counts[counts > 0]
        starts = np.nonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))[0]
        runs, counts = symbol[starts], np.add.reduceat(counts, starts)
        turns = at[has_turn]
        out = {
            "no_id": key[0], "conv": key[1], "stretch": number, "whole": whole, "runs": runs.astype(np.uint8).tobytes(),
            "counts": counts.astype(np.int64).tobytes(), "n_blank": int((n * blank).sum()),
            "n_again": int((n * again).sum() + ((n - 1) * ~(blank | again)).sum()), "n_cut": int((fault == TRUNCATED).sum()),
            # Pairs of a row with its own repeats are illegal, those of neighbours may be.
            "n_illegal": int((n - 1).sum() + (~_LEGAL[initial[:-1], initial[1:]]).sum()),
            "first": int(initial[0]), "last": int(initial[-1]), "low": int(turns[0]) if len(turns) else None,
            "high": int(turns[-1]) if len(turns) else None, "n_turns": int((turns[1:] != turns[:-1]).sum()) + bool(len(turns)),
        }
        if whole:
            audit, state = machine.unroll(runs.tolist(), counts.tolist(), EMPTY, TAIL)
            out["audit"] = audit + TAIL_LETTERS[state]
            cost = TAIL
            for s, k in zip(runs[::-1].tolist(), counts[::-1].tolist()):
                cost = machine.advance(s, k, cost)
            out["cost"] = int(cost[EMPTY])
        else:
            out["product"] = machine.product(runs, counts).tobytes()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, machine, now, parts, ready = TaskContext.get().partitionId(), Machine(), None, [], []
        first = True
        for batch in batches:
            conv, no_id = batch.column("conv"), batch.column("no_id").to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("initial", "fault", "n", "blank", "again", "has_turn", "at")]
            ids = conv.to_numpy(zero_copy_only=False)
            edges = [0, *(np.nonzero((ids[1:] != ids[:-1]) | (no_id[1:] != no_id[:-1]))[0] + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = (bool(no_id[a]), conv[a].as_py())
                if parts and key != now:
                    # What lies between two others in a partition is whole.
                    ready.append(closed(machine, now, number, not first, parts))
                    parts, first = [], False
                now = key
                parts.append([c[a:b] for c in columns])
            if len(ready) >= 1000:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready = []
        if parts:
            ready.append(closed(machine, now, number, False, parts))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    dealt = symbols.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return keep(dealt.mapInArrow(run, ddl), "stretches")


def _chained(parts: DataFrame) -> DataFrame:
    """The stretches of conversations that reach over partitions, with their edits; totals stand in the first one."""
    conv = parts.schema["conv"].dataType.simpleString()
    ddl = _STRETCH.format(conv=conv)
    schema = _arrow(ddl, parts.sparkSession)
    few = ["stretch", "product", "first", "last", "low", "high", "n_illegal", "n_turns"]
    lists = parts.groupBy("no_id", "conv").agg(F.sort_array(F.collect_list(F.struct(*few))).alias("parts"))
    told = f"no_id boolean, conv {conv}, stretch long, head boolean, to_come binary, cost long, illegal long, turns long"
    told_schema = _arrow(told, parts.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One small row a partition that the conversation reaches.
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                to_come, own = TAIL, []
                for p in reversed(row["parts"]):
                    own.append({"no_id": row["no_id"], "conv": row["conv"], "stretch": p["stretch"], "head": False,
                                "to_come": to_come.tobytes(), "cost": 0, "illegal": p["n_illegal"], "turns": p["n_turns"]})
                    to_come = times(np.frombuffer(p["product"], np.int64).reshape(4, 4), to_come)
                for p, q, x in zip(row["parts"], row["parts"][1:], own[::-1][1:]):
                    x["illegal"] += not _LEGAL[p["last"], q["first"]]
                    x["turns"] -= p["high"] is not None and p["high"] == q["low"]
                own[-1] |= {"head": True, "cost": int(to_come[EMPTY])}
                out += own
            yield pa.RecordBatch.from_pylist(out, schema=told_schema)

    tells = lists.mapInArrow(tell, told)
    ways = f"no_id boolean, conv {conv}, stretch long, states array<int>, audits array<string>"
    ways_schema = _arrow(ways, parts.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            for row in batch.to_pylist():
                runs, counts = np.frombuffer(row["runs"], np.uint8).tolist(), np.frombuffer(row["counts"], np.int64).tolist()
                to_come = np.frombuffer(row["to_come"], np.int64)
                found = [machine.unroll(runs, counts, s, to_come) for s in ((EMPTY,) if row["head"] else range(4))]
                out = {k: row[k] for k in ("no_id", "conv", "stretch")} | {"states": [s for _, s in found], "audits": [a for a, _ in found]}
                yield pa.RecordBatch.from_pylist([out], schema=ways_schema)

    key = ["no_id", "conv", "stretch"]
    joined = keep(parts.drop("cost", "audit", "n_illegal", "n_turns").join(tells, key), "chained")
    walked = keep(joined.mapInArrow(walk, ways), "ways")
    # The state that a stretch begins with is where the one before it ends.
    enters = F.aggregate(
        F.sort_array(F.collect_list(F.struct("stretch", "states"))), F.array(F.lit(EMPTY)),
        lambda path, x: F.concat(path, F.array(F.get(x["states"], F.element_at(path, -1)))))
    paths = walked.groupBy("no_id", "conv").agg(F.sort_array(F.collect_list("stretch")).alias("order"), enters.alias("path"))
    steps = paths.select("no_id", "conv", F.explode(F.arrays_zip("order", F.slice("path", 1, F.size("order")).alias("enter"))).alias("x"),
                         F.element_at("path", -1).alias("end"), F.element_at("order", -1).alias("last_one"))
    steps = steps.select("no_id", "conv", F.col("x.order").alias("stretch"), F.col("x.enter").alias("enter"),
                         F.when(F.col("x.order") == F.col("last_one"), F.get(F.array(*[F.lit(x) for x in TAIL_LETTERS]), F.col("end")))
                         .otherwise("").alias("tail"))
    edits = walked.join(steps, key).select(*key, F.concat(F.get("audits", F.col("enter")), "tail").alias("audit"))
    return joined.join(edits, key).select(
        *[{"n_illegal": F.col("illegal").alias("n_illegal"), "n_turns": F.col("turns").alias("n_turns")}.get(c, F.col(c)) for c in schema.names])


def plan(rows: DataFrame) -> DataFrame:
    """(no_id, conv, stretch, counts ..., cost, audit): the edits of every conversation, stretch by stretch."""
    symbols = _symbols(_prepared(rows))
    found = stretches(symbols)
    return keep(found.where("whole").unionByName(_chained(found.where("not whole"))).drop("runs", "counts", "product"), "edits")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, kind, role, text): each conversation's edits are read off as its rows stream by. Kind None ends one."""
    role_of = {USER: "user", ASSISTANT: "assistant"}
    now, audit, at, state = None, "", 0, EMPTY

    def inserts(key: tuple) -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _NEXT[state]
            at += 1
            yield key, "I", role_of[state], ""

    for batch in batches:
        for no_id, conv, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("no_id", "conv", "audit", "role", "text"))):
            key = (no_id, conv)
            if key != now:
                if now is not None:
                    yield from inserts(now)
                    yield now, None, audit, None
                now, audit, at, state = key, "", 0, EMPTY
            if edits is not None:
                audit += edits
                continue
            yield from inserts(key)
            letter = audit[at]
            at += 1
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield key, "K", role, text
            elif letter == "R":
                state = _NEXT[state]
                yield key, "R", role_of[state], text
    if now is not None:
        yield from inserts(now)
        yield now, None, audit, None


def _streamed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits ahead of the rows they are for, by conversation."""
    texts = _prepared(rows).select(*ORDER, "text", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("stretch"), F.lit(None).cast("string").alias("audit"))
    heads = edits.select("no_id", "conv", "stretch", "audit", F.lit(0).alias("kind"))
    return (heads.unionByName(texts, allowMissingColumns=True).repartition("no_id", "conv")
            .sortWithinPartitions("no_id", "conv", "kind", "stretch", "has_turn", "at", "role", "sum")
            .select("no_id", "conv", "audit", "role", "text"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, row by row."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, place long, edit string, role string, text string"
    schema = _arrow(ddl, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []
        for (no_id, conv), kind, role, text in _events(batches):
            if kind is None:
                place = 0
                continue
            out.append({"conv_id": None if no_id else conv, "place": place, "edit": kind, "role": role, "text": text})
            place += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _streamed(rows, edits).mapInArrow(run, ddl)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(no_id, conv, audit, repaired_sha256) of every conversation; the hash takes ``role:text`` lines as they pass."""
    conv = edits.schema["conv"].dataType.simpleString()
    ddl = f"no_id boolean, conv {conv}, audit string, repaired_sha256 string"
    schema = _arrow(ddl, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, some, out = hashlib.sha256(), False, []
        for (no_id, conv), kind, role, text in _events(batches):
            if kind is None:
                out.append({"no_id": no_id, "conv": conv, "audit": role, "repaired_sha256": digest.hexdigest()})
                digest, some = hashlib.sha256(), False
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
                continue
            digest.update(f"{'\n' if some else ''}{role}:{text}".encode())
            some = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _streamed(rows, edits).mapInArrow(run, ddl)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``conversations`` names more conversations (conv_id), which have no rows and so nothing to repair.
    """
    rows = keep(rows.select("conv_id", "turn", "role", "text"), "conversations")
    edits = plan(rows)
    totals = edits.groupBy("no_id", "conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("n_turns"), F.lit(0)).alias("gaps"),
        F.sum("n_blank").alias("blank"), F.sum("n_again").alias("duplicate"), F.sum("n_cut").alias("truncated"),
        F.sum("n_illegal").alias("illegal"), F.sum("cost").alias("cost"))
    found = totals.join(digests(rows, edits), ["no_id", "conv"])
    if conversations is not None:
        kind = rows.schema["conv_id"].dataType
        known = conversations.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv")).distinct()
        found = known.join(found, ["no_id", "conv"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
