"""Subword encoding with a SentencePiece model as a relational lattice, and decoding.

Frequent words are encoded relationally: every substring up to the longest piece is a row, an equi-join with
the piece table leaves the lattice edges, edges are grouped by word, and Spark's ``aggregate`` folds them. Two
folds exist. :func:`viterbi_fold` keeps the best-scoring path to every position and suits unigram tables.
:func:`merge_fold` replays best-first merges over the same edges and suits BPE tables, whose segmentation no
sum of scores along a path reproduces; this gives the ids of the reference library for the given BPE model.

A join of every word occurrence with an unbounded word table would shuffle the corpus twice, so the relational
part covers a bounded dictionary (the most frequent words), and each task folds rarer words itself by the same
rule. No text is shuffled.

Defined cases: a null text counts as empty; an empty text has no ids; characters without a piece become their
UTF-8 byte pieces (the unknown id in tables without byte pieces); repeated rows are encoded one by one; other
columns pass through, existing ``ids``, ``n_tokens`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import forget, keep

SPACE = "▁"
#: Texts that a task holds as Python objects at a time.
TOGETHER = 512
#: Words in the dictionary that the lattice encodes, by falling frequency.
DICTIONARY = 50_000
#: Dictionary words fit the bits of a long.
MAX_WORD = 60
MEMO = 300_000


@dataclass(frozen=True)
class PieceTable:
    """Ordinary pieces with id and score, byte pieces, and the id of unknown text."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unknown: int
    texts: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load_pieces(path: str) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte, texts = {}, {}, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            texts.append(piece.encode())
    return PieceTable(pieces, tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (), model.unk_id(), tuple(texts))


def marked(text: Column) -> Column:
    """The text as the model sees it: a mark before it and for every space."""
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))).otherwise("")


#: Cuts before marks that follow other text and around line feeds; pieces never cross these places.
CUT = f"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)"
_WORDS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def check_cuts(table: PieceTable) -> None:
    """Raise if the table has a piece that crosses a cut."""
    for piece in table.pieces:
        if len(piece) > 1 and ("\n" in piece or SPACE in piece.lstrip(SPACE)):
            raise ValueError(f"piece {piece!r} crosses a word border")


def frequent_words(docs: DataFrame, text: str, most: int = DICTIONARY) -> DataFrame:
    """(word, n): all words at least as frequent as a count that leaves at most ``most`` of them."""
    words = docs.select(F.explode(F.split(marked(F.coalesce(F.col(text), F.lit(""))), CUT)).alias("word"))
    counts = words.where(F.length("word").between(1, MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))
    # Written once, as the texts would else be cut and counted for the histogram and again for the words.
    counts = keep(counts.where("n > 1"), "word-counts")
    # A coarse histogram, a few hundred rows, finds the least count.
    level = F.floor(F.log2("n") * 16)
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n"))
    total, least = 0, None
    for row in sorted(histogram.collect(), key=lambda r: -r["level"]):
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    return counts.where(F.col("n") >= least) if least is not None else counts.where("false")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): every piece that is a substring of the word, as (start, end, id, score), best score first."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(
        F.sequence(F.col("start") + 1, F.least(n, F.col("start") + longest))).alias("end"))
    substrings = spans.withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("end") - F.col("start")))
    # One row per vocabulary entry: bounded by the model file.
    edges = substrings.join(F.broadcast(pieces), "piece")
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "start", "end", "id")))
    return words.join(edges.groupBy("word").agg(best_first.alias("edges")), "word", "left")


def merge_fold(word: Column, edges: Column) -> Column:
    """Cuts left after merging the best applicable edge again and again, as array of positions."""
    n = F.length(word)
    one = F.lit(1).cast("long")

    def up_to(k: Column) -> Column:
        return F.call_function("shiftleft", one, k) - one

    usable = F.transform(F.filter(edges, lambda e: e["end"] - e["start"] > 1), lambda e: F.struct(
        e["start"], e["end"], (up_to(e["end"]) - up_to(e["start"] + 1)).alias("inside")))

    def step(cuts, _):
        def fits(e):
            return (F.getbit(cuts, e["start"]) == 1) & (F.getbit(cuts, e["end"]) == 1) & (
                F.bit_count(cuts.bitwiseAND(e["inside"])) == 1)

        found = F.filter(usable, fits)
        return F.when(F.size(found) > 0, cuts.bitwiseAND(F.bitwise_not(F.get(found, F.lit(0))["inside"]))).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), up_to(n + 1), step)
    return F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit(cuts, i) == 1)


def viterbi_fold(word: Column, edges: Column, unknown_cost: float = 1e4) -> Column:
    """Cuts of the path with the least summed cost, as array of positions; a character without edge costs ``unknown_cost``."""
    kind = "array<struct<cost:double,cuts:array<int>>>"
    begin = F.array(F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0)).alias("cuts"))).cast(kind)

    def step(paths, i):
        def extended(start, cost):
            before = F.get(paths, start)
            return F.struct((before["cost"] + cost).alias("cost"), F.array_append(before["cuts"], i).alias("cuts"))

        into = F.transform(F.filter(edges, lambda e: e["end"] == i), lambda e: extended(e["start"], e["cost"]))
        options = F.array_append(into, extended(i - 1, F.lit(unknown_cost)))
        return F.array_append(paths, F.array_min(options))

    paths = F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step)
    return F.element_at(paths, -1)["cuts"]


def encode_words(words: DataFrame, spark: SparkSession, table: PieceTable, fold=merge_fold) -> DataFrame:
    """(word, segments): the segments of every word by the lattice and ``fold``."""
    pieces = spark.createDataFrame([(p, i, s) for p, (i, s) in table.pieces.items()], "piece string, id int, score double")
    edges = lattice(words.select("word"), pieces, table.longest)
    cuts = edges.select("word", fold(F.col("word"), F.coalesce("edges", F.array().cast(
        "array<struct<cost:double,start:int,end:int,id:int>>"))).alias("cuts"))
    return cuts.select("word", F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda a, k: F.substring(
        F.col("word"), a + 1, F.get("cuts", k + 1) - a)).alias("segments"))


class Folder(dict):
    """Ids of words: those of the dictionary, and of rarer ones by best-first merges when first met."""

    def __init__(self, table: PieceTable, dictionary: dict[str, list[str]]):
        super().__init__()
        self.table = table
        self.fixed = {w: self.ids(s) for w, s in dictionary.items()}
        self.update(self.fixed)

    def ids(self, segments: list[str]) -> bytes:
        out = []
        for s in segments:
            if s in self.table.pieces:
                out.append(self.table.pieces[s][0])
            elif self.table.byte_ids:
                out.extend(self.table.byte_ids[b] for b in s.encode())
            else:
                out.append(self.table.unknown)
        return np.array(out, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if "\n" in word or SPACE in word.lstrip(SPACE):
            out = b"".join(map(self.__getitem__, _WORDS.findall(word)))
        else:
            out = self.ids(self.merge(word))
        if len(word) > MAX_WORD:
            return out  # hardly ever met again, and of any size
        if len(self) > len(self.fixed) + MEMO:
            self.clear()
            self.update(self.fixed)
        self[word] = out
        return out

    def merge(self, word: str) -> list[str]:
        """Merge the best-scoring neighbours, leftmost first among equals, until no piece fits."""
        pieces, parts = self.table.pieces, list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts):
                joined = parts[a] + parts[b]
                if joined in pieces:
                    heapq.heappush(heap, (-pieces[joined][1], a, joined))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = after[a]
            if not parts[a] or b >= len(parts) or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in parts if p]


#: The folder of the running query, kept by each Python worker from task to task.
_FOLDERS: dict[str, Folder] = {}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``TOGETHER`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def encode(docs: DataFrame, path: str, text: str = "text", most: int = DICTIONARY) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (unsigned 32-bit, little-endian) to every row."""
    spark = docs.sparkSession
    table = load_pieces(path)
    check_cuts(table)
    frequent = frequent_words(docs, text, most)
    chosen = encode_words(frequent, spark, table).toPandas()  # at most ``most`` rows
    forget(frequent)
    shared = spark.sparkContext.broadcast((table, dict(zip(chosen["word"], map(list, chosen["segments"])))))

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _FOLDERS:
            _FOLDERS.clear()
            _FOLDERS[key] = Folder(*shared.value)
        look = _FOLDERS[key].__getitem__
        for batch in _slices(batches):
            ids = []
            for value in batch.column(text).to_pylist():
                if not value:
                    ids.append(b"")
                elif "  " in value or value[0] == " " or value[-1] == " " or SPACE in value or "\n " in value or " \n" in value:
                    ids.append(b"".join(map(look, _WORDS.findall(SPACE + value.replace(" ", SPACE)))))
                else:
                    ids.append(b"".join([look(SPACE + w) for w in value.split(" ")]))
            kept = [n for n in batch.schema.names if n not in ("ids", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[*kept, "n_tokens", "ids"])

    plain = docs.drop("ids", "n_tokens")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema] + ["n_tokens long", "ids binary"])
    return plain.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``: the text that ``ids`` stand for; bytes that are no UTF-8 become U+FFFD."""
    texts = load_pieces(path).texts
    mark = SPACE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = texts.__getitem__
        for batch in _slices(batches):
            out = []
            for ids in batch.column("ids").to_pylist():
                raw = b"".join(map(look, np.frombuffer(ids or b"", "<u4").tolist()))
                out.append(raw.removeprefix(mark).replace(mark, b" ").decode("utf-8", "replace"))
            kept = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.string())], names=[*kept, "decoded"])

    plain = encoded.drop("decoded")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema] + ["decoded string"])
    return plain.mapInArrow(run, schema)
