"""Token ids in compressed files: canonical length-limited Huffman codes from global counts.

A folder holds ``codebook`` (one row per used id: id, length) and ``blocks`` (part, block, data).
A block is self-contained next to the codebook and is laid out, little-endian, as

    magic "HTB1" | u32 docs D | u32 step K | u64 payload bytes
    D x (i64 doc_id, u8 has_id, u64 tokens, u64 payload offset in bytes)
    for each document, ceil(tokens / K) x u64 bit offset from the start of its payload (checkpoints)
    payload: the documents' codes, each document starting at a byte

Blocks follow each other in ascending ``doc_id`` order (null first, ties by content): ``part`` is the
range, ``block`` the place inside it. Any checkpoint can be decoded without what stands before it.

The counts are summed over all documents; only the code lengths (at most one per vocabulary entry)
reach the driver. Texts are encoded once; afterwards only ids and codes move.

Defined cases: a null text counts as empty and gives only the end id; repeated rows are written as
often as they occur; an empty table gives an empty folder that reads back as no rows; columns of the
input other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import forget, keep, small_side

#: Longest code in bits; a decoding table has 2 ** MAX_BITS entries. Holds vocabularies of up to 2 ** 18 ids.
MAX_BITS = 18
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1 << 24
#: Words remembered per Python worker, to bound its memory.
MEMO = 600_000
#: Marks the part of a text that no space precedes; a lone surrogate never occurs in a text.
_FIRST = "\ud800"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder(dict):
    """Whole-text ids from a byte-level tokenizer, encoding every distinct word once.

    Such a tokenizer never lets a token cross the gap between a visible character and a single space
    that a visible character follows; cutting there leaves the ids as they are. The mapping holds the
    ids of the words met so far, without the space before them. With ``special`` the names of special
    tokens stand for those tokens, as in the library's plain ``encode``; else they are letters like others.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = re.compile("|".join(names)) if names else None
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        raw = word[1:] if word[:1] == _FIRST else " " + word
        letters = raw.removeprefix(" ")
        if letters.isalpha() and max(letters) < "\u0250":
            # Letters alone are one piece for the tokenizer's model.
            ids = [t.id for t in self.tokenizer.model.tokenize(raw.encode().decode("latin-1").translate(self.letters))]
        elif letters[-1:] in _MARKS and letters[:-1].isalpha() and max(letters) < "\u0250":
            # So is a single mark after letters.
            out = self[word] = self[word[:-1]] + self[_FIRST + word[-1]]
            return out
        else:
            ids = self.tokenizer.encode(raw, add_special_tokens=False).ids
        out = self[word] = np.array(ids, self.width).tobytes()
        return out

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        if len(self) > MEMO:
            self.clear()
        end = np.array([end_id], self.width).tobytes()
        look, out = self.__getitem__, []
        for text in texts:
            if self.special and self.special.search(text):
                # The names are found before words are; the text goes through the tokenizer as a whole.
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes() + end)
                continue
            odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _RARE_SPACE.search(text)
            parts = _INNER_SPACE.split(text) if odd else text.split(" ")
            parts[0] = _FIRST + parts[0]
            out.append(b"".join(map(look, parts)) + end)
        return out


@cache
def _encoder(path: str, special: bool = False) -> WordEncoder:
    """One encoder a Python worker, which serves many tasks."""
    return WordEncoder(path, special)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, special: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every text, little-endian, ``end_id`` last; ``special`` as in :class:`WordEncoder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, special)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                ids = encoder.encode(texts[lo:lo + 256], end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, 256), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame, width: str) -> DataFrame:
    """(id, n) over all documents; every task adds up its own part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                part = np.bincount(np.frombuffer(ids.as_py(), width))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, leaves = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        half = len(level) // 2
        both = np.concatenate([weight, level[0: 2 * half: 2] + level[1: 2 * half: 2]])
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaves.append(place < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(leaves):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every id, ids in the order of their codes)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    top = int(sizes.max()) if len(sizes) else 0
    # Left-aligned codes are the running sum of 2 ** (top - length).
    starts = np.concatenate([[0], np.cumsum(np.int64(1) << (top - sizes))[:-1]]) if len(sizes) else sizes
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = starts >> (top - sizes)
    return codes, order


class Codec:
    """Encoding and table-driven decoding with one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes, order = canonical_codes(lengths)
        self.bits = max(1, int(lengths.max())) if len(order) else 1
        spread = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.taken = np.ones(1 << self.bits, np.uint8)
        filled = np.repeat(order, spread)
        self.table[: len(filled)] = filled
        self.taken[: len(filled)] = np.repeat(lengths[order], spread)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(payload, byte offset of every document and of the end, bit offset of every id from its document)."""
        lens = self.lengths[ids].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        bits = ends[first[1:]] - ends[first[:-1]]
        base = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
        local = ends[:-1] - np.repeat(ends[first[:-1]], sizes)
        at = local + np.repeat(base[:-1] * 8, sizes)
        value = self.codes[ids].astype(np.int64) << (32 - lens - (at & 7))
        out = np.zeros(int(base[-1]) + 4)
        for k in range(4):
            part = (value >> (24 - 8 * k)) & 255
            out += np.bincount((at >> 3) + k, part, len(out))[: len(out)] if len(part) else 0
        return out[: int(base[-1])].astype(np.uint8).tobytes(), base, local

    def decode(self, payload: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of independent runs that start at bits ``at`` and have ``counts`` ids, one after the other."""
        padded = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
        word = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        start = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(start[-1]), np.uint32)
        lanes = np.argsort(-counts, kind="stable")
        pos, begin = at[lanes].astype(np.int64), start[:-1][lanes]
        falling = -counts[lanes]
        shift = np.uint32(32 - self.bits)
        for step in range(int(counts.max()) if len(counts) else 0):
            n = int(np.searchsorted(falling, -step, "left"))
            if n < len(pos):
                pos, begin, falling = pos[:n], begin[:n], falling[:n]
            peek = (word[pos >> 3] << (pos & 7).astype(np.uint32)) >> shift
            out[begin + step] = self.table[peek]
            pos = pos + self.taken[peek]
        return out


def _code_documents(encoded: DataFrame, lengths: np.ndarray, width: str) -> DataFrame:
    """(doc_id, tokens, code, checks): one document's codes and checkpoints a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [np.frombuffer(x.as_py(), width) for x in part.column("ids")]
                sizes = np.array([len(x) for x in raw], np.int64)
                payload, base, local = codec.encode(np.concatenate(raw).astype(np.int64), sizes)
                first = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(sizes),
                    pa.array([payload[a:b] for a, b in zip(base[:-1], base[1:])], pa.binary()),
                    pa.array([local[a:b:CHECKPOINT].astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                ], names=["doc_id", "tokens", "code", "checks"])

    return encoded.mapInArrow(run, "doc_id long, tokens long, code binary, checks binary")


_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("tokens", "<u8"), ("at", "<u8")])


def _pack(rows: list[tuple]) -> bytes:
    head = np.zeros(len(rows), _DOC)
    at = 0
    for k, (doc_id, tokens, code, _) in enumerate(rows):
        head[k] = (doc_id or 0, doc_id is not None, tokens, at)
        at += len(code)
    return b"".join([struct.pack("<4sIIQ", b"HTB1", len(rows), CHECKPOINT, at), head.tobytes(),
                     *(r[3] for r in rows), *(r[2] for r in rows)])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, payload, start bit of every checkpoint, ids from it to the next)."""
    magic, n, step, size = struct.unpack_from("<4sIIQ", data)
    if magic != b"HTB1":
        raise ValueError("not a token block")
    at = struct.calcsize("<4sIIQ")
    docs = np.frombuffer(data, _DOC, n, at)
    at += docs.nbytes
    tokens = docs["tokens"].astype(np.int64)
    runs = (tokens + step - 1) // step
    checks = np.frombuffer(data, "<u8", int(runs.sum()), at).astype(np.int64)
    payload = np.frombuffer(data, np.uint8, size, at + checks.nbytes)
    counts = np.full(len(checks), step, np.int64)
    last = np.cumsum(runs) - 1
    counts[last] = tokens - (runs - 1) * step
    return docs, payload, checks + np.repeat(docs["at"].astype(np.int64) * 8, runs), counts


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, special: bool = False) -> None:
    """Encode all documents and write them to ``folder`` in ascending ``doc_id`` order.

    ``special``: whether names of special tokens in a text become those tokens."""
    spark = docs.sparkSession
    width = _encoder(tokenizer).width.str
    encoded = keep(encode_documents(docs, tokenizer, end_id, special), "token-ids", compression="zstd")
    counts = count_ids(encoded, width).toPandas()  # one row per used id at most
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    table[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = code_lengths(table)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in used], "id long, length int"
    ).coalesce(1).write.parquet(f"{folder}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, rows, held = TaskContext.get().partitionId(), 0, [], 0
        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([_pack(rows)], pa.binary())],
                names=["part", "block", "data"])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "code", "checks"))):
                rows.append(row)
                held += row[1]
                if held >= BLOCK_TOKENS:
                    yield out()
                    block, rows, held = block + 1, [], 0
        if rows:
            yield out()

    coded = keep(_code_documents(encoded, lengths, width), "token-codes", compression="none")
    forget(encoded)
    parts = max(1, -(-int(table.sum()) // PART_TOKENS))
    (coded
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tokens", "code")
        .mapInArrow(blocks, "part int, block long, data binary")
        .write.option("compression", "none").parquet(f"{folder}/blocks"))
    forget(coded)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids (unsigned 32-bit, little-endian) and those of all before it."""
    book = spark.read.schema("id long, length int").parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for base, data in zip(batch.column("base"), batch.column("data")):
                docs, payload, at, counts = _unpack(data.as_py())
                raw = codec.decode(payload, at, counts).astype("<u4").tobytes()
                ends = np.cumsum(docs["tokens"].astype(np.int64))
                starts = ends - docs["tokens"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs["doc_id"], mask=docs["has_id"] == 0), pa.array(starts + base.as_py()),
                    pa.array([raw[4 * a:4 * b] for a, b in zip(starts, ends)], pa.binary()),
                ], names=["doc_id", "start", "ids"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(d.as_py(), _DOC, struct.unpack_from("<4sIIQ", d.as_py())[1], struct.calcsize("<4sIIQ"))["tokens"].sum())
                    for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), pa.array(sums, pa.int64())],
                                             names=["part", "block", "n"])

    stored = spark.read.schema("part int, block long, data binary").parquet(f"{folder}/blocks")
    sizes = keep(stored.mapInArrow(totals, "part int, block long, n long"), "token-blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    offsets = (sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
               .join(files, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("base")))
    placed = stored.join(small_side(offsets, sizes.count(), 32), ["part", "block"])
    return placed.select("base", "data").mapInArrow(run, "doc_id long, start long, ids binary")


def digest(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what :func:`read_files` gives."""
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
