"""Exact top-k inner-product search with vector-approximation files.

Every vector becomes a row of small cell numbers (one byte per component). Reading only these, a query
gets a lower and an upper bound of its score with every vector. The k-th best lower bound over all blocks
is a score that the k-th result reaches for certain, so vectors whose upper bound is below it are out. Exact
vectors of the others are then read in the order of their bounds: first the most promising ones, and, with
the k-th exact score of those known, every further one whose bound still reaches it.

Queries and vectors are dealt in hash blocks of bounded size, so a pass is one task per pair of blocks; the
number of pairs grows with queries times vectors, as the question itself does.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, as query or as
candidate; a vector shorter than others counts as if it ended in zeros; rows repeated with equal id and vector
count once; a row never is a result of a query with its own id; a query without candidates gives no row;
other columns of the input are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import keep

SCALE = 1024
BLOCK_VECTORS = 2048
BLOCK_QUERIES = 1024
CELLS = 64
#: Exact vectors read first, as a multiple of k.
FIRST = 4


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, key): floor(1024 x) of every component of the vectors that take part, equal rows once.

    ``key`` tells rows with one id but different vectors apart."""
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE))
    usable = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.forall(
        F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), whole.cast("array<bigint>").alias("v"))
            .dropDuplicates(["vec_id", "v"]).withColumn("key", F.xxhash64("vec_id", "v")))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _blocks(rows: DataFrame, n: int, width: int, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """One row a block: ids, cell numbers and exact components, each as one binary."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(list(pdf["v"]), width)
        cells = np.minimum((v - low) // step, CELLS - 1).astype(np.uint8)
        ids = pdf[["vec_id", "key"]].to_numpy(np.int64)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [ids.tobytes()],
                             "cells": [cells.tobytes()], "exact": [v.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, "block int, ids binary, cells binary, exact binary")


def _bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) score bounds of every query with every row of cells, rounded outwards by the float error."""
    bottom = (low + cells.astype(np.int64) * step).astype(np.float64)
    q = q.astype(np.float64)
    base = q @ bottom.T
    reach = (step - 1).astype(np.float64)
    up, down = np.maximum(q, 0) @ reach, np.minimum(q, 0) @ reach
    slack = (np.abs(q) @ np.abs(bottom).max(axis=0) + up - down) * 1e-12
    return base + (down - slack)[:, None], base + (up + slack)[:, None]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row for which ``is_query`` holds."""
    rows = keep(quantised(vectors), "vectors")
    spread = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).toPandas()  # one row per component
    n = rows.count()
    n_queries = rows.where(is_query).count()
    width = int(spread["pos"].max()) + 1 if len(spread) else 1
    low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for pos, a, b, held in spread.itertuples(index=False):
        # Shorter vectors hold zeros here.
        low[pos], high[pos] = (a, b) if held == n else (min(a, 0), max(b, 0))
    step = np.maximum((high - low) // CELLS + 1, 1)

    data = keep(_blocks(rows, max(1, -(-n // BLOCK_VECTORS)), width, low, step), "approximations", "none")
    q_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    asked = _blocks(rows.where(is_query), q_blocks, width, low, step).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("exact").alias("q"))
    asked = keep(asked, "queries", "none")
    # Every block of vectors meets every block of queries; the cells are what travels.
    scans = data.select("block", "ids", "cells", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    pairs = scans.repartition(max(1, q_blocks * -(-n // BLOCK_VECTORS)), "q_block", "block").join(asked, "q_block")

    def unpack(row: dict) -> tuple:
        q_ids, ids = (np.frombuffer(row[c], np.int64).reshape(-1, 2) for c in ("q_ids", "ids"))
        q = np.frombuffer(row["q"], np.int64).reshape(len(q_ids), width)
        lower, upper = _bounds(q, np.frombuffer(row["cells"], np.uint8).reshape(len(ids), width), low, step)
        other = q_ids[:, :1] != ids[None, :, 0]
        return q_ids, ids, np.where(other, lower, -np.inf), np.where(other, upper, -np.inf)

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, _, lower, _ = unpack(row)
                best = -np.sort(-lower, axis=1)[:, :k] if lower.shape[1] <= k else -np.partition(-lower, k - 1, axis=1)[:, :k]
                found = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[:, 0], found.sum(axis=1))), pa.array(best[found])],
                                                 names=["query_id", "lower"])

    ranked = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floor = (pairs.mapInArrow(certain, "query_id long, lower double")
             .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
             .groupBy("query_id").agg(F.min("lower").alias("lower"), F.count("*").alias("n"))
             # With fewer than k candidates in all, each of them is a result.
             .select("query_id", F.when(F.col("n") == k, F.col("lower")).otherwise(F.lit(float("-inf"))).alias("floor")))
    # The floors travel with the blocks of their queries.
    floors = floor.withColumn("q_block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(q_blocks)).cast("int"))

    def collect(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"q_block": [int(pdf["q_block"].iloc[0])], "f_ids": [pdf["query_id"].to_numpy(np.int64).tobytes()],
                             "floors": [pdf["floor"].to_numpy(np.float64).tobytes()]})

    packed = keep(floors.groupBy("q_block").applyInPandas(collect, "q_block int, f_ids binary, floors binary"), "floors", "none")

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids, _, upper = unpack(row)
                known = dict(zip(np.frombuffer(row["f_ids"], np.int64).tolist(), np.frombuffer(row["floors"], np.float64)))
                least = np.array([known.get(i, np.inf) for i in q_ids[:, 0].tolist()])
                a, b = np.nonzero((upper >= least[:, None]) & np.isfinite(upper))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[a, 0]), pa.array(q_ids[a, 1]), pa.array(ids[b, 0]), pa.array(ids[b, 1]), pa.array(upper[a, b])],
                    names=["query_id", "q_key", "vec_id", "v_key", "upper"])

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    left = keep(pairs.join(packed, "q_block").mapInArrow(survive, "query_id long, q_key long, vec_id long, v_key long, upper double")
                .withColumn("place", F.row_number().over(by_bound)), "candidates")
    first = keep(_exact(left.where(F.col("place") <= FIRST * k), rows), "first-read")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = (first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
               .select("query_id", F.col("score").alias("reached")))
    more = (left.where(F.col("place") > FIRST * k).join(reached, "query_id")
            .where(F.col("upper") >= F.col("reached")).drop("reached"))
    return (first.unionByName(_exact(more, rows)).withColumn("rank", F.row_number().over(by_score))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _exact(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) with the exact vectors of both."""
    both = (candidates.select("query_id", "q_key", "vec_id", "v_key")
            .join(rows.select(F.col("key").alias("v_key"), F.col("v").alias("b")), "v_key")
            .join(rows.select(F.col("key").alias("q_key"), F.col("v").alias("a")), "q_key"))
    total = F.aggregate(F.zip_with("a", "b", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))),
                        F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("query_id", "vec_id", total.alias("score"))
