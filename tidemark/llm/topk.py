"""Exact top-k search by inner product: columnar branch and bound.

Vectors become integers. Candidates are packed in blocks, one column a dimension, the dimensions in the order of their mass in
the block; beside them lie the masses that remain behind every STEP dimensions. Queries are packed in blocks too. Candidate and query blocks are dealt
over slots of a bounded number of blocks, and every pair of slots is one group. For a query, partial scores are accumulated down
the columns, STEP dimensions at a time, and a candidate stays only while its partial score plus the product of the remaining
masses (Cauchy-Schwarz) reaches the k-th best score known; survivors are compacted after every step. A query's best k and its
threshold go on from block to block of a group, and groups are merged by rank.

Masses that remain are sums of their own terms, from the last dimension on, not differences, and the bound is widened by SLACK, more than doubles
can err over any number of dimensions that fits in memory; so no candidate is lost, however large the components. Products run in doubles
where all sums stay below 2 ** 53, so that doubles are exact, and in 64-bit integers elsewhere.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither do null ids; an empty
vector scores 0 with all; a shorter vector counts as having zeros behind; rows that share an id with the query are not its
candidates; repeated rows are candidates each; ties go to the smaller id; an empty table gives an empty result; extra columns are not read. Scores must
fit in 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm._shared import written

#: Vectors of a block, queries of a block, and dimensions of a step.
CANDIDATES, QUERIES, STEP = 8192, 512, 8
#: Blocks of a slot of candidates and of a slot of queries.
SLOT_BLOCKS, QUERY_SLOT_BLOCKS = 8, 16
SLACK = 1e-6

BLOCK = "n int, dims int, ids binary, m binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """id, v (array<bigint>) -> blocks: ids and a column-major matrix, as bytes. Blocks end with their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[list[int]] = []

        def block() -> pa.RecordBatch:
            dims = max(map(len, rows))
            m = np.zeros((len(rows), dims), np.int64)
            for k, r in enumerate(rows):
                m[k, : len(r)] = r
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m.T).tobytes()], pa.binary())], names=["n", "dims", "ids", "m"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    return vectors.mapInArrow(run, BLOCK)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and columns."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["m"], np.int64).reshape(row["dims"], row["n"])


def remaining(columns: np.ndarray) -> np.ndarray:
    """(steps, n): the root of the mass of all dimensions behind each step."""
    squares = columns.astype(float) ** 2
    ends = range(STEP, len(columns) + STEP, STEP)
    out = np.zeros((len(ends), columns.shape[1]))
    for k in range(len(out) - 2, -1, -1):
        out[k] = out[k + 1] + squares[ends[k] : ends[k + 1]].sum(0)
    return np.sqrt(out)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_block(q: np.ndarray, q_rest: np.ndarray, q_id: int, columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, k: int, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a block (scores, ids) among which are all of its k best that score `floor` or more. columns: (dims, n), rest: remaining(columns)."""
    kept = np.flatnonzero(ids != q_id)
    part = np.zeros(len(kept), columns.dtype)
    for step in range(len(rest)):
        use = slice(step * STEP, (step + 1) * STEP)
        values = columns[use] if len(kept) == columns.shape[1] else columns[use][:, kept]
        part += q[use] @ values
        if step == len(rest) - 1:
            break
        reach = rest[step][kept] * (q_rest[step] * (1 + SLACK)) + 1
        at_least = part - reach
        if len(kept) > k:
            floor = max(floor, np.partition(at_least, -k)[-k])
        stay = part + reach >= floor - abs(floor) * 1e-15 if math.isfinite(floor) else slice(None)
        kept, part = kept[stay], part[stay]
        if not len(kept):
            break
    return part, ids[kept]


def search_group(queries: list[dict], candidates: list[dict], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k best among the candidates."""
    prepared = []
    for row in candidates:
        ids, columns = _unpacked(row)
        order = np.argsort(-(columns.astype(float) ** 2).sum(1), kind="stable")
        columns = columns[order]
        prepared.append((ids, order, columns, remaining(columns), float(np.abs(columns).max(initial=0))))
    out = []
    for row in queries:
        q_ids, qs = _unpacked(row)
        top = float(np.abs(qs).max(initial=0))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
        for ids, order, columns, rest, most in prepared:
            own = np.zeros((len(order), len(q_ids)), np.int64)
            has = order < len(qs)
            own[has] = qs[order[has]]  # dimensions that only one side has count as zeros
            q_rest = remaining(own)
            if top * most * max(1, len(order)) < 2**52:
                own, columns = own.astype(float), columns.astype(float)
            for j, q_id in enumerate(q_ids):
                scores, found = best[j]
                floor = float(scores[-1]) if len(scores) >= k else -math.inf
                s, i = search_block(np.ascontiguousarray(own[:, j]), q_rest[:, j], int(q_id), columns, rest, ids, k, floor)
                if len(i):
                    best[j] = best_of(np.concatenate([scores, s.astype(np.int64)]), np.concatenate([found, i]), k)
        out += [(int(q), i, s) for q, (s, i) in zip(q_ids, best, strict=True)]
    return out


def _searched(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    found = search_group(queries.to_pylist(), candidates.to_pylist(), k)
    columns = [np.repeat([q for q, *_ in found], [len(i) for _, i, _ in found]), *(np.concatenate([x[at] for x in found]) if found else [] for at in (1, 2))]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", least_slots: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row against all rows.

    Blocks are dealt over slots, SLOT_BLOCKS candidate blocks (at least least_slots slots) and QUERY_SLOT_BLOCKS query blocks to a slot on average, so that
    groups keep their size and are many. A candidate block is sent once a query slot, a query block once a candidate slot.
    """
    as_ints = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    good = vectors.where(F.coalesce(sound, F.lit(False)))
    shape = good.select(F.col(key).cast("bigint").alias("id"), as_ints.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, n_queries = shape.agg(F.count(F.lit(1)), F.count_if("q")).first()
    slots, query_slots = max(least_slots, math.ceil(n / (CANDIDATES * SLOT_BLOCKS))), max(1, math.ceil(n_queries / (QUERIES * QUERY_SLOT_BLOCKS)))
    slot = lambda m: F.pmod(F.xxhash64("ids"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    candidates = _packed(shape.select("id", "v"), CANDIDATES).select("*", slot(slots).alias("cs"), every(query_slots).alias("qs"))
    queries = _packed(shape.where("q").dropDuplicates(["id", "v"]).select("id", "v"), QUERIES).select("*", slot(query_slots).alias("qs"), every(slots).alias("cs"))
    pairs = candidates.groupBy("cs", "qs").cogroup(queries.groupBy("cs", "qs"))
    parts = written(pairs.applyInArrow(lambda c, q: _searched(c, q, k), FOUND), "top")
    w = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(50)) == 0)
