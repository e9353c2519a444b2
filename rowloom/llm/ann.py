"""Approximate nearest neighbours by inner product, through learned partitions.

A bounded sample of vectors is linked to its nearest neighbours; that graph is cut into balanced parts; a softmax
classifier learns the part of a vector. Every row goes to its most probable part, every query to as many of its most
probable parts as the sample's own held-out neighbours need for the wanted recall, and the rows of these parts are
reranked exactly, in blocks.

Defined results: vectors that are null, zero, or hold a null or non-finite component, or have another length than most vectors,
take no part, neither as queries nor as candidates; a row is never its own neighbour, and of rows that share an id one
answer is given, with the best score; equal scores are in order of the id; with no valid rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import scratch

SAMPLE = 4096  # rows that the graph and the classifier are fitted on
GRAPH_DEGREE = 16
ROWS_PER_PART = 4096
PARTS = (16, 512)  # least and most; the sample bounds them to one for eight of its rows, so that parts grow with more than 2 million rows
RECALL = 0.97  # wanted on the sample
BLOCK_BYTES = 16 << 20  # of rows, and of queries, that are compared at once
SHARE = 1 << 22  # products in memory at once


@dataclass(frozen=True)
class Router:
    weights: np.ndarray  # [dim + 1, parts]
    scale: float
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return x @ self.weights[:-1] + self.weights[-1]


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.05, rounds: int = 12) -> np.ndarray:
    """A part for each node of a neighbour graph (rows of neighbour numbers), none with over slack * n / parts nodes.
    Nodes move to the part that most of their neighbours are in, strongest wishes first, as far as there is room."""
    n = len(graph)
    cap = int(np.ceil(slack * n / parts))
    order, seen, queue = [], np.zeros(n, bool), []
    for root in rng.permutation(n):  # breadth-first order keeps neighbours together in the first cut
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        for node in queue:
            order.append(node)
            for other in graph[node]:
                if not seen[other]:
                    seen[other] = True
                    queue.append(other)
    part = np.empty(n, np.int64)
    part[np.array(order)] = np.arange(n) * parts // n
    sources = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        pull = np.zeros((n, parts))
        np.add.at(pull, (sources, part[graph.ravel()]), 1)
        np.add.at(pull, (graph.ravel(), part[sources]), 1)
        room = np.full(parts, cap)
        wish = np.argsort(-pull, axis=1)
        new = np.full(n, -1)
        for node in np.argsort(-(pull.max(axis=1) - pull.mean(axis=1)), kind="stable"):
            for choice in wish[node]:
                if room[choice]:
                    new[node] = choice
                    room[choice] -= 1
                    break
        if (new == part).all():
            break
        part = new
    return part


def fit_router(sample: np.ndarray, parts: int, seed: int = 7, wanted: float = RECALL, steps: int = 300) -> Router:
    rng = np.random.default_rng(seed)
    n = len(sample)
    scale = float(np.sqrt((sample**2).sum(axis=1).mean())) or 1.0
    x = sample / scale
    products = x @ x.T
    np.fill_diagonal(products, -np.inf)
    degree = min(GRAPH_DEGREE, n - 1)
    if degree < 1 or parts < 2:
        return Router(np.zeros((sample.shape[1] + 1, 1)), scale, 1)
    near = np.argpartition(-products, degree - 1, axis=1)[:, :degree]
    part = balanced_parts(near, parts, rng)
    held = rng.random(n) < 0.1
    soft = np.zeros((n, parts))  # a vector should be routed to where its neighbours are, not only to its own part
    np.add.at(soft, (np.repeat(np.arange(n), degree), part[near.ravel()]), 0.5 / degree)
    soft[np.arange(n), part] += 0.5
    x1 = np.hstack([x, np.ones((n, 1))])
    w = np.zeros((x1.shape[1], parts))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam, whole batch
        z = x1[~held] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x1[~held].T @ (p - soft[~held]) / (~held).sum() + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = x1 @ w
    home = z.argmax(axis=1)
    queries = np.flatnonzero(held) if held.any() else np.arange(n)
    rank = np.empty_like(z[queries], dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-z[queries], axis=1), np.arange(parts)[None, :], axis=1)
    needs = np.take_along_axis(rank, home[near[queries]], axis=1)  # the probe that finds each neighbour
    recall = [(needs < k).mean() for k in range(1, parts + 1)]
    return Router(w, scale, next(k for k, r in enumerate(recall, 1) if r >= wanted))


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def top_pairs(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, id, score) of the k best rows of one block for each query. A fast product gives a shortlist with room for
    rounding; its scores are then summed in one order, so that equal vectors get equal scores wherever they are."""
    out_q, out_id, out_score = [], [], []
    step = max(1, SHARE // max(1, len(rows)))
    for i, qid in enumerate(query_ids):
        if i % step == 0:
            product = queries[i : i + step] @ rows.T
            slack = 1e-9 * (1 + np.abs(product).max(initial=0))
        row = product[i % step]
        own = ids == qid
        if own.any():
            row = np.where(own, -np.inf, row)
        ask = k
        while True:  # more are asked for only while repeated ids take places
            least = np.partition(row, len(row) - ask)[len(row) - ask] if ask < len(row) else -np.inf
            at = np.flatnonzero((row >= least - slack) & (row > -np.inf))
            score = (rows[at] * queries[i]).sum(axis=1)
            order = np.lexsort((ids[at], -score))
            at, score = at[order], score[order]
            _, first = np.unique(ids[at], return_index=True)
            first = np.sort(first)[:k]
            if len(first) == k or ask >= len(row):
                break
            ask *= 4
        out_q += [qid] * len(first)
        out_id += ids[at[first]].tolist()
        out_score += score[first].tolist()
    return out_q, out_id, out_score


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", wanted: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id (named id_col) and score of the k nearest found for each row that is_query selects."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask")
    ).filter(F.col("id").isNotNull() & valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    empty = f"query_id bigint, rank int, `{id_col}` bigint, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dim, total = sizes[0]
    rows = rows.filter(F.size("v") == dim)
    parts = int(np.clip(round(total / ROWS_PER_PART), *PARTS))
    hashed = rows.select("v").withColumn("h", F.xxhash64("v"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # hashes first, so that few vectors are shuffled
    drawn = hashed.filter(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").collect()  # copies count once: SAMPLE rows at most
    sample = np.array([r.v for r in drawn], np.float64)
    router = fit_router(sample, min(parts, max(1, len(sample) // 8)), wanted=wanted)
    probes = router.probes

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() * 7919
        for batch in batches:
            x = _matrix(batch.column(1))
            scores = router.scores(x) if batch.num_rows else np.zeros((0, 1))
            order = np.argsort(-scores, axis=1, kind="stable")
            ask = batch.column(2).to_numpy(zero_copy_only=False)
            routed = [o[:probes].tolist() if a else None for o, a in zip(order.astype(np.int32), ask)]
            slot = np.arange(seen, seen + batch.num_rows, dtype=np.int64)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(order[:, 0], pa.int32()), pa.array(slot), pa.array(routed, pa.list_(pa.int32()))],
                ["id", "v", "part", "slot", "routed"],
            )

    kind = rows.schema["v"].dataType.simpleString()
    table = scratch(rows.select("id", "v", "ask").mapInArrow(assign, f"id bigint, v {kind}, part int, slot bigint, routed array<int>"), "ann-rows")
    asked = table.filter("routed is not null").select(F.col("id").alias("qid"), F.col("v").alias("q"), "slot", F.explode("routed").alias("part"))
    n_rows = dict(map(tuple, table.groupBy("part").agg(F.count("*")).collect()))  # at most `parts` rows
    n_asked = dict(map(tuple, asked.groupBy("part").agg(F.count("*")).collect()))

    def blocks(counts: dict[int, int], size: int) -> Column:
        many = {p: -(-n // size) for p, n in counts.items() if n > size}
        if not many:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("part")), F.lit(1))

    size = max(1, BLOCK_BYTES // (8 * dim))
    row_blocks, ask_blocks = blocks(n_rows, size), blocks(n_asked, size)
    left = (
        table.select("id", "v", "part", F.pmod("slot", row_blocks).cast("int").alias("rb"), ask_blocks.alias("qn"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
        .drop("qn")
    )
    right = (
        asked.select("qid", "q", "part", F.pmod("slot", ask_blocks).cast("int").alias("qb"), row_blocks.alias("rn"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rn") - 1)))
        .drop("rn")
    )

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        got = top_pairs(b["qid"].to_numpy(), np.array(b["q"].tolist(), np.float64), a["id"].to_numpy(), np.array(a["v"].tolist(), np.float64), k)
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), got))).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    key = ["part", "rb", "qb"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rerank, "query_id bigint, id bigint, score double")
    best = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
