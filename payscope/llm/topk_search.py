"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each segment its mean and deviation are kept. For two vectors
the squared distance is at least the sum over segments of
length * ((mean - mean')^2 + (deviation - deviation')^2), and as the score is
(|q|^2 + |x|^2 - distance^2) / 2, that lower bound on the distance is an upper bound on the score:
the sum of length * (mean * mean' + deviation * deviation'). Coarse segments sift first, finer ones
what is left, and exact scores are computed for the survivors.

Queries and rows are dealt to blocks of bounded size; each pair of blocks is one group of a
cogroup. Rows of a block are taken by vec_id, so an equal score of a later row never displaces an
earlier one. The best k of each pair of blocks meet in a window that is cut to k before its shuffle.

Vectors that are null or hold null or non-finite components take no part, nor do rows without a
vec_id. Only vectors of equal length are compared. Repeated rows are rows of their own: a query is
kept from itself alone. An empty table gives an empty result. Only vec_id and embedding are read, so
further columns, whatever their names, change nothing. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.llm.common import ratio_up, staged

LEVELS = (4, 16)  # segments at each level, coarse to fine


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, vec (integer components) and dim of the rows that take part."""
    vector = F.col("embedding")
    sound = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")),
    )
    return embeddings.filter(F.col("vec_id").isNotNull() & vector.isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
        F.size(vector).alias("dim"),
    )


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length.

    The inner product of two rows of features is the upper bound on the score of the vectors.
    """
    parts = np.array_split(vectors, min(segments, max(1, vectors.shape[1])), axis=1)
    columns = []
    for part in parts:
        length = max(1, part.shape[1])
        mean = part.sum(axis=1) / length
        columns += [mean * length**0.5, np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(columns, axis=1)


def best_of_block(
    queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, step: int = 2048
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of each query's k best rows; ties to the earlier row.

    Position -1 stands where there are fewer than k. `query_rows` and `row_ids` identify rows, so
    that a query does not meet itself.
    """
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    as_float = exact < 2**53
    q, x = (queries.astype(float), rows.astype(float)) if as_float else (queries, rows)
    low = np.iinfo(np.int64).min + 1  # so that it can be negated
    top = np.full((len(q), k), low)
    place = np.full((len(q), k), -1)
    coarse = [(segment_features(queries.astype(float), n), segment_features(rows.astype(float), n)) for n in LEVELS]
    slack = 1e-9 * max(1.0, exact)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        worst = top[:, -1].astype(float)
        # A row must beat the k-th best so far by at least 1 to come in.
        (fq, fx), *finer = coarse
        i, j = np.nonzero(fq @ fx[at : at + step].T >= (worst + 1 - slack)[:, None])
        for fq, fx in finer if len(i) * 8 < len(q) * len(part) else []:
            keep = np.einsum("ij,ij->i", fq[i], fx[at + j]) >= worst[i] + 1 - slack
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        if len(i) * 8 < len(q) * len(part):
            scores = np.einsum("ij,ij->i", q[i], part[j])
        else:  # most survive: one product of blocks costs less than picking rows
            scores = (q @ part.T)[i, j]
        scores = scores.astype(np.int64)
        keep = (scores > top[i, -1]) & (row_ids[at + j] != query_rows[i])
        i, j, scores = i[keep], j[keep], scores[keep]
        hit, inverse = np.unique(i, return_inverse=True)
        alls = np.concatenate([np.repeat(hit, k), hit[inverse]])
        score = np.concatenate([top[hit].ravel(), scores])
        where = np.concatenate([place[hit].ravel(), at + j])
        order = np.lexsort((where, -score, alls))
        alls, score, where = alls[order], score[order], where[order]
        first = np.searchsorted(alls, hit)[:, None] + np.arange(k)
        top[hit], place[hit] = score[first], where[first]
    return place, top


def search(
    rows: DataFrame, is_query: Column, k: int = 20, query_block: int = 2048, row_block: int = 16384
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query, ties to smaller vec_id.

    `rows` has vec_id, vec and dim as made by `quantised`; `is_query` says which rows are queries.
    """
    rows = staged(rows.withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    row_blocks, query_blocks = ratio_up(n, row_block), ratio_up(n_queries, query_block)

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("row_id"), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    dealt = rows.withColumn("row_block", block(row_blocks)).withColumn("query_block", each(query_blocks))
    asked = (
        rows.filter(is_query)
        .withColumn("query_block", block(query_blocks))
        .withColumn("row_block", each(row_blocks))
    )
    keys = ["query_block", "row_block", "dim"]

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1) if len(flat) else np.zeros((t.num_rows, 0), np.int64)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("vec_id", "ascending"), ("row_id", "ascending")])
        ids, row_ids = right.column("vec_id").to_numpy(), right.column("row_id").to_numpy()
        asked_ids, asked_rows = left.column("vec_id").to_numpy(), left.column("row_id").to_numpy()
        if not left.num_rows or not right.num_rows:
            place = top = np.full((0, k), -1)
        else:
            place, top = best_of_block(matrix(left), asked_rows, matrix(right), row_ids, k)
        i, j = np.nonzero(place >= 0)
        at = place[i, j]
        return pa.table(
            {
                "query_row": asked_rows[i],
                "query_id": asked_ids[i],
                "row_id": row_ids[at],
                "vec_id": ids[at],
                "score": top[i, j],
            }
        )

    found = (
        asked.groupBy(*keys)
        .cogroup(dealt.groupBy(*keys))
        .applyInArrow(pair, "query_row bigint, query_id bigint, row_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
