"""Exact top-k search with block-at-a-time pruning.

Candidates are cut into blocks of neighbouring ids. A block keeps, for each term, the largest weight any
of its rows has; a dimension stands for two terms, one for each sign. For a query the blocks are ordered by the
bound that these maxima sum to, and scored through their forward index (the rows of the block, whole) until the
bounds fall below the k-th best score. A block whose bound equals the k-th score is still scored: ties go to the
smaller id.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import best, read
from ledgerline.llm.tiles import tile_pairs, usable, widened

BLOCK, SCALE = 64, 256
TOGETHER, AT_ONCE = 512, 16  # queries and blocks of a matrix product
LARGEST = (1 << 63) - 1  # scores beyond a long stop here
FOUND = "query_id long, vec_id long, score long"


def block_top_k(query_ids, queries, ids, rows, k: int, block: int = BLOCK, floor=None):
    """Top ``k`` rows of a tile for each query, without those below its ``floor``. All weights are whole numbers."""
    queries, rows = widened(queries, rows)
    lowest = np.iinfo(np.int64).min
    floor = np.full(len(queries), lowest) if floor is None else floor
    starts = np.arange(0, len(ids), block)
    # sums of whole numbers stay exact in singles while they cannot pass 2^24, in doubles up to 2^53, in longs up to 2^63, beyond that in whole numbers of any size
    reach = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * rows.shape[1]
    if reach >= 2.0**53:
        whole = (lambda x: x.astype(np.int64)) if reach < 2.0**62 else np.frompyfunc(int, 1, 1)
        queries, rows = whole(queries), whole(rows)
    elif reach < 2.0**24 and all((x == np.rint(x)).all() for x in (queries, rows)):
        queries, rows = queries.astype(np.float32), rows.astype(np.float32)
    settled = (lambda x: np.clip(x, -LARGEST, LARGEST).astype(np.int64)) if rows.dtype == object else (lambda x: x)
    most, least = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    found = []
    for first in range(0, len(queries), TOGETHER):
        some, names = queries[first : first + TOGETHER], query_ids[first : first + TOGETHER]
        bounds = settled(np.maximum(some, 0) @ most.T + np.minimum(some, 0) @ least.T)
        kth = floor[first : first + TOGETHER].astype(bounds.dtype)
        order = np.argsort(-bounds.max(axis=0), kind="stable")
        for blocks in (order[i : i + AT_ONCE] for i in range(0, len(order), AT_ONCE)):
            open_ = bounds[:, blocks] >= kth[:, None]
            blocks, asking = blocks[open_.any(axis=0)], np.flatnonzero(open_.any(axis=1))
            if not len(asking):
                continue
            part = np.concatenate([np.arange(b, min(b + block, len(ids))) for b in starts[blocks]])
            scores = settled(some[asking] @ rows[part].T)
            if len(part) > k and (kth[asking] == lowest).any():  # one of the k + 1 best may be the query itself
                kth[asking] = np.maximum(kth[asking], np.partition(scores, len(part) - k - 1, axis=1)[:, len(part) - k - 1])
            i, j = np.divmod(np.flatnonzero(scores >= kth[asking][:, None]), len(part))
            other = ids[part[j]] != names[asking[i]]
            i, j = i[other], j[other]
            found.append((first + asking[i], ids[part[j]], scores[i, j]))
    q, v, s = (np.concatenate(x) for x in zip((np.empty(0, np.int64), ids[:0], np.empty(0, rows.dtype if rows.dtype != object else np.int64)), *found))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    chosen = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[chosen]], v[chosen], s[chosen].astype(np.int64)


def search(queries: DataFrame, rows: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each query: ``query_id, rank, vec_id, score``.

    Weights are whole numbers; scores are exact, and those beyond a long stop at 2^63 - 1 on either side. A query never finds the row of its own id. Vectors that are null or
    hold a null, infinite or NaN component take no part, nor do rows without an id. Rows of one id count
    once, with the least of their vectors. Vectors of different length are compared as if the shorter
    ended in zeros. Empty tables give no rows; other columns are never read.
    """
    clean = lambda df: df.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    found = tile_pairs(clean(queries), clean(rows), id_column, vector_column, partial(block_top_k, k=k), k, FOUND)
    return best(found, "query_id", [F.desc("score"), F.asc("vec_id")], k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op1_exact_top_k(spark, folder) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    impact = rows.select(
        "vec_id", F.when(usable(F.col("embedding")), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))).alias("embedding")
    )
    return search(impact.where(F.col("vec_id") % 50 == 0), impact, 5)


SQL = """
WITH impact AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM impact q JOIN impact c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
  )
) WHERE rank <= 5
"""
