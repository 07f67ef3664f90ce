"""Nearest neighbours by a block matrix join of quantised tiles.

Each vector becomes int8 codes and a scale. The product of two tiles of codes gives every inner product of the
pair up to an error that the vectors' residuals bound, so a candidate whose upper bound is below the k-th best score
seen so far cannot be among the nearest. The pairs that survive are computed again from the original components
and merged by heaps. The bound makes the result exact, not just likely.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import best, read
from ledgerline.llm.tiles import tile_pairs, usable, widened

TOGETHER, PAIRS = 512, 1 << 16  # queries of a matrix product, pairs computed at once from their components
FOUND = "query_id long, vec_id long, score double"


def quantised(rows: np.ndarray):
    """int8 codes, scales, and, in units of the scale, the lengths of the codes and of what they miss."""
    scale = np.abs(rows).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    units = rows / scale[:, None]
    codes = np.rint(units).clip(-127, 127).astype(np.int8)
    return codes, scale, np.linalg.norm(codes.astype(np.float64), axis=1), np.linalg.norm(units - codes, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added in order, so the sum does not depend on how pairs are batched.

    Where a term or a sum on the way is beyond doubles, the rows are scaled first, so that only a result beyond doubles is infinite.
    """
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
        lost = np.flatnonzero(~np.isfinite(total))
        if len(lost):
            powers = [np.frexp(np.abs(x[lost]).max(axis=1))[1] for x in (a, b)]
            small = inner(*(np.ldexp(x[lost], -p[:, None]) for x, p in zip((a, b), powers)))
            total[lost] = np.ldexp(small, powers[0] + powers[1])
    return total


def tile_nearest(query_ids, queries, ids, rows, k: int, floor=None):
    """Every row of a tile that can be among a query's ``k`` nearest, with its true score; none below the query's ``floor``."""
    queries, rows = widened(queries, rows)
    floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
    qc, qs, qn, qe = quantised(queries)
    rc, rs, rn, re = quantised(rows)
    kind = np.float32 if rows.shape[1] < 1 << 16 else np.float64
    # <q, r> <= <q', r'> + |q'||r - r'| + |q - q'||r'| + |q - q'||r - r'|, and the rounding of the sums; the last terms are two more components, so one product gives the bounds
    lost = 2 * (rows.shape[1] + 8) * float(np.finfo(kind).eps) + 1e-12
    top = rs.max(initial=0)  # bounds are in units of a query's scale, which changes no order, and of the rows' largest, and stay finite
    left = np.column_stack([qc, qn, qe]).astype(kind)
    right = (np.column_stack([rc, (re + lost * rn) * (1 + 2 * lost), (rn + re) * (1 + 2 * lost)]) * (rs / top)[:, None]).astype(kind)
    found = []

    def scored(q, r):
        return np.concatenate([inner(queries[q[i : i + PAIRS]], rows[r[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)] or [np.empty(0)])

    for first in range(0, len(queries), TOGETHER):
        bound = left[first : first + TOGETHER] @ right.T
        new = np.flatnonzero(floor[first : first + TOGETHER] == -np.inf)
        if len(new) and len(rows) > k:  # the true scores of the k + 1 largest bounds, one of which may be the query itself
            r = np.argpartition(bound[new], len(rows) - k - 1, axis=1)[:, len(rows) - k - 1 :]
            q = np.repeat(first + new, k + 1)
            score = np.where(ids[r.ravel()] == query_ids[q], -np.inf, scored(q, r.ravel()))
            floor[first + new] = np.sort(score.reshape(r.shape), axis=1)[:, 1]
        q, r = np.divmod(np.flatnonzero(bound >= least(floor[first : first + TOGETHER], qs[first : first + TOGETHER], top).astype(kind)[:, None]), len(rows))
        other = ids[r] != query_ids[first + q]
        q, r = first + q[other], r[other]
        score = scored(q, r)
        good = score >= floor[q]
        found.append((query_ids[q[good]], ids[r[good]], score[good]))
    return tuple(np.concatenate(x) for x in zip((query_ids[:0], ids[:0], np.empty(0)), *found))


def least(score, scale, top):
    """A bound that a row with this score or a larger one is never below. Scores beyond doubles are equal, whatever their bounds, as are those below."""
    with np.errstate(over="ignore"):
        bound = (np.minimum(score, np.finfo(np.float64).max) - 1e-290) / np.maximum(scale, top) / np.minimum(scale, top)
    bound = np.clip(bound, -1e37, 1e37)
    return bound - np.abs(bound) * 1e-6 - 1e-30


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each query: ``query_id, rank, vec_id, score``.

    Scores are inner products of the original vectors in double precision; those beyond doubles are infinite. A query never finds the row of its
    own id; ties go to the smaller id. Vectors that are null, all zero (or empty), or hold a null, infinite or NaN
    component take no part, nor do rows without an id. Rows of one id count once, with the least of their
    vectors. The shorter of two vectors counts as if it ended in zeros. Empty tables give no rows; other
    columns are never read.
    """

    def clean(df):
        vector = F.col(vector_column)
        return df.where(F.col(id_column).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0))

    found = tile_pairs(clean(queries), clean(rows), id_column, vector_column, partial(tile_nearest, k=k), k, FOUND)
    return best(found, "query_id", [F.desc("score"), F.asc("vec_id")], k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op6_nearest_neighbours(spark, folder) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    return nearest(rows.where(F.col("vec_id") % 20 == 0), rows, 20)


SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
  )
) WHERE rank <= 20
"""
