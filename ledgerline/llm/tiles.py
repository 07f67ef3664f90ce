"""Queries and candidates dealt over a grid of tasks, and in each task every query held against tiles of candidates.

Shared by the two vector searches. A tile is a matrix of vectors of ascending ids with those ids. Rows are dealt to the
tasks by number, in one shuffle: what a task gets follows from the ids alone, nothing is broadcast and no pair of tiles is a row.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import partitions

HEIGHT, WEIGHTS = 4096, 1 << 21  # rows of a tile at most, and components of a tile of wide vectors
MOST = 16_384  # queries that a task holds at a time
NEIGHBOURS = 9  # ids that agree but for so many bits stay together, so that a block of a tile holds neighbouring ids
Tile = tuple[np.ndarray, np.ndarray]


def usable(vector: Column) -> Column:
    """Not null, and every component present and finite."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN sorts above infinity
    return vector.isNotNull() & F.forall(vector, finite)


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns; a component that a vector lacks counts as 0."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


class Heaps:
    """The ``k`` best candidates of each of some queries (their ids ascend), ties to the smaller id. ``floor`` is the score of a
    query's k-th, the least there is while it has fewer: what is below it need not be added."""

    def __init__(self, k: int, queries: np.ndarray, kind: type):
        self.k, self.queries, self.kept = k, queries, [[] for _ in queries]
        self.floor = np.full(len(queries), -np.inf if kind is np.float64 else np.iinfo(kind).min, kind)
        self.last = np.full(len(queries), np.iinfo(np.int64).max)  # the id of the k-th

    def add(self, queries, ids, scores) -> None:
        at = np.searchsorted(self.queries, queries)
        good = (scores > self.floor[at]) | (scores == self.floor[at]) & (ids <= self.last[at])
        for q, v, s in zip(at[good].tolist(), ids[good].tolist(), scores[good].tolist()):
            heap = self.kept[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
            else:
                continue
            if len(heap) == self.k:
                self.floor[q], self.last[q] = heap[0][0], -heap[0][1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.queries), 1024):
            lengths = [len(heap) for heap in self.kept[i : i + 1024]]
            flat = [pair for heap in self.kept[i : i + 1024] for pair in heap]
            if flat:
                s, v = zip(*flat)
                ids = np.repeat(self.queries[i : i + 1024], lengths)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([-x for x in v], pa.int64()), pa.array(np.array(s, self.floor.dtype))], names=["query_id", "vec_id", "score"])


class Held:
    """Tiles of queries that a task holds at a time: ``most`` queries and ``BYTES`` at most, one tile at least."""

    BYTES = 1 << 26

    def __init__(self, most: int):
        self.most, self.tiles = most, []

    def takes(self, tile: Tile) -> bool:
        more = [*self.tiles, tile]
        if self.tiles and (sum(len(ids) for ids, _ in more) > self.most or sum(data.size * 8 for _, data in more) > self.BYTES):
            return False
        self.tiles = more
        return True


class Spool:
    """Tiles that wait in a file of the task's own, which is gone with it."""

    def __init__(self):
        self.file, self.count = tempfile.TemporaryFile(), 0

    def put(self, tile: Tile) -> None:
        pickle.dump(tile, self.file, pickle.HIGHEST_PROTOCOL)
        self.count += 1

    def __iter__(self) -> Iterator[Tile]:
        self.file.seek(0)
        for _ in range(self.count):
            yield pickle.load(self.file)


def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Tile]]:
    """Tiles of rows sorted by ``side``, ``id`` and ``vector``, with their side. Rows of one id are one row, the least vector."""
    last = None
    for batch in batches:
        side, ids, column = batch.column("side").to_numpy(), batch.column("id").to_numpy(), batch.column("vector")
        if not len(ids):
            continue
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        lengths = np.diff(ends)
        height = min(HEIGHT, max(1, WEIGHTS // max(1, lengths.max())))
        new = np.append((side[0], ids[0]) != last, (side[1:] != side[:-1]) | (ids[1:] != ids[:-1]))
        last = (side[-1], ids[-1])
        for one in (0, 1):
            rows = np.flatnonzero(new & (side == one))
            for part in (rows[i : i + height] for i in range(0, len(rows), height)):
                wide = np.arange(lengths[part].max()) < lengths[part][:, None]
                data = np.zeros(wide.shape, flat.dtype)
                data[wide] = flat[(ends[part][:, None] + np.arange(wide.shape[1]))[wide]]
                yield one, (ids[part], data)


def searched(held: list[Tile], candidates: Iterable[Tile], score: Callable, k: int, kind: type) -> Iterator[pa.RecordBatch]:
    ids, width = np.concatenate([x for x, _ in held]), max(x.shape[1] for _, x in held)
    matrix = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in held]).astype(np.float64)
    heaps = Heaps(k, ids, kind)
    for names, data in candidates:
        heaps.add(*score(ids, matrix, names, data.astype(np.float64), floor=heaps.floor))
    yield from heaps.rows()


def best_of(batches: Iterable[pa.RecordBatch], score: Callable, k: int, kind: type, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The ``k`` best candidates (side 1) of each query (side 0, they come first). What a task holds is bounded: ``most`` queries
    and one tile of candidates, which come in a stream; with more queries the tiles wait in a file and come again."""
    found, first, held, waiting, again = tiles(batches), [], Held(most), Spool(), Spool()
    for side, tile in found:
        if side:
            first = [tile]
            break
        if waiting.count or not held.takes(tile):
            waiting.put(tile)

    def stream() -> Iterator[Tile]:
        for tile in chain(first, (tile for _, tile in found)):
            tile = leading(tile, k)
            if waiting.count:
                again.put(tile)
            yield tile

    if not (first and held.tiles):
        for _ in stream():
            pass
        return
    yield from searched(held.tiles, stream(), score, k, kind)
    held = Held(most)
    for tile in waiting:
        if not held.takes(tile):
            yield from searched(held.tiles, again, score, k, kind)
            held = Held(most)
            held.takes(tile)
    if held.tiles:
        yield from searched(held.tiles, again, score, k, kind)


def leading(tile: Tile, k: int) -> Tile:
    """Without the rows that ``k`` + 1 rows of the same vector and smaller ids precede: they have the same score, ties go to the
    smaller id, and one of them may be the query itself. So many copies of a vector cost a query no more than ``k`` + 1."""
    ids, data = tile
    bits = data.view(np.uint32 if data.itemsize == 4 else np.uint64).astype(np.uint64)
    keys = bits @ (np.arange(1, 2 * data.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    by, data_by = keys[order], bits[order]
    new = np.append(True, by[1:] != by[:-1])
    same = np.flatnonzero(~new)
    new[same] = (data_by[same] != data_by[same - 1]).any(axis=1)
    starts = np.flatnonzero(new)
    nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    kept = np.sort(order[nth <= k])
    return (ids, data) if len(kept) == len(ids) else (ids[kept], data[kept])


def grid(spark: SparkSession) -> tuple[int, int]:
    """Parts of the queries and parts of the candidates; each pair of parts is a task. A candidate is copied once for each of the
    first, a query, of which there are fewer, once for each of the second, and each of the second has results of its own for a
    query: so the first are fewer, and there are no more than three tasks for a core, or 36."""
    tasks = max(1, min(partitions(spark), max(36, 3 * spark.sparkContext.defaultParallelism)))
    down = max(1, round(tasks**0.5 / 3))
    return down, tasks // down


def tile_pairs(queries: DataFrame, candidates: DataFrame, id_column: str, vector_column: str, score: Callable, k: int, schema: str) -> DataFrame:
    """The ``k`` best candidates of each query in each part of the candidates.

    Queries and candidates meet in tasks of a grid (``grid``), not in a join: Spark would size the queries' copies as if there were
    one of each and broadcast them. ``score(query ids, query matrix, candidate ids, candidate matrix, floor=)`` gives query ids, candidate ids and scores; it may
    leave out what is below a query's ``floor``, the k-th score that its task has seen so far.
    """
    down, across = grid(candidates.sparkSession)
    own = [df.select(vector_column).dtypes[0][1] for df in (queries, candidates)]
    vector = F.col(vector_column).cast("array<float>" if own == ["array<float>"] * 2 else "array<double>")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = lambda df, side: df.select(F.lit(side).alias("side"), F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
    asking = rows(queries, 0).select("*", part("id", down).alias("row"), every(across).alias("column"))
    asked = rows(candidates, 1).select("*", every(down).alias("row"), part(F.shiftright("id", NEIGHBOURS), across).alias("column"))
    dealt = asking.unionByName(asked).repartitionById(down * across, F.col("row") * across + F.col("column"))
    kind = np.float64 if "score double" in schema else np.int64
    sorted_ = dealt.select("side", "id", "vector").sortWithinPartitions("side", "id", "vector")
    return sorted_.mapInArrow(lambda batches: best_of(batches, score, k, kind), schema)
