"""Hard negatives by a vertical scan of columnar tiles (branch and bound over dimensions).

A tile holds its vectors by dimension. For an anchor the dimensions are read in descending order of the anchor's weight, a few at a time;
what the unread ones can still add lies between the sums of their least and largest contributions, taken from the least and
largest value of each dimension in the tile. A bitmap keeps the candidates whose interval can still matter, and only for
these are further dimensions read. Two passes: the first finds each anchor's positives, the second scans for the windows of scores that they
set, and resolves them exactly.

Anchors and tiles meet on a grid of cells, one cell a task: an anchor goes to each column of the grid, a tile to each row, so what moves
grows with the square root of the number of tasks. Within a cell the anchors of a block keep what they have found from tile to tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, best, partitions, read
from ledgerline.llm.tiles import usable

HEIGHT, ANCHORS = 2048, 128  # vectors of a tile, anchors of a block
STEP = 8                     # dimensions read between two looks at the bitmap
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def in_longs(x: np.ndarray) -> np.ndarray:
    """Python whole numbers held between the least and the largest long."""
    return np.array([min(max(int(v), LEAST), MOST) for v in x], object)


class Tile:
    """Vectors by dimension, with the least and the largest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.most = columns.min(1), columns.max(1)
        self.size = max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0))


def vertical_scan(query: np.ndarray, tile: Tile, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, int]:
    """The candidates that ``keep(partial, lowest, highest)`` never lets go, their whole scores, and the values read.

    ``alive`` is the bitmap to begin with. ``keep`` gets the candidates' partial scores and what the unread dimensions add
    at least and at most. Scores are whole numbers: in doubles while no sum can pass 2^53, else as Python's.
    """
    width = min(len(query), len(tile.columns))
    query, columns = query[:width], tile.columns[:width]
    exact = np.abs(query).max(initial=0) * tile.size * width < EXACT
    order = np.argsort(-np.abs(query), kind="stable")
    order = order[query[order] != 0]
    ends = np.stack([query * tile.least[:width], query * tile.most[:width]])[:, order]
    # what is still to come after each dimension read
    lowest, highest = (np.concatenate([np.cumsum(side[::-1])[::-1], [0]]) for side in (ends.min(0), ends.max(0)))
    if not exact:
        # bounds in doubles would round: no candidate is let go before its score is whole
        at = np.nonzero(alive)[0]
        whole = sum((int(query[d]) * np.array([int(v) for v in columns[d, at]], object) for d in order), np.zeros(len(at), object))
        scores = in_longs(whole)
        kept = keep(scores, 0, 0)
        return at[kept], scores[kept], len(at) * len(order)
    at, partial, seen = np.nonzero(alive)[0], None, 0
    for start in range(0, len(order), STEP):
        dims = order[start : start + STEP]
        block = columns[dims] if len(at) == columns.shape[1] else columns[np.ix_(dims, at)]
        added = query[dims] @ block
        partial = added if partial is None else partial + added
        seen += block.size
        done = start + len(dims)
        kept = keep(partial, lowest[done], highest[done])
        if not kept.all():
            at, partial = at[kept], partial[kept]
        if not len(at):
            break
    if partial is None:
        partial = np.zeros(len(at))
        kept = keep(partial, 0, 0)
        at, partial = at[kept], partial[kept]
    return at, partial, seen


class Best:
    """The ``k`` highest scores seen, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def floor(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else float("-inf")

    def add(self, ids, scores) -> None:
        for v, s in zip(ids, scores):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -v))
            elif (s, -v) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -v))

    def items(self) -> list[tuple[int, int]]:
        return [(-v, int(s)) for s, v in self.heap]


def positives_in(anchor: int, label: int, query: np.ndarray, tile: Tile, found: Best) -> int:
    """Adds the tile's best rows of the anchor's own label."""
    k = found.k

    def keep(partial, low, high):
        floor = found.floor()
        if len(partial) > k:  # k candidates already reach this score, whatever the rest adds
            floor = max(floor, np.partition(partial, len(partial) - k)[len(partial) - k] + low)
        return partial + high >= floor

    at, scores, seen = vertical_scan(query, tile, (tile.labels == label) & (tile.ids != anchor), keep)
    found.add(tile.ids[at].tolist(), scores.tolist())
    return seen


def negatives_in(anchor: int, label: int, query: np.ndarray, tile: Tile, windows: list[tuple[int, int, Best]]) -> int:
    """Adds the tile's best rows of other labels to each window ``(least score, largest score, found)``."""

    def keep(partial, low, high):
        kept = np.zeros(len(partial), bool)
        for least, most, found in windows:
            kept |= (partial + high >= max(least, found.floor())) & (partial + low <= most)
        return kept

    at, scores, seen = vertical_scan(query, tile, (tile.labels != label) & (tile.ids != anchor), keep)
    for least, most, found in windows:
        inside = (scores >= least) & (scores <= most)
        if inside.any():
            found.add(tile.ids[at[inside]].tolist(), scores[inside].tolist())
    return seen


BLOCK = "block long, n int, dim int, ids binary, labels binary, data binary"


def _packed(rows: DataFrame, height: int) -> DataFrame:
    """Blocks of at most ``height`` rows ``id, label, vector``, neighbours by id; values are whole numbers, by dimension, in as few
    bytes as hold them. Rows may carry ``found``, pairs of an id and a score: those of all rows follow one another, behind their numbers."""
    carried = "found" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, found = [], [], [], []

        def block():
            data = np.zeros((len(ids), max(map(len, vectors))))
            for row, vector in zip(data, vectors):
                row[: len(vector)] = vector
            size = np.abs(data).max(initial=0)
            kind = np.int16 if size < 2**15 else np.int32 if size < 2**31 else np.float64
            made = {
                "block": pa.array([ids[0]], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "dim": pa.array([data.shape[1]], pa.int32()),
                "ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int64).tobytes()], "data": [data.T.astype(kind).tobytes()],
            }
            if carried:
                flat = [x for own in found for x in own]
                made["found"] = [np.array([len(own) // 2 for own in found] + flat, np.int64).tobytes()]
            ids.clear(), labels.clear(), vectors.clear(), found.clear()
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "label", *(["found"] if carried else []))]
            for i, (name, label, *more) in enumerate(zip(*own)):
                ids.append(name)
                labels.append(label)
                vectors.append(flat[ends[i] : ends[i + 1]])
                found.extend(more)
                if len(ids) == height:
                    yield block()
        if ids:
            yield block()

    return rows.sortWithinPartitions("id").mapInArrow(pack, BLOCK + (", found binary" if carried else ""))


class Cell:
    """A pair of a block of anchors and a tile, as a row of the join."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.value = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()

    def tile(self, side: str) -> Tile:
        n, dim, data = (self.value(f"{side}_{name}") for name in ("n", "dim", "data"))
        kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (n * dim)] if n * dim else np.float64
        values = np.frombuffer(data, kind).astype(np.float64).reshape(dim, n)
        return Tile(np.frombuffer(self.value(f"{side}_ids"), np.int64), np.frombuffer(self.value(f"{side}_labels"), np.int64), values)

    def found(self) -> list[list[tuple[int, int]]]:
        numbers = np.frombuffer(self.value("a_found"), np.int64).tolist()
        n = self.value("a_n")
        pairs = iter(zip(numbers[n::2], numbers[n + 1 :: 2]))
        return [[next(pairs) for _ in range(many)] for many in numbers[:n]]


def _met(blocks: DataFrame, tiles: DataFrame, anchors: int, rows: int) -> DataFrame:
    """Each block of anchors beside each tile. With A rows and C columns of cells, A * C the number of shuffle partitions, a block
    goes to C cells and a tile to A; A is chosen so that both sides move about as much."""
    cells = partitions(tiles.sparkSession)
    high = min(cells, max(1, round((cells * anchors / max(rows, 1)) ** 0.5)))
    wide = -(-cells // high)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    side = lambda df, s: df.select("row", "col", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in ("row", "col")])
    left = blocks.withColumn("row", dealt(high)).withColumn("col", every(wide))
    right = tiles.withColumn("col", dealt(wide)).withColumn("row", every(high))
    return side(left, "a").hint("merge").join(side(right, "t"), ["row", "col"])


class Search:
    """What a scan does with a block of anchors: the places for what they find, a tile, the rows that come out."""

    names: list[str]

    def begin(self, cell: Cell) -> None: ...
    def add(self, tile: Tile) -> None: ...
    def rows(self) -> list[tuple]: ...


class Positives(Search):
    names = ["anchor_id", "positive_id", "positive_score"]

    def __init__(self, k: int):
        self.k = k

    def begin(self, cell):
        self.block = cell.tile("a")
        self.found = [Best(self.k) for _ in self.block.ids]

    def add(self, tile):
        b = self.block
        for j, found in enumerate(self.found):
            positives_in(b.ids[j], b.labels[j], b.columns[:, j], tile, found)

    def rows(self):
        return [(int(a), v, s) for a, found in zip(self.block.ids, self.found) for v, s in found.items()]


class Negatives(Search):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def __init__(self, k: int, least: int, most: int):
        self.k, self.least, self.most = k, least, most

    def begin(self, cell):
        self.block, self.windows = cell.tile("a"), []
        for own in cell.found():
            bounds = [(-(-self.least * score // 100), self.most * score // 100) for _, score in own]
            self.windows.append([(*pair, low, high, Best(self.k)) for pair, (low, high) in zip(own, bounds) if low <= high])

    def add(self, tile):
        b = self.block
        for j, own in enumerate(self.windows):
            if own:
                negatives_in(b.ids[j], b.labels[j], b.columns[:, j], tile, [w[2:] for w in own])

    def rows(self):
        return [(int(a), *w[:2], v, s) for a, own in zip(self.block.ids, self.windows) for w in own for v, s in w[4].items()]


def _scanned(met: DataFrame, search: Search) -> DataFrame:
    """Runs a search over the pairs of each task. What a block's anchors have found is kept while its pairs follow one another, and given
    out when another block comes; the merge of what several tasks give also puts together several turns of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            if name is not None and (found := search.rows()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=search.names)

        name = None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = Cell(batch, i)
                if cell.value("a_block") != name:
                    yield from out()
                    name = cell.value("a_block")
                    search.begin(cell)
                search.add(cell.tile("t"))
        yield from out()

    return met.mapInArrow(run, ", ".join(f"{n} long" for n in search.names))


def mine(
    anchors: DataFrame,
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best other rows of its label. For each of them, its negatives are the best rows of another label that
    score between ``least`` and ``most`` hundredths of the positive; a positive with a negative score therefore has none. Weights are whole
    numbers; a score is an exact inner product, and one beyond a long counts as the largest or least long. Ties go to the smaller id.

    Rows with a null id, label or vector, or a null, infinite or NaN component take no part. Rows of one id count once, with the least
    label and then vector. Vectors of different length are compared as if the shorter ended in zeros. ``anchors`` need not be among
    ``rows``; a row of the anchor's own id is neither a positive nor a negative of it. Empty tables give no rows; other columns are never read.
    """
    scratch = Scratch(rows.sparkSession)

    def clean(df):
        vector = F.col(vector_column)
        good = df.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & usable(vector))
        value = F.struct(F.col(label_column).cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
        # rows of one id meet in the tasks before they move
        return good.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(value).alias("v")).select("id", "v.label", "v.vector")

    asked = scratch.save(clean(anchors), "anchors")
    tiles = scratch.save(_packed(clean(rows), HEIGHT), "tiles")
    sizes = asked.count(), tiles.agg(F.sum("n")).first()[0] or 0

    found = _scanned(_met(_packed(asked, ANCHORS), tiles, *sizes), Positives(positives))
    chosen = best(found, "anchor_id", [F.desc("positive_score"), F.asc("positive_id")], positives)
    chosen = scratch.save(chosen.drop("rank"), "positives")

    # what an anchor has found travels with it, at most ``positives`` pairs
    pairs = chosen.groupBy("anchor_id").agg(F.collect_list(F.array("positive_id", "positive_score")).alias("found"))
    with_found = asked.join(pairs, asked["id"] == pairs["anchor_id"]).select("id", "label", "vector", F.flatten("found").alias("found"))
    found = _scanned(_met(_packed(with_found, ANCHORS), tiles, *sizes), Negatives(negatives, least, most))
    order = [F.desc("negative_score"), F.asc("negative_id")]
    return best(found, ["anchor_id", "positive_id"], order, negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_hard_negatives(spark, folder) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    # from 2^53 on a double is a whole number, and may be more than a long holds; rows whose product is no finite double take no part
    weight = lambda x: x.cast("double") * 256
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    labelled = rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: whole(weight(x))).alias("embedding"),
    )
    return mine(labelled.where(F.col("vec_id") % 100 == 0), labelled)


SQL = """
WITH weights AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM weights a JOIN weights r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
