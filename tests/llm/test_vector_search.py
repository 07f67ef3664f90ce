"""The two vector searches: tasks of a grid, scores carried from tile to tile, more queries than a task holds."""

import time
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import neighbours, tiles, topk


def brute(ids, rows, q, k):
    return [v for _, v in sorted((-float(rows[q] @ rows[j]), int(ids[j])) for j in range(len(ids)) if j != q)[:k]]


def whole(seed, n, dim, size=60):
    return np.floor(np.random.default_rng(seed).normal(0, size, (n, dim)))


@pytest.mark.parametrize("search", [topk.search, neighbours.nearest])
def test_copies_of_queries_are_never_broadcast(spark, tmp_path, search):
    rows = whole(3, 400, 8)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    found = search(table.where("vec_id % 50 = 0"), table, 4)
    got = found.orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [v for q in range(0, 400, 50) for v in brute(range(400), rows, q, 4)]
    found.foreach(lambda r: None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan and "Join" not in plan


def test_scores_of_a_tile_take_less_than_a_sort_of_them():
    rows, ids = whole(4, 4096, 16, 32), np.arange(4096)

    def seconds(run):
        least = 9.0
        for _ in range(4):
            began = time.perf_counter()
            run()
            least = min(least, time.perf_counter() - began)
        return least

    sort = seconds(lambda: np.argsort(rows[:512] @ rows.T, axis=1))
    assert seconds(lambda: topk.block_top_k(ids[:512], rows[:512], ids, rows, k=5)) < sort


@pytest.mark.parametrize("score, kind", [(topk.block_top_k, np.int64), (neighbours.tile_nearest, np.float64)])
def test_rows_below_the_score_of_earlier_tiles_stay_out(score, kind):
    rows, ids = whole(5, 900, 16), np.arange(900)
    rows[400:430] = rows[3]  # ties
    heaps, given = tiles.Heaps(5, ids[:20], kind), []
    for part in (slice(0, 300), slice(300, 600), slice(600, 900)):
        floor = heaps.floor.copy()
        q, v, s = score(ids[:20], rows[:20], ids[part], rows[part], k=5, floor=floor)
        assert (s >= floor[q]).all()
        heaps.add(q, v, s)
        given.append(len(q))
    assert given[2] < given[0]
    found = [list(zip(*(c.to_pylist() for c in b.columns))) for b in heaps.rows()]
    for q in range(20):
        assert [v for _, v, _ in sorted((x for b in found for x in b if x[0] == q), key=lambda x: (-x[2], x[1]))] == brute(ids, rows, q, 5)


@pytest.mark.parametrize("score, kind", [(partial(topk.block_top_k, k=4), np.int64), (partial(neighbours.tile_nearest, k=4), np.float64)])
def test_more_queries_than_a_task_holds(monkeypatch, score, kind):
    monkeypatch.setattr(tiles, "HEIGHT", 16)
    rows = whole(6, 200, 8)
    given = [(0, i, rows[i]) for i in range(0, 200, 2)] + [(1, i, rows[i]) for i in range(200) for _ in range(1 + i % 2)]
    batches = [
        pa.RecordBatch.from_pydict({"side": pa.array([x[0] for x in part], pa.int32()), "id": [x[1] for x in part], "vector": pa.array([x[2].tolist() for x in part], pa.list_(pa.float32()))})
        for part in (given[i : i + 37] for i in range(0, len(given), 37))
    ]
    for most in (1000, 40, 1):
        found = [r for b in tiles.best_of(iter(batches), score, 4, kind, most) for r in zip(*(c.to_pylist() for c in b.columns))]
        for q in range(0, 200, 2):
            assert [v for _, v, _ in sorted((x for x in found if x[0] == q), key=lambda x: (-x[2], x[1]))] == brute(range(200), rows, q, 4)
    for side in (0, 1):
        alone = pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "id": [1], "vector": pa.array([[1.0]], pa.list_(pa.float32()))})
        assert list(tiles.best_of(iter([alone, alone.slice(0, 0)]), score, 4, kind)) == []


@pytest.mark.parametrize("score, kind", [(topk.block_top_k, np.int64), (neighbours.tile_nearest, np.float64)])
def test_copies_of_a_vector_cost_a_query_no_more_than_its_answers(score, kind):
    rows = whole(7, 300, 8)
    rows[50:250:2] = rows[51] = rows[299]
    seen = []

    def counted(query_ids, queries, ids, data, floor):
        seen.append((ids, data))
        return score(query_ids, queries, ids, data, k=3, floor=floor)

    given = [(0, i) for i in range(0, 300, 3)] + [(1, i) for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"side": pa.array([s for s, _ in given], pa.int32()), "id": [i for _, i in given], "vector": pa.array([rows[i].tolist() for _, i in given], pa.list_(pa.float32()))})
    found = [r for b in tiles.best_of([batch], counted, 3, kind) for r in zip(*(c.to_pylist() for c in b.columns))]
    for q in range(0, 300, 3):
        assert [v for _, v, _ in sorted((x for x in found if x[0] == q), key=lambda x: (-x[2], x[1]))] == brute(range(300), rows, q, 3)
    assert sum(int((data == rows[51]).all(axis=1).sum()) for _, data in seen) == 4
    assert seen[0][0].tolist() == [i for i in range(300) if i in (50, 51, 52, 54) or not (rows[i] == rows[51]).all()]


def test_tasks_of_a_grid_follow_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 7, 36, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            down, across = tiles.grid(spark)
            assert 1 <= down <= across and down * across <= min(n, 36)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vectors_without_components(spark):
    rows = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<double>")
    found = topk.search(rows.where("vec_id = 1"), rows, 2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 0, 0), (2, 2, 0)]
    assert neighbours.nearest(rows, rows, 2).count() == 0
