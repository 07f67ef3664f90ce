"""Hard negatives against a plain scoring of all pairs, and the vertical scan by itself."""

import random

import numpy as np
import pytest

from ledgerline.llm import hardneg

KIND = "vec_id long, embedding array<double>, label int"
LEAST, MOST = -(2**63), 2**63 - 1


def expected(rows, anchors, positives=5, negatives=5, least=80, most=100):
    kept = {}
    for name, vector, label in rows:
        if None not in (name, vector, label) and all(x is not None and np.isfinite(x) for x in vector):
            kept[name] = min(kept.get(name, (label, vector)), (label, vector))
    dot = lambda a, b: max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(a, b))))
    out = []
    for a in sorted(n for n in kept if n in anchors):
        label, vector = kept[a]
        scored = sorted((-dot(vector, v), n, own) for n, (own, v) in kept.items() if n != a)
        for p, name, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p][:negatives]
            out += [(a, name, i + 1, n, -p, -s) for i, (s, n, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' AS id", "1 AS rank", "2 AS found", "3 AS block", "4 AS anchor_id", "5 AS n").repartition(3)
    return sorted(tuple(r) for r in hardneg.mine(df.where(df["vec_id"].isin(anchors)), df, **options).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hardneg, "HEIGHT", 16)
    monkeypatch.setattr(hardneg, "ANCHORS", 2)


def drawn(seed, n, dim, spread=60):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, spread, (3, dim))
    return [(int(i), np.floor(centres[i % 3] * 0.6 + draw.normal(0, spread, dim)).tolist(), int(i * 7 % 4)) for i in range(n)]


def test_random_vectors(spark, small):
    rows = drawn(1, 300, 20)
    anchors = list(range(0, 300, 30))
    assert found(spark, rows, anchors) == expected(rows, anchors)
    assert found(spark, rows, anchors, positives=2, negatives=7, least=50, most=130) == expected(rows, anchors, 2, 7, 50, 130)


def test_edges(spark, small):
    draw = random.Random(3)
    rows = drawn(2, 60, 5) + [
        (100, None, 1), (101, [1.0, None], 1), (102, [float("nan"), 1.0], 1), (103, [float("inf")], 1), (None, [9.0], 1), (104, [5.0], None),
        (105, [], 1), (106, [3.0], 2), (107, [0.0] * 5, 1), (108, [0.0] * 5, 2), (109, [-4.0, -7.0], 3), (0, [1.0, 1.0], 9), (0, [1.0, 1.0], 9),
    ] + [(200 + i, [40.0, 30.0, 0.0, 0.0, 1.0], i % 2) for i in range(40)]
    draw.shuffle(rows)
    anchors = [0, 3, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 200, 201]
    assert found(spark, rows, anchors) == expected(rows, anchors)
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame(rows, KIND)
    assert hardneg.mine(none, some).count() == hardneg.mine(some, none).count() == hardneg.mine(none, none).count() == 0


def test_huge_weights_stay_whole(spark, small):
    rows = [(i, [2.0**40 + i, float(i % 3) * 2.0**20, 1.0 * (-1) ** i], i % 2) for i in range(40)]
    rows += [(50 + i, [2.0**90, (-1.0) ** i * 2.0**100, float(i)], i % 2) for i in range(20)]
    assert found(spark, rows, [0, 1, 50, 51]) == expected(rows, [0, 1, 50, 51])


def test_query_takes_huge_components(spark, tmp_path):
    rows = [(i, [3e38 if i % 3 else -1e-3, 1.5 * i, 1e20], i % 3) for i in range(0, 60)] + [(100, [1e308], 1), (200, [1.0, 2.0], 1)]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "embeddings.parquet"))
    weights = [(n, [float(np.floor(x * 256)) for x in v], (y + 1) % 10 if n % 7 == 0 else y) for n, v, y in rows if n != 100]
    result = sorted(tuple(r) for r in hardneg.op11_hard_negatives(spark, str(tmp_path)).collect())
    assert result == expected(weights, [0, 200])


def test_the_bitmap_shrinks_and_loses_nothing():
    draw = np.random.default_rng(5)
    columns = np.floor(draw.normal(0, 32, (64, 3000)) * np.exp(-np.arange(64) / 12)[:, None])
    tile = hardneg.Tile(np.arange(3000), np.arange(3000) % 2, columns)
    for j in range(5):
        query, scores = columns[:, j], columns[:, j] @ columns
        best_of = hardneg.Best(5)
        seen = hardneg.positives_in(j, j % 2, query, tile, best_of)
        own = sorted((-int(scores[v]), v) for v in range(3000) if v % 2 == j % 2 and v != j)[:5]
        assert sorted((-s, v) for v, s in best_of.items()) == own
        assert seen < 0.6 * 1500 * 64
        windows = [(-(-80 * -p // 100), -p, hardneg.Best(5)) for p, _ in own]
        seen = hardneg.negatives_in(j, j % 2, query, tile, windows)
        for low, high, got in windows:
            fit = sorted((-int(scores[v]), v) for v in range(3000) if v % 2 != j % 2 and low <= scores[v] <= high)[:5]
            assert sorted((-s, v) for v, s in got.items()) == fit
        assert seen < 0.7 * 1500 * 64
