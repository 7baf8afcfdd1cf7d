"""Windows over a whole axis, cut into ranges and blocks, against plain loops."""

import random

import pytest

from sievestone.operators import ranks, relational, stats


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 7)
    monkeypatch.setattr(relational, "BLOCK_ROWS", 10)


def points(spark, seed, n=100, gaps=0.4):
    rnd = random.Random(seed)
    rows = [(x, None if rnd.random() < gaps else float(rnd.randint(0, 50)), "kept") for x in sorted(rnd.sample(range(10 * n), n))]
    return rows, spark.createDataFrame(rows, "x long, y double, other string").repartition(3)


@pytest.mark.parametrize("seed,width", [(1, 5), (2, 3), (3, 9)])
def test_moving_average(spark, small_ranges, seed, width):
    rows, table = points(spark, seed)
    found = {r.x: r.smoothed for r in relational.moving_average(table, "x", "y", width, 2).collect()}
    for i, (x, _, _) in enumerate(rows):
        near = [y for _, y, _ in rows[max(0, i - width // 2):i + width // 2 + 1] if y is not None]
        assert found[x] == (pytest.approx(sum(near) / len(near)) if len(near) >= 2 else None)
    assert len(found) == len(rows)


@pytest.mark.parametrize("gaps", [0.4, 0.95, 1.0])
def test_interpolate(spark, small_ranges, gaps):
    rows, table = points(spark, 5, gaps=gaps)
    found = {r.x: r.filled for r in relational.interpolate(table, "x", "y").collect()}
    known = [(x, y) for x, y, _ in rows if y is not None]
    for x, y, _ in rows:
        left, right = [k for k in known if k[0] <= x][-1:], [k for k in known if k[0] >= x][:1]
        if not left or not right:
            assert found[x] is None
        else:
            (a, b), (c, d) = left[0], right[0]
            assert found[x] == pytest.approx(b if a == c else b + (d - b) * (x - a) / (c - a))


def test_codes_and_totals(spark, small_ranges):
    words = [f"w{i:03d}" for i in range(60)]
    table = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "v string")
    assert {r.value: r.code for r in stats.label_codes(table, "v").collect()} == {w: i for i, w in enumerate(words)}
    counts = spark.createDataFrame([(i, i % 5, 2 * i) for i in range(50)], "v long, n long, m long")
    got = {r.v: (r.n_before, r.m_before) for r in ranks.running_totals(counts, "v", ["n", "m"], small_rows=10).collect()}
    assert got == {i: (sum(k % 5 for k in range(i)), i * (i - 1)) for i in range(50)}
