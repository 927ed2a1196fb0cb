"""Grouped quantiles of any size, box statistics, sketches by day, ranges of many values."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import quantiles, ranks, recs, tables


@pytest.fixture(scope="module")
def groups(spark):
    """Group a holds 90 % of the rows; b spans hundreds of orders of magnitude; c is one value; d has nothing; nulls are a group."""
    rng = random.Random(1)
    made = [("a", rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5)), rng.random() * 1e6])) for _ in range(9000)]
    made += [("b", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(300)] + [("c", 7.5)] * 400
    made += [("d", None)] * 20 + [(None, float(k)) for k in range(100)] + [("a", float("nan")), ("e", 3.0), ("f", 1.0), ("f", 2.0)]
    return spark.createDataFrame(made, "g string, x double").repartition(5)


@pytest.mark.parametrize(("most", "bins", "passes"), [(8192, 1024, 8), (50, 16, 20), (50, 4, 2), (1, 8, 40)])
def test_grouped_quantiles_are_exact(groups, most, bins, passes):
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r[1:] for r in quantiles.grouped_quantiles(groups, ["g"], "x", points, [f"p{n}" for n in range(6)], most, bins, passes).collect()}
    values = {}
    for r in groups.collect():
        if r.x is not None and r.x == r.x:
            values.setdefault(r.g, []).append(r.x)
    assert set(got) == set(values) and "d" not in got
    for g, xs in values.items():
        assert np.allclose(got[g], np.quantile(xs, points), rtol=1e-12, atol=0), g
    assert quantiles.grouped_quantiles(groups.limit(0), ["g"], "x", [0.5], ["m"]).count() == 0


def test_box_stats_and_medians(spark, groups):
    got = {r.g: tuple(r)[1:] for r in tables.box_stats(groups.where("g = 'f' OR g = 'c' OR g IS NULL"), "g", "x").collect()}
    assert got == {"f": (1.0, 1.25, 1.5, 1.75, 2.0), "c": (7.5,) * 5, None: (0.0, 24.75, 49.5, 74.25, 99.0)}
    day = dt.date(2024, 1, 31)
    df = spark.createDataFrame([(1, 1.0, day), (1, 5.0, day - dt.timedelta(40)), (1, 3.0, day), (2, 4.0, day - dt.timedelta(50))], "p int, v double, d date")
    made = {r.p: r for r in tables.deep_features(df, "p", ["v"], "d", [30, None], "x").collect()}
    assert (made[1].median_v_30_x, made[1].median_v_x, made[1].sum_v_x, made[1].count_30_x) == (2.0, 3.0, 9.0, 2)
    assert (made[2].median_v_30_x, made[2].median_v_x, made[2].count_30_x, made[2].max_v_30_x) == (None, 4.0, 0, None)


def test_sketches_by_day(spark, tmp_path):
    rng = random.Random(2)
    day = lambda n: dt.date(2024, 1, 1 + n)
    made = [(day(rng.randrange(3)), rng.gauss(50, 9), rng.randrange(2000) if rng.random() < 0.9 else None) for _ in range(20_000)]
    df = spark.createDataFrame(made, "d date, x double, k int").cache()
    path = str(tmp_path / "parts")
    assert quantiles.add_parts(df.where(F.col("d") <= day(1)), ["x", "k"], "d", path) == [day(0), day(1)]
    later = df.where("x > -1e9")  # rows of days that are there are not read again: a poisoned one would fail the job
    poisoned = later.withColumn("x", F.when(F.col("d") < day(2), F.raise_error("read again").cast("double")).otherwise(F.col("x")))
    assert quantiles.add_parts(poisoned, ["x", "k"], "d", path) == [day(2)]
    assert quantiles.add_parts(poisoned, ["x", "k"], "d", path) == []
    got = {r.column: r for r in quantiles.merged_profile(spark.read.parquet(path)).collect()}
    exact = {r["column"]: r for r in tables.profile(df, ["x", "k"]).collect()}
    of_distinct, of_rank = quantiles.stated_errors()
    for c in ("x", "k"):
        g, e = got[c], exact[c]
        assert (g["count"], g.nulls, g.min, g.max) == (e["count"], e.nulls, e.min, e.max)
        assert abs(g.mean - e.mean) < 1e-9 and abs(g.std - e.std) < 1e-6
        assert abs(g.n_distinct - e.n_distinct) <= 3 * of_distinct * e.n_distinct
        values = np.sort([r[c] for r in df.collect() if r[c] is not None])
        for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
            low, high = np.searchsorted(values, g[name], "left"), np.searchsorted(values, g[name], "right")
            assert low - 3 * of_rank * len(values) <= q * len(values) <= high + 3 * of_rank * len(values)


def test_ranges_grow_with_the_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE", 200)
    monkeypatch.setattr(ranks, "RANGE_ROWS", 10)
    values = spark.range(5000).select(F.col("id").alias("x"))
    cut = values.select("x", ranks.ranges(values, "x", 8).alias("r")).orderBy("x").collect()
    numbers = [r.r for r in cut]
    assert numbers == sorted(numbers) and len(set(numbers)) > 40 and max(numbers) < 64
    assert [(r.x, r.idx) for r in ranks.dense_ids(values, "x").orderBy("x").collect()] == [(k, k) for k in range(5000)]


def test_unpack_shuffles_nothing(spark):
    wide = spark.createDataFrame([(1, [5, 6, 6], [7, 6]), (2, None, [5]), (3, None, None), (4, [None, 8], [8])], "customer_id long, a array<long>, b array<long>")
    made = recs.unpack(wide, ["a", "b"])
    got = sorted(map(tuple, made.collect()))
    assert got == [(1, 5, "a"), (1, 6, "multiple_strategies"), (1, 7, "b"), (2, 5, "b"), (4, 8, "multiple_strategies")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_numbers_within_hot_keys(spark):
    """One key holds 90 % of the rows and is numbered in many ranges; null times come first."""
    rng = random.Random(4)
    made = [(0 if rng.random() < 0.9 else rng.choice([1, 2, 3, None]), None if n % 50 == 0 else rng.randrange(400), n) for n in range(3000)]
    df = spark.createDataFrame(made, "k int, t int, n int")
    cell = F.when(F.col("t").isNull(), -1).otherwise(ranks.ranges(df.select("t").where("t IS NOT NULL").distinct(), "t"))
    got = {r.n: r.at for r in ranks.running_within(df, ["k"], ["t", "n"], cell, F.lit(1), "at").collect()}
    for k in (0, 1, 2, 3, None):
        rows = sorted((r for r in made if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in rows] == list(range(len(rows)))
    sizes = df.withColumn("cell", cell).groupBy("k", "cell").count().agg(F.max("count")).first()[0]
    assert sizes < 3000 / 20


@pytest.mark.parametrize("seed", range(4))
def test_refined_times_of_hot_users_equal_the_walk(spark, seed):
    """One user holds 90 % of the rows: its times come from scans over ranges."""
    rng = random.Random(seed)
    made, t = [], {k: 0 for k in (0, 1, None)}
    for n in range(1500):
        k = 0 if rng.random() < 0.9 else rng.choice([1, None])
        t[k] += rng.choice([0, 0, 1, 2, 5, 60] if seed % 2 else [0, 1, 40, 400, 4000])
        made.append((k, None if n % 97 == 5 else t[k], n))
    df = spark.createDataFrame(made, "u int, time long, n int").repartition(4)
    got = {r.n: r.time for r in tables.refine_times(df, "u", "time", "n", hot_rows=400).collect()}
    for k in t:
        last, gap = None, 1
        for _, x, n in sorted((r for r in made if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if x is None:
                assert got[n] is None
                continue
            if last is not None and x <= last:
                last, gap = x + gap, gap + 1
            else:
                last = x
            assert got[n] == last
