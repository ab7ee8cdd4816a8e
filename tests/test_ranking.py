import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.operators import ranking
from tillscope.operators.ranking import percentiles, quintiles, share_reached, with_running_total


def counts(spark, groups):
    rows = {}
    for g, vs in groups.items():
        for v in vs:
            rows[(g, float(v))] = rows.get((g, float(v)), 0) + 1
    return spark.createDataFrame([(g, v, n) for (g, v), n in rows.items()], "g string, v double, n long")


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    return {
        "ints": [rng.randint(-5, 30) for _ in range(400)], "money": [round(rng.lognormvariate(3, 2), 2) for _ in range(500)],
        "one": [7.0], "hot": [1.0] * 300 + [rng.uniform(0.99, 1.01) for _ in range(150)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-7, 12) for _ in range(200)],
    }


def test_percentiles_match_linear_interpolation(spark, groups):
    got = {r.g: r for r in percentiles(counts(spark, groups), ["g"], "v", "n", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g, vs in groups.items():
        for name, q in (("a", 25), ("b", 50), ("c", 90)):
            assert got[g][name] == pytest.approx(np.percentile(vs, q), rel=1e-12, abs=1e-12), (g, name)


def test_running_totals(spark, groups):
    for r in with_running_total(counts(spark, groups), ["g"], "v", "n").collect():
        assert r.before == sum(1 for x in groups[r.g] if x < r.v) and r.total == len(groups[r.g])


@pytest.mark.parametrize("ascending", [True, False])
def test_quintiles_match_ranked_bins(spark, groups, ascending):
    got = {(r.g, r.v): r.score for r in quintiles(counts(spark, groups), ["g"], "v", "n", ascending).collect()}
    for g, vs in groups.items():
        n = len(vs)
        ranked = sorted(vs, reverse=not ascending)
        bins = {}
        for p, v in enumerate(ranked, 1):
            bins.setdefault(float(v), []).append(5 if n == 1 else max(1, -(-5 * (p - 1) // (n - 1))))
        for v, b in bins.items():
            assert got[(g, v)] == math.ceil(sum(b) / len(b) - 0.5), (g, v)


def test_share_reached(spark):
    groups = {"a": [50, 30, 10, 5, 5], "b": [1] * 10, "c": [100], "d": [3.5] * 3 + [2.25] * 7 + [0.01] * 40}
    got = {r.g: (r.needed, r.members) for r in share_reached(counts(spark, groups), ["g"], "v", "n", 0.8).collect()}
    for g, vs in groups.items():
        total, run, need = sum(vs), 0.0, 0
        for v in sorted(vs, reverse=True):
            run += v
            need += run < total * 0.8
        assert got[g] == (min(need + 1, len(vs)), len(vs)), g


def test_a_hot_value_is_one_row(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    r = percentiles(df, [], "v", "n", {"m": 0.5}).first()
    assert r.m == pytest.approx(np.median([1.0 if i % 3 == 0 else float(i) for i in range(30000)]))


def test_crowded_buckets_are_cut_until_none_is(spark, groups, monkeypatch):
    """Close numbers, nested clusters and one value apart: no bucket above the bound, the same ranks."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 5)
    monkeypatch.setattr(ranking, "PER_TASK", 1_000)
    monkeypatch.setattr(ranking, "MOST_PARTS", 4)
    near = {"close": [90_000.0 + i / 1_000 for i in range(700)], "nested": [1e6 + 10.0 ** -k * j for k in range(9) for j in range(9)], "far": [1.0, 1e300, -1e300, 5e-324, 0.0] + [3.0 + i * 1e-12 for i in range(90)]}
    for name, vs in {**groups, **near}.items():
        df = counts(spark, {name: vs})
        sizes = ranking.bucketed(df, ["g"], "v").groupBy("g", "__bucket").count()
        assert sizes.agg(F.max("count")).first()[0] <= 5, name
    got = percentiles(counts(spark, near), ["g"], "v", "n", {"a": 0.25, "c": 0.9}).collect()
    for r in got:
        for name, q in (("a", 25), ("c", 90)):
            assert r[name] == pytest.approx(np.percentile(near[r.g], q), rel=1e-12, abs=1e-12), (r.g, name)
    test_running_totals(spark, groups)


def test_ten_million_close_numbers(spark):
    """No window holds more than twice a task's fair share."""
    n = 10_000_000
    df = spark.range(90_000_000, 90_000_000 + n).select(F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranking.bucketed(df, [], "v")
    assert placed.groupBy("__bucket").count().agg(F.max("count")).first()[0] <= 2 * n / max(tasks, 8)
    r = percentiles(df, [], "v", "n", {"m": 0.5, "q": 0.25}).first()
    assert (r.m, r.q) == (90_000_000 + (n - 1) / 2, 90_000_000 + (n - 1) / 4)


def test_decimals_beyond_doubles_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 3)
    monkeypatch.setattr(ranking, "PER_TASK", 1_000)
    df = spark.range(40).select((F.lit(10).cast("decimal(38,0)") * F.lit(10**16).cast("decimal(18,0)") + F.col("id")).cast("decimal(38,0)").alias("v"), F.lit(1).cast("long").alias("n"))
    got = sorted((r.v, r.before) for r in with_running_total(df, [], "v", "n").collect())
    assert [b for _, b in got] == list(range(40))
