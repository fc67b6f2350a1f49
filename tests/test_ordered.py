"""Chunked operators must agree with plain windows however keys are split."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalbox.operators.ordered import exact_quantiles, global_rank, greedy_chain, nearest_instant, ordered_scan
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    values = [
        (k, at, rng.choice([None, rng.randint(0, 9)])) for k in "ab" for at in rng.sample(range(5000), 200 if k == "a" else 5)
    ]
    return spark.createDataFrame(values, "k string, at long, v int").cache()


@pytest.mark.parametrize("width", [1, 100, 1_000_000])
def test_matches_plain_windows(data, width):
    got = ordered_scan(
        data, ["k"], ["at"], F.floor(F.col("at") / width), lags={"lag_v": "v", "lag_at": "at"}, leads={"lead_at": "at"},
        sums={"total": F.coalesce("v", F.lit(0)), "n": F.lit(1)}, fills={"seen": "v"}, fills_before={"before": "v"},
        fills_after={"after": "v"},
    )
    w = Window.partitionBy("k").orderBy("at")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = data.withColumns({
        "lag_v": F.lag("v").over(w), "lag_at": F.lag("at").over(w), "lead_at": F.lead("at").over(w),
        "total": F.sum(F.coalesce("v", F.lit(0))).over(up), "n": F.row_number().over(w).cast("long"),
        "seen": F.last("v", True).over(up), "before": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    assert rows(got) == rows(want)


def test_single_sequence_without_keys(data):
    got = ordered_scan(data, [], ["at", "k"], F.floor(F.col("at") / 100), sums={"n": F.lit(1)})
    want = data.withColumn("n", F.row_number().over(Window.orderBy("at", "k")).cast("long"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("chunk_width", [7, 1_000_000])
def test_exact_quantiles(spark, chunk_width):
    rng = random.Random(1)
    df = spark.createDataFrame([(g, rng.randint(-50, 400)) for g in "xy" for _ in range(rng.randint(3, 90))], "g string, v int")
    got = exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}, chunk_width=chunk_width)
    want = df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("p50"), F.expr("percentile(v, 0.9)").alias("p90"))
    key = lambda df: [(r[0], round(r[1], 9), round(r[2], 9)) for r in rows(df)]
    assert key(got) == key(want)


def test_nearest_instant(spark):
    q = spark.createDataFrame([(5,), (20,), (100,), (5,)], "q long")
    p = spark.createDataFrame([(4,), (20,), (7200,)], "p long")
    assert rows(nearest_instant(q, "q", p, "p")) == [(100, 20, 7200), (20, 20, 20), (5, 4, 20)]


def test_global_rank_where_most_rows_tie(spark):
    rng = random.Random(4)
    data = [(0 if rng.random() < 0.8 else rng.randrange(50), i) for i in rng.sample(range(10_000), 3000)]
    got = global_rank(spark.createDataFrame(data, "age long, pos long").repartition(5), ["age", "pos"], "place")
    ranges = got.select("place", "age", "pos").orderBy("place").collect()
    assert [(r.age, r.pos) for r in ranges] == sorted(data) and [r.place for r in ranges] == list(range(1, 3001))


def test_chain_of_choices_on_a_hot_key(spark):
    """One key with a third of all rows and no gap, so that its chain is one long stretch; varying waits."""
    rng = random.Random(5)
    given = [("hot", at, at + rng.randint(3, 40)) for at in range(0, 1200)]
    given += [(f"k{n}", at, at + rng.randint(1, 300)) for n in range(80) for at in rng.sample(range(4000), 30)]
    want = []
    for key in {r[0] for r in given}:
        free = None
        for _, at, then in sorted(r for r in given if r[0] == key):
            if free is None or at >= free:
                want.append((key, at))
                free = then
    df = spark.createDataFrame(given, "k string, at long, then long")
    got = greedy_chain(df, ["k"], "at", F.col("then"), chunk_s=100)
    assert sorted((r.k, r.at) for r in got.collect()) == sorted(want)


def test_greatest_value_before(spark):
    rng = random.Random(6)
    given = [("a", i, rng.randrange(100) if i % 3 else None) for i in range(200)] + [("b", 5, 1)]
    got = ordered_scan(spark.createDataFrame(given, "k string, i long, v long"), ["k"], ["i"], F.floor(F.col("i") / 7), maxes_before={"m": "v"})
    for r in got.collect():
        assert r.m == max((v for k, i, v in given if k == r.k and i < r.i and v is not None), default=None)
