"""Percentiles over moving spans against numpy, with narrowing forced by tiny groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import order


def test_codes_keep_the_order():
    v = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf, np.nan])
    c = order.codes(v)
    assert c[4] == c[5] and sorted(c.tolist()) == c.tolist()
    assert np.array_equal(order.values_of(c), v, equal_nan=True)


def test_kth_with_weights():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = rng.integers(1, 40), rng.integers(1, 20)
        g, at, u, rank, w = rng.integers(0, 3, n), rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 6, n), rng.integers(1, 4, n)
        h, t, v = rng.integers(0, 4, m), rng.integers(0, 9, m), rng.integers(0, 3, m)
        active = [np.repeat(rank, np.where((g == c) & ((at < a) | ((at == a) & (u <= b))), w, 0)) for c, a, b in zip(h, t, v, strict=True)]
        k = np.array([rng.integers(0, len(x)) if len(x) else 0 for x in active])
        found, left = order.kth(g, at, u, w, rank, h, t, v, k)
        for x, i, f, rest in zip(active, k, found, left, strict=True):
            if len(x):
                assert f == np.sort(x)[i] and rest == i - (x < f).sum()


@pytest.mark.parametrize(("hot", "q", "piece"), [(10**6, 0.5, None), (10**6, 0.9, 40), (30, 0.5, 40), (12, 0.25, None), (3, 0.5, None)])
def test_percentiles_of_spans(spark, hot, q, piece):
    rng = random.Random(hot)
    amounts = [None, float("nan"), 0.0, -0.0, -3.5, 2.5, 2.5, 2.75, 10.0, 1e6, 1e-9]
    rows = [(i, rng.choice((None, "a", "a", "a", "b")), None if rng.random() < 0.03 else rng.randrange(200), rng.choice(amounts) if rng.random() < 0.5 else round(rng.lognormvariate(3, 2), 2)) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, g string, at long, x double")
    zero = F.lit(0).cast("long")
    out = order.sliding_percentile(df, ["g"], "p", q, F.col("x"), (F.col("at"), F.col("id")), (F.col("at") + 25, zero), (F.col("at"), F.col("id")), piece, hot)
    assert out.columns == ["id", "g", "at", "x", "p"]
    got = {r.id: r.p for r in out.collect()}
    assert len(got) == len(rows)
    for i, g, t, _ in rows:
        near = [x for j, h, s, x in rows if t is not None and s is not None and h == g and x is not None and (s, j) <= (t, i) and t < s + 25]
        if not near:
            assert got[i] is None
        else:
            near = sorted(near, key=lambda x: (np.isnan(x), x))
            place = q * (len(near) - 1)
            low, high = near[int(np.floor(place))], near[int(np.ceil(place))]
            want = low if low == high else low + (high - low) * (place - np.floor(place))
            assert got[i] == pytest.approx(want, rel=1e-12, nan_ok=True), (i, near)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, g string, at long, x double")
    one = F.col("at")
    assert order.sliding_percentile(df, ["g"], "p", 0.5, F.col("x"), (one, one), (one + 5, one), (one, one)).count() == 0


def test_times_of_any_zone_go_through(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1, "a", 5, 2.0), (2, "a", 6, 4.0)], "id long, g string, at long, x double")
    df = df.withColumn("ts", F.timestamp_seconds("at")).withColumn("s", F.struct("ts", "g")).withColumn("l", F.array("ts")).withColumn("n", F.col("ts").cast("timestamp_ntz"))
    try:
        for zone in ("Etc/UTC", "America/New_York", "+02:00"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            zero = F.lit(0).cast("long")
            out = order.sliding_percentile(df, ["g"], "p", 0.5, F.col("x"), (F.col("at"), zero), (F.col("at") + 9, zero), (F.col("at"), zero))
            got = {r.id: (r.p, r.t, r.u, r.v) for r in out.select("id", "p", F.unix_seconds("ts").alias("t"), F.unix_seconds("s.ts").alias("u"), F.unix_seconds(F.col("l")[0]).alias("v")).collect()}
            assert got == {1: (2.0, 5, 5, 5), 2: (3.0, 6, 6, 6)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_buckets_of_small_groups_stay_a_small_fraction_of_hot(spark):
    n, hot = 400_000, 100_000
    sizes = spark.range(n).groupBy(order._bucket(["id"], n, hot).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= hot // 32
