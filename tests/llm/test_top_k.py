"""Exact top-k against brute force in Python integers: lengths, huge components, far and repeated ids, share of blocks left out."""

import math
from fractions import Fraction

import numpy as np

from tidewatch.llm import topk


FAR = 10**38 - 1


def floored(x, scale=256):
    return [math.floor(Fraction(v) * scale) for v in x]


def brute(rows, every, k=5):
    ok = [(i, floored(x)) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-max(-FAR, min(FAR, sum(x * y for x, y in zip(a, b)))), c) for c, b in ok if c != q)[:k]
            out += [(q, r, c, max(-(2**63 - 1), min(2**63 - 1, -s))) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, every, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    return sorted(tuple(r) for r in topk.top_k(df, df.where(f"vec_id % {every} = 0"), **sizes).collect())


def test_lengths_huge_components_and_far_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0, 5.0]), (1000, [0.5] * 5), (2**62, [0.25, -0.5]), (300, []), (350, None), (400, [1.0, None]), (None, [1.0])]
    rows += [(201, rows[3][1])] * 3  # repeated rows
    assert found(spark, [(*r, "x") for r in rows], 50, block=8, shard=20, group=2) == brute(rows, 50)
    huge = [*rows[:60], (500, [1e300, -1e300, 3.0, 1.0]), (501, [1e300, 1e299, 0.1, 0.2]), (502, [-1e16, 1e-300, 1.0, 2.0]), (550, [1.7e308, 1.0, 0.0, 0.0])]
    assert found(spark, [(*r, "x") for r in huge], 50, block=8, shard=1000, group=20) == brute(huge, 50)


def test_bounds_leave_blocks_out_where_vectors_cluster(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.2).tolist(), "x") for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    share = topk.skipped_share(df, df.where("vec_id % 50 = 0"), block=16).first().skipped
    assert share > 0.8
    assert found(spark, rows, 50, block=16) == brute([r[:2] for r in rows], 50)


def test_shards_are_even_however_rows_are_partitioned(spark):
    """One row a partition: numbers by partition would all be multiples of 2 ** 33."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string").repartition(400, "vec_id")
    met = topk._met(df, df.where("vec_id % 50 = 0"), 400, 256, 8, 100, 4)
    each = sorted(r["count"] for r in met.groupBy("query_id").count().collect())
    assert each == [399] * 8
    from pyspark.sql import functions as F

    shards = [r["count"] for r in topk.finite(df).groupBy(F.pmod(F.xxhash64("vec_id", "x"), F.lit(4))).count().collect()]
    assert len(shards) == 4 and max(shards) < 1.5 * min(shards)
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), block=8, shard=100, group=4).collect()) == brute([r[:2] for r in rows], 50)
