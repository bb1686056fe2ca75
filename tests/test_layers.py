"""Layers are made once for a content, again after a change, and deleted with their scope."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import layers as L
from tidewatch.sources.tables import transactions

DATA = "/root/testdata/sf0.001"


def paths(spark):
    return [p.removeprefix("file://") for (app, _), p in L._WRITTEN.items() if app == spark.sparkContext.applicationId]


def test_made_once_and_again_after_a_change(spark, tmp_path):
    source, made = str(tmp_path / "t"), []
    spark.range(3).coalesce(1).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    get = lambda: sorted(r.x for r in L.layer(spark, source, "twice", make).collect())
    before = set(paths(spark))
    with L.kept(spark):
        assert get() == get() == [0, 2, 4] and len(made) == 1
        spark.range(5, 6).coalesce(1).write.mode("append").parquet(source)
        assert get() == [0, 2, 4, 10] and len(made) == 2
        mine = set(paths(spark)) - before
        assert len(mine) == 2 and all(map(os.path.isdir, mine))
    assert not any(map(os.path.exists, mine)) and set(paths(spark)) == before
    assert get() == [0, 2, 4, 10] and len(made) == 3
    # one that is gone is made again; a failed one isn't kept
    spark._jvm.org.apache.hadoop.fs.FileUtil.fullyDelete(spark._jvm.java.io.File((set(paths(spark)) - before).pop()))
    assert get() == [0, 2, 4, 10] and len(made) == 4
    with pytest.raises(ZeroDivisionError):
        L.layer(spark, source, "bad", lambda: 1 // 0)
    assert L.layer(spark, source, "bad", make).count() == 4
    L.drop(spark)
    assert not paths(spark)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_scan_the_source_twice_at_most(spark):
    from tidewatch.plans import QUERIES

    with L.kept(spark):
        same = L.transaction_layer(spark, DATA)
        assert same.exceptAll(transactions(spark, DATA)).count() == 0 and same.count() == 1000
        for name in ("c7_case_mart", "c8_case_evidence", "j12_queue_scores", "d22_combined_v3", "c6_rule_queue"):
            plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("user_id") <= 2, name
