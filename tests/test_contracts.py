"""Null, tie and boundary rules on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import alerts as A, features as W, profiles as P


def test_null_is_different(spark):
    df = spark.createDataFrame([(None, None), ("x", "x"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(S.differs(F.col("a"), F.col("b"))).collect()] == [1, 0, 1]


def test_rolling_leaves_out_ties(spark):
    at = ["01 00:00:00", "01 01:00:00", "01 01:00:00", "01 01:00:00", "02 01:00:00", "02 01:00:01"]
    rows = [(i, 1, i, 2.0**i, dt.datetime.fromisoformat(f"2023-01-{a}")) for i, a in enumerate(at)]
    df = W.rolling(spark.createDataFrame(rows, "tx_id long, Sender_account long, Receiver_account long, Amount double, ts timestamp")).orderBy("tx_id")
    got = [(r.Sender_window_count, r.Sender_window_amount) for r in df.collect()]
    assert got == [(0, 0.0), (1, 1.0), (1, 1.0), (1, 1.0), (3, 14.0), (1, 16.0)]


def test_session_breaks_only_after_the_gap(spark):
    at = ["2023-01-01", "2023-01-08", "2023-01-15 00:00:01"]
    df = spark.createDataFrame([(i, "a", dt.datetime.fromisoformat(a)) for i, a in enumerate(at)], "i long, k string, ts timestamp")
    assert [r.session for r in A.sessions(df, ["k"], "ts", 7, "i").orderBy("i").collect()] == [1, 1, 2]


def test_causal_features_do_not_see_later_rows(spark):
    at = ["2023-02-27 23:59:59", "2023-03-01 00:00:00", "2023-03-01 00:00:00", "2023-03-03 18:30:00", "2023-03-04 06:00:00"]
    rows = [(i, "acct", r, a, i % 2, 0, dt.datetime.fromisoformat(t)) for i, (t, r, a) in enumerate(zip(at, "pqqps", (7.5, 20.0, 5.0, 60.0, 2.5), strict=True))]
    df = spark.createDataFrame(rows, "tx_id long, Sender_account string, Receiver_account string, Amount double, Cross_border int, Currency_mismatch int, ts timestamp")
    origin = F.lit("2023-03-01").cast("timestamp")
    run = lambda x: [tuple(r) for r in W.causal_bucket(x, 14, origin).orderBy("tx_id").select("bucket", "n", "unique_receivers", "total", "median_amount").collect()]
    full = run(df)
    assert full == [(-1, 1, 1, 7.5, 7.5), (0, 1, 1, 20.0, 20.0), (0, 2, 1, 25.0, 12.5), (0, 3, 2, 85.0, 20.0), (0, 4, 3, 87.5, 12.5)]
    for k in range(1, 5):
        assert run(df.where(f"tx_id < {k}")) == full[:k]
    snapped = W.causal_bucket(df, 14, origin, (10.0, 15.0, 30.0)).orderBy("tx_id").collect()
    assert [r.median_amount for r in snapped] == [10.0, 30.0, 15.0, 30.0, 15.0]


def test_dates_and_shares(spark):
    bad = spark.createDataFrame([("2023-01-01",), ("not-a-date",)], "Date string")
    with pytest.raises(ValueError, match="Unparseable Date"):
        P.parse_dates(bad)
    days = spark.createDataFrame([(dt.date(2023, 1, i), 1) for i in range(1, 6)], "day date, transactions long")
    with pytest.raises(ValueError):
        P.boundaries(days, 0.8, 0.3)
    b = P.boundaries(days).first()
    assert (b.train_end.day, b.development_end.day) == (3, 4)


def test_block_sample_is_bounded(spark):
    df = spark.range(100).select(F.col("id").alias("tx_id"), (F.col("id") % 10 == 0).cast("int").alias("Is_laundering"))
    got = P.block_sample(df, 50, {0: 3, 1: 99}).groupBy("Is_laundering").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 6, 1: 10}


def test_streaming_sessions_equal_batch(spark, tmp_path):
    from tidewatch.streaming.jobs import ingest, session_alerts

    rows = [(i, 1, 10.0, 0.9, dt.datetime(2023, 1, 1) + dt.timedelta(days=d)) for i, d in enumerate((0, 3, 12, 40))]
    df = spark.createDataFrame(rows, "tx_id long, Sender_account long, Amount double, ml_probability double, ts timestamp")
    df.unionByName(df.where("tx_id = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session_alerts(ingest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), 0.5)
    q = stream.writeStream.format("memory").queryName("alerts_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted(r.transaction_count for r in spark.table("alerts_out").collect())
    assert got in ([1, 2], [1, 1, 2])  # the last session stays open until a later row closes it


def test_stratified_split_keeps_the_shares(spark):
    df = spark.range(20_000).select(F.col("id").alias("tx_id"), (F.col("id") % 50 == 0).cast("int").alias("Is_laundering"))
    got = {(r[0], r[1]): r[2] for r in P.stratified_split(df).groupBy("Is_laundering", "fold").count().collect()}
    assert abs(got[0, "test"] / 19_600 - 0.2) < 0.02 and abs(got[1, "test"] / 400 - 0.2) < 0.08


def test_audits_find_what_is_wrong(spark):
    from tidewatch.operators import audit

    rows = [(1, 1, 0.9, 1), (1, 0, 0.1, 0), (2, 3, 1.5, 1), (3, 0, 0.2, 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "tx_id long, Is_laundering int, ml_probability double, ML_ALERT int")
    got = {r[0]: r[1] for r in audit.evidence(df, 0.5).collect()}
    assert got == {"null_transaction_id": 1, "null_label": 1, "null_probability": 1, "label_not_binary": 1, "probability_out_of_range": 1, "flag_against_threshold": 1, "repeated_transaction_id": 1}


def test_ranks_cross_bands_and_empty_queues(spark):
    df = spark.createDataFrame([(0.91, "a"), (0.12, "b"), (0.91, "c"), (None, "d")], "p double, k string")
    got = A.ranked(df, [F.desc_nulls_last("p"), F.asc("k")], -F.floor(F.col("p") * 10)).orderBy("queue_rank").collect()
    assert [(r.k, r.queue_rank) for r in got] == [("a", 1), ("c", 2), ("b", 3), ("d", 4)]
    assert A.ranked(df.limit(0), [F.desc("p")], F.col("p")).count() == 0


def test_history_goes_on_over_micro_batches(spark, tmp_path):
    from tidewatch.streaming.jobs import drained, running_history

    rows = [(i, 1, 2.0, dt.datetime(2023, 1, 1, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "tx_id long, Sender_account long, Amount double, ts timestamp")
    df.where("tx_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("tx_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.Sender_prior_count, r.Sender_prior_amount) for r in drained(running_history(stream), "h").collect())
    assert got == [(i, 2.0 * i) for i in range(6)]


def test_buckets_leave_out_rows_without_an_account(spark):
    rows = [(None, 2, 1.0, 0, 0, dt.datetime(2023, 1, 1)), (1, None, 2.0, 0, 0, dt.datetime(2023, 1, 1)), (1, 2, 4.0, 0, 0, dt.datetime(2023, 1, 2))]
    df = spark.createDataFrame(rows, "Sender_account long, Receiver_account long, Amount double, Cross_border int, Currency_mismatch int, ts timestamp")
    got = W.bucket_features(df, "Sender_account", "Receiver_account", W.epoch_bucket(F.col("ts"), 60)).collect()
    assert [(r.Sender_account, r.n, r.total, r.unique_others) for r in got] == [(1, 2, 6.0, 1)]
