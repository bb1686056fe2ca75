"""Queries that run as streams over the whole table; their SQL states what a batch would find in closed windows."""

from __future__ import annotations

from ..sources.tables import transaction_stream
from ..streaming import jobs
from .registry import _F, _H, _query

_MARK = ", mk AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM f)"


@_query(_F + " SELECT tx_id, Sender_account, Receiver_account, Amount FROM f")
def x1_stream_ingest(spark, sf_dir):
    return jobs.drained(jobs.ingest(transaction_stream(spark, sf_dir)), "ingest").select("tx_id", "Sender_account", "Receiver_account", "Amount")


@_query(_F + _MARK + ", b AS (SELECT time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01') AS bucket, Sender_account, count(*) AS n, sum(Amount) AS total FROM f GROUP BY 1,2) SELECT b.* FROM b, mk WHERE bucket + INTERVAL 10 DAYS <= mark")
def x2_stream_windows(spark, sf_dir):
    return jobs.drained(jobs.account_windows(transaction_stream(spark, sf_dir).withWatermark("ts", "1 day")), "windows").select("bucket", "Sender_account", "n", "total")


@_query(_F + _MARK + """, z AS (SELECT *, coalesce(epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY Sender_account ORDER BY ts, tx_id)) > 2*86400000000, true) AS nw FROM f WHERE ml),
 q AS (SELECT *, sum(CAST(nw AS INT)) OVER (PARTITION BY Sender_account ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING) AS s FROM z),
 a AS (SELECT Sender_account, min(ts) AS alert_created_at, max(ts) AS last, count(*) AS transaction_count, sum(Amount) AS alert_amount, max(ml_probability) AS p FROM q GROUP BY Sender_account, s)
 SELECT Sender_account, alert_created_at, transaction_count, alert_amount, round(p,6) AS ml_probability_max FROM a, mk WHERE last + INTERVAL 2 DAYS <= mark""")
def x3_stream_sessions(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..operators.alerts import THRESHOLD

    found = jobs.drained(jobs.session_alerts(transaction_stream(spark, sf_dir).withWatermark("ts", "1 day"), THRESHOLD, "2 days"), "sessions")
    return found.select("Sender_account", "alert_created_at", "transaction_count", "alert_amount", F.round("ml_probability_max", 6).alias("ml_probability_max"))


@_query(_F + _H + " SELECT tx_id, spc AS Sender_prior_count, spa AS Sender_prior_amount, CAST(gap AS DOUBLE) AS Sender_gap FROM h")
def x4_stream_history(spark, sf_dir):
    return jobs.drained(jobs.running_history(transaction_stream(spark, sf_dir)), "history")


@_query(_F + _H + " SELECT tx_id, swc AS Sender_window_count, swa AS Sender_window_amount FROM h")
def x4_stream_lookback(spark, sf_dir):
    return jobs.drained(jobs.running_lookback(transaction_stream(spark, sf_dir)), "lookback")


@_query(_F + _H + _MARK + " SELECT tx_id, swc AS Sender_window_count, swa AS Sender_window_amount FROM h, mk WHERE (epoch_us(ts)//86400000000 + 1)*86400000000 <= epoch_us(mark)")
def x4_shuffled_lookback(spark, sf_dir):
    """Rows arrive up to a day late, in batches of six days of arrival: each still gets the answer of the batch."""
    from pyspark.sql import functions as F

    from ..sources.tables import shared_path, transactions

    tx = transactions(spark, sf_dir).select("tx_id", "ts", "Sender_account", "Amount")
    arrives = F.unix_seconds("ts") + F.pmod(F.xxhash64("tx_id"), F.lit(86_400))
    batch = F.expr("arrives DIV 518400")
    path, out, marks = (shared_path(spark, n) for n in ("arrivals", "lookback-out", "lookback-marks"))
    tx.withColumn("arrives", arrives).withColumn("batch", batch).drop("arrives").write.partitionBy("batch").parquet(path)
    arrived = shared_path(spark, "arrived")
    for r in spark.read.parquet(path).select("batch").distinct().orderBy("batch").collect():  # a row for each six days
        spark.read.schema(tx.schema).parquet(f"{path}/batch={r.batch}").write.mode("append").parquet(arrived)
        stream = jobs.settled_lookback(spark.readStream.schema(tx.schema).parquet(arrived))
        found = jobs.drained_into(stream, out, marks)
    return found


@_query(_F + """, mk AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM f WHERE tx_id%20<>0), b AS (SELECT time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS bucket, CAST(sum(CAST(tx_id%20<>0 AS INT)) AS BIGINT) AS stream_n, count(*) AS batch_n FROM f GROUP BY 1)
 SELECT bucket, stream_n, batch_n, batch_n-stream_n AS missing FROM b, mk WHERE bucket + INTERVAL 5 DAYS <= mark""")
def x5_late_rows(spark, sf_dir):
    """A twentieth of the rows arrives after the rest: windows that the watermark has closed leave them out, and a batch shows how many."""
    from pyspark.sql import functions as F

    from ..sources.tables import shared_path, transactions

    tx = transactions(spark, sf_dir).select("tx_id", "ts")
    arrived, out, marks = (shared_path(spark, n) for n in ("arrived", "late-windows", "late-marks"))
    window = F.window("ts", "5 days")
    for part in (tx.where("tx_id % 20 <> 0"), tx.where("tx_id % 20 = 0")):
        part.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(tx.schema).parquet(arrived).withWatermark("ts", "1 day")
        counted = stream.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "n")
        closed = jobs.drained_into(counted, out, marks)
    batch = tx.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "n")
    return jobs.reconciled(closed, batch, ["bucket"])
