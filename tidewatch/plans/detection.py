"""Queries of scenarios, parameter grids, alerts, cases and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts as A, features as W, network as N, profiles as P, scenarios as D
from ..sources.layers import layer, transaction_layer
from ..sources.tables import transactions
from .registry import _CASE, _EDGE, _F, _FLAGS, _H, _MART, _SESS, _features, _lean, _mart, _query, _transfers, _v1

_B = """, {0} AS (SELECT time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01') AS bk, {1} AS acc, count(*) AS n, sum(Amount) AS total, quantile_cont(Amount,0.5) AS md, count(DISTINCT {2}) AS u, avg(Cross_border) AS c, avg(Currency_mismatch) AS x FROM f GROUP BY 1,2)"""
_V2 = _F + _B.format("sb", "Sender_account", "Receiver_account") + _B.format("rb", "Receiver_account", "Sender_account") + """, j AS (SELECT f.*,
 CAST(sb.n>=8 AND sb.md<5000 AND sb.total>=20000 AND sb.u<=3 AS INT) AS smurfing, CAST(f.Amount<10000 AND rb.u>=5 AND rb.total>=20000 AND (rb.c>=0.2 OR rb.x>=0.25) AS INT) AS structuring,
 CAST(sb.u BETWEEN 5 AND 12 AND sb.n BETWEEN 5 AND 20 AND (sb.c>=0.2 OR sb.x>=0.25) AS INT) AS fan_out, CAST(rb.u BETWEEN 5 AND 15 AND rb.n BETWEEN 5 AND 20 AND (rb.c>=0.1 OR rb.x>=0.2) AS INT) AS fan_in
 FROM f JOIN sb ON sb.acc=f.Sender_account AND sb.bk=time_bucket(INTERVAL '10 days', f.ts, TIMESTAMP '1970-01-01') JOIN rb ON rb.acc=f.Receiver_account AND rb.bk=time_bucket(INTERVAL '10 days', f.ts, TIMESTAMP '1970-01-01'))"""


def _v2(spark, sf_dir):
    """Transactions with the second generation's flags: each side's bucket features joined back to the rows."""
    f = _features(spark, sf_dir).withColumn("bucket", W.epoch_bucket(F.col("ts"), 10))
    for account, other, flags in (
        ("Sender_account", "Receiver_account", {"smurfing": D.smurfing_bucket(f), "fan_out": D.fan_bucket(5, 12, 0.20, 0.25)}),
        ("Receiver_account", "Sender_account", {"structuring": D.structuring_v2(), "fan_in": D.fan_bucket(5, 15, 0.10, 0.20)}),
    ):
        b = W.bucket_features(f.drop("bucket"), account, other, W.epoch_bucket(F.col("ts"), 10)).select("bucket", account, "n", "total", "median_amount", "unique_others", "cross_rate", "fx_rate")
        f = f.join(b, [account, "bucket"]).withColumns(flags).drop("n", "total", "median_amount", "unique_others", "cross_rate", "fx_rate")
    return f.withColumn("alert", F.greatest("smurfing", "structuring", "fan_out", "fan_in"))


@_query(_V2 + " SELECT tx_id, smurfing, structuring, fan_out, fan_in, greatest(smurfing,structuring,fan_out,fan_in) AS alert FROM j")
def d19_second_generation(spark, sf_dir):
    return _v2(spark, sf_dir).select("tx_id", "smurfing", "structuring", "fan_out", "fan_in", "alert")


@_query(_V2 + ", k AS (SELECT Is_laundering AS y, unnest([{'s':'smurfing','v':smurfing},{'s':'structuring','v':structuring},{'s':'fan_out','v':fan_out},{'s':'fan_in','v':fan_in}]) AS z FROM j) SELECT z.s AS scenario, CAST(sum(z.v) AS BIGINT) AS triggered, CAST(sum(z.v*y) AS BIGINT) AS hits, round(sum(z.v)/count(*),6) AS trigger_rate, round(coalesce(sum(z.v*y)/nullif(sum(z.v),0),0),6) AS precision, round(sum(z.v*y)/sum(y),6) AS recall FROM k GROUP BY 1")
def a17_second_generation_summary(spark, sf_dir):
    from ..operators import evaluation as E

    return E.flag_summary(_v2(spark, sf_dir), ["smurfing", "structuring", "fan_out", "fan_in"])


_W90 = "WINDOW w AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)"


@_query(_F + ", g AS (SELECT tx_id, count(*) OVER w AS n, quantile_cont(Amount,0.5) OVER w AS md, sum(Amount) OVER w AS t, count(DISTINCT Receiver_account) OVER w AS u, avg(Cross_border) OVER w AS c, avg(Currency_mismatch) OVER w AS x FROM f " + _W90 + ") SELECT tx_id, CAST(n>=3 AND md<3000 AND t>=20000 AND u<=3 AND c<=0.15 AND x<=0.15 AS INT) AS smurfing FROM g")
def d20_smurfing_90_days(spark, sf_dir):
    return W.sliding(_lean(_features(spark, sf_dir), "tx_id"), 90).select("tx_id", D.smurfing_v3().alias("smurfing"))


_KIND = """, o AS (SELECT min(ts) AS t0 FROM f WHERE Payment_type='{0}'), k AS (SELECT f.*, CAST(floor((epoch_us(ts)-epoch_us(t0))/(30*86400000000.0)) AS BIGINT) AS bk FROM f, o WHERE Payment_type='{0}'),
 a AS (SELECT bk, Sender_account, count(*) AS n, sum(Amount) AS t, quantile_cont(Amount,0.5) AS md, avg(Cross_border) AS c, avg(Currency_mismatch) AS x FROM k GROUP BY 1,2) SELECT k.tx_id FROM k JOIN a USING (bk, Sender_account) WHERE {1}"""


def _what_if(rows, condition, days):
    """Ids of the rows whose sender's bucket, counted from the first row, meets the condition."""
    first = rows.agg(F.min("ts").alias("_t0"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("bucket", F.floor((F.unix_micros("ts") - F.unix_micros("_t0")) / F.lit(days * 86_400_000_000)).cast("long"))
    b = W.bucket_features(rows.withColumnRenamed("bucket", "_b"), "Sender_account", "Receiver_account", F.col("_b"))
    return rows.select("tx_id", "Sender_account", "bucket").join(b.where(condition == 1), ["bucket", "Sender_account"], "left_semi").select("tx_id")


@_query(_F + _KIND.format("Cash Deposit", "n>=2 AND md<6000 AND t>=2000 AND c<=0.15 AND x<=0.15"))
def d23_cash_deposit_what_if(spark, sf_dir):
    return _what_if(_features(spark, sf_dir).where("Payment_type = 'Cash Deposit'"), D.cash_smurfing(2, 6_000.0, 2_000.0), 30)


@_query(_F + _KIND.format("Cash Withdrawal", "n>=2 AND md<=8000 AND t>=2000"))
def d24_cash_withdrawal_what_if(spark, sf_dir):
    return _what_if(_features(spark, sf_dir).where("Payment_type = 'Cash Withdrawal'"), D.cash_withdrawal(2, 8_000.0, 2_000.0), 30)


@_query(_F + ", o AS (SELECT min(ts) AS t0 FROM f), k AS (SELECT f.*, CAST(floor((epoch_us(ts)-epoch_us(t0))/(14*86400000000.0)) AS BIGINT) AS bk FROM f, o), a AS (SELECT bk, Sender_account, count(*) AS n, count(DISTINCT Receiver_account) AS u, avg(Cross_border) AS c, avg(Currency_mismatch) AS x FROM k GROUP BY 1,2) SELECT k.tx_id FROM k JOIN a USING (bk, Sender_account) WHERE u>=3 AND n BETWEEN 3 AND 20 AND (c>=0.2 OR x>=0.2)")
def d25_fan_out_what_if(spark, sf_dir):
    return _what_if(_features(spark, sf_dir), D.fan_out_what_if(3, 20, 0.2), 14)


@_query(_F + _H + " SELECT tx_id, CAST(swa>=20000 AS INT) AS high_value, CAST(swc>=5 AS INT) AS high_velocity FROM h")
def d29_d37_rolling_totals(spark, sf_dir):
    r = W.rolling(transactions(spark, sf_dir))
    return r.select("tx_id", S.holds(F.col("Sender_window_amount") >= 20_000).alias("high_value"), S.holds(F.col("Sender_window_count") >= 5).alias("high_velocity"))


@_query(_F + _EDGE + """, v AS (SELECT dst AS account, src AS payer, NULL AS payee, ts FROM e UNION ALL SELECT src, NULL, dst, ts FROM e),
 s AS (SELECT account, epoch(ts) AS "at", count(DISTINCT payer) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS senders, count(DISTINCT payee) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND FOLLOWING AND INTERVAL 86400 SECONDS FOLLOWING) AS receivers FROM v)
 SELECT DISTINCT account, CAST("at" AS BIGINT) AS "at", senders, receivers FROM s WHERE senders>=3 AND receivers>=3""")
def d30_gather_scatter(spark, sf_dir):
    return N.gather_scatter(_transfers(spark, sf_dir)).select("account", "at", F.col("senders").cast("long").alias("senders"), F.col("receivers").cast("long").alias("receivers"))


@_query(_F + _EDGE + " SELECT a.src, a.dst AS mid1, b.dst AS mid2, a.tx_id AS tx1, b.tx_id AS tx2, c.tx_id AS tx3 FROM e a JOIN e b ON a.dst=b.src AND b.dst<>a.src AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 3 DAYS JOIN e c ON c.src=b.dst AND c.dst=a.src AND c.ts>b.ts AND c.ts<=a.ts+INTERVAL 3 DAYS")
def d33_triangles(spark, sf_dir):
    return N.triangles(_transfers(spark, sf_dir), 3 * 86_400)


@_query(_F + _EDGE + ", p AS (SELECT b.dst AS root, a.dst AS mid, count(DISTINCT a.src) AS leaves FROM e a JOIN e b ON a.dst=b.src AND a.src<>b.dst AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 7 DAYS GROUP BY 1,2 HAVING count(DISTINCT a.src)>=2) SELECT root, count(*) AS mids, CAST(sum(leaves) AS BIGINT) AS leaf_links FROM p GROUP BY 1 HAVING count(*)>=2")
def d35_layered_fan_in(spark, sf_dir):
    return N.layered_fan_in(_transfers(spark, sf_dir), 7 * 86_400)


@_query(_F + """, g AS (SELECT tx_id, Receiver_bank_location AS loc, count(*) OVER nr AS near_n, count(*) OVER fr AS far_n, sum(Amount) OVER nr AS near_amount, coalesce(sum(Amount) OVER fr,0) AS far_amount, list(Receiver_bank_location) OVER ev AS known FROM f
 WINDOW nr AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 604799 SECONDS PRECEDING AND CURRENT ROW), fr AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 3196799 SECONDS PRECEDING AND INTERVAL 604800 SECONDS PRECEDING), ev AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 3196799 SECONDS PRECEDING AND INTERVAL 1 SECOND PRECEDING))
 SELECT tx_id, near_n, far_n, near_amount, far_amount, CAST(far_amount>0 AND near_amount*30>=21*far_amount AS INT) AS amount_change, CAST(far_n>0 AND near_n*30>=21*far_n AS INT) AS count_change, CAST(coalesce(len(known)>0 AND NOT list_contains(known, loc), false) AS INT) AS new_place FROM g""")
def d36_behaviour_change(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("tx_id", "ts", "Sender_account", "Receiver_bank_location", "Amount")
    return N.behaviour_change(tx).select("tx_id", "near_n", "far_n", "near_amount", "far_amount", "amount_change", "count_change", "new_place")


_DAYS, _LEAST, _MOST, _RISK = (7, 10, 14, 21), (3, 4, 5, 6), (12, 16, 20, 30), (0.10, 0.15, 0.20, 0.25, 0.30)
_FANGRID = """, dd AS (SELECT unnest([7,10,14,21]) AS d), o AS (SELECT d, Sender_account, CAST(floor((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-15'))/(d*86400000000.0)) AS BIGINT) AS bk, count(*) AS n, count(DISTINCT Receiver_account) AS u, greatest(avg(Cross_border),avg(Currency_mismatch)) AS r,
 sum(CAST(ts>=TIMESTAMP '2024-01-15' AS INT)) AS dt, sum(CAST(ts>=TIMESTAMP '2024-01-15' AS INT)*Is_laundering) AS da, sum(CAST(ts>=TIMESTAMP '2024-01-15' AND Laundering_type='Fan_Out' AS INT)) AS dg FROM f, dd GROUP BY 1,2,3 HAVING sum(CAST(ts>=TIMESTAMP '2024-01-15' AS INT))>0),
 t AS (SELECT d, sum(dt) AS at, sum(dg) AS ag FROM o GROUP BY 1),
 g AS (SELECT * FROM (SELECT unnest([7,10,14,21]) AS days), (SELECT unnest([3,4,5,6]) AS min_cp), (SELECT unnest([12,16,20,30]) AS max_n), (SELECT unnest([CAST(0.10 AS DOUBLE),0.15,0.20,0.25,0.30]) AS min_rate))
 SELECT days, min_cp, max_n, min_rate, CAST(coalesce(sum(dt),0) AS BIGINT) AS triggered, CAST(coalesce(sum(da),0) AS BIGINT) AS aml_hits, CAST(coalesce(sum(dg),0) AS BIGINT) AS target_hits, count(o.n) AS windows,
 round(coalesce(sum(dt),0)/max(t.at),6) AS trigger_rate, round(coalesce(sum(da)/nullif(sum(dt),0),0),6) AS precision, round(coalesce(sum(dg),0)/max(t.ag),6) AS target_recall
 FROM g JOIN t ON t.d=g.days LEFT JOIN o ON o.d=days AND o.u>=min_cp AND o.n>=min_cp AND o.n<=max_n AND o.r>=min_rate GROUP BY 1,2,3,4"""


@_query(_F + _FANGRID)
def g6_fan_out_grid(spark, sf_dir):
    """320 settings: rows once per window length, windows once, then cells of thresholds."""
    start = F.lit("2024-01-15").cast("timestamp")
    dev = (F.col("ts") >= start).cast("int")
    f = _features(spark, sf_dir).withColumn("d", F.explode(F.array(*map(F.lit, _DAYS))))
    bucket = F.floor((F.unix_micros("ts") - F.unix_micros(start)) / (F.col("d").cast("double") * 86_400_000_000)).cast("long")
    o = f.groupBy("d", "Sender_account", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Receiver_account").alias("u"), F.greatest(F.avg("Cross_border"), F.avg("Currency_mismatch")).alias("r"),
        F.sum(dev).alias("dev_transactions"), F.sum(dev * F.col("Is_laundering")).alias("dev_aml"), F.sum(dev * (F.col("Laundering_type") == "Fan_Out").cast("int")).alias("dev_target"),
    ).where("dev_transactions > 0")
    c = P.cells(o, cell_days=F.col("d"), cell_cp=P.at_least(F.least("u", "n"), _LEAST), cell_n=P.below("n", tuple(m + 1 for m in _MOST)), cell_rate=P.at_least("r", _RISK))
    g = P.grid(spark, days=_DAYS, min_cp=_LEAST, max_n=_MOST, min_rate=_RISK)
    g = g.select(*(F.col(k).cast("int").alias(k) for k in ("days", "min_cp", "max_n")), "min_rate")
    return P.evaluate_grid(c, g, (F.col("cell_cp") >= F.col("min_cp")) & (F.col("cell_n") <= F.col("max_n") + 1) & (F.col("cell_rate") >= F.col("min_rate")), per="days")


@_query(_F + _FANGRID.replace(" SELECT days, min_cp", ", res AS (SELECT days, min_cp", 1) + "), k AS (SELECT *, bool_or(trigger_rate<=0.05) OVER () AS found FROM res) SELECT days, min_cp, max_n, min_rate, triggered, aml_hits, target_hits, windows, trigger_rate, precision, target_recall FROM k WHERE trigger_rate<=0.05 OR NOT found ORDER BY target_recall DESC, precision DESC, days, min_cp, max_n, min_rate LIMIT 12")
def t2_shortlist(spark, sf_dir):
    return P.shortlist(g6_fan_out_grid(spark, sf_dir), 0.05, 12, ("days", "min_cp", "max_n", "min_rate"))


@_query(_F + _H + _FLAGS + " SELECT printf('SCN_SINGLE_LARGE-%07d', row_number() OVER (ORDER BY ts, tx_id)) AS alert_id, Sender_account AS focal_account, tx_id, ts AS alert_timestamp, Amount AS amount FROM v WHERE SCN_CROSS_BORDER_CURRENCY_MISMATCH=1")
def c1_transaction_alerts(spark, sf_dir):
    return A.transaction_alerts(_v1(spark, sf_dir), "SCN_SINGLE_LARGE", "SCN_CROSS_BORDER_CURRENCY_MISMATCH").select("alert_id", "focal_account", "tx_id", "alert_timestamp", "amount")


@_query(_F + _H + _FLAGS + " SELECT printf('SCN_FAN_IN-%07d', row_number() OVER (ORDER BY ts, tx_id)) AS alert_id, Receiver_account AS focal_account, tx_id, ts AS alert_timestamp, ts - INTERVAL 24 HOURS AS lookback_start FROM v WHERE SCN_FAN_IN=1")
def c2_window_alerts(spark, sf_dir):
    return A.transaction_alerts(_v1(spark, sf_dir), "SCN_FAN_IN", "SCN_FAN_IN", "Receiver_account", 24).select("alert_id", "focal_account", "tx_id", "alert_timestamp", "lookback_start")


_NAMES = ("SCN_SANCTIONED_GEOGRAPHY", "SCN_FAN_OUT", "SCN_STRUCTURING_PROXY")
_RULES = _F + _H + _FLAGS + ", hit AS (SELECT unnest([" + ",".join(f"{{'s':'{n}','f':{n}}}" for n in _NAMES) + """]) AS x, Sender_account AS account, ts, tx_id, Amount FROM v),
 hz AS (SELECT *, coalesce(epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY x.s, account ORDER BY ts, tx_id)) > CASE x.s WHEN 'SCN_FAN_OUT' THEN 3 ELSE 2 END*86400000000, true) AS nw FROM hit WHERE x.f=1),
 hs AS (SELECT *, CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY x.s, account ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM hz),
 ra AS (SELECT 'ALT-RV3-' || upper(substr(sha1(x.s || '|' || account || '|' || session),1,16)) AS alert_id, x.s AS scenario_id, account AS acc, min(ts) AS started, count(*) AS n FROM hs GROUP BY 1,2,3),
 rz AS (SELECT *, coalesce(epoch_us(started)-epoch_us(lag(started) OVER (PARTITION BY acc ORDER BY started, alert_id)) > 7*86400000000, true) AS nw FROM ra),
 rl AS (SELECT *, 'CAS-RV3-' || upper(substr(sha1(acc || '|' || CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY acc ORDER BY started, alert_id ROWS UNBOUNDED PRECEDING) AS BIGINT)),1,16)) AS case_id FROM rz),
 rc AS (SELECT case_id, any_value(acc) AS subject_id, count(*) AS alert_count, count(DISTINCT scenario_id) AS scenario_count, CAST(sum(n) AS BIGINT) AS transaction_count, max(CAST(scenario_id='SCN_SANCTIONED_GEOGRAPHY' AS INT)) AS policy_flag, max(started) AS last_alert_at, string_agg(DISTINCT scenario_id, ' | ' ORDER BY scenario_id) AS scenarios,
  CAST(least(100, max(CASE scenario_id WHEN 'SCN_SANCTIONED_GEOGRAPHY' THEN 80 WHEN 'SCN_FAN_OUT' THEN 60 ELSE 50 END) + 10*(count(DISTINCT scenario_id)-1) + 5*least(4, count(*)-1)) AS INT) AS risk_score FROM rl GROUP BY 1),
 rq AS (SELECT *, CASE WHEN risk_score>=80 THEN 'HIGH' WHEN risk_score>=60 THEN 'MEDIUM' ELSE 'LOW' END AS queue_priority, row_number() OVER (ORDER BY risk_score DESC, last_alert_at DESC, case_id) AS queue_rank FROM rc)"""


def _rule_evidence(spark, sf_dir):
    """The rules' hits with their alerts: a layer that the queue, the marts and their views share."""
    return layer(spark, f"{sf_dir}/events.parquet", "rule-evidence", lambda: _made_rule_evidence(spark, sf_dir))


def _made_rule_evidence(spark, sf_dir):
    hit = _v1(spark, sf_dir, transaction_layer(spark, sf_dir)).select(F.col("Sender_account").alias("account"), "ts", "tx_id", "Amount", F.explode(F.array(*(F.when(F.col(n) == 1, F.lit(n)) for n in _NAMES))).alias("scenario_id"))
    return A.rule_alert_links(hit.where("scenario_id IS NOT NULL"), {"SCN_FAN_OUT": 3}, 2)


def _rule_links(spark, sf_dir):
    return A.rule_case_links(A.rule_alerts(_rule_evidence(spark, sf_dir)), 7)


def _queue(spark, sf_dir):
    return A.rule_queue(_rule_links(spark, sf_dir), {n: D.V1[n][0] for n in _NAMES})


_QUEUE = ("case_id", "subject_id", "alert_count", "scenario_count", "transaction_count", "policy_flag", "last_alert_at", "scenarios", "risk_score", "queue_priority", "queue_rank")


@_query(_RULES + " SELECT " + ", ".join(_QUEUE) + " FROM rq")
def c6_rule_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select(*_QUEUE)


@_query(_RULES + " SELECT case_id, queue_rank FROM rq WHERE queue_priority IN ('HIGH','MEDIUM') AND scenario_count>1 ORDER BY queue_rank LIMIT 50")
def c9_queue_view(spark, sf_dir):
    return A.queue_view(_queue(spark, sf_dir), ("HIGH", "MEDIUM"), several=True).select("case_id", "queue_rank")


@_query(_RULES + " SELECT p AS queue_priority, count(rq.case_id) AS n FROM (SELECT unnest(['HIGH','MEDIUM','LOW']) AS p) LEFT JOIN rq ON queue_priority=p GROUP BY 1")
def a43_priority_counts(spark, sf_dir):
    return A.priority_counts(_queue(spark, sf_dir))


@_query(_RULES + " SELECT scenario_id, count(*) AS alerts, CAST(sum(n) AS BIGINT) AS triggering_transactions, count(DISTINCT acc) AS accounts FROM ra GROUP BY 1")
def a34_scenario_rollup(spark, sf_dir):
    return A.scenario_rollup(_rule_links(spark, sf_dir))


@_query(_RULES + " SELECT case_id, CAST(started AS DATE) AS day, scenario_id, count(*) AS alerts FROM rl GROUP BY 1,2,3")
def a37_timeline(spark, sf_dir):
    return A.timeline(_rule_links(spark, sf_dir))


@_query(_F + _SESS + _CASE + _MART + " SELECT case_id, Sender_bank_location || ' → ' || Receiver_bank_location AS route, count(*) AS n, sum(Amount) AS amount FROM m WHERE Cross_border=1 GROUP BY 1,2")
def a36_routes(spark, sf_dir):
    return A.routes(_mart(spark, sf_dir))


@_query(_RULES + " SELECT rl.case_id, alert_id, scenario_id, CAST(n AS BIGINT) AS transaction_count FROM rl JOIN rq USING (case_id)")
def c8_case_alerts(spark, sf_dir):
    """Drill-down into the alerts of the cases of the queue."""
    linked = _rule_links(spark, sf_dir)
    return A.case_alerts(linked, A.rule_queue(linked, {n: D.V1[n][0] for n in _NAMES})).select("case_id", "alert_id", "scenario_id", "transaction_count")


_SMURF = """, res AS (SELECT g.*, CAST(coalesce(sum(dt),0) AS BIGINT) AS triggered, CAST(coalesce(sum(da),0) AS BIGINT) AS aml_hits, CAST(coalesce(sum(dg),0) AS BIGINT) AS target_hits, count(o.n) AS windows,
 round(coalesce(sum(dt),0)/max(t.at),6) AS trigger_rate, round(coalesce(sum(da)/nullif(sum(dt),0),0),6) AS precision, round(coalesce(sum(dg),0)/max(t.ag),6) AS target_recall
 FROM g JOIN (SELECT d, sum(dt) AS at, sum(dg) AS ag FROM o GROUP BY 1) t ON t.d=g.days LEFT JOIN o ON o.d=days AND o.n>=min_n AND o.md<max_median AND o.t>=min_total AND o.u<=3 AND o.r<={0} GROUP BY ALL) SELECT * FROM res"""
_AXES = ", g AS (SELECT * FROM (SELECT unnest({0}) AS days), (SELECT unnest({1}) AS min_n), (SELECT CAST(unnest({2}) AS DOUBLE) AS max_median), (SELECT CAST(unnest({3}) AS DOUBLE) AS min_total))"


def _smurfing_grid(windows, spark, rate, days, counts, medians, totals, snapped=False):
    """``windows``: d, n, md, t, u, r and the dev sums. Those that break the fixed rules count in the totals only.
    ``snapped``: md is the lowest of ``medians`` that the median is under."""
    ok = (F.col("u") <= 3) & (F.col("r") <= rate)
    c = P.cells(windows, cell_days=F.col("d"), cell_n=F.when(ok, P.at_least("n", counts)), cell_median=F.col("md") if snapped else P.below("md", medians), cell_total=P.at_least("t", totals))
    g = P.grid(spark, days=days, min_n=counts, max_median=medians, min_total=totals)
    g = g.select(*(F.col(k).cast("int").alias(k) for k in ("days", "min_n")), "max_median", "min_total")
    return P.evaluate_grid(c, g, (F.col("cell_n") >= F.col("min_n")) & (F.col("cell_median") <= F.col("max_median")) & (F.col("cell_total") >= F.col("min_total")), per="days")


_G1 = ((60,), (5, 8, 10, 12), (3_000.0, 4_000.0, 5_000.0), (15_000.0, 25_000.0, 40_000.0))
_G3 = ((60, 90, 120), (3, 5, 8, 10), (3_000.0, 4_000.0, 5_000.0, 6_000.0), (10_000.0, 20_000.0, 30_000.0))


@_query(_F + ", o AS (SELECT 60 AS d, time_bucket(INTERVAL '60 days', ts, TIMESTAMP '1970-01-01') AS bk, Sender_account, count(*) AS n, quantile_cont(Amount,0.5) AS md, sum(Amount) AS t, count(DISTINCT Receiver_account) AS u, greatest(avg(Cross_border),avg(Currency_mismatch)) AS r, count(*) AS dt, sum(Is_laundering) AS da, sum(CAST(Laundering_type='Smurfing' AS INT)) AS dg FROM f GROUP BY 1,2,3)" + _AXES.format(*map(list, _G1)) + _SMURF.format("0.10"))
def g1_smurfing_period_grid(spark, sf_dir):
    b = _features(spark, sf_dir).groupBy(F.lit(60).alias("d"), W.epoch_bucket(F.col("ts"), 60).alias("bucket"), "Sender_account").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("Amount", 0.5).alias("md"), F.sum("Amount").alias("t"), F.countDistinct("Receiver_account").alias("u"), F.greatest(F.avg("Cross_border"), F.avg("Currency_mismatch")).alias("r"),
        F.count(F.lit(1)).alias("dev_transactions"), F.sum("Is_laundering").alias("dev_aml"), F.sum((F.col("Laundering_type") == "Smurfing").cast("int")).alias("dev_target"),
    )
    return _smurfing_grid(b, spark, 0.10, *_G1)


@_query(_F + """, b AS (SELECT f.*, d, CAST(floor((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-15'))/(d*86400000000.0)) AS BIGINT) AS bucket FROM f, (SELECT unnest([60,90,120]) AS d)),
 nw AS (SELECT *, CAST(row_number() OVER (PARTITION BY d, Sender_account, bucket, Receiver_account ORDER BY ts, tx_id)=1 AS INT) AS isnew FROM b),
 rr AS (SELECT d, ts, Is_laundering, Laundering_type, count(*) OVER w AS n, quantile_cont(Amount,0.5) OVER w AS md, sum(Amount) OVER w AS t, sum(isnew) OVER w AS u, greatest(avg(Cross_border) OVER w, avg(Currency_mismatch) OVER w) AS r FROM nw WINDOW w AS (PARTITION BY d, Sender_account, bucket ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING)),
 o AS (SELECT d, n, md, t, u, r, 1 AS dt, Is_laundering AS da, CAST(Laundering_type='Smurfing' AS INT) AS dg FROM rr WHERE ts>=TIMESTAMP '2024-01-15')""" + _AXES.format(*map(list, _G3)) + _SMURF.format("0.15"))
def g3_causal_smurfing_grid(spark, sf_dir):
    """144 settings on features that each row's sender had at that moment; rows before the development start are context."""
    start = F.lit("2024-01-15").cast("timestamp")
    f, rows = _features(spark, sf_dir), None
    for days in _G3[0]:
        r = W.causal_bucket(f, days, start, _G3[2]).where(F.col("ts") >= start).select(
            F.lit(days).alias("d"), "n", F.col("median_amount").alias("md"), F.col("total").alias("t"), F.col("unique_receivers").alias("u"), F.greatest("cross_rate", "fx_rate").alias("r"),
            F.lit(1).alias("dev_transactions"), F.col("Is_laundering").alias("dev_aml"), (F.col("Laundering_type") == "Smurfing").cast("int").alias("dev_target"),
        )
        rows = r if rows is None else rows.unionByName(r)
    return _smurfing_grid(rows, spark, 0.15, *_G3, snapped=True)
