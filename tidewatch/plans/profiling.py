"""Queries of profiles, samples, evaluation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A, audit, evaluation as E, features as W, profiles as P, scenarios as D
from ..sources.tables import transactions
from .registry import _CUM, _F, _FAN, _FLAGS, _H, _SPLIT, _V1, _features, _ml, _query, _v1

_CATEGORIES = ["Payment_type", "Payment_currency", "Received_currency", "Sender_bank_location", "Receiver_bank_location"]


@_query(" SELECT Is_laundering, Laundering_type, count(*) AS n, round(100*count(*)/sum(count(*)) OVER (),6) AS percent FROM tx GROUP BY 1,2")
def a2_class_distribution(spark, sf_dir):
    return P.class_distribution(transactions(spark, sf_dir), "Is_laundering", "Laundering_type")


@_query(", d AS (SELECT Laundering_type, unnest([" + ",".join(f"{{'d':'{c}','v':{c}}}" for c in _CATEGORIES) + "]) AS x FROM tx) SELECT Laundering_type, x.d AS dimension, x.v AS value, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY Laundering_type, x.d),6) AS share FROM d GROUP BY 1,2,3")
def a4_category_profile(spark, sf_dir):
    return P.category_profile(transactions(spark, sf_dir), _CATEGORIES)


_SUMMARY = " SELECT {0}, count(*) AS n, round(avg(Amount),6) AS mean, round(avg(Cross_border),6) AS cross_rate, round(avg(Currency_mismatch),6) AS fx_rate, count(DISTINCT Sender_account) AS senders, count(DISTINCT Receiver_account) AS receivers, {1} FROM {2} GROUP BY 1"
_POP = _F + ", pop AS (SELECT *, CASE WHEN Laundering_type IN ('Smurfing','Structuring') THEN Laundering_type ELSE 'Normal_Sub_10k' END AS Pattern FROM f WHERE Laundering_type IN ('Smurfing','Structuring') OR (Is_laundering=0 AND Amount<10000))"


def _q(*at):
    return ", ".join(f"round(quantile_cont(Amount,{q}),6) AS p{int(q * 100)}" for q in at)


@_query(_F + _SUMMARY.format("Laundering_type", _q(0.5, 0.95), "f WHERE contains(Laundering_type,'Fan')"))
def a6_fan_summary(spark, sf_dir):
    return P.amount_summary(_features(spark, sf_dir).where(F.col("Laundering_type").isin(*_FAN)), "Laundering_type", (0.5, 0.95))


@_query(_POP + _SUMMARY.format("Pattern", _q(0.25, 0.5, 0.75, 0.95), "pop"))
def a9_structuring_summary(spark, sf_dir):
    return P.amount_summary(P.structuring_population(_features(spark, sf_dir)), "Pattern")


_SENDERS = ", s AS (SELECT Pattern, Sender_account, count(*) AS n, sum(Amount) AS total, count(DISTINCT Receiver_account) AS receivers, round((epoch_us(max(ts))-epoch_us(min(ts)))/3.6e9,6) AS hours FROM pop GROUP BY 1,2)"


@_query(_POP + _SENDERS + " SELECT * FROM s")
def a10_structuring_senders(spark, sf_dir):
    return P.sender_summary(P.structuring_population(_features(spark, sf_dir)))


@_query(_POP + _SENDERS + " SELECT Pattern, count(*) AS accounts, " + ", ".join(f"round(quantile_cont({m},{q}),6) AS {m}_{n}" for m in ("n", "total", "receivers", "hours") for n, q in (("median", 0.5), ("p95", 0.95))) + " FROM s GROUP BY 1")
def a10_structuring_sender_summary(spark, sf_dir):
    return P.summarised(P.sender_summary(P.structuring_population(_features(spark, sf_dir))), "Pattern", ["n", "total", "receivers", "hours"])


@_query(_F + " SELECT date_trunc('day',ts)::TIMESTAMP AS bucket, Sender_account, count(*) AS n, sum(Amount) AS total, round(quantile_cont(Amount,0.5),6) AS median_amount, round(quantile_cont(Amount,0.95),6) AS p95_amount, count(DISTINCT Receiver_account) AS unique_others, (epoch_us(max(ts))-epoch_us(min(ts)))/86400e6 AS duration_days FROM f GROUP BY 1,2")
def a12_sender_days(spark, sf_dir):
    b = W.bucket_features(_features(spark, sf_dir), "Sender_account", "Receiver_account", F.date_trunc("day", "ts"))
    return b.select("bucket", "Sender_account", "n", "total", *(F.round(c, 6).alias(c) for c in ("median_amount", "p95_amount")), "unique_others", ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(86_400e6)).alias("duration_days"))


@_query(_F + """, e AS (SELECT 'RULE' AS engine, CAST(Amount>=20000 AS INT) AS p, Is_laundering AS y FROM f UNION ALL SELECT 'ML', CAST(ml AS INT), Is_laundering FROM f),
 c AS (SELECT engine, count(*) AS n, CAST(sum(p) AS BIGINT) AS alerts, CAST(sum(p*y) AS BIGINT) AS tp, CAST(sum(y) AS BIGINT) AS pos FROM e GROUP BY 1)
 SELECT engine, alerts, tp, alerts-tp AS fp, pos-tp AS fn, n-alerts-pos+tp AS tn, round(coalesce(tp/nullif(alerts,0),0),6) AS precision, round(coalesce(tp/nullif(pos,0),0),6) AS recall, round(coalesce(2*tp/nullif(alerts+pos,0),0),6) AS f1, round(alerts/n,6) AS alert_rate FROM c""")
def a25_rule_against_ml(spark, sf_dir):
    rows = _ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int"))
    return E.binary_metrics(rows, "RULE", "RULE").unionByName(E.binary_metrics(rows, "ML_ALERT", "ML"))


@_query(_F + """, c AS (SELECT Is_laundering AS y, CAST(ml AS INT) AS p FROM f), k AS (SELECT unnest([0,1]) AS class),
 r AS (SELECT class, CAST(sum(CAST(y=class AS INT)) AS BIGINT) AS support, sum(CAST(p=class AS INT)) AS got, sum(CAST(p=class AND y=class AS INT)) AS tp FROM c, k GROUP BY 1)
 SELECT class, support, round(coalesce(tp/nullif(got,0),0),6) AS precision, round(coalesce(tp/nullif(support,0),0),6) AS recall, round(coalesce(2*tp/nullif(got+support,0),0),6) AS f1, round(sum(tp) OVER ()/sum(support) OVER (),6) AS accuracy FROM r""")
def a26_classification_report(spark, sf_dir):
    return E.classification_report(_ml(spark, sf_dir), "ML_ALERT")


@_query(_F + " SELECT count(*) AS transactions, CAST(sum(CAST(ml AS INT)) AS BIGINT) AS alerts, CAST(sum(Is_laundering) AS BIGINT) AS positives, CAST(sum(CAST(ml AS INT)*Is_laundering) AS BIGINT) AS hits, round(sum(CAST(ml AS INT))/count(*),6) AS alert_rate, round(sum(CAST(ml AS INT)*Is_laundering)/sum(CAST(ml AS INT)),6) AS precision, round(sum(CAST(ml AS INT)*Is_laundering)/sum(Is_laundering),6) AS recall, round(1-sum(CAST(ml AS INT))/sum(CAST(Amount>=20000 AS INT)),6) AS workload_reduction FROM f")
def a40_indicators(spark, sf_dir):
    return E.indicators(_ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int")), "ML_ALERT", "RULE")


@_query(" , n AS (SELECT unnest([{'c':'Amount','v':Amount},{'c':'ml_probability','v':ml_probability}]) AS x FROM tx) SELECT x.c AS \"column\", count(x.v) AS n, round(avg(x.v),6) AS mean, round(stddev_samp(x.v),4) AS std, min(x.v) AS min, " + ", ".join(f"round(quantile_cont(x.v,{q}),6) AS p{int(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + ", max(x.v) AS max FROM n GROUP BY 1")
def a42_describe(spark, sf_dir):
    return P.described(transactions(spark, sf_dir), ["Amount", "ml_probability"])


@_query(_F + " SELECT Cross_border, count(*) AS n, round(avg(Is_laundering),6) AS aml_rate FROM f GROUP BY 1")
def a45_aml_by_border(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("Cross_border").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("Is_laundering"), 6).alias("aml_rate"))


@_query(_CUM + " SELECT round(sum(n-p)/sum(p),6) AS weight FROM k")
def a46_class_weight(spark, sf_dir):
    return transactions(spark, sf_dir).agg(F.round(F.sum(1 - F.col("Is_laundering")) / F.sum("Is_laundering"), 6).alias("weight"))


@_query(_SPLIT + " SELECT e1 AS train_end, e2 AS development_end FROM b")
def w13_split_days(spark, sf_dir):
    return P.boundaries(P.daily(transactions(spark, sf_dir)))


@_query(" SELECT CAST(Is_laundering AS INT) AS Is_laundering, CAST(sum(least(n, CASE Is_laundering WHEN 1 THEN 25 ELSE 100 END)) AS BIGINT) AS n FROM (SELECT event_id // 250 AS b, Is_laundering, count(*) AS n FROM (SELECT tx_id AS event_id, Is_laundering FROM tx) GROUP BY 1,2) GROUP BY 1")
def k1_block_sample_counts(spark, sf_dir):
    """Rows that the seeded sample keeps of each class: at most 100 normal and 25 labelled ones in each block of ids."""
    return P.block_sample(transactions(spark, sf_dir), 250, {0: 100, 1: 25}).groupBy("Is_laundering").agg(F.count(F.lit(1)).alias("n"))


@_query(", h AS (SELECT Is_laundering, row_number() OVER (PARTITION BY Is_laundering ORDER BY md5('42|' || Is_laundering || '|' || tx_id)) AS nth, count(*) OVER (PARTITION BY Is_laundering) AS c FROM tx) SELECT Is_laundering, CASE WHEN nth<=floor(0.2*c+0.5) THEN 'test' ELSE 'train' END AS fold, count(*) AS n FROM h GROUP BY 1,2")
def k3_stratified_split(spark, sf_dir):
    """Rows per class and fold."""
    return P.stratified_split(transactions(spark, sf_dir)).groupBy("Is_laundering", "fold").agg(F.count(F.lit(1)).alias("n"))


@_query(", h AS (SELECT tx_id, row_number() OVER (PARTITION BY Is_laundering ORDER BY md5('7|' || Is_laundering || '|' || tx_id)) AS nth, count(*) OVER (PARTITION BY Is_laundering) AS c FROM tx) SELECT tx_id FROM h WHERE nth<=floor(0.35*c+0.5)")
def k3_test_fold(spark, sf_dir):
    """The ids of a test fold of 35 % of each class."""
    return P.stratified_split(transactions(spark, sf_dir), 0.35, 7).where("fold = 'test'").select("tx_id")


@_query(_F + _H + _FLAGS + ", u AS (SELECT Laundering_type, greatest(" + ",".join(_V1) + ") AS hit, CAST(ml AS INT) AS m, Is_laundering AS y, Sender_account AS a FROM v) SELECT CAST(sum(hit) AS BIGINT) AS triggered, CAST(sum(hit*y) AS BIGINT) AS hits, count(DISTINCT CASE WHEN hit=1 THEN a END) AS triggered_accounts, count(DISTINCT CASE WHEN y=1 THEN a END) AS target_accounts, count(DISTINCT CASE WHEN hit*y=1 THEN a END) AS hit_accounts, round(coalesce(count(DISTINCT CASE WHEN hit*y=1 THEN a END)/nullif(count(DISTINCT CASE WHEN y=1 THEN a END),0),0),6) AS account_recall FROM u")
def a20_account_recall(spark, sf_dir):
    rows = _v1(spark, sf_dir).withColumn("hit", F.greatest(*D.V1))
    return E.account_recall(rows, "hit")


@_query(_F + _H + _FLAGS + " SELECT CAST(sum(SCN_FAN_OUT) AS BIGINT) AS a, CAST(sum(SCN_FAN_IN) AS BIGINT) AS b, CAST(sum(SCN_FAN_OUT*SCN_FAN_IN) AS BIGINT) AS both, CAST(sum(greatest(SCN_FAN_OUT,SCN_FAN_IN)) AS BIGINT) AS either, CAST(sum(greatest(SCN_FAN_OUT,SCN_FAN_IN)*Is_laundering) AS BIGINT) AS hits FROM v")
def a22_combined(spark, sf_dir):
    return E.combined(_v1(spark, sf_dir), "SCN_FAN_OUT", "SCN_FAN_IN")


_EV = """, ev AS (SELECT CASE WHEN tx_id%61=0 THEN NULL WHEN tx_id%59=0 THEN 7 ELSE tx_id END AS tx_id, CASE WHEN tx_id%43=0 THEN NULL WHEN tx_id%47=0 THEN 3 ELSE Is_laundering END AS y, CASE WHEN tx_id%41=0 THEN NULL WHEN tx_id%31=0 THEN ml_probability+2 ELSE ml_probability END AS p, CAST(ml AS INT) AS a FROM f)"""


@_query(_F + _EV + """ SELECT 'null_transaction_id' AS "check", count(*)-count(tx_id) AS n_bad FROM ev UNION ALL SELECT 'null_label', count(*)-count(y) FROM ev UNION ALL SELECT 'null_probability', count(*)-count(p) FROM ev UNION ALL SELECT 'label_not_binary', count(*) FROM ev WHERE y NOT IN (0,1)
 UNION ALL SELECT 'probability_out_of_range', count(*) FROM ev WHERE p NOT BETWEEN 0 AND 1 UNION ALL SELECT 'flag_against_threshold', count(*) FROM ev WHERE a<>CAST(p>=0.653366 AS INT) UNION ALL SELECT 'repeated_transaction_id', count(*) FROM (SELECT tx_id FROM ev WHERE tx_id IS NOT NULL GROUP BY 1 HAVING count(*)>1)""")
def c12_evidence_audit(spark, sf_dir):
    """The audit on evidence with nulls, repeated ids, labels and scores out of range, by the rows' ids."""
    x, k = _ml(spark, sf_dir), F.col("tx_id")
    return audit.evidence(x.select(
        F.when(k % 61 == 0, F.lit(None)).when(k % 59 == 0, 7).otherwise(k).alias("tx_id"), F.when(k % 43 == 0, F.lit(None)).when(k % 47 == 0, 3).otherwise(F.col("Is_laundering")).alias("Is_laundering"),
        F.when(k % 41 == 0, F.lit(None)).when(k % 31 == 0, F.col("ml_probability") + 2).otherwise(F.col("ml_probability")).alias("ml_probability"), "ML_ALERT",
    ), A.THRESHOLD)


@_query(" SELECT 'unparseable_dates' AS \"check\", CAST(0 AS BIGINT) AS n_bad UNION ALL SELECT 'empty_periods', CAST(0 AS BIGINT)")
def c14_temporal_contract(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return audit.temporal(tx, P.with_split(tx, P.boundaries(P.daily(tx))))
