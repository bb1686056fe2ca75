"""All queries of the surveillance engine by name, and the SQL that states their results.

Every query derives its transactions from the whole ``events`` table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts as A, evaluation as E, features as W, network as N, profiles as P, scenarios as D
from ..operators.scans import hot_among
from ..sources.tables import transactions, written

_TX = """tx AS (SELECT event_id AS tx_id, strftime(ts,'%Y-%m-%d') AS Date, strftime(ts,'%H:%M:%S') AS Time, date_trunc('second',ts) AS ts, s AS Sender_account, r AS Receiver_account,
 CAST(CAST(round(value*100) AS BIGINT) AS DOUBLE)*CAST(2.5 AS DOUBLE) AS Amount,
 CASE WHEN s%10<7 THEN 'UK pounds' WHEN s%10=7 THEN 'US dollar' WHEN s%10=8 THEN 'Dirham' ELSE 'Turkish lira' END AS Payment_currency,
 CASE WHEN r%10<7 THEN 'UK pounds' WHEN r%10=7 THEN 'US dollar' WHEN r%10=8 THEN 'Dirham' ELSE 'Turkish lira' END AS Received_currency,
 CASE WHEN s%10<7 THEN 'UK' WHEN s%10=7 THEN 'USA' WHEN s%10=8 THEN 'UAE' ELSE 'Turkey' END AS Sender_bank_location,
 CASE WHEN r%10<7 THEN 'UK' WHEN r%10=7 THEN 'USA' WHEN r%10=8 THEN 'UAE' ELSE 'Turkey' END AS Receiver_bank_location,
 CASE event_type WHEN 'purchase' THEN 'Cash Deposit' WHEN 'signup' THEN 'Cash Withdrawal' WHEN 'error' THEN 'Cross-border' WHEN 'view' THEN 'ACH' ELSE 'Credit card' END AS Payment_type,
 CASE WHEN event_id%37=0 THEN 1 ELSE 0 END AS Is_laundering,
 CASE WHEN event_id%37=0 THEN CASE (event_id // 37)%6 WHEN 0 THEN 'Smurfing' WHEN 1 THEN 'Structuring' WHEN 2 THEN 'Fan_In' WHEN 3 THEN 'Fan_Out' WHEN 4 THEN 'Layered_Fan_In' ELSE 'Layered_Fan_Out' END
      ELSE CASE event_id%4 WHEN 0 THEN 'Normal_Fan_In' WHEN 1 THEN 'Normal_Fan_Out' WHEN 2 THEN 'Normal_Small_Fan_In' ELSE 'Normal_Small_Fan_Out' END END AS Laundering_type,
 CAST((event_id*7919)%10007 + CASE WHEN event_id%37=0 THEN 3000 ELSE 0 END AS DOUBLE)/CAST(13006 AS DOUBLE) AS ml_probability
 FROM (SELECT e.*, user_id AS s, (user_id*7 + CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT)%12)%m.n AS r FROM events e CROSS JOIN (SELECT max(user_id)+1 AS n FROM events) m) x)"""
_F = """, f AS (SELECT *, CAST(Sender_bank_location<>Receiver_bank_location AS INT) AS Cross_border, CAST(Payment_currency<>Received_currency AS INT) AS Currency_mismatch,
 hour(ts) AS Hour, CAST(isodow(ts)-1 AS INT) AS Day_of_week, CAST(isodow(ts)>=6 AS INT) AS Is_weekend, CAST(hour(ts) BETWEEN 0 AND 5 AS INT) AS Is_night,
 ml_probability>=0.653366 AS ml, Payment_type IN ('Cash Withdrawal','Cash Deposit') AS cash FROM tx)"""
_RISK = "CASE {0} WHEN 'UK' THEN 3.0 WHEN 'USA' THEN 4.0 WHEN 'UAE' THEN 7.5 ELSE 7.0 END"
_H = f""", h AS (SELECT *, greatest({_RISK.format('Sender_bank_location')}, {_RISK.format('Receiver_bank_location')}) AS risk, CAST('UAE' IN (Sender_bank_location, Receiver_bank_location) AS INT) AS sanction,
 count(*) OVER sb AS spc, coalesce(sum(Amount) OVER sb, 0) AS spa, coalesce(epoch(ts) - epoch(lag(ts) OVER so), -1) AS gap,
 count(*) OVER rb AS rpc, coalesce(sum(Amount) OVER rb, 0) AS rpa, coalesce(epoch(ts) - epoch(lag(ts) OVER ro), -1) AS rgap,
 count(*) OVER sw AS swc, coalesce(sum(Amount) OVER sw, 0) AS swa, count(DISTINCT Receiver_account) OVER sw AS swu,
 count(*) OVER rw AS rwc, coalesce(sum(Amount) OVER rw, 0) AS rwa, count(DISTINCT Sender_account) OVER rw AS rwu FROM f
 WINDOW so AS (PARTITION BY Sender_account ORDER BY ts, tx_id), ro AS (PARTITION BY Receiver_account ORDER BY ts, tx_id),
 sb AS (PARTITION BY Sender_account ORDER BY ts, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rb AS (PARTITION BY Receiver_account ORDER BY ts, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 sw AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND INTERVAL 1 SECOND PRECEDING), rw AS (PARTITION BY Receiver_account ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND INTERVAL 1 SECOND PRECEDING))"""
_V1 = {
    "SCN_SINGLE_LARGE": "Amount>=50000", "SCN_HIGH_RISK_GEOGRAPHY": "risk>=7", "SCN_SANCTIONED_GEOGRAPHY": "sanction=1", "SCN_CROSS_BORDER_CURRENCY_MISMATCH": "Cross_border=1 AND Currency_mismatch=1",
    "SCN_RAPID_REPEAT_ACTIVITY": "gap BETWEEN 0 AND 3600", "SCN_HIGH_VELOCITY": "spc>=10", "SCN_UNUSUAL_AMOUNT": "spc>0 AND spa>0 AND Amount>=3*(spa/spc)",
    "SCN_STRUCTURING_PROXY": "Amount<10000 AND spc>=5 AND gap BETWEEN 0 AND 3600", "SCN_FAN_ACTIVITY_PROXY": "spc>=8", "SCN_STRUCTURING_ROLLING": "Amount<10000 AND swc>=5 AND swa>=20000",
    "SCN_FAN_OUT": "swu>=5 AND swc>=5", "SCN_FAN_IN": "rwu>=5 AND rwc>=5",
}
_FLAGS = ", v AS (SELECT *, " + ", ".join(f"CAST(({c}) AS INT) AS {k}" for k, c in _V1.items()) + " FROM h)"
#: Weights and labels (fixed values), written out: the SQL doesn't take them from the operators.
_LABELS = (
    ("SCN_SINGLE_LARGE", 60, "Single large transaction"), ("SCN_HIGH_RISK_GEOGRAPHY", 40, "High-risk geography"), ("SCN_SANCTIONED_GEOGRAPHY", 80, "Sanctioned-jurisdiction exposure"),
    ("SCN_CROSS_BORDER_CURRENCY_MISMATCH", 30, "Cross-border currency mismatch"), ("SCN_RAPID_REPEAT_ACTIVITY", 40, "Rapid repeat sender activity"), ("SCN_HIGH_VELOCITY", 45, "High sender transaction velocity"),
    ("SCN_UNUSUAL_AMOUNT", 50, "Amount materially above sender history"), ("SCN_STRUCTURING_PROXY", 50, "Potential structuring pattern"), ("SCN_FAN_ACTIVITY_PROXY", 35, "Potential fan activity"),
    ("SCN_STRUCTURING_ROLLING", 60, "Rolling-window structuring pattern"), ("SCN_FAN_OUT", 60, "Multiple outgoing counterparties"), ("SCN_FAN_IN", 60, "Multiple incoming counterparties"),
)
_SCORED = ", w AS (SELECT *, " + "+".join(k for k, _, _ in _LABELS) + " AS Scenario_count, least(" + "+".join(f"{w}*{k}" for k, w, _ in _LABELS) + ", 100) AS Scenario_score, concat_ws('; ', " + ", ".join(f"CASE WHEN {k}=1 THEN '{t}' END" for k, _, t in _LABELS) + ") AS Alert_reasons FROM v)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    """Registers a query under its name; ``sql`` follows the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {_TX}{sql}"
        return f

    return add


def _features(spark, sf_dir):
    return S.row_features(transactions(spark, sf_dir))


def _lean(f, *names):
    """The columns that sums over moving spans need, and ``names``: such sums carry all of a row through their sorts and workers."""
    return f.select(*names, "ts", "Sender_account", "Receiver_account", "Amount", "Cross_border", "Currency_mismatch")


def _ml(spark, sf_dir):
    return _features(spark, sf_dir).withColumn("ML_ALERT", (F.col("ml_probability") >= A.THRESHOLD).cast("int"))


def _v1(spark, sf_dir, tx=None):
    tx = transactions(spark, sf_dir) if tx is None else tx
    among = hot_among(tx, W.ACCOUNTS)  # counted once, on the plain rows
    risk = S.with_country_risk(S.row_features(tx), S.country_dimension(spark))
    return D.apply_v1(W.rolling(W.history(risk, among=among), among=among))


@_query(" SELECT * EXCLUDE (Date, Time) FROM tx")
def s1_transactions(spark, sf_dir):
    return transactions(spark, sf_dir).drop("Date", "Time")


@_query(_F + " SELECT tx_id, Hour, Day_of_week, Is_weekend, Is_night, Cross_border, Currency_mismatch, round(ln(1+Amount),6) AS Log_amount FROM f")
def p4_row_features(spark, sf_dir):
    return _features(spark, sf_dir).select("tx_id", "Hour", "Day_of_week", "Is_weekend", "Is_night", "Cross_border", "Currency_mismatch", F.round("Log_amount", 6).alias("Log_amount"))


@_query(" SELECT tx_id, ts AS parsed FROM tx")
def p1_timestamps(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", S.timestamp_of(F.col("Date"), F.col("Time")).alias("parsed"))


_SEM = ("is_cash_withdrawal", "is_cash_deposit", "is_cash_transaction", "is_account_transfer", "is_cross_border_transfer", "flow_type", "initiating_account", "counterparty_account", "has_true_sender_receiver", "counterparty_applicable", "geo_pair_applicable", "currency_pair_applicable", "network_eligible", "sender_is_customer", "receiver_is_customer", "transaction_direction", "semantic_direction")


@_query(_F + """ SELECT tx_id, CAST(Payment_type='Cash Withdrawal' AS INT) AS is_cash_withdrawal, CAST(Payment_type='Cash Deposit' AS INT) AS is_cash_deposit, CAST(cash AS INT) AS is_cash_transaction, CAST(NOT cash AS INT) AS is_account_transfer, CAST(Payment_type='Cross-border' AS INT) AS is_cross_border_transfer,
 CASE Payment_type WHEN 'Cash Withdrawal' THEN 'CASH_WITHDRAWAL' WHEN 'Cash Deposit' THEN 'CASH_DEPOSIT' ELSE 'ACCOUNT_TRANSFER' END AS flow_type, CASE WHEN Payment_type='Cash Deposit' THEN Receiver_account ELSE Sender_account END AS initiating_account, CASE WHEN NOT cash THEN Receiver_account END AS counterparty_account,
 CAST(NOT cash AS INT) AS has_true_sender_receiver, CAST(NOT cash AS INT) AS counterparty_applicable, CAST(NOT cash AS INT) AS geo_pair_applicable, CAST(NOT cash AS INT) AS currency_pair_applicable, CAST(NOT cash AS INT) AS network_eligible,
 CAST(Payment_type<>'Cash Deposit' AS INT) AS sender_is_customer, CAST(Payment_type<>'Cash Withdrawal' AS INT) AS receiver_is_customer,
 CASE Payment_type WHEN 'Cash Withdrawal' THEN 'CASH_OUT' WHEN 'Cash Deposit' THEN 'CASH_IN' ELSE 'OUTBOUND' END AS transaction_direction, CASE Payment_type WHEN 'Cash Withdrawal' THEN 'ACCOUNT → CASH' WHEN 'Cash Deposit' THEN 'CASH → ACCOUNT' ELSE 'SENDER → RECEIVER' END AS semantic_direction FROM f""")  # fmt: skip
def p13_semantics(spark, sf_dir):
    return S.semantics(transactions(spark, sf_dir)).select("tx_id", *_SEM)


@_query(_F + _H + f" SELECT tx_id, risk AS Max_country_risk, CAST(abs({_RISK.format('Sender_bank_location')}-{_RISK.format('Receiver_bank_location')}) AS DOUBLE) AS Risk_difference, sanction AS Any_sanctioned, CASE Sender_bank_location WHEN 'UK' THEN 'GB' WHEN 'USA' THEN 'US' WHEN 'UAE' THEN 'AE' ELSE 'TR' END AS Sender_iso2, CASE Receiver_bank_location WHEN 'UK' THEN 'GBR' WHEN 'USA' THEN 'USA' WHEN 'UAE' THEN 'ARE' ELSE 'TUR' END AS Receiver_iso3 FROM h")
def j1_country_risk(spark, sf_dir):
    return S.with_country_risk(transactions(spark, sf_dir), S.country_dimension(spark)).select("tx_id", "Max_country_risk", "Risk_difference", "Any_sanctioned", "Sender_iso2", "Receiver_iso3")


@_query(_F + _H + " SELECT tx_id, spc AS Sender_prior_count, spa AS Sender_prior_amount, CAST(gap AS DOUBLE) AS Sender_gap, round(CASE WHEN spc>0 THEN spa/spc ELSE 0 END,6) AS Sender_prior_average, rpc AS Receiver_prior_count, rpa AS Receiver_prior_amount, CAST(rgap AS DOUBLE) AS Receiver_gap FROM h")
def w1_history(spark, sf_dir):
    return W.history(transactions(spark, sf_dir)).select("tx_id", "Sender_prior_count", "Sender_prior_amount", "Sender_gap", F.round("Sender_prior_average", 6).alias("Sender_prior_average"), "Receiver_prior_count", "Receiver_prior_amount", "Receiver_gap")


@_query(_F + _H + " SELECT tx_id, swc AS Sender_window_count, swa AS Sender_window_amount, CAST(swu AS INT) AS Sender_window_unique, rwc AS Receiver_window_count, rwa AS Receiver_window_amount, CAST(rwu AS INT) AS Receiver_window_unique FROM h")
def w5_rolling(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("tx_id", "ts", "Sender_account", "Receiver_account", "Amount")
    return W.rolling(tx).select("tx_id", *(f"{s}_window_{c}" for s in ("Sender", "Receiver") for c in ("count", "amount", "unique")))


_SLIDE = """ SELECT tx_id, count(*) OVER w AS n, sum(Amount) OVER w AS total, quantile_cont(Amount, 0.5) OVER w AS median_amount, CAST(count(DISTINCT Receiver_account) OVER w AS INT) AS unique_receivers, round(avg(Cross_border) OVER w,6) AS cross_rate FROM f
 WINDOW w AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL {0} DAYS PRECEDING AND CURRENT ROW)"""


@_query(_F + _SLIDE.format(21))
def w8_sliding(spark, sf_dir):
    return W.sliding(_lean(_features(spark, sf_dir), "tx_id"), 21).select("tx_id", "n", "total", "median_amount", "unique_receivers", F.round("cross_rate", 6).alias("cross_rate"))


@_query(_F + """ , b AS (SELECT *, CAST(floor((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-15'))/(10*86400000000.0)) AS BIGINT) AS bucket FROM f),
 g AS (SELECT *, CAST(row_number() OVER (PARTITION BY Sender_account, bucket, Receiver_account ORDER BY ts, tx_id)=1 AS INT) AS isnew FROM b)
 SELECT tx_id, bucket, count(*) OVER w AS n, sum(Amount) OVER w AS total, quantile_cont(Amount,0.5) OVER w AS median_amount, CAST(sum(isnew) OVER w AS BIGINT) AS unique_receivers FROM g WINDOW w AS (PARTITION BY Sender_account, bucket ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def w7_causal_bucket(spark, sf_dir):
    return W.causal_bucket(_features(spark, sf_dir), 10, F.lit("2024-01-15").cast("timestamp")).select("tx_id", "bucket", "n", "total", "median_amount", "unique_receivers")


_BUCKET = """, b AS (SELECT time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01') AS bucket, {0}, count(*) AS n, sum(Amount) AS total, quantile_cont(Amount,0.5) AS median_amount, count(DISTINCT {1}) AS unique_others, avg(Cross_border) AS cross_rate, avg(Currency_mismatch) AS fx_rate FROM f GROUP BY ALL)"""


def _bucket(spark, sf_dir, account, other):
    return W.bucket_features(_features(spark, sf_dir), account, other, W.epoch_bucket(F.col("ts"), 10))


@_query(_F + _BUCKET.format("Sender_account", "Receiver_account") + " SELECT bucket, Sender_account, n, total, round(median_amount,6) AS median_amount, unique_others, round(cross_rate,6) AS cross_rate, round(fx_rate,6) AS fx_rate FROM b")
def a13_sender_buckets(spark, sf_dir):
    b = _bucket(spark, sf_dir, "Sender_account", "Receiver_account")
    return b.select("bucket", "Sender_account", "n", "total", F.round("median_amount", 6).alias("median_amount"), "unique_others", F.round("cross_rate", 6).alias("cross_rate"), F.round("fx_rate", 6).alias("fx_rate"))


@_query(_F + _BUCKET.format("Sender_account", "Receiver_account") + " SELECT bucket, Sender_account, CAST(n>=8 AND median_amount<8000 AND total>=20000 AND unique_others<=12 AS INT) AS smurfing, CAST(unique_others BETWEEN 5 AND 12 AND n BETWEEN 5 AND 20 AND (cross_rate>=0.2 OR fx_rate>=0.25) AS INT) AS fan_out FROM b")
def d15_d17_sender_flags(spark, sf_dir):
    b = _bucket(spark, sf_dir, "Sender_account", "Receiver_account")
    return b.select("bucket", "Sender_account", D.smurfing_bucket(b, 8, 8_000.0, 20_000.0, 12).alias("smurfing"), D.fan_bucket(5, 12, 0.20, 0.25).alias("fan_out"))


@_query(_F + _BUCKET.format("Receiver_account", "Sender_account") + " SELECT bucket, Receiver_account, CAST(unique_others BETWEEN 5 AND 15 AND n BETWEEN 5 AND 20 AND (cross_rate>=0.1 OR fx_rate>=0.2) AS INT) AS fan_in FROM b")
def d18_fan_in(spark, sf_dir):
    b = _bucket(spark, sf_dir, "Receiver_account", "Sender_account")
    return b.select("bucket", "Receiver_account", D.fan_bucket(5, 15, 0.10, 0.20).alias("fan_in"))


@_query(_F + _BUCKET.format("Receiver_account", "Sender_account") + " SELECT f.tx_id, CAST(f.Amount<10000 AND unique_others>=5 AND total>=20000 AND (cross_rate>=0.2 OR fx_rate>=0.25) AS INT) AS structuring FROM f JOIN b ON f.Receiver_account=b.Receiver_account AND time_bucket(INTERVAL '10 days', f.ts, TIMESTAMP '1970-01-01')=b.bucket")
def d16_structuring(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("bucket", W.epoch_bucket(F.col("ts"), 10)).select("tx_id", "Amount", "Receiver_account", "bucket")
    b = _bucket(spark, sf_dir, "Receiver_account", "Sender_account")
    return f.join(b, ["Receiver_account", "bucket"]).select("tx_id", D.structuring_v2().alias("structuring"))


@_query(_F + _H + _FLAGS + _SCORED + " SELECT tx_id, " + ", ".join(_V1) + ", Scenario_count, Scenario_score, Alert_reasons FROM w")
def d1_scenarios(spark, sf_dir):
    return _v1(spark, sf_dir).select("tx_id", *D.V1, "Scenario_count", "Scenario_score", "Alert_reasons")


_UNION = " UNION ALL ".join(f"SELECT '{k}' AS scenario, CAST(sum({k}) AS BIGINT) AS triggered, CAST(sum({k}*Is_laundering) AS BIGINT) AS hits, count(*) AS n, sum(Is_laundering) AS p FROM v" for k in _V1)


@_query(_F + _H + _FLAGS + f" SELECT scenario, triggered, hits, round(triggered/n,6) AS trigger_rate, round(coalesce(hits/nullif(triggered,0),0),6) AS precision, round(coalesce(hits/nullif(p,0),0),6) AS recall FROM ({_UNION})")
def d13_scenario_summary(spark, sf_dir):
    return E.flag_summary(_v1(spark, sf_dir), list(D.V1))


@_query(_F + _H + _FLAGS + " SELECT Laundering_type, count(*) AS n, " + ", ".join(f"round(avg({k}),6) AS {k}" for k in _V1) + ", round(avg(greatest(" + ",".join(_V1) + ")),6) AS any_flag FROM v GROUP BY 1")
def a18_coverage(spark, sf_dir):
    return E.coverage(_v1(spark, sf_dir), list(D.V1))


@_query(_F + """ , g AS (SELECT *, count(*) OVER w AS n, quantile_cont(Amount,0.5) OVER w AS md, sum(Amount) OVER w AS t, count(DISTINCT Receiver_account) OVER w AS u, avg(Cross_border) OVER w AS c, avg(Currency_mismatch) OVER w AS x FROM f WINDOW w AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW))
 SELECT tx_id, CAST(u>=3 AND n BETWEEN 3 AND 12 AND (c>=0.2 OR x>=0.2) AS INT) AS fan_out_12_20, CAST(u>=3 AND n BETWEEN 3 AND 12 AND (c>=0.3 OR x>=0.3) AS INT) AS fan_out_12_30, CAST(u>=3 AND n BETWEEN 3 AND 8 AND (c>=0.3 OR x>=0.3) AS INT) AS fan_out_8_30 FROM g""")  # fmt: skip
def d21_fan_out_variants(spark, sf_dir):
    f = W.sliding(_lean(_features(spark, sf_dir), "tx_id"), 21, median=False)
    return f.select("tx_id", D.fan_out_v3(12, 0.20).alias("fan_out_12_20"), D.fan_out_v3(12, 0.30).alias("fan_out_12_30"), D.fan_out_v3(8, 0.30).alias("fan_out_8_30"))


@_query(" , d AS (SELECT unnest([{'d':'Payment_type','v':Payment_type},{'d':'Payment_currency','v':Payment_currency},{'d':'Sender_bank_location','v':Sender_bank_location},{'d':'Laundering_type','v':Laundering_type}]) AS x FROM tx) SELECT x.d AS dimension, x.v AS value, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY x.d),6) AS share FROM d GROUP BY 1,2")
def a1_value_counts(spark, sf_dir):
    return P.value_counts(transactions(spark, sf_dir), ["Payment_type", "Payment_currency", "Sender_bank_location", "Laundering_type"])


@_query(_F + " SELECT Laundering_type, count(*) AS n, round(avg(Amount),6) AS mean, round(stddev_pop(Amount),4) AS std, min(Amount) AS min, max(Amount) AS max, round(avg(Cross_border),6) AS Cross_border_rate, round(avg(Currency_mismatch),6) AS Currency_mismatch_rate, round(avg(Is_night),6) AS Is_night_rate, round(avg(Is_weekend),6) AS Is_weekend_rate, count(DISTINCT Sender_account) AS senders, count(DISTINCT Receiver_account) AS receivers, " + ", ".join(f"round(quantile_cont(Amount,{q}),6) AS p{int(q * 100)}" for q in P.QUANTILES) + " FROM f GROUP BY 1")
def a3_typology_profile(spark, sf_dir):
    return P.typology_profile(_features(spark, sf_dir))


_FAN = ("Fan_In", "Fan_Out", "Layered_Fan_In", "Layered_Fan_Out", "Normal_Fan_In", "Normal_Fan_Out", "Normal_Small_Fan_In", "Normal_Small_Fan_Out")
_FOCAL = """, a AS (SELECT Laundering_type, CASE WHEN contains(Laundering_type,'Fan_In') THEN Receiver_account ELSE Sender_account END AS focal, count(*) AS n, sum(Amount) AS total, count(DISTINCT CASE WHEN contains(Laundering_type,'Fan_In') THEN Sender_account ELSE Receiver_account END) AS counterparties, round((epoch_us(max(ts))-epoch_us(min(ts)))/3.6e9,6) AS hours FROM tx WHERE contains(Laundering_type,'Fan') GROUP BY 1,2)"""


@_query(_FOCAL + " SELECT * FROM a")
def a7_focal_accounts(spark, sf_dir):
    return P.focal_accounts(transactions(spark, sf_dir), _FAN)


@_query(_FOCAL + " SELECT Laundering_type, count(*) AS accounts, " + ", ".join(f"round(quantile_cont({m},{q}),6) AS {m}_{n}" for m in ("n", "total", "counterparties", "hours") for n, q in (("median", 0.5), ("p95", 0.95))) + " FROM a GROUP BY 1")
def a8_focal_summary(spark, sf_dir):
    return P.summarised(P.focal_accounts(transactions(spark, sf_dir), _FAN), "Laundering_type", ["n", "total", "counterparties", "hours"])


@_query(" SELECT CAST(ts AS DATE) AS day, count(*) AS transactions, CAST(sum(Is_laundering) AS BIGINT) AS aml FROM tx GROUP BY 1")
def a11_daily(spark, sf_dir):
    return P.daily(transactions(spark, sf_dir))


_SPLIT = """, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS t FROM tx GROUP BY 1), c AS (SELECT day, sum(t) OVER (ORDER BY day) AS cum, sum(t) OVER () AS total FROM d),
 b AS (SELECT min(day) FILTER (cum >= CAST(0.6 AS DOUBLE)*total) AS e1, min(day) FILTER (cum >= CAST(0.8 AS DOUBLE)*total) AS e2 FROM c)"""


@_query(_SPLIT + " SELECT CASE WHEN CAST(ts AS DATE)<=e1 THEN 'train' WHEN CAST(ts AS DATE)<=e2 THEN 'development' ELSE 'holdout' END AS split, count(*) AS rows, CAST(sum(Is_laundering) AS BIGINT) AS aml, round(avg(Is_laundering),6) AS aml_rate FROM tx, b GROUP BY 1")
def k4_split_summary(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return P.with_split(tx, P.boundaries(P.daily(tx))).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("Is_laundering").alias("aml"), F.round(F.avg("Is_laundering"), 6).alias("aml_rate"))


_TWICE = """, dd AS (SELECT tx_id, CASE WHEN tx_id%101=0 THEN NULL ELSE Amount END AS Amount, CASE WHEN tx_id%53=0 THEN NULL ELSE Payment_type END AS Payment_type, Is_laundering FROM tx), d2 AS (SELECT * FROM dd UNION ALL SELECT * FROM dd WHERE tx_id%97=0)"""


def _doubled(spark, sf_dir):
    """Transactions with nulls and repeated rows, by their ids."""
    tx = transactions(spark, sf_dir)
    x = tx.select("tx_id", F.when(F.col("tx_id") % 101 != 0, F.col("Amount")).alias("Amount"), F.when(F.col("tx_id") % 53 != 0, F.col("Payment_type")).alias("Payment_type"), "Is_laundering")
    return x.unionByName(x.where("tx_id % 97 = 0"))


@_query(_TWICE + " SELECT 'Amount' AS \"column\", count(*)-count(Amount) AS nulls FROM d2 UNION ALL SELECT 'tx_id', count(*)-count(tx_id) FROM d2 UNION ALL SELECT 'Payment_type', count(*)-count(Payment_type) FROM d2 UNION ALL SELECT 'Is_laundering', count(*)-count(Is_laundering) FROM d2")
def a44_overview(spark, sf_dir):
    return P.overview(_doubled(spark, sf_dir))


@_query(_TWICE + """ SELECT 'nulls' AS part, 'Amount' AS name, CAST(count(*)-count(Amount) AS DOUBLE) AS value FROM d2 UNION ALL SELECT 'nulls', 'tx_id', count(*)-count(tx_id) FROM d2 UNION ALL SELECT 'nulls', 'Payment_type', count(*)-count(Payment_type) FROM d2 UNION ALL SELECT 'nulls', 'Is_laundering', count(*)-count(Is_laundering) FROM d2
 UNION ALL SELECT 'type bigint', 'tx_id', NULL UNION ALL SELECT 'type double', 'Amount', NULL UNION ALL SELECT 'type string', 'Payment_type', NULL UNION ALL SELECT 'type int', 'Is_laundering', NULL
 UNION ALL SELECT 'duplicates', 'rows', count(*)-(SELECT count(*) FROM (SELECT DISTINCT * FROM d2)) FROM d2 UNION ALL SELECT 'class percent', CAST(Is_laundering AS VARCHAR), round(100*count(*)/(SELECT count(*) FROM d2),6) FROM d2 GROUP BY Is_laundering""")
def a44_dataset_overview(spark, sf_dir):
    return P.dataset_overview(_doubled(spark, sf_dir))


@_query(_F + " SELECT 'ML' AS engine, CAST(sum(CAST(ml AS INT)) AS BIGINT) AS alerts, CAST(sum(CAST(ml AS INT)*Is_laundering) AS BIGINT) AS tp, CAST(sum(CAST(ml AS INT)*(1-Is_laundering)) AS BIGINT) AS fp, CAST(sum((1-CAST(ml AS INT))*Is_laundering) AS BIGINT) AS fn, CAST(sum((1-CAST(ml AS INT))*(1-Is_laundering)) AS BIGINT) AS tn, round(sum(CAST(ml AS INT)*Is_laundering)/sum(CAST(ml AS INT)),6) AS precision, round(sum(CAST(ml AS INT)*Is_laundering)/sum(Is_laundering),6) AS recall, round(2*sum(CAST(ml AS INT)*Is_laundering)/(sum(CAST(ml AS INT))+sum(Is_laundering)),6) AS f1, round(avg(CAST(ml AS INT)),6) AS alert_rate FROM f")
def a24_binary_metrics(spark, sf_dir):
    return E.binary_metrics(_ml(spark, sf_dir), "ML_ALERT", "ML")


@_query(" SELECT t AS threshold, CAST(sum(CAST(ml_probability>=t AS INT)) AS BIGINT) AS alerts, CAST(sum(CAST(ml_probability>=t AS INT)*Is_laundering) AS BIGINT) AS tp, CAST(sum(CAST(ml_probability<t AS INT)*Is_laundering) AS BIGINT) AS fn FROM tx, (SELECT unnest([CAST(0.1 AS DOUBLE),0.2,0.3,0.4]) AS t) GROUP BY 1")
def a28_threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(transactions(spark, sf_dir))


_CUM = ", k AS (SELECT ml_probability AS s, count(*) AS n, sum(Is_laundering) AS p FROM tx GROUP BY 1), c AS (SELECT s, n, p, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER () AS nn, sum(p) OVER () AS pp FROM k)"


@_query(_CUM + " SELECT round(sum(p/pp*(cp/cn)),6) AS average_precision, round(sum((n-p)*(cp-p/2))/(max(pp)*(max(nn)-max(pp))),6) AS roc_auc FROM c")
def a27_ranking_metrics(spark, sf_dir):
    return E.ranking_metrics(transactions(spark, sf_dir))


@_query(_CUM + " SELECT r AS target_rate, arg_min(s,cn) AS threshold, CAST(min(cn) AS BIGINT) AS alerts, round(arg_min(cp,cn)/min(cn),6) AS precision, round(arg_min(cp,cn)/max(pp),6) AS recall FROM c, (SELECT unnest([CAST(0.01 AS DOUBLE),0.02,0.05,0.1]) AS r) WHERE cn>=ceil(r*nn) GROUP BY 1")
def a29_operating_points(spark, sf_dir):
    return E.operating_points(transactions(spark, sf_dir))


@_query(" SELECT CAST(greatest(0,least(9,floor(ml_probability*10))) AS INT) AS band, printf('%.1f–%.1f', greatest(0,least(9,floor(ml_probability*10)))/10.0, (greatest(0,least(9,floor(ml_probability*10)))+1)/10.0) AS label, count(*) AS n FROM tx GROUP BY 1,2")
def a39_score_bands(spark, sf_dir):
    return E.score_bands(transactions(spark, sf_dir))


@_query(_F + " SELECT CASE WHEN Amount>=20000 AND ml THEN 'both' WHEN Amount>=20000 THEN 'rule_only' WHEN ml THEN 'ml_only' ELSE 'neither' END AS \"group\", count(*) AS transactions, CAST(sum(Is_laundering) AS BIGINT) AS aml_positives FROM f GROUP BY 1")
def a41_overlap(spark, sf_dir):
    return E.overlap(_ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int")), "RULE", "ML_ALERT")


_SESS = """, z AS (SELECT *, coalesce(epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY Sender_account ORDER BY ts, tx_id)) > 2*86400000000, true) AS nw FROM f WHERE ml),
 q AS (SELECT *, CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY Sender_account ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM z),
 l AS (SELECT 'ALT-ML1A-' || upper(substr(sha1('MLV1|AGG|' || Sender_account || '|' || session),1,16)) AS alert_id, printf('TXN-HO-%010d', tx_id) AS transaction_id, * FROM q),
 al AS (SELECT alert_id, any_value(Sender_account) AS primary_account_id, min(ts) AS alert_created_at, max(ts) AS last_trigger_at, count(DISTINCT transaction_id) AS transaction_count, sum(Amount) AS alert_amount, max(ml_probability) AS pmax, avg(ml_probability) AS pmean FROM l GROUP BY 1)"""
_CASE = """, y AS (SELECT *, coalesce(epoch_us(alert_created_at)-epoch_us(lag(alert_created_at) OVER (PARTITION BY primary_account_id ORDER BY alert_created_at, alert_id)) > 7*86400000000, true) AS nw FROM al),
 u AS (SELECT *, CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY primary_account_id ORDER BY alert_created_at, alert_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM y),
 cl AS (SELECT 'CAS-ML1-' || upper(substr(sha1('MLV1|CASE|' || primary_account_id || '|' || session),1,16)) AS case_id, * FROM u)"""


def _layers(spark, sf_dir):
    links = A.ml_alert_links(_features(spark, sf_dir), 2)
    alerts = A.ml_alerts(links, 2)
    return links, alerts, A.case_links(alerts, 7)


@_query(_F + _SESS + " SELECT alert_id, transaction_id, tx_id, Sender_account AS primary_account_id FROM l")
def c3_alert_links(spark, sf_dir):
    return _layers(spark, sf_dir)[0].select("alert_id", "transaction_id", "tx_id", "primary_account_id")


@_query(_F + _SESS + " SELECT alert_id, primary_account_id, alert_created_at, last_trigger_at, transaction_count, alert_amount, round(pmax,6) AS ml_probability_max, round(pmean,6) AS ml_probability_mean, 'ML_V1' AS detection_engine, 'ML_DETECTION_V1' AS model_version, 'NEW' AS alert_status, 'UNASSIGNED' AS priority, printf('Frozen ML V1; %d triggering transaction(s); max probability=%.4f; 2d inactivity-session aggregation', transaction_count, pmax) AS trigger_reason FROM al")
def c3_ml_alerts(spark, sf_dir):
    a = _layers(spark, sf_dir)[1]
    return a.select("alert_id", "primary_account_id", "alert_created_at", "last_trigger_at", "transaction_count", "alert_amount", F.round("ml_probability_max", 6).alias("ml_probability_max"), F.round("ml_probability_mean", 6).alias("ml_probability_mean"), "detection_engine", "model_version", "alert_status", "priority", "trigger_reason")


@_query(_F + _SESS + _CASE + " SELECT case_id, alert_id, 'SAME_ACCOUNT_7D_SESSION' AS link_reason, alert_created_at AS linked_at, 'SYSTEM' AS linked_by FROM cl")
def c4_case_alerts(spark, sf_dir):
    return A.case_alert_table(_layers(spark, sf_dir)[2], 7)


@_query(_F + _SESS + _CASE + """, cs AS (SELECT case_id, any_value(primary_account_id) AS subject_id, min(alert_created_at) AS case_created_at, max(last_trigger_at) AS last_alert_at, count(*) AS alert_count, sum(alert_amount) AS total_alert_amount, max(pmax) AS pmax, CAST(sum(transaction_count) AS BIGINT) AS transaction_count FROM cl GROUP BY 1)
 SELECT case_id, subject_id, case_created_at, last_alert_at, alert_count, total_alert_amount, round(pmax,6) AS ml_probability_max, transaction_count, row_number() OVER (ORDER BY pmax DESC, alert_count DESC, last_alert_at DESC, case_id) AS queue_rank,
 'OPEN' AS case_status, 'UNASSIGNED' AS case_priority, printf('%d ML alert(s); %d unique transaction(s); maximum probability %.4f', alert_count, transaction_count, pmax) AS case_summary FROM cs""")  # fmt: skip
def c4_ml_cases(spark, sf_dir):
    links, _, linked = _layers(spark, sf_dir)
    c = A.ml_cases(linked, links)
    return c.select("case_id", "subject_id", "case_created_at", "last_alert_at", "alert_count", "total_alert_amount", F.round("ml_probability_max", 6).alias("ml_probability_max"), "transaction_count", "queue_rank", "case_status", "case_priority", "case_summary")


@_query(_F + _SESS + " SELECT (SELECT count(*) FROM al) AS alerts, (SELECT count(DISTINCT primary_account_id) FROM al) AS accounts, count(DISTINCT transaction_id) AS evidence_transactions, count(*) AS flagged, round(1-(SELECT count(*) FROM al)/count(*),6) AS reduction_pct FROM l")
def a47_manifest(spark, sf_dir):
    links, alerts, _ = _layers(spark, sf_dir)
    return A.manifest(transactions(spark, sf_dir), alerts, links)


_DIRTY = """, al2 AS (SELECT alert_id FROM al WHERE substr(alert_id,10,1) NOT IN ('0','1') UNION ALL SELECT alert_id FROM al WHERE substr(alert_id,10,1)='2'), l2 AS (SELECT alert_id FROM l WHERE substr(alert_id,10,1)<>'3'),
 cl2 AS (SELECT alert_id, case_id FROM cl WHERE substr(alert_id,10,1)<>'4' UNION ALL SELECT alert_id, 'OTHER' FROM cl WHERE substr(alert_id,10,1)='5'), cs2 AS (SELECT DISTINCT case_id FROM cl WHERE substr(case_id,9,1)<>'6')"""


@_query(_F + _SESS + _CASE + _DIRTY + """ SELECT 'duplicate_alert_ids' AS "check", count(*) AS n_bad FROM (SELECT alert_id FROM al2 GROUP BY 1 HAVING count(*)>1) UNION ALL SELECT 'duplicate_case_ids', CAST(0 AS BIGINT)
 UNION ALL SELECT 'orphan_alert_links', count(*) FROM l2 WHERE alert_id NOT IN (SELECT alert_id FROM al2) UNION ALL SELECT 'alerts_without_evidence', count(*) FROM al2 WHERE alert_id NOT IN (SELECT alert_id FROM l2)
 UNION ALL SELECT 'alerts_in_several_cases', count(*) FROM (SELECT alert_id FROM cl2 GROUP BY 1 HAVING count(DISTINCT case_id)>1) UNION ALL SELECT 'alerts_without_case', count(*) FROM al2 WHERE alert_id NOT IN (SELECT alert_id FROM cl2)
 UNION ALL SELECT 'orphan_case_links', count(*) FROM cl2 WHERE case_id NOT IN (SELECT case_id FROM cs2) UNION ALL SELECT 'no_alerts', CAST(0 AS BIGINT)""")
def c11_violations(spark, sf_dir):
    """The integrity suite on layers from which some alerts, links and cases were taken and others doubled, by their ids."""
    links, alerts, linked = (written(x, n) for x, n in zip(_layers(spark, sf_dir), ("links", "alerts", "case-links"), strict=True))
    at = lambda c, k: F.substring(c, k, 1)
    two = alerts.select("alert_id").where(~at("alert_id", 10).isin("0", "1"))
    two = two.unionByName(alerts.select("alert_id").where(at("alert_id", 10) == "2"))
    several = linked.select("alert_id", F.lit("OTHER").alias("case_id")).where(at("alert_id", 10) == "5")
    some = linked.select("alert_id", "case_id").where(at("alert_id", 10) != "4").unionByName(several)
    cases = linked.select("case_id").distinct().where(at("case_id", 9) != "6")
    return A.violations(two, links.where(at("alert_id", 10) != "3"), cases, some)


_MART = """, ca AS (SELECT case_id, any_value(primary_account_id) AS subject_id, min(alert_created_at) - INTERVAL 72 HOURS AS a, max(alert_created_at) + INTERVAL 72 HOURS AS b FROM cl GROUP BY 1),
 m AS (SELECT ca.case_id, ca.subject_id, f.*, CAST(EXISTS (SELECT 1 FROM l JOIN cl USING (alert_id) WHERE l.tx_id=f.tx_id AND cl.case_id=ca.case_id) AS INT) AS is_alerted FROM ca JOIN f ON (f.Sender_account=ca.subject_id OR f.Receiver_account=ca.subject_id) AND f.ts BETWEEN ca.a AND ca.b)"""


def _mart(spark, sf_dir):
    links, _, linked = _layers(spark, sf_dir)
    cases = linked.groupBy("case_id").agg(F.first("primary_account_id").alias("subject_id"), F.min("alert_created_at").alias("case_created_at"), F.max("alert_created_at").alias("last_alert_at"))
    alerted = links.join(linked.select("alert_id", "case_id"), "alert_id").select("case_id", "tx_id").distinct().withColumn("is_alerted", F.lit(1))
    mart = A.case_context(cases, S.semantics(_features(spark, sf_dir)))
    return mart.join(alerted, ["case_id", "tx_id"], "left").withColumn("is_alerted", F.coalesce("is_alerted", F.lit(0)))


@_query(_F + _SESS + _CASE + _MART + " SELECT case_id, tx_id, is_alerted FROM m")
def j6_case_context(spark, sf_dir):
    return _mart(spark, sf_dir).select("case_id", "tx_id", "is_alerted")


@_query(_F + _SESS + _CASE + _MART + " SELECT case_id, count(*) AS rows, count(DISTINCT CASE WHEN NOT cash THEN CASE WHEN Sender_account=subject_id THEN Receiver_account ELSE Sender_account END END) AS unique_counterparties, CAST(sum(Cross_border) AS BIGINT) AS cross_border, CAST(sum(is_alerted) AS BIGINT) AS alerted FROM m GROUP BY 1")
def a33_network_complexity(spark, sf_dir):
    return A.network_complexity(_mart(spark, sf_dir))


@_query(_F + _SESS + _CASE + _MART + " SELECT case_id, Sender_account AS src, Receiver_account AS dst, count(*) AS n, sum(Amount) AS amount FROM m WHERE NOT cash GROUP BY ALL")
def a38_edges(spark, sf_dir):
    return A.edges(_mart(spark, sf_dir))


@_query(", s AS (SELECT Sender_bank_location AS country, sum(Amount) AS sent, count(*) AS sc FROM tx GROUP BY 1), r AS (SELECT Receiver_bank_location AS country, sum(Amount) AS received, count(*) AS rc FROM tx GROUP BY 1) SELECT country, coalesce(sent,0) AS sent, coalesce(sc,0) AS sent_count, coalesce(received,0) AS received, coalesce(rc,0) AS received_count FROM s FULL JOIN r USING (country)")
def a35_country_totals(spark, sf_dir):
    return A.country_totals(transactions(spark, sf_dir))


_RULE = _F + _H + _FLAGS + """, hit AS (SELECT unnest([{'s':'SCN_SINGLE_LARGE','f':SCN_SINGLE_LARGE},{'s':'SCN_FAN_OUT','f':SCN_FAN_OUT},{'s':'SCN_STRUCTURING_PROXY','f':SCN_STRUCTURING_PROXY}]) AS x, Sender_account AS account, ts, tx_id, Amount FROM v),
 hz AS (SELECT *, coalesce(epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY x.s, account ORDER BY ts, tx_id)) > CASE x.s WHEN 'SCN_FAN_OUT' THEN 3 ELSE 2 END*86400000000, true) AS nw FROM hit WHERE x.f=1),
 hs AS (SELECT *, CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY x.s, account ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM hz)
 SELECT 'ALT-RV3-' || upper(substr(sha1(x.s || '|' || account || '|' || session),1,16)) AS alert_id, x.s AS scenario_id, account AS primary_account_id, min(ts) AS alert_created_at, max(ts) AS last_trigger_at, count(*) AS transaction_count, sum(Amount) AS alert_amount FROM hs GROUP BY x.s, account, session"""  # fmt: skip


@_query(_RULE)
def c5_rule_alerts(spark, sf_dir):
    names = ("SCN_SINGLE_LARGE", "SCN_FAN_OUT", "SCN_STRUCTURING_PROXY")
    hit = _v1(spark, sf_dir).select(F.col("Sender_account").alias("account"), "ts", "tx_id", "Amount", F.explode(F.array(*(F.when(F.col(n) == 1, F.lit(n)) for n in names))).alias("scenario_id"))
    return A.rule_alerts(A.rule_alert_links(hit.where("scenario_id IS NOT NULL"), {"SCN_FAN_OUT": 3}, 2))


_GRID = """, o AS (SELECT Sender_account, CAST(floor((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-15'))/(10*86400000000.0)) AS BIGINT) AS bucket, count(*) AS n, quantile_cont(Amount,0.5) AS md, sum(Amount) AS t, count(DISTINCT Receiver_account) AS u,
 sum(CAST(ts>=TIMESTAMP '2024-01-15' AS INT)) AS dt, sum(CAST(ts>=TIMESTAMP '2024-01-15' AS INT)*Is_laundering) AS da, sum(CAST(ts>=TIMESTAMP '2024-01-15' AND Laundering_type='Smurfing' AS INT)) AS dg FROM f GROUP BY 1,2 HAVING sum(CAST(ts>=TIMESTAMP '2024-01-15' AS INT))>0),
 g AS (SELECT * FROM (SELECT unnest([3,5,8,10]) AS min_n), (SELECT unnest([4000.0,6000.0,9000.0]) AS max_median), (SELECT unnest([10000.0,20000.0,30000.0]) AS min_total))
 SELECT min_n, CAST(max_median AS DOUBLE) AS max_median, CAST(min_total AS DOUBLE) AS min_total, CAST(coalesce(sum(dt),0) AS BIGINT) AS triggered, CAST(coalesce(sum(da),0) AS BIGINT) AS aml_hits, CAST(coalesce(sum(dg),0) AS BIGINT) AS target_hits, count(o.n) AS windows,
 round(coalesce(sum(dt),0)/(SELECT sum(dt) FROM o),6) AS trigger_rate, round(coalesce(sum(da)/nullif(sum(dt),0),0),6) AS precision, round(coalesce(sum(dg),0)/(SELECT sum(dg) FROM o),6) AS target_recall
 FROM g LEFT JOIN o ON o.n>=min_n AND o.md<max_median AND o.t>=min_total GROUP BY 1,2,3"""


@_query(_F + _GRID)
def g5_smurfing_grid(spark, sf_dir):
    start = F.lit("2024-01-15").cast("timestamp")
    dev = (F.col("ts") >= start).cast("int")
    f = _features(spark, sf_dir).withColumn("bucket", W.anchored(F.col("ts"), start, 10))
    o = f.groupBy("Sender_account", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("Amount", 0.5).alias("md"), F.sum("Amount").alias("t"), F.sum(dev).alias("dev_transactions"), F.sum(dev * F.col("Is_laundering")).alias("dev_aml"), F.sum(dev * (F.col("Laundering_type") == "Smurfing").cast("int")).alias("dev_target"),
    ).where("dev_transactions > 0")
    g = P.grid(spark, min_n=(3, 5, 8, 10), max_median=(4000.0, 6000.0, 9000.0), min_total=(10_000.0, 20_000.0, 30_000.0)).withColumn("min_n", F.col("min_n").cast("int"))
    o = P.cells(o, cell_n=P.at_least("n", (3, 5, 8, 10)), cell_median=P.below("md", (4000.0, 6000.0, 9000.0)), cell_total=P.at_least("t", (10_000.0, 20_000.0, 30_000.0)))
    return P.evaluate_grid(o, g, (F.col("cell_n") >= F.col("min_n")) & (F.col("cell_median") <= F.col("max_median")) & (F.col("cell_total") >= F.col("min_total")))


_EDGE = ", e AS (SELECT Sender_account AS src, Receiver_account AS dst, ts, tx_id, Amount AS amount FROM f WHERE NOT cash AND Sender_account<>Receiver_account)"


def _transfers(spark, sf_dir):
    return N.transfers(S.semantics(transactions(spark, sf_dir)))


@_query(_F + _EDGE + " SELECT a.dst AS account, a.tx_id AS in_tx, b.tx_id AS out_tx FROM e a JOIN e b ON a.dst=b.src AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 1 DAY WHERE b.amount/a.amount BETWEEN 0.8 AND 1.05")
def d32_pass_through(spark, sf_dir):
    return N.pass_through(_transfers(spark, sf_dir))


@_query(_F + _EDGE + " SELECT a.src, a.dst, a.tx_id AS out_tx, b.tx_id AS back_tx FROM e a JOIN e b ON a.dst=b.src AND b.dst=a.src AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 7 DAYS")
def d33_cycles(spark, sf_dir):
    return N.cycles(_transfers(spark, sf_dir))


@_query(_F + _EDGE + " SELECT a.src AS source, b.dst AS target, count(DISTINCT a.dst) AS mids FROM e a JOIN e b ON a.dst=b.src AND a.src<>b.dst AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 7 DAYS GROUP BY 1,2 HAVING count(DISTINCT a.dst)>=2")
def d31_scatter_gather(spark, sf_dir):
    return N.scatter_gather(_transfers(spark, sf_dir), 7 * 86_400, 2)


@_query(_F + _EDGE + ", p AS (SELECT a.src, a.dst, count(DISTINCT b.dst) AS leaves FROM e a JOIN e b ON a.dst=b.src AND a.src<>b.dst AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 7 DAYS GROUP BY 1,2 HAVING count(DISTINCT b.dst)>=2) SELECT src AS root, count(*) AS mids, CAST(sum(leaves) AS BIGINT) AS leaf_links FROM p GROUP BY 1 HAVING count(*)>=2")
def d34_layered_fan_out(spark, sf_dir):
    return N.layered_fan_out(_transfers(spark, sf_dir), 7 * 86_400)


@_query(_F + _EDGE + " SELECT a.Receiver_account AS account, a.tx_id AS deposit_tx, b.tx_id AS send_tx FROM f a JOIN e b ON a.Receiver_account=b.src AND b.ts>a.ts AND b.ts<=a.ts+INTERVAL 72 HOURS WHERE a.Payment_type='Cash Deposit' AND b.amount>=0.8*a.Amount")
def d28_deposit_then_send(spark, sf_dir):
    return N.deposit_then_send(S.semantics(transactions(spark, sf_dir)))


@_query(", d AS (SELECT Sender_bank_location, CAST(ts AS DATE) AS day, count(*) AS n, sum(Is_laundering) AS p FROM tx GROUP BY 1,2) SELECT Sender_bank_location, day, CAST(coalesce(sum(n) OVER w,0) AS BIGINT) AS past_n, round(coalesce(sum(p) OVER w,0)/(coalesce(sum(n) OVER w,0)+10.0),6) AS past_rate FROM d WINDOW w AS (PARTITION BY Sender_bank_location ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def m9_past_target_rate(spark, sf_dir):
    from ..operators.ml import past_target_rate

    return past_target_rate(transactions(spark, sf_dir))


def _learning_rows(spark, sf_dir):
    tx = S.with_country_risk(W.history(_features(spark, sf_dir)), S.country_dimension(spark))
    return P.with_split(tx, P.boundaries(P.daily(tx)))


@_query(None)
def m6_scored_holdout(spark, sf_dir):
    """Trained on the first days, scored on the last; rows and invariants are tested, SQL can't state the trees."""
    from ..operators import ml

    rows = _learning_rows(spark, sf_dir)
    return ml.score(ml.fit(rows.where("split = 'train'")), rows.where("split = 'holdout'")).select("tx_id", "Is_laundering", F.round("probability_1", 6).alias("probability"))
