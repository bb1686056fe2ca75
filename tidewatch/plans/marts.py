"""Queries of sources and sinks, country codes, checked joins, combined detectors, grids, investigation marts and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import scalars as S
from ..operators import alerts as A, audit, evaluation as E, features as W, profiles as P, scenarios as D
from ..operators.scans import hot_among
from ..sources import tables as X
from ..sources.layers import transaction_layer
from ..sources.tables import transactions
from .detection import _AXES, _FANGRID, _G3, _LEAST, _MOST, _RISK, _RULES, _SMURF, _queue, _rule_evidence, _rule_links, _smurfing_grid, _DAYS
from .registry import _CASE, _CUM, _F, _FAN, _FLAGS, _H, _SCORED, _SESS, _SPLIT, _features, _layers, _lean, _learning_rows, _ml, _query, _v1

_START = "TIMESTAMP '2024-01-15'"


def _start():
    return F.lit("2024-01-15").cast("timestamp")


# --- sources and sinks

_COLUMNS = ("tx_id", "Date", "Time", "Sender_account", "Amount", "Payment_type")


@_query(" SELECT " + ", ".join(_COLUMNS) + " FROM tx")
def s4_csv_round_trip(spark, sf_dir):
    """All columns written as CSV, six of them read back by the fixed schema."""
    path = X.shared_path(spark, "transactions-csv")
    schema = T.StructType([T.StructField("tx_id", T.LongType()), *X.TRANSACTIONS.fields])
    X.write_csv(transactions(spark, sf_dir).select(*schema.names), path)
    return X.read_csv(spark, path, schema, list(_COLUMNS))


@_query(_SPLIT + " SELECT CASE WHEN CAST(ts AS DATE)<=e1 THEN 'train' WHEN CAST(ts AS DATE)<=e2 THEN 'development' ELSE 'holdout' END AS split, count(*) AS rows, sum(Amount) AS total FROM tx, b GROUP BY 1")
def s5_split_folders(spark, sf_dir):
    """Rows written to a folder for each period, and read from there."""
    tx, path = transactions(spark, sf_dir), X.shared_path(spark, "split")
    X.write_split(P.with_split(tx, P.boundaries(P.daily(tx))), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.sum("Amount").alias("total"))


@_query(_F + _SESS + " SELECT (SELECT count(*) FROM al) AS alerts, (SELECT count(DISTINCT primary_account_id) FROM al) AS accounts, count(DISTINCT transaction_id) AS evidence_transactions, count(*) AS flagged, round(1-(SELECT count(*) FROM al)/count(*),6) AS reduction_pct FROM l")
def s6_manifest_file(spark, sf_dir):
    links, alerts, _ = _layers(spark, sf_dir)
    path = X.shared_path(spark, "manifest")
    X.write_manifest(A.manifest(transactions(spark, sf_dir), alerts, links), path)
    return spark.read.schema("alerts long, accounts long, evidence_transactions long, flagged long, reduction_pct double").json(path)


@_query(" SELECT 'daily' AS artifact, count(DISTINCT CAST(ts AS DATE)) AS rows FROM tx UNION ALL SELECT 'absent', NULL")
def s7_optional_tables(spark, sf_dir):
    """Rows of an artifact that is there, and of one that isn't."""
    path = X.shared_path(spark, "artifacts")
    P.daily(transactions(spark, sf_dir)).write.parquet(f"{path}/daily")
    found = {name: X.load_optional(spark, f"{path}/{name}") for name in ("daily", "absent")}
    count = lambda name, df: df.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("rows")) if df is not None else spark.range(1).select(F.lit(name).alias("artifact"), F.lit(None).cast("long").alias("rows"))
    return count("daily", found["daily"]).unionByName(count("absent", found["absent"]))


_DETECTORS = ("Rule-Based V3", "XGBoost V1")


@_query(_F + """, e AS (SELECT 'Rule-Based V3' AS detector, CAST(Amount>=20000 AS INT) AS a, Is_laundering AS y FROM f UNION ALL SELECT 'XGBoost V1', CAST(ml AS INT), Is_laundering FROM f),
 c AS (SELECT detector, count(*) AS n, sum(a) AS al, sum(a*y) AS h, sum(y) AS p FROM e GROUP BY 1),
 r AS (SELECT detector, unnest([{'m':'precision','v':round(h/al,6)},{'m':'recall','v':round(h/p,6)},{'m':'alert_rate','v':round(al/n,6)}]) AS x FROM c)
 SELECT detector, x.m AS metric, round(x.v + CASE WHEN detector='XGBoost V1' AND x.m='recall' THEN 0.01 ELSE 0 END,6) AS published, x.v AS recomputed, NOT (detector='XGBoost V1' AND x.m='recall') AS agrees FROM r""")
def c13_summary_audit(spark, sf_dir):
    """A table of metrics published as CSV with a byte order mark, one figure of which was changed, against its own counts."""
    rows = _ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int"))
    both = E.binary_metrics(rows, "RULE", _DETECTORS[0]).unionByName(E.binary_metrics(rows, "ML_ALERT", _DETECTORS[1]))
    changed = F.when(F.col("engine") == _DETECTORS[1], F.lit(0.01)).otherwise(F.lit(0.0))
    values = {
        "HOLDOUT transactions": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "AML positives": F.col("tp") + F.col("fn"), "Flagged transactions": F.col("alerts"), "AML hits": F.col("tp"),
        "Precision": F.col("precision"), "Recall": F.round(F.col("recall") + changed, 6), "Alert rate": F.col("alert_rate"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("Metric"), v.cast("double").alias("value")) for k, v in values.items()))).alias("x")
    wide = both.select("engine", each).groupBy("x.Metric").agg(*(F.max(F.when(F.col("engine") == d, F.col("x.value"))).alias(d) for d in _DETECTORS))
    path = X.shared_path(spark, "published")
    X.write_csv(wide.withColumnRenamed("Metric", "﻿Metric"), path)
    return audit.summary(spark.read.csv(path, header=True), list(_DETECTORS))


_EXPORT = ("tx_id", "Sender_account", "Receiver_account", "Amount", "Payment_type", "Is_laundering", "Laundering_type", "ts", "Scenario_count", "Scenario_score", "Alert_reasons")


@_query(_F + _H + _FLAGS + _SCORED + " SELECT " + ", ".join(_EXPORT) + " FROM w WHERE Scenario_count>=1")
def s11_flagged_export(spark, sf_dir):
    rows = _v1(spark, sf_dir).where("Scenario_alert = 1").select(*_EXPORT)
    path = X.shared_path(spark, "flagged")
    X.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


_TIMES = ", n AS (SELECT tx_id, ts, Date, CASE WHEN tx_id%5=0 THEN ' ' WHEN tx_id%7=0 THEN 'nan' WHEN tx_id%11=0 THEN NULL ELSE Time END AS t FROM tx)"


@_query(_TIMES + " SELECT tx_id, CASE WHEN tx_id%5=0 OR tx_id%7=0 OR tx_id%11=0 THEN CAST(Date AS TIMESTAMP) ELSE ts END AS parsed FROM n")
def p2_timestamps_or_dates(spark, sf_dir):
    """Blank, missing and placeholder times fall back to the date; a row with neither fails."""
    k = F.col("tx_id")
    time = F.when(k % 5 == 0, " ").when(k % 7 == 0, "nan").when(k % 11 == 0, F.lit(None)).otherwise(F.col("Time"))
    rows = transactions(spark, sf_dir).select("tx_id", S.timestamp_or_date(F.col("Date"), time).alias("parsed"))
    return P.require_parsed(rows, "parsed")


@_query(" SELECT tx_id FROM tx WHERE tx_id%13<>0")
def f9_dated_rows(spark, sf_dir):
    time = F.when(F.col("tx_id") % 13 == 0, "99:99:99").otherwise(F.col("Time"))
    return transactions(spark, sf_dir).withColumn("at", S.timestamp_of(F.col("Date"), time)).dropna(subset=["at"]).select("tx_id")


# --- countries

_LOC = "CASE {0} WHEN 'UK' THEN '{1}' WHEN 'USA' THEN '{2}' WHEN 'UAE' THEN '{3}' ELSE '{4}' END"


@_query(" SELECT tx_id, CASE Sender_bank_location WHEN 'UK' THEN 'United Kingdom' WHEN 'UAE' THEN 'United Arab Emirates' WHEN 'USA' THEN 'United States' ELSE Sender_bank_location END AS country FROM tx")
def p10_country_names(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", S.long_country_name(F.col("Sender_bank_location")).alias("country"))


@_query(f" SELECT tx_id, CASE WHEN tx_id%4 IN (0,1) THEN {_LOC.format('Sender_bank_location', 'GB', 'US', 'AE', 'TR')} WHEN tx_id%4=2 AND Sender_bank_location='USA' THEN 'US' END AS Sender_iso2, CASE WHEN tx_id%4 IN (0,1) THEN {_LOC.format('Sender_bank_location', 'GBR', 'USA', 'ARE', 'TUR')} WHEN tx_id%4=2 AND Sender_bank_location='USA' THEN 'USA' END AS Sender_iso3 FROM tx")
def p11_country_codes(spark, sf_dir):
    """Codes of places written in several ways: as they are, in small letters with spaces, with dots between letters, and as placeholders."""
    name, k = F.col("Sender_bank_location"), F.col("tx_id") % 4
    noisy = F.when(k == 0, name).when(k == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" "))).when(k == 2, F.regexp_replace(name, "(?<=.)(?=.)", ".")).otherwise("NaN")
    tx = S.with_country_codes(transactions(spark, sf_dir).withColumn("place", noisy), S.countries(spark), "place", "Sender")
    return tx.select("tx_id", "Sender_iso2", "Sender_iso3")


_OTHER = ("Russian Federation", "Viet Nam", "Czech Republic", "Republic of Korea", "Hong Kong", "Türkiye", "Kingdom of the Netherlands", "Iran, Islamic Republic of", "Côte d'Ivoire", "Democratic Republic of the Congo", "Kingdom of France")


@_query(" SELECT tx_id, CASE tx_id%11 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(("RU", "VN", "CZ", "KR", "HK", "TR", "NL", "IR", "CI", "CD"))) + " END AS Sender_iso2, CASE tx_id%11 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(("RUS", "VNM", "CZE", "KOR", "HKG", "TUR", "NLD", "IRN", "CIV", "COD"))) + " END AS Sender_iso3 FROM tx")
def p11_official_names(spark, sf_dir):
    """Codes of official, inverted and former names, by the ids of the rows; the last one is nobody's."""
    name = F.element_at(F.array(*map(F.lit, _OTHER)), (F.col("tx_id") % len(_OTHER) + 1).cast("int"))
    tx = S.with_country_codes(transactions(spark, sf_dir).withColumn("place", name), S.countries(spark), "place", "Sender")
    return tx.select("tx_id", "Sender_iso2", "Sender_iso3")


# --- joins that check their keys

@_query(_F + " SELECT tx_id, Amount, ml_probability FROM f WHERE ml")
def j3_scored_transactions(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    scores = tx.where(F.col("ml_probability") >= A.THRESHOLD).select("tx_id", "ml_probability")
    return X.checked_join(scores, tx.drop("ml_probability"), ["tx_id"], "left", "one_to_one").select("tx_id", "Amount", "ml_probability")


@_query(_F + _SESS + _CASE + " SELECT case_id, transaction_id FROM cl JOIN l USING (alert_id)")
def j4_case_transactions(spark, sf_dir):
    links, _, linked = _layers(spark, sf_dir)
    return X.checked_join(linked.select("case_id", "alert_id"), links.select("alert_id", "transaction_id").distinct(), ["alert_id"], "inner", "one_to_many").select("case_id", "transaction_id")


# --- combined detectors and grids

_PERIODS = _F + _SPLIT + """, p AS (SELECT f.*, CASE WHEN CAST(ts AS DATE)<=e1 THEN 'train' WHEN CAST(ts AS DATE)<=e2 THEN 'development' ELSE 'holdout' END AS split FROM f, b), st AS (SELECT min(ts) AS s FROM p WHERE split='development'),
 hs AS (SELECT p.* FROM p, st WHERE split='development' OR (split='train' AND ts>=s-INTERVAL {0} DAYS))"""


@_query(_PERIODS.format(5) + " SELECT tx_id, split FROM hs")
def f5_warm_up(spark, sf_dir):
    """Development rows and the train rows of the five days before them."""
    tx = _features(spark, sf_dir)
    return W.warmed_up(P.with_split(tx, P.boundaries(P.daily(tx))), days=5)[0].select("tx_id", "split")


@_query(_PERIODS.format(120) + """, g AS (SELECT split, Is_laundering AS y, count(*) OVER w9 AS n9, quantile_cont(Amount,0.5) OVER w9 AS m9, sum(Amount) OVER w9 AS t9, count(DISTINCT Receiver_account) OVER w9 AS u9, avg(Cross_border) OVER w9 AS c9, avg(Currency_mismatch) OVER w9 AS x9,
  count(*) OVER w2 AS n2, count(DISTINCT Receiver_account) OVER w2 AS u2, avg(Cross_border) OVER w2 AS c2, avg(Currency_mismatch) OVER w2 AS x2 FROM hs
  WINDOW w9 AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY Sender_account ORDER BY ts RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW)),
 k AS (SELECT y, CAST(n9>=3 AND m9<3000 AND t9>=20000 AND u9<=3 AND c9<=0.15 AND x9<=0.15 AS INT) AS sm, unnest([{'v':'recall','f':CAST(u2>=3 AND n2 BETWEEN 3 AND 12 AND (c2>=0.2 OR x2>=0.2) AS INT)},{'v':'intermediate','f':CAST(u2>=3 AND n2 BETWEEN 3 AND 12 AND (c2>=0.3 OR x2>=0.3) AS INT)},{'v':'selective','f':CAST(u2>=3 AND n2 BETWEEN 3 AND 8 AND (c2>=0.3 OR x2>=0.3) AS INT)}]) AS z FROM g WHERE split='development')
 SELECT z.v AS FanOut_variant, CAST(sum(sm) AS BIGINT) AS Smurfing_alerts, CAST(sum(z.f) AS BIGINT) AS FanOut_alerts, CAST(sum(sm*z.f) AS BIGINT) AS Overlapping_alerts, CAST(sum(greatest(sm,z.f)) AS BIGINT) AS Combined_alerts, CAST(sum(y) AS BIGINT) AS AML_transactions, CAST(sum(greatest(sm,z.f)*y) AS BIGINT) AS AML_hits,
  round(sum(greatest(sm,z.f))/count(*),6) AS Alert_rate, round(coalesce(sum(greatest(sm,z.f)*y)/nullif(sum(greatest(sm,z.f)),0),0),6) AS Precision, round(coalesce(sum(greatest(sm,z.f)*y)/nullif(sum(y),0),0),6) AS Overall_AML_recall FROM k GROUP BY 1""")
def d22_combined_v3(spark, sf_dir):
    """Smurfing of 90 days with each of three fan-out variants of 21 days, on development rows, with 120 days of train as context."""
    tx = S.row_features(transaction_layer(spark, sf_dir))
    rows = P.with_split(tx, P.boundaries(P.daily(tx)))
    audit.require_none(audit.leaks(rows))
    history, _ = W.warmed_up(_lean(rows, "split", "Is_laundering"), days=120)
    columns = [c for c in history.columns if c != "dev_start"]
    among = hot_among(history, ["Sender_account"])  # once, on the plain rows
    flagged = W.sliding(history, 90, among=among).withColumn("smurfing", D.smurfing_v3()).select(*columns, "smurfing")
    fan = W.sliding(flagged, 21, median=False, among=among).where("split = 'development'")
    return E.combined_variants(fan, "smurfing", {"recall": D.fan_out_v3(12, 0.20), "intermediate": D.fan_out_v3(12, 0.30), "selective": D.fan_out_v3(8, 0.30)})


_GEO = (0.2, 0.3, 0.4)


@_query(_F + """, o AS (SELECT time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01') AS bk, Sender_account, count(*) AS n, count(DISTINCT Receiver_account) AS u, greatest(avg(Cross_border),avg(Currency_mismatch)) AS r, count(*) AS dt, sum(Is_laundering) AS da, sum(CAST(Laundering_type='Fan_Out' AS INT)) AS dg FROM f GROUP BY 1,2),
 g AS (SELECT * FROM (SELECT unnest([5,6,7,8]) AS min_cp), (SELECT unnest([10,12]) AS max_cp), (SELECT unnest([CAST(0.2 AS DOUBLE),0.3,0.4]) AS min_geo))
 SELECT min_cp, max_cp, min_geo, CAST(coalesce(sum(dt),0) AS BIGINT) AS triggered, CAST(coalesce(sum(da),0) AS BIGINT) AS aml_hits, CAST(coalesce(sum(dg),0) AS BIGINT) AS target_hits, count(o.n) AS windows, round(coalesce(sum(dt),0)/(SELECT sum(dt) FROM o),6) AS trigger_rate, round(coalesce(sum(da)/nullif(sum(dt),0),0),6) AS precision, round(coalesce(sum(dg),0)/(SELECT sum(dg) FROM o),6) AS target_recall
 FROM g LEFT JOIN o ON o.u BETWEEN min_cp AND max_cp AND o.n BETWEEN min_cp AND 20 AND o.r>=min_geo GROUP BY 1,2,3""")
def g2_fan_out_period_grid(spark, sf_dir):
    """24 settings on buckets of ten days, full ones."""
    o = _features(spark, sf_dir).groupBy(W.epoch_bucket(F.col("ts"), 10).alias("bucket"), "Sender_account").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Receiver_account").alias("u"), F.greatest(F.avg("Cross_border"), F.avg("Currency_mismatch")).alias("r"),
        F.count(F.lit(1)).alias("dev_transactions"), F.sum("Is_laundering").alias("dev_aml"), F.sum((F.col("Laundering_type") == "Fan_Out").cast("int")).alias("dev_target"),
    )
    c = P.cells(o, cell_cp=F.when(F.col("n") <= 20, P.at_least(F.least("u", "n"), (5, 6, 7, 8))), cell_u=P.below("u", (11, 13)), cell_geo=P.at_least("r", _GEO))
    g = P.grid(spark, min_cp=(5, 6, 7, 8), max_cp=(10, 12), min_geo=_GEO).select(F.col("min_cp").cast("int").alias("min_cp"), F.col("max_cp").cast("int").alias("max_cp"), "min_geo")
    return P.evaluate_grid(c, g, (F.col("cell_cp") >= F.col("min_cp")) & (F.col("cell_u") <= F.col("max_cp") + 1) & (F.col("cell_geo") >= F.col("min_geo")))


@_query(_F + f""", b AS (SELECT f.*, d, CAST(floor((epoch_us(ts)-epoch_us({_START}))/(d*86400000000.0)) AS BIGINT) AS bucket FROM f, (SELECT unnest([7,10,14,21]) AS d)),
 nw AS (SELECT *, CAST(row_number() OVER (PARTITION BY d, Sender_account, bucket, Receiver_account ORDER BY ts, tx_id)=1 AS INT) AS isnew FROM b),
 rr AS (SELECT d, ts, Is_laundering, Laundering_type, count(*) OVER w AS n, sum(isnew) OVER w AS u, greatest(avg(Cross_border) OVER w, avg(Currency_mismatch) OVER w) AS r FROM nw WINDOW w AS (PARTITION BY d, Sender_account, bucket ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING)),
 o AS (SELECT d, n, u, r, 1 AS dt, Is_laundering AS da, CAST(Laundering_type='Fan_Out' AS INT) AS dg FROM rr WHERE ts>={_START}),
""" + _FANGRID[_FANGRID.index(" t AS (SELECT d, sum(dt)") :])
def g4_causal_fan_out_grid(spark, sf_dir):
    """320 settings on what each row's sender had done in its bucket up to then; rows before the development start are context."""
    f, rows = _features(spark, sf_dir), None
    for days in _DAYS:
        r = W.causal_bucket(f, days, _start(), (1.0,)).where(F.col("ts") >= _start()).select(
            F.lit(days).alias("d"), "n", F.col("unique_receivers").alias("u"), F.greatest("cross_rate", "fx_rate").alias("r"),
            F.lit(1).alias("dev_transactions"), F.col("Is_laundering").alias("dev_aml"), (F.col("Laundering_type") == "Fan_Out").cast("int").alias("dev_target"),
        )
        rows = r if rows is None else rows.unionByName(r)
    c = P.cells(rows, cell_days=F.col("d"), cell_cp=P.at_least(F.least("u", "n"), _LEAST), cell_n=P.below("n", tuple(m + 1 for m in _MOST)), cell_rate=P.at_least("r", _RISK))
    g = P.grid(spark, days=_DAYS, min_cp=_LEAST, max_n=_MOST, min_rate=_RISK)
    g = g.select(*(F.col(k).cast("int").alias(k) for k in ("days", "min_cp", "max_n")), "min_rate")
    return P.evaluate_grid(c, g, (F.col("cell_cp") >= F.col("min_cp")) & (F.col("cell_n") <= F.col("max_n") + 1) & (F.col("cell_rate") >= F.col("min_rate")), per="days")


@_query(_F + f""", o AS (SELECT d, Sender_account, CAST(floor((epoch_us(ts)-epoch_us({_START}))/(d*86400000000.0)) AS BIGINT) AS bk, count(*) AS n, quantile_cont(Amount,0.5) AS md, sum(Amount) AS t, count(DISTINCT Receiver_account) AS u, greatest(avg(Cross_border),avg(Currency_mismatch)) AS r,
 sum(CAST(ts>={_START} AS INT)) AS dt, sum(CAST(ts>={_START} AS INT)*Is_laundering) AS da, sum(CAST(ts>={_START} AND Laundering_type='Smurfing' AS INT)) AS dg FROM f, (SELECT unnest([60,90,120]) AS d) GROUP BY 1,2,3 HAVING sum(CAST(ts>={_START} AS INT))>0)""" + _AXES.format(*map(list, _G3)) + _SMURF.format("0.15"))
def g5_smurfing_window_grid(spark, sf_dir):
    """144 settings on whole windows of 60, 90 and 120 days that hold development rows."""
    dev = (F.col("ts") >= _start()).cast("int")
    f = _features(spark, sf_dir).withColumn("d", F.explode(F.array(*map(F.lit, _G3[0]))))
    bucket = F.floor((F.unix_micros("ts") - F.unix_micros(_start())) / (F.col("d").cast("double") * 86_400_000_000)).cast("long")
    o = f.groupBy("d", "Sender_account", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("Amount", 0.5).alias("md"), F.sum("Amount").alias("t"), F.countDistinct("Receiver_account").alias("u"), F.greatest(F.avg("Cross_border"), F.avg("Currency_mismatch")).alias("r"),
        F.sum(dev).alias("dev_transactions"), F.sum(dev * F.col("Is_laundering")).alias("dev_aml"), F.sum(dev * (F.col("Laundering_type") == "Smurfing").cast("int")).alias("dev_target"),
    ).where("dev_transactions > 0")
    return _smurfing_grid(o, spark, 0.15, *_G3)


# --- what-if scenarios of receivers

_RECEIVED = """, rb AS (SELECT time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01') AS bk, Receiver_account, count(*) AS n, sum(Amount) AS t, count(DISTINCT Sender_account) AS u, avg(Cross_border) AS c, avg(Currency_mismatch) AS x FROM f GROUP BY 1,2)
 SELECT tx_id FROM f JOIN rb ON rb.Receiver_account=f.Receiver_account AND rb.bk=time_bucket(INTERVAL '10 days', f.ts, TIMESTAMP '1970-01-01') WHERE {0}"""


def _received(spark, sf_dir, condition):
    """Ids of the rows that meet a condition on their receiver's bucket of ten days."""
    f = _features(spark, sf_dir).withColumn("bucket", W.epoch_bucket(F.col("ts"), 10)).select("tx_id", "Amount", "Receiver_account", "bucket")
    b = W.bucket_features(_features(spark, sf_dir), "Receiver_account", "Sender_account", W.epoch_bucket(F.col("ts"), 10))
    return f.join(b, ["Receiver_account", "bucket"]).where(condition == 1).select("tx_id")


@_query(_F + _RECEIVED.format("f.Amount<8000 AND u>=3 AND t>=5000 AND (c>=0.2 OR x>=0.3)"))
def d26_structuring_what_if(spark, sf_dir):
    return _received(spark, sf_dir, D.structuring_what_if(8_000.0, 3, 5_000.0, 0.2, 0.3))


@_query(_F + _RECEIVED.format("u BETWEEN 3 AND 15 AND n BETWEEN 3 AND 20 AND (c>=0.2 OR x>=0.3)"))
def d27_fan_in_what_if(spark, sf_dir):
    return _received(spark, sf_dir, D.fan_in_what_if((3, 15), (3, 20), 0.2, 0.3))


# --- investigation marts

_EVID = _RULES + """, he AS (SELECT 'ALT-RV3-' || upper(substr(sha1(x.s || '|' || account || '|' || session),1,16)) AS alert_id, x.s AS sid, tx_id FROM hs), ce AS (SELECT rl.case_id, he.tx_id, string_agg(DISTINCT sid, ' | ' ORDER BY sid) AS scenario FROM rl JOIN he USING (alert_id) GROUP BY 1,2),
 q AS (SELECT case_id, any_value(acc) AS subject_id, min(started) - INTERVAL 72 HOURS AS a, max(started) + INTERVAL 72 HOURS AS z FROM rl GROUP BY 1)"""
_ISO = [_LOC.format(f"f.{s}_bank_location", "GB", "US", "AE", "TR") for s in ("Sender", "Receiver")]


def _rule_layers(spark, sf_dir):
    """Cases, each case's alerts, and each case's evidence, of the rules."""
    evidence = _rule_evidence(spark, sf_dir)
    linked = A.rule_case_links(A.rule_alerts(evidence), 7)
    cases = linked.groupBy("case_id").agg(F.first("primary_account_id").alias("subject_id"), F.min("alert_created_at").alias("case_created_at"), F.max("alert_created_at").alias("last_alert_at"))
    held = evidence.join(linked.select("alert_id", "case_id"), "alert_id").select("case_id", "alert_id", "scenario_id", "tx_id", "ts")
    return cases, linked, held


def _case_mart(spark, sf_dir):
    cases, _, held = _rule_layers(spark, sf_dir)
    known, tx = S.countries(spark), S.semantics(S.row_features(transaction_layer(spark, sf_dir)))
    for side in ("Sender", "Receiver"):
        tx = S.with_country_codes(tx, known, f"{side}_bank_location", side)
    return A.case_mart(cases, tx, held)


@_query(_EVID + f""" SELECT q.case_id, q.subject_id, printf('TXN-HO-%010d', f.tx_id) AS transaction_id, coalesce(ce.scenario,'CONTEXT') AS scenario, CAST(ce.scenario IS NOT NULL AS INT) AS is_alerted_transaction, {_ISO[0]} AS sender_iso2, {_ISO[1]} AS receiver_iso2,
 CAST(NOT cash AND Cross_border=1 AS INT) AS cross_border, CAST(NOT cash AND Currency_mismatch=1 AS INT) AS currency_mismatch, CASE WHEN Sender_account=Receiver_account THEN 'BOTH' WHEN Sender_account=subject_id THEN 'SENDER' ELSE 'RECEIVER' END AS subject_role
 FROM q JOIN f ON (f.Sender_account=q.subject_id OR f.Receiver_account=q.subject_id) AND f.ts BETWEEN q.a AND q.z LEFT JOIN ce ON ce.case_id=q.case_id AND ce.tx_id=f.tx_id""")
def c7_case_mart(spark, sf_dir):
    return _case_mart(spark, sf_dir).select("case_id", "subject_id", "transaction_id", "scenario", "is_alerted_transaction", "sender_iso2", "receiver_iso2", "cross_border", "currency_mismatch", "subject_role")


@_query(_EVID + f""", mm AS (SELECT DISTINCT f.tx_id, {_ISO[0]} AS sender_iso2, {_ISO[1]} AS receiver_iso2 FROM q JOIN f ON (f.Sender_account=q.subject_id OR f.Receiver_account=q.subject_id) AND f.ts BETWEEN q.a AND q.z)
 SELECT rl.case_id, he.alert_id, printf('TXN-HO-%010d', he.tx_id) AS transaction_id, he.sid AS scenario_id, sender_iso2, receiver_iso2 FROM rl JOIN he USING (alert_id) LEFT JOIN mm ON mm.tx_id=he.tx_id""")
def c8_case_evidence(spark, sf_dir):
    """The evidence of all cases with the countries that the mart has for each transaction."""
    _, _, held = _rule_layers(spark, sf_dir)
    places = _case_mart(spark, sf_dir).select("transaction_id", "sender_iso2", "receiver_iso2").dropDuplicates(["transaction_id"])
    return held.withColumn("transaction_id", X.transaction_id(F.col("tx_id"))).join(places, "transaction_id", "left").select("case_id", "alert_id", "transaction_id", "scenario_id", "sender_iso2", "receiver_iso2")


@_query(_EVID + """, sc AS (SELECT rl.case_id, max(ml_probability) AS p FROM rl JOIN he USING (alert_id) JOIN f ON f.tx_id=he.tx_id GROUP BY 1), sr AS (SELECT *, row_number() OVER (ORDER BY p DESC, case_id) AS ml_rank FROM sc)
 SELECT case_id, queue_rank, ml_rank, round(p,6) AS ml_probability, CAST(floor(100*p) AS BIGINT) AS ml_score, queue_rank-ml_rank AS rank_delta FROM rq JOIN sr USING (case_id)""")
def j12_queue_scores(spark, sf_dir):
    """The rule queue with each case's model score (the highest of its evidence), rank by it, and how many places that moves it."""
    _, _, held = _rule_layers(spark, sf_dir)
    scores = held.join(transaction_layer(spark, sf_dir).select("tx_id", "ml_probability"), "tx_id").groupBy("case_id").agg(F.max("ml_probability").alias("ml_probability"))
    scores = A.ranked(scores, [F.desc("ml_probability"), F.asc("case_id")], -F.floor(F.col("ml_probability") * 100_000), "ml_rank")
    out = X.checked_join(_queue(spark, sf_dir), scores, ["case_id"], "left", "one_to_one")
    return out.select("case_id", "queue_rank", "ml_rank", F.round("ml_probability", 6).alias("ml_probability"), F.floor(F.col("ml_probability") * 100).alias("ml_score"), (F.col("queue_rank") - F.col("ml_rank")).alias("rank_delta"))


_TOKENS = {"Smurfing": "SCN_STRUCTURING_ROLLING", "Fan_Out": "SCN_FAN_OUT", "Structuring": "SCN_STRUCTURING_PROXY", "Fan_In": "SCN_FAN_IN"}
_INV = _F + _H + _FLAGS + _SCORED + """, iq AS (SELECT printf('INV-%010d', tx_id) AS Alert_id, ts AS Transaction_timestamp, Sender_account, Receiver_account, Amount, concat_ws(';', """ + ", ".join(f"CASE WHEN {k}=1 THEN '{t}' END" for t, k in _TOKENS.items()) + """) AS Triggered_scenarios, CAST(Scenario_score AS INT) AS Priority_score,
 CASE WHEN Scenario_score>=80 THEN 'HIGH' WHEN Scenario_score>=60 THEN 'MEDIUM' ELSE 'LOW' END AS Priority FROM w WHERE """ + " OR ".join(f"{k}=1" for k in _TOKENS.values()) + """),
 fa AS (SELECT * FROM iq WHERE Priority IN ('HIGH','MEDIUM') AND Priority_score>=70 AND list_has_any(string_split(Triggered_scenarios,';'), ['Fan_Out','Structuring']) AND (contains(CAST(Sender_account AS VARCHAR),'1') OR contains(CAST(Receiver_account AS VARCHAR),'1')))"""


def _filtered(spark, sf_dir):
    return A.filtered_alerts(A.investigation_queue(_v1(spark, sf_dir), _TOKENS), ("HIGH", "MEDIUM"), ("Fan_Out", "Structuring"), "1", 70)


@_query(_INV + " SELECT Alert_id, Sender_account, Receiver_account, Triggered_scenarios, Priority_score, Priority FROM fa")
def f6_f7_filtered_alerts(spark, sf_dir):
    """The investigation queue filtered by priority, least score, any of two scenarios, and a part of either account's number."""
    return _filtered(spark, sf_dir).select("Alert_id", "Sender_account", "Receiver_account", "Triggered_scenarios", "Priority_score", "Priority")


@_query(_INV + """ SELECT 'priority' AS part, p AS name, CAST(count(fa.Alert_id) AS DOUBLE) AS value FROM (SELECT unnest(['HIGH','MEDIUM','LOW']) AS p) LEFT JOIN fa ON Priority=p GROUP BY 2
 UNION ALL SELECT 'scenario', s, CAST(count(fa.Alert_id) AS DOUBLE) FROM (SELECT unnest(['Smurfing','Fan_Out','Structuring','Fan_In']) AS s) LEFT JOIN fa ON list_contains(string_split(Triggered_scenarios,';'), s) GROUP BY 2
 UNION ALL SELECT 'mean', 'Priority_score', round(avg(Priority_score),6) FROM fa""")
def a43_alert_overview(spark, sf_dir):
    return A.alert_overview(_filtered(spark, sf_dir), list(_TOKENS))


_REC = """ SELECT printf('{0}-%07d', row_number() OVER (ORDER BY ts, tx_id)) AS alert_id, '{0}' AS scenario_id, '{1}' AS scenario_name, CAST({2} AS VARCHAR) AS focal_account, ts AS alert_timestamp, {3} AS lookback_start, ts AS lookback_end, {4} AS transaction_count, {5} AS aggregate_amount, {6} AS unique_counterparties, {7} AS scenario_score, {8} AS reason FROM w WHERE {0}=1"""


@_query(_F + _H + _FLAGS + _SCORED + _REC.format("SCN_CROSS_BORDER_CURRENCY_MISMATCH", "Cross-border currency mismatch", "Sender_account", "CAST(NULL AS TIMESTAMP)", "CAST(1 AS BIGINT)", "Amount", "CAST(1 AS BIGINT)", "30", "Alert_reasons"))
def c1_alert_records(spark, sf_dir):
    return A.alert_records(_v1(spark, sf_dir), "SCN_CROSS_BORDER_CURRENCY_MISMATCH", "Cross-border currency mismatch", "SCN_CROSS_BORDER_CURRENCY_MISMATCH", 30)


@_query(_F + _H + _FLAGS + _SCORED + _REC.format("SCN_FAN_IN", "Multiple incoming counterparties", "Receiver_account", "ts - INTERVAL 24 HOURS", "rwc", "rwa", "CAST(rwu AS BIGINT)", "60", "'Multiple incoming counterparties'"))
def c2_alert_records(spark, sf_dir):
    return A.alert_records(_v1(spark, sf_dir), "SCN_FAN_IN", "Multiple incoming counterparties", "SCN_FAN_IN", 60, "Receiver_account", 24, ("Receiver_window_count", "Receiver_window_amount", "Receiver_window_unique"))


@_query(_RULES + " SELECT scenario_id, count(*) AS alerts, CAST(sum(n) AS BIGINT) AS triggering_transactions, count(DISTINCT acc) AS accounts FROM ra WHERE scenario_id IN ('SCN_FAN_OUT','SCN_STRUCTURING_PROXY') GROUP BY 1 HAVING count(*)>=2")
def c10_scenario_monitor(spark, sf_dir):
    """The scenario rollup, filtered to some scenarios with a least number of alerts."""
    return A.scenario_rollup(_rule_links(spark, sf_dir)).where(F.col("scenario_id").isin("SCN_FAN_OUT", "SCN_STRUCTURING_PROXY") & (F.col("alerts") >= 2))


@_query(" SELECT k AS \"Parameter\", v AS \"Value\", count(tx_id) AS rows_at_least FROM (SELECT unnest(['large_amount','structuring_amount','window_total']) AS k, unnest([CAST(50000 AS DOUBLE),10000,20000]) AS v) LEFT JOIN tx ON Amount>=v GROUP BY 1,2")
def d14_thresholds(spark, sf_dir):
    """The amounts of the configuration, and how many rows reach each; one pass over the rows."""
    limits = D.configuration(spark).where(F.col("Parameter").isin("large_amount", "structuring_amount", "window_total"))
    counts = transactions(spark, sf_dir).select("Amount").crossJoin(F.broadcast(limits)).groupBy("Parameter", "Value")  # three rows
    return counts.agg(F.count(F.when(F.col("Amount") >= F.col("Value"), 1)).alias("rows_at_least"))


@_query(" SELECT CAST(Is_laundering AS INT) AS Is_laundering, CAST(sum(CASE Is_laundering WHEN 1 THEN n ELSE least(n, 60) END) AS BIGINT) AS n FROM (SELECT tx_id // 250 AS b, Is_laundering, count(*) AS n FROM tx GROUP BY 1,2) GROUP BY 1")
def k2_all_labelled_rows(spark, sf_dir):
    """Rows that the sample keeps of each class: all labelled ones, at most 60 normal ones in each block of ids."""
    return P.block_sample(transactions(spark, sf_dir), 250, {0: 60, 1: 2**31 - 1}).groupBy("Is_laundering").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation and contracts

@_query(_F + """, e AS (SELECT 'RULE' AS engine, CAST(Amount>=20000 AS INT) AS a, Is_laundering AS y FROM f UNION ALL SELECT 'ML', CAST(ml AS INT), Is_laundering FROM f), c AS (SELECT engine, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(a) AS BIGINT) AS alerts, CAST(sum(a*y) AS BIGINT) AS hits FROM e GROUP BY 1),
 k AS (SELECT engine, n, positives, alerts, hits FROM c UNION ALL SELECT engine || ' changed', n, positives, alerts, alerts+1 FROM c)
 SELECT engine, n, positives, alerts, hits, hits AS tp, alerts-hits AS fp, positives-hits AS fn, n-positives-alerts+hits AS tn, round(hits/alerts,6) AS precision, round(hits/positives,6) AS recall, round(alerts/n,6) AS alert_rate, round(positives/n,6) AS prevalence, hits<=positives AND hits<=alerts AND positives<=n AND alerts<=n AND n-positives-alerts+hits>=0 AS valid FROM k""")
def a23_confusion(spark, sf_dir):
    """Matrices from counts, and from counts with more hits than alerts, which aren't valid."""
    rows = _ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int"))
    sums = lambda flag, name: rows.agg(F.lit(name).alias("engine"), F.count(F.lit(1)).alias("n"), F.sum("Is_laundering").alias("positives"), F.sum(flag).alias("alerts"), F.sum(F.col(flag) * F.col("Is_laundering")).alias("hits"))
    counts = sums("RULE", "RULE").unionByName(sums("ML_ALERT", "ML"))
    changed = counts.withColumns({"engine": F.concat("engine", F.lit(" changed")), "hits": F.col("alerts") + 1})
    return audit.confusion(counts.unionByName(changed))


@_query(_F + _CUM + """, e AS (SELECT 'Rule-Based' AS model, CAST(Amount>=20000 AS INT) AS a, Is_laundering AS y FROM f UNION ALL SELECT 'Machine Learning', CAST(ml AS INT), Is_laundering FROM f), q AS (SELECT model, count(*) AS n, CAST(sum(a) AS BIGINT) AS alerts, sum(a*y) AS tp, sum(y) AS pos FROM e GROUP BY 1),
 r AS (SELECT round(sum(p/pp*(cp/cn)),6) AS ap, round(sum((n-p)*(cp-p/2))/(max(pp)*(max(nn)-max(pp))),6) AS auc FROM c)
 SELECT model, round(tp/alerts,6) AS precision, round(tp/pos,6) AS recall, round(2*tp/(alerts+pos),6) AS f1, CASE WHEN model='Machine Learning' THEN auc END AS roc_auc, CASE WHEN model='Machine Learning' THEN ap END AS pr_auc, alerts, round(alerts/n,6) AS alert_rate FROM q, r""")
def a25_engine_comparison(spark, sf_dir):
    return E.compare_engines(_ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int")), "RULE", "ML_ALERT")


@_query(_F + """, c AS (SELECT Is_laundering AS y, CAST(ml AS INT) AS p FROM f), k AS (SELECT unnest([0,1]) AS class), r AS (SELECT class, CAST(sum(CAST(y=class AS INT)) AS BIGINT) AS support, sum(CAST(p=class AS INT)) AS got, sum(CAST(p=class AND y=class AS INT)) AS tp FROM c, k GROUP BY 1),
 m AS (SELECT class, support, tp, round(tp/got,6) AS pr, round(tp/support,6) AS re, round(2*tp/(got+support),6) AS f1 FROM r)
 SELECT CAST(class AS VARCHAR) AS "row", pr AS precision, re AS recall, f1, support FROM m UNION ALL SELECT 'accuracy', round(sum(tp)/sum(support),6), round(sum(tp)/sum(support),6), round(sum(tp)/sum(support),6), CAST(sum(support) AS BIGINT) FROM m
 UNION ALL SELECT 'macro avg', round(avg(pr),6), round(avg(re),6), round(avg(f1),6), CAST(sum(support) AS BIGINT) FROM m UNION ALL SELECT 'weighted avg', round(sum(pr*support)/sum(support),6), round(sum(re*support)/sum(support),6), round(sum(f1*support)/sum(support),6), CAST(sum(support) AS BIGINT) FROM m""")
def a26_full_report(spark, sf_dir):
    return E.full_report(_ml(spark, sf_dir), "ML_ALERT")


_SEVEN = ("n", "total", "median_amount", "counterparties", "hours", "cross_rate", "fx_rate")


@_query(_F + """, a AS (SELECT Laundering_type, CASE WHEN contains(Laundering_type,'Fan_In') THEN Receiver_account ELSE Sender_account END AS focal, count(*) AS n, sum(Amount) AS total, quantile_cont(Amount,0.5) AS median_amount, count(DISTINCT CASE WHEN contains(Laundering_type,'Fan_In') THEN Sender_account ELSE Receiver_account END) AS counterparties,
 round((epoch_us(max(ts))-epoch_us(min(ts)))/3.6e9,6) AS hours, avg(Cross_border) AS cross_rate, avg(Currency_mismatch) AS fx_rate FROM f WHERE contains(Laundering_type,'Fan') GROUP BY 1,2) SELECT Laundering_type, count(*) AS accounts, """ + ", ".join(f"round(quantile_cont({m},{q}),6) AS {m}_{n}" for m in _SEVEN for n, q in (("median", 0.5), ("p95", 0.95))) + " FROM a GROUP BY 1")
def a8_focal_seven_metrics(spark, sf_dir):
    return P.summarised(P.focal_profiles(_features(spark, sf_dir), _FAN), "Laundering_type", list(_SEVEN))


@_query(_F + """, e AS (SELECT 'given' AS rows, Is_laundering AS y, CAST(Amount>=20000 AS INT) AS r, CAST(ml AS INT) AS m FROM f UNION ALL SELECT 'without positives', 0, CAST(Amount>=20000 AS INT), CAST(ml AS INT) FROM f UNION ALL SELECT 'without alerts', Is_laundering, 0, 0 FROM f),
 c AS (SELECT rows, sum(y) AS y, sum(r) AS r, sum(m) AS m, sum(r*y) AS h FROM e GROUP BY 1), u AS (SELECT rows, unnest([{'k':'no_positives','n':y=0},{'k':'no_rule_alerts','n':r=0},{'k':'no_ml_alerts','n':m=0},{'k':'rule_hits_over_positives','n':h>y}]) AS z FROM c)
 SELECT rows, z.k AS "check", CAST(z.n AS BIGINT) AS n_bad FROM u""")
def c15_comparable(spark, sf_dir):
    """Whether rules and model can be compared: on the rows as they are, without positives, and without alerts."""
    rows = _ml(spark, sf_dir).withColumn("RULE", (F.col("Amount") >= 20_000).cast("int")).select("Is_laundering", "RULE", "ML_ALERT")
    cases = {"given": rows, "without positives": rows.withColumn("Is_laundering", F.lit(0)), "without alerts": rows.withColumns({"RULE": F.lit(0), "ML_ALERT": F.lit(0)})}
    out = None
    for name, df in cases.items():
        one = audit.comparable(df, "RULE", "ML_ALERT").select(F.lit(name).alias("rows"), "check", "n_bad")
        out = one if out is None else out.unionByName(one)
    return out


# --- models: trees aren't SQL, so tests hold their invariants

def _evaluated(spark, sf_dir, model):
    from ..operators import ml

    return ml.frozen_evaluation(X.written(_learning_rows(spark, sf_dir), "learning-rows"), model)


@_query(None)
def m8_decision_tree(spark, sf_dir):
    """Fitted on train, threshold set on development, evaluated once on holdout."""
    return _evaluated(spark, sf_dir, "decision_tree")


@_query(None)
def m4_random_forest(spark, sf_dir):
    return _evaluated(spark, sf_dir, "random_forest")


@_query(None)
def m5_boosted_trees(spark, sf_dir):
    return _evaluated(spark, sf_dir, "boosted_trees")


@_query(None)
def m7_feature_importance(spark, sf_dir):
    from ..operators import ml

    rows = X.written(_learning_rows(spark, sf_dir).where("split = 'train'"), "train-rows")
    return ml.importances(ml.fit(rows), rows)
