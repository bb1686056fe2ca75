"""Grids of the first tuner on account windows: by day, as its periods come out, and by whole periods; evaluated on rows and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as W, scenarios as D
from .registry import _F, _features, _query

_SMURFING = [(n, m, t) for n in (5, 8, 10, 12) for m in (3_000.0, 4_000.0, 5_000.0) for t in (15_000.0, 25_000.0, 40_000.0)]
_FAN_OUT = [(a, b, g) for a in (5, 6, 7, 8) for b in (10, 12) for g in (0.2, 0.3, 0.4)]


def _sql(days: int, axes: str, keys: str, condition: str, typology: str) -> str:
    """Rows of flagged windows, joined back, for both kinds of windows."""
    place = f"CASE kind WHEN 'day' THEN date_trunc('day', ts) ELSE time_bucket(INTERVAL '{days} days', ts, TIMESTAMP '1970-01-01') END"
    return f"""{_F}, k AS (SELECT f.*, kind, {place} AS bk FROM f, (SELECT unnest(['day','{days} days']) AS kind)),
 o AS (SELECT kind, bk, Sender_account AS acc, count(*) AS n, quantile_cont(Amount,0.5) AS md, sum(Amount) AS t, count(DISTINCT Receiver_account) AS u, avg(Cross_border) AS c, avg(Currency_mismatch) AS x FROM k GROUP BY ALL),
 g AS (SELECT * FROM {axes}), hit AS (SELECT k.kind, {keys}, k.Sender_account AS acc, Is_laundering AS y, CAST(Is_laundering=1 AND Laundering_type='{typology}' AS INT) AS z FROM g JOIN o ON {condition} JOIN k ON k.kind=o.kind AND k.bk=o.bk AND k.Sender_account=o.acc),
 s AS (SELECT kind, {keys}, count(*) AS triggered, sum(y) AS y, sum(z) AS z, count(DISTINCT acc) AS fa, count(DISTINCT CASE WHEN z=1 THEN acc END) AS ha FROM hit GROUP BY ALL),
 w AS (SELECT count(*) AS n, sum(CAST(Is_laundering=1 AND Laundering_type='{typology}' AS INT)) AS tc, count(DISTINCT CASE WHEN Is_laundering=1 AND Laundering_type='{typology}' THEN Sender_account END) AS ta FROM f),
 e AS (SELECT kind, {keys}, coalesce(triggered,0) AS triggered, CAST(coalesce(y,0) AS BIGINT) AS aml_cases, CAST(coalesce(z,0) AS BIGINT) AS target_hits, coalesce(fa,0) AS flagged_accounts, coalesce(ha,0) AS hit_accounts, n, CAST(tc AS BIGINT) AS target_cases, ta AS target_accounts FROM (SELECT unnest(['day','{days} days']) AS kind) CROSS JOIN g CROSS JOIN w LEFT JOIN s USING (kind, {keys}))
 SELECT kind AS "window", {keys}, triggered, round(triggered/n,6) AS trigger_rate, aml_cases, round(coalesce(aml_cases/nullif(triggered,0),0),6) AS precision, target_cases, target_hits, round(coalesce(target_hits/nullif(target_cases,0),0),6) AS target_recall, flagged_accounts, target_accounts, hit_accounts, round(coalesce(hit_accounts/nullif(target_accounts,0),0),6) AS account_recall FROM e"""


def _grid(spark, sf_dir, days: int, settings: list, conditions: list, keys: str, typology: str):
    """Both kinds of windows, sorted as the tuner sorts: by recall, then precision."""
    rows, out = _features(spark, sf_dir), None
    table = F.broadcast(spark.createDataFrame([(i, *s) for i, s in enumerate(settings)], f"setting int, {keys}"))
    for kind, length in (("day", None), (f"{days} days", days)):
        found = W.account_grid(rows, "Sender_account", "Receiver_account", length, conditions, typology).join(table, "setting").withColumn("window", F.lit(kind)).drop("setting")
        out = found if out is None else out.unionByName(found)
    return out.orderBy("window", F.desc("target_recall"), F.desc("precision"))


@_query(_sql(60, "(SELECT unnest([5,8,10,12]) AS min_count), (SELECT CAST(unnest([3000,4000,5000]) AS DOUBLE) AS median_ceiling), (SELECT CAST(unnest([15000,25000,40000]) AS DOUBLE) AS aggregate_floor)", "min_count, median_ceiling, aggregate_floor", "o.n>=min_count AND o.md<median_ceiling AND o.t>=aggregate_floor AND o.u<=3 AND o.c<=0.10 AND o.x<=0.10", "Smurfing"))
def g1_smurfing_account_windows(spark, sf_dir):
    """36 settings on days and on windows of 60 days."""
    few = (F.col("cross_rate") <= 0.10) & (F.col("fx_rate") <= 0.10) & (F.col("unique_others") <= 3)
    conditions = [(F.col("n") >= n) & (F.col("median_amount") < m) & (F.col("total") >= t) & few for n, m, t in _SMURFING]
    return _grid(spark, sf_dir, 60, _SMURFING, conditions, "min_count int, median_ceiling double, aggregate_floor double", "Smurfing")


@_query(_sql(10, "(SELECT unnest([5,6,7,8]) AS min_counterparties), (SELECT unnest([10,12]) AS max_counterparties), (SELECT unnest([CAST(0.2 AS DOUBLE),0.3,0.4]) AS geo_fx_threshold)", "min_counterparties, max_counterparties, geo_fx_threshold", "o.u BETWEEN min_counterparties AND max_counterparties AND o.n BETWEEN min_counterparties AND 20 AND (o.c>=geo_fx_threshold OR o.x>=geo_fx_threshold)", "Fan_Out"))
def g2_fan_out_account_windows(spark, sf_dir):
    """24 settings on days and on windows of 10 days."""
    conditions = [F.col("unique_others").between(a, b) & F.col("n").between(a, 20) & D.risky(g, g) for a, b, g in _FAN_OUT]
    return _grid(spark, sf_dir, 10, _FAN_OUT, conditions, "min_counterparties int, max_counterparties int, geo_fx_threshold double", "Fan_Out")


@_query(_sql(10, "(SELECT unnest([2,3]) AS min_count)", "min_count", "o.n>=min_count AND o.t>=2000 AND o.u<=2", "Smurfing"))
def a19_account_windows(spark, sf_dir):
    """Loose detectors, which flag windows of this table too."""
    conditions = [(F.col("n") >= n) & (F.col("total") >= 2_000) & (F.col("unique_others") <= 2) for n in (2, 3)]
    return _grid(spark, sf_dir, 10, [(2,), (3,)], conditions, "min_count int", "Smurfing")
