"""Detectors on windows of an account, evaluated on the rows that their flagged windows hold.

All settings of a grid are one mask of bits on a window. Masks go back to the rows by account and window, rows are summed up by
account and mask, and only those sums are spread over the settings: a pass over the rows whatever the size of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ratio
from .features import epoch_bucket


def bucket_of(ts: Column, days: int | None) -> Column:
    """The start of the window of ``ts``: of ``days`` days counted from 1970, or, None, its day. (A tuner's period of many days is often
    its day in truth, so both are offered.)"""
    return F.date_trunc("day", ts) if days is None else epoch_bucket(ts, days)


def masked(windows: DataFrame, settings: list[Column], name: str = "mask") -> DataFrame:
    """``windows`` with a long whose bit k says whether setting k holds; 63 settings at most. A null condition does not hold."""
    if not 0 < len(settings) <= 63:
        raise ValueError("1 to 63 settings")
    bit = lambda k, c: F.when(c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    out = bit(0, settings[0])
    for k, c in enumerate(settings[1:], 1):
        out = out.bitwiseOR(bit(k, c))
    return windows.withColumn(name, out)


def flagged_rows(rows: DataFrame, windows: DataFrame, account: str, bucket: str, mask: str = "mask") -> DataFrame:
    """``rows`` with the mask of their account's window; 0 where the window isn't flagged. Null accounts have no window."""
    hit = windows.where(F.col(mask) != 0).select(F.col(account).alias("_account"), F.col(bucket).alias("_bucket"), mask)
    out = rows.join(hit, (F.col(account) == F.col("_account")) & (F.col(bucket) == F.col("_bucket")), "left").drop("_account", "_bucket")
    return out.withColumn(mask, F.coalesce(mask, F.lit(0).cast("long")))


def evaluated(flagged: DataFrame, settings: int, account: str, target: Column, label: str = "Is_laundering", mask: str = "mask") -> DataFrame:
    """A row for each setting: rows that it triggers, labelled and target rows among them, rates, and the accounts with target rows
    that it hits. ``target`` marks the rows that count for recall, labelled ones of a typology."""
    y, z = F.coalesce(F.col(label), F.lit(0)).cast("long"), F.when(target, 1).otherwise(0).cast("long")
    sums = flagged.groupBy(account, mask).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(z).alias("z"))
    bits = F.filter(F.array(*(F.when(F.col(mask).bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(settings))), lambda k: k.isNotNull())
    each = sums.select(account, "n", "y", "z", F.explode(bits).alias("setting")).groupBy("setting", account).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("z").alias("z"))
    hit = each.groupBy("setting").agg(
        F.sum("n").alias("triggered"), F.sum("y").alias("aml_cases"), F.sum("z").alias("target_hits"), F.count(F.lit(1)).alias("flagged_accounts"), F.sum(F.when(F.col("z") > 0, 1).otherwise(0)).alias("hit_accounts"),
    )
    whole = sums.groupBy(account).agg(F.sum("n").alias("n"), F.sum("z").alias("z")).agg(F.sum("n").alias("_n"), F.coalesce(F.sum("z"), F.lit(0)).alias("target_cases"), F.coalesce(F.sum(F.when(F.col(account).isNotNull() & (F.col("z") > 0), 1).otherwise(0)), F.lit(0)).alias("target_accounts"))
    out = flagged.sparkSession.range(settings).select(F.col("id").cast("int").alias("setting")).join(F.broadcast(hit), "setting", "left").crossJoin(F.broadcast(whole))  # settings; one row
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumns({c: zero(c) for c in ("triggered", "aml_cases", "target_hits", "flagged_accounts", "hit_accounts", "target_cases", "target_accounts")})
    rate = lambda a, b, name: F.round(ratio(F.col(a), F.col(b)), 6).alias(name)
    return out.select(
        "setting", "triggered", rate("triggered", "_n", "trigger_rate"), "aml_cases", rate("aml_cases", "triggered", "precision"), "target_cases", "target_hits", rate("target_hits", "target_cases", "target_recall"),
        "flagged_accounts", "target_accounts", "hit_accounts", rate("hit_accounts", "target_accounts", "account_recall"),
    )


def window_features(rows: DataFrame, account: str, other: str, bucket: str = "bucket") -> DataFrame:
    """One row per account and window, null accounts left out: n, median_amount, total, unique_others and rates."""
    return rows.where(F.col(account).isNotNull()).groupBy(bucket, account).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("Amount", 0.5).alias("median_amount"), F.sum("Amount").alias("total"), F.countDistinct(other).alias("unique_others"), F.avg("Cross_border").alias("cross_rate"), F.avg("Currency_mismatch").alias("fx_rate"),
    )


def account_grid(rows: DataFrame, account: str, other: str, days: int | None, settings: list[Column], typology: str) -> DataFrame:
    """``evaluated`` for conditions on ``window_features``: flagged windows go back to the rows."""
    x = rows.withColumn("bucket", bucket_of(F.col("ts"), days))
    windows = masked(window_features(x, account, other), settings)
    return evaluated(flagged_rows(x, windows, account, "bucket"), len(settings), account, (F.col("Is_laundering") == 1) & (F.col("Laundering_type") == typology))
