"""Audits: tables of (check, n_bad), computed in one pass over the rows where a check needs no grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _counts(df: DataFrame, checks: dict) -> DataFrame:
    one = df.agg(*(F.count(F.when(bad, 1)).alias(name) for name, bad in checks.items()))
    return one.unpivot([], list(checks), "check", "n_bad")


def evidence(rows: DataFrame, threshold: float, score: str = "ml_probability", flag: str = "ML_ALERT", label: str = "Is_laundering", key: str = "tx_id") -> DataFrame:
    """Whether scored rows can be evidence: no nulls, binary labels, scores in [0, 1], flags as the threshold says, unique ids."""
    out = _counts(rows, {
        "null_transaction_id": F.col(key).isNull(), "null_label": F.col(label).isNull(), "null_probability": F.col(score).isNull(), "label_not_binary": ~F.col(label).isin(0, 1),
        "probability_out_of_range": ~F.col(score).between(0, 1) | F.isnan(score), "flag_against_threshold": F.col(flag) != (F.col(score) >= threshold).cast("int"),
    })
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n_bad"))
    return out.unionByName(twice.select(F.lit("repeated_transaction_id").alias("check"), "n_bad"))


def confusion(counts: DataFrame) -> DataFrame:
    """The confusion matrix and ratios of rows of whole counts (n, positives, alerts, hits), and whether those agree with each other."""
    tp, fp, fn = F.col("hits"), F.col("alerts") - F.col("hits"), F.col("positives") - F.col("hits")
    tn = F.col("n") - F.col("positives") - fp
    some = [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in ("n", "positives", "alerts", "hits")]
    valid = some[0] & some[1] & some[2] & some[3] & (tp <= F.col("positives")) & (F.col("positives") <= F.col("n")) & (tp <= F.col("alerts")) & (F.col("alerts") <= F.col("n")) & (tn >= 0)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return counts.select(
        "*", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, F.col("alerts")).alias("precision"), ratio(tp, F.col("positives")).alias("recall"),
        ratio(F.col("alerts"), F.col("n")).alias("alert_rate"), ratio(F.col("positives"), F.col("n")).alias("prevalence"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def require_valid(counts: DataFrame) -> DataFrame:
    """``confusion``, but ValueError where a row's counts contradict each other."""
    out = confusion(counts)
    if not out.where("NOT valid").isEmpty():
        raise ValueError("inconsistent positive, alert or hit counts")
    return out


#: Names of a published table of metrics (fixed values) and what they are called here.
PUBLISHED = {"HOLDOUT transactions": "n", "AML positives": "positives", "Flagged transactions": "alerts", "AML hits": "hits", "Precision": "precision", "Recall": "recall", "Alert rate": "alert_rate"}


def summary(published: DataFrame, detectors: list[str], tolerance: float = 2e-6) -> DataFrame:
    """A published table, one row a Metric and one column a detector, against the ratios that its own counts give.

    (detector, metric, published, recomputed, agrees); a metric that is missing agrees with nothing.
    """
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(f"`{d}`").cast("double").alias("value")) for d in detectors))).alias("x")
    wide = published.select("Metric", each).groupBy("x.detector").agg(*(F.max(F.when(F.col("Metric") == m, F.col("x.value"))).alias(f"p_{c}" if c in ("precision", "recall", "alert_rate") else c) for m, c in PUBLISHED.items()))
    again = confusion(wide.withColumns({c: F.col(c).cast("long") for c in ("n", "positives", "alerts", "hits")}))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"p_{c}").alias("published"), F.col(c).alias("recomputed")) for c in ("precision", "recall", "alert_rate")))).alias("y")
    return again.select("detector", "valid", rows).select("detector", "y.*", (F.col("valid") & F.coalesce(F.abs(F.col("y.published") - F.col("y.recomputed")) <= tolerance, F.lit(False))).alias("agrees"))


def leaks(tx: DataFrame, split: str = "split") -> DataFrame:
    """(check, n_bad): train rows at or after the first development row, development rows at or after the first holdout row."""
    first = lambda p: F.min(F.when(F.col(split) == p, F.col("ts")))
    starts = tx.agg(first("development").alias("_d"), first("holdout").alias("_h"))
    return _counts(tx.crossJoin(F.broadcast(starts)), {"train_after_development": (F.col(split) == "train") & (F.col("ts") >= F.col("_d")), "development_after_holdout": (F.col(split) == "development") & (F.col("ts") >= F.col("_h"))})


def comparable(rows: DataFrame, rule: str, ml: str, label: str = "Is_laundering") -> DataFrame:
    """(check, n_bad): whether rule and model can be compared: some positives, some alerts of each, no more rule hits than positives."""
    one = rows.agg(F.sum(label).alias("y"), F.sum(rule).alias("r"), F.sum(ml).alias("m"), F.sum(F.col(rule) * F.col(label)).alias("h"))
    none = lambda c: (F.coalesce(F.col(c), F.lit(0)) == 0).cast("long")
    checks = {"no_positives": none("y"), "no_rule_alerts": none("r"), "no_ml_alerts": none("m"), "rule_hits_over_positives": F.coalesce((F.col("h") > F.col("y")).cast("long"), F.lit(0))}
    return one.select(*(v.cast("long").alias(k) for k, v in checks.items())).unpivot([], list(checks), "check", "n_bad")


def require_none(violations: DataFrame) -> DataFrame:
    """The table of violations, but ValueError if any check found one; a few rows."""
    bad = [r.check for r in violations.where("n_bad > 0").collect()]
    if bad:
        raise ValueError(f"violated: {', '.join(sorted(bad))}")
    return violations


def temporal(tx: DataFrame, split: DataFrame, periods: tuple[str, ...] = ("train", "development", "holdout")) -> DataFrame:
    """Dates that are none, and periods without rows."""
    bad = _counts(tx, {"unparseable_dates": F.try_to_timestamp("Date").isNull()})
    seen = split.agg(*(F.count(F.when(F.col("split") == p, 1)).alias(p) for p in periods))
    empty = sum(((F.col(p) == 0).cast("long") for p in periods), F.lit(0).cast("long"))
    return bad.unionByName(seen.select(F.lit("empty_periods").alias("check"), empty.alias("n_bad")))
