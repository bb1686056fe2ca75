"""Evaluation of detectors against labels, in single passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import band_label, ratio, score_band


def flag_summary(df: DataFrame, flags: list[str], label: str = "Is_laundering") -> DataFrame:
    """One row per flag: rows triggered, rate, labelled among them, precision and recall. One pass over ``df``."""
    sums = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).alias("positives")]
    for f in flags:
        sums += [F.coalesce(F.sum(f), F.lit(0)).alias(f"t_{f}"), F.coalesce(F.sum(F.col(f) * F.col(label)), F.lit(0)).alias(f"p_{f}")]
    one = df.agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("scenario"), F.col(f"t_{f}").alias("triggered"), F.col(f"p_{f}").alias("hits")) for f in flags)))
    out = one.select("rows", "positives", each.alias("x")).select("rows", "positives", "x.*")
    return out.select("scenario", "triggered", "hits", F.round(ratio(F.col("triggered"), F.col("rows")), 6).alias("trigger_rate"), F.round(ratio(F.col("hits"), F.col("triggered")), 6).alias("precision"), F.round(ratio(F.col("hits"), F.col("positives")), 6).alias("recall"))


def coverage(df: DataFrame, flags: list[str], by: str = "Laundering_type") -> DataFrame:
    """Share of each typology's rows that each flag, and any flag, hits."""
    every = F.greatest(*flags) if len(flags) > 1 else F.col(flags[0])
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(f), 6).alias(f) for f in flags), F.round(F.avg(every), 6).alias("any_flag"))


def binary_metrics(df: DataFrame, predicted: str, engine: str, label: str = "Is_laundering") -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(predicted) * F.col(label)).alias("tp"), F.sum(predicted).alias("alerts"), F.sum(label).alias("positives"))
    p, r = ratio(F.col("tp"), F.col("alerts")), ratio(F.col("tp"), F.col("positives"))
    return one.select(
        F.lit(engine).alias("engine"), "alerts", "tp", (F.col("alerts") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"), (F.col("rows") - F.col("alerts") - F.col("positives") + F.col("tp")).alias("tn"),
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round(ratio(F.col("alerts"), F.col("rows")), 6).alias("alert_rate"),
    )


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4), score: str = "ml_probability", label: str = "Is_laundering") -> DataFrame:
    """Confusion counts at each threshold, in one pass."""
    grid = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    hit = (F.col(score) >= F.col("threshold")).cast("int")
    return df.select(score, label, grid).groupBy("threshold").agg(F.sum(hit).alias("alerts"), F.sum(hit * F.col(label)).alias("tp"), F.sum((1 - hit) * F.col(label)).alias("fn"))


def cumulative_scores(df: DataFrame, score: str, label: str, parts: int = 64) -> DataFrame:
    """Per distinct score s: rows n, labelled p, and the rows cn and labelled cp with that score or more; all_n and all_p are totals.

    Rows are first summed per distinct score. Prefix sums go over bands of scores, so no task holds them all: a band has
    its own running sums and adds the totals of the bands above, of which there are ``parts``.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("p"))
    bounds = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    by = by.crossJoin(F.broadcast(bounds)).withColumn("band", F.least(F.floor((F.col("s") - F.col("lo")) / width * parts), F.lit(parts - 1)))
    bands = by.groupBy("band").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows
    whole = Window.partitionBy(F.lit(1))
    bands = bands.select("band", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.sum("bn").over(whole).alias("all_n"), F.sum("bp").over(whole).alias("all_p"))
    run = Window.partitionBy("band").orderBy(F.desc("s"))
    return by.join(F.broadcast(bands), "band").withColumns({"cn": F.col("n0") + F.sum("n").over(run), "cp": F.col("p0") + F.sum("p").over(run)})


def ranking_metrics(df: DataFrame, score: str = "ml_probability", label: str = "Is_laundering") -> DataFrame:
    """Exact ROC-AUC and average precision (step sum)."""
    rows, negatives = cumulative_scores(df, score, label), F.col("n") - F.col("p")
    return rows.agg(
        F.round(F.sum(F.col("p") / F.col("all_p") * (F.col("cp") / F.col("cn"))), 6).alias("average_precision"),
        F.round(F.sum(negatives * (F.col("cp") - F.col("p") / 2)) / (F.first("all_p") * (F.first("all_n") - F.first("all_p"))), 6).alias("roc_auc"),
    )


def operating_points(df: DataFrame, rates: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1), score: str = "ml_probability", label: str = "Is_laundering") -> DataFrame:
    """For each alert rate r the score of the ceil(r n)-th highest row, and what alerts at that score or more give."""
    rows = cumulative_scores(df, score, label).withColumn("target_rate", F.explode(F.array(*(F.lit(r) for r in rates))))
    rows = rows.where(F.col("cn") >= F.ceil(F.col("target_rate") * F.col("all_n")))
    least = rows.groupBy("target_rate").agg(F.min(F.struct("cn", "s", "cp", "all_p")).alias("x"))
    return least.select("target_rate", F.col("x.s").alias("threshold"), F.col("x.cn").alias("alerts"), F.round(ratio(F.col("x.cp"), F.col("x.cn")), 6).alias("precision"), F.round(ratio(F.col("x.cp"), F.col("x.all_p")), 6).alias("recall"))


def score_bands(df: DataFrame, score: str = "ml_probability") -> DataFrame:
    return df.groupBy(score_band(F.col(score)).alias("band")).count().select("band", band_label(F.col("band")).alias("label"), F.col("count").alias("n"))


def overlap(df: DataFrame, rule: str, ml: str, label: str = "Is_laundering") -> DataFrame:
    a, b = F.col(rule) == 1, F.col(ml) == 1
    group = F.when(a & b, "both").when(a, "rule_only").when(b, "ml_only").otherwise("neither")
    return df.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("transactions"), F.sum(label).alias("aml_positives"))


def classification_report(df: DataFrame, predicted: str, label: str = "Is_laundering") -> DataFrame:
    """Per class: support, precision, recall, F1; and the accuracy. One pass to the four counts."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.withColumn("class", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("class").agg(
        *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("support", F.col("y") == F.col("class")), ("_got", F.col("p") == F.col("class")), ("_tp", (F.col("p") == F.col("class")) & (F.col("y") == F.col("class"))))),
    )
    whole = Window.partitionBy(F.lit(1))  # two rows
    tp = F.col("_tp")
    return each.select(
        "class", "support", F.round(ratio(tp, F.col("_got")), 6).alias("precision"), F.round(ratio(tp, F.col("support")), 6).alias("recall"), F.round(ratio(2 * tp, F.col("_got") + F.col("support")), 6).alias("f1"),
        F.round(F.sum("_tp").over(whole) / F.sum("support").over(whole), 6).alias("accuracy"),
    )


def full_report(df: DataFrame, predicted: str, label: str = "Is_laundering") -> DataFrame:
    """``classification_report`` as rows: each class, accuracy, macro and weighted averages."""
    one = classification_report(df, predicted, label)
    total = F.sum("support")
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / total, 6).alias(c)
    acc = F.round(F.max("accuracy"), 6)
    parts = [
        one.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support"),
        one.agg(F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support")),
        one.agg(F.lit("macro avg").alias("row"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")), total.alias("support")),
        one.agg(F.lit("weighted avg").alias("row"), *(weighted(c) for c in ("precision", "recall", "f1")), total.alias("support")),
    ]
    return reduce(DataFrame.unionByName, parts)


def compare_engines(df: DataFrame, rule: str, ml: str, score: str = "ml_probability") -> DataFrame:
    """Rules and model on the same rows; only the model has a score to rank by."""
    rules = binary_metrics(df, rule, "Rule-Based").withColumns({"roc_auc": F.lit(None).cast("double"), "pr_auc": F.lit(None).cast("double")})
    model = binary_metrics(df, ml, "Machine Learning").crossJoin(ranking_metrics(df, score).withColumnRenamed("average_precision", "pr_auc"))
    return rules.unionByName(model).select(F.col("engine").alias("model"), "precision", "recall", "f1", "roc_auc", "pr_auc", "alerts", "alert_rate")


def indicators(df: DataFrame, flag: str, baseline: str, label: str = "Is_laundering") -> DataFrame:
    """One row: counts, rates, and how many alerts fewer than the baseline raises."""
    one = df.agg(F.count(F.lit(1)).alias("transactions"), F.sum(flag).alias("alerts"), F.sum(label).alias("positives"), F.sum(F.col(flag) * F.col(label)).alias("hits"), F.sum(baseline).alias("_base"))
    return one.select(
        "transactions", "alerts", "positives", "hits", F.round(ratio(F.col("alerts"), F.col("transactions")), 6).alias("alert_rate"), F.round(ratio(F.col("hits"), F.col("alerts")), 6).alias("precision"),
        F.round(ratio(F.col("hits"), F.col("positives")), 6).alias("recall"), F.round(1 - ratio(F.col("alerts"), F.col("_base")), 6).alias("workload_reduction"),
    )


def account_recall(df: DataFrame, flag: str, account: str = "Sender_account", label: str = "Is_laundering") -> DataFrame:
    """Rows and distinct accounts that a flag hits. Accounts are summed up first, so no distinct set is held."""
    hit, y = F.col(flag) == 1, F.col(label) == 1
    a = df.groupBy(account).agg(F.sum(flag).alias("t"), F.sum(F.col(flag) * F.col(label)).alias("h"), F.max(hit.cast("int")).alias("at"), F.max(y.cast("int")).alias("ay"), F.max((hit & y).cast("int")).alias("ah"))
    one = a.agg(F.sum("t").alias("triggered"), F.sum("h").alias("hits"), F.sum("at").alias("triggered_accounts"), F.sum("ay").alias("target_accounts"), F.sum("ah").alias("hit_accounts"))
    return one.withColumn("account_recall", F.round(ratio(F.col("hit_accounts"), F.col("target_accounts")), 6))


def combined(df: DataFrame, a: str, b: str, label: str = "Is_laundering") -> DataFrame:
    """Alerts of two detectors, of both and of either, and labelled rows among the latter."""
    either = F.greatest(a, b)
    return df.agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(F.col(a) * F.col(b)).alias("both"), F.sum(either).alias("either"), F.sum(either * F.col(label)).alias("hits"))


def combined_variants(df: DataFrame, first: str, variants: dict, label: str = "Is_laundering") -> DataFrame:
    """The flag ``first`` with each variant of a second one: alerts of both, overlap, union, hits and rates. One pass."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("v"), c.cast("int").alias("f")) for k, c in variants.items()))).alias("z")
    x = df.select(F.col(first).alias("a"), F.col(label).alias("y"), each).select("a", "y", F.col("z.v").alias("FanOut_variant"), F.col("z.f").alias("b")).withColumn("e", F.greatest("a", "b"))
    s = lambda c, name: F.sum(c).alias(name)
    one = x.groupBy("FanOut_variant").agg(s("a", "Smurfing_alerts"), s("b", "FanOut_alerts"), s(F.col("a") * F.col("b"), "Overlapping_alerts"), s("e", "Combined_alerts"), s("y", "AML_transactions"), s(F.col("e") * F.col("y"), "AML_hits"), F.count(F.lit(1)).alias("_n"))
    r = lambda a, b, name: F.round(ratio(F.col(a), F.col(b)), 6).alias(name)
    return one.select("FanOut_variant", "Smurfing_alerts", "FanOut_alerts", "Overlapping_alerts", "Combined_alerts", "AML_transactions", "AML_hits", r("Combined_alerts", "_n", "Alert_rate"), r("AML_hits", "Combined_alerts", "Precision"), r("AML_hits", "AML_transactions", "Overall_AML_recall"))
