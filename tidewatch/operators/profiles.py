"""Profiles of transactions, chronological splits and parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import ratio
from .quantiles import percentiles

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def value_counts(tx: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n, share) of several columns in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    out = tx.select(each).select("x.*").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dimension")), 6))


def with_percentiles(groups: DataFrame, rows: DataFrame, by: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """``groups``, one row for each value of ``by``, and p25, p50, ... of ``value`` over ``rows``."""
    q = percentiles(rows, by, value, at)
    return groups.join(q, by, "left").select(*groups.columns, *(F.round(F.col("q")[i], 6).alias(f"p{int(v * 100)}") for i, v in enumerate(at)))


def typology_profile(tx: DataFrame, by: str = "Laundering_type") -> DataFrame:
    tx = tx.where(F.col(by).isNotNull())
    out = tx.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("Amount"), 6).alias("mean"), F.round(F.stddev_pop("Amount"), 4).alias("std"), F.min("Amount").alias("min"), F.max("Amount").alias("max"),
        *(F.round(F.avg(c), 6).alias(f"{c}_rate") for c in ("Cross_border", "Currency_mismatch", "Is_night", "Is_weekend")), F.countDistinct("Sender_account").alias("senders"), F.countDistinct("Receiver_account").alias("receivers"),
    )
    return with_percentiles(out, tx, [by], "Amount", QUANTILES)


def focal_accounts(tx: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row per typology and focal account: the receiver of fan-in types, the sender of the others."""
    into = F.col("Laundering_type").contains("Fan_In")
    x = tx.where(F.col("Laundering_type").isin(*kinds)).withColumns({"focal": F.when(into, F.col("Receiver_account")).otherwise(F.col("Sender_account")), "other": F.when(into, F.col("Sender_account")).otherwise(F.col("Receiver_account"))})
    return x.groupBy("Laundering_type", "focal").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total"), F.countDistinct("other").alias("counterparties"), F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9, 6).alias("hours"))


def focal_profiles(tx: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``focal_accounts`` with the median amount, rates and direction of each."""
    into = F.col("Laundering_type").contains("Fan_In")
    x = tx.where(F.col("Laundering_type").isin(*kinds)).withColumn("focal", F.when(into, F.col("Receiver_account")).otherwise(F.col("Sender_account")))
    more = x.groupBy("Laundering_type", "focal").agg(F.percentile("Amount", 0.5).alias("median_amount"), F.avg("Cross_border").alias("cross_rate"), F.avg("Currency_mismatch").alias("fx_rate"))
    return focal_accounts(tx, kinds).join(more, ["Laundering_type", "focal"]).withColumn("direction", F.when(into, "in").otherwise("out"))


def summarised(accounts: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Median and 95th percentile of each metric."""
    aggs = [F.round(F.percentile(m, q), 6).alias(f"{m}_{n}") for m in metrics for n, q in (("median", 0.5), ("p95", 0.95))]
    return accounts.groupBy(by).agg(F.count(F.lit(1)).alias("accounts"), *aggs)


def daily(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("transactions"), F.sum("Is_laundering").alias("aml"))


def boundaries(days: DataFrame, train: float = 0.6, development: float = 0.2) -> DataFrame:
    """One row: the last days of train and development, by cumulative share of transactions."""
    if not (0 < train < 1 and 0 < development < 1 and train + development < 1):
        raise ValueError("shares must be positive and leave a holdout")
    run = Window.orderBy("day")  # one row a day
    c = days.withColumns({"cum": F.sum("transactions").over(run), "total": F.sum("transactions").over(Window.partitionBy(F.lit(1)))})
    at = lambda share: F.min(F.when(F.col("cum") >= F.lit(share) * F.col("total"), F.col("day")))
    return c.agg(at(train).alias("train_end"), at(train + development).alias("development_end"))


def require_periods(tx: DataFrame, periods: tuple[str, ...] = ("train", "development", "holdout")) -> DataFrame:
    """``tx`` with a split; ValueError unless every period has rows."""
    found = {r[0] for r in tx.select("split").distinct().collect()}  # a few names
    if not set(periods) <= found:
        raise ValueError(f"periods without rows: {', '.join(sorted(set(periods) - found))}")
    return tx


def with_split(tx: DataFrame, bounds: DataFrame) -> DataFrame:
    day = F.to_date("ts")
    return tx.crossJoin(F.broadcast(bounds)).withColumn("split", F.when(day <= F.col("train_end"), "train").when(day <= F.col("development_end"), "development").otherwise("holdout")).drop("train_end", "development_end")


def parse_dates(rows: DataFrame, column: str = "Date") -> DataFrame:
    """Dates at midnight; a text that is none raises ValueError."""
    out = rows.withColumn(column, F.to_date(F.try_to_timestamp(column)))
    bad = rows.where(F.try_to_timestamp(column).isNull()).agg(F.count(F.lit(1))).first()[0]
    if bad:
        raise ValueError(f"Unparseable Date in {bad} rows")
    return out


def require_parsed(rows: DataFrame, column: str) -> DataFrame:
    """``rows``; ValueError if ``column`` has a null."""
    if not rows.where(F.col(column).isNull()).isEmpty():
        raise ValueError(f"unparseable values remain in {column}")
    return rows


def block_sample(tx: DataFrame, block: int, most: dict[int, int], seed: int = 42) -> DataFrame:
    """At most most[label] rows of each label in each block of ids, by a seeded hash."""
    x = tx.withColumn("block", F.expr(f"tx_id DIV {block}"))
    order = Window.partitionBy("block", "Is_laundering").orderBy(F.xxhash64(F.lit(seed), "tx_id"), "tx_id")
    limit = reduce(lambda c, kv: F.when(F.col("Is_laundering") == kv[0], kv[1]).otherwise(c), most.items(), F.lit(0))
    return x.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n", "block")


def overview(tx: DataFrame) -> DataFrame:
    """(column, nulls) of each column."""
    one = tx.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in tx.columns))
    return one.unpivot([], tx.columns, "column", "nulls")


def dataset_overview(tx: DataFrame, label: str = "Is_laundering") -> DataFrame:
    """(part, name, value): the type and number of nulls of each column, rows that repeat an earlier one, and the share of each class in percent."""
    kinds = dict(tx.dtypes)
    nulls = overview(tx).select(F.lit("nulls").alias("part"), F.col("column").alias("name"), F.col("nulls").cast("double").alias("value"))
    types = tx.sparkSession.createDataFrame([("type " + kinds[c], c, None) for c in tx.columns], "part string, name string, value double")
    twice = tx.groupBy(F.xxhash64(*tx.columns), F.xxhash64(*tx.columns, F.lit(1))).agg((F.count(F.lit(1)) - 1).alias("n"))  # two hashes of 64 bits stand for a row
    repeated = twice.agg(F.lit("duplicates").alias("part"), F.lit("rows").alias("name"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value"))
    classes = class_distribution(tx, label).select(F.lit("class percent").alias("part"), F.col(label).cast("string").alias("name"), F.col("percent").alias("value"))
    return nulls.unionByName(types).unionByName(repeated).unionByName(classes)


def grid(spark: SparkSession, **axes: tuple) -> DataFrame:
    """All combinations of the values; one row each."""
    rows: list[dict] = [{}]
    for k, values in axes.items():
        rows = [{**r, k: v} for r in rows for v in values]
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(axes))


def at_least(c: Column | str, thresholds: tuple) -> Column:
    """The highest threshold that ``c`` reaches; null below all. ``c >= t`` is the same as ``at_least(c) >= t`` for each of them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(*(F.when(c >= t, F.lit(t)) for t in thresholds), F.lit(None))


def below(c: Column | str, thresholds: tuple) -> Column:
    """The lowest threshold that ``c`` is under; null above all. ``c < t`` is the same as ``below(c) <= t`` for each of them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.least(*(F.when(c < t, F.lit(t)) for t in thresholds), F.lit(None))


def cells(windows: DataFrame, **axes: Column) -> DataFrame:
    """Sums of dev_transactions, dev_aml and dev_target for each combination of the axes' values.

    With axes snapped to the thresholds of a grid there are at most as many rows as the grid has, and a grid is evaluated
    on them instead of on every window.
    """
    return windows.groupBy(*(c.alias(k) for k, c in axes.items())).agg(*(F.sum(c).alias(c) for c in ("dev_transactions", "dev_aml", "dev_target")), F.count(F.lit(1)).alias("windows"))


def evaluate_grid(windows: DataFrame, params: DataFrame, condition: Column, per: str | None = None) -> DataFrame:
    """Evaluates every parameter row (a few hundred) on ``cells``, or on pre-aggregated windows, in one pass.

    ``per`` names a column of both that splits the rows, such as the length of the windows; ``params`` has it as ``per``,
    ``windows`` as ``cell_per``. Rates are of the rows with the same value.
    """
    keys = params.columns
    if per:
        condition = (F.col(per) == F.col(f"cell_{per}")) & condition
    weight = F.col("windows") if "windows" in windows.columns else F.lit(1).cast("long")
    hit = windows.withColumn("_w", weight).crossJoin(F.broadcast(params)).where(condition).groupBy(*keys).agg(F.sum("dev_transactions").alias("triggered"), F.sum("dev_aml").alias("aml_hits"), F.sum("dev_target").alias("target_hits"), F.sum("_w").alias("windows"))
    total = windows.groupBy(*([F.col(f"cell_{per}").alias(per)] if per else [])).agg(F.sum("dev_transactions").alias("all_tx"), F.sum("dev_target").alias("all_target"))
    out = params.join(hit, keys, "left")
    out = out.join(F.broadcast(total), per, "left") if per else out.crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*keys, *(zero(c).alias(c) for c in ("triggered", "aml_hits", "target_hits", "windows")), F.round(ratio(zero("triggered"), F.col("all_tx")), 6).alias("trigger_rate"), F.round(ratio(zero("aml_hits"), zero("triggered")), 6).alias("precision"), F.round(ratio(zero("target_hits"), F.col("all_target")), 6).alias("target_recall"))


def shortlist(results: DataFrame, most_rate: float = 0.01, n: int = 12, ties: tuple[str, ...] = ()) -> DataFrame:
    """The best ``n`` under the rate ceiling, or of all if none is under it; ``ties`` are the columns that order equal ones."""
    ok = results.withColumn("_ok", F.col("trigger_rate") <= most_rate).withColumn("_any", F.max("_ok").over(Window.partitionBy(F.lit(1))))  # grid rows
    return ok.where("_ok OR NOT _any").drop("_ok", "_any").orderBy(F.desc("target_recall"), F.desc("precision"), *ties).limit(n)


def class_distribution(tx: DataFrame, *by: str) -> DataFrame:
    """(by, n, percent) over all rows."""
    out = tx.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = out.agg(F.sum("n").alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("_all"), 6)).drop("_all")


def category_profile(tx: DataFrame, columns: list[str], by: str = "Laundering_type") -> DataFrame:
    """(by, dimension, value, n, share): each value's share within its typology and dimension, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    out = tx.where(F.col(by).isNotNull()).select(by, each).select(by, "x.*").groupBy(by, "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by, "dimension")), 6))


def structuring_population(tx: DataFrame, kinds: tuple[str, ...] = ("Smurfing", "Structuring"), ceiling: float = 10_000.0) -> DataFrame:
    """Transactions of the given typologies, and normal ones under the ceiling as one pattern of their own."""
    kind = F.col("Laundering_type").isin(*kinds)
    rows = tx.where(kind | ((F.col("Is_laundering") == 0) & (F.col("Amount") < ceiling)))
    return rows.withColumn("Pattern", F.when(kind, F.col("Laundering_type")).otherwise("Normal_Sub_10k"))


def amount_summary(tx: DataFrame, by: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Rows, mean and quantiles of the amount, rates and distinct accounts per group."""
    tx = tx.where(F.col(by).isNotNull())
    out = tx.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("Amount"), 6).alias("mean"), F.round(F.avg("Cross_border"), 6).alias("cross_rate"), F.round(F.avg("Currency_mismatch"), 6).alias("fx_rate"),
        F.countDistinct("Sender_account").alias("senders"), F.countDistinct("Receiver_account").alias("receivers"),
    )
    return with_percentiles(out, tx, [by], "Amount", quantiles)


def sender_summary(tx: DataFrame, by: str = "Pattern") -> DataFrame:
    """One row per group and sender: rows, total, receivers, hours between first and last."""
    hours = F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9, 6)
    return tx.groupBy(by, "Sender_account").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total"), F.countDistinct("Receiver_account").alias("receivers"), hours.alias("hours"))


def described(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(column, n, mean, std, min, quantiles, max) of numeric columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")
    rows = df.select(each).select("e.*")
    out = rows.groupBy("column").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev("x"), 4).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return with_percentiles(out, rows, ["column"], "x", quantiles)


def stratified_split(tx: DataFrame, test: float = 0.2, seed: int = 42, label: str = "Is_laundering") -> DataFrame:
    """Adds ``fold``: 'test' for the nearest whole number to ``test`` of each class, halves up; the rows that come first by a seeded hash of
    label and id (md5, so that other engines find the same).

    A class is ranked within 65,536 bands of the hash, whose sizes are counted first, so that no task holds a class.
    """
    label_of = F.coalesce(F.col(label).cast("string"), F.lit(""))
    x = tx.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), label_of, F.coalesce(F.col("tx_id").cast("string"), F.lit("")))))
    x = x.withColumn("_band", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    sizes = x.groupBy(F.col(label).alias("_label"), F.col("_band").alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy("_label")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(of.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(of)})
    x = x.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_band") == F.col("_place")))  # 65,536 rows a class at most
    nth = F.row_number().over(Window.partitionBy(label, "_band").orderBy("_hash")) + F.col("_before")
    quota = F.floor(F.lit(test) * F.col("_all") + 0.5)
    return x.withColumn("fold", F.when(nth <= quota, "test").otherwise("train")).select(*tx.columns, "fold")
