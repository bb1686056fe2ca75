"""Account features over windows. Causal ones see earlier rows only; bucket ones see their whole bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import NEVER, sliding_percentile
from .scans import HOT, hot_among, running, with_bands

SIDES = {"Sender": "Receiver", "Receiver": "Sender"}


ACCOUNTS = [f"{s}_account" for s in SIDES]


def history(tx: DataFrame, hot: int = HOT, among: set[str] | None = None) -> DataFrame:
    """Earlier transactions of each account, as sender and as receiver: number, sum, mean, seconds since the last (-1: none).

    Accounts of more than ``hot`` rows are many tasks (``scans``); ``among``: the sides that have such, if that is known."""
    tx, bands = with_bands(tx.withColumn("_at", F.unix_seconds("ts")), {f"{s}_account": f"_{s}_band" for s in SIDES}, "_at", hot, among)
    for side in SIDES:
        key, n, total, gap = f"{side}_account", f"{side}_prior_count", f"{side}_prior_amount", f"{side}_gap"
        tx = running(tx, key, bands[key], [F.asc_nulls_last("ts"), F.col("tx_id")], {n: F.lit(1).cast("long"), total: F.col("Amount")}, {gap: F.col("_at")})
        tx = tx.withColumns({n: F.coalesce(n, F.lit(0).cast("long")), total: F.coalesce(total, F.lit(0.0)), gap: F.coalesce((F.col("_at") - F.col(gap)).cast("double"), F.lit(-1.0))})
        tx = tx.withColumn(f"{side}_prior_average", F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0))
    return tx.drop("_at", *(b for b in bands.values() if b))


#: A sum of amounts is kept as whole numbers of these sizes, so that what enters and leaves cancels exactly.
_FAR, _REST = 2.0**40, 2.0**32


def money(name: str, amount: Column) -> dict[str, Column]:
    """The parts of an amount that ``active_sums`` adds up, by name: whole units, 2 ** -32 of a unit, 2 ** 40 units for those beyond
    2 ** 52, and marks of NaN and of what is infinite or beyond 2 ** 82. Null is nothing."""
    a = F.coalesce(amount.cast("double"), F.lit(0.0))
    odd = F.when(F.isnan(a), 1).when(a >= 2.0**82, 1 << 21).when(a <= -(2.0**82), 1 << 42).otherwise(0).cast("long")
    tame = F.when(odd == 0, a).otherwise(0.0)
    far = F.when(F.abs(tame) >= 2.0**52, F.floor(tame / _FAR)).otherwise(0).cast("long")
    low = tame - far * _FAR
    whole = F.floor(low).cast("long")
    return {f"{name}_whole": whole, f"{name}_rest": F.round((low - whole) * _REST).cast("long"), f"{name}_far": far, f"{name}_odd": odd}


def summed(rows: DataFrame, name: str) -> DataFrame:
    """The sum that the parts of ``money`` stand for, as a double, in their place."""
    part = lambda k: F.col(f"{name}_{k}")
    bits = lambda k: F.shiftright(part("odd"), k).bitwiseAND((1 << 21) - 1)
    nan = (bits(0) > 0) | ((bits(21) > 0) & (bits(42) > 0))
    total = part("far") * _FAR + part("whole") + part("rest") / _REST
    out = F.when(part("odd") == 0, total).when(nan, float("nan")).when(bits(21) > 0, float("inf")).otherwise(float("-inf"))
    return rows.withColumn(name, out).drop(*(f"{name}_{k}" for k in ("whole", "rest", "far", "odd")))


def active_sums(rows: DataFrame, key: str, spans: list[tuple[Column, Column, dict[str, Column]]], reach: int, hot: int = HOT, split: bool | None = None) -> DataFrame:
    """Adds to each row, at second ``_at``, the sums of the values that rows of the same ``key`` lend to that second.

    A span (begin, end, {name: value}) lends its values at begin <= t < end; no span of a row ends ``reach`` seconds after the
    row's first begin, or later. Values enter and leave as events of one running sum, so the cost is linear however long the
    spans are. An account's time is cut into pieces of four reaches, each a group of its own that also gets the events of rows
    that reach into it from the piece before. Rows without a time lend nothing, and nothing is lent to them. Where an account has more than ``hot``
    rows (``split`` says so if it is known), the events of a piece are cut into bands with what they carry (``scans``).
    """
    piece, names = 4 * reach, [n for _, _, values in spans for n in values]
    kinds = {n: v for _, _, values in spans for n, v in values.items()}
    begins, ends = {f"_b{k}": s[0] for k, s in enumerate(spans)}, {f"_e{k}": s[1] for k, s in enumerate(spans)}
    x = rows.withColumns({**begins, **ends, **{f"_v_{n}": v for n, v in kinds.items()}})

    def event(at: str, own: list[str], sign: int) -> Column:
        sums = [(F.col(f"_v_{n}") * sign if n in own else F.col(f"_v_{n}") * 0).alias(n) for n in names]
        return F.struct(F.col(at).alias("_t"), *sums)

    # spans that are given the same begin enter together
    together: dict[int, list[int]] = {}
    for k, s in enumerate(spans):
        together.setdefault(id(s[0]), []).append(k)
    enter = [event(f"_b{ks[0]}", [n for k in ks for n in spans[k][2]], 1) for ks in together.values()]
    leave = [event(f"_e{k}", list(s[2]), -1) for k, s in enumerate(spans)]
    first = F.least(*begins) if len(begins) > 1 else F.col("_b0")
    last = F.greatest(*ends) if len(ends) > 1 else F.col("_e0")
    home, to = F.floor(first / piece).cast("long"), F.floor((last - 1) / piece).cast("long")
    moves = F.array(*enter, *leave)
    events = x.where(F.col("_at").isNotNull()).select(F.col(key).alias("_k"), F.explode(moves).alias("_m"), F.array_distinct(F.array(home, F.greatest(home, to))).alias("_p"))
    events = events.select("_k", F.explode("_p").alias("_p"), F.lit(0).alias("_probe"), "_m.*", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    zero = [(F.col(f"_v_{n}") * 0).alias(n) for n in names]
    probes = x.select(F.col(key).alias("_k"), F.floor(F.col("_at") / piece).cast("long").alias("_p"), F.lit(1).alias("_probe"), F.col("_at").alias("_t"), *zero, F.struct(*rows.columns).alias("_row"))
    run = Window.partitionBy("_k", "_p").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    both = events.unionByName(probes)
    if hot_among(rows, [key], hot) if split is None else split:
        both, bands = with_bands(both.withColumn("_kp", F.struct("_k", "_p")), {"_kp": "_band"}, "_t", hot)
        out = running(both, "_kp", bands["_kp"], [F.col("_t"), F.col("_probe")], {f"_t_{n}": F.col(n) for n in names}, {})
        out = out.withColumns({n: F.coalesce(f"_t_{n}", F.col(n) * 0) for n in names})  # a probe adds nothing itself
    else:
        out = both.withColumns({n: F.sum(n).over(run) for n in names})
    return out.where("_probe = 1").select("_row.*", *names)


def seen_again(key: str, other: str) -> Column:
    """The second of the key's next row with the same ``other``; null for the last."""
    return F.lead("_at").over(Window.partitionBy(key, other).orderBy("_at"))


def rolling(tx: DataFrame, seconds: int = 86_400, hot: int = HOT, among: set[str] | None = None) -> DataFrame:
    """Number, sum and distinct counterparties of each account in [t - seconds, t), as sender and as receiver."""
    tx = tx.withColumn("_at", F.unix_seconds("ts"))
    one = F.lit(1).cast("long")
    large = hot_among(tx, ACCOUNTS, hot) if among is None else among
    for side, other in SIDES.items():
        key, n, total, unique = f"{side}_account", f"{side}_window_count", f"{side}_window_amount", f"{side}_window_unique"
        # a counterparty counts by its latest row
        tx = tx.withColumn("_next", seen_again(key, f"{other}_account"))
        begin, end = F.col("_at") + 1, F.col("_at") + seconds + 1
        known = F.when(F.col(f"{other}_account").isNotNull(), one).otherwise(F.lit(0).cast("long"))
        spans = [(begin, end, {n: one, **money(total, F.col("Amount"))}), (begin, F.least(end, F.col("_next") + 1), {unique: known})]
        tx = summed(active_sums(tx, key, spans, seconds + 1, hot, key in large), total).withColumn(unique, F.col(unique).cast("int")).drop("_next")
    return tx.drop("_at")


def sliding(tx: DataFrame, days: int, median: bool = True, hot: int = HOT, among: set[str] | None = None) -> DataFrame:
    """Sender features of the last ``days`` days up to and with the current second: number, sum, receivers, rates and median (``order``).

    Hot accounts are counted first (``among`` says so if it is known), on the rows as they come: later each count would make the percentiles anew.
    """
    large = hot_among(tx, ["Sender_account"], hot) if among is None else among
    tx, reach = tx.withColumn("_at", F.unix_seconds("ts")), days * 86_400 + 1
    if median:
        zero = F.lit(0).cast("long")
        tx = sliding_percentile(tx, ["Sender_account"], "median_amount", 0.5, F.col("Amount"), (F.col("_at"), zero), (F.col("_at") + reach, zero), (F.col("_at"), zero), piece=2 * reach)
    tx = tx.withColumn("_next", seen_again("Sender_account", "Receiver_account"))
    one, end = F.lit(1).cast("long"), F.col("_at") + days * 86_400 + 1
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    sums = {"n": one, **money("total", F.col("Amount")), "_cross": flag("Cross_border"), "_fx": flag("Currency_mismatch")}
    known = F.when(F.col("Receiver_account").isNotNull(), one).otherwise(F.lit(0).cast("long"))
    begin = F.col("_at")
    out = summed(active_sums(tx, "Sender_account", [(begin, end, sums), (begin, F.least(end, F.col("_next")), {"unique_receivers": known})], days * 86_400 + 1, hot, "Sender_account" in large), "total")
    rate = lambda c: F.try_divide(F.col(c), F.col("n"))
    return out.withColumns({"unique_receivers": F.col("unique_receivers").cast("int"), "cross_rate": rate("_cross"), "fx_rate": rate("_fx")}).drop("_at", "_next", "_cross", "_fx")


def median_below(value: str, ceiling: float, w) -> Column:
    """Whether the median of ``value`` over a growing frame is under ``ceiling``, from running counts and extremes alone."""
    under, over = F.when(F.col(value) < ceiling, F.col(value)), F.when(F.col(value) >= ceiling, F.col(value))
    twice, n = 2 * F.count(under).over(w), F.count(value).over(w)
    return F.coalesce((twice > n) | ((twice == n) & (F.max(under).over(w) + F.min(over).over(w) < 2 * ceiling)), F.lit(False))


def anchored(ts: Column, origin: Column, days: int) -> Column:
    """Number of the bucket of ``days`` days counted from ``origin``; negative before it."""
    return F.floor((F.unix_micros(ts) - F.unix_micros(origin)) / F.lit(days * 86_400_000_000)).cast("long")


def epoch_bucket(ts: Column, days: int) -> Column:
    return F.window(ts, f"{days} days")["start"]


def bucket_features(tx: DataFrame, account: str, other: str, bucket: Column) -> DataFrame:
    """One row per account and bucket, over all of the bucket; rows without an account have none."""
    return tx.where(F.col(account).isNotNull()).groupBy(bucket.alias("bucket"), account).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total"), F.percentile("Amount", 0.5).alias("median_amount"), F.percentile("Amount", 0.95).alias("p95_amount"), F.countDistinct(other).alias("unique_others"),
        F.avg("Cross_border").alias("cross_rate"), F.avg("Currency_mismatch").alias("fx_rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def causal_bucket(tx: DataFrame, days: int, origin: Column, ceilings: tuple[float, ...] | None = None) -> DataFrame:
    """Running sender features inside buckets anchored at ``origin``, with the current row.

    ``median_amount`` is exact (``order``); with ``ceilings`` it is instead the lowest of them that the median is under (null: none),
    which running counts tell.
    """
    tx = tx.withColumn("bucket", anchored(F.col("ts"), origin, days))
    keys = ("Sender_account", "bucket")
    w = Window.partitionBy(*keys).orderBy("ts", "tx_id").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*keys, "Receiver_account").orderBy("ts", "tx_id")) == 1
    if ceilings is None:
        now, never = (F.unix_micros("ts"), F.col("tx_id")), (F.lit(NEVER), F.lit(0).cast("long"))
        tx = sliding_percentile(tx, list(keys), "median_amount", 0.5, F.col("Amount"), now, never, now)
    else:
        tx = tx.withColumn("median_amount", F.least(*(F.when(median_below("Amount", c, w), F.lit(c)) for c in ceilings), F.lit(None)))
    return tx.withColumn("_new", first.cast("int")).withColumns({
        "n": F.count(F.lit(1)).over(w), "total": F.sum("Amount").over(w), "unique_receivers": F.sum("_new").over(w),
        "cross_rate": F.avg("Cross_border").over(w), "fx_rate": F.avg("Currency_mismatch").over(w),
    }).drop("_new")


def warmed_up(tx: DataFrame, split: str = "split", days: int = 120) -> tuple[DataFrame, DataFrame]:
    """Development rows with the train rows of the ``days`` days before the first of them, and that start as a row (``dev_start``).

    Train rows at or after the start are a leak; ``audit.leaks`` counts them.
    """
    start = tx.where(F.col(split) == "development").agg(F.min("ts").alias("dev_start"))
    rows = tx.crossJoin(F.broadcast(start))  # one row
    near = (F.col(split) == "train") & (F.col("ts") >= F.col("dev_start") - F.make_dt_interval(days=F.lit(days)))
    return rows.where((F.col(split) == "development") | near), start
