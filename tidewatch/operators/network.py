"""Flow scenarios: time-bounded joins of transfers along accounts.

The equi-key is the account and a time bucket as long as the window: each later transfer is looked up in its own and the
next bucket, so a hub account's transfers meet only those near in time. Where the result names accounts and not transfers, distinct
partners meet instead (``reached``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import holds
from .features import active_sums, money, summed
from .scans import hot_among


def transfers(tx: DataFrame) -> DataFrame:
    """Account transfers without loops: (src, dst, ts, tx_id, amount)."""
    x = tx.where((F.col("network_eligible") == 1) & (F.col("Sender_account") != F.col("Receiver_account")))
    return x.select(F.col("Sender_account").alias("src"), F.col("Receiver_account").alias("dst"), F.unix_seconds("ts").alias("at"), "tx_id", F.col("Amount").alias("amount"))


def followed(first: DataFrame, then: DataFrame, left: str, right: str, seconds: int) -> DataFrame:
    """Pairs where ``then`` (columns prefixed n_) comes after ``first`` within ``seconds`` and first.left = then.right."""
    a = first.withColumn("_k", F.expr(f"at DIV {seconds}")).withColumn("_k", F.explode(F.array(F.col("_k"), F.col("_k") + 1)))
    b = then.select(*(F.col(c).alias(f"n_{c}") for c in then.columns)).withColumn("_nk", F.expr(f"n_at DIV {seconds}"))
    on = (F.col(left) == F.col(f"n_{right}")) & (F.col("_k") == F.col("_nk"))
    return a.join(b, on).where((F.col("n_at") > F.col("at")) & (F.col("n_at") <= F.col("at") + seconds)).drop("_k", "_nk")


def reached(e: DataFrame, seconds: int) -> DataFrame:
    """(src, mid, dst), each once: src paid mid and, within ``seconds`` after, mid paid dst, which isn't src.

    Transfers are first summed up to a row for each pair of accounts and time bucket, with its first and last second. In one bucket, of
    which every two seconds are near enough, some pair fits if the first payment in lies before the last one out; over
    two buckets, if the last one in and the first one out are near enough. So a hub's rows are its distinct partners, not
    its transfers, and pairs of transfers are never formed.
    """
    ends = e.groupBy("src", "dst", F.floor(F.col("at") / seconds).cast("long").alias("k")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    a = ends.select("src", F.col("dst").alias("mid"), "k", "first", "last", F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).withColumn("k", F.col("k") + F.col("later"))
    b = ends.select(F.col("src").alias("mid"), "dst", "k", F.col("first").alias("n_first"), F.col("last").alias("n_last"))
    fits = F.when(F.col("later") == 0, F.col("first") < F.col("n_last")).otherwise(F.col("n_first") <= F.col("last") + seconds)
    return a.join(b, ["mid", "k"]).where(fits & (F.col("src") != F.col("dst"))).select("src", "mid", "dst").distinct()


def pass_through(e: DataFrame, seconds: int = 86_400, low: float = 0.8, high: float = 1.05) -> DataFrame:
    p = followed(e, e, "dst", "src", seconds).where(F.try_divide("n_amount", "amount").between(low, high))
    return p.select(F.col("dst").alias("account"), F.col("tx_id").alias("in_tx"), F.col("n_tx_id").alias("out_tx"))


def cycles(e: DataFrame, seconds: int = 7 * 86_400) -> DataFrame:
    """Two transfers there and back."""
    p = followed(e, e, "dst", "src", seconds).where("n_dst = src")
    return p.select("src", "dst", F.col("tx_id").alias("out_tx"), F.col("n_tx_id").alias("back_tx"))


def scatter_gather(e: DataFrame, seconds: int = 86_400, mids: int = 3) -> DataFrame:
    """(source, target) with at least ``mids`` accounts between them."""
    p = reached(e, seconds)
    return p.groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("mids")).where(F.col("mids") >= mids)


def layered_fan_out(e: DataFrame, seconds: int = 86_400, mids: int = 2, leaves: int = 2) -> DataFrame:
    """Accounts with at least ``mids`` receivers that each pass on to at least ``leaves`` distinct others."""
    each = reached(e, seconds).groupBy("src", "mid").agg(F.count(F.lit(1)).alias("leaves")).where(F.col("leaves") >= leaves)
    return each.groupBy(F.col("src").alias("root")).agg(F.count(F.lit(1)).alias("mids"), F.sum("leaves").alias("leaf_links")).where(F.col("mids") >= mids)


def deposit_then_send(tx: DataFrame, seconds: int = 72 * 3600, share: float = 0.8) -> DataFrame:
    cash = tx.where("is_cash_deposit = 1").select(F.col("Receiver_account").alias("dst"), F.unix_seconds("ts").alias("at"), "tx_id", F.col("Amount").alias("amount"))
    p = followed(cash, transfers(tx), "dst", "src", seconds).where(F.col("n_amount") >= F.lit(share) * F.col("amount"))
    return p.select(F.col("dst").alias("account"), F.col("tx_id").alias("deposit_tx"), F.col("n_tx_id").alias("send_tx"))


def layered_fan_in(e: DataFrame, seconds: int = 86_400, mids: int = 2, leaves: int = 2) -> DataFrame:
    """Accounts with at least ``mids`` senders that each were paid before by at least ``leaves`` distinct others."""
    each = reached(e, seconds).groupBy(F.col("dst").alias("root"), "mid").agg(F.count(F.lit(1)).alias("leaves")).where(F.col("leaves") >= leaves)
    return each.groupBy("root").agg(F.count(F.lit(1)).alias("mids"), F.sum("leaves").alias("leaf_links")).where(F.col("mids") >= mids)


def triangles(e: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Cycles of three transfers over three accounts in rising time, all within ``seconds`` of the first."""
    p = followed(e, e, "dst", "src", seconds).where("n_dst <> src")
    two = p.select("src", F.col("dst").alias("mid1"), F.col("n_dst").alias("dst"), "tx_id", F.col("n_tx_id").alias("tx2"), F.col("at").alias("first_at"), F.col("n_at").alias("at"))
    c = followed(two, e, "dst", "src", seconds).where(F.col("n_dst").eqNullSafe(F.col("src")) & (F.col("n_at") <= F.col("first_at") + seconds))
    return c.select("src", "mid1", F.col("dst").alias("mid2"), F.col("tx_id").alias("tx1"), "tx2", F.col("n_tx_id").alias("tx3"))


def gather_scatter(e: DataFrame, seconds: int = 86_400, senders: int = 3, receivers: int = 3) -> DataFrame:
    """Moments at which an account was paid by at least ``senders`` in the time before and pays at least ``receivers`` after.

    A payer counts by its latest payment before the moment, a payee by the first payment to it after.
    """
    sides = F.array(F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit(1).alias("paid")), F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit(0).alias("paid")))
    each = e.select(F.explode(sides).alias("x"), F.col("at").alias("_at")).select("x.*", "_at")
    w = Window.partitionBy("account", "paid", "other").orderBy("_at")
    begin = F.when(F.col("paid") == 1, F.col("_at") + 1).otherwise(F.greatest(F.col("_at") - seconds, F.lag("_at").over(w)))
    end = F.when(F.col("paid") == 1, F.least(F.col("_at") + seconds + 1, F.lead("_at").over(w) + 1)).otherwise(F.col("_at"))
    each = each.withColumns({"_begin": begin, "_end": end})
    values = {"senders": F.col("paid").cast("long"), "receivers": (1 - F.col("paid")).cast("long")}
    seen = active_sums(each, "account", [(F.col("_begin"), F.col("_end"), values)], seconds + 1)
    return seen.where((F.col("senders") >= senders) & (F.col("receivers") >= receivers)).select("account", F.col("_at").alias("at"), "senders", "receivers").distinct()


def behaviour_change(tx: DataFrame, recent: int = 7, base: int = 30, times: float = 3.0) -> DataFrame:
    """Per transaction: the sender's last ``recent`` days (with this second) against the ``base`` days before, per day.

    Flagged if amount or count a day is at least ``times`` the baseline's, or the receiver's place is new in both spans.
    Without a baseline there is no change of amount or count.
    """
    day, large = 86_400, hot_among(tx, ["Sender_account"])  # counted on the plain rows
    tx = tx.withColumn("_at", F.unix_seconds("ts"))
    before = Window.partitionBy("Sender_account", "Receiver_bank_location").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    tx = tx.withColumn("_last", F.max("_at").over(before))
    at, one = F.col("_at"), F.lit(1).cast("long")
    spans = [
        (at, at + recent * day, {"near_n": one, **money("near_amount", F.col("Amount"))}), (at + recent * day, at + (recent + base) * day, {"far_n": one, **money("far_amount", F.col("Amount"))}),
        (at + 1, at + (recent + base) * day, {"_ever": F.when(F.col("Receiver_bank_location").isNotNull(), one).otherwise(F.lit(0).cast("long"))}),
    ]
    x = summed(summed(active_sums(tx, "Sender_account", spans, (recent + base) * day, split="Sender_account" in large), "near_amount"), "far_amount")
    more = lambda a, b: holds((F.col(b) > 0) & (F.col(a) * F.lit(float(base)) >= F.lit(times * recent) * F.col(b)))
    known = F.col("_last") >= F.col("_at") - ((recent + base) * day - 1)
    fresh = holds((F.col("_ever") > 0) & F.col("Receiver_bank_location").isNotNull() & ~F.coalesce(known, F.lit(False)))
    return x.withColumns({"amount_change": more("near_amount", "far_amount"), "count_change": more("near_n", "far_n"), "new_place": fresh}).drop("_at", "_last", "_ever")
