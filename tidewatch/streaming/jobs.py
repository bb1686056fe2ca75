"""Streaming forms: deduplicated ingest, account windows, session alerts and running account history.

Watermarks bound the state of all but the history, which keeps one row of state an account. The settled lookback gives
each row the batch's answer, whatever order the rows arrive in.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_path


def ingest(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops repeated ids within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tx_id"])


def account_windows(stream: DataFrame, length: str = "10 days") -> DataFrame:
    w = F.window("ts", length)
    out = stream.groupBy(w.alias("w"), "Sender_account").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total"), F.approx_count_distinct("Receiver_account").alias("receivers"))
    return out.select(F.col("w.start").alias("bucket"), "Sender_account", "n", "total", "receivers")


def session_alerts(stream: DataFrame, threshold: float, gap: str = "7 days") -> DataFrame:
    """Alerts by inactivity session; ids hash the session's start, which late rows of other sessions don't change."""
    w = F.session_window("ts", gap)
    out = stream.where(F.col("ml_probability") >= threshold).groupBy(w.alias("w"), "Sender_account").agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("Amount").alias("alert_amount"), F.max("ml_probability").alias("ml_probability_max"))
    return out.select(F.sha1(F.concat_ws("|", F.col("Sender_account").cast("string"), F.col("w.start").cast("string"))).alias("alert_id"), "Sender_account", F.col("w.start").alias("alert_created_at"), "transaction_count", "alert_amount", "ml_probability_max")


HISTORY = "tx_id long, Sender_prior_count long, Sender_prior_amount double, Sender_gap double"


def _history_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, total, last = state.get if state.exists else (0, 0.0, None)
    rows = pd.concat(list(frames)).sort_values(["at", "tx_id"], kind="stable")
    sums = rows["Amount"].cumsum()
    gap = rows["at"].diff()
    gap.iloc[0] = -1.0 if last is None else rows["at"].iloc[0] - last
    yield pd.DataFrame({"tx_id": rows["tx_id"], "Sender_prior_count": range(count, count + len(rows)), "Sender_prior_amount": total + sums - rows["Amount"], "Sender_gap": gap.astype(float)})
    state.update((count + len(rows), float(total + sums.iloc[-1]), int(rows["at"].iloc[-1])))


def running_history(stream: DataFrame) -> DataFrame:
    """Number, sum and distance of each sender's earlier transactions, as they arrive.

    A micro-batch is ordered by time, then id; its size (``maxFilesPerTrigger``) bounds what one account brings at once.
    Rows that arrive late count as arriving then.
    """
    rows = stream.select("tx_id", "Sender_account", F.unix_seconds("ts").alias("at"), "Amount")
    return rows.groupBy("Sender_account").applyInPandasWithState(_history_step, HISTORY, "n long, total double, last long", "append", GroupStateTimeout.NoTimeout)


LOOKBACK = "tx_id long, Sender_window_count long, Sender_window_amount double"


def _lookback_step(seconds: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_at, old_amount = state.get if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(["at", "tx_id"], kind="stable")
        at = np.concatenate([np.asarray(old_at, np.int64), rows["at"].to_numpy(np.int64)])
        amount = np.concatenate([np.asarray(old_amount, float), rows["Amount"].to_numpy(float)])
        order = np.argsort(at, kind="stable")
        at, sums = at[order], np.concatenate([[0.0], np.cumsum(amount[order])])
        mine = rows["at"].to_numpy(np.int64)
        first, end = np.searchsorted(at, mine - seconds, "left"), np.searchsorted(at, mine, "left")
        yield pd.DataFrame({"tx_id": rows["tx_id"].to_numpy(), "Sender_window_count": end - first, "Sender_window_amount": sums[end] - sums[first]})
        # rows down to the watermark may still come, and look back from there
        mark, newest = state.getCurrentWatermarkMs(), int(at[-1])
        keep = at >= min(newest, mark // 1000) - seconds
        state.update((at[keep].tolist(), amount[order][keep].tolist()))
        state.setTimeoutTimestamp(max(mark + 1, (newest + seconds) * 1000))

    return step


def running_lookback(stream: DataFrame, seconds: int = 86_400, late: str = "1 day") -> DataFrame:
    """Number and sum of each sender's transactions in [t - seconds, t), as far as they have arrived: an answer at once.

    State is the account's transactions of the last ``seconds`` before the watermark; it goes when the watermark has passed them.
    ``settled_lookback`` waits for what is late.
    """
    rows = stream.withWatermark("ts", late).select("tx_id", "Sender_account", "ts", F.unix_seconds("ts").alias("at"), "Amount")
    return rows.groupBy("Sender_account").applyInPandasWithState(_lookback_step(seconds), LOOKBACK, "at array<long>, amount array<double>", "append", GroupStateTimeout.EventTimeTimeout)


class Lookback(StatefulProcessor):
    """Windows [t - seconds, t) of the accounts of one share, answered when nothing that belongs to them can arrive any more.

    Every access to state is a call to the JVM, so accounts share theirs: the number of calls is that of shares, slots and batches, not
    of accounts. Time is cut into slots, ``slots`` to a window. State by slot, as packed arrays: the rows that wait for their answer, a part for
    each piece of a batch that brought some, so nothing is written again as it grows; and, once the slot is answered, counts and sums of each account's seconds that
    have rows. The timer at the end of a slot fires when the watermark has passed it: its waiting rows are answered from the
    slots that their windows reach, and the slot that no later window reaches goes.
    """

    def __init__(self, seconds: int, slots: int):
        self.seconds, self.slots = seconds, slots
        self.width = -(-seconds // slots)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "slot long", "account binary, at binary, n binary, amount binary")
        self.waiting = handle.getMapState("waiting", "slot long, part int", "tx_id binary, account binary, at binary, amount binary")
        self.parts = handle.getMapState("parts", "slot long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, seen = timerValues.getCurrentWatermarkInMs(), {}
        for frame in rows:
            ids, account, at = (frame[c].to_numpy(np.int64) for c in ("tx_id", "account", "at"))
            amount, slot = frame["Amount"].fillna(0.0).to_numpy(np.float64), at // self.width
            for k in np.unique(slot).tolist():
                if mark > 0 and (k + 1) * self.width * 1000 <= mark:
                    continue  # the slot is closed: too late
                if k not in seen:
                    seen[k] = self.parts.getValue((k,))[0] if self.parts.containsKey((k,)) else 0
                    if not seen[k]:
                        for end in (k + 1, k + 1 + self.slots):
                            self.handle.registerTimer(end * self.width * 1000)
                own = slot == k
                self.waiting.updateValue((k, seen[k]), tuple(x[own].tobytes() for x in (ids, account, at, amount)))
                seen[k] += 1
        for k, n in seen.items():
            self.parts.updateValue((k,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        k = expiredTimerInfo.getExpiryTimeInMs() // (self.width * 1000) - 1
        if self.parts.containsKey((k,)):
            n = self.parts.getValue((k,))[0]
            ids, account, at, amount = _unpacked([self.waiting.getValue((k, i)) for i in range(n)], "iiif")
            own = _summed(account, at, np.ones(len(at), np.int64), amount)
            near = [self.sums.getValue((j,)) for j in range(k - self.slots, k) if self.sums.containsKey((j,))]
            known = [np.concatenate(x) for x in zip(_unpacked(near, "iiif"), own, strict=True)] if near else own
            counts, totals = _looked_back(known, account, at, self.seconds)
            yield pd.DataFrame({"tx_id": ids, "Sender_window_count": counts, "Sender_window_amount": totals})
            self.sums.updateValue((k,), tuple(x.tobytes() for x in own))
            for i in range(n):
                self.waiting.removeKey((k, i))
            self.parts.removeKey((k,))
        if self.sums.containsKey((k - self.slots,)):
            self.sums.removeKey((k - self.slots,))

    def close(self) -> None:
        pass


def _unpacked(parts: list, kinds: str) -> list[np.ndarray]:
    """The columns of packed parts, one after the other; a kind is i (long) or f (double)."""
    return [np.concatenate([np.frombuffer(p[c], f"{kind}8") for p in parts]) for c, kind in enumerate(kinds)]


def _summed(account: np.ndarray, at: np.ndarray, n: np.ndarray, amount: np.ndarray) -> list[np.ndarray]:
    """Counts and sums by account and second, in that order."""
    order = np.lexsort((at, account))
    account, at, n, amount = (x[order] for x in (account, at, n, amount))
    first = np.flatnonzero(np.r_[True, (account[1:] != account[:-1]) | (at[1:] != at[:-1])])
    return [account[first], at[first], np.add.reduceat(n, first), np.add.reduceat(amount, first)]


def _looked_back(known: list[np.ndarray], account: np.ndarray, at: np.ndarray, seconds: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of [t - seconds, t) for rows of ``account`` at ``at``, from ``known`` counts and sums by account and second.

    Running sums begin anew with each account: what another one has, however large, doesn't change them."""
    order = np.lexsort((known[1], known[0]))
    who, when, n, amount = (x[order] for x in known)
    codes, start = np.unique(who, return_index=True)
    mine, of = np.searchsorted(codes, account), np.repeat(np.arange(len(codes)), np.diff(np.r_[start, len(who)]))
    low, span = when.min() - seconds, when.max() - when.min() + seconds + 1
    place = of * span + (when - low)  # accounts one after the other, each with its own stretch of seconds
    first, end = (np.searchsorted(place, mine * span + (t - low), "left") for t in (at - seconds, at))
    counts = np.r_[0, np.cumsum(n)]
    sums = pd.Series(amount).groupby(of).cumsum().to_numpy()
    until = lambda i: np.where(i > start[mine], sums[i - 1], 0.0)
    return counts[end] - counts[first], until(end) - until(first)


def settled_lookback(stream: DataFrame, seconds: int = 86_400, late: str = "1 day", slots: int = 1, shares: int = 256) -> DataFrame:
    """Number and sum of each sender's transactions in [t - seconds, t): what a batch finds, in whatever order rows within the watermark arrive.

    A row is answered when the watermark has passed its slot of seconds / slots. Rows behind the watermark are left out, rows without
    a time are answered at once: they have no window. Accounts are dealt to ``shares`` by hash, those without one are a share of their own; a
    task holds a slot of one share at a time. Runs on the RocksDB state store (``rocksdb``).
    """
    share = F.when(F.col("Sender_account").isNull(), -1).otherwise(F.pmod(F.xxhash64("Sender_account"), F.lit(shares))).cast("int")
    rows = stream.withWatermark("ts", late).select("tx_id", share.alias("share"), F.coalesce("Sender_account", F.lit(0)).cast("long").alias("account"), "ts", F.unix_seconds("ts").alias("at"), "Amount")
    timed = rows.where("ts IS NOT NULL").groupBy("share").transformWithStateInPandas(Lookback(seconds, slots), LOOKBACK, "append", "eventTime")
    none = rows.where("ts IS NULL").select("tx_id", F.lit(0).cast("long").alias("Sender_window_count"), F.lit(0.0).alias("Sender_window_amount"))
    return timed.unionByName(none)


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, which timers and state variables need; the setting goes back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def reconciled(closed: DataFrame, batch: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Windows that a stream closed against the same windows of a batch: (keys, stream_n, batch_n, missing)."""
    return closed.withColumnRenamed(n, "stream_n").join(batch.withColumnRenamed(n, "batch_n"), keys, "left").select(*keys, "stream_n", "batch_n", (F.col("batch_n") - F.col("stream_n")).alias("missing"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source has, and reads back what it appended."""
    spark = stream.sparkSession
    return drained_into(stream, shared_path(spark, name), shared_path(spark, f"{name}-marks"))


def drained_into(stream: DataFrame, out: str, marks: str) -> DataFrame:
    """As ``drained``, with the folders given: a second run with the same ones goes on where the first ended."""
    spark = stream.sparkSession
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", marks).start(out)
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
