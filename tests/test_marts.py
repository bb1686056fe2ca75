"""Checked joins, contracts that fail, linear window sums and exact percentiles, streams with late rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import audit, evaluation as E, features as W, ml, network as N, profiles as P, scenarios as D
from tidewatch.operators.quantiles import percentiles
from tidewatch.sources import tables as X

T0 = dt.datetime(2023, 5, 1)


def payments(n, accounts, days, seed):
    rng = random.Random(seed)
    at = [T0 + dt.timedelta(seconds=rng.choice((rng.randrange(days * 86_400), 86_400 * rng.randrange(days)))) for _ in range(n)]
    return [(i, rng.randrange(accounts), rng.choice((None, *range(accounts))), rng.choice((2.5, 10.0, 99.5, 4000.0)), rng.randrange(2), rng.randrange(2), "AB"[rng.randrange(2)], a) for i, a in enumerate(at)]


COLUMNS = "tx_id long, Sender_account long, Receiver_account long, Amount double, Cross_border int, Currency_mismatch int, Receiver_bank_location string, ts timestamp"


@pytest.mark.parametrize("hot", [W.HOT, 20])
def test_rolling_sums_equal_those_of_frames(spark, hot):
    rows = payments(300, 4, 12, 3)
    got = {r.tx_id: r for r in W.rolling(spark.createDataFrame(rows, COLUMNS), hot=hot).collect()}
    for i, s, r, *_, t in rows:
        near = [x for x in rows if x[1] == s and dt.timedelta(0) < t - x[7] <= dt.timedelta(days=1)]
        assert (got[i].Sender_window_count, got[i].Sender_window_amount, got[i].Sender_window_unique) == (len(near), sum(x[3] for x in near), len({x[2] for x in near} - {None}))
        near = [x for x in rows if x[2] == r and dt.timedelta(0) < t - x[7] <= dt.timedelta(days=1)]
        assert (got[i].Receiver_window_count, got[i].Receiver_window_unique) == (len(near), len({x[1] for x in near}))


def test_sliding_sums_equal_those_of_frames(spark):
    rows = payments(200, 3, 30, 4)
    got = {r.tx_id: r for r in W.sliding(spark.createDataFrame(rows, COLUMNS), 5).collect()}
    for i, s, *_, t in rows:
        near = [x for x in rows if x[1] == s and dt.timedelta(0) <= t - x[7] <= dt.timedelta(days=5)]
        r = got[i]
        assert (r.n, r.total, r.unique_receivers, r.median_amount) == (len(near), sum(x[3] for x in near), len({x[2] for x in near} - {None}), float(np.median([x[3] for x in near])))
        assert abs(r.cross_rate - np.mean([x[4] for x in near])) < 1e-12


def test_gather_scatter_and_behaviour_against_brute_force(spark):
    rows = [x for x in payments(250, 5, 20, 5) if x[2] is not None and x[1] != x[2]]
    e = spark.createDataFrame([(x[1], x[2], int((x[7] - dt.datetime(1970, 1, 1)).total_seconds()), x[0], x[3]) for x in rows], "src long, dst long, at long, tx_id long, amount double")
    want = set()
    day = dt.timedelta(days=1)
    for account in range(5):
        for t in {x[7] for x in rows if account in (x[1], x[2])}:
            a = {x[1] for x in rows if x[2] == account and dt.timedelta(0) < t - x[7] <= day}
            b = {x[2] for x in rows if x[1] == account and dt.timedelta(0) < x[7] - t <= day}
            if len(a) >= 2 and len(b) >= 2:
                want.add((account, int((t - dt.datetime(1970, 1, 1)).total_seconds()), len(a), len(b)))
    assert {tuple(r) for r in N.gather_scatter(e, 86_400, 2, 2).collect()} == want and want
    got = {r.tx_id: r for r in N.behaviour_change(spark.createDataFrame(rows, COLUMNS), 2, 5).collect()}
    for i, s, _, _, _, _, place, t in rows:
        age = lambda x: (t - x[7]).total_seconds()
        mine = [x for x in rows if x[1] == s]
        near, far = [x for x in mine if 0 <= age(x) < 2 * 86_400], [x for x in mine if 2 * 86_400 <= age(x) < 7 * 86_400]
        ever = {x[6] for x in mine if 0 < age(x) < 7 * 86_400}
        assert (got[i].near_n, got[i].far_n, got[i].near_amount, got[i].new_place) == (len(near), len(far), sum(x[3] for x in near), int(bool(ever) and place not in ever))


def test_median_below_is_the_median(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, float(rng.randrange(9))) for k in range(200)], "k long, x double").withColumn("g", F.col("k") % 7)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = df.select(*(W.median_below("x", c, w).alias(f"b{c}") for c in (2.0, 4.5, 5.0)), F.percentile("x", 0.5).over(w).alias("m")).collect()
    assert all(r["b2.0"] == (r.m < 2) and r["b4.5"] == (r.m < 4.5) and r["b5.0"] == (r.m < 5) for r in out)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(np.round(v, 2))) for g, n in (("a", 1), ("b", 2), ("c", 997), ("d", 400)) for v in rng.lognormal(3, 2, n)] + [("d", 5.0)] * 300 + [("a", None), ("e", None)]
    got = {r.g: r.q for r in percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", (0.0, 0.25, 0.5, 0.95, 1.0), bands=8).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for g in got:
        want = np.quantile([x for k, x in rows if k == g and x is not None], (0.0, 0.25, 0.5, 0.95, 1.0))
        assert np.allclose(got[g], want, atol=1e-9)


def test_joins_check_their_keys(spark):
    one, many = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k long, x string"), spark.createDataFrame([(1, "p"), (1, "q")], "k long, y string")
    assert X.checked_join(one, many, ["k"], "inner", "one_to_many").count() == 2
    for bad in ("one_to_one", "many_to_one"):
        with pytest.raises(ValueError, match="repeated keys"):
            X.checked_join(one, many, ["k"], "left", bad)
    with pytest.raises(ValueError, match="missing columns: z"):
        X.require_columns(one, "k", "z")
    assert X.load_optional(spark, "file:///tmp/no-such-table-here") is None


def test_contracts_fail_on_bad_input(spark):
    counts = lambda *r: spark.createDataFrame([r], "n long, positives long, alerts long, hits long")
    r = audit.require_valid(counts(500, 40, 60, 30)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (30, 30, 10, 430, 0.5, 0.75)
    for bad in ((500, 40, 60, 41), (500, 40, 20, 30), (30, 40, 20, 10), (500, -1, 20, 0), (500, 40, 60, None)):
        with pytest.raises(ValueError):
            audit.require_valid(counts(*bad))
    rows = spark.createDataFrame([("train", T0), ("development", T0 - dt.timedelta(1)), ("holdout", T0 + dt.timedelta(1))], "split string, ts timestamp")
    assert {r.check: r.n_bad for r in audit.leaks(rows).collect()} == {"train_after_development": 1, "development_after_holdout": 0}
    with pytest.raises(ValueError, match="train_after_development"):
        audit.require_none(audit.leaks(rows))
    assert P.require_periods(rows).count() == 3
    with pytest.raises(ValueError, match="holdout"):
        P.require_periods(rows.where("split <> 'holdout'"))
    with pytest.raises(ValueError):
        P.require_parsed(spark.createDataFrame([(None,)], "t timestamp"), "t")


def test_published_table_is_audited(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("Metric,A,B,Unit\nHOLDOUT transactions,1000,1000,n\nAML positives,50,50,n\nFlagged transactions,80,40,n\nAML hits,20,30,n\nPrecision,0.25,0.75,x\nRecall,0.4,0.7,x\nAlert rate,0.08,0.04,x\n".encode("utf-8-sig"))
    got = {(r.detector, r.metric): r.agrees for r in audit.summary(spark.read.csv(str(tmp_path), header=True), ["A", "B"]).collect()}
    assert got.pop(("B", "recall")) is False and len(got) == 5 and all(got.values())


def test_countries(spark):
    known = S.countries(spark, {"ATLANTIS": "GR"})
    names = ["uk", " U.S.A. ", "Türkiye?", "turkey", "deu", "Germany", "FR", "atlantis", "Nowhere", "", None, "NaN", "Great-Britain"]
    got = S.with_country_codes(spark.createDataFrame(list(enumerate(names)), "i int, c string"), known, "c", "x").orderBy("i").collect()
    assert [r.x_iso2 for r in got] == ["GB", "US", "TR", "TR", "DE", "DE", "FR", "GR", None, None, None, None, "GB"]
    assert got[4].x_iso3 == "DEU" and got[12].x_iso3 == "GBR"


def test_thresholds_table(spark):
    got = {r.Parameter: r.Value for r in D.configuration(spark).collect()}
    assert got["large_amount"] == 50_000 and got["alert_count"] == 1 and len(got) == 12


def test_models_learn_and_name_their_features(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.random() * 100, "train" if i < 500 else "development" if i < 650 else "holdout") for i in range(900)]
    df = spark.createDataFrame(rows, "tx_id long, c string, x double, split string").withColumn("Is_laundering", (F.col("x") > 90).cast("int"))
    df = df.select("*", *(F.col("c").alias(c) for c in ml.CATEGORICAL), *((F.col("x") if c == "Log_amount" else F.lit(1.0)).alias(c) for c in ml.NUMERIC))
    for name, small in (("decision_tree", ml.MODELS["decision_tree"]), ("random_forest", lambda: ml.MODELS["random_forest"]().setNumTrees(5)), ("boosted_trees", lambda: ml.MODELS["boosted_trees"]().setMaxIter(3))):
        ml.MODELS[f"small {name}"] = small
        r = ml.frozen_evaluation(df, f"small {name}", 0.1).first()
        assert r.roc_auc > 0.9 and r.tp > 0 and r.fp + r.tp == r.alerts
        del ml.MODELS[f"small {name}"]
    top = ml.importances(ml.fit(df.where("split = 'train'")), df, 3).collect()
    assert top[0].feature == "Log_amount" and len(top) == 3


def test_report_rows(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 5 + [(0, 1)], "Is_laundering int, p int")
    got = {r["row"]: (r.precision, r.recall, r.support) for r in E.full_report(df, "p").collect()}
    assert got["1"] == (0.75, 0.75, 4) and got["accuracy"][0] == 0.8 and got["macro avg"][2] == 10 and abs(got["weighted avg"][1] - 0.8) < 1e-6


def test_lookback_state_goes_on_over_micro_batches(spark, tmp_path):
    from tidewatch.streaming.jobs import drained, running_lookback

    rows = [(i, 1, 2.0**i, T0 + dt.timedelta(hours=8 * i)) for i in range(8)]
    df = spark.createDataFrame(rows, "tx_id long, Sender_account long, Amount double, ts timestamp")
    for k in range(4):
        df.where(f"tx_id DIV 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.tx_id, r.Sender_window_count, r.Sender_window_amount) for r in drained(running_lookback(stream), "look").collect())
    assert got == [(i, min(i, 3), float(sum(2.0**j for j in range(max(0, i - 3), i)))) for i in range(8)]


def arrived_in(spark, tmp_path, parts, run, name):
    """Runs a stream over parts that arrive one after the other; state goes on from run to run."""
    from tidewatch.streaming.jobs import drained_into

    path, out, marks = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "marks"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        found = drained_into(run(spark.readStream.schema(part.schema).parquet(path)), out, marks)
    return found


@pytest.mark.parametrize("slots", [1, 5])
def test_lookback_is_the_batch_answer_in_any_order(spark, tmp_path, slots):
    from tidewatch.streaming.jobs import settled_lookback

    rng = random.Random(slots)
    seconds, late = 6 * 3600, 4 * 3600
    rows = [(i, rng.choice((1, 1, 2, None)), rng.choice((0.5, 2.0, None, 64.0)), T0 + dt.timedelta(seconds=rng.choice((rng.randrange(4 * 86_400), 600 * rng.randrange(500))))) for i in range(240)]
    rows += [(1000 + k, 1, 1.0, T0 + dt.timedelta(days=9)) for k in range(2)] + [(2000, 1, 5.0, None)]
    arrives = lambda r: (r[3] or T0) + dt.timedelta(seconds=rng.randrange(late))
    schema = "tx_id long, Sender_account long, Amount double, ts timestamp"
    batches: dict[int, list] = {}
    for r in rows:
        batches.setdefault(int((arrives(r) - T0).total_seconds() // 40_000), []).append(r)
    parts = [spark.createDataFrame(rng.sample(b, len(b)), schema) for _, b in sorted(batches.items())]
    got = {r.tx_id: (r.Sender_window_count, r.Sender_window_amount) for r in arrived_in(spark, tmp_path, parts, lambda s: settled_lookback(s, seconds, "4 hours", slots), "o").collect()}
    assert got.pop(2000) == (0, 0.0)
    want = {}
    for i, a, _, t in rows[:240]:
        near = [x for x in rows[:240] if x[1] == a and t - dt.timedelta(seconds=seconds) <= x[3] < t]
        want[i] = (len(near), sum(x[2] or 0.0 for x in near))
    assert got == want


def test_lookback_leaves_out_what_is_behind_the_watermark(spark, tmp_path):
    from tidewatch.streaming.jobs import settled_lookback

    at = lambda h: T0 + dt.timedelta(hours=h)
    schema = "tx_id long, Sender_account long, Amount double, ts timestamp"
    batches = [[(0, 1, 1.0, at(0)), (1, 1, 2.0, at(10)), (2, 1, 4.0, at(36))], [(3, 1, 8.0, at(20))], [(4, 1, 16.0, at(240))], [(5, 1, 32.0, at(30))], [(6, 1, 64.0, at(250))], [(7, 1, 1.0, at(900))]]
    parts = [spark.createDataFrame(b, schema) for b in batches]
    got = {r.tx_id: (r.Sender_window_count, r.Sender_window_amount) for r in arrived_in(spark, tmp_path, parts, lambda s: settled_lookback(s, 86_400), "l").collect()}
    # 20 h comes after 36 h but in time; 30 h comes when the watermark stands at 216 h; the last row stays open
    assert got == {0: (0, 0.0), 1: (1, 1.0), 3: (2, 3.0), 2: (1, 8.0), 4: (0, 0.0), 6: (1, 16.0)}


def test_lookback_calls_for_state_grow_with_shares_not_accounts(spark, tmp_path):
    from tidewatch.streaming.jobs import Lookback

    calls = [0]

    class Counted(dict):
        def __getattribute__(self, name):
            calls[0] += name in ("getValue", "updateValue", "containsKey", "removeKey")
            return dict.__getattribute__(self, name)

        getValue, updateValue, containsKey, removeKey = dict.__getitem__, dict.__setitem__, dict.__contains__, dict.__delitem__

    class Handle:
        getMapState, registerTimer = staticmethod(lambda *_: Counted()), staticmethod(lambda end: ends.add(end))

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    for accounts in (3, 3000):
        ends: set = set()
        calls[0] = 0
        lookback = Lookback(3600, 1)
        lookback.init(Handle)
        # an account's own sums: what the largest one has doesn't change the others'
        rows = [(a * 10 + i, a, 600 * i, 1e18 if a == 0 else a + 0.5) for a in range(accounts) for i in range(10)]
        frame = pd.DataFrame(rows, columns=["tx_id", "account", "at", "Amount"]).sample(frac=1, random_state=1)
        list(lookback.handleInputRows((0,), iter([frame]), Now))
        out = pd.concat([f for end in sorted(ends) for f in lookback.handleExpiredTimer((0,), Now, type("T", (), {"getExpiryTimeInMs": lambda self, end=end: end})())])
        got = {r.tx_id: (r.Sender_window_count, r.Sender_window_amount) for r in out.itertuples()}
        assert got == {k: (min(k % 10, 6), min(k % 10, 6) * v) for k, _, _, v in rows}
        assert calls[0] < 40 and not lookback.sums and not lookback.waiting and not lookback.parts


def test_prompt_lookback_keeps_what_late_rows_look_back_to(spark, tmp_path):
    from tidewatch.streaming.jobs import running_lookback

    at = lambda h: T0 + dt.timedelta(hours=h)
    schema = "tx_id long, Sender_account long, Amount double, ts timestamp"
    parts = [spark.createDataFrame(b, schema) for b in ([(0, 1, 1.0, at(0)), (1, 1, 2.0, at(10)), (2, 1, 4.0, at(36))], [(3, 1, 8.0, at(20))])]
    got = {r.tx_id: (r.Sender_window_count, r.Sender_window_amount) for r in arrived_in(spark, tmp_path, parts, lambda s: running_lookback(s, 86_400), "p").collect()}
    assert got == {0: (0, 0.0), 1: (1, 1.0), 2: (0, 0.0), 3: (2, 3.0)}


def test_window_sums_of_rows_without_time_and_odd_amounts(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        (0, 1, 7, 1e15, 0, 0, "A", at(0)), (1, 1, 8, 0.1, 0, 0, "A", at(1)), (2, 1, 8, 3e-7, 0, 0, "A", at(2)), (3, 1, 9, 5.0, 0, 0, "A", None), (4, 1, 9, None, 0, 0, "A", at(3)),
        (5, 1, 9, 2.0**60 + 2.0**20, 0, 0, "A", at(30)), (6, 1, 7, -(2.0**60), 0, 0, "A", at(31)), (7, 1, 7, 0.25, 0, 0, "A", at(32)),
        (8, 1, 7, float("nan"), 0, 0, "A", at(60)), (9, 1, 7, 1.0, 0, 0, "A", at(61)), (10, 1, 7, 2.0, 0, 0, "A", at(100)), (11, 1, 7, float("inf"), 0, 0, "A", at(101)), (12, 1, 7, 4.0, 0, 0, "A", at(102)), (13, 1, 7, 4.0, 0, 0, "A", at(126)),
    ]
    got = {r.tx_id: (r.Sender_window_count, r.Sender_window_amount, r.Sender_window_unique) for r in W.rolling(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[0] == (0, 0.0, 0) and got[1] == (1, 1e15, 1) and got[3] == (0, 0.0, 0)
    assert got[2] == (2, 1e15 + 0.1, 2) and got[4] == (3, 1e15 + 0.1, 2)
    assert got[6] == (1, 2.0**60 + 2.0**20, 1) and got[7] == (2, 2.0**20, 2)
    assert np.isnan(got[9][1]) and got[10][:2] == (0, 0.0) and got[12][1] == float("inf") and got[13][:2] == (1, 4.0)
    lone = [(0, 1, 7, 1e-7, 0, 0, "A", at(0)), (1, 1, 7, 1.0, 0, 0, "A", at(1))]
    assert abs(W.rolling(spark.createDataFrame(lone, COLUMNS)).where("tx_id = 1").first().Sender_window_amount - 1e-7) < 2.0**-32


@pytest.mark.parametrize("hot", [1_000_000, 25, 1])
def test_history_of_any_account_is_that_of_one_window(spark, hot):
    """Bands of time with what they carry, against all rows of the account in one window; ties, nulls and a hot account."""
    rng = random.Random(hot)
    rows = [(i, rng.choice((None, 1, 1, 1, 2, 3)), rng.choice((None, 4, 4, 5)), rng.choice((None, 2.5, 10.0)), rng.choice((None, T0 + dt.timedelta(seconds=rng.choice((rng.randrange(90), rng.randrange(9 * 3600))))))) for i in range(160)]
    rows += [(1000 + i, 1, 4, 2.5, T0 - dt.timedelta(days=40 * 365, seconds=i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "tx_id long, Sender_account long, Receiver_account long, Amount double, ts timestamp")
    key = lambda r: (r[4] is None, r[4] or T0, r[0])
    for r in W.history(df, hot).collect():
        for side, c in (("Sender", 1), ("Receiver", 2)):
            me = next(x for x in rows if x[0] == r.tx_id)
            before = sorted((x for x in rows if x[c] == me[c] and key(x) < key(me)), key=key)
            total = sum(x[3] or 0.0 for x in before)
            gap = (me[4] - before[-1][4]).total_seconds() if before and me[4] and before[-1][4] else -1.0
            assert (r[f"{side}_prior_count"], r[f"{side}_prior_amount"], r[f"{side}_gap"]) == (len(before), total, gap)
            assert r[f"{side}_prior_average"] == (total / len(before) if before else 0.0)


def test_partners_reached_through_an_account(spark):
    """Distinct ends of time buckets against all pairs of transfers; times before 1970 too."""
    rng = random.Random(6)
    rows = [(rng.randrange(6), rng.randrange(6), rng.randrange(-400, 900)) for _ in range(150)] + [(1, 2, -7), (2, 3, 7), (7, 8, -50), (8, 9, 50)]
    rows = [r for r in rows if r[0] != r[1]]
    e = spark.createDataFrame(rows, "src long, dst long, at long")
    for seconds in (7, 60):
        want = {(a, m, c) for a, m, t in rows for n, c, u in rows if n == m and a != c and t < u <= t + seconds}
        got = [tuple(r) for r in N.reached(e, seconds).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_hub_of_many_transfers_is_its_partners(spark):
    """10 ** 5 transfers in and as many out within one bucket, between 60 partners: 3,600 pairs of ends, not 10 ** 10 of transfers."""
    hub = spark.range(100_000).select((F.col("id") % 60 + 1).alias("p"), F.pmod(F.xxhash64("id"), F.lit(86_400)).alias("at"))
    e = hub.select(F.col("p").alias("src"), F.lit(0).cast("long").alias("dst"), "at").unionByName(hub.select(F.lit(0).cast("long").alias("src"), (F.col("p") + 30).alias("dst"), (F.col("at") + 40).alias("at")))
    assert N.reached(e, 86_400).where("mid = 0").count() == 60 * 60 - 30


def test_points_in_intervals(spark):
    from tidewatch.operators.intervals import within

    rng = random.Random(9)
    at = lambda s: T0 + dt.timedelta(hours=s)
    points = [(i, rng.choice((None, 1, 1, 2)), rng.choice((None, *(at(rng.randrange(-900, 900)) for _ in range(9))))) for i in range(120)]
    spans = [(j, rng.choice((None, 1, 2)), at(a := rng.randrange(-900, 900)), rng.choice((None, at(a), at(a + rng.randrange(1000)), at(a - 1)))) for j in range(60)]
    a, b = spark.createDataFrame(points, "i long, k long, t timestamp"), spark.createDataFrame(spans, "j long, k long, low timestamp, high timestamp")
    want = sorted((i, j) for i, k, t in points for j, m, low, high in spans if k is not None and k == m and None not in (t, high) and low <= t <= high)
    for days in (1, 7):
        out = within(a, b, "k", "t", "low", "high", days)
        assert out.columns == ["k", "i", "t", "j", "low", "high"] and sorted((r.i, r.j) for r in out.collect()) == want


def test_other_names_of_countries(spark):
    want = {
        "Russian Federation": "RU", "Viet Nam": "VN", "Socialist Republic of Viet Nam": "VN", "Czech Republic": "CZ", "Republic of Korea": "KR", "Korea, Republic of": "KR", "Korea, Democratic People's Republic of": "KP", "Hong Kong": "HK",
        "Türkiye": "TR", "Turkiye": "TR", "Republic of Türkiye": "TR", "Congo, The Democratic Republic of the": "CD", "Democratic Republic of the Congo": "CD", "Republic of the Congo": "CG", "Cote d'Ivoire": "CI", "Côte d'Ivoire": "CI", "Ivory Coast": "CI",
        "Iran, Islamic Republic of": "IR", "Islamic Republic of Iran": "IR", "Kingdom of the Netherlands": "NL", "Republic of the Philippines": "PH", "Grand Duchy of Luxembourg": "LU", "Federal Republic of Germany": "DE", "People's Republic of China": "CN",
        "Republic of China": None, "Commonwealth of the Bahamas": "BS", "Tanzania, United Republic of": "TZ", "United Republic of Tanzania": "TZ", "Swaziland": "SZ", "Macao": "MO", "Holy See (Vatican City State)": "VA", "Kingdom of France": None, "Republic of": None,
        "Niger": "NE", "Nigeria": "NG", "Guinea": "GN", "Guinea-Bissau": "GW", "Dominica": "DM", "Dominican Republic": "DO", "Åland Islands": "AX", "Aland Islands": "AX", "the United States of America": "US", "State of Palestine": "PS",
    }
    df = spark.createDataFrame([(n,) for n in want], "c string")
    got = {r.c: r.x_iso2 for r in S.with_country_codes(df, S.countries(spark), "c", "x").collect()}
    assert got == want


def test_every_country_by_all_its_names(spark):
    """Each code of the standard by its codes, short name and each of its other names; keys are unique and lead to one country."""
    from tidewatch.functions.countries import FORMS, OTHER_NAMES, cleaned

    known = S.countries(spark).collect()
    keys = {r.key: r.iso2 for r in known}
    assert len(keys) == len(known) and len(set(keys.values())) >= 249
    locale = spark._jvm.java.util.Locale
    codes = list(locale.getISOCountries())
    for code in codes:
        for name in (code, locale("", code).getISO3Country(), locale("", code).getDisplayCountry(locale.ENGLISH)):
            assert keys[cleaned(name)] == code
    for line in OTHER_NAMES.strip().splitlines():
        code, names = line.split(" ", 1)
        for name in names.split(";"):
            assert keys[cleaned(name)] == code, name
    listed = [c for x in FORMS.values() for c in x.split()]
    assert set(listed) <= set(codes) and len(listed) == len(set(listed))


def test_hot_accounts_are_counted_on_rows_without_percentiles(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(W, "hot_among", lambda rows, keys, hot=None: counted.append(set(rows.columns)) or set())
    monkeypatch.setattr(N, "hot_among", W.hot_among, raising=False)
    rows = [(0, 1, 7, 1.0, 0, 0, "A", T0), (1, 1, 8, 3.0, 0, 0, "B", T0 + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.tx_id: (r.n, r.median_amount) for r in W.sliding(df, 21).collect()}
    assert got == {0: (1, 1.0), 1: (2, 2.0)}
    N.behaviour_change(df)
    assert counted == [set(df.columns)] * 2
    W.sliding(df, 21, among=set())
    assert len(counted) == 2
