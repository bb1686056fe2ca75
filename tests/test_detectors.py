"""Account-window detectors against brute force over rows, windows and settings."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors as W

T0 = dt.datetime(2023, 5, 1)
COLUMNS = "tx_id long, Sender_account long, Receiver_account long, Amount double, Cross_border int, Currency_mismatch int, Is_laundering int, Laundering_type string, ts timestamp"


def payments(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice((None, 1, 1, 2, 3, 4)), rng.choice((None, 7, 8)), rng.choice((1.0, 5.0, 100.0)), rng.randrange(2), rng.randrange(2), int(rng.random() < 0.3), rng.choice("ab"), T0 + dt.timedelta(hours=rng.randrange(24 * 25))) for i in range(n)]


@pytest.mark.parametrize("days", [None, 10])
def test_grid_goes_back_to_rows_and_accounts(spark, days):
    rows = payments(400, 3)
    settings = [(n, t) for n in (2, 4) for t in (5.0, 50.0, 1e9)]
    conditions = [(F.col("n") >= n) & (F.col("total") >= t) & (F.col("median_amount") < 50) & (F.col("unique_others") <= 2) for n, t in settings]
    got = {r.setting: r for r in W.account_grid(spark.createDataFrame(rows, COLUMNS), "Sender_account", "Receiver_account", days, conditions, "a").collect()}
    epoch = dt.datetime(1970, 1, 1)
    bucket = lambda t: (t - epoch).days // (days or 1)
    windows = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            windows[r[1], bucket(r[8])].append(r)
    target = [r for r in rows if r[6] == 1 and r[7] == "a"]
    assert len(got) == len(settings)
    for k, (n, t) in enumerate(settings):
        flagged = {w for w, x in windows.items() if len(x) >= n and sum(r[3] for r in x) >= t and np.median([r[3] for r in x]) < 50 and len({r[2] for r in x} - {None}) <= 2}
        hit = [r for r in rows if r[1] is not None and (r[1], bucket(r[8])) in flagged]
        mine = [r for r in hit if r in target]
        g = got[k]
        assert (g.triggered, g.aml_cases, g.target_cases, g.target_hits) == (len(hit), sum(r[6] for r in hit), len(target), len(mine))
        assert (g.flagged_accounts, g.target_accounts, g.hit_accounts) == (len({r[1] for r in hit}), len({r[1] for r in target} - {None}), len({r[1] for r in mine}))
        assert g.trigger_rate == round(len(hit) / len(rows), 6) and g.account_recall == round(g.hit_accounts / g.target_accounts, 6)
    assert any(g.target_hits for g in got.values()) and any(not g.triggered for g in got.values())


def test_masks(spark):
    df = spark.createDataFrame([(0,), (5,), (None,)], "x int")
    got = [r.mask for r in W.masked(df, [F.col("x") >= k for k in range(63)]).collect()]
    assert got == [1, 0b111111, 0]
    for bad in ([], [F.lit(True)] * 64):
        with pytest.raises(ValueError):
            W.masked(df, bad)


def test_nothing_to_evaluate(spark):
    out = W.account_grid(spark.createDataFrame([], COLUMNS), "Sender_account", "Receiver_account", 10, [F.col("n") > 0], "a").collect()
    assert [(r.setting, r.triggered, r.account_recall) for r in out] == [(0, 0, 0.0)]
