"""Fitted trees as tables, SQL and joins against the library that fitted them; exact stratified folds."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ml, profiles as P, trees


@pytest.fixture(scope="module")
def learning(spark, tmp_path_factory):
    """Rows with places that train doesn't have, nulls and quotes in names."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        x, c = rng.random() * 100, rng.choice(("a", "b", "it's", "c"))
        rows.append((i, x, -1.0 if rng.random() < 0.03 else rng.random(), c, int(x > 80 or (c == "b" and rng.random() < 0.5)), "train" if i < 600 else "holdout"))
    rows += [(900 + i, 50.0, 0.5, v, 0, "holdout") for i, v in enumerate((None, "new", ""))]
    df = spark.createDataFrame(rows, "tx_id long, x double, y double, c string, Is_laundering int, split string")
    used = {"Log_amount": F.col("x"), "Sender_gap": F.col("y"), "Payment_type": F.col("c"), "Sender_bank_location": F.upper("c")}
    df = df.select("tx_id", "Is_laundering", "split", *(used.get(c, F.lit("k")).alias(c) for c in ml.CATEGORICAL), *(used.get(c, F.lit(1.0)).alias(c) for c in ml.NUMERIC))
    path = str(tmp_path_factory.mktemp("rows") / "t")
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path), path


SMALL = {
    "decision_tree": lambda: ml.MODELS["decision_tree"]().setMinInstancesPerNode(5),
    "random_forest": lambda: ml.MODELS["random_forest"]().setNumTrees(7).setMaxDepth(5),
    "boosted_trees": lambda: ml.MODELS["boosted_trees"]().setMaxIter(5).setMaxDepth(3),
}


@pytest.fixture(params=sorted(SMALL))
def fitted(request, learning, monkeypatch):
    monkeypatch.setitem(ml.MODELS, f"small {request.param}", SMALL[request.param])
    rows, path = learning
    model = ml.fit(rows.where("split = 'train'"), f"small {request.param}")
    return model, rows, path, trees.nodes(model, rows)


def test_nodes_decide_as_the_model_does(fitted):
    model, rows, path, table = fitted
    assert table.columns == list(trees.NODES)
    want = {r.tx_id: r.probability_1 for r in ml.score(model, rows).select("tx_id", "probability_1").collect()}
    got = {r.tx_id: r.probability for r in trees.walked(rows, table, trees.categories(model), "tx_id", trees.is_boosted(model)).collect()}
    assert len(want) == 903 and got == pytest.approx(want, abs=1e-12)
    if not hasattr(model.stages[-1], "trees"):
        case = trees.tree_sql(table, trees.categories(model))
        other = dict(duckdb.sql(f"SELECT tx_id, {case} FROM '{path}/*.parquet'").fetchall())
        assert other == pytest.approx(want, abs=1e-12) and len(set(other.values())) > 3


def test_gains_are_the_importances(fitted):
    model, rows, _, table = fitted
    want = {r.feature: r.importance for r in ml.importances(model, rows, 10**6).collect() if r.importance}
    got = {r.feature: r.importance for r in trees.gains(table, trees.is_boosted(model)).collect() if r.importance}
    assert got == pytest.approx(want, abs=1e-9) and sum(got.values()) == pytest.approx(1)


def test_a_tree_of_one_leaf(spark, learning):
    rows = learning[0].where("split = 'train'").withColumn("Is_laundering", F.lit(0))
    model = ml.fit(rows)
    table = trees.nodes(model, rows)
    assert table.count() == 1 and trees.tree_sql(table, {}) == "CAST(0.0 AS DOUBLE)" and trees.gains(table).count() == 0
    assert {r.probability for r in trees.walked(rows, table, {}, "tx_id", False).collect()} == {0.0}


def test_folds_have_their_exact_share(spark):
    rows = [(i, 1 if i % 50 == 0 else None if i % 97 == 0 else 0) for i in range(3_001)] + [(7, 0)] * 5
    df = spark.createDataFrame(rows, "tx_id long, Is_laundering int")
    for share in (0.2, 0.5, 0.0, 1.0):
        got = P.stratified_split(df, share, 3).collect()
        assert len(got) == len(rows)
        for label in (0, 1, None):
            mine = [r for r in got if r.Is_laundering == label]
            test = [r for r in mine if r.fold == "test"]
            assert len(test) == int(share * len(mine) + 0.5)
            place = lambda r: hashlib.md5(f"3|{'' if label is None else label}|{r.tx_id}".encode()).hexdigest()  # noqa: E731, B023
            assert not test or len(test) == len(mine) or max(map(place, test)) <= min(place(r) for r in mine if r.fold != "test")


def test_walking_neither_shuffles_nor_multiplies_rows(spark, learning):
    rows, _ = learning
    table = spark.createDataFrame(
        [(k, 1.0, n, f, t, None, l, r, None, None, says) for k in range(9) for n, f, t, l, r, says in ((0, "Log_amount", 50.0, 1, 2, 0.5), (1, None, None, None, None, 0.25), (2, None, None, None, None, 0.75))],
        "tree int, weight double, node int, feature string, threshold double, values array<double>, left int, right int, gain double, rows double, says double",
    )
    out = trees.walked(rows, table, {}, "tx_id", False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.tx_id: r.probability for r in out.collect()}
    assert got == {r.tx_id: 0.25 if r.Log_amount <= 50 else 0.75 for r in rows.collect()}


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(learning, monkeypatch):
    assert ml.MODELS["random_forest"]().getCacheNodeIds()
    train = learning[0].where("split = 'train'")
    grown = []
    for kept in (True, False):
        monkeypatch.setitem(ml.MODELS, "small", lambda kept=kept: SMALL["random_forest"]().setCacheNodeIds(kept))
        grown.append(ml.fit(train, "small").stages[-1].toDebugString.split("\n", 1)[1])
    assert grown[0] == grown[1]
