"""Queries of fitted models: what SQL can state of them. Trees differ with their training, but their features, the rows they answer
for, and that their exported form decides as they do, can be counted."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..operators import ml, trees
from ..sources.tables import written
from .registry import _F, _H, _RISK, _SPLIT, _learning_rows, _query

_NUMERIC = {
    "Log_amount": "ln(1+Amount)", "Sender_risk": _RISK.format("Sender_bank_location"), "Receiver_risk": _RISK.format("Receiver_bank_location"), "Cross_border": "Cross_border", "Hour": "Hour", "Day_of_week": "Day_of_week", "Is_weekend": "Is_weekend",
    "Is_night": "Is_night", "Currency_mismatch": "Currency_mismatch", "Risk_difference": f"abs({_RISK.format('Sender_bank_location')}-{_RISK.format('Receiver_bank_location')})", "Max_country_risk": "risk", "Any_sanctioned": "sanction",
    "Sender_prior_count": "spc", "Receiver_prior_count": "rpc", "Sender_prior_amount": "spa", "Receiver_prior_amount": "rpa", "Sender_prior_average": "CASE WHEN spc>0 THEN spa/spc ELSE 0 END", "Receiver_prior_average": "CASE WHEN rpc>0 THEN rpa/rpc ELSE 0 END",
    "Sender_gap": "gap", "Receiver_gap": "rgap",
}
_SLOTS = " UNION ALL ".join(f"SELECT '{n}' AS slot, round(CAST(sum({c}) AS DOUBLE),3) AS total FROM h" for n, c in _NUMERIC.items()) + "".join(
    f" UNION ALL SELECT '{c}_v_' || {c}, CAST(count(*) AS DOUBLE) FROM h GROUP BY {c} UNION ALL SELECT '{c}_v___unknown', CAST(0 AS DOUBLE)" for c in ml.CATEGORICAL
)


def _fitted(spark, sf_dir, model):
    """The model, fitted on train; all rows; its nodes."""
    rows = written(_learning_rows(spark, sf_dir), "learning-rows")
    fitted = ml.fit(rows.where("split = 'train'"), model)
    return fitted, rows, written(trees.nodes(fitted, rows), "nodes")


@_query(_F + _H + " " + _SLOTS)
def m1_m2_feature_vector(spark, sf_dir):
    """The sum of each slot of the assembled feature vector, encoded categories included, over all rows."""
    rows = written(_learning_rows(spark, sf_dir), "learning-rows")
    fitted = ml.features(rows)
    vectors = fitted.transform(rows)
    total = vectors.agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("m"))  # one row
    names = F.array(*map(F.lit, trees.slot_names(fitted, rows)))
    return total.select(F.posexplode("m").alias("i", "total")).select(F.get(names, F.col("i")).alias("slot"), F.round("total", 3).alias("total"))


@_query(", k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM tx GROUP BY 2" for c in ml.CATEGORICAL) + ") SELECT \"column\", value, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value)-1 AS INT) AS slot FROM k")
def m2_categories(spark, sf_dir):
    """The slot of each category: the more frequent ones first, then by name."""
    known = trees.categories(ml.features(written(_learning_rows(spark, sf_dir), "learning-rows")))
    return spark.createDataFrame([(c, v, i) for c, values in known.items() for i, v in enumerate(values)], "column string, value string, slot int")


_HOLDOUT = _SPLIT + ", s AS (SELECT *, CASE WHEN CAST(ts AS DATE)<=e1 THEN 'train' WHEN CAST(ts AS DATE)<=e2 THEN 'development' ELSE 'holdout' END AS split FROM tx, b)"
_AGREES = _HOLDOUT + " SELECT count(*) AS rows, count(*) AS scored, CAST(0 AS BIGINT) AS differing FROM s WHERE split='holdout'"


def _compared(rows, own, other):
    """Rows, rows with a score, and rows whose scores of two ways differ."""
    x = rows.select("tx_id").join(own, "tx_id", "left").join(other, "tx_id", "left")
    unlike = ~F.coalesce(F.abs(F.col("p") - F.col("q")) < 1e-9, F.lit(False))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count("q").alias("scored"), F.sum(unlike.cast("long")).alias("differing"))


@_query(_AGREES)
def m3_compiled_tree(spark, sf_dir):
    """The decision tree as one CASE expression against the model's own scores, on all rows of the holdout."""
    fitted, rows, table = _fitted(spark, sf_dir, "decision_tree")
    rows = rows.where("split = 'holdout'")
    case = F.expr(trees.tree_sql(table, trees.categories(fitted), quote="`"))
    return _compared(rows, ml.score(fitted, rows).select("tx_id", F.col("probability_1").alias("p")), rows.select("tx_id", case.alias("q")))


@_query(_HOLDOUT + " SELECT count(*) AS rows, CAST(sum(Is_laundering) AS BIGINT) AS positives FROM s WHERE split='train'")
def m6_leaves_hold_train(spark, sf_dir):
    """Rows and positives of train, added up over the leaves of the tree: each row is in one leaf, whose share is that of its rows by class weight."""
    fitted, rows, table = _fitted(spark, sf_dir, "decision_tree")
    train = rows.where("split = 'train'")
    n, p = train.agg(F.count(F.lit(1)), F.sum("Is_laundering")).first()
    each = train.select("Is_laundering", F.expr(trees.tree_sql(table, trees.categories(fitted), quote="`")).alias("says"))
    leaf = each.groupBy("says").agg(F.count(F.lit(1)).alias("n"), F.sum("Is_laundering").alias("p"))
    weight = (n - p) / p if p else 1.0
    share = F.col("p") * weight / (F.col("p") * weight + F.col("n") - F.col("p"))
    right = leaf.where(F.abs(share - F.col("says")) < 1e-9)
    return right.agg(F.sum("n").alias("rows"), F.sum("p").alias("positives"))


def _walked(spark, sf_dir, model):
    fitted, rows, table = _fitted(spark, sf_dir, model)
    rows = rows.where("split = 'holdout'")
    other = trees.walked(rows, table, trees.categories(fitted), "tx_id", trees.is_boosted(fitted))
    return _compared(rows, ml.score(fitted, rows).select("tx_id", F.col("probability_1").alias("p")), other.select("tx_id", F.col("probability").alias("q")))


@_query(_AGREES)
def m4_walked_forest(spark, sf_dir):
    """The forest as a table of nodes, walked by batches of rows, against the model's own scores."""
    return _walked(spark, sf_dir, "random_forest")


@_query(_AGREES)
def m5_walked_boosted_trees(spark, sf_dir):
    return _walked(spark, sf_dir, "boosted_trees")


@_query(" SELECT CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS differing")
def m7_importances_of_gains(spark, sf_dir):
    """Importances worked out from the gains of the tree's nodes against those of the library: their sum, and how many differ."""
    fitted, rows, table = _fitted(spark, sf_dir, "decision_tree")
    library = ml.importances(fitted, rows, 10**6).withColumnRenamed("importance", "own")
    both = library.join(trees.gains(table), "feature", "full_outer")
    unlike = F.abs(F.coalesce("own", F.lit(0.0)) - F.coalesce("importance", F.lit(0.0))) > 1e-9
    return both.agg(F.round(F.sum("importance"), 9).alias("total"), F.sum(unlike.cast("long")).alias("differing"))
