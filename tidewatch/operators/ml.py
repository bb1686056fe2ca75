"""Classifiers on transaction features, trained on earlier days and scored on later ones."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

CATEGORICAL = ("Payment_currency", "Received_currency", "Sender_bank_location", "Receiver_bank_location", "Payment_type")
NUMERIC = (
    "Log_amount", "Sender_risk", "Receiver_risk", "Cross_border", "Hour", "Day_of_week", "Is_weekend", "Is_night", "Currency_mismatch", "Risk_difference", "Max_country_risk", "Any_sanctioned",
    "Sender_prior_count", "Receiver_prior_count", "Sender_prior_amount", "Receiver_prior_amount", "Sender_prior_average", "Receiver_prior_average", "Sender_gap", "Receiver_gap",
)
MODELS = {
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=50, seed=42),
    "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, cacheNodeIds=True),  # rows keep their node of each tree: same trees, no walk from the root at each level
    "boosted_trees": lambda: GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.1, seed=42),
}


def _encoders() -> list:
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_i" for c in CATEGORICAL], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_v" for c in CATEGORICAL], handleInvalid="keep")
    return [index, hot, VectorAssembler(inputCols=[*hot.getOutputCols(), *NUMERIC], outputCol="features", handleInvalid="keep")]


def features(rows: DataFrame) -> PipelineModel:
    """The encoders alone, fitted: they add ``features``."""
    return Pipeline(stages=_encoders()).fit(rows)


def fit(train: DataFrame, model: str = "decision_tree", label: str = "Is_laundering") -> PipelineModel:
    n, p = train.agg(F.count(F.lit(1)), F.sum(label)).first()
    weight = (n - p) / p if p else 1.0
    train = train.withColumn("_weight", F.when(F.col(label) == 1, weight).otherwise(1.0))
    tree = MODELS[model]().setLabelCol(label).setFeaturesCol("features").setWeightCol("_weight")
    return Pipeline(stages=[*_encoders(), tree]).fit(train)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("probability_1", vector_to_array("probability")[1])


def importances(model: PipelineModel, rows: DataFrame, n: int = 20) -> DataFrame:
    """(feature, importance) of the ``n`` features that the trees use most; their number is that of the features, not of rows."""
    meta = model.transform(rows.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in meta.values() for a in kind}
    weights = model.stages[-1].featureImportances.toArray()
    ranked = sorted(((names[i], float(w)) for i, w in enumerate(weights)), key=lambda x: (-x[1], x[0]))[:n]
    return rows.sparkSession.createDataFrame(ranked, "feature string, importance double")


def frozen_evaluation(rows: DataFrame, model: str = "decision_tree", rate: float = 0.05, label: str = "Is_laundering") -> DataFrame:
    """Fitted on train, its threshold set on development (the score of the row that ends ``rate`` of them), then one evaluation on holdout."""
    from . import evaluation as E

    fitted = fit(rows.where("split = 'train'"), model, label)
    scored = lambda part: score(fitted, rows.where(F.col("split") == part)).select(label, "probability_1")
    point = E.operating_points(scored("development"), (rate,), "probability_1", label).select("threshold")
    test = scored("holdout").crossJoin(F.broadcast(point)).withColumn("alert", (F.col("probability_1") >= F.col("threshold")).cast("int"))
    out = E.binary_metrics(test, "alert", model, label).crossJoin(E.ranking_metrics(test, "probability_1", label))
    return out.crossJoin(F.broadcast(point))


def past_target_rate(tx: DataFrame, by: str = "Sender_bank_location", label: str = "Is_laundering", prior: float = 10.0) -> DataFrame:
    """Label rate of earlier days per value of ``by``, drawn to the rate of all earlier days; summed per day first."""
    from pyspark.sql import Window

    day = F.to_date("ts")
    d = tx.groupBy(F.col(by).alias(by), day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    w = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n, p = F.coalesce(F.sum("n").over(w), F.lit(0)), F.coalesce(F.sum("p").over(w), F.lit(0))
    return d.withColumns({"past_n": n, "past_rate": F.round(p / (n + F.lit(prior)), 6)}).select(by, "day", "past_n", "past_rate")
