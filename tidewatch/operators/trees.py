"""Fitted trees as tables and expressions: what a model decides, without the library that fitted it.

``nodes`` is a row for each node of each tree: the feature it asks for, by name and values of the input columns, where it sends what is below
its threshold or of its values, its gain and weight, and what its leaf says. A single tree becomes one SQL CASE expression, which
any engine can run; an ensemble is walked by that table, which is as large as the model and no larger. Feature
importances follow from the gains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.tables import shared_path

NODES = ("tree", "weight", "node", "feature", "threshold", "values", "left", "right", "gain", "rows", "says")


def slot_names(model: PipelineModel, rows: DataFrame) -> list[str]:
    """Names of the slots of the feature vector; an encoded category is <column>_v_<value>."""
    meta = model.transform(rows.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in meta.values() for a in kind}
    return [names[i] for i in range(len(names))]


def is_boosted(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], GBTClassificationModel)


def nodes(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The columns ``NODES`` of all trees of the fitted model. ``says`` is the share of the positive class in a node of a classifier and
    the prediction in one of a boosted tree; ``values``: those of an encoded slot that go left, null for a threshold."""
    spark, tree = rows.sparkSession, model.stages[-1]
    boosted = is_boosted(model)
    path = shared_path(spark, "tree")
    tree.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(tree.treeWeights)], "tree int, weight double")
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(weights), "tree")  # a row a tree
    else:
        data = data.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})
    names = F.array(*map(F.lit, slot_names(model, rows)))
    stats = F.col("impurityStats")
    says = F.col("prediction") if boosted else F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    inner, by_value = F.col("leftChild") >= 0, F.col("split.numCategories") >= 0
    where = F.col("split.leftCategoriesOrThreshold")
    return data.select(
        "tree", "weight", F.col("id").alias("node"), F.when(inner, F.get(names, "split.featureIndex")).alias("feature"), F.when(inner & ~by_value, F.get(where, F.lit(0))).alias("threshold"), F.when(inner & by_value, where).alias("values"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), F.when(inner, F.col("gain")).alias("gain"), F.aggregate(F.slice(stats, 1, 1) if boosted else stats, F.lit(0.0), lambda a, x: a + x).alias("rows"), says.alias("says"),
    )


def slot_sql(name: str, categories: dict[str, list[str]], quote: str = '"') -> str:
    """SQL of a slot's value over the input columns. ``categories``: the known values of each encoded column; any other, null too, is unknown."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    for column, known in categories.items():
        if name.startswith(f"{column}_v_"):
            value = name.removeprefix(f"{column}_v_")
            if value in known:
                return f"CASE WHEN {quote}{column}{quote} = {text(value)} THEN 1.0 ELSE 0.0 END"
            return f"CASE WHEN {quote}{column}{quote} IN ({', '.join(map(text, known))}) THEN 0.0 ELSE 1.0 END"
    return f"CAST({quote}{name}{quote} AS DOUBLE)"


def categories(model: PipelineModel) -> dict[str, list[str]]:
    index = model.stages[0]
    return dict(zip(index.getInputCols(), map(list, index.labelsArray), strict=True))


def tree_sql(table: DataFrame, known: dict[str, list[str]], tree: int = 0, quote: str = '"') -> str:
    """One CASE expression for a tree of ``nodes``; its size is that of the tree."""
    rows = {r.node: r for r in table.where(F.col("tree") == tree).collect()}

    def of(k: int) -> str:
        r = rows[k]
        if r.left is None:
            return f"CAST({r.says!r} AS DOUBLE)"
        slot = slot_sql(r.feature, known, quote)
        test = f"{slot} <= CAST({r.threshold!r} AS DOUBLE)" if r["values"] is None else f"{slot} IN ({', '.join(map(repr, r['values']))})"
        return f"CASE WHEN {test} THEN {of(r.left)} ELSE {of(r.right)} END"

    return of(0)


def walked(rows: DataFrame, table: DataFrame, known: dict[str, list[str]], key: str, boosted: bool) -> DataFrame:
    """(key, probability): each row sent down every tree of ``table``, a level at a time; ``key`` names a row.

    The table is as large as the model; it is sent to the tasks, where all rows of an Arrow batch go down a tree together, so no row is multiplied by
    the trees or shuffled. Leaves are averaged, or, boosted, summed by weight and put through the logistic function of twice the margin."""
    nodes = [r.asDict() for r in table.orderBy("tree", "node").collect()]  # those of the model
    used = sorted({r["feature"] for r in nodes if r["feature"]})
    slots = [F.expr(slot_sql(n, known, "`")).cast("double").alias(f"_x{i}") for i, n in enumerate(used)]
    x = rows.select(key, *slots)
    return x.mapInArrow(_walk(_packed(nodes, used), len(used), boosted), T.StructType([x.schema[key], T.StructField("probability", T.DoubleType())]))


def _packed(nodes: list[dict], used: list[str]) -> list[tuple]:
    """Trees as (weight, levels, slot, threshold, values by node, left, right, says); a leaf leads to itself. ``values`` are the
    bits of a long where a node asks for whole numbers from 0 to 62, as those of encoded slots are, else an array by node."""
    trees: dict[int, list[dict]] = {}
    for r in nodes:
        trees.setdefault(r["tree"], []).append(r)
    place, out = {n: i for i, n in enumerate(used)}, []
    for mine in trees.values():
        at = {r["node"]: i for i, r in enumerate(mine)}
        inner = [r["left"] is not None for r in mine]
        to = lambda side, mine=mine, at=at: np.array([i if r[side] is None else at[r[side]] for i, r in enumerate(mine)])
        left, right = to("left"), to("right")
        levels, level = 0, [at[0]]
        while level := [int(c) for i in level if inner[i] for c in (left[i], right[i])]:
            levels += 1
        slot = np.array([place[r["feature"]] if r["feature"] else 0 for r in mine])
        threshold = np.array([np.nan if r["threshold"] is None else r["threshold"] for r in mine])
        asks = {i: r["values"] for i, r in enumerate(mine) if r["values"] is not None}
        small = {i for i, v in asks.items() if all(x in range(63) for x in v)}
        bits = np.array([sum(1 << int(x) for x in set(asks[i])) if i in small else 0 for i in range(len(mine))], np.int64)
        values = (bits if small else None, {i: np.array(v) for i, v in asks.items() if i not in small})
        out.append((mine[0]["weight"], levels, at[0], slot, threshold, values, left, right, np.array([r["says"] for r in mine])))
    return out


def _walk(trees: list[tuple], width: int, boosted: bool):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.empty((n, max(width, 1)))
            for i in range(width):  # a null goes right, as a NaN does
                x[:, i] = batch.column(i + 1).to_numpy(zero_copy_only=False)
            total, row = np.zeros(n), np.arange(n)
            for weight, levels, root, slot, threshold, values, left, right, says in trees:
                node = np.full(n, root)
                for _ in range(levels):
                    v = x[row, slot[node]]
                    goes = v <= threshold[node]
                    bits, others = values
                    if bits is not None:
                        whole = (v >= 0) & (v <= 62) & (v == np.floor(v))
                        goes |= whole & ((bits[node] >> np.where(whole, v, 0).astype(np.int64)) & 1 == 1)
                    for i, some in others.items():
                        here = node == i
                        goes[here] = np.isin(v[here], some)
                    node = np.where(goes, left[node], right[node])
                total += weight * says[node]
            answer = 1 / (1 + np.exp(-2 * total)) if boosted else total / sum(t[0] for t in trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answer, pa.float64())], [batch.schema.names[0], "probability"])

    return run


def gains(table: DataFrame, boosted: bool = False) -> DataFrame:
    """(feature, importance): each tree's gains by feature, weighted by the rows of their nodes and, but for boosted trees, scaled to 1; then
    those of all trees scaled to 1."""
    each = table.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    whole: Column = F.sum("g").over(Window.partitionBy("tree"))
    each = each.withColumn("s", F.col("g") if boosted else F.when(whole > 0, F.col("g") / whole).otherwise(0.0)).groupBy("feature").agg(F.sum("s").alias("s"))
    total = each.agg(F.sum("s").alias("all"))
    return each.crossJoin(F.broadcast(total)).select("feature", (F.col("s") / F.col("all")).alias("importance"))  # one row
