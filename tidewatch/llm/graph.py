"""Connected components by repeated contraction, as joins and aggregations.

In each round every node takes the neighbour (or itself) of least priority as its new name, edges are renamed, and loops
and repetitions go. Priorities are a hash of the node and the round, so long chains shrink by a constant factor a round.
Each round's edges and names are written to the shared folder, so the lineage stays short; they go when the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import temporary, written


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root names the component (any one of its nodes).

    Loops and repeated edges are allowed; no edges give an empty table. Each round is expected to
    leave a fixed share of the nodes that still have edges, so ``rounds`` is far more than any table needs.
    """
    with temporary(edges.sparkSession, "components"):
        return written(_contracted(edges, rounds), "roots", outside=True)


def _contracted(edges: DataFrame, rounds: int) -> DataFrame:
    live = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    named: list[DataFrame] = []
    for k in range(rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        names = written(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("next")), "names")
        named.append(names)
        left = names.select(F.col("node").alias("a"), F.col("next").alias("x"))
        right = names.select(F.col("node").alias("b"), F.col("next").alias("y"))
        moved = live.join(left, "a").join(right, "b").where("x <> y")
        live = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not named:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = named[0].select("node", F.col("next").alias("root"))
    for names in named[1:]:
        step = names.select(F.col("node").alias("root"), "next")
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
