"""Exact percentiles of groups of any size.

Values are first counted, once per group and value; each group's values are cut into bands by approximate quantiles, and only
the bands that hold a wanted position are sorted. No buffer or task holds all values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def percentiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...], bands: int = 64) -> DataFrame:
    """(by, q array<double>): the interpolated percentiles of ``value``, as ``percentile`` gives them; rows with null are left out."""
    x = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = x.groupBy(*by).agg(F.percentile_approx("_v", F.array(*(F.lit(k / bands) for k in range(1, bands))), F.lit(1000)).alias("_cuts"))
    x = x.join(cuts, by).select(*by, "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_band"))
    sizes = x.groupBy(*by, "_band").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*by)  # a row for each band
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_bn").over(w.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_bn").over(w)})
    places = [(k, side, q) for k, q in enumerate(at) for side in (0, 1)]
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    wanted = F.array(*(F.struct(F.lit(2 * k + side).alias("i"), (F.ceil(place(q)) if side else F.floor(place(q))).alias("p")) for k, side, q in places))
    wanted = F.filter(wanted, lambda t: (t["p"] >= F.col("_before")) & (t["p"] < F.col("_before") + F.col("_bn")))
    sizes = sizes.withColumn("_wanted", wanted).where(F.size("_wanted") > 0)
    run = Window.partitionBy(*by, "_band").orderBy("_v")
    y = x.join(sizes, [*by, "_band"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(run))
    hit = y.select(*by, "_v", "_n", "_upto", "_all", F.explode("_wanted").alias("t")).where((F.col("t.p") < F.col("_upto")) & (F.col("t.p") >= F.col("_upto") - F.col("_n")))
    each = hit.groupBy(*by).agg(F.max("_all").alias("_all"), *(F.max(F.when(F.col("t.i") == 2 * k + side, F.col("_v"))).alias(f"_{k}_{side}") for k, side, _ in places))
    inner = lambda k, q: F.col(f"_{k}_0") + (F.col(f"_{k}_1") - F.col(f"_{k}_0")) * (place(q) - F.floor(place(q)))
    return each.select(*by, F.array(*(inner(k, q) for k, q in enumerate(at))).alias("q"))
