"""Running totals of keys of any size: a two-level prefix scan.

A key's rows are dealt into bands of time, each a group of its own; a small table has each band's totals, and what all
bands before one hold is carried into it. So no task holds a key, whatever share of the rows it has. Most keys have few rows and are one
band. Those with more than ``HOT`` rows are cut by hours, and their hours into slices of equal length, down to a second.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a key, and of a band, at most about.
HOT = 1_000_000
_HOUR = 3600


#: The band of keys that aren't cut.
_WHOLE = -(2**62)


def _hot_keys(rows: DataFrame, key: str, hot: int) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_scan_key")).agg(F.count(F.lit(1)).alias("_scan_rows")).where(F.col("_scan_rows") > hot)


def hot_among(rows: DataFrame, keys: list[str], hot: int = HOT) -> set[str]:
    """Those of ``keys`` of which some value has more than ``hot`` rows: one count."""
    found = [_hot_keys(rows, key, hot).limit(1).select(F.lit(key).alias("key")) for key in keys]  # a row a key at most
    return {r.key for r in reduce(DataFrame.unionAll, found).collect()}


def with_bands(rows: DataFrame, bands: dict[str, str], at: str, hot: int = HOT, among: set[str] | None = None) -> tuple[DataFrame, dict[str, str | None]]:
    """``rows`` with a long column of bands for each key, by ``bands`` {key: its name}, and those names; None for a key of which no value
    has more than ``hot`` rows, which a count finds first unless ``among`` tells: it needs no bands.

    A band is the second at which a slice of a hot key's hours begins; rows without a time are in the last one. Hot keys are rows / ``hot`` at
    most, and so are broadcast.
    """
    out, names, source = rows, dict.fromkeys(bands), rows
    for key in sorted((hot_among(source, list(bands), hot) if among is None else among) & set(bands)):
        large, band = _hot_keys(source, key, hot), bands[key]
        names[key] = band
        k, many, parts = "_scan_key", "_scan_rows", "_scan_parts"
        hours = source.join(F.broadcast(large), F.col(key).eqNullSafe(F.col(k)), "left_semi").groupBy(F.col(key).alias(k), F.floor(F.col(at) / _HOUR).alias("_h")).agg(F.count(F.lit(1)).alias(many))
        cut = hours.groupBy(k).agg(F.least(F.ceil(F.max(many) / hot), F.lit(_HOUR)).cast("int").alias(parts))
        out = out.join(F.broadcast(cut), F.col(key).eqNullSafe(F.col(k)), "left")
        width = F.ceil(F.lit(_HOUR) / F.col(parts))
        place = F.floor(F.col(at) / _HOUR) * _HOUR + F.floor(F.pmod(F.col(at), F.lit(_HOUR)) / width) * width
        out = out.withColumn(band, F.when(F.col(parts).isNull(), _WHOLE).when(F.col(at).isNull(), 2**62).otherwise(place).cast("long")).drop(k, parts)
    return out, names


def running(rows: DataFrame, key: str, band: str | None, order: list[Column], sums: dict[str, Column], latest: dict[str, Column]) -> DataFrame:
    """``rows`` with totals of the rows of their key that come before them: of ``sums`` (null counts as nothing; null if there is none
    before), and of ``latest`` the largest so far, both over all bands."""
    before = Window.partitionBy(*filter(None, (key, band))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumns({f"_s_{n}": v for n, v in sums.items()} | {f"_m_{n}": v for n, v in latest.items()})
    if band is None:
        out = x.withColumns({n: F.sum(f"_s_{n}").over(before) for n in sums} | {n: F.max(f"_m_{n}").over(before) for n in latest})
        return out.drop(*(f"_s_{n}" for n in sums), *(f"_m_{n}" for n in latest))
    totals = x.groupBy(F.col(key).alias("_carry_key"), F.col(band).alias("_carry_band")).agg(*(F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums), *(F.max(f"_m_{n}").alias(f"_m_{n}") for n in latest))
    earlier = Window.partitionBy("_carry_key").orderBy("_carry_band").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.where(F.col("_carry_band") != _WHOLE).select("_carry_key", "_carry_band", *(F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums), *(F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in latest))
    x = x.join(carry, F.col(key).eqNullSafe(F.col("_carry_key")) & (F.col(band) == F.col("_carry_band")), "left").drop("_carry_key", "_carry_band")
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    x = x.withColumns({n: both(F.sum(f"_s_{n}").over(before), F.col(f"_c_{n}")) for n in sums} | {n: F.greatest(F.max(f"_m_{n}").over(before), F.col(f"_c_{n}")) for n in latest})
    return x.drop(*(f"{p}_{n}" for n in sums for p in ("_s", "_c")), *(f"{p}_{n}" for n in latest for p in ("_m", "_c")))
