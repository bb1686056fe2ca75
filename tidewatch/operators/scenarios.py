"""Detection scenarios as projections over features; labels are never inputs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import holds


@dataclass(frozen=True)
class Config:
    """Thresholds of the first generation (fixed values)."""

    large_amount: float = 50_000.0
    high_risk: float = 7.0
    rapid_seconds: float = 3_600.0
    velocity_count: int = 10
    unusual_multiple: float = 3.0
    structuring_amount: float = 10_000.0
    structuring_count: int = 5
    fan_count: int = 8
    window_total: float = 20_000.0
    window_count: int = 5
    window_unique: int = 5
    alert_count: int = 1


#: flag: (weight, label) (fixed values)
V1 = {
    "SCN_SINGLE_LARGE": (60, "Single large transaction"),
    "SCN_HIGH_RISK_GEOGRAPHY": (40, "High-risk geography"),
    "SCN_SANCTIONED_GEOGRAPHY": (80, "Sanctioned-jurisdiction exposure"),
    "SCN_CROSS_BORDER_CURRENCY_MISMATCH": (30, "Cross-border currency mismatch"),
    "SCN_RAPID_REPEAT_ACTIVITY": (40, "Rapid repeat sender activity"),
    "SCN_HIGH_VELOCITY": (45, "High sender transaction velocity"),
    "SCN_UNUSUAL_AMOUNT": (50, "Amount materially above sender history"),
    "SCN_STRUCTURING_PROXY": (50, "Potential structuring pattern"),
    "SCN_FAN_ACTIVITY_PROXY": (35, "Potential fan activity"),
    "SCN_STRUCTURING_ROLLING": (60, "Rolling-window structuring pattern"),
    "SCN_FAN_OUT": (60, "Multiple outgoing counterparties"),
    "SCN_FAN_IN": (60, "Multiple incoming counterparties"),
}


def apply_v1(f: DataFrame, c: Config = Config()) -> DataFrame:
    """Twelve flags, their number, weighted score (0 to 100), alert and reasons."""
    x = F.col
    small, close = x("Amount") < c.structuring_amount, x("Sender_gap").between(0, c.rapid_seconds)
    rules: dict[str, Column] = {
        "SCN_SINGLE_LARGE": x("Amount") >= c.large_amount,
        "SCN_HIGH_RISK_GEOGRAPHY": x("Max_country_risk") >= c.high_risk,
        "SCN_SANCTIONED_GEOGRAPHY": x("Any_sanctioned") == 1,
        "SCN_CROSS_BORDER_CURRENCY_MISMATCH": (x("Cross_border") == 1) & (x("Currency_mismatch") == 1),
        "SCN_RAPID_REPEAT_ACTIVITY": close,
        "SCN_HIGH_VELOCITY": x("Sender_prior_count") >= c.velocity_count,
        "SCN_UNUSUAL_AMOUNT": x("Amount") >= c.unusual_multiple * F.nullif(x("Sender_prior_average"), F.lit(0.0)),
        "SCN_STRUCTURING_PROXY": small & (x("Sender_prior_count") >= c.structuring_count) & close,
        "SCN_FAN_ACTIVITY_PROXY": x("Sender_prior_count") >= c.fan_count,
        "SCN_STRUCTURING_ROLLING": small & (x("Sender_window_count") >= c.window_count) & (x("Sender_window_amount") >= c.window_total),
        "SCN_FAN_OUT": (x("Sender_window_unique") >= c.window_unique) & (x("Sender_window_count") >= c.window_count),
        "SCN_FAN_IN": (x("Receiver_window_unique") >= c.window_unique) & (x("Receiver_window_count") >= c.window_count),
    }
    out = f.withColumns({k: holds(v) for k, v in rules.items()})
    score = sum((x(k) * w for k, (w, _) in V1.items()), F.lit(0))
    count = sum((x(k) for k in V1), F.lit(0))
    return out.withColumns({
        "Scenario_count": count, "Scenario_score": F.least(F.greatest(score, F.lit(0)), F.lit(100)), "Scenario_alert": (count >= c.alert_count).cast("int"),
        "Alert_reasons": F.concat_ws("; ", *(F.when(x(k) == 1, F.lit(label)) for k, (_, label) in V1.items())),
    })


def configuration(spark: SparkSession, c: Config = Config()) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in asdict(c).items()], "Parameter string, Value double")


def risky(cross: float, fx: float) -> Column:
    return (F.col("cross_rate") >= cross) | (F.col("fx_rate") >= fx)


def smurfing_bucket(b: DataFrame, n: int = 8, median: float = 5_000.0, total: float = 20_000.0, unique: int = 3) -> Column:
    return holds((F.col("n") >= n) & (F.col("median_amount") < median) & (F.col("total") >= total) & (F.col("unique_others") <= unique))


def fan_bucket(low: int, high: int, cross: float, fx: float, n: tuple[int, int] = (5, 20)) -> Column:
    return holds(F.col("unique_others").between(low, high) & F.col("n").between(*n) & risky(cross, fx))


def structuring_v2(amount: float = 10_000.0, unique: int = 5, total: float = 20_000.0, cross: float = 0.20, fx: float = 0.25) -> Column:
    """For transactions joined with the receiver's bucket features."""
    return holds((F.col("Amount") < amount) & (F.col("unique_others") >= unique) & (F.col("total") >= total) & risky(cross, fx))


def smurfing_v3() -> Column:
    """Over 90 sliding days."""
    return holds((F.col("n") >= 3) & (F.col("median_amount") < 3000) & (F.col("total") >= 20_000) & (F.col("unique_receivers") <= 3) & (F.col("cross_rate") <= 0.15) & (F.col("fx_rate") <= 0.15))


def fan_out_v3(most: int = 12, rate: float = 0.20) -> Column:
    """Over 21 sliding days."""
    return holds((F.col("unique_receivers") >= 3) & F.col("n").between(3, most) & risky(rate, rate))


def cash_smurfing(n: int, median: float, total: float, rate: float = 0.15) -> Column:
    """On cash deposits joined with their sender's bucket."""
    return holds((F.col("n") >= n) & (F.col("median_amount") < median) & (F.col("total") >= total) & (F.col("cross_rate") <= rate) & (F.col("fx_rate") <= rate))


def cash_withdrawal(n: int, median: float, total: float) -> Column:
    return holds((F.col("n") >= n) & (F.col("median_amount") <= median) & (F.col("total") >= total))


def fan_out_what_if(least: int, most: int, rate: float) -> Column:
    return holds((F.col("unique_others") >= least) & F.col("n").between(least, most) & risky(rate, rate))


def structuring_what_if(amount: float, unique: int, total: float, cross: float, fx: float) -> Column:
    """On transactions joined with their receiver's bucket."""
    return structuring_v2(amount, unique, total, cross, fx)


def fan_in_what_if(unique: tuple[int, int], n: tuple[int, int], cross: float, fx: float) -> Column:
    """On transactions joined with their receiver's bucket."""
    return fan_bucket(*unique, cross, fx, n)
