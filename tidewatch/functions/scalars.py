"""Column expressions. Comparisons with null follow the surveillance rules: an unequal pair with a null side counts as different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .countries import cleaned, other_keys

#: Short names and the long ones that risk tables use (fixed values).
COUNTRY_ALIASES = {"UK": "United Kingdom", "UAE": "United Arab Emirates", "USA": "United States"}
CASH = ("Cash Withdrawal", "Cash Deposit")


def timestamp_of(date: Column, time: Column) -> Column:
    """Date text and time text as a timestamp; null where they are none."""
    day = F.date_format(F.to_date(F.try_to_timestamp(F.trim(date))), "yyyy-MM-dd")
    return F.try_to_timestamp(F.concat_ws(" ", day, time))


def timestamp_or_date(date: Column, time: Column) -> Column:
    """As ``timestamp_of``, but blank or missing times fall back to midnight of the date."""
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "nat", "null"), F.trim(c))
    return F.coalesce(timestamp_of(clean(date), F.coalesce(clean(time), F.lit("?"))), F.date_trunc("day", F.try_to_timestamp(clean(date))))


def differs(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(True)).cast("int")


def holds(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def hash_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 16)))


def score_band(p: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(9), F.floor(p * 10))).cast("int")


def band_label(band: Column) -> Column:
    return F.format_string("%.1f–%.1f", band / F.lit(10.0), (band + 1) / F.lit(10.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def row_features(tx: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0), night, weekend, cross-border and currency flags, and the logarithm of the amount."""
    day = F.to_date("Date")
    return tx.withColumns({
        "Hour": F.hour(F.try_to_timestamp(F.concat_ws(" ", F.lit("2000-01-01"), F.col("Time")))), "Day_of_week": F.weekday(day),
        "Is_weekend": holds(F.weekday(day) >= 5), "Cross_border": differs(F.col("Sender_bank_location"), F.col("Receiver_bank_location")),
        "Currency_mismatch": differs(F.col("Payment_currency"), F.col("Received_currency")), "Log_amount": F.log1p("Amount"),
    }).withColumn("Is_night", holds(F.col("Hour").between(0, 5)))


def semantics(tx: DataFrame) -> DataFrame:
    """What a transaction is: cash or account transfer, who initiates it, which two-sided comparisons hold, whether it belongs in the account network."""
    kind = F.trim(F.coalesce("Payment_type", F.lit("")))
    out, into = kind == CASH[0], kind == CASH[1]
    cash = out | into
    two_sided = (~cash).cast("int")
    named = lambda a, b, other: F.when(out, a).when(into, b).otherwise(other)
    # the words are fixed values
    return tx.withColumns({
        "is_cash_withdrawal": out.cast("int"), "is_cash_deposit": into.cast("int"), "is_cash_transaction": cash.cast("int"), "is_account_transfer": two_sided,
        "is_cross_border_transfer": (kind == "Cross-border").cast("int"), "flow_type": named("CASH_WITHDRAWAL", "CASH_DEPOSIT", "ACCOUNT_TRANSFER"),
        "initiating_account": F.when(into, F.col("Receiver_account")).otherwise(F.col("Sender_account")), "counterparty_account": F.when(~cash, F.col("Receiver_account")),
        "has_true_sender_receiver": two_sided, "counterparty_applicable": two_sided, "geo_pair_applicable": two_sided, "currency_pair_applicable": two_sided, "network_eligible": two_sided,
        "sender_is_customer": (~into).cast("int"), "receiver_is_customer": (~out).cast("int"),
        "transaction_direction": named("CASH_OUT", "CASH_IN", "OUTBOUND"), "semantic_direction": named("ACCOUNT → CASH", "CASH → ACCOUNT", "SENDER → RECEIVER"),
    })


#: Keys that stand for a country beside its codes and names (fixed values).
COUNTRY_KEYS = {"UK": "GB", "UAE": "AE", "USA": "US", "U S A": "US", "U S": "US", "UNITED STATES OF AMERICA": "US", "GREAT BRITAIN": "GB", "TURKEY": "TR"}


def countries(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """(key, iso2, iso3) of all countries: both codes, the English name, other and official names (``countries.other_keys``) and the known
    aliases as keys, cleaned as ``country_key`` does.

    Codes and short names are those of the Java library; ``more`` adds keys. About a thousand rows, whatever the data.
    """
    locale = spark._jvm.java.util.Locale
    rows, code3, names = {}, {}, {}
    for code in locale.getISOCountries():
        country = locale("", code)
        code3[code] = country.getISO3Country()
        names[code] = {country.getDisplayCountry(locale.ENGLISH)}
        for name in (*names[code], country.getISO3Country(), code):
            rows[cleaned(name)] = code
    for key, code in other_keys(names).items():
        rows.setdefault(key, code)
    rows.update(COUNTRY_KEYS)
    rows.update(more or {})
    return spark.createDataFrame([(k, c, code3[c]) for k, c in sorted(rows.items())], "key string, iso2 string, iso3 string")


def with_country_codes(tx: DataFrame, known: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds {prefix}_iso2 and {prefix}_iso3 of the country that ``column`` names; null for unknown and missing ones. ``known`` is ``countries``, bounded by their number."""
    d = known.select(F.col("key").alias("_key"), F.col("iso2").alias(f"{prefix}_iso2"), F.col("iso3").alias(f"{prefix}_iso3"))
    return tx.withColumn("_key", country_key(F.col(column))).join(F.broadcast(d), "_key", "left").drop("_key")


def long_country_name(c: Column) -> Column:
    """Short names as the long ones that risk tables use."""
    out = c
    for short, long in COUNTRY_ALIASES.items():
        out = F.when(c == short, F.lit(long)).otherwise(out)
    return out


def country_dimension(spark: SparkSession) -> DataFrame:
    """Names of countries with their codes, and a risk score; to be replaced by a full table."""
    rows = [("UK", "GB", "GBR", None, 3.0), ("USA", "US", "USA", None, 4.0), ("UAE", "AE", "ARE", "X", 7.5), ("TURKEY", "TR", "TUR", None, 7.0)]
    return spark.createDataFrame(rows, "key string, iso2 string, iso3 string, sanction string, risk double")


def country_key(c: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", " "))
    return F.when(~clean.isin("", "NAN", "NONE", "NULL"), clean)


def with_country_risk(tx: DataFrame, dim: DataFrame) -> DataFrame:
    """Codes, risk and sanctions of both ends. ``dim`` has one row a country: its size is bounded by their number."""
    for side in ("Sender", "Receiver"):
        d = dim.select(F.col("key").alias("_key"), F.col("iso2").alias(f"{side}_iso2"), F.col("iso3").alias(f"{side}_iso3"), F.col("risk").alias(f"{side}_risk"), F.col("sanction").isNotNull().cast("int").alias(f"{side}_sanctioned"))
        tx = tx.withColumn("_key", country_key(F.col(f"{side}_bank_location"))).join(F.broadcast(d), "_key", "left").drop("_key")
    return tx.withColumns({
        "Max_country_risk": F.greatest("Sender_risk", "Receiver_risk"), "Risk_difference": F.abs(F.col("Sender_risk") - F.col("Receiver_risk")),
        "Any_sanctioned": F.greatest(F.coalesce("Sender_sanctioned", F.lit(0)), F.coalesce("Receiver_sanctioned", F.lit(0))),
    })
