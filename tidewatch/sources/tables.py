"""Reading and writing of transaction tables, and the bridge from the ``events`` table to transactions."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TRANSACTIONS = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("Time", T.StringType()), ("Date", T.StringType()), ("Sender_account", T.LongType()), ("Receiver_account", T.LongType()), ("Amount", T.DoubleType()),
        ("Payment_currency", T.StringType()), ("Received_currency", T.StringType()), ("Sender_bank_location", T.StringType()), ("Receiver_bank_location", T.StringType()),
        ("Payment_type", T.StringType()), ("Is_laundering", T.IntegerType()), ("Laundering_type", T.StringType()),
    )]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTIONS, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with header and fixed schema; ``columns`` are all that is parsed."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return df.select(*columns) if columns else df


def load_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    """One folder for each value of ``by``; what was there before goes."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """One row of counts as JSON."""
    df.write.mode("overwrite").json(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: several uses then cost one computation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; what was there before goes."""
    df.write.mode("overwrite").csv(path, header=True)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str, validate: str) -> DataFrame:
    """A join whose keys must be unique on the sides that ``validate`` ("one_to_one", "one_to_many", "many_to_one") calls one; else ValueError.

    Null keys match nothing and aren't counted. Each check is a grouped count that stops at the first repeated key.
    """
    sides = dict(zip(("left", "right"), validate.split("_to_"), strict=True))
    for name, df in (("left", left), ("right", right)):
        if sides[name] == "one" and not df.select(*on).dropna().groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"the {name} side of a {validate} join has repeated keys")
    return left.join(right, on, how)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidewatch-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where ``spark.checkpoint.dir`` is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def transaction_id(row_id: Column) -> Column:
    return F.format_string("TXN-HO-%010d", row_id)


def _place(account: str, names: tuple[str, str, str, str]) -> Column:
    k = F.col(account) % 10
    return F.when(k < 7, names[0]).when(k == 7, names[1]).when(k == 8, names[2]).otherwise(names[3])


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions derived from ``events``: one a row, with accounts, currencies, places, labels and a score."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_events(e, e)


def transaction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the table's files; the number of accounts is read once, at start."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a pattern, as the source takes no single file by its name
    return from_events(spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]"), e)


def from_events(events: DataFrame, known: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    users = known.agg((F.max("user_id") + 1).alias("users"))  # one row
    step = F.regexp_extract("props", "[0-9]+", 0).cast("long") % 12
    e = e.crossJoin(F.broadcast(users)).withColumns({"s": F.col("user_id"), "r": (F.col("user_id") * 7 + step) % F.col("users")})
    money, place = ("UK pounds", "US dollar", "Dirham", "Turkish lira"), ("UK", "USA", "UAE", "Turkey")
    aml = F.col("event_id") % 37 == 0
    kinds = ("Smurfing", "Structuring", "Fan_In", "Fan_Out", "Layered_Fan_In", "Layered_Fan_Out")
    normal = ("Normal_Fan_In", "Normal_Fan_Out", "Normal_Small_Fan_In", "Normal_Small_Fan_Out")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    pay = F.when(F.col("event_type") == "purchase", "Cash Deposit").when(F.col("event_type") == "signup", "Cash Withdrawal").when(F.col("event_type") == "error", "Cross-border").when(F.col("event_type") == "view", "ACH").otherwise("Credit card")
    return e.select(
        F.col("event_id").alias("tx_id"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"), F.date_trunc("second", "ts").alias("ts"),
        F.col("s").alias("Sender_account"), F.col("r").alias("Receiver_account"), (F.round(F.col("value") * 100).cast("long").cast("double") * F.lit(2.5)).alias("Amount"),
        _place("s", money).alias("Payment_currency"), _place("r", money).alias("Received_currency"), _place("s", place).alias("Sender_bank_location"), _place("r", place).alias("Receiver_bank_location"),
        pay.alias("Payment_type"), aml.cast("int").alias("Is_laundering"),
        F.when(aml, pick(kinds, F.expr("event_id DIV 37") % 6)).otherwise(pick(normal, F.col("event_id") % 4)).alias("Laundering_type"),
        (((F.col("event_id") * 7919) % 10007 + F.when(aml, 3000).otherwise(0)).cast("double") / F.lit(13006.0)).alias("ml_probability"),
    )
