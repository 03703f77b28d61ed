"""Messages of a broker as a table or stream: topic, payload, received_us, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.functions import parsing
from streamcheck.operators.asof import own_raw, raw_pairing

MESSAGE = "topic string, payload string, received_us bigint, seq bigint"


def message_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Messages from JSON files as they arrive; a Kafka source has the same columns after a select."""
    return spark.readStream.schema(MESSAGE).options(**options).json(path)


def routed(messages: DataFrame, root: str = parsing.ROOT) -> DataFrame:
    """Adds ``route``, and zone, zone_id and metric where the topic is a reading's; garden topics begin with ``root``."""
    topic = parsing.parse_topic(F.col("topic"), root)
    return messages.withColumns({"route": parsing.route(F.col("topic"), root), "zone": topic["zone"], "zone_id": topic["zone_id"], "metric": topic["metric"]})


def numeric_readings(messages: DataFrame, root: str = parsing.ROOT) -> DataFrame:
    """Readings and buffered raw counts with their number; ``rejected`` where the payload has none."""
    r = routed(messages, root).where(F.col("route").isin("reading", "raw"))
    whole = parsing.whole_number(F.col("payload")).cast("double")
    value = F.when(F.col("route") == "raw", whole).otherwise(parsing.number(F.col("payload")))
    return r.select(F.concat_ws("/", "zone", "zone_id").alias("source"), "metric", value.alias("value"), F.col("received_us").alias("ts_us"), F.lit(None).cast("bigint").alias("raw_value"), "seq", value.isNull().alias("rejected"))


def readings(messages: DataFrame, root: str = parsing.ROOT) -> DataFrame:
    """The readings of a message table with their raw counts; raw counts alone are no readings."""
    good = numeric_readings(messages, root).where("not rejected").drop("rejected")
    other = own_raw(good.where(~F.col("metric").isin("moisture", "moisture_raw")))
    return raw_pairing(good).select(*other.columns).unionByName(other)


def sessions(messages: DataFrame) -> DataFrame:
    """Session rows, stamped at receipt; messages of any wrong field are dropped."""
    s = routed(messages).where("route = 'session'").withColumn("s", parsing.parse_session(F.col("payload"))).where("s is not null")
    return s.select(F.col("seq").alias("id"), F.col("received_us").alias("started_us"), "s.*")
