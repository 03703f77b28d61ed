"""Column functions that read numbers, times, topics and session messages from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a floating-point number.
NUMBER = r"^(?i)[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def number(cell: Column) -> Column:
    """The trimmed cell as a double, null where it is blank or no number."""
    text = F.trim(cell)
    plain = F.when(F.lower(text).rlike(r"^[+-]?nan$"), float("nan")).otherwise(text.try_cast("double"))
    return F.when(text.rlike(NUMBER), plain)


def whole_number(cell: Column) -> Column:
    """Strictly an integer of 64 bits."""
    text = F.trim(cell)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def timestamp_micros(cell: Column) -> Column:
    """Microseconds since 1970 of any accepted form, null where none fits.

    RFC 3339, RFC 2822, date and time with blank or T, slashed date and time, date alone,
    epoch seconds, and epoch milliseconds over 10**12.  Times without a zone are UTC.
    """
    text = F.trim(cell)
    day = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
    clock = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?"
    digits = F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("bigint"))
    epoch = F.when(F.abs(digits) > 10**12, digits * 1000).otherwise(digits * 1_000_000)

    def plain(t: Column) -> Column:
        # The wall clock as UTC, whatever the session's zone.
        ntz = t.try_cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)

    zoned = F.unix_micros(F.regexp_replace(F.regexp_replace(text, "[zZ]$", "+00:00"), "[tT]", " ").try_cast("timestamp"))
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT)$", "+0000")
    return (
        F.when(text.rlike(rf"^{day}[Tt ]{clock}([zZ]|[+-][0-9]{{2}}:[0-9]{{2}})$"), zoned)
        .when(text.rlike(rf"^{day}[T ]{clock}$"), plain(F.regexp_replace(text, "T", " ")))
        .when(text.rlike(rf"^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} {clock}$"), plain(F.regexp_replace(text, "/", "-")))
        .when(text.rlike(rf"^{day}$"), plain(F.concat(text, F.lit(" 00:00:00"))))
        .when(text.rlike(r"^([A-Za-z]{3},\s*)?[0-9]{1,2} [A-Za-z]{3} [0-9]{4} "), F.unix_micros(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))))
        .otherwise(epoch)
    )


UNIT = r"^([1-9]|1[0-6])$"
ROOT = "garden"


def parse_topic(topic: Column, root: str = ROOT) -> Column:
    """struct(zone, zone_id, metric) of a reading's topic, null for any other.

    Garden topics begin with ``root``, which is whatever the nodes are set up to publish under.
    """
    part = F.split(topic, "/", -1)
    first, second, third, fourth = (F.get(part, F.lit(i)) for i in range(4))
    bed = (F.size(part) == 4) & (first == root) & (second == "bed") & fourth.isin("moisture", "moisture_raw", "temperature", "humidity")
    house = (F.size(part) == 3) & (first == root) & (second == "greenhouse") & third.isin("temperature", "humidity")
    bench = (F.size(part) == 3) & (first == "charstation") & second.rlike(UNIT) & third.isin("raw_adc", "temperature")

    def reading(zone: str, zone_id: Column, metric: Column) -> Column:
        return F.struct(F.lit(zone).alias("zone"), zone_id.alias("zone_id"), metric.alias("metric"))

    return F.when(bed, reading("bed", third, fourth)).when(house, reading("greenhouse", F.lit("greenhouse"), third)).when(bench, reading("charstation", second, third))


def route(topic: Column, root: str = ROOT) -> Column:
    """What a message is: session, control, raw (buffered), reading or unrecognised."""
    parsed = parse_topic(topic, root)
    return (
        F.when(topic == "charstation/session", "session")
        .when(topic.startswith("charstation/control/"), "control")
        .when(parsed.isNull(), "unrecognised")
        .when(parsed["metric"] == "moisture_raw", "raw")
        .otherwise("reading")
    )


def parse_session(payload: Column) -> Column:
    """struct(unit_id, batch_label, insertion_number, notes, unit_known), null where any field has a wrong type."""
    json = F.try_parse_json(payload)

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(json, f"$.{name}", "variant")), F.lit("VOID"))

    def text(name: str) -> Column:
        return F.trim(F.try_variant_get(json, f"$.{name}", "string"))

    unit, batch, notes = text("unit_id"), text("batch"), text("notes")
    insertion = F.try_variant_get(json, "$.insertion", "bigint")
    good = (
        json.isNotNull()
        & F.schema_of_variant(json).startswith("OBJECT")
        & kind("unit_id").isin("STRING", "BIGINT")
        & (unit != "")
        & (kind("batch") == "STRING")
        & (batch != "")
        & kind("insertion").isin("VOID", "BIGINT")
        & kind("notes").isin("VOID", "STRING")
    )
    made = F.struct(unit.alias("unit_id"), batch.alias("batch_label"), insertion.alias("insertion_number"), F.nullif(notes, F.lit("")).alias("notes"), unit.rlike(UNIT).alias("unit_known"))
    return F.when(F.coalesce(good, F.lit(False)), made)


def micros(df_schema: T.StructType, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without a zone (without: UTC)."""
    if isinstance(df_schema[name].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name))
