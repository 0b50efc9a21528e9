"""Order events: JSON messages to a table, malformed ones to a dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col
from pyspark.sql.streaming import StreamingQuery

from cartwright.schemas import ORDER_EVENT_SCHEMA
from cartwright.session import settle
from cartwright.sources.published import Published

REQUIRED_FIELDS = sorted(ORDER_EVENT_SCHEMA.fieldNames())
BATCH_SIZE = 100
FLUSH_SECONDS = 30
REPLAY_WINDOW = "1 day"


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``reason`` (NULL for a good message) and the struct ``event``.

    A field must be present; its value may be null. Presence is read from the object's keys,
    because after parsing a null and an absent field look the same.
    """
    text = col(value).cast("string")
    lacking = F.array_except(F.array(*[F.lit(f) for f in REQUIRED_FIELDS]), col("_keys"))
    reason = F.when(col("_missing").isNull(), "Invalid JSON event").when(
        F.size("_missing") > 0,
        F.concat(F.lit("Missing required event fields: "), F.array_join("_missing", ", ")),
    )
    keys = F.json_object_keys(F.when(F.is_valid_utf8(text), text))
    return (
        # As a generator's output the keys are computed once: a filter on the reason is not pushed
        # below it, which would parse every message again.
        messages.select("*", F.explode_outer(F.array(keys)).alias("_keys"))
        .withColumn("_missing", lacking)
        .withColumn("reason", reason)
        .withColumn("event", F.when(col("reason").isNull(), F.from_json(text, ORDER_EVENT_SCHEMA)))
        .drop("_keys", "_missing")
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(col("reason").isNull()).select("event.*")


def dead_letters(parsed: DataFrame, value: str = "value") -> DataFrame:
    return parsed.where(col("reason").isNotNull()).select(col(value).cast("string").alias("value"), "reason")


def once_per_event(parsed: DataFrame, within: str = REPLAY_WINDOW) -> DataFrame:
    """A stream of parsed messages without repeated events: of those with one event_id that arrive
    ``within`` the given time the first stays, also across restarts.

    State is kept by time of arrival, so no event is too late. Malformed messages and events without an
    id are all kept.
    """
    known = col("reason").isNull() & col("event.event_id").isNotNull()
    key = F.when(known, F.concat(F.lit("e"), "event.event_id")).otherwise(F.concat(F.lit("m"), F.uuid()))
    arrived = parsed.withColumns({"_arrived": F.current_timestamp(), "_key": key})
    return arrived.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_key"]).drop("_arrived", "_key")


def file_messages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder of text files, one message per line, as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def kafka_options(
    servers: str, topic: str, batch_size: int = BATCH_SIZE, flush_seconds: int = FLUSH_SECONDS, most: int | None = None
) -> dict[str, str]:
    """Options of a topic read from its earliest offset. A batch starts with ``batch_size`` waiting messages, or
    ``flush_seconds`` after the last one with fewer; ``most`` bounds it from above."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "minOffsetsPerTrigger": str(batch_size),
        "maxTriggerDelay": f"{flush_seconds}s",
    }
    return options | ({"maxOffsetsPerTrigger": str(most)} if most else {})


def kafka_messages(spark: SparkSession, servers: str, topic: str, **limits: int) -> DataFrame:
    """A topic as a stream. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **limits)).load().select("value")


def write_orders(
    messages: DataFrame,
    table: str,
    dead_letter_table: str,
    checkpoint: str,
    available_now: bool = False,
    flush_seconds: int = FLUSH_SECONDS,
    replay_window: str | None = REPLAY_WINDOW,
) -> StreamingQuery:
    """Append good events and dead letters batch by batch.

    A batch is committed under its own number once it is whole, so readers never see a part of it, and a
    batch that is replayed after a failure adds nothing. Offsets advance after both tables; there is no
    buffer to drain at shutdown. ``read_events`` reads either table.
    """
    spark = messages.sparkSession
    parsed = parse_messages(messages)
    if replay_window:
        parsed = once_per_event(parsed, replay_window)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        held = settle(batch)
        Published(spark, table).append_once(good_events(held), batch_id)
        Published(spark, dead_letter_table).append_once(dead_letters(held), batch_id)

    writer = parsed.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{flush_seconds} seconds")
    return writer.start()


def read_events(spark: SparkSession, table: str) -> DataFrame:
    return Published(spark, table).read_all()
