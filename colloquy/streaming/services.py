"""Request, reply and keyed state on top of event streams.

A subject's handler gets each microbatch's rows; what it writes goes into a folder of the batch, which a repeated batch
overwrites: replies and forwarded events come out once, however often a batch is run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.ids import dashed
from colloquy.operators.graph import latest

#: Subjects of a session's life, and what state its event leads to.
LIFECYCLE_SUBJECTS = {"context.instance.created": "created", "context.instance.started": "started", "context.instance.ended": "ended"}


def write_once(df: DataFrame, path: str, batch_id: int) -> None:
    """``df`` as JSON into the folder of its batch."""
    df.write.mode("overwrite").json(f"{path}/batch={batch_id}")


def reply(compute: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the answers that ``compute`` gives to a batch of requests."""
    return lambda batch, i: write_once(compute(batch), path, i)


def forward(subjects: dict[str, str], path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: events of ``subjects`` (here -> there) are passed on under their new subject; others are dropped."""

    def run(batch: DataFrame, i: int) -> None:
        to = F.create_map(*[F.lit(x) for kv in subjects.items() for x in kv])
        write_once(batch.withColumn("subject", F.try_element_at(to, F.col("subject"))).where("subject is not null"), path, i)

    return run


def both(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: several sinks of one microbatch, which is computed once."""

    def run(batch: DataFrame, i: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, i)
        finally:
            batch.unpersist()

    return run


def lifecycle(events: DataFrame) -> DataFrame:
    """(``session``, ``state``, ``mind``, ``at``): the latest lifecycle event of each session and the last mind it named.

    ``events`` is (``subject``, ``contextId``, ``instanceId``, ``mindId``, ``at``); other subjects and null sessions do not count.
    """
    state = F.create_map(*[F.lit(x) for kv in LIFECYCLE_SUBJECTS.items() for x in kv])
    e = events.select(F.concat_ws(":", dashed(F.col("contextId")), dashed(F.col("instanceId"))).alias("session"), F.try_element_at(state, F.col("subject")).alias("state"), F.lower("mindId").alias("mind"), "at", "instanceId")
    e = e.where("state is not null and instanceId is not null")
    rank = F.struct("at", F.array_position(F.array(*[F.lit(x) for x in LIFECYCLE_SUBJECTS.values()]), F.col("state")))
    return e.groupBy("session").agg(F.max_by("state", rank).alias("state"), F.max_by("mind", F.when(F.col("mind").isNotNull(), rank)).alias("mind"), F.max("at").alias("at"))


def variant(context: Column, tested: list[str]) -> Column:
    """``v2`` for the contexts under test, else ``v1``."""
    return F.when(dashed(context).isin([t.lower() for t in tested]), "v2").otherwise("v1")


def with_attendees(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """``requests`` (``request``, ...) with the ``attendees`` of ``replies`` (``request``, ``attendees``, ``at``); the latest counts, without one it is null."""
    return requests.join(latest(replies.select("request", "attendees", "at"), ["request"], ["at"]).select("request", "attendees"), "request", "left")


# Keyed store: an append-only table of what was set, when, and for how long


def store_set(rows: DataFrame, path: str) -> None:
    """Sets ``rows`` (``store``, ``key``, ``value``, ``at`` TIMESTAMP, ``ttl_s`` BIGINT or null); a null value deletes the key."""
    rows.select("store", "key", "value", "at", F.col("ttl_s").cast("bigint").alias("ttl_s")).write.mode("append").partitionBy("store").parquet(path)


def store_get(spark: SparkSession, path: str, now: Column, store: str | None = None) -> DataFrame:
    """(``store``, ``key``, ``value``): what holds at ``now``: the latest value set of each key, unless deleted or expired."""
    rows = spark.read.schema("key string, value string, at timestamp, ttl_s bigint, store string").parquet(path).where(F.col("at") <= now)
    if store is not None:
        rows = rows.where(F.col("store") == store)  # prunes to the store's folder
    last = latest(rows, ["store", "key"], ["at", "value"])
    alive = F.col("ttl_s").isNull() | (F.timestamp_seconds(F.unix_micros("at") / 1_000_000 + F.col("ttl_s")) > now)
    return last.where(F.col("value").isNotNull() & alive).select("store", "key", "value")


def store_compact(spark: SparkSession, path: str, to: str, now: Column) -> None:
    """What still holds at ``now``, as a new table at ``to``."""
    rows = spark.read.schema("key string, value string, at timestamp, ttl_s bigint, store string").parquet(path)
    last = latest(rows, ["store", "key"], ["at", "value"])
    held = last.join(store_get(spark, path, now).select("store", "key"), ["store", "key"], "left_semi")
    held.write.mode("overwrite").partitionBy("store").parquet(to)


def unsubscribe(queries: list[StreamingQuery]) -> None:
    """Stops the queries; their checkpoints let them go on where they stopped."""
    for q in queries:
        q.stop()
