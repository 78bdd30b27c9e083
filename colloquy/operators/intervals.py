"""Overlapping and gapped time intervals as continuous periods and the gaps between them (problem 4).

``session_window`` with a gap of each row's own length merges overlapping spans. It runs per entity, hour of the start
and salt, so that no entity, however large, is one task; what is left is one row per session, with the true maximum of its ends. Sessions that
touch, or that meet across salts and hours, are joined by running maxima: inside an hour by a window, across the hours
of an entity by a window over one summary row per hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed
from colloquy.runtime import cut

CHUNK_US = 3_600_000_000


def _merge_sorted(df: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint, non-touching stretches of (``by``, start_us, end_us): running maximum, then islands."""
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col("start_us") <= before, 0).otherwise(1))
    grouped = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def continuous_periods(spans: DataFrame, keys: dict[str, Column], start_us: Column, end_us: Column, salts: int = 8) -> DataFrame:
    """Periods and gaps per entity: (``keys``..., ``kind``, ``start_us``, ``end_us``).

    ``keys`` maps output names to columns; ``start_us`` and ``end_us`` are microseconds. ``kind`` is ``period`` for each
    maximal stretch of spans that overlap or touch and ``gap`` for each stretch between two neighbouring periods.

    Spans with a null key, start or end, or not ending after their start, do not count. Repeated and nested spans change
    nothing. An empty table gives an empty result. Other columns of ``spans``, whatever their names, are ignored.
    """
    names = list(keys)
    k = [f"_k{i}" for i in range(len(names))]
    rows = spans.select(*[c.alias(a) for a, c in zip(k, keys.values(), strict=True)], start_us.alias("start_us"), end_us.alias("end_us"))
    rows = rows.where(F.col("end_us") > F.col("start_us")).dropna()
    rows = rows.withColumns({"_chunk": F.floor(F.col("start_us") / CHUNK_US), "_salt": F.pmod(F.xxhash64("start_us", "end_us"), F.lit(salts))})
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(end_us - start_us as decimal(18, 0)) / 1000000)")
    merged = (
        rows.withColumns({"_ts": F.timestamp_micros("start_us"), "_len": length})
        .groupBy(*k, "_chunk", "_salt", F.session_window("_ts", F.col("_len")))
        .agg(F.max("end_us").alias("_e"))
        .select(*k, "_chunk", F.unix_micros("session_window.start").alias("start_us"), F.col("_e").alias("end_us"))
    )
    local = cut(_merge_sorted(merged, [*k, "_chunk"]))  # read by the hours, the heads and the periods

    # One row per entity and hour: what reaches into it from before, and where the next hours begin.
    entity = Window.partitionBy(*k).orderBy("_chunk")
    hours = local.groupBy(*k, "_chunk").agg(F.max("end_us").alias("_hi"))
    hours = hours.withColumn("_reach", F.max("_hi").over(entity.rowsBetween(Window.unboundedPreceding, -1))).drop("_hi")
    # A stretch that starts within reach continues the last period of an earlier hour; the others begin periods.
    seen = local.join(hours, [*k, "_chunk"]).withColumn("_begins", F.col("_reach").isNull() | (F.col("start_us") > F.col("_reach")))
    heads = seen.groupBy(*k, "_chunk").agg(
        F.max(F.when(~F.col("_begins"), F.col("end_us"))).alias("_head"),
        F.min(F.when(F.col("_begins"), F.col("start_us"))).alias("_first"),
        F.max(F.when(F.col("_begins"), F.col("start_us"))).alias("_last"),
        F.max(F.when(F.col("_begins"), F.col("end_us"))).alias("_last_end"),
    )
    # The last period of an hour runs on through the heads of the following hours, up to and with the one that begins a period.
    heads = heads.withColumn("_run", F.sum(F.col("_first").isNotNull().cast("int")).over(entity.rowsBetween(Window.unboundedPreceding, 0)))
    tails = heads.groupBy(*k, "_run").agg(
        F.max("_last").alias("_last"), F.max("_first").alias("_first"), F.max("_last_end").alias("_own"),
        F.max(F.when(F.col("_first").isNotNull(), F.col("_head"))).alias("_before"), F.max(F.when(F.col("_first").isNull(), F.col("_head"))).alias("_later"), F.max(F.when(F.col("_first").isNotNull(), F.col("_chunk"))).alias("_chunk"),
    )
    runs = Window.partitionBy(*k).orderBy("_run")
    tails = tails.select(*k, "_chunk", F.col("_last").alias("start_us"), F.greatest("_own", "_later", F.lead("_before").over(runs)).alias("_end"), F.lead("_first").over(runs).alias("_next"))
    inside = Window.partitionBy(*k, "_chunk").orderBy("start_us")
    periods = seen.where("_begins").select(*k, "_chunk", "start_us", "end_us", F.lead("start_us").over(inside).alias("_following"))
    periods = periods.join(tails, [*k, "_chunk", "start_us"], "left").select(
        *k, "start_us", F.greatest("end_us", "_end").alias("end_us"), F.coalesce("_following", "_next").alias("_following")
    )
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_us"), F.col("end_us")),
        F.when(F.col("_following").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("end_us").alias("start_us"), F.col("_following").alias("end_us"))),
    )
    return periods.select(*[F.col(a).alias(n) for a, n in zip(k, names, strict=True)], F.inline(F.array_compact(both)))


def micros(col: Column) -> Column:
    """Microseconds since 1970 UTC of a zoneless TIMESTAMP that holds UTC, whatever the session's time zone."""
    days = F.unix_date(col.cast("date")).cast("bigint") * 86_400
    seconds = (F.hour(col) * 60 + F.minute(col)) * 60
    return (days + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")


def speaking_periods(recorded: DataFrame) -> DataFrame:
    """:func:`continuous_periods` of each recording and speaker, ids dashed in lower case."""
    return continuous_periods(recorded, {"recording_id": dashed(F.col("recordingId")), "spoken_by": dashed(F.col("spokenBy"))}, micros(F.col("startTime")), micros(F.col("endTime")))
