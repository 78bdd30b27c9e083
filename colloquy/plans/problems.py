"""Queries of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.instants import EXACT_UTC, segment_instants, segment_zones
from colloquy.operators.intervals import speaking_periods
from colloquy.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = segment_instants(table(spark, d, "segment_requests"), table(spark, d, "tenants"), wanted=~F.col("raw").rlike(EXACT_UTC))
    return found.select("seg_row_id", "field", "utc_us")


def p1_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone estimate of each tenant, with and without what the tenant states."""
    return segment_zones(table(spark, d, "segment_requests"), table(spark, d, "tenants"), wanted=~F.col("raw").rlike(EXACT_UTC))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return speaking_periods(table(spark, d, "recorded_segments"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_zones": p1_zones, "p4_found": p4_found}

_UUID = "regexp_replace(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"

SQL: dict[str, str] = {
    "p4_found": f"""
with s as (
  select {_UUID.format("recordingId")} recording_id, {_UUID.format("spokenBy")} spoken_by, epoch_us(startTime) a, epoch_us(endTime) b
  from recorded_segments where recordingId is not null and spokenBy is not null and endTime > startTime),
r as (select *, max(b) over (partition by recording_id, spoken_by order by a, b rows between unbounded preceding and 1 preceding) prev from s),
i as (select *, sum(case when a <= prev then 0 else 1 end) over (partition by recording_id, spoken_by order by a, b rows unbounded preceding) k from r),
p as (select recording_id, spoken_by, min(a) start_us, max(b) end_us from i group by recording_id, spoken_by, k),
g as (select *, lead(start_us) over (partition by recording_id, spoken_by order by start_us) nxt from p)
select recording_id, spoken_by, 'period' as kind, start_us, end_us from g
union all select recording_id, spoken_by, 'gap', end_us, nxt from g where nxt is not null""",
}
