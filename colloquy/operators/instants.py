"""Timestamps of many formats, precisions and zones as one UTC instant (problem 1).

A value is read in three steps, all of them built-in expressions:

1. *shape* - one of a few regular expressions rewrites the text into
   ``year|month|day|hour|minute|second|fraction|half of day|order|zone``;
2. *zone* - an offset, an IANA name, an abbreviation (which may mean several
   offsets) or nothing;
3. *choice* - of all readings (day/month order, meaning of an abbreviation, both
   passes of an hour repeated by a clock change) the one closest to the anchor.

Every local value without a zone gets one by estimation: within a stream (rows
written by the same clocks) every candidate zone, which is an offset history,
is laid over all local values of the stream, its violations (values on the
wrong side of their anchor, statements that the clocks run in another zone) are
counted, and the zone with the fewest is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import broadcast_if_small, cut, once

EXACT_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"

_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?"
_HALF = r"\s*([AaPp][Mm])?"
#: shape name -> (pattern, rewriting); the parts are year|month|day|hour|minute|second|fraction|half|order|zone
SHAPES: dict[str, tuple[str, str]] = {
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|\s+){_TIME}(.*)$", "$1|$2|$3|$4|$5|$6|$7||ymd|$8"),
    "date": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1|$2|$3|0|0|0|||ymd|"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(.*)$", "$1|$2|$3|$4|$5|$6|$7||ymd|$8"),
    "ordinal": (rf"^(\d{{4}})-(\d{{3}})[Tt ]{_TIME}(.*)$", "$1||$2|$3|$4|$5|$6||ord|$7"),
    "numeric": (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})[Tt ,]+{_TIME}{_HALF}(.*)$", "$3|$2|$1|$4|$5|$6|$7|$8|num|$9"),
    "named": (rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}})[Tt ,]+{_TIME}{_HALF}(.*)$", "$3|$2|$1|$4|$5|$6|$7|$8|nam|$9"),
    "us": (rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}})[Tt ,]+{_TIME}{_HALF}(.*)$", "$3|$1|$2|$4|$5|$6|$7|$8|nam|$9"),
}

#: What zone abbreviations can mean, in minutes east of UTC.
ABBREVIATIONS: dict[str, list[int]] = {
    "Z": [0], "UT": [0], "UTC": [0], "GMT": [0], "WET": [0], "WEST": [60],
    "BST": [60, 360], "IST": [330, 60, 120], "CET": [60], "CEST": [120], "MEZ": [60], "MESZ": [120],
    "EET": [120], "EEST": [180], "MSK": [180], "PKT": [300], "SGT": [480], "HKT": [480], "JST": [540], "KST": [540],
    "AWST": [480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
    "AST": [-240, 180], "ADT": [-180], "EST": [-300, 600], "EDT": [-240, 660], "CST": [-360, 480, 570], "CDT": [-300, 630],
    "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480], "HST": [-600],
}

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MINUTE = 60_000_000


def _int(c: Column) -> Column:
    return F.when(c != "", c).otherwise("0").cast("bigint")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 by calendar arithmetic: no exception for a date that does not exist."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mp = F.when(m > 2, m - 3).otherwise(m + 9)
    era, doy = F.floor(yy / 400), F.floor((mp * 153 + 2) / 5) + d - 1
    yoe = yy - era * 400
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _real(y: Column, m: Column, d: Column) -> Column:
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(_leap(y), 29).otherwise(28)).otherwise(31)
    return y.between(1, 9999) & m.between(1, 12) & d.between(1, last)


def zone_names(spark) -> list[str]:
    """IANA names that this Spark's Java knows."""
    return sorted(str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def parse_parts(df: DataFrame, value: str, zones: list[str]) -> DataFrame:
    """Adds ``_epoch`` (µs), ``_local`` (array of wall-clock µs), ``_offs`` (array of minutes) and ``_named`` (IANA name).

    Exactly one of these holds for a readable value: ``_epoch``; ``_local`` with ``_offs``; ``_local`` with
    ``_named``; ``_local`` alone (no zone written). An unreadable or impossible value has ``_ok`` false.
    Each step is computed once per row (see :func:`once`).
    """
    df = once(df, _v=F.regexp_replace(F.col(value), r"^[\s\u00a0\u200b]+|[\s\u00a0\u200b]+$", ""))
    v = F.col("_v")
    canon = F.when(~v.rlike(r"^[\dA-Za-z]"), F.lit(None))
    canon = canon.when(v.rlike(r"^\d{9,20}(?:[.,]\d+)?$"), F.concat(F.regexp_replace(v, r"[.,]", "|"), F.lit("|epoch")))
    for pattern, to in SHAPES.values():
        canon = canon.when(v.rlike(pattern), F.regexp_replace(v, pattern, to))
    df = once(df, _c=F.split(canon, r"\|", 10)).drop("_v")

    p = lambda i: F.get(F.col("_c"), F.lit(i))
    is_epoch = F.element_at("_c", -1) == "epoch"
    month_no = F.array_position(F.array(*[F.lit(x) for x in _MONTHS]), F.lower(F.substring(p(1), 1, 3)))
    df = once(
        df,
        dg=F.when(is_epoch, p(0)), fr=F.when(is_epoch, F.when(F.size("_c") == 3, p(1)).otherwise("")),
        y=F.when(~is_epoch, _int(p(0))), a=F.when(~is_epoch, F.when(p(8) == "nam", month_no).when(p(8) == "ord", 0).otherwise(_int(p(1)))), b=F.when(~is_epoch, _int(p(2))),
        h0=F.when(~is_epoch, _int(p(3))), mi=F.when(~is_epoch, _int(p(4))), s=F.when(~is_epoch, _int(p(5))),
        us=F.when(~is_epoch, _int(F.substring(F.rpad(p(6), 6, "0"), 1, 6))), half=F.when(~is_epoch, F.lower(p(7))), o=F.when(~is_epoch, p(8)), z0=F.when(~is_epoch, F.trim(p(9))),
    ).drop("_c")

    c = F.col
    n, dg, y, a, b, half, order = F.length("dg"), c("dg"), c("y"), c("a"), c("b"), c("half"), c("o")
    epoch = (
        F.when(n <= 11, dg.cast("bigint") * 1_000_000 + _int(F.substring(F.rpad("fr", 6, "0"), 1, 6)))
        .when(n <= 14, dg.cast("bigint") * 1000 + _int(F.substring(F.rpad("fr", 3, "0"), 1, 3)))
        .when(n <= 17, dg.cast("bigint"))
        .otherwise(F.expr("cast(substring(dg, 1, length(dg) - 3) as bigint)"))
    )
    h = F.when(half == "pm", c("h0") % 12 + 12).when(half == "am", c("h0") % 12).otherwise(c("h0"))
    clock = ((h * 60 + c("mi")) * 60 + c("s")) * 1_000_000 + c("us")
    clock_ok = (h < 24) & (c("mi") < 60) & (c("s") < 60) & ((half == "") | c("h0").between(1, 12))
    day = lambda m, d: F.when(_real(y, m, d), _days(y, m, d) * 86_400_000_000 + c("_clock"))
    ordinal = F.when(y.between(1, 9999) & b.between(1, F.when(_leap(y), 366).otherwise(365)), (_days(y, F.lit(1), F.lit(1)) + b - 1) * 86_400_000_000 + c("_clock"))
    z = F.when(c("z0").rlike(r"^\S+\s*\[.*\]$"), F.trim(F.regexp_replace("z0", r"\[.*\]$", ""))).otherwise(F.regexp_replace("z0", r"^\[|\]$", ""))
    df = once(df, _epoch=F.when(dg.isNotNull(), epoch), _clock=F.when(clock_ok, clock), _z=z)
    z, off = c("_z"), r"^(?:[Uu][Tt][Cc]|[Gg][Mm][Tt])?\s*([+-])(\d{1,2})(?::?(\d{2}))?$"
    past = _int(F.regexp_extract(z, off, 3))
    minutes = _int(F.regexp_extract(z, off, 2)) * 60 + past
    numeric = F.when((minutes <= 18 * 60) & (past < 60), F.array(F.when(F.regexp_extract(z, off, 1) == "-", -minutes).otherwise(minutes).cast("int")))
    meaning = F.lit(None).cast("array<int>")
    for name, offsets in ABBREVIATIONS.items():
        meaning = F.when(F.upper(z) == name, F.array(*[F.lit(m) for m in offsets])).otherwise(meaning)
    df = once(
        df,
        _first=F.when(order == "ord", ordinal).otherwise(day(a, b)), _second=F.when(order == "num", day(b, a)),
        _offs=F.when(z == "", F.lit(None)).when(z.rlike(off), numeric).when(F.length(z) <= 5, meaning),
        _named=F.when(z.contains("/") & z.isin(zones), z),
    )
    zone_ok = (z == "") | c("_offs").isNotNull() | c("_named").isNotNull()
    df = once(df, _local=F.array_compact(F.array("_first", "_second")), _ok=F.coalesce(c("_epoch").isNotNull() | (F.coalesce("_first", "_second").isNotNull() & zone_ok), F.lit(False)))
    return df.drop("dg", "fr", "y", "a", "b", "h0", "mi", "s", "us", "half", "o", "z0", "_clock", "_z", "_first", "_second")


def local_readings(local: Column, zone: Column) -> Column:
    """Array of the UTC instants (µs) that wall-clock ``local`` µs can mean in ``zone``.

    A skipped time is read with the offset in force before the change; a repeated one has both readings.
    """
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))
    again = [F.when(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(first + m * _MINUTE), zone)) == local, first + m * _MINUTE) for m in (30, 60, 120)]
    return F.array_compact(F.array(first, *again))


def nearest(readings: Column, anchor: Column) -> Column:
    """The reading closest to ``anchor``; the first one without an anchor, the earlier one of two equally close."""
    ranked = F.array_min(F.transform(readings, lambda r: F.struct(F.abs(r - anchor).alias("d"), r.alias("r"))))
    return F.when(anchor.isNull(), F.get(readings, F.lit(0))).otherwise(ranked["r"])


def _readings(zone: Column) -> Column:
    fixed = F.flatten(F.transform("_local", lambda x: F.transform("_offs", lambda o: x - o.cast("bigint") * _MINUTE)))
    named = F.flatten(F.transform("_local", lambda x: local_readings(x, zone)))
    return F.when(F.col("_epoch").isNotNull(), F.array("_epoch")).when(F.col("_offs").isNotNull(), fixed).when(zone.isNotNull(), named)


#: What one row's statement that its clocks run in another zone weighs against one value on the wrong side of its anchor.
STATEMENT_WEIGHT = 2


def score_zones(local_values: DataFrame, candidates: list[str], after: list[str], weight: int = STATEMENT_WEIGHT) -> DataFrame:
    """Every candidate zone of each stream: (``_stream``, ``_zone``, ``v``, ``d``, ``n``), violations, distance in µs, values.

    ``local_values`` has ``_stream, _stated, _anchor, _local, field``. Every candidate zone (``candidates`` and the row's stated
    one) is applied to every local value of the stream. A violation is a value on the wrong side of its anchor (fields in
    ``after`` must not precede it, the others must not follow it); a row that states another zone counts ``weight``
    violations. Only counts per stream and zone are shuffled.
    """
    zones = F.array_union(F.array(*[F.lit(z) for z in candidates]).cast("array<string>"), F.array_compact(F.array("_stated")))
    tried = local_values.withColumn("_zone", F.explode(zones))
    late = F.col("field").isin(after)
    wrong = lambda u: F.coalesce(F.when(late, u < F.col("_anchor")).otherwise(u > F.col("_anchor")), F.lit(False))
    # one wall-clock reading on the right side of its anchor needs no second look; the others take the nearest of all readings
    tried = once(tried, _q=F.when(F.size("_local") == 1, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.get("_local", F.lit(0))), F.col("_zone")))))
    every = nearest(F.flatten(F.transform("_local", lambda x: local_readings(x, F.col("_zone")))), F.col("_anchor"))
    tried = once(tried, _u=F.when(F.col("_q").isNotNull() & ~wrong(F.col("_q")), F.col("_q")).otherwise(every))
    other = F.coalesce(F.col("_stated") != F.col("_zone"), F.lit(False)).cast("bigint") * weight
    score = tried.groupBy("_stream", "_zone").agg(
        F.sum(wrong(F.col("_u")).cast("bigint") + other).alias("v"),
        F.sum(F.coalesce(F.abs(F.col("_u") - F.col("_anchor")), F.lit(0)).cast("double")).alias("d"), F.count(F.lit(1)).alias("n"),
    )
    # a zone that only some rows of the stream state is tried on these alone; on the others it is violated by definition
    most = score.groupBy("_stream").agg(F.max("n").alias("_all"))
    return score.join(most, "_stream").select("_stream", "_zone", (F.col("v") + (F.col("_all") - F.col("n")) * (weight + 1)).alias("v"), "d", F.col("_all").alias("n"))


def estimate_zones(local_values: DataFrame, candidates: list[str], after: list[str], weight: int = STATEMENT_WEIGHT) -> DataFrame:
    """Zone of each stream: (``_stream``, ``_zone``) by :func:`score_zones`.

    Fewest violations win, then the smallest sum of distances from the anchor, then the name.
    """
    score = score_zones(local_values, candidates, after, weight)
    return score.groupBy("_stream").agg(F.min(F.struct("v", "d", "_zone"))["_zone"].alias("_zone"))


def _read(df: DataFrame, row_id: str, fields: list[str], anchor: str, stream: Column, clock: Column, stated_zone: Column, wanted: Column | None) -> DataFrame:
    """Each readable value: (``_id``, ``field``, ``raw``, ``_utc``) if it says its zone, else ``_local`` with what is known of its clock."""
    zones = zone_names(df.sparkSession)
    base = df.select(F.col(row_id).alias("_id"), stream.alias("_stream"), clock.alias("_own"), stated_zone.alias("_stated"), F.col(anchor).alias("_a"), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    iso = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?Z$"
    g = lambda i: _int(F.regexp_extract("_a", iso, i))
    micros = _int(F.substring(F.rpad(F.regexp_extract("_a", iso, 7), 6, "0"), 1, 6))
    anchor_us = F.when(F.col("_a").rlike(iso) & _real(g(1), g(2), g(3)), (_days(g(1), g(2), g(3)) * 86400 + (g(4) * 60 + g(5)) * 60 + g(6)) * 1_000_000 + micros)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("raw")) for i, f in enumerate(fields)])
    long = base.withColumn("_p", F.explode(pairs)).select("_id", "_stream", "_own", "_stated", "_a", "_p.field", "_p.raw").where(F.col("raw").isNotNull())
    if wanted is not None:
        long = long.where(wanted)
    long = once(long, _anchor=anchor_us).drop("_a")
    parsed = parse_parts(long, "raw", zones).where("_ok")
    says = F.col("_epoch").isNotNull() | F.col("_offs").isNotNull() | F.col("_named").isNotNull()
    read = once(parsed, _utc=F.when(says, nearest(_readings(F.col("_named")), F.col("_anchor"))))
    open_ = lambda c: F.when(~says, F.col(c)).alias(c)
    return read.select("_id", "field", "raw", "_utc", open_("_local"), open_("_anchor"), open_("_stream"), open_("_own"), open_("_stated")).where("_utc is not null or _local is not null")


def _evidence(read: DataFrame) -> DataFrame:
    """Local values by the clock they were written with; those of a stream with clockless values also by the stream."""
    local = read.where("_local is not null").select("field", "_local", "_anchor", "_stream", "_own", "_stated")
    lost = local.where("_own is null and _stream is not null").select("_stream").distinct()
    by_stream = local.join(broadcast_if_small(lost), "_stream", "left_semi")
    keyed = lambda x, key: x.select(key.alias("_stream"), "_stated", "_anchor", "_local", "field")
    return keyed(local.where("_own is not null"), _clock_key()).unionByName(keyed(by_stream, _stream_key()))


def _clock_key() -> Column:
    return F.concat(F.lit("clock "), F.col("_own"))


def _stream_key() -> Column:
    return F.concat(F.lit("stream "), F.col("_stream"))


def normalise_instants(
    df: DataFrame,
    row_id: str,
    fields: list[str],
    anchor: str,
    stream: Column,
    stated_zone: Column,
    candidates: list[str],
    after: list[str] = (),
    wanted: Column | None = None,
    clock: Column | None = None,
) -> DataFrame:
    """Each readable value of ``fields`` as one UTC instant: (``row_id``, ``field``, ``raw``, ``utc_us``, ``zone_estimated``).

    ``anchor`` is a clean ISO UTC text column. ``clock`` names whose clocks wrote a row (null where that is not known) and
    ``stream`` rows that were written together; values without a zone take the zone estimated for their clock, or, where
    no clock is known, for their stream. Without ``clock`` the stream is the clock. ``stated_zone`` is what a row says of its clock's zone (an IANA name or null): evidence
    for the estimate. ``candidates`` are further zones to choose from; ``after`` lists fields that are written after the
    anchor. ``wanted`` restricts the raw values (column ``raw``).

    Null, blank, placeholder and impossible values give no row. Without clock and stream, or without any candidate, a
    local value takes its stated zone, and without one it gives no row. Rows are kept apart by ``row_id``: repeated rows each give theirs.
    Extra columns are ignored. Values are parsed once and read back from a checkpoint.
    """
    read = cut(_read(df, row_id, fields, anchor, stream, stream if clock is None else clock, stated_zone, wanted))
    zones = cut(estimate_zones(_evidence(read), candidates, list(after)).where("_zone is not null"))
    keyed = read.withColumn("_key", F.coalesce(_clock_key(), _stream_key()))
    joined = keyed.join(broadcast_if_small(zones.withColumnRenamed("_stream", "_key")), "_key", "left")
    zone = F.coalesce("_zone", F.when(F.col("_key").isNull(), F.col("_stated")))
    told = nearest(F.flatten(F.transform("_local", lambda x: local_readings(x, zone))), F.col("_anchor"))
    out = joined.select(F.col("_id").alias(row_id), "field", "raw", F.when(F.col("_utc").isNotNull(), F.col("_utc")).when(zone.isNotNull(), told).alias("utc_us"), (F.col("_utc").isNull() & F.col("_zone").isNotNull()).alias("zone_estimated"))
    return out.where("utc_us is not null")


def _segment_clocks(segments: DataFrame, tenants: DataFrame) -> tuple[DataFrame, list[str], dict[str, Column]]:
    from colloquy.functions.ids import dashed

    known = zone_names(segments.sparkSession)
    zones = tenants.where(F.col("zone").isin(known)).groupBy(dashed(F.col("tenantId")).alias("_t")).agg(F.min("zone").alias("_tz")).where("_t is not null")
    # distinct names of Java's own list: bounded by it
    candidates = sorted(r[0] for r in zones.select("_tz").distinct().collect())
    joined = segments.withColumn("_t", dashed(F.col("tenantId"))).join(broadcast_if_small(zones), "_t", "left")
    return joined, candidates, {"stream": dashed(F.coalesce("recordingId", "instanceId")), "clock": F.col("_t"), "stated_zone": F.col("_tz")}


_FIELDS, _AFTER = ["startTime", "createdAt", "updatedAt"], ["createdAt", "updatedAt"]


def segment_instants(segments: DataFrame, tenants: DataFrame, **kw) -> DataFrame:
    """:func:`normalise_instants` for delivered segments: the clocks are the tenants'.

    ``tenants`` (tenantId, zone) is a small fixed table: it is counted before it is broadcast. Its zone is what a row
    states of its clock, and its distinct zones are the candidates; of a tenant given twice the first zone by name holds.
    Rows that lack a tenant take the zone estimated for their recording.
    """
    joined, candidates, clocks = _segment_clocks(segments, tenants)
    return normalise_instants(joined, "seg_row_id", _FIELDS, "endTime", candidates=candidates, after=_AFTER, **clocks, **kw)


def segment_zones(segments: DataFrame, tenants: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(``tenant_id``, ``stated``, ``estimated``, ``blind``, ``n_values``): how the zone estimate of each tenant comes out.

    ``blind`` is the estimate from the alignment of the values alone, without what the tenants state; zones that differ in
    no value of a tenant are told apart by name only.
    """
    joined, candidates, c = _segment_clocks(segments, tenants)
    read = _read(joined, "seg_row_id", _FIELDS, "endTime", c["stream"], c["clock"], c["stated_zone"], wanted).where("_own is not null and _local is not null")
    values = cut(read.select(F.col("_own").alias("_stream"), "_stated", "_anchor", "_local", "field"))
    best = estimate_zones(values, candidates, _AFTER).withColumnRenamed("_zone", "estimated")
    blind = estimate_zones(values.withColumn("_stated", F.lit(None).cast("string")), candidates, _AFTER).withColumnRenamed("_zone", "blind")
    stated = values.groupBy("_stream").agg(F.max("_stated").alias("stated"), F.count(F.lit(1)).alias("n_values"))
    return stated.join(best, "_stream").join(blind, "_stream").select(F.col("_stream").alias("tenant_id"), "stated", "estimated", "blind", "n_values")
