from datetime import UTC, datetime

from pyspark.sql import functions as F

from colloquy.operators.instants import EXACT_UTC, normalise_instants, segment_instants, segment_zones

END = "2020-06-09T12:00:00Z"


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


def read(spark, rows, zones=("America/New_York", "Europe/Berlin")):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, v string, e string, z string, s string")
    out = normalise_instants(df, "id", ["v"], "e", F.col("s"), F.col("z"), list(zones))
    return {r["id"]: (r["utc_us"], r["zone_estimated"]) for r in out.collect()}


FORMATS = [
    ("2020-06-09T14:00:00+02:00", None, END, "2020-06-09T12:00:00"),
    ("2020-06-09T14:00:00.123456789+02:00[Europe/Berlin]", None, END, "2020-06-09T12:00:00.123456"),
    ("\t2020-06-09t12:00:00.5z ", None, END, "2020-06-09T12:00:00.5"),
    ("2020-06-09T12:00:00,141Z", None, END, "2020-06-09T12:00:00.141"),
    ("20200609T140000+0200", None, END, "2020-06-09T12:00:00"),
    ("2020-161T12:00:00Z", None, END, "2020-06-09T12:00:00"),
    ("1591704000", None, END, "2020-06-09T12:00:00"),
    ("1591704000.25", None, END, "2020-06-09T12:00:00.25"),
    ("1591704000123", None, END, "2020-06-09T12:00:00.123"),
    ("1591704000123456", None, END, "2020-06-09T12:00:00.123456"),
    ("1591704000123456789", None, END, "2020-06-09T12:00:00.123456"),
    ("2020-06-09 14:00", "Europe/Berlin", END, "2020-06-09T12:00:00"),
    ("2020/06/09 14:00:00", "Europe/Berlin", END, "2020-06-09T12:00:00"),
    ("09.06.2020 14:00:00", "Europe/Berlin", END, "2020-06-09T12:00:00"),
    ("09-Jun-2020 14.00.00", "Europe/Berlin", END, "2020-06-09T12:00:00"),
    ("Jun 9, 2020 2:00:00 PM", "Europe/Berlin", END, "2020-06-09T12:00:00"),
    ("Jun 9, 2020 12:00:00 AM", "UTC", END, "2020-06-09T00:00:00"),
    ("Tue, 09 Jun 2020 14:00:00 +0200", None, END, "2020-06-09T12:00:00"),
    ("9 Jun 2020 08:00:00 EDT", None, END, "2020-06-09T12:00:00"),
    ("2020-06-09 14:00:00 UTC+2", None, END, "2020-06-09T12:00:00"),
    ("2020-06-09 17:30:00 GMT+05:30", None, END, "2020-06-09T12:00:00"),
    ("2020-06-09 14:00:00 Europe/Berlin", None, END, "2020-06-09T12:00:00"),
    ("2020-06-09 12:00:00UTC", None, END, "2020-06-09T12:00:00"),
    # day or month first: the reading closest to the end
    ("06/09/2020 12:00:00", "UTC", END, "2020-06-09T12:00:00"),
    ("06/09/2020 12:00:00", "UTC", "2020-09-06T13:00:00Z", "2020-09-06T12:00:00"),
    # IST is India, Ireland or Israel
    ("9 Jun 2020 17:30:00 IST", None, END, "2020-06-09T12:00:00"),
    ("9 Jun 2020 13:00:00 IST", None, END, "2020-06-09T12:00:00"),
    # skipped by the clock change: the offset before it; repeated: the reading closest to the end
    ("2021-03-14 02:30:00", "America/New_York", "2021-03-14T08:00:00Z", "2021-03-14T07:30:00"),
    ("2021-11-07 01:30:00", "America/New_York", "2021-11-07T05:40:00Z", "2021-11-07T05:30:00"),
    ("2021-11-07 01:30:00", "America/New_York", "2021-11-07T06:40:00Z", "2021-11-07T06:30:00"),
]


def test_formats(spark):
    """Each value is a stream of its own; a local one comes by the estimate, for which the stated zone is evidence."""
    got = read(spark, [(raw, end, zone, str(i)) for i, (raw, zone, end, _) in enumerate(FORMATS)])
    assert {i: v for i, (v, _) in got.items()} == {i: us(f[3]) for i, f in enumerate(FORMATS)}
    assert all(estimated == (FORMATS[i][1] is not None) for i, (_, estimated) in got.items())


def test_blind_estimate_finds_the_offset_history(spark):
    """Without any statement the zone is told by the values' alignment with their anchors, in summer and in winter."""
    rows = [("2020-06-09 13:59:00", END, None, "a"), ("2020-12-09 12:58:00", "2020-12-09T12:00:00Z", None, "a")]
    assert read(spark, rows, ("America/New_York", "Europe/Berlin", "Africa/Lagos"))[0] == (us("2020-06-09T11:59:00"), True)


def test_zones_report(spark):
    segs = [(i, f"2020-06-09 {h}:59:00", None, None, END, t, "r", None) for i, (h, t) in enumerate([("13", "0a" * 16), ("13", "0a" * 16), ("07", "0b" * 16)])]
    df = spark.createDataFrame(segs, "seg_row_id long, startTime string, createdAt string, updatedAt string, endTime string, tenantId string, recordingId string, instanceId string")
    tenants = spark.createDataFrame([("0a" * 16, "Europe/Berlin"), ("0b" * 16, "America/New_York"), ("0c" * 16, "no zone")], "tenantId string, zone string")
    got = {(r["stated"], r["estimated"], r["blind"], r["n_values"]) for r in segment_zones(df, tenants).collect()}
    assert got == {("Europe/Berlin", "Europe/Berlin", "Europe/Berlin", 2), ("America/New_York", "America/New_York", "America/New_York", 1)}


def test_values_that_name_no_instant(spark):
    bad = [None, "", " ", "-", "NaN", "TBD", "25:61", "2020-13-04 08:00:00", "2019-02-30T10:15:00+01:00", "0000-00-00T00:00:00Z", "2020-06-09 12:00:00 XYZ", "31/04/2020 10:00:00", "2020-06-09T24:61:00Z", "x" * 100_000]
    assert read(spark, [(b, END, "UTC", "a") for b in bad]) == {}


def test_missing_zone_is_estimated_per_stream(spark):
    rows = [("2020-06-09 13:59:00", END, None, "a"), ("2020-06-09 13:58:00", END, None, "a"), ("2020-06-09 07:59:00", END, None, "b"), ("2020-06-09 13:59:00", END, None, None)]
    got = read(spark, rows)
    assert got == {0: (us("2020-06-09T11:59:00"), True), 1: (us("2020-06-09T11:58:00"), True), 2: (us("2020-06-09T11:59:00"), True)}


def test_stated_zone_of_the_stream_outweighs_distance(spark):
    rows = [("2020-06-09 10:00:00", END, "Europe/Berlin", "a"), ("2020-06-09 10:00:00", END, "Europe/Berlin", "a"), ("2020-06-09 08:00:00", END, None, "a")]
    assert read(spark, rows)[2] == (us("2020-06-09T06:00:00"), True)


def test_empty_ties_repeats_and_clashing_columns(spark):
    schema = "seg_row_id long, startTime string, createdAt string, updatedAt string, endTime string, tenantId string, recordingId string, instanceId string, raw string, field string, _local int, utc_us string"
    tenants = spark.createDataFrame([("0A" * 16, "UTC", 1)], "tenantId string, zone string, raw int")
    assert segment_instants(spark.createDataFrame([], schema), tenants).count() == 0
    row = (1, "2020-06-09 12:00", None, END, END, "0a" * 16, None, None, "x", "y", 3, "z")
    out = segment_instants(spark.createDataFrame([row, row], schema), tenants, wanted=~F.col("raw").rlike(EXACT_UTC)).collect()
    assert [(r["seg_row_id"], r["field"], r["utc_us"]) for r in out] == [(1, "startTime", us("2020-06-09T12:00:00"))] * 2
    nobody = spark.createDataFrame([], "tenantId string, zone string")
    assert segment_instants(spark.createDataFrame([row], schema), nobody).where("field = 'startTime'").count() == 0
