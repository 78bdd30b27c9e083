import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.operators.intervals import continuous_periods

SCHEMA = "k string, s long, e long, kind string, start_us string, _chunk int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    out = continuous_periods(df, {"k": F.col("k")}, F.col("s"), F.col("e"), salts=2)
    return sorted((r["k"], r["kind"], r["start_us"], r["end_us"]) for r in out.collect())


def brute(rows):
    out, by = [], {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)]
    return sorted(out)


HOUR = 3_600_000_000


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), s := r.choice([r.randrange(6 * HOUR), r.randrange(12) * HOUR // 2]), s + r.choice([1, HOUR // 7, HOUR // 2, HOUR, 3 * HOUR, 0, -5])) for _ in range(r.choice([3, 30, 120]))]
    rows += rows[: len(rows) // 4] + [("a", None, 5), ("a", 5, None)]
    assert run(spark, rows) == brute(rows)


def test_touching_nested_and_long_spans(spark):
    rows = [("a", 0, HOUR), ("a", HOUR, 2 * HOUR), ("a", 10, 20), ("b", 0, 9 * HOUR), ("b", 2 * HOUR, 3 * HOUR), ("b", 10 * HOUR, 10 * HOUR + 1), ("c", -5, -1)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", 3, 3), (None, 1, 2)]) == []
