"""Mixing sources to target weights (problem 8).

1. The token streams of each source are laid end to end (distributed prefix sums) and cut into blocks of a fixed length.
2. The mixture is as large as the scarcest source allows. Its slots are dealt to output shards: every shard draws
   multinomial source counts, and the running totals are scaled so that each source ends at exactly its share.
3. Slot i of a source is a block through a keyed pseudorandom permutation of the source's block numbers (a Feistel
   network with cycle walking), a new one for every repetition, so no block is used more often than allowed.
4. Slots and blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import bounded_rows, cut

BLOCK_TOKENS = 256
SHARD_SLOTS = 4_096
#: Shards whose counts are summed up together; across these groups of shards one row each is summed up.
SHARD_GROUP = 4_096
#: Most target sources; more are an error.
SOURCES = 10_000
#: Slots that one task deals, about.
TASK_SLOTS = 200_000


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of ``i`` (values in [0, n)) under the pseudorandom permutation of [0, n) chosen by ``key``."""
    if n <= 1:
        return np.zeros(len(i), np.int64)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            left, right = right, left ^ (_mix(right, key * 4 + r + 0x9E3779B97F4A7C15 * (r + 1)) & mask)
        return (left << half) | right

    x = walk(i.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = walk(x[out])
    return x.astype(np.int64)


def source_blocks(sizes: DataFrame, block: int, bucket_docs: int = 20_000) -> DataFrame:
    """Where each document lies in the blocks of its source: (``source``, ``block``, ``doc_id``, ``token_start``, ``n_tokens``)."""
    docs = sizes.where("n_tokens > 0 and source is not null").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n"))
    buckets = max(1, -(-sizes.count() // bucket_docs))
    docs = docs.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = Window.partitionBy("source", "b").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("o", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = docs.groupBy("source", "b").agg(F.sum("n").alias("s"))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    laid = docs.join(sums, ["source", "b"]).withColumn("o", F.col("o") + F.col("base"))
    cut_at = F.sequence(F.floor(F.col("o") / block), F.floor((F.col("o") + F.col("n") - 1) / block))
    spans = laid.select("source", "doc_id", "o", "n", F.explode(cut_at).alias("block"))
    start = F.greatest(F.col("o"), F.col("block") * block)
    end = F.least(F.col("o") + F.col("n"), (F.col("block") + 1) * block)
    return spans.select("source", "block", "doc_id", (start - F.col("o")).alias("token_start"), (end - start).alias("n_tokens"))


def plan_slots(sizes: DataFrame, targets: DataFrame, block: int) -> list[dict]:
    """Per target source its blocks and slots. ``targets`` is a small fixed table; more than ``SOURCES`` rows are an error.

    Of a source given twice the smaller target, then the smaller number of repeats holds.
    """
    available = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = targets.where("target_share > 0 and source is not null and max_repeats > 0").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    rows = [r.asDict() for r in bounded_rows(wanted.join(available, "source").orderBy("source"), SOURCES, "target sources")]
    share = sum(r["target_share"] for r in rows)
    if not rows:
        return []
    total = min(r["tokens"] * r["max_repeats"] / (r["target_share"] / share) for r in rows)
    for r in rows:
        r["share"] = r["target_share"] / share
        r["blocks"] = -(-r["tokens"] // block)
        r["slots"] = min(r["blocks"] * r["max_repeats"], max(1, round(total * r["share"] / block)))
    return rows


def mix_sources(sizes: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """The mixture: (``shard``, ``slot``, ``source``, ``use_no``, ``doc_id``, ``token_start``, ``n_tokens``).

    ``sizes`` is (``doc_id``, ``source``, ``n_tokens``); ``targets`` is (``source``, ``target_share``, ``max_repeats``).
    A slot is a block of ``block`` tokens (the last block of a source may be shorter) and has one row for each document
    in it. Shares of sources without tokens are spread over the others. Documents of no target source, and those without
    tokens, are not used. Without targets or tokens there are no rows. Repeated documents are streams of their own.
    """
    spark = sizes.sparkSession
    plan = plan_slots(sizes, targets, block)
    schema = "shard long, slot long, source string, use_no long, block long"
    if not plan:
        empty = spark.createDataFrame([], schema)
        return empty.select("shard", "slot", "source", "use_no", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    names, share = [r["source"] for r in plan], np.array([r["share"] for r in plan])
    n_blocks = {r["source"]: int(r["blocks"]) for r in plan}
    slots = sum(r["slots"] for r in plan)
    shards = -(-slots // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = [np.random.default_rng([seed, int(j)]).multinomial(shard_slots, share / share.sum()) for j in pdf["id"]]
            yield pd.DataFrame({"shard": np.repeat(pdf["id"].to_numpy(), len(names)), "source": names * len(pdf), "c": np.concatenate(drawn) if drawn else []}).astype({"c": "int64"})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source string, c long")
    goal = spark.createDataFrame([(r["source"], int(r["slots"])) for r in plan], "source string, k long")

    # Running totals per source: inside groups of shards, and over one row per group ahead of them. Draws are seeded by
    # shard, so that a lost task draws the same again; they are computed once.
    drawn = cut(drawn.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP)))
    ahead = drawn.groupBy("source", "group").agg(F.sum("c").alias("_s"))
    whole = Window.partitionBy("source")
    ahead = ahead.withColumns({"_off": F.coalesce(F.sum("_s").over(whole.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("_s").over(whole)}).drop("_s")
    w = Window.partitionBy("source", "group").orderBy("shard")
    run = drawn.join(F.broadcast(goal), "source").join(ahead, ["source", "group"])
    run = run.withColumns({"upto": F.col("_off") + F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))})

    def scaled(upto: Column, shard: Column) -> Column:  # slots of the source up to and with the shard
        part = F.floor(upto.cast("decimal(19,0)") * F.col("k").cast("decimal(19,0)") / F.greatest("all", F.lit(1)).cast("decimal(19,0)")).cast("bigint")
        even = F.floor(F.col("k") * (shard + 1) / shards).cast("bigint")
        return F.when(shard < 0, 0).when(shard == shards - 1, F.col("k")).when(F.col("all") > 0, part).otherwise(even)

    run = run.withColumns({"hi": scaled(F.col("upto"), F.col("shard")), "lo": scaled(F.col("upto") - F.col("c"), F.col("shard") - 1)})
    placed = run.withColumns(
        {
            "at": F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("shard").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "in_shard": F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("shard")),
        }
    ).select("shard", "source", "lo", "hi", "at", "in_shard")
    # a range of slots longer than a few shards (scaled draws of a small plan) becomes rows of at most TASK_SLOTS / 16
    piece = TASK_SLOTS // 16
    starts = F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(piece).cast("bigint"))
    placed = placed.where("hi > lo").withColumn("from", F.explode(starts)).withColumn("to", F.least(F.col("from") + piece, F.col("hi")))
    tasks = max(1, -(-slots // TASK_SLOTS), min(shards, spark.sparkContext.defaultParallelism))
    placed = placed.repartition(tasks, "shard", "source", "from")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                n, code = n_blocks[r.source], names.index(r.source) + 1
                i = np.arange(r.start, r.stop, dtype=np.int64)
                use = i // n
                chosen = np.empty(len(i), np.int64)
                for u in np.unique(use):
                    m = use == u
                    chosen[m] = permute(i[m] % n, n, (seed * 1_000_003 + code) * 1_000_003 + int(u))
                slot = permute(i - r.lo + r.at, int(r.in_shard), (seed * 7 + 3) * 1_000_003 + int(r.shard))
                yield pd.DataFrame({"shard": r.shard, "slot": slot, "source": r.source, "use_no": use + 1, "block": chosen})

    dealt = placed.withColumnsRenamed({"from": "start", "to": "stop"}).mapInPandas(deal, schema)
    blocks = source_blocks(sizes.join(F.broadcast(goal.select("source")), "source", "left_semi"), block)
    # the slots are computed from a short range, whose size says nothing of theirs: never broadcast them
    return dealt.hint("merge").join(blocks, ["source", "block"]).select("shard", "slot", "source", "use_no", "doc_id", "token_start", "n_tokens")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(``source``, ``target_share``, ``actual_share``, ``n_tokens``, ``max_repeats``, ``most_uses``) per target source."""
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("use_no").alias("most_uses"))
    out = targets.where("source is not null").join(used, "source", "left").withColumns({"n_tokens": F.coalesce("n_tokens", F.lit(0)), "most_uses": F.coalesce("most_uses", F.lit(0))})
    actual = F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))
    return out.select("source", "target_share", actual.alias("actual_share"), "n_tokens", F.col("max_repeats").cast("bigint").alias("max_repeats"), "most_uses")
