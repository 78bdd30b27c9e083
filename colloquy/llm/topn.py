"""Top N items within every group (problem 3).

Pass 1: every partition keeps, per group, its best N items in the full order (score descending, then the tie rule); where
it holds N or more, its N-th best is a lower bound: at least N items are as good. The best of these bounds per group is
joined to the rows in pass 2; rows below it are gone before anything is ranked. A group that fills half a partition or
half the table shuffles at most N rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import BROADCAST_ROWS, cut

#: Copies of a bound where the bounds are too many to broadcast: rows of a hot group spread over so many join keys.
SALTS = 16


def _local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group the N-th best row of this partition, if it has N. Columns: g, n, score, tie, id."""
    kept: pa.Table | None = None
    pending: list[pa.RecordBatch] = []
    rows = 0

    def prune(parts: list) -> pa.Table:
        t = pa.concat_tables([pa.Table.from_batches([b]) if isinstance(b, pa.RecordBatch) else b for b in parts])
        t = t.sort_by([("g", "ascending"), ("score", "descending"), ("tie", "ascending"), ("id", "ascending")])
        g = t.column("g").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1]
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) + 1
        t = t.append_column("rank", pa.array(rank, pa.int64()))
        return t.filter(pa.array(rank <= t.column("n").to_numpy()))

    for b in batches:
        if b.num_rows:
            pending.append(b)
            rows += b.num_rows
        if rows > max(200_000, kept.num_rows if kept is not None else 0):  # sorted again only when as much has come in
            kept = prune(([kept.drop(["rank"])] if kept is not None else []) + pending)
            pending, rows = [], 0
    if pending:
        kept = prune(([kept.drop(["rank"])] if kept is not None else []) + pending)
    if kept is not None:
        last = kept.filter(pa.array(kept.column("rank").to_numpy() == kept.column("n").to_numpy()))
        yield from last.drop(["rank"]).combine_chunks().to_batches()


def top_n(rows: DataFrame, group: Column, n: Column, score: Column, tie: Column, row_id: Column) -> DataFrame:
    """The first ``n`` rows of each group: (``g``, ``pos``, ``id``), by score descending, tie ascending, id ascending.

    Rows with a null or NaN score, a null group or ``n`` null or below 1 do not compete; a null tie sorts before all
    texts. Repeated rows compete as often as they occur. Groups without a competing row give nothing.
    """
    base = rows.select(group.alias("g"), n.cast("bigint").alias("n"), score.cast("double").alias("score"), F.coalesce(tie, F.lit("")).alias("tie"), row_id.cast("bigint").alias("id"))
    base = base.where(F.col("g").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("n") >= 1))
    local = base.mapInArrow(_local_best, base.schema)
    worst_first = F.struct((-F.col("score")).alias("s"), F.col("tie").alias("t"), F.col("id").alias("i"))
    bounds = cut(local.groupBy("g").agg(F.min(worst_first).alias("bound")))
    if bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bounded = base.join(F.broadcast(bounds), "g", "left")
    else:
        salted = base.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        copies = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        bounded = salted.join(copies, ["g", "_salt"], "left")
    survivors = bounded.where(F.col("bound").isNull() | (worst_first <= F.col("bound")))
    w = Window.partitionBy("g").orderBy(F.desc("score"), F.asc("tie"), F.asc("id"))
    return survivors.withColumn("pos", F.row_number().over(w).cast("bigint")).where("pos <= n").select("g", "pos", "id")


def instance_keyphrases(requests: DataFrame, keyphrases: DataFrame, default: int = 10) -> DataFrame:
    """(``instance_id``, ``pos``, ``kp_id``): per requested instance its first ``limit`` keyphrases by boosted_sim.

    A request delivered more than once asks for the largest of its limits; a null limit means ``default``.
    """
    from colloquy.functions.ids import dashed
    from colloquy.runtime import broadcast_if_small

    limits = requests.where("instanceId is not null").groupBy(dashed(F.col("instanceId")).alias("_i")).agg(F.coalesce(F.max("limit"), F.lit(default)).alias("_n"))
    rows = keyphrases.select(dashed(F.col("instanceId")).alias("_i"), F.col("score.boosted_sim").alias("_s"), F.col("originalForm").alias("_f"), F.col("kp_id").alias("_k"))
    found = top_n(rows.join(broadcast_if_small(limits), "_i"), F.col("_i"), F.col("_n"), F.col("_s"), F.col("_f"), F.col("_k"))
    return found.select(F.col("g").alias("instance_id"), "pos", F.col("id").alias("kp_id"))
