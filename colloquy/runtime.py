"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ... and its columns take at most this many bytes, by the width of a sample of its rows.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most ``size`` bytes together, else ``df`` itself.

    The count stops at ``rows + 1``; a larger side is left to a shuffle join. Rows are measured as JSON text.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """All rows of a table that is small by definition; an error, not a cut, when it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir`` of the session. Where none is set, a temporary folder serves a single-machine
    session (tests); on a cluster that folder would be each machine's own, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "colloquy-checkpoints"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added, each computed once per row.

    A one-row generator stands between the columns and what uses them: the optimizer then neither copies their
    expressions into every later use nor pushes a filter on them down into a second evaluation.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint: computed once, and safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running(df: DataFrame, by: list[str], chunk: str, order: list, value: Column, how: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum or maximum (``how``) of ``value`` over all rows of ``by`` before this one; null before the first.

    ``order`` must begin with what ``chunk`` (a column) is monotone in. No task orders more than one chunk of one ``by``;
    across chunks one row each is ordered.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    own, ahead, v = fresh("own"), fresh("ahead"), fresh("v")
    valued = df.withColumn(v, value)
    before = Window.unboundedPreceding, -1
    local = valued.withColumn(own, agg(v).over(Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(*before)))
    chunks = valued.groupBy(*by, chunk).agg(agg(v).alias(v))
    chunks = chunks.withColumn(ahead, agg(v).over(Window.partitionBy(*by).orderBy(chunk).rowsBetween(*before))).drop(v)
    joined = local.join(chunks, [*by, chunk])
    total = F.greatest(own, ahead) if how == "max" else F.when(F.col(own).isNull() & F.col(ahead).isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(ahead, F.lit(0)))
    return joined.withColumn(name, total).select(*df.columns, name)


def fresh(prefix: str) -> str:
    """A column name that cannot clash with a caller's."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"
