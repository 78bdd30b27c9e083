"""Session state from event streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.operators.graph import latest
from colloquy.operators.wordgraph import build_word_graph

LIFECYCLE = "session string, mind string, segments long, ended boolean"


def session_state(events: DataFrame, default_mind: str, idle_ms: int = 3_600_000) -> DataFrame:
    """State per session from (``session``, ``event``, ``mind``): started sets the mind, segments are counted, ended clears.

    Emits the state after each batch of a session's events. A session without a stored mind has ``default_mind``. State
    of an idle session is dropped after ``idle_ms``. A repeated start keeps the count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mind, n = state.get if state.exists else (None, 0)
        ended = False
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples(index=False):
                if r.event == "started":
                    mind, ended = r.mind or mind, False
                elif r.event == "segment":
                    n += 1
                elif r.event == "ended":
                    ended = True
        out = pd.DataFrame({"session": [key[0]], "mind": [mind or default_mind], "segments": [n], "ended": [ended]})
        if ended:
            state.remove()
        else:
            state.update((mind, n))
            state.setTimeoutDuration(idle_ms)
        yield out

    return events.groupBy("session").applyInPandasWithState(step, LIFECYCLE, "mind string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: Folders that stored edges are spread over by graph; a batch reads those of its own graphs.
EDGE_BUCKETS = 64


def merge_word_graph(path: str, window: int = 4) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: edges of new segments (``graph``, ``text``) that the stored set lacks are appended.

    Edges are a set, so a replayed batch changes nothing. The store is partitioned by bucket of the graph; only the buckets
    of the batch's graphs are read.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = build_word_graph(batch, F.col("graph"), F.col("text"), window).withColumn("bucket", F.pmod(F.xxhash64("graph"), F.lit(EDGE_BUCKETS)))
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most EDGE_BUCKETS
        try:
            stored = spark.read.parquet(path).where(F.col("bucket").isin(buckets))
            new = new.join(stored.select("graph", "src", "dst"), ["graph", "src", "dst"], "left_anti")
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return run


def membership(events: DataFrame) -> DataFrame:
    """(``contextId``, ``userId``, ``state``, ``at``): the latest event wins, whatever the order of arrival."""
    return latest(events.select("contextId", "userId", "state", "at"), ["contextId", "userId"], ["at", "state"])


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events per type and tumbling window, late ones admitted up to ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


def route(handlers: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` dispatcher: each handler gets the rows of its ``subject``."""

    def run(batch: DataFrame, _: int) -> None:
        for subject, handle in handlers.items():
            handle(batch.where(F.col("subject") == subject))

    return run
