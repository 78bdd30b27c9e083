"""All core queries and their SQL twins, collected from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans import graph_queries, keyphrase_queries, problems, ranking_queries, service_queries, text_queries

MODULES = [problems, text_queries, graph_queries, ranking_queries, keyphrase_queries, service_queries]
FLAGSHIP = "cooccurrence_top_words"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
