"""Topic grouping: sentence similarity, communities, time groups, ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.vectors import cosine
from colloquy.runtime import bounded_rows, running


#: Most minds that are scored against; more are an error.
MINDS = 10_000


def mind_scores(vectors: DataFrame, minds: DataFrame, key: str) -> DataFrame:
    """(``key``, ``score``, ``mind``): best cosine of each vector over the ``minds`` (``mind``, ``mind_vec``), a small table (at most ``MINDS`` rows, else an error).

    The minds travel as one array literal column: no row is multiplied.
    """
    known = bounded_rows(minds.select(F.col("mind").alias("mind"), F.col("mind_vec").alias("v")).orderBy("mind"), MINDS, "minds")
    kind = vectors.sparkSession.createDataFrame([], minds.select("mind").schema).schema["mind"].dataType.simpleString()
    table = vectors.sparkSession.createDataFrame([([(r["mind"], r["v"]) for r in known],)], f"_minds array<struct<mind:{kind},v:array<double>>>")
    scored = vectors.join(F.broadcast(table)).withColumn("_s", F.transform("_minds", lambda m: F.struct(cosine(F.col("vec"), m["v"]).alias("s"), (-F.abs(m["mind"].cast("bigint"))).alias("o"), m["mind"].alias("mind"))))
    best = F.array_max(F.filter("_s", lambda x: x["s"].isNotNull()))
    return scored.select(key, best["s"].alias("score"), best["mind"].alias("mind"))


def pim_scores(vectors: DataFrame, minds: DataFrame, key: str, nsp, dampening: float = 0.7) -> DataFrame:
    """(``key``, ``score``): the best over the minds of the mean of cosine and damped next-sentence score.

    ``nsp`` is a function of the mind's column that gives the next-sentence score of the row with that mind.
    """
    known = bounded_rows(minds.select("mind", "mind_vec").orderBy("mind"), MINDS, "minds")
    each = [(cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in r["mind_vec"]])) + nsp(F.lit(r["mind"])) * dampening) / 2 for r in known]
    best = F.array_max(F.array_compact(F.array(*each))) if each else F.lit(None).cast("double")
    return vectors.select(key, best.alias("score"))


def segment_distance(score: Column, n_words: Column) -> tuple[Column, Column]:
    """(score, distance): a tenth of the score below 40 words; distance = 1 / score."""
    s = F.when(n_words < 40, score * 0.1).otherwise(score)
    return s, F.try_divide(F.lit(1.0), s)


def next_segment_pairs(sentences: DataFrame, session: str) -> DataFrame:
    """(``session``, ``i``, ``j``, ``w``): cosine of sentences whose segments are the same or neighbours, i before j.

    ``sentences`` has ``sentence``, ``ord`` (segment order) and ``vec``. An equi-join on the order, written as two keys per
    row; no range condition.
    """
    a = sentences.select(session, F.col("sentence").alias("i"), F.col("ord").alias("_oi"), F.col("vec").alias("_a"))
    b = sentences.select(session, F.col("sentence").alias("j"), F.col("ord").alias("_oj"), F.col("vec").alias("_b"))
    a = a.withColumn("_oj", F.explode(F.array("_oi", F.col("_oi") + 1)))
    near = a.join(b, [session, "_oj"]).where((F.col("_oj") > F.col("_oi")) | (F.col("i") < F.col("j")))
    return near.select(session, "i", "j", cosine(F.col("_a"), F.col("_b")).alias("w"))


def normalised_similarity(pairs: DataFrame, session: str) -> DataFrame:
    """Weights min-max normalised per row and symmetrised: (w'_ij + w'_ji) / 2; null where a row has no range.

    ``pairs`` holds each pair once; rows are formed from both directions.
    """
    both = pairs.select(session, F.col("i").alias("a"), F.col("j").alias("b"), "w").unionByName(pairs.where("i <> j").select(session, F.col("j").alias("a"), F.col("i").alias("b"), "w"))
    w = Window.partitionBy(session, "a")
    n = both.withColumn("n", F.try_divide(F.col("w") - F.min("w").over(w), F.max("w").over(w) - F.min("w").over(w)))
    return n.groupBy(session, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.avg("n").alias("w"))


def _full_weights(vectors: list) -> np.ndarray:
    """Symmetric weights of all pairs of a session's vectors, 1 on the diagonal; NaN where a row has no range or a vector is zero.

    The diagonal of the cosines becomes the row's mean before each row's minimum and maximum are taken.
    """
    v = np.array(vectors, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        x = u @ u.T
        known = ~np.isnan(x)
        np.fill_diagonal(x, np.where(known, x, 0).sum(axis=1) / known.sum(axis=1))
        low, high = np.where(known, x, np.inf).min(axis=1, keepdims=True), np.where(known, x, -np.inf).max(axis=1, keepdims=True)
        n = (x - low) / np.where(high > low, high - low, np.nan)
    w = (n + n.T) / 2
    np.fill_diagonal(w, 1.0)
    return w


def full_similarity(sentences: DataFrame, session: str) -> DataFrame:
    """(``session``, ``i``, ``j``, ``w``): all pairs i <= j of a session, min-max normalised over whole rows and symmetrised.

    One task per session; a session's matrix is held at once.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sentence")
        ids, w = pdf["sentence"].to_numpy(), _full_weights(pdf["vec"].tolist())
        i, j = np.triu_indices(len(ids))
        return pd.DataFrame({session: key[0], "i": ids[i], "j": ids[j], "w": w[i, j]})

    rows = sentences.where("vec is not null").select(session, "sentence", "vec").groupBy(session).applyInPandas(run, f"{session} string, i long, j long, w double")
    return rows.withColumn("w", F.nanvl("w", F.lit(None)))


def prune_percentile(pairs: DataFrame, session: str, v: float) -> DataFrame:
    """Pairs with a weight of at least the session's ``v``-th percentile (linear interpolation)."""
    cut_at = pairs.groupBy(session).agg(F.percentile("w", F.lit(v / 100)).alias("_p"))
    return pairs.join(cut_at, session).where(F.col("w") >= F.col("_p")).drop("_p")


def louvain_labels(i: list, j: list, w: list, resolution: float = 1.0) -> dict:
    """Deterministic Louvain: nodes in order, the best gain wins, ties go to the smallest label."""
    nodes = sorted(set(i) | set(j))
    label = {n: n for n in nodes}
    graph: dict = {n: {} for n in nodes}
    for a, b, x in zip(i, j, w, strict=True):
        graph[a][b] = graph[a].get(b, 0.0) + x
        if a != b:
            graph[b][a] = graph[b].get(a, 0.0) + x
    while True:
        degree = {n: sum(x for m, x in graph[n].items()) + graph[n].get(n, 0.0) for n in graph}
        total = sum(degree.values())
        if total <= 0:
            return label
        own, weight, moved_ever = {n: n for n in graph}, dict(degree), False
        for _ in range(50):
            moved = False
            for n in sorted(graph):
                weight[own[n]] -= degree[n]
                links: dict = {own[n]: 0.0}
                for m, x in graph[n].items():
                    if m != n:
                        links[own[m]] = links.get(own[m], 0.0) + x
                gain = {c: x - resolution * degree[n] * weight[c] / total for c, x in links.items()}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c))
                if gain[best] <= gain[own[n]] + 1e-12:
                    best = own[n]
                moved |= best != own[n]
                own[n] = best
                weight[best] += degree[n]
            moved_ever |= moved
            if not moved:
                break
        if not moved_ever:
            return label
        label = {n: own[c] for n, c in label.items()}
        merged: dict = {c: {} for c in set(own.values())}
        for a in graph:
            for b, x in graph[a].items():
                if a < b:
                    merged[own[a]][own[b]] = merged[own[a]].get(own[b], 0.0) + x
                    if own[a] != own[b]:
                        merged[own[b]][own[a]] = merged[own[b]].get(own[a], 0.0) + x
                elif a == b:
                    merged[own[a]][own[a]] = merged[own[a]].get(own[a], 0.0) + x
        graph = merged


def communities(pairs: DataFrame, session: str, resolution: float = 0.9) -> DataFrame:
    """(``session``, ``sentence``, ``community``) by Louvain per session; ``pairs`` is (``session``, ``i``, ``j``, ``w``)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        label = louvain_labels(pdf["i"].tolist(), pdf["j"].tolist(), np.maximum(pdf["w"].fillna(0.0), 0.0).tolist(), resolution)
        return pd.DataFrame({session: key[0], "sentence": list(label), "community": list(label.values())})

    return pairs.groupBy(session).applyInPandas(run, f"{session} string, sentence long, community long")


def hierarchical_split(labels: DataFrame, sentences: DataFrame, session: str, v: float = 75) -> DataFrame:
    """(``session``, ``sentence``, ``community``): every community of two or more sentences split once more.

    Of its own full similarity graph, edges below the ``v``-th percentile go, then Louvain runs again; a sentence always keeps
    its edge with itself. The new labels are unique in the session.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for n, (_, part) in enumerate(pdf.sort_values("sentence").groupby("community", sort=True)):
            ids, w = part["sentence"].tolist(), _full_weights(part["vec"].tolist())
            i, j = np.triu_indices(len(ids))
            x = np.nan_to_num(w[i, j])
            kept = (x > 0) & (x >= np.percentile(x[x > 0], v))
            kept |= i == j
            label = louvain_labels([ids[a] for a in i[kept]], [ids[b] for b in j[kept]], x[kept].tolist())
            out += [(key[0], s, (n, label[s])) for s in ids]
        number = {c: k for k, c in enumerate(sorted({c for *_, c in out}))}
        return pd.DataFrame([(k, s, number[c]) for k, s, c in out], columns=[session, "sentence", "community"])

    rows = labels.select(session, "sentence", "community").join(sentences.select(session, "sentence", "vec"), [session, "sentence"])
    return rows.groupBy(session).applyInPandas(run, f"{session} string, sentence long, community long")


def readd_removed(groups: DataFrame, segments: DataFrame, session: str) -> DataFrame:
    """``groups`` (``session``, ``segment``, ``group``) with each of the ``segments`` that is in none as a group of its own."""
    lost = segments.select(session, "segment").distinct().join(groups, [session, "segment"], "left_anti")
    return groups.select(session, "segment", "group").unionByName(lost.withColumn("group", F.col("segment")))


def time_groups(assigned: DataFrame, segments: DataFrame, scores: DataFrame, session: str) -> DataFrame:
    """(``session``, ``group``, ``size``, ``start``, ``end``, ``mean_score``, ``rank``): a session's groups from its communities.

    ``assigned`` (``session``, ``segment``, ``community``) is split into time islands, over the order of the segments that it has;
    the other ``segments`` return as single groups; groups inside another one join it; single groups go, if there is a larger
    one; the rest is ranked by the mean of the ``scores`` (``session``, ``segment``, ``score``). A group's name is its first segment.
    """
    placed = assigned.withColumn("ord", F.row_number().over(Window.partitionBy(session).orderBy("segment")))
    island = Window.partitionBy(session, "community", "island")
    g = time_islands(placed, [session, "community"]).withColumn("group", F.min("segment").over(island))
    all_of = readd_removed(g, segments, session)
    spans = all_of.groupBy(session, "group").agg(F.count(F.lit(1)).alias("size"), F.min("segment").alias("start"), F.max("segment").alias("end"))
    merged = all_of.join(merge_contained(spans, session), [session, "group"]).select(session, "segment", F.col("into").alias("group"))
    final = merged.groupBy(session, "group").agg(F.count(F.lit(1)).alias("size"), F.min("segment").alias("start"), F.max("segment").alias("end"))
    kept = drop_singletons(final, session)
    scored = merged.join(kept.select(session, "group"), [session, "group"], "left_semi").join(scores, [session, "segment"], "left")
    return kept.join(order_groups(scored, session, "group", F.col("score")), [session, "group"])


def majority_assign(members: DataFrame, session: str) -> DataFrame:
    """(``session``, ``segment``, ``community``, ``n``): the community with most of a segment's sentences; ties to the later."""
    n = members.groupBy(session, "segment", "community").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(session, "segment").agg(F.max(F.struct("n", "community")).alias("m"))
    return best.select(session, "segment", F.col("m.community").alias("community"), F.col("m.n").alias("n"))


def time_islands(segments: DataFrame, keys: list[str], chunk: int = 4096) -> DataFrame:
    """Adds ``island``: within ``keys``, segments whose ``ord`` follow each other without a gap.

    Ordered in chunks of ``chunk`` positions; see :func:`running`.
    """
    rows = segments.withColumn("_chunk", F.floor(F.col("ord") / chunk))
    seen = running(rows, keys, "_chunk", ["ord"], F.col("ord"), "max", "_before")
    breaks = seen.withColumn("_b", F.when(F.col("ord") - F.col("_before") <= 1, 0).otherwise(1)).drop("_before")
    counted = running(breaks, keys, "_chunk", ["ord"], F.col("_b"), "sum", "_n")
    return counted.withColumn("island", (F.coalesce("_n", F.lit(0)) + F.col("_b")).cast("bigint")).drop("_b", "_n", "_chunk")


def numbered_sentences(segments: DataFrame, session: str, order: str, sentences: str, chunk: int = 4096) -> DataFrame:
    """One row per sentence of the array ``sentences``: ``pos`` in its segment, ``idx`` in its session (both from 0), ``sentence``."""
    rows = segments.withColumn("_chunk", F.floor(F.col(order) / chunk))
    counted = running(rows, [session], "_chunk", [order], F.size(sentences), "sum", "_before")
    each = counted.select(session, order, "_before", F.posexplode(sentences).alias("pos", "sentence"))
    return each.select(session, order, F.col("pos").cast("bigint").alias("pos"), (F.coalesce("_before", F.lit(0)) + F.col("pos")).cast("bigint").alias("idx"), "sentence")


def compact_order(segments: DataFrame, session: str, order: str, chunk: int = 4096) -> DataFrame:
    """Adds ``new_ord``: the positions from 0 that a session's rows have among those that are left."""
    rows = segments.withColumn("_chunk", F.floor(F.col(order) / chunk))
    counted = running(rows, [session], "_chunk", [order], F.lit(1), "sum", "new_ord")
    return counted.withColumn("new_ord", F.coalesce("new_ord", F.lit(0)).cast("bigint")).drop("_chunk")


def drop_singletons(groups: DataFrame, session: str, size: str = "size") -> DataFrame:
    """Groups of one segment go, if their session has a larger one."""
    w = Window.partitionBy(session)
    return groups.withColumn("_m", F.max(size).over(w)).where((F.col("_m") <= 1) | (F.col(size) > 1)).drop("_m")


def merge_contained(groups: DataFrame, session: str, chunk: float = 3_600_000_000) -> DataFrame:
    """(``session``, ``group``, ``into``): each group whose [start, end] lies inside a larger one joins the widest that holds it.

    Sorted by (start, end descending, group), a group is contained exactly if the running maximum of the ends before it
    reaches its end; the holder is the group that set that maximum. At least one of the two must have several segments.
    Chains are resolved by the widest holder, which contains all of them. ``chunk`` is the stretch of starts that one task orders.
    """
    holder = F.struct(F.col("end"), (-F.col("start").cast("double")).alias("s"), F.col("group").alias("g"), F.col("size").alias("n"))
    rows = groups.withColumn("_chunk", F.floor(F.col("start") / chunk))
    held = running(rows, [session], "_chunk", ["start", F.desc("end"), "group"], holder, "max", "_h")
    inside = F.col("_h").isNotNull() & (F.col("_h.end") >= F.col("end")) & ((F.col("size") > 1) | (F.col("_h.n") > 1))
    return held.select(session, "group", F.when(inside, F.col("_h.g")).otherwise(F.col("group")).alias("into"))


def order_groups(segments: DataFrame, session: str, group: str, score: Column) -> DataFrame:
    """(``session``, ``group``, ``mean_score``, ``rank``): groups by mean score of their segments, a missing score is 0."""
    g = segments.groupBy(session, group).agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("mean_score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("mean_score"), group)).cast("bigint"))


def topic_order(items: DataFrame, groups: DataFrame, recording: str) -> DataFrame:
    """(``group``, ``distance``, ``rank``): groups by the smallest distance of their recordings, first occurrence each."""
    best = items.join(groups, recording).groupBy("group").agg(F.min("distance").alias("distance"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "group")).cast("bigint"))
