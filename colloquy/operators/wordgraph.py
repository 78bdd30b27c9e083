"""Word graph, centrality and phrases.

Graphs are DataFrames: ``edges(graph, src, dst)`` with ``src < dst`` once per edge, ``nodes(graph, word, ...)``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.tagging import default_tag, pos_tag
from colloquy.functions.text import STOP_WORDS, lemma, words
from colloquy.runtime import broadcast_if_small, cut

DAMPING = 0.85


def text_tokens(df: DataFrame, graph: Column, text_id: Column, text: Column, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(``graph``, ``text_id``, ``pos``, ``word``): words without stop words, numbered from 0 within each text.

    Numbering is done inside each row's array: no window, no shuffle. Null texts give nothing.
    """
    kept = F.filter(words(text), lambda w: ~w.isin(stop) & (F.length(w) > 1))
    return df.select(graph.alias("graph"), text_id.alias("text_id"), F.posexplode(kept).alias("pos", "word"))


def build_word_graph(df: DataFrame, graph: Column, text: Column, window: int = 4, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(``graph``, ``src``, ``dst``): words at distance 1..window-1 in a text of the graph; a set, without self edges.

    The neighbours come from slices of each row's own array, so only distinct edges are shuffled.
    """
    kept = df.select(graph.alias("graph"), F.filter(words(text), lambda w: ~w.isin(stop) & (F.length(w) > 1)).alias("w"))
    return neighbour_edges(kept, F.col("w"), window)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("graph", F.inline(F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def degree(edges: DataFrame) -> DataFrame:
    """(``graph``, ``word``, ``degree``)."""
    return symmetric(edges).groupBy("graph", F.col("src").alias("word")).agg(F.count(F.lit(1)).alias("degree"))


#: A graph of at most this many edges is iterated in one task's memory; a larger one by joins.
LOCAL_EDGES = 1_000_000


def _local_ranks(src: np.ndarray, dst: np.ndarray, iterations: int, tol: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Words and ranks of one graph whose edges are given once."""
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = code[: len(src)], code[len(src) :]
    out, into, n = np.concatenate([a, b]), np.concatenate([b, a]), len(nodes)
    deg, r = np.bincount(out, minlength=n), np.full(n, 1 / max(n, 1))
    for _ in range(iterations):
        new = (1 - DAMPING) / n + DAMPING * np.bincount(into, (r / deg)[out], n)
        done = tol is not None and np.abs(new - r).sum() < n * tol
        r = new
        if done:
            break
    return nodes, r


def pagerank(edges: DataFrame, iterations: int = 20, tol: float | None = None, checkpoint_every: int = 10, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(``graph``, ``word``, ``pagerank``) of each graph, unweighted, damping 0.85; sums to 1 per graph.

    Fixed ``iterations``, or until the summed change of a graph is below its size times ``tol``. Every word has an edge, so
    no mass dangles. Graphs of at most ``local_edges`` edges (sessions) are iterated one a task; larger ones by joins on
    (graph, word), all until the slowest is done, their lineage cut every few rounds.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words_, ranks = _local_ranks(pdf["src"].to_numpy(str), pdf["dst"].to_numpy(str), iterations, tol)
        return pd.DataFrame({"graph": key[0], "word": words_, "pagerank": ranks})

    edges = cut(edges)
    large = cut(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_edges).select("graph"))
    if large.isEmpty():
        return edges.groupBy("graph").applyInPandas(one, "graph string, word string, pagerank double")
    few = broadcast_if_small(large)
    small = edges.join(few, "graph", "left_anti").groupBy("graph").applyInPandas(one, "graph string, word string, pagerank double")
    return small.unionByName(_joined_ranks(edges.join(few, "graph", "left_semi"), iterations, tol, checkpoint_every))


def _joined_ranks(edges: DataFrame, iterations: int, tol: float | None, checkpoint_every: int) -> DataFrame:
    deg = cut(degree(edges))
    n = deg.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    sized = deg.join(broadcast_if_small(n), "graph")  # one row per large graph
    links = cut(symmetric(edges).join(sized.withColumnRenamed("word", "src"), ["graph", "src"]))
    ranks = sized.select("graph", "word", "n", (1.0 / F.col("n")).alias("r"))
    for i in range(iterations):
        sent = links.join(ranks.select("graph", F.col("word").alias("src"), "r"), ["graph", "src"])
        new = sent.groupBy("graph", F.col("dst").alias("word")).agg(((1 - DAMPING) / F.max("n") + DAMPING * F.sum(F.col("r") / F.col("degree"))).alias("r"), F.max("n").alias("n"))
        if (i + 1) % checkpoint_every == 0 and i + 1 < iterations:
            new = cut(new)
        if tol is not None:
            new = cut(new)
            moved = new.join(ranks.select("graph", "word", F.col("r").alias("old")), ["graph", "word"]).groupBy("graph").agg((F.sum(F.abs(F.col("r") - F.col("old"))) < F.max("n") * tol).alias("done"))
            if moved.where("not done").isEmpty():
                ranks = new
                break
        ranks = new
    return ranks.select("graph", "word", F.col("r").alias("pagerank"))


def normalize_by_degree(ranks: DataFrame, degrees: DataFrame) -> DataFrame:
    """Adds ``score`` = pagerank / degree; the raw value where there is no degree."""
    joined = ranks.join(degrees, ["graph", "word"], "left")
    return joined.withColumn("score", F.coalesce(F.try_divide("pagerank", "degree"), "pagerank")).select("graph", "word", "pagerank", "score")


#: Tags whose words are nodes of the word graph.
SYNTACTIC = {"JJ", "JJR", "JJS", "NN", "NNP", "NNS", "VB", "VBP", "NNPS", "FW"}


def neighbour_edges(texts: DataFrame, line: Column, window: int = 4) -> DataFrame:
    """(``graph``, ``src``, ``dst``): what stands at distance 1..window-1 in a ``line`` (array) of a ``graph``; a set, without self edges."""
    kept = texts.select("graph", line.alias("w"))
    pairs = [F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - k, F.lit(0))).alias("a"), F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias("b")) for k in range(1, window)]
    both = kept.where("size(w) > 1").select("graph", F.inline(F.concat(*pairs))).where("a <> b")
    return both.select("graph", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def node_scores(nodes: DataFrame, edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(``graph``, ``word``, ``score``): PageRank over degree; the raw value of a node without neighbours, whose mass goes to all nodes.

    The ranks of the connected nodes alone are those of the whole graph up to a factor: with n nodes, k of them alone and
    damping d, one that is alone has r = (1 - d) / (n - d k), and the others m r / (1 - d) times their rank among the m.
    """
    edges = cut(edges)
    ranks = pagerank(edges, 100, tol).join(degree(edges), ["graph", "word"])
    joined = cut(nodes.select("graph", "word").distinct().join(ranks, ["graph", "word"], "left"))
    sizes = joined.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"), F.count("degree").alias("_m"))
    alone = (1 - DAMPING) / (F.col("_n") - DAMPING * (F.col("_n") - F.col("_m")))
    own = F.col("_m") * alone / (1 - DAMPING) * F.col("pagerank") / F.col("degree")
    return joined.join(broadcast_if_small(sizes), "graph").select("graph", "word", F.when(F.col("degree").isNull(), alone).otherwise(own).alias("score"))


def keyword_tokens(df: DataFrame, graph: Column, text_id: Column, text: Column, tag: Callable[[str], str] = default_tag, window: int = 4, stop: list[str] = STOP_WORDS, ranked: bool = True) -> DataFrame:
    """(``graph``, ``text_id``, ``pos``, ``word``, ``tag``, ``score``): every token, marked by the word graph of its graph.

    Nodes are the words with a tag of SYNTACTIC that are no stop words, plurals in their singular. ``tag`` is k for a node, p
    for a plural of a node, e for others; a plural without a node is left out. ``score`` is the node's degree-normalised
    PageRank (1 unless ``ranked``), null where a run of keywords breaks. Texts are tagged once; no task holds a graph's tokens. Null texts give nothing.
    """
    none = F.lit("\x00")  # a null graph is a graph of its own
    tagged = df.select(F.coalesce(graph, none).alias("graph"), text_id.alias("text_id"), pos_tag(text, tag).alias("t"), text.isNotNull().alias("_ok")).where("_ok")
    common = F.array(*[F.lit(w) for w in stop])
    low = lambda x: F.lower(x["tok"])
    node = lambda x: F.when(x["pos"] == "NNS", lemma(low(x))).otherwise(low(x))
    chosen = F.filter("t", lambda x: x["pos"].isin(*sorted(SYNTACTIC)) & ~F.array_contains(common, low(x)))
    plural = F.array_distinct(F.transform(F.filter("t", lambda x: x["pos"] == "NNS"), low))
    tagged = cut(tagged.select("graph", "text_id", F.transform("t", low).alias("words"), F.transform(chosen, node).alias("line"), plural.alias("plural")))
    nodes = tagged.select("graph", F.explode("line").alias("word")).distinct()
    scores = node_scores(nodes, neighbour_edges(tagged, F.col("line"), window)) if ranked else nodes.withColumn("score", F.lit(1.0))
    tokens = tagged.select("graph", "text_id", "plural", F.posexplode("words").alias("pos", "word"))
    tokens = tokens.select("graph", "text_id", "pos", "word", F.array_contains("plural", F.col("word")).alias("_p"))
    tokens = tokens.withColumn("_node", F.when(F.col("_p"), lemma(F.col("word"))).otherwise(F.col("word")))
    joined = tokens.join(scores.withColumnRenamed("word", "_node"), ["graph", "_node"], "left").where("not _p or score is not null")
    kind = F.when(F.col("score").isNull(), "e").when(F.col("_p"), "p").otherwise("k")
    score = F.when(F.col("_p") | ~F.array_contains(common, F.col("word")), F.col("score"))
    return joined.select(F.when(F.col("graph") != none, F.col("graph")).alias("graph"), "text_id", F.col("pos").cast("bigint").alias("pos"), "word", kind.alias("tag"), score.alias("score"))


def keyword_runs(tokens: DataFrame) -> DataFrame:
    """Maximal runs of keywords: (``text_id``, ``phrase``, ``score``, ``best``, ``start``): sum and maximum of the scores.

    ``tokens`` is (``text_id``, ``pos``, ``word``, ``score``); a null score breaks a run, and so does the end of the text
    without being reached by a break: a run that ends the text is not given out, as it is never closed.
    """
    w = Window.partitionBy("text_id").orderBy("pos")
    t = tokens.withColumns({"_b": F.col("score").isNull().cast("int"), "_last": F.max("pos").over(Window.partitionBy("text_id"))})
    t = t.withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_b = 0")
    runs = t.groupBy("text_id", "_i").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.sum("score").alias("score"), F.max("score").alias("best"), F.min("pos").alias("start"), F.max("pos").alias("_e"), F.max("_last").alias("_last"),
    )
    return runs.where("_e < _last").select("text_id", "phrase", "score", "best", "start")


def phrase_scores(phrases: DataFrame, nodes: DataFrame, normalize: bool = True) -> DataFrame:
    """(``graph``, ``phrase``, ``score_sum``, ``score_max``) from word scores; missing words count 0.

    With ``normalize``, phrases of more than three words are divided by their length.
    """
    each = phrases.select("graph", "phrase", F.explode(F.split("phrase", " ")).alias("word"))
    n = nodes.select("graph", "word", "score")
    s = each.join(n, ["graph", "word"], "left").groupBy("graph", "phrase").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.max(F.coalesce("score", F.lit(0.0))).alias("m"), F.count(F.lit(1)).alias("k"))
    over = F.when((F.col("k") > 3) & F.lit(normalize), F.col("k")).otherwise(1)
    return s.select("graph", "phrase", (F.col("s") / over).alias("score_sum"), (F.col("m") / over).alias("score_max"))


def run_scores(runs: DataFrame) -> DataFrame:
    """(``graph``, ``phrase``, ``score_sum``, ``score_max``) from the scores of the runs; of a phrase's runs the best counts.

    Phrases of more than three words are divided by their length.
    """
    s = runs.groupBy("graph", "phrase").agg(F.max("score").alias("s"), F.max("best").alias("m"))
    k = F.size(F.split("phrase", " "))
    over = F.when(k > 3, k).otherwise(1)
    return s.select("graph", "phrase", (F.col("s") / over).alias("score_sum"), (F.col("m") / over).alias("score_max"))


def clean_phrases(phrases: DataFrame) -> DataFrame:
    """Without repeated words, one-letter words, and phrases that another phrase of the graph contains as whole words.

    A phrase is compared only with phrases that share its first word: an equi-join, not a scan of all pairs.
    """
    tokens = F.split("phrase", " ")
    p = phrases.where((F.size(F.array_distinct(tokens)) == F.size(tokens)) & ~F.exists(tokens, lambda t: F.length(t) < 2)).distinct()
    keyed = p.withColumn("_w", F.get(F.split("phrase", " "), F.lit(0)))
    holders = p.select("graph", F.col("phrase").alias("_o"), F.explode(F.split("phrase", " ")).alias("_w"))
    contained = (F.concat(F.lit(" "), F.col("_o"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))) & (F.col("_o") != F.col("phrase"))
    inside = keyed.join(holders, ["graph", "_w"]).where(contained).select("graph", "phrase").distinct()
    return p.join(inside, ["graph", "phrase"], "left_anti")


def top_phrases(scored: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best phrases per graph by (score desc, phrase desc), with ``rank``."""
    w = Window.partitionBy("graph").orderBy(F.desc("score"), F.desc("phrase"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def _shortest(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    nodes = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {w: i for i, w in enumerate(nodes)}
    near: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        near[at[a]].append(at[b])
        near[at[b]].append(at[a])
    k = len(nodes)
    between, close = np.zeros(k), np.zeros(k)
    for s in range(k):  # Brandes' accumulation
        dist, paths, order, before = [-1] * k, np.zeros(k), [], [[] for _ in range(k)]
        dist[s], paths[s], queue = 0, 1.0, [s]
        for v in queue:
            order.append(v)
            for w in near[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        total = sum(d for d in dist if d > 0)
        reach = len(order) - 1
        close[s] = (reach / total) * (reach / (k - 1)) if total else 0.0
        part = np.zeros(k)
        for w in reversed(order):
            for v in before[w]:
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                between[w] += part[w]
    scale = (k - 1) * (k - 2)
    return nodes, between / scale if scale else between, close


def centrality(edges: DataFrame) -> DataFrame:
    """(``graph``, ``word``, ``betweenness``, ``closeness``) by shortest paths, normalised; one task per graph (a session)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, between, close = _shortest(pdf)
        return pd.DataFrame({"graph": key[0], "word": nodes, "betweenness": between, "closeness": close})

    return edges.groupBy("graph").applyInPandas(run, "graph string, word string, betweenness double, closeness double")
