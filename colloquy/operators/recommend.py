"""Similar-user search by locality-sensitive hashing, cut-offs and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed
from colloquy.functions.tagging import all_tags_allowed
from colloquy.operators.ranking import best_matches, fuzzy_dedupe


def projections(tables: int, bits: int, dim: int, seed: int = 7) -> np.ndarray:
    """Seeded Gaussian projections, (tables, bits, dim)."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def hashed_projections(tables: int, bits: int, dim: int) -> np.ndarray:
    """Projections with entries in [-1, 1) by integer arithmetic on their number, (tables, bits, dim): the same in any language.

    Entry ``x`` (from 1) is the middle of the square of a multiplicative hash of ``x``.
    """
    x = np.arange(1, tables * bits * dim + 1, dtype=np.int64)
    h = x * 2654435761 % (1 << 31)
    return ((h * h // 65536 + x * 40503) % 65536 / 32768 - 1).reshape(tables, bits, dim)


def lsh_buckets(vectors: DataFrame, key: str, planes: np.ndarray) -> DataFrame:
    """(``key``, ``buckets`` ARRAY<BIGINT>): per table the integer whose bit i is 1 where projection i has a positive dot product."""
    tables, bits, dim = planes.shape
    flat, powers = planes.reshape(tables * bits, dim), 1 << np.arange(bits)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            out: list[np.ndarray] = []
            for at in range(0, len(v), 256):  # a block's signs are rows x tables x bits
                signs = (np.stack([np.asarray(x, float) for x in v.iloc[at : at + 256]]) @ flat.T > 0).reshape(-1, tables, bits)
                out.extend(signs @ powers)
            yield pd.Series(out, dtype=object)

    return vectors.where("vec is not null").select(key, F.pandas_udf(run, "array<long>")("vec").alias("buckets"))


def lsh_matches(queries: DataFrame, index: DataFrame, label: str) -> DataFrame:
    """(``query``, ``label``, ``matches``): equal buckets over all tables, with multiplicity; an equi-join on (table, bucket)."""
    q = queries.select("query", F.posexplode("buckets").alias("table", "bucket")).groupBy("query", "table", "bucket").agg(F.count(F.lit(1)).alias("_q"))
    i = index.select(label, F.posexplode("buckets").alias("table", "bucket")).groupBy(label, "table", "bucket").agg(F.count(F.lit(1)).alias("_i"))
    return q.join(i, ["table", "bucket"]).groupBy("query", label).agg(F.sum(F.col("_q") * F.col("_i")).alias("matches"))


def user_scores(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """(``user``, ``v1``, ``v2``): matches per vector; and matches over all matches times (mean + (max - mean) * n) of the sizes.

    ``sizes`` (``user``, ``n``) covers every indexed user; ``matches`` only those hit.
    """
    s = sizes.agg(F.avg("n").alias("mean"), F.max("n").alias("most"))
    total = matches.agg(F.sum("matches").alias("total"))
    j = matches.join(sizes, "user").join(F.broadcast(s)).join(F.broadcast(total))
    v2 = F.try_divide(F.col("matches"), F.col("total") * (F.col("mean") + (F.col("most") - F.col("mean")) * F.col("n")))
    return j.select("user", (F.col("matches") / F.col("n")).alias("v1"), v2.alias("v2"))


def adaptive_hash_size(n: int, default: int = 16) -> int:
    """0: the default; else the next power of two of ceil(log2 n)."""
    if n <= 0:
        return default
    need = max(1, int(np.ceil(np.log2(n)))) if n > 1 else 1
    return 1 << (need - 1).bit_length()


def normalise_scores(df: DataFrame, score: str) -> DataFrame:
    """Adds ``norm`` = (s - mean) / (max - min); null where all scores are equal. One small aggregate, broadcast."""
    a = df.agg(F.avg(score).alias("_m"), (F.max(score) - F.min(score)).alias("_r"))
    return df.join(F.broadcast(a)).withColumn("norm", F.try_divide(F.col(score) - F.col("_m"), "_r")).drop("_m", "_r")


def percentile_cutoff(df: DataFrame, score: str, q: float = 0.75) -> DataFrame:
    """Rows with a positive score of at least the ``q`` quantile."""
    a = df.agg(F.percentile(score, F.lit(q)).alias("_c"))
    return df.join(F.broadcast(a)).where((F.col(score) >= F.col("_c")) & (F.col(score) > 0)).drop("_c")


def relevancy_gate(df: DataFrame, score: str = "norm", least: float = 0.55) -> DataFrame:
    """All rows if the best score reaches ``least``, else none."""
    a = df.agg(F.max(score).alias("_b"))
    return df.join(F.broadcast(a)).where(F.col("_b") >= least).drop("_b")


def rerank(user_items: DataFrame, similarity: Column, top: int = 10) -> DataFrame:
    """(``user``, ``phrase_score``, ``phrases``): mean of a user's ``top`` best similarities and the items, best first."""
    w = Window.partitionBy("user").orderBy(F.desc("_s"), "item")
    r = user_items.withColumn("_s", similarity).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda x: x["item"])
    return r.groupBy("user").agg(F.avg("_s").alias("phrase_score"), listed.alias("phrases"))


def rerank_all(queries: DataFrame, user_items: DataFrame, top: int = 10, block: int = 1024) -> DataFrame:
    """(``query``, ``user``, ``phrase_score``, ``phrases``): ``rerank`` by cosine for every query (``query``, ``vec``) against all items.

    Blocks of queries meet blocks of (``user``, ``item``, ``vec``); a block of items gives out at most ``top`` rows per query and
    user, so that only candidates are shuffled. A zero vector has no similarity and is left out.
    """
    q = queries.where("vec is not null").groupBy(F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() // block)))).alias("_b"))
    q = q.agg(F.collect_list(F.struct("query", "vec")).alias("_q")).select("_q")
    i = user_items.where("vec is not null").groupBy("user", F.expr(f"item div {block}").alias("_b")).agg(F.collect_list(F.struct("item", "vec")).alias("_i")).select("user", "_i")

    def unit(rows: list) -> np.ndarray:
        v = np.array([r["vec"] for r in rows], dtype=float)
        with np.errstate(invalid="ignore", divide="ignore"):
            return v / np.linalg.norm(v, axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for user, qs, items in zip(pdf["user"], pdf["_q"], pdf["_i"], strict=True):
                items = sorted(items, key=lambda r: r["item"])
                s, ids = unit(qs) @ unit(items).T, np.array([r["item"] for r in items])
                best = np.argsort(-s, axis=1, kind="stable")[:, :top]  # NaN comes last, ties by item
                rows = pd.DataFrame({"query": np.repeat([r["query"] for r in qs], best.shape[1]), "user": user, "item": ids[best].ravel(), "_s": np.take_along_axis(s, best, 1).ravel()})
                yield rows.dropna(subset="_s")

    pairs = i.crossJoin(q).mapInPandas(run, f"query long, user {user_items.schema['user'].dataType.simpleString()}, item long, _s double")
    w = Window.partitionBy("query", "user").orderBy(F.desc("_s"), "item")
    r = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda x: x["item"])
    return r.groupBy("query", "user").agg(F.avg("_s").alias("phrase_score"), listed.alias("phrases"))


def high_deviation(df: DataFrame, score: str, limit: float) -> DataFrame:
    """(``deviation``, ``high``): lead of the best score over the second in standard deviations."""
    top = df.orderBy(F.desc(score)).limit(2).agg(F.max(score).alias("a"), F.min(score).alias("b")).join(F.broadcast(df.agg(F.stddev_pop(score).alias("sd"))))
    d = F.try_divide(F.col("a") - F.col("b"), "sd")
    return top.select(d.alias("deviation"), (d >= limit).alias("high"))


def user_profiles(rows: DataFrame, user: str, columns: list[str]) -> DataFrame:
    """(``user``, sorted distinct values of each column); nulls do not count."""
    return rows.groupBy(user).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def profile_rows(rows: DataFrame, user: str, columns: dict[str, Column], blacklist: DataFrame | None = None) -> DataFrame:
    """(``user``, ``kind``, ``value``): each distinct value of ``columns`` (name -> array of texts) of each user, one row each.

    Users in ``blacklist`` (``user``) are left out; nulls do not count. A profile is rows, not a list, however long it is.
    """
    tagged = lambda k, c: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    each = [tagged(k, c) for k, c in columns.items()]
    out = rows.where(F.col(user).isNotNull()).select(F.col(user).alias("user"), F.inline(F.concat(*each))).where("value is not null").distinct()
    return out if blacklist is None else out.join(blacklist.select("user").distinct(), "user", "left_anti")


def participants(attendees: Column) -> Column:
    """ARRAY<STRING>: the attendees' dashed ids from the reply's JSON; null or another text gives none."""
    ids = F.from_json(attendees, "struct<attendees:array<struct<sourceUserId:string>>>")["attendees"]["sourceUserId"]
    return F.coalesce(F.array_compact(F.transform(ids, dashed)), F.array().cast("array<string>"))


def confidence(similar: DataFrame, hashed: DataFrame, by: str) -> DataFrame:
    """``similar`` (``by``, ``similarity``) with ``hash_score`` and ``confidence``, their product; a missing hash score is the least of all.

    ``hashed`` is (``by``, ``hash_score``).
    """
    least = hashed.agg(F.min("hash_score").alias("_least"))
    joined = similar.join(hashed.select(by, "hash_score"), by, "left").join(F.broadcast(least))  # one row
    return joined.withColumn("hash_score", F.coalesce("hash_score", "_least")).withColumn("confidence", F.col("similarity") * F.col("hash_score")).drop("_least")


def suggested_users(users: DataFrame, score: str, speakers: DataFrame, q: float = 0.75) -> DataFrame:
    """``users`` (``user``, ``score``) who are not among the ``speakers`` (``user``), with ``suggested``: a score of at least the ``q`` quantile of these."""
    left = users.join(speakers.select("user").distinct(), "user", "left_anti")
    cut_at = left.agg(F.percentile(score, F.lit(q)).alias("_c"))
    return left.join(F.broadcast(cut_at)).withColumn("suggested", F.coalesce(F.col(score) >= F.col("_c"), F.lit(False))).drop("_c")  # one row


def related_words(top_words: DataFrame, query_text: Column, tags: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(``user``, ``words``): of each user's ``phrases`` (a top-n list) those most like ``query_text``, with their likeness.

    With ``tags`` only phrases all of whose tokens have one of them are compared, alike ones once.
    """
    rows = top_words.select("user", F.col("phrases").alias("p"), query_text.alias("q"))
    if tags is not None:
        kept = rows.withColumn("p", all_tags_allowed(F.col("p"), tags))
        rows = fuzzy_dedupe(kept, "user", "p").join(kept.select("user", "q"), "user")
    return rows.select("user", best_matches(F.col("q"), F.col("p"), limit).alias("words"))


def explanation(top_words: DataFrame, users: DataFrame, query_text: Column, tags: list[str] | None = None) -> DataFrame:
    """(``user``, ``confidence``, ``words``, ``rank``): ranked users with the phrases that explain them."""
    words = related_words(top_words, query_text, tags)
    ranked = users.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "user")).cast("bigint"))
    return ranked.join(words, "user", "left").select("user", "confidence", "words", "rank")


def watchers(users: DataFrame, speakers: DataFrame, top_words: DataFrame, query_text: Column, tags: list[str] | None = None, least: float | None = None, n_words: int = 6) -> DataFrame:
    """(``user``, ``confidence``, ``rank``, ``suggested``, ``words``): whom to recommend, end to end.

    ``users`` is (``user``, ``similarity``, ``hash_score``); with ``least`` nobody is recommended unless the best normalised hash score reaches it.
    ``speakers`` are left out; ``words`` are the ``n_words`` best explaining phrases.
    """
    if least is not None:
        users = relevancy_gate(normalise_scores(users, "hash_score"), least=least).drop("norm")
    scored = users.withColumn("confidence", F.col("similarity") * F.col("hash_score"))
    found = suggested_users(explanation(top_words, scored, query_text, tags), "confidence", speakers)
    return found.select("user", "confidence", "rank", "suggested", F.slice(F.transform("words", lambda w: w["phrase"]), 1, n_words).alias("words"))
