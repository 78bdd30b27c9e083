"""Relevance, normalisation, thresholds and selection of phrases."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from colloquy.functions.vectors import cosine


def segment_quality(phrases: DataFrame, by: list[str], score: Column) -> DataFrame:
    """(``by``..., ``quality_mean``, ``quality_median``, ``phrases``) of the scores; nulls and NaN do not count."""
    s = F.when(~F.isnan(score), score)
    return phrases.groupBy(*by).agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("quality_mean"), F.coalesce(F.percentile(s, F.lit(0.5)), F.lit(0.0)).alias("quality_median"), F.count(s).alias("phrases"))


def norm_boosted(phrases: DataFrame, quality: DataFrame, session: str, segment: str, q: str, sentences: Column) -> DataFrame:
    """Adds ``norm_boosted`` = boosted * own quality * sentences / the session's summed quality; null where that is 0."""
    total = quality.groupBy(session).agg(F.sum(q).alias("_total"))
    joined = phrases.join(quality.select(session, segment, F.col(q).alias("_q")), [session, segment]).join(total, session)
    return joined.withColumn("norm_boosted", F.try_divide(F.col("boosted") * F.col("_q") * sentences, "_total")).drop("_q", "_total")


def dynamic_top_n(total: Column, top_n: Column) -> Column:
    """5 and 10 stay; any other wish is raised to a third of ``total``, and at most 10."""
    return F.when(top_n.isin(5, 10), top_n).otherwise(F.least(F.greatest(top_n, F.floor(total / 3)), F.lit(10)))


def located(phrases: DataFrame, segments: DataFrame) -> DataFrame:
    """``phrases`` (``segment``, ``kind``, ``phrase``, ...) with ``loc``, ``offset`` and ``removed``: where in its segment's text a phrase stands.

    ``segments`` is (``segment``, ``session``, ``text``, ``seconds``), one row each. ``offset`` is the segment's time after the first of its
    session, ``loc`` the position in the text plus that. An entity is also looked for in lower case. Phrases that do not
    occur, entities with a ``*`` and keyphrases with a ``*`` and a full stop are ``removed`` and have no ``loc``. Phrases
    of unknown segments are left out.
    """
    first = segments.groupBy("session").agg(F.min("seconds").alias("_first"))
    s = segments.join(first, "session").select("segment", "session", "text", (F.col("seconds") - F.col("_first")).alias("offset"))
    exact, low = (F.position(p, F.col("text")) for p in (F.col("phrase"), F.lower("phrase")))
    entity, star = F.col("kind") == "entity", F.col("phrase").contains("*")
    at = F.when(exact > 0, exact).when(entity, low).otherwise(F.lit(0))
    ok = (at > 0) & F.when(entity, ~star).otherwise(~(star & F.col("phrase").contains(".")))
    out = phrases.join(s, "segment").withColumn("removed", ~F.coalesce(ok, F.lit(False)))
    return out.withColumn("loc", F.when(~F.col("removed"), at - 1 + F.col("offset")).cast("double")).drop("text")


def local_relevance(phrases: DataFrame, vectors: DataFrame, segment_vector: str, phrase_vector: str, norm_limit: int = 4) -> DataFrame:
    """Adds ``segsim`` and ``boosted``: cosine of a phrase's and its segment's vector over its length, and that plus ``pagerank``.

    ``vectors`` is (``key``, ``vec``), one row each; the named columns hold keys. A vector that is missing or zero gives 0. A phrase of more than
    ``norm_limit`` words is divided by its length beyond ``norm_limit`` - 1, another one by its length.
    """
    v = lambda name, key: vectors.select(F.col("key").alias(key), F.col("vec").alias(name))
    both = phrases.join(v("_s", segment_vector), segment_vector, "left").join(v("_p", phrase_vector), phrase_vector, "left")
    words = F.size(F.filter(F.split("phrase", r"\s+"), lambda w: w != ""))
    over = F.when(words > norm_limit, words - (norm_limit - 1)).otherwise(F.greatest(words, F.lit(1)))
    sim = F.coalesce(cosine(F.col("_s"), F.col("_p")), F.lit(0.0)) / over
    return both.withColumn("segsim", sim).withColumn("boosted", F.coalesce("pagerank", F.lit(0.0)) + F.col("segsim")).drop("_s", "_p")


def segment_qualities(phrases: DataFrame, form: str = "descriptive") -> DataFrame:
    """(``session``, ``segment``, ``kind``, ``mean``, ``median``) of ``boosted``: of the entities, and of the keyphrases of type ``form``.

    A segment that has phrases but none of a kind has 0 for it.
    """
    own = (F.col("kind") == "entity") | (F.col("type") == form)
    s = F.when(own & ~F.isnan("boosted"), F.col("boosted"))
    q = phrases.groupBy("session", "segment", "kind").agg(F.avg(s).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"))
    return q.withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "median": F.coalesce("median", F.lit(0.0))})


def normalised_relevance(phrases: DataFrame, qualities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Adds ``norm_boosted`` and ``quality``: ``boosted`` times the segment's quality and number of sentences over the session's summed quality.

    Quality is the median for keyphrases and the mean for entities; ``sentences`` is (``segment``, ``sentences``). Null where the sum is 0.
    """
    q = qualities.withColumn("_q", F.when(F.col("kind") == "entity", F.col("mean")).otherwise(F.col("median")))
    total = q.groupBy("session", "kind").agg(F.sum("_q").alias("_total"))
    joined = phrases.join(q.select("segment", "kind", "_q", F.col("mean").alias("quality")), ["segment", "kind"]).join(total, ["session", "kind"]).join(sentences, "segment")
    return joined.withColumn("norm_boosted", F.try_divide(F.col("boosted") * F.col("_q") * F.col("sentences"), "_total")).drop("_q", "_total", "sentences")


def threshold_phrases(phrases: DataFrame, score: Column, quality: Column) -> DataFrame:
    """``removed`` by score: keyphrases not above the ``quality``; entities of preference over 2 but not 5 likewise, if the segment has two or more.

    Other entities with a positive score that are not ``related`` to a keyphrase come back. Needs ``segment``, ``kind``, ``preference``,
    ``related`` and ``removed``; a null or NaN score leaves ``removed`` as it is.
    """
    n = phrases.where("kind = 'entity'").groupBy("segment").agg(F.count(F.lit(1)).alias("_n"))
    s = F.when(~F.isnan(score), score)
    weak = (F.col("preference") > 2) & (F.col("preference") != 5)
    low = F.coalesce(s <= quality, F.lit(False))
    entity = F.when(weak, F.col("removed") | ((F.col("_n") >= 2) & low)).when((s > 0) & ~F.coalesce("related", F.lit(False)), F.lit(False)).otherwise(F.col("removed"))
    out = phrases.join(n, "segment", "left")
    return out.withColumn("removed", F.coalesce(F.when(F.col("kind") == "entity", entity).otherwise(F.col("removed") | low), F.lit(False))).drop("_n")


def related_entities(phrases: DataFrame) -> DataFrame:
    """``phrases`` with ``related``: an entity of one word that occurs in a keyphrase of its segment, as it is or in lower case.

    One-word entities inside a longer entity of the segment are left out; longer ones that repeat a word are ``removed``.
    Needs ``segment``, ``kind``, ``phrase``, ``row_id``, ``removed``.
    """
    words = F.filter(F.split("phrase", r"\s+"), lambda w: w != "")
    p = phrases.withColumns({"_k": F.size(words), "_twice": F.size(F.array_distinct(words)) < F.size(words)})
    single = p.where("kind = 'entity' and _k = 1").select("segment", "row_id", F.col("phrase").alias("_e"))
    held = p.where("kind = 'entity' and _k > 1").select("segment", F.col("phrase").alias("_o"))
    inside = single.join(held, "segment").where(F.position(F.col("_e"), F.col("_o")) > 0).select("row_id").distinct()
    keys = p.where("kind = 'keyphrase'").select("segment", F.col("phrase").alias("_o"))
    near = single.join(keys, "segment").where((F.position(F.col("_e"), F.col("_o")) > 0) | (F.position(F.lower("_e"), F.col("_o")) > 0)).select("row_id", F.lit(True).alias("_r")).distinct()
    entities = p.where("kind = 'entity'").join(inside, "row_id", "left_anti").join(near, "row_id", "left")
    entities = entities.withColumns({"related": F.coalesce("_r", F.lit(False)), "removed": F.col("removed") | ((F.col("_k") > 1) & F.col("_twice"))}).drop("_r")
    return p.where("kind = 'keyphrase'").withColumn("related", F.lit(False)).unionByName(entities).drop("_k", "_twice")


def quota_slice(phrases: DataFrame, session: str, limit: int = 10, entities: int = 5) -> DataFrame:
    """At most ``entities`` entities; keyphrases fill up to ``limit``. Needs ``kind``, ``score``, ``phrase``, ``removed``.

    Entities ``related`` to a keyphrase (where that column is there) do not count. Ties by phrase, then ``row_id`` where there is one.
    """
    kept = phrases.where("not removed")
    if "related" in phrases.columns:
        kept = kept.where("kind <> 'entity' or not related")
    w = Window.partitionBy(session, "kind").orderBy(F.desc_nulls_last("score"), "phrase", *[c for c in ("row_id",) if c in phrases.columns])
    ranked = kept.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)
    n = F.sum(F.when(F.col("kind") == "entity", 1).otherwise(0)).over(Window.partitionBy(session))  # at most 2 * limit rows a session
    cutoff = F.when(F.col("kind") == "entity", entities).otherwise(limit - F.least(F.lit(entities), n))
    return ranked.withColumn("_c", cutoff).where("rank <= _c").drop("_c")


def merged_phrases(sliced: DataFrame) -> DataFrame:
    """(``session``, ``phrase``, ``loc``, ``rank``): a session's phrases in the order of ``loc``; of one name keyphrases win over entities, later ranks over earlier."""
    one = last_wins(sliced.withColumn("_k", (F.col("kind") == "keyphrase").cast("int")), ["session", "phrase"], "loc", ["_k", "rank", "row_id"])
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.asc_nulls_last("loc"), "phrase")).cast("bigint"))


def last_wins(phrases: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """One row per ``by`` with the ``value`` that is last by ``order``."""
    return phrases.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


#: Texts of a session that one task reads, and its phrases that are looked up there; longer sessions go in shares.
TEXTS, PHRASES = 50_000, 50_000

#: Bytes of the stretch by which a phrase is looked up, long enough to reach from one word into the next.
STRETCH = 6


def _stretches(text: bytes, size: int) -> set[bytes]:
    return {text[i : i + size] for i in range(len(text) - size + 1)}


def _by_rarest_stretch(phrases: list[bytes]) -> dict[int, dict[bytes, list[bytes]]]:
    """By size and stretch the phrases, each under the one of its stretches that the fewest have; one below ``STRETCH`` bytes under itself."""
    counts = Counter(t for p in phrases for t in _stretches(p, STRETCH))
    out: dict[int, dict[bytes, list[bytes]]] = {}
    for p in phrases:
        t = min(_stretches(p, STRETCH), key=counts.__getitem__, default=p)
        out.setdefault(len(t), {}).setdefault(t, []).append(p)
    return out


def _last_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every group the phrases with the number and offset of the first text that holds them.

    Columns: group (3), is_text, value, segment_no, offset. A group's phrases come first, then its texts, last one first.
    A phrase waits under its stretch until a text holds it.
    """
    group, phrases, waiting = None, [], None
    for batch in batches:
        at, found = [], []
        session, share, part, is_text, value = (c.to_pylist() for c in batch.columns[:5])
        for i, key in enumerate(zip(session, share, part, strict=True)):
            if key != group:
                group, phrases, waiting = key, [], None
            if not is_text[i]:
                phrases.append(value[i])
                continue
            if waiting is None:
                phrases, waiting = [], _by_rarest_stretch(phrases)
            for size, by in waiting.items():
                for t in by.keys() & _stretches(value[i], size) if by else ():
                    held = [p for p in by[t] if p in value[i]]
                    if held:
                        at += [i] * len(held)
                        found += held
                        by[t] = [p for p in by[t] if p not in value[i]]
                        if not by[t]:
                            del by[t]
        if at:
            hits = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([hits.column(0), pa.array(found, pa.binary()), hits.column(5), hits.column(6)], ["session", "phrase", "segment_no", "offset"])


def phrase_offsets(phrases: DataFrame, segments: DataFrame, session: str) -> DataFrame:
    """(``session``, ``phrase``, ``offset``): offset of the last segment of the session whose text holds the phrase.

    ``segments`` is (``session``, ``segment_no``, ``offset``, ``text``), one row per ``segment_no``. Texts and distinct phrases travel to
    their session once, as they are; there the texts pass by, last one first, and a phrase that was found is done. Sessions of
    more than ``TEXTS`` texts or ``PHRASES`` phrases go in shares, every share of texts meeting every share of phrases.
    Empty phrases are in every text.
    """
    p = phrases.select(session, "phrase").where(F.col(session).isNotNull() & F.col("phrase").isNotNull()).distinct()
    s = segments.select(session, "segment_no", "offset", "text").where(F.col(session).isNotNull() & F.col("text").isNotNull())

    def shares(rows: DataFrame, most: int, name: str) -> DataFrame:  # at most one row in ``most``
        many = rows.groupBy(session).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most)
        return F.broadcast(many.select(session, F.ceil(F.col("_c") / most).cast("int").alias(name)))

    def dealt(rows: DataFrame) -> DataFrame:
        both = rows.join(shares(s, TEXTS, "_s"), session, "left").join(shares(p, PHRASES, "_p"), session, "left")
        return both.withColumns({n: F.coalesce(n, F.lit(1)) for n in ("_s", "_p")})

    one = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = [F.lit(None).cast(s.schema[n].dataType).alias(n) for n in ("segment_no", "offset")]
    asked = dealt(p).select(session, each("_s").alias("_share"), one("phrase", F.col("_p")).alias("_part"), F.lit(False).alias("_text"), F.col("phrase").cast("binary").alias("_v"), *none)
    told = dealt(s).select(session, one("segment_no", F.col("_s")).alias("_share"), each("_p").alias("_part"), F.lit(True).alias("_text"), F.col("text").cast("binary").alias("_v"), "segment_no", "offset")
    key = [session, "_share", "_part"]
    ordered = asked.unionByName(told).repartition(*key).sortWithinPartitions(*key, "_text", F.desc("segment_no"))
    types = [StructField(n, t) for n, t in (("session", s.schema[session].dataType), ("phrase", BinaryType()), ("segment_no", s.schema["segment_no"].dataType), ("offset", s.schema["offset"].dataType))]
    hit = ordered.mapInArrow(_last_texts, StructType(types)).select(F.col("session").alias(session), F.col("phrase").cast("string").alias("phrase"), "segment_no", "offset")
    return hit.groupBy(session, "phrase").agg(F.max_by("offset", F.struct("segment_no")).alias("offset"))


def vocabulary_filter(phrases: DataFrame, vocabulary: DataFrame, key: str, by: list[str] = (), words: Column | None = None) -> DataFrame:
    """Phrases all of whose lower-case words are in ``vocabulary`` (``word``, and ``by``: a mind, say).

    ``words`` tells which of a phrase's words count (an array), by default all of them; without any the phrase stays.
    """
    own = F.array_distinct(F.split(F.lower("phrase"), " ")) if words is None else words
    each = phrases.select(key, *by, F.explode(own).alias("word"))
    missing = each.join(vocabulary.select(*by, "word").distinct(), [*by, "word"], "left_anti").select(key).distinct()
    return phrases.join(missing, key, "left_anti")


def partial_ratio(a: str, b: str) -> float:
    """0..100: the shorter text against its best stretch of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    m = difflib.SequenceMatcher(None, short, long, autojunk=False)
    starts = {max(0, j - i) for i, j, n in m.get_matching_blocks() if n}
    return max((100 * difflib.SequenceMatcher(None, short, long[s : s + len(short)], autojunk=False).ratio() for s in starts), default=0.0)


def partial_token_set_ratio(a: str, b: str) -> float:
    """0..100: :func:`partial_ratio` of what the two have in common with each side's own words; 100 if they share a word."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if x & y:
        return 100.0
    return partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def best_matches(query: Column, phrases: Column, limit: int = 20, least: float = 30.0) -> Column:
    """ARRAY<STRUCT<phrase, score>>: the ``limit`` phrases most like ``query`` with at least ``least``, best first, ties by phrase.

    ``phrases`` is a short list. Null texts and arrays give none.
    """

    def run(queries: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for q, items in zip(queries, lists, strict=True):
            scored = [(-partial_token_set_ratio(q, p), p) for p in dict.fromkeys(items if items is not None else []) if p] if q else []
            out.append([{"phrase": p, "score": -s} for s, p in sorted(scored)[:limit] if -s >= least])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<phrase:string,score:double>>")(query, phrases)


def token_set_ratio(a: str, b: str) -> float:
    """0..100: best match of the shared words against each side with its own words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    base, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    one, two = f"{base} {left}".strip(), f"{base} {right}".strip()
    ratio = lambda p, q: 100 * difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() if p or q else 0.0
    return max(ratio(base, one), ratio(base, two), ratio(one, two)) if base else ratio(one, two)


def fuzzy_dedupe(df: DataFrame, key: str, phrases: str, threshold: float = 90.0) -> DataFrame:
    """(``key``, ``phrases``): of phrases alike by :func:`token_set_ratio` the longest is kept, in first order.

    ``phrases`` is a short array (a final top-n list). Null arrays come back empty.
    """

    def dedupe(lists: pd.Series) -> pd.Series:
        out = []
        for items in lists:
            kept: list[str] = []
            for p in items if items is not None else []:
                alike = [i for i, k in enumerate(kept) if token_set_ratio(p, k) >= threshold]
                if not alike:
                    kept.append(p)
                elif len(p) > len(kept[alike[0]]):
                    kept[alike[0]] = p
            out.append(kept)
        return pd.Series(out)

    return df.select(key, F.pandas_udf(dedupe, "array<string>")(F.col(phrases)).alias(phrases))
