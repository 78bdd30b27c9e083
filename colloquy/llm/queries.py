"""Queries over the operators of this folder, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.copies import phrase_collisions, phrase_copies
from colloquy.llm.mixing import mix_sources, share_report
from colloquy.llm.packing import fill_report, pack_documents
from colloquy.llm.pairs import segment_pairs
from colloquy.llm.subjects import assign_subjects, composition, held_out
from colloquy.llm.tokens import n_tokens
from colloquy.llm.topn import instance_keyphrases
from colloquy.llm.turns import boundary_figures, speaker_turns
from colloquy.runtime import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return phrase_copies(*(table(spark, d, t) for t in ("keyphrases", "entities", "phrase_records")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return instance_keyphrases(table(spark, d, "requests"), table(spark, d, "keyphrases"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return segment_pairs(table(spark, d, "segment_requests")).select("item_a", "item_b", "n_together")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(table(spark, d, "spoken_segments"), table(spark, d, "speakers"))


def p6_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return boundary_figures(table(spark, d, "spoken_segments"), table(spark, d, "speakers"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tokens, counted once."""
    return cut(table(spark, d, "documents").select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens")))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_packing(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_sizes(spark, d), table(spark, d, "source_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p8_mixture(spark, d), table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


def p9_held_out(spark: SparkSession, d: str) -> DataFrame:
    return held_out(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(p9_found(spark, d), _sizes(spark, d))


# Invariants of whole results: what has no SQL of its own is checked by what must hold of it.


def p2_collisions(spark: SparkSession, d: str) -> DataFrame:
    """(``tab``, ``collisions``): 128-bit hashes that different canonical texts share."""
    return phrase_collisions(*(table(spark, d, t) for t in ("keyphrases", "entities", "phrase_records")))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """(``repeated``, ``same_speaker``, ``strangers``): turn numbers given twice, neighbouring turns of one speaker, speakers not of the roster."""
    t = cut(p6_found(spark, d))
    w = Window.partitionBy("transcript_id", F.floor(F.col("turn_no") / 10_000)).orderBy("turn_no")
    near = t.withColumns({"n": F.lag("turn_no").over(w), "s": F.lag("spoken_by").over(w)})
    roster = table(spark, d, "speakers").select(F.col("transcriptId").alias("transcript_id"), F.col("spokenBy").alias("spoken_by")).distinct()
    found = near.join(roster.withColumn("known", F.lit(True)), ["transcript_id", "spoken_by"], "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return found.agg(count(F.col("n") == F.col("turn_no")).alias("repeated"), count((F.col("n") + 1 == F.col("turn_no")) & (F.col("s") == F.col("spoken_by"))).alias("same_speaker"), count(F.col("known").isNull()).alias("strangers"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """(``pack_name``, ``documents``, ``overfull``, ``split``, ``uncovered``): containers over capacity, documents split without need, documents whose pieces are not all their tokens."""
    sizes, packs = _sizes(spark, d), table(spark, d, "pack_sizes")
    packed = cut(pack_documents(sizes, packs))
    over = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("c")).where("t > c").groupBy("pack_name").agg(F.count(F.lit(1)).alias("overfull"))
    docs = packed.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.max("capacity_tokens").alias("c"), F.countDistinct("token_start").alias("starts"))
    docs = docs.join(sizes.select("doc_id", F.col("n_tokens").alias("n")), "doc_id")
    each = docs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") <= F.col("c")) & (F.col("k") > 1)).alias("split"), F.count_if((F.col("t") != F.col("n")) | (F.col("starts") != F.col("k"))).alias("uncovered"))
    return each.join(over, "pack_name", "left").select("pack_name", "documents", F.coalesce("overfull", F.lit(0)).alias("overfull"), "split", "uncovered")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """(``source``, ``on_target``, ``within_repeats``): the share within a hundredth of the target, no document used too often."""
    r = p8_shares(spark, d)
    return r.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01).alias("on_target"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """(``labels_lost``, ``strangers``, ``repeated``): labels of documents missing from the result, subjects that are none, rows given twice."""
    got = cut(p9_found(spark, d))
    labels = table(spark, d, "doc_labels").distinct().join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    lost = labels.join(got, ["doc_id", "subject"], "left_anti").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    strangers = got.join(F.broadcast(table(spark, d, "subjects").select("subject")), "subject", "left_anti").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    twice = got.groupBy("doc_id", "subject").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    return twice.select(F.lit(lost).cast("bigint").alias("labels_lost"), F.lit(strangers).cast("bigint").alias("strangers"), "repeated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_boundaries": p6_boundaries,
    "p7_packing": p7_packing, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_held_out": p9_held_out, "p9_composition": p9_composition,
    "p2_collisions": p2_collisions, "p6_checks": p6_checks, "p7_checks": p7_checks, "p8_checks": p8_checks, "p9_checks": p9_checks,
}

_BARE = "lower(regexp_replace(originalForm, '[^\\p{L}\\p{N}\\p{M}]+', '', 'g'))"
_SCORE = "score.pagerank, score.segsim, score.boosted_sim, score.norm_boosted_sim, score.loc, score is null"
_NUM = "round(cast(json_extract_string(payload, '$.{0}') as double), 9)"

SQL: dict[str, str] = {
    "p2_found": f"""
with k as (select 'keyphrases' tab, min(kp_id) keep_id, count(*) copies from keyphrases
  group by lower(contextId), lower(instanceId), lower(segmentId), {_BARE}, type, {_SCORE}, to_remove),
e as (select 'entities' tab, min(ent_id) keep_id, count(*) copies from entities
  group by lower(contextId), lower(instanceId), lower(segmentId), {_BARE}, label, preference, {_SCORE}, confidence_score, type, to_remove, related_to_keyphrase),
j as (select record_id, json_extract_string(payload, '$.originalForm') originalForm, payload from phrase_records),
p as (select 'phrase_records' tab, min(record_id) keep_id, count(*) copies from j
  group by lower(json_extract_string(payload, '$.segmentId')), {_BARE}, json_extract_string(payload, '$.type'), json_extract_string(payload, '$.label'),
  {_NUM.format("preference")}, {_NUM.format("confidence_score")}, {", ".join(_NUM.format("score." + x) for x in ("pagerank", "segsim", "boosted_sim", "norm_boosted_sim", "loc"))})
select tab, keep_id, copies from (select * from k union all select * from e union all select * from p) where copies > 1""",
    "p3_found": """
with l as (select lower(instanceId) i, coalesce(max("limit"), 10) n from requests where instanceId is not null group by 1),
k as (select l.i instance_id, n, kp_id, row_number() over (partition by l.i order by score.boosted_sim desc, encode(coalesce(originalForm, '')), kp_id) pos
  from keyphrases join l on l.i = lower(instanceId) where score.boosted_sim is not null and not isnan(score.boosted_sim))
select instance_id, pos, kp_id from k where pos <= n""",
    "p5_found": """
with s as (select coalesce(lower(replace(id, '-', '')), 'row:' || seg_row_id) b, keyphrases, entities from segment_requests),
i as (select distinct b, lower(trim(x)) item from (select b, unnest(list_concat(
  coalesce(list_transform(keyphrases, lambda k: k.originalForm), []), coalesce(list_transform(entities, lambda k: k.originalForm), []))) x from s)
  where trim(x) <> ''),
n as (select count(distinct b) n from s),
c as (select item, count(*) n from i group by 1),
p as (select a.item item_a, b.item item_b, count(*) n_together from i a join i b on a.b = b.b and a.item < b.item group by 1, 2 having count(*) >= 8)
select item_a, item_b, n_together from p join c ca on ca.item = item_a join c cb on cb.item = item_b, n where n_together * n.n >= 12 * ca.n * cb.n""",
    "p2_collisions": "select * from (values ('keyphrases', 0::bigint), ('entities', 0::bigint), ('phrase_records', 0::bigint)) v(tab, collisions)",
    "p6_checks": "select 0::bigint repeated, 0::bigint same_speaker, 0::bigint strangers",
    "p7_checks": "select pack_name, (select count(distinct doc_id) from documents) documents, 0::bigint overfull, 0::bigint split, 0::bigint uncovered from pack_sizes",
    "p8_checks": "select source, true on_target, true within_repeats from source_targets",
    "p9_checks": "select 0::bigint labels_lost, 0::bigint strangers, 0::bigint repeated",
}
