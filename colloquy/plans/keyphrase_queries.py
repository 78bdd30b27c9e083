"""The keyphrase service end to end over whole tables, with SQL twins.

Phrases are the keyphrases and entities of the tables, segments the first deliveries of segment_requests, their time the
clean end time. In place of a feature store, a phrase's and a segment's vector is one of the first 200 embeddings, chosen by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import tagging, text
from colloquy.functions.ids import dashed
from colloquy.operators import ranking
from colloquy.runtime import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ID = "regexp_replace(replace(lower({0}), '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')".format
VECTORS = 200


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(``segment``, ``session``, ``text``, ``seconds``): the first delivery of each segment that has an id, a session, a text and an end."""
    s = table(spark, d, "segment_requests").where("id is not null and instanceId is not null")
    row = F.struct(dashed(F.col("instanceId")).alias("session"), F.col("originalText").alias("text"), F.unix_seconds(F.try_to_timestamp("endTime")).alias("seconds"))
    one = s.groupBy(dashed(F.col("id")).alias("segment")).agg(F.min_by(row, "seg_row_id").alias("r"))
    return one.select("segment", "r.*").where("text is not null and seconds is not null")


def phrases(spark: SparkSession, d: str) -> DataFrame:
    """(``row_id``, ``segment``, ``kind``, ``phrase``, ``type``, ``pagerank``, ``preference``)."""
    k, e = table(spark, d, "keyphrases"), table(spark, d, "entities")
    take = lambda t, row, kind, form, preference: t.where("segmentId is not null and originalForm is not null").select(F.col(row).alias("row_id"), dashed(F.col("segmentId")).alias("segment"), F.lit(kind).alias("kind"), F.col("originalForm").alias("phrase"), form.alias("type"), F.col("score.pagerank").alias("pagerank"), preference.cast("int").alias("preference"))
    return take(k, "kp_id", "keyphrase", F.col("type"), F.lit(None)).unionByName(take(e, "ent_id", "entity", F.lit(None).cast("string"), F.col("preference")))


def _key(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("bigint") % VECTORS


_CTE = f"""with seg as (select segment, session, t, secs, secs - min(secs) over (partition by session) off from (
  select {_ID('id')} segment, {_ID('instanceId')} session, originalText t, epoch_us(try_cast(regexp_replace(endTime, '(\\.\\d{{6}})\\d+', '\\1') as timestamptz)) // 1000000 secs
  from segment_requests where id is not null and instanceId is not null qualify row_number() over (partition by {_ID('id')} order by seg_row_id) = 1) where t is not null and secs is not null),
ph as (select kp_id row_id, lower(segmentId) segment, 'keyphrase' kind, originalForm phrase, type, score.pagerank pagerank, null::int preference from keyphrases where segmentId is not null and originalForm is not null
  union all select ent_id, lower(segmentId), 'entity', originalForm, null, score.pagerank, preference from entities where segmentId is not null and originalForm is not null),
lo as (select *, case when not removed then greatest(a, case when kind = 'entity' then b else 0 end) - 1 + off end::double loc from (
  select ph.*, session, off, case when strpos(t, phrase) > 0 then strpos(t, phrase) else 0 end a, case when strpos(t, phrase) > 0 then 0 else strpos(t, lower(phrase)) end b,
    not ((strpos(t, phrase) > 0 or (kind = 'entity' and strpos(t, lower(phrase)) > 0)) and case when kind = 'entity' then not contains(phrase, '*') else not (contains(phrase, '*') and contains(phrase, '.')) end) removed
  from ph join seg using (segment))),
v as (select vec_id k, embedding::double[] vec from embeddings where vec_id < {VECTORS}),
si as (select lo.*, coalesce(pagerank, 0) + segsim boosted, segsim from (select lo.*, coalesce(list_cosine_similarity(s.vec, p.vec), 0) / case when n > 4 then n - 3 else greatest(n, 1) end segsim
  from (select *, len(list_filter(regexp_split_to_array(phrase, '\\s+'), lambda w: w <> '')) n, ('0x' || substr(md5(phrase), 1, 6))::bigint % {VECTORS} pk, ('0x' || substr(md5(segment), 1, 6))::bigint % {VECTORS} sk from lo) lo
  left join v s on s.k = sk left join v p on p.k = pk) lo),
qu as (select session, segment, kind, coalesce(avg(boosted) filter (kind = 'entity' or type = 'descriptive'), 0) mean, coalesce(quantile_cont(boosted, 0.5) filter (kind = 'entity' or type = 'descriptive'), 0) median from si group by 1, 2, 3),
nr as (select si.*, qu.mean quality, boosted * case when kind = 'entity' then qu.mean else qu.median end * sentences / nullif(total, 0) norm_boosted from si join qu using (session, segment, kind)
  join (select session, kind, sum(case when kind = 'entity' then mean else median end) total from qu group by 1, 2) using (session, kind)
  join (select segment, len(list_filter(string_split(regexp_replace(trim(t), '([.?!])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: s <> '')) sentences from seg) using (segment))
""".replace("select lo.*, coalesce(pagerank, 0) + segsim boosted, segsim from", "select *, coalesce(pagerank, 0) + segsim boosted from")


def _located(spark: SparkSession, d: str) -> DataFrame:
    return ranking.located(phrases(spark, d), segments(spark, d))


@query(_CTE + "select kind, row_id, session, off \"offset\", loc, removed from lo")
def extract_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Where each phrase stands in its segment and in its session, and what is to be removed."""
    return _located(spark, d).select("kind", "row_id", "session", "offset", "loc", "removed")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") < VECTORS).select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _relevance(spark: SparkSession, d: str) -> DataFrame:
    p = _located(spark, d).withColumns({"_sk": _key(F.col("segment")), "_pk": _key(F.col("phrase"))})
    return ranking.local_relevance(p, F.broadcast(_vectors(spark, d)), "_sk", "_pk")  # at most VECTORS rows


@query(_CTE + "select kind, row_id, round(segsim, 9) segsim, round(boosted, 9) boosted from si")
def phrase_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each phrase with its segment over its length, and that plus its rank."""
    return _relevance(spark, d).select("kind", "row_id", F.round("segsim", 9).alias("segsim"), F.round("boosted", 9).alias("boosted"))


@query(_CTE + "select session, segment, kind, round(mean, 9) mean, round(median, 9) median from qu")
def local_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median relevance of each segment's descriptive keyphrases and of its entities."""
    q = ranking.segment_qualities(_relevance(spark, d))
    return q.withColumns({"mean": F.round("mean", 9), "median": F.round("median", 9)})


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    r = cut(_relevance(spark, d))
    n = segments(spark, d).select("segment", F.size(text.sentences(F.col("text"))).alias("sentences"))
    return ranking.normalised_relevance(r, ranking.segment_qualities(r), n)


@query(_CTE + "select kind, row_id, round(norm_boosted, 9) + 0.0 norm_boosted, round(quality, 9) quality from nr")
def compute_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Relevance of every phrase normalised over its session, with the quality of its segment."""
    return _normalised(spark, d).select("kind", "row_id", (F.round("norm_boosted", 9) + 0.0).alias("norm_boosted"), F.round("quality", 9).alias("quality"))


@query(_CTE + "select row_id, round(norm_boosted, 9) + 0.0 norm_boosted from nr where kind = 'keyphrase'")
def norm_boosted_rank(spark: SparkSession, d: str) -> DataFrame:
    """Keyphrases' relevance, by the number of sentences of their segment."""
    return _normalised(spark, d).where("kind = 'keyphrase'").select("row_id", (F.round("norm_boosted", 9) + 0.0).alias("norm_boosted"))


_REL = """, es as (select * from nr where kind = 'entity'), w as (select *, list_filter(regexp_split_to_array(phrase, '\\s+'), lambda w: w <> '') ws from es),
ins as (select distinct s.row_id from w s join w o on o.segment = s.segment and len(s.ws) = 1 and len(o.ws) > 1 and contains(o.phrase, s.phrase)),
rl as (select distinct s.row_id from w s join nr k on k.segment = s.segment and k.kind = 'keyphrase' and len(s.ws) = 1 and (contains(k.phrase, s.phrase) or contains(k.phrase, lower(s.phrase)))),
re as (select nr.* exclude (removed), removed, false related from nr where kind = 'keyphrase' union all
  select es.* exclude (removed), es.removed or (len(w.ws) > 1 and len(list_distinct(w.ws)) < len(w.ws)), es.row_id in (select row_id from rl) from es join w using (row_id) where es.row_id not in (select row_id from ins)),
th as (select re.* exclude (removed), coalesce(case when kind = 'keyphrase' then removed or coalesce(boosted <= quality, false)
  when preference > 2 and preference <> 5 then removed or (ec >= 2 and coalesce(boosted <= quality, false)) when boosted > 0 and not related then false else removed end, false) removed
  from re left join (select segment, count(*) ec from re where kind = 'entity' group by 1) using (segment))"""


def _related(spark: SparkSession, d: str) -> DataFrame:
    return ranking.related_entities(cut(_normalised(spark, d)))


@query(_CTE + _REL + "select kind, row_id, related, removed from re")
def post_process_phrase_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities without those inside longer ones; what is related to a keyphrase."""
    return _related(spark, d).select("kind", "row_id", "related", "removed")


def _thresholded(spark: SparkSession, d: str) -> DataFrame:
    return ranking.threshold_phrases(cut(_related(spark, d)), F.col("boosted"), F.col("quality"))


@query(_CTE + _REL + "select row_id, kind, removed from th")
def limit_phrase_list(spark: SparkSession, d: str) -> DataFrame:
    """What the segment's quality removes."""
    return _thresholded(spark, d).select("row_id", "kind", "removed")


_SLICE = """, rk as (select *, row_number() over (partition by session, kind order by norm_boosted desc nulls last, encode(phrase), row_id) rank from th where not removed and (kind <> 'entity' or not related)),
sl as (select * from (select *, sum(case when kind = 'entity' then 1 else 0 end) over (partition by session) ne from rk where rank <= 10) where rank <= case when kind = 'entity' then 5 else 10 - least(5, ne) end)"""


def _sliced(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quota_slice(_thresholded(spark, d).withColumn("score", F.col("norm_boosted")), "session")


@query(_CTE + _REL + _SLICE + "select session, kind, row_id, rank from sl")
def slice_phrases(spark: SparkSession, d: str) -> DataFrame:
    """At most five entities, keyphrases up to ten in all."""
    return _sliced(spark, d).select("session", "kind", "row_id", "rank")


_API = ", mg as (select session, phrase, arg_max(struct_pack(l := loc), struct_pack(k := case when kind = 'keyphrase' then 1 else 0 end, r := rank, i := row_id)).l loc from sl group by 1, 2)"


@query(_CTE + _REL + _SLICE + _API + "select session, phrase, loc, row_number() over (partition by session order by loc, encode(phrase)) rank from mg")
def get_keyphrases_api(spark: SparkSession, d: str) -> DataFrame:
    """The request for keyphrases, end to end: each session's phrases in the order they were said."""
    return ranking.merged_phrases(_sliced(spark, d))


@query(_CTE + _REL + _SLICE + ", og as (select session, phrase, segment, off, loc, row_number() over (partition by session, phrase order by off, segment) r from sl) select session, phrase, segment, off \"offset\", loc from og where r = 1")
def get_keyphrases_offset_api(spark: SparkSession, d: str) -> DataFrame:
    """The request for keyphrases with offsets: the same phrases with the first segment that has them and its time in the session."""
    s = _sliced(spark, d)
    return s.groupBy("session", "phrase").agg(F.min_by(F.struct("segment", "offset", "loc"), F.struct("offset", "segment")).alias("r")).select("session", "phrase", "r.*")


@query(_CTE + _REL + ", fs as (select session, arg_min(segment, struct_pack(o := off, s := segment)) segment from seg group by 1) select session, row_id, kind, rank from (select th.*, row_number() over (partition by session order by pagerank desc nulls last, encode(phrase), kind, row_id) rank from th join fs using (session, segment) where not removed) where rank <= 10")
def instance_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """The ten best phrases of each session's first segment."""
    from pyspark.sql import Window

    s = segments(spark, d)
    s = s.groupBy("session").agg(F.min_by("segment", F.struct("seconds", "segment")).alias("segment"))
    own = _thresholded(spark, d).where("not removed").join(s, ["session", "segment"], "left_semi")
    w = Window.partitionBy("session").orderBy(F.desc_nulls_last("pagerank"), "phrase", "kind", "row_id")
    return own.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10").select("session", "row_id", "kind", "rank")


# Filtration by a mind's vocabulary: the words of a mind are those of the descriptive keyphrases said in its sessions.

_MV = "mv as (select distinct lower(instanceId) session, mindId mind from requests where mindId is not null and instanceId is not null), vo as (select distinct mind, unnest(string_split(lower(originalForm), ' ')) word from keyphrases k join mv on mv.session = lower(k.instanceId) where type = 'descriptive')"


def _mind_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests").where("mindId is not null and instanceId is not null").select(dashed(F.col("instanceId")).alias("session"), F.col("mindId").alias("mind")).distinct()


@query(f"with {_MV} select mind, word from vo")
def vocab_load(spark: SparkSession, d: str) -> DataFrame:
    """(``mind``, ``word``): the vocabulary of each mind."""
    k = table(spark, d, "keyphrases").where("type = 'descriptive'").select(dashed(F.col("instanceId")).alias("session"), F.explode(F.split(F.lower("originalForm"), " ")).alias("word"))
    return k.join(_mind_of(spark, d), "session").select("mind", "word").distinct()


@query(f"with {_MV}, en as (select ent_id, mind, unnest(list_distinct(string_split(lower(originalForm), ' '))) word from entities e join mv on mv.session = lower(e.instanceId)), bad as (select distinct ent_id from en where not exists (select 1 from vo where vo.mind = en.mind and vo.word = en.word)) select e.ent_id, e.ent_id in (select ent_id from bad) removed from entities e where lower(instanceId) in (select session from mv)")
def graph_filter_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of sessions with a mind; ``removed`` if one of their words is not in the mind's vocabulary."""
    e = table(spark, d, "entities").select("ent_id", dashed(F.col("instanceId")).alias("session"), F.col("originalForm").alias("phrase")).join(_mind_of(spark, d), "session")
    kept = ranking.vocabulary_filter(e, vocab_load(spark, d), "ent_id", ["mind"])
    return e.select("ent_id").distinct().join(kept.select("ent_id", F.lit(False).alias("removed")).distinct(), "ent_id", "left").withColumn("removed", F.coalesce("removed", F.lit(True)))


@query()
def graph_filter_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """Keyphrases of sessions with a mind; ``removed`` if one of their words that is a noun in the segment is not in the vocabulary."""
    nouns = F.transform(F.filter(tagging.pos_tag(F.col("text")), lambda x: x["pos"].startswith("NN")), lambda x: F.lower(x["tok"]))
    s = segments(spark, d).select("segment", F.array_distinct(nouns).alias("nouns"))
    k = table(spark, d, "keyphrases").select("kp_id", dashed(F.col("instanceId")).alias("session"), dashed(F.col("segmentId")).alias("segment"), F.col("originalForm").alias("phrase")).join(_mind_of(spark, d), "session").join(s, "segment")
    kept = ranking.vocabulary_filter(k, vocab_load(spark, d), "kp_id", ["mind"], F.array_intersect(F.split(F.lower("phrase"), " "), "nouns"))
    return k.select("kp_id").distinct().join(kept.select("kp_id", F.lit(False).alias("removed")).distinct(), "kp_id", "left").withColumn("removed", F.coalesce("removed", F.lit(True)))


@query()
def graph_filtration(spark: SparkSession, d: str) -> DataFrame:
    """Both filters: (``kind``, ``row_id``, ``removed``)."""
    k, e = graph_filter_keyphrases(spark, d), graph_filter_entities(spark, d)
    return k.select(F.lit("keyphrase").alias("kind"), F.col("kp_id").alias("row_id"), "removed").unionByName(e.select(F.lit("entity").alias("kind"), F.col("ent_id").alias("row_id"), "removed"))


@query("select kp_id, rank from (select kp_id, row_number() over (order by score.boosted_sim desc, kp_id) rank from keyphrases where score.boosted_sim is not null and not isnan(score.boosted_sim)) where rank <= 100 order by rank")
def sort_by_key_idx(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best keyphrases: a top-k report, descending."""
    k = table(spark, d, "keyphrases").where("score.boosted_sim is not null and not isnan(score.boosted_sim)")
    top = k.select("kp_id", F.col("score.boosted_sim").alias("s")).orderBy(F.desc("s"), "kp_id").limit(100)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "kp_id")).cast("bigint")).drop("s")


@query(f"select seg_row_id, {_ID('contextId')} || ':' || {_ID('instanceId')} graph_id from segment_requests where contextId is not null and instanceId is not null")
def graph_id(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_requests").where("contextId is not null and instanceId is not null")
    return s.select("seg_row_id", F.concat_ws(":", dashed(F.col("contextId")), dashed(F.col("instanceId"))).alias("graph_id"))


@query(_CTE + "select segment, session || '/' || segment || '.vec' uri, t is not null has_text from seg")
def segment_attrs(spark: SparkSession, d: str) -> DataFrame:
    """(``segment``, ``uri``, ``has_text``): what a segment's vertex gets: where its vectors are stored."""
    return segments(spark, d).select("segment", F.concat(F.concat_ws("/", "session", "segment"), F.lit(".vec")).alias("uri"), F.col("text").isNotNull().alias("has_text"))
