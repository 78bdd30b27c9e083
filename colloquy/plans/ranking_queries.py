"""Relevance, topic and recommendation queries over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed
from colloquy.functions.tagging import entity_preference
from colloquy.operators import ranking, recommend, topics
from colloquy.operators.graph import latest
from colloquy.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIM, TABLES, BITS = 64, 8, 6


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Relevance of phrases. Segment = segmentId, session = instanceId.

_OK = "score.boosted_sim is not null and not isnan(score.boosted_sim)"


def _scored(spark: SparkSession, d: str, name: str = "keyphrases", row: str = "kp_id") -> DataFrame:
    k = table(spark, d, name)
    return k.where("score.boosted_sim is not null and not isnan(score.boosted_sim)").select(
        F.col(row).alias("row_id"), dashed(F.col("instanceId")).alias("session"), dashed(F.col("segmentId")).alias("segment"), F.col("originalForm").alias("phrase"),
        F.col("score.boosted_sim").alias("boosted"), F.col("score.loc").alias("loc"), F.lit("keyphrase" if row == "kp_id" else "entity").alias("kind"),
        (F.col("preference") if row == "ent_id" else F.lit(None)).cast("int").alias("preference"),
    )


_K = f"select kp_id row_id, instanceId session, segmentId segment, originalForm phrase, score.boosted_sim boosted, score.loc loc, 'keyphrase' kind, null::int preference from keyphrases where {_OK}"
_E = f"select ent_id row_id, instanceId session, segmentId segment, originalForm phrase, score.boosted_sim boosted, score.loc loc, 'entity' kind, preference from entities where {_OK}"
_B = f"({_K} union all {_E})"


def _both(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).unionByName(_scored(spark, d, "entities", "ent_id"))


@query("select kp_id, score.pagerank + score.segsim boosted from keyphrases where score is not null")
def boosted_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keyphrases").where("score is not null").select("kp_id", (F.col("score.pagerank") + F.col("score.segsim")).alias("boosted"))


@query('select session, total, top_n, case when top_n in (5, 10) then top_n else least(greatest(top_n, total // 3), 10) end n from (select instanceId session, count(*) total from keyphrases group by 1) k join (select lower(instanceId) i, coalesce(max("limit"), 10) top_n from requests group by 1) r on r.i = session')
def prepare_output(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic number of phrases per session."""
    k = table(spark, d, "keyphrases").groupBy(dashed(F.col("instanceId")).alias("session")).agg(F.count(F.lit(1)).alias("total"))
    r = table(spark, d, "requests").groupBy(dashed(F.col("instanceId")).alias("session")).agg(F.coalesce(F.max("limit"), F.lit(10)).alias("top_n"))
    return k.join(r, "session").withColumn("n", ranking.dynamic_top_n(F.col("total"), F.col("top_n")).cast("bigint"))


@query("select ent_id, preference from entities order by preference, ent_id")
def sort_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("ent_id", "preference").orderBy("preference", "ent_id")


@query(f"select session, phrase, arg_max(loc, struct_pack(r := case when kind = 'keyphrase' then 1 else 0 end, i := row_id)) loc from {_B} where loc is not null group by 1, 2")
def dict_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Location of a phrase: keyphrases win over entities, later rows over earlier."""
    b = _both(spark, d).where("loc is not null").withColumn("r", (F.col("kind") == "keyphrase").cast("int"))
    return ranking.last_wins(b, ["session", "phrase"], "loc", ["r", "row_id"])


@query()
def fuzzy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The ten best phrases of each session, alike ones merged."""
    from colloquy.operators.wordgraph import top_phrases

    k = _scored(spark, d).groupBy(F.col("session").alias("graph"), "phrase").agg(F.max("boosted").alias("score"))
    lists = top_phrases(k).groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
    return ranking.fuzzy_dedupe(lists, "graph", "phrases").select("graph", F.array_join("phrases", "|").alias("phrases"))


_SEG = "select lower(instanceId) session, seg_row_id segment_no, originalText t from segment_requests where originalText is not null and instanceId is not null"


@query(f"select session, phrase, max(segment_no) \"offset\" from (select distinct instanceId session, originalForm phrase from keyphrases) k join ({_SEG}) s using (session) where contains(t, phrase) group by 1, 2")
def offset_map(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_requests").where("originalText is not null").select(dashed(F.col("instanceId")).alias("session"), F.col("seg_row_id").alias("segment_no"), F.col("seg_row_id").alias("offset"), F.col("originalText").alias("text"))
    k = table(spark, d, "keyphrases").select(dashed(F.col("instanceId")).alias("session"), F.col("originalForm").alias("phrase"))
    return ranking.phrase_offsets(k, s, "session")


@query("select kp_id from keyphrases where len(string_split(originalForm, ' ')) > 1 and not to_remove")
def post_process_output(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keyphrases").where("size(split(originalForm, ' ')) > 1 and not to_remove").select("kp_id")


@query("select distinct e.ent_id from entities e join keyphrases k on lower(k.segmentId) = lower(e.segmentId) where contains(lower(k.originalForm), lower(e.originalForm))")
def post_process_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that occur in a keyphrase of their segment."""
    e = table(spark, d, "entities").select("ent_id", dashed(F.col("segmentId")).alias("s"), F.lower("originalForm").alias("e"))
    k = table(spark, d, "keyphrases").select(dashed(F.col("segmentId")).alias("s"), F.lower("originalForm").alias("k"))
    return e.join(k, "s").where(F.position(F.col("e"), F.col("k")) > 0).select("ent_id").distinct()


@query("select ent_id, cast(case label when 'MISC' then 1 when 'ORG' then 2 when 'PER' then 3 when 'LOC' then 4 when 'O' then 5 else 6 end as bigint) preference from entities")
def entity_preference_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("ent_id", entity_preference(F.col("label")).cast("bigint").alias("preference"))


@query("select lower(instanceId) session, coalesce(arg_max(mindId, request_id) filter (mindId is not null), 'default') mind from requests group by 1")
def s_set_mind(spark: SparkSession, d: str) -> DataFrame:
    """Stored mind of a session, else the default."""
    r = table(spark, d, "requests").groupBy(dashed(F.col("instanceId")).alias("session")).agg(F.max_by("mindId", F.when(F.col("mindId").isNotNull(), F.col("request_id"))).alias("m"))
    return r.select("session", F.coalesce("m", F.lit("default")).alias("mind"))


@query('select lower(contextId) context, lower(instanceId) session, request_id, "limit" wish, highlight from requests qualify row_number() over (partition by lower(contextId), lower(instanceId) order by request_id desc) = 1')
def latest_request(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requests").select(dashed(F.col("contextId")).alias("context"), dashed(F.col("instanceId")).alias("session"), "request_id", F.col("limit").alias("wish"), "highlight")
    return latest(r, ["context", "session"], ["request_id"])


# Vectors: embeddings(vec_id, embedding, label); a mind is a label with its mean vector; a session is ten vectors.


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def _minds(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return v.groupBy(F.col("label").alias("mind")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mind_vec"))


_V = "select vec_id, embedding::double[] vec, label from embeddings"
_M = f"select label mind, list(m order by i) mind_vec from (select label, i, avg(x) m from (select label, unnest(range(64)) i, unnest(vec) x from ({_V})) group by 1, 2) group by 1"
_COS = "list_cosine_similarity({0}, {1})".format
_MS = f"select vec_id, mind, {_COS('vec', 'mind_vec')} s from ({_V}), ({_M})"


@query(f"select vec_id, round(max(s), 9) score from ({_MS}) group by 1")
def mind_score(spark: SparkSession, d: str) -> DataFrame:
    return topics.mind_scores(_vectors(spark, d), _minds(spark, d), "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query(f"select arg_max mind, count(*) n from (select vec_id, arg_max(mind, s) arg_max from ({_MS}) group by 1) group by 1")
def segment_score_core(spark: SparkSession, d: str) -> DataFrame:
    """How often each mind is the best."""
    return topics.mind_scores(_vectors(spark, d), _minds(spark, d), "vec_id").groupBy("mind").agg(F.count(F.lit(1)).alias("n"))


@query(f"select vec_id // 10 segment, round(avg(m), 9) score, round(1 / (0.1 * avg(m)), 6) distance from (select vec_id, max(s) m from ({_MS}) group by 1) group by 1")
def segment_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the best scores of ten vectors each, penalised as if short."""
    s = topics.mind_scores(_vectors(spark, d), _minds(spark, d), "vec_id").groupBy(F.expr("vec_id div 10").alias("segment")).agg(F.avg("score").alias("m"))
    return s.select("segment", F.round("m", 9).alias("score"), F.round(topics.segment_distance(F.col("m"), F.lit(30))[1], 6).alias("distance"))


def _sentence_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sentence = vector; segment = two vectors; session = 20 vectors."""
    return _vectors(spark, d).select(F.concat(F.lit("s"), F.expr("vec_id div 20").cast("string")).alias("session"), F.col("vec_id").alias("sentence"), F.expr("vec_id div 2").alias("ord"), "vec")


_SV = f"select 's' || (vec_id // 20) session, vec_id sentence, vec_id // 2 ord, vec from ({_V})"
_NP = f"select a.session, a.sentence i, b.sentence j, {_COS('a.vec', 'b.vec')} w from ({_SV}) a join ({_SV}) b on a.session = b.session and b.ord - a.ord in (0, 1) and a.sentence < b.sentence"


@query(f"select session, i, j, round(w, 9) w from ({_NP})")
def next_segment_graph(spark: SparkSession, d: str) -> DataFrame:
    return topics.next_segment_pairs(_sentence_vectors(spark, d), "session").withColumn("w", F.round("w", 9))


_FS = f"""with p as (select a.session, a.sentence i, b.sentence j, {_COS('a.vec', 'b.vec')} w from ({_SV}) a join ({_SV}) b on a.session = b.session),
x as (select session, i, j, case when i = j then avg(case when i = j then 1 else w end) over (partition by session, i) else w end x from p),
n as (select *, (x - min(x) over v) / nullif(max(x) over v - min(x) over v, 0) n from x window v as (partition by session, i))
select a.session, a.i, a.j, round(case when a.i = a.j then 1 else (a.n + b.n) / 2 end, 9) + 0.0 w from n a join n b on a.session = b.session and a.i = b.j and a.j = b.i where a.i <= a.j"""


@query(_FS)
def full_similarity_graph(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a session's sentences and each sentence with itself (1)."""
    return topics.full_similarity(_sentence_vectors(spark, d), "session").withColumn("w", F.round("w", 9))


@query(f"with p as ({_NP}), c as (select session, quantile_cont(w, 0.75) c from p group by 1) select session, i, j from p join c using (session) where w >= c")
def prune_percentile(spark: SparkSession, d: str) -> DataFrame:
    return topics.prune_percentile(topics.next_segment_pairs(_sentence_vectors(spark, d), "session"), "session", 75).select("session", "i", "j")


@query()
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return topics.communities(topics.next_segment_pairs(_sentence_vectors(spark, d), "session"), "session")


@query()
def h_communities(spark: SparkSession, d: str, h_flag: bool = False) -> DataFrame:
    """The whole grouping: communities, majority, time islands, segments without a community, contained groups merged, singletons
    dropped, groups ranked by their segments' mean mind score; with ``h_flag``, communities are split once more.
    """
    v = _sentence_vectors(spark, d)
    s = v.select("session", "sentence", F.col("ord").alias("segment"))
    c = louvain(spark, d)
    if h_flag:
        c = topics.hierarchical_split(c, v, "session")
    m = topics.majority_assign(c.join(s, ["session", "sentence"]), "session")
    scores = topics.mind_scores(_vectors(spark, d), _minds(spark, d), "vec_id").withColumnRenamed("vec_id", "sentence").join(s, "sentence")
    scores = scores.groupBy("session", "segment").agg(F.avg("score").alias("score"))
    return topics.time_groups(m, s, scores, "session").withColumn("mean_score", F.round("mean_score", 9))


_MJ = "select * from (select session, segment, community, count(*) n from (select 's' || (vec_id // 20) session, vec_id // 5 segment, label community from embeddings) group by 1, 2, 3) qualify row_number() over (partition by session, segment order by n desc, community desc) = 1"


@query(_MJ)
def majority_assign(spark: SparkSession, d: str) -> DataFrame:
    m = _vectors(spark, d).select(F.concat(F.lit("s"), F.expr("vec_id div 20").cast("string")).alias("session"), F.expr("vec_id div 5").alias("segment"), F.col("label").alias("community"))
    return topics.majority_assign(m, "session")


_TI = "select label, vec_id ord, sum(b) over (partition by label order by vec_id) island from (select label, vec_id, case when vec_id - lag(vec_id) over (partition by label order by vec_id) <= 1 then 0 else 1 end b from embeddings)"


@query(f"select label, ord, cast(island as bigint) island from ({_TI})")
def time_islands(spark: SparkSession, d: str) -> DataFrame:
    return topics.time_islands(_vectors(spark, d).select("label", F.col("vec_id").alias("ord")), ["label"])


_IS = f"select label, island, count(*) size from ({_TI}) group by 1, 2"


@query(f"select label, cast(island as bigint) island, size from (select *, max(size) over (partition by label) m from ({_IS})) where m <= 1 or size > 1")
def drop_singletons(spark: SparkSession, d: str) -> DataFrame:
    g = time_islands(spark, d).groupBy("label", "island").agg(F.count(F.lit(1)).alias("size"))
    return topics.drop_singletons(g, "label")


_GR = "select lower(replace(recordingId, '-', '')) session, rec_row_id grp, epoch_us(startTime) s, epoch_us(endTime) e from recorded_segments where recordingId is not null and endTime > startTime"


@query(f"""with g as ({_GR}), w as (select *, max(e) over (partition by session order by s, e desc, grp rows between unbounded preceding and 1 preceding) m from g)
select grp as "group" from w where m >= e""")
def merge_contained(spark: SparkSession, d: str) -> DataFrame:
    """Spans that lie inside another span of their recording."""
    from colloquy.operators.intervals import micros

    r = table(spark, d, "recorded_segments").where("recordingId is not null and endTime > startTime")
    g = r.select(F.regexp_replace(F.lower("recordingId"), "-", "").alias("session"), F.col("rec_row_id").alias("group"), micros(F.col("startTime")).alias("start"), micros(F.col("endTime")).alias("end"), F.lit(2).alias("size"))
    return topics.merge_contained(g, "session").where("into <> group").select("group")


@query(f"select session, grp \"group\", round(m, 9) mean_score, row_number() over (partition by session order by m desc, grp) rank from (select session, segment grp, avg(boosted) m from ({_K}) group by 1, 2)")
def order_groups(spark: SparkSession, d: str) -> DataFrame:
    g = topics.order_groups(_scored(spark, d).withColumnRenamed("segment", "group"), "session", "group", F.col("boosted"))
    return g.withColumn("mean_score", F.round("mean_score", 9))


@query(f"select vec_id from (select vec_id, max(s) m from ({_MS}) group by 1) order by m desc, vec_id limit 5")
def fallback_top5(spark: SparkSession, d: str) -> DataFrame:
    return topics.mind_scores(_vectors(spark, d), _minds(spark, d), "vec_id").orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id")


@query(f"select label \"group\", round(min(1 / m), 6) distance, row_number() over (order by min(1 / m), label) rank from (select vec_id, label, max(s) m from ({_MS}) join embeddings using (vec_id) group by 1, 2) group by 1")
def topic_pims(spark: SparkSession, d: str) -> DataFrame:
    s = topics.mind_scores(_vectors(spark, d), _minds(spark, d), "vec_id").select("vec_id", (1 / F.col("score")).alias("distance"))
    return topics.topic_order(s, _vectors(spark, d).select("vec_id", F.col("label").alias("group")), "vec_id").withColumn("distance", F.round("distance", 6))


@query('select lower(instanceId) session, count(*) n, arg_min(seg_row_id, struct_pack(e := endTime, i := seg_row_id)) first_row from segment_requests where instanceId is not null group by 1')
def get_topics(spark: SparkSession, d: str) -> DataFrame:
    """Segments per session and the first of them by end time (text order)."""
    s = table(spark, d, "segment_requests").where("instanceId is not null")
    return s.groupBy(dashed(F.col("instanceId")).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min_by("seg_row_id", F.struct("endTime", "seg_row_id")).alias("first_row"))


# Recommendation: users are labels, their vectors the embeddings; every 100th vector is a query.

#: The index that is searched: the reference's 500 tables. Its adaptive hash size (16 bits for 500 to 2,000 vectors) would find
#: 15 % of the ten nearest of sf0.1; 10 bits find 99 %.
INDEX_TABLES, INDEX_BITS = 500, 10
_PLANES = recommend.hashed_projections(TABLES, BITS, DIM)
_INDEX = recommend.hashed_projections(INDEX_TABLES, INDEX_BITS, DIM)


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    return recommend.lsh_buckets(_vectors(spark, d), "vec_id", _PLANES)


def _bucket_sql(tables: int, bits: int) -> str:
    entry = "((h * h // 65536 + x * 40503) % 65536) / 32768 - 1"
    planes = f"select (x - 1) // {DIM} i, list({entry} order by x) p from (select x, x * 2654435761 % 2147483648 h from (select unnest(range(1, {tables * bits * DIM + 1})) x)) group by 1"
    return f"select vec_id, i // {bits} t, cast(sum(case when list_dot_product(vec, p) > 0 then 1 << (i % {bits}) else 0 end) as bigint) bucket from ({_V}), ({planes}) group by 1, 2"


_BK = _bucket_sql(TABLES, BITS)
_MT = f"with b as materialized ({_bucket_sql(INDEX_TABLES, INDEX_BITS)}) select q.vec_id query, e.label as user, count(*) matches from b q join b i on q.t = i.t and q.bucket = i.bucket join embeddings e on e.vec_id = i.vec_id where q.vec_id % 100 = 0 group by 1, 2"


@query(f"select vec_id, array_to_string(list(bucket order by t), ',') buckets from ({_BK}) group by 1")
def lsh_hash(spark: SparkSession, d: str) -> DataFrame:
    return _buckets(spark, d).select("vec_id", F.array_join(F.transform("buckets", lambda x: x.cast("string")), ",").alias("buckets"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return recommend.lsh_buckets(_vectors(spark, d), "vec_id", _INDEX)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    b = _index(spark, d)
    index = b.join(_vectors(spark, d).select("vec_id", F.col("label").alias("user")), "vec_id")
    return recommend.lsh_matches(b.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "buckets"), index.select("user", "buckets"), "user")


@query(_MT)
def lsh_query(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with an id divisible by 100 against all."""
    return _matches(spark, d)


_US = f"select m.user, sum(matches) / any_value(n) v1, sum(matches) / ((select sum(matches) from ({_MT})) * (any_value(mean) + (any_value(most) - any_value(mean)) * any_value(n))) v2 from ({_MT}) m join (select label as user, count(*) n from embeddings group by 1) z on z.user = m.user, (select avg(n) mean, max(n) most from (select count(*) n from embeddings group by label)) group by 1"


def _user_scores(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d).groupBy("user").agg(F.sum("matches").alias("matches"))
    n = _vectors(spark, d).groupBy(F.col("label").alias("user")).agg(F.count(F.lit(1)).alias("n"))
    return recommend.user_scores(m, n)


@query(f"select \"user\", round(v1, 9) v1, round(v2, 12) v2 from ({_US})")
def user_search(spark: SparkSession, d: str) -> DataFrame:
    return _user_scores(spark, d).select("user", F.round("v1", 9).alias("v1"), F.round("v2", 12).alias("v2"))


_NS = f"select \"user\", (v1 - avg(v1) over ()) / nullif(max(v1) over () - min(v1) over (), 0) norm from ({_US})"


@query(f"select \"user\", round(norm, 9) norm from ({_NS})")
def normalize_scores(spark: SparkSession, d: str) -> DataFrame:
    return recommend.normalise_scores(_user_scores(spark, d), "v1").select("user", F.round("norm", 9).alias("norm"))


@query(f"select \"user\" from ({_NS}) where norm > 0 and norm >= (select quantile_cont(norm, 0.75) from ({_NS}))")
def lsh_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return recommend.percentile_cutoff(recommend.normalise_scores(_user_scores(spark, d), "v1"), "norm").select("user")


@query(f"select \"user\" from ({_NS}) where (select max(norm) from ({_NS})) >= 0.55")
def relevancy_gate(spark: SparkSession, d: str) -> DataFrame:
    return recommend.relevancy_gate(recommend.normalise_scores(_user_scores(spark, d), "v1"), least=0.55).select("user")


@query(f"select \"user\" from ({_US}) where \"user\" not in (select label from embeddings where vec_id < 3)")
def exclude_participants(spark: SparkSession, d: str) -> DataFrame:
    """Users without those of the first three vectors."""
    return _user_scores(spark, d).join(_vectors(spark, d).where("vec_id < 3").select(F.col("label").alias("user")), "user", "left_anti").select("user")


_RR = f"select q.vec_id query, a.label as user, a.vec_id item, {_COS('a.vec', 'q.vec')} s from ({_V}) a join ({_V}) q on q.vec_id % 100 = 0"


@query(f"select query, \"user\", round(avg(s), 9) phrase_score, array_to_string(list(item order by r), ',') phrases from (select *, row_number() over (partition by query, \"user\" order by s desc, item) r from ({_RR})) where r <= 10 group by 1, 2")
def rerank_users(spark: SparkSession, d: str) -> DataFrame:
    """Ten items of each user nearest to every vector with an id divisible by 100."""
    v = _vectors(spark, d)
    out = recommend.rerank_all(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "vec"), v.select(F.col("label").alias("user"), F.col("vec_id").alias("item"), "vec"))
    return out.select("query", "user", F.round("phrase_score", 9).alias("phrase_score"), F.array_join(F.transform("phrases", lambda x: x.cast("string")), ",").alias("phrases"))


@query("select user_id, array_to_string(list_sort(list(distinct event_type)), ',') event_type from events where event_type is not null group by 1")
def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = recommend.user_profiles(table(spark, d, "events"), "user_id", ["event_type"])
    return p.select("user_id", F.array_join("event_type", ",").alias("event_type"))


@query(f"select (max(v1) - (select v1 from ({_US}) order by v1 desc limit 1 offset 1)) / stddev_pop(v1) >= 1.0 high from ({_US})")
def high_deviation(spark: SparkSession, d: str) -> DataFrame:
    return recommend.high_deviation(_user_scores(spark, d), "v1", 1.0).select("high")


@query("select event_type k, count(*) v from events group by 1 order by 2, 1")
def sort_dict_by_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("v")).orderBy("v", "k")

