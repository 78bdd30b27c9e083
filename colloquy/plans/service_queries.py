"""Graph, topic, recommendation, ETL and request queries over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import tagging, text
from colloquy.functions.ids import dashed
from colloquy.operators import etl, graph, ranking, recommend, topics
from colloquy.operators.intervals import micros
from colloquy.plans import graph_queries as gq
from colloquy.plans import ranking_queries as rq
from colloquy.runtime import cut, table
from colloquy.sources import io

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ID, _G = gq._ID, gq._G


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return gq.populate_segments_edges(spark, d)


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    return gq.populate_segments_vertices(spark, d)


# Graph queries


@query(_G + "select xid, \"type\" from gv where name = 'next step'")
def g_root_eq(spark: SparkSession, d: str) -> DataFrame:
    return graph.root_eq(_vertices(spark, d), "name", "next step").select("xid", "type")


@query(_G + f"select xid, name from gv where \"type\" = 'Keyphrase' and not {gq._ANY} and xid in (select dst from ge where relation = 'hasKeywords' and src in (select src from ge where relation = 'authoredBy' and dst = (select min(dst) from ge where relation = 'authoredBy')))")
def g_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keyphrases that hold none of the terms (NOT) and that the first user said (uid)."""
    e, v = cut(_edges(spark, d)), _vertices(spark, d)
    first = e.where("relation = 'authoredBy'").agg(F.min("dst").alias("xid"))
    said = graph.expand(graph.expand(first, e, "authoredBy", "segment", True, True).select(F.col("segment").alias("xid")), e, "hasKeywords", "word", True)
    named = v.where((F.col("type") == "Keyphrase") & ~graph.any_of_terms(F.col("name"), gq._TERMS))
    return graph.by_uid(named, said.select(F.col("word").alias("xid"))).select("xid", "name")


@query(_G + f"select m.src context, m.dst session, s.dst segment, a.dst as user from {gq._rel('hasMeeting')} m join {gq._rel('hasSegment')} s on s.src = m.dst join {gq._rel('authoredBy')} a on a.src = s.dst")
def g_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of all walks context - session - segment - user."""
    v = _vertices(spark, d).where("type = 'Context'").select("xid")
    return graph.normalize(v, cut(_edges(spark, d)), [("hasMeeting", "session"), ("hasSegment", "segment"), ("authoredBy", "user")], "context")


_LAST = "select {0} context, {1} session, max(endTime) last from segment_requests where contextId is not null and instanceId is not null group by 1, 2".format(_ID("contextId"), _ID("instanceId"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment_requests").where("contextId is not null and instanceId is not null")
    return s.groupBy(dashed(F.col("contextId")).alias("context"), dashed(F.col("instanceId")).alias("session")).agg(F.max("endTime").alias("last"))


@query(f"select context, session, last from ({_LAST}) qualify row_number() over (partition by context order by last desc, session) <= 2")
def g_order(spark: SparkSession, d: str) -> DataFrame:
    """The last two sessions of each context."""
    return graph.first_per_parent(_sessions(spark, d), "context", 2, [F.desc("last"), F.asc("session")])


@query(_G + "select src, count(*) n from ge where relation = 'hasSegment' group by 1 having count(*) >= 10")
def g_params(spark: SparkSession, d: str) -> DataFrame:
    """A query text with named parameters."""
    return graph.run_query("select src, count(*) n from {edges} where relation = :r group by src having count(*) >= :least", {"edges": _edges(spark, d)}, r="hasSegment", least=10)


QUERIES["run_query"], SQL["run_query"] = QUERIES["g_params"], SQL["g_params"]

_NAMES = "array_to_string(list_sort(list(distinct name)), '|')"


@query(_G + f""", hi as (select distinct lower(instanceId) session from (select instanceId, highlight, row_number() over (partition by lower(instanceId) order by request_id desc) r from requests) where r = 1 and highlight),
sg as (select s.src session, s.dst segment from {gq._rel('hasSegment')} s join hi on hi.session = s.src),
kw as (select k.src segment, {_NAMES} keywords from {gq._rel('hasKeywords')} k join (select distinct xid, name from gv where "type" = 'Keyphrase') n on n.xid = k.dst group by 1),
en as (select k.src segment, {_NAMES} entities from {gq._rel('hasEntities')} k join (select distinct xid, name from gv where "type" = 'Entity') n on n.xid = k.dst group by 1)
select session, segment, a.dst as user, keywords, entities from sg left join {gq._rel('authoredBy')} a on a.src = segment left join kw using (segment) left join en using (segment)""")
def q_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Segments of highlighted sessions with their author, keyphrases and entities."""
    e, v = cut(_edges(spark, d)), cut(_vertices(spark, d).where("type in ('Keyphrase', 'Entity')"))
    last = table(spark, d, "requests").groupBy(dashed(F.col("instanceId")).alias("xid")).agg(F.max_by("highlight", "request_id").alias("h")).where("h")
    s = graph.expand(last.select("xid"), e, "hasSegment", "segment", cascade=True).select(F.col("xid").alias("session"), F.col("segment").alias("xid"))
    s = graph.expand(s, e, "authoredBy", "user")

    def names(relation: str, kind: str, out: str) -> DataFrame:
        n = v.where(F.col("type") == kind).select(F.col("xid").alias("dst"), "name").distinct()
        return e.where(F.col("relation") == relation).join(n, "dst").groupBy(F.col("src").alias("xid")).agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias(out))

    found = s.join(names("hasKeywords", "Keyphrase", "keywords"), "xid", "left").join(names("hasEntities", "Entity", "entities"), "xid", "left")
    return found.select("session", F.col("xid").alias("segment"), "user", "keywords", "entities")


_GROUPS = f"select rec_row_id, {_ID('recordingId')} recording, {_ID('recordingId')} || ':' || groupId grp, {_ID('spokenBy')} u, {_ID('id')} segment, epoch_us(startTime) s from recorded_segments where recordingId is not null and groupId is not null"


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recorded_segments").where("recordingId is not null and groupId is not null")
    return r.select(dashed(F.col("recordingId")).alias("recording"), F.concat_ws(":", dashed(F.col("recordingId")), F.col("groupId").cast("string")).alias("group"), dashed(F.col("spokenBy")).alias("user"), dashed(F.col("id")).alias("segment"), micros(F.col("startTime")).alias("at"))


_SUMMARY = f"""with g as ({_GROUPS}), hu as (select distinct grp, u from g where u is not null)
select distinct segment src, 'belongsTo' relation, grp dst from g where segment is not null union all select grp, 'hasUser', u from hu union all select distinct a.u, 'groupedWith', b.u from hu a join hu b on a.grp = b.grp and a.u <> b.u"""


@query(_SUMMARY)
def populate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the summary groups of recorded segments."""
    return graph.summary_edges(_grouped(spark, d).select("segment", "group", "user"))


@query(f"""with g as ({_GROUPS}), l as (select recording, grp from (select recording, grp, max(s) m from g group by 1, 2) qualify row_number() over (partition by recording order by m desc nulls last, grp) <= 10),
hu as (select distinct grp, u from g where u is not null)
select l.recording, l.grp "group", a.u as user, b.u related from l join hu a using (grp) left join hu b on b.grp = a.grp and b.u <> a.u""")
def q_summary_info(spark: SparkSession, d: str) -> DataFrame:
    """The last ten summary groups of each recording with their users and whom these are grouped with there."""
    g = cut(_grouped(spark, d))
    last = graph.first_per_parent(g.groupBy("recording", "group").agg(F.max("at").alias("at")), "recording", 10, [F.desc_nulls_last("at"), F.asc("group")])
    users = g.where("user is not null").select("group", "user").distinct().join(last.select("group"), "group", "left_semi")
    other = users.select("group", F.col("user").alias("related"))
    pairs = users.join(other, "group").where("user <> related")
    return last.select("recording", "group").join(users, "group").join(pairs, ["group", "user"], "left").select("recording", "group", "user", "related")


_WS = f"select distinct {_ID('tenantId')} ws, {_ID('contextId')} c, {_ID('instanceId')} i, {_ID('id')} g, {_ID('spokenBy')} u from segment_requests where tenantId is not null and contextId is not null and instanceId is not null and id is not null"


@query(f"""with s as ({_WS}), c0 as (select min(c) c from s), w as (select distinct ws from s where c in (select c from c0)), mem as (select distinct u from s where c in (select c from c0) and u is not null),
ses as (select c, i from (select distinct c, i from s join w using (ws)) qualify row_number() over (partition by c order by i) <= 10)
select distinct s.c context, s.i session, s.g segment, s.u as user, k.originalForm keyword from s join w using (ws) join ses on ses.c = s.c and ses.i = s.i join mem on mem.u = s.u join keyphrases k on lower(k.segmentId) = s.g""")
def q_user_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What the members of the first context said in the contexts of its workspace: ten sessions each, with keyphrases."""
    s = table(spark, d, "segment_requests").where("tenantId is not null and contextId is not null and instanceId is not null and id is not null")
    s = cut(s.select(dashed(F.col("tenantId")).alias("ws"), dashed(F.col("contextId")).alias("context"), dashed(F.col("instanceId")).alias("session"), dashed(F.col("id")).alias("segment"), dashed(F.col("spokenBy")).alias("user")).distinct())
    own = s.join(s.agg(F.min("context").alias("context")), "context", "left_semi")
    near = s.join(own.select("ws").distinct(), "ws", "left_semi")
    ten = graph.first_per_parent(near.select("context", "session").distinct(), "context", 10, [F.asc("session")])
    said = near.join(ten, ["context", "session"], "left_semi").join(own.select("user").where("user is not null").distinct(), "user", "left_semi")
    k = table(spark, d, "keyphrases").select(dashed(F.col("segmentId")).alias("segment"), F.col("originalForm").alias("keyword"))
    return said.join(k, "segment").select("context", "session", "segment", "user", "keyword").distinct()


@query(f"select distinct u as user, k.originalForm keyword from ({_WS}) s join tenants t on lower(t.tenantId) = s.ws join keyphrases k on lower(k.segmentId) = s.g where tenantName = 'tenant amber' and u is not null")
def q_user_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keyphrases of each user in the workspace of one name."""
    ws = graph.root_eq(table(spark, d, "tenants"), "tenantName", "tenant amber").select(dashed(F.col("tenantId")).alias("ws"))
    s = table(spark, d, "segment_requests").select(dashed(F.col("tenantId")).alias("ws"), dashed(F.col("contextId")).alias("c"), dashed(F.col("instanceId")).alias("i"), dashed(F.col("id")).alias("segment"), dashed(F.col("spokenBy")).alias("user")).dropna()
    k = table(spark, d, "keyphrases").select(dashed(F.col("segmentId")).alias("segment"), F.col("originalForm").alias("keyword"))
    return s.join(ws, "ws", "left_semi").join(k, "segment").select("user", "keyword").distinct()


_UN = f"select distinct {_ID('spokenBy')} u from segment_requests where spokenBy is not null union select spokenBy from speakers"


@query(f"select u as user, coalesce(min(speakerName), u) \"name\" from ({_UN}) left join speakers on spokenBy = u group by u")
def q_user_name(spark: SparkSession, d: str) -> DataFrame:
    """Each user's name, else the id."""
    who = table(spark, d, "speakers").select(dashed(F.col("spokenBy")).alias("user"), "speakerName")
    all_of = table(spark, d, "segment_requests").where("spokenBy is not null").select(dashed(F.col("spokenBy")).alias("user")).union(who.select("user")).distinct()
    names = who.groupBy("user").agg(F.min("speakerName").alias("n"))
    return all_of.join(names, "user", "left").select("user", F.coalesce("n", "user").alias("name"))


@query(f"select distinct k.kp_id, {_ID('s.instanceId')} || '/' || {_ID('s.id')} || '.vec' uri from keyphrases k join segment_requests s on {_ID('s.id')} = lower(k.segmentId) where s.instanceId is not null")
def q_segment_uris(spark: SparkSession, d: str) -> DataFrame:
    """Where the vectors of each keyphrase's segment are stored."""
    s = table(spark, d, "segment_requests").where("id is not null and instanceId is not null").select(dashed(F.col("id")).alias("segment"), dashed(F.col("instanceId")).alias("session")).distinct()
    k = table(spark, d, "keyphrases").select("kp_id", dashed(F.col("segmentId")).alias("segment"))
    return k.join(s, "segment").select("kp_id", F.concat(F.concat_ws("/", "session", "segment"), F.lit(".vec")).alias("uri")).distinct()


@query()
def q_schema(spark: SparkSession, d: str) -> DataFrame:
    """(``table``, ``column``, ``type``) of the graph's tables."""
    rows = [(n, f.name, f.dataType.simpleString()) for n, t in (("vertices", _vertices(spark, d)), ("edges", _edges(spark, d))) for f in t.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string")


# ETL: the vertices as an older producer wrote them, with the attribute in place of the type

_ATTR = {"Context": "contextId", "ContextSession": "instanceId", "TranscriptionSegment": "segmentId", "User": "authorId", "TranscriptionProvider": "segmentProvider", "Source": "sourceId", "Mind": "mindId", "Keyphrase": "importantKeywords"}


def _old_vertices(spark: SparkSession, d: str) -> DataFrame:
    attribute = F.create_map(*[F.lit(x) for kv in _ATTR.items() for x in kv])
    return _vertices(spark, d).select("xid", F.try_element_at(attribute, F.col("type")).alias("attribute"), "name")


_OLD = "select xid, case \"type\" " + " ".join(f"when '{k}' then '{v}'" for k, v in _ATTR.items()) + " end attribute, name from gv"


@query(_G + f"select xid, case attribute when 'authorId' then 'userId' when 'importantKeywords' then 'segmentKeywords' else attribute end label from ({_OLD})")
def rename_labels(spark: SparkSession, d: str) -> DataFrame:
    return _old_vertices(spark, d).select("xid", etl.rename_label(F.lit(None).cast("string"), F.col("attribute")).alias("label"))


@query(_G + "select xid, coalesce(case attribute " + " ".join(f"when '{k}' then '{v}'" for k, v in etl.TYPES.items()) + f" end, 'null') \"type\" from ({_OLD})")
def type_map(spark: SparkSession, d: str) -> DataFrame:
    """The vertex type of each attribute; unknown ones (the older names, entities) have none."""
    return _old_vertices(spark, d).select("xid", etl.vertex_type(F.col("attribute")).alias("type"))


_RAW = "select distinct id x, 'segmentId' a from segment_requests where id is not null union select distinct instanceId, 'instanceId' from segment_requests where instanceId is not null union select distinct contextId, 'contextId' from segment_requests where contextId is not null"


@query(f"select distinct case when a = 'contextId' then x else {_ID('x')} end xid, a attribute from ({_RAW})")
def ids_to_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Vertices with ids as written, some of them without dashes, after the ids were unified; contexts keep theirs."""
    s = table(spark, d, "segment_requests")
    v = s.select(F.inline(F.array(*[F.struct(F.col(c).alias("xid"), F.lit(a).alias("attribute")) for c, a in (("id", "segmentId"), ("instanceId", "instanceId"), ("contextId", "contextId"))]))).where("xid is not null").distinct()
    e = s.select(F.col("instanceId").alias("src"), F.lit("hasSegment").alias("relation"), F.col("id").alias("dst")).dropna().distinct()
    return etl.ids_to_uuid(v, e)[0].distinct()


@query(_G + f"""select xid, attribute, case when trim(name) not in ('', 'nan', 'NaN', 'null', 'None') then name end as name, case when attribute = 'segmentKeywords' then 'original' end "type"
from (select xid, case attribute when 'authorId' then 'userId' when 'importantKeywords' then 'segmentKeywords' else attribute end attribute, name from ({_OLD})) where coalesce(attribute, '') <> 'wordGraph' and xid <> 'undefinedMind'""")
def cleanup_chain(spark: SparkSession, d: str) -> DataFrame:
    """The old vertices, with deprecated columns and embeddings, after the whole cleaning."""
    v = _old_vertices(spark, d).withColumn("attribute", etl.rename_label(F.lit(None).cast("string"), F.col("attribute")))
    v = v.withColumns({"keyphraseType": F.when(F.col("attribute") == "segmentKeywords", "original"), "phrase": F.col("name"), "word": F.lit("x"), "embedding_vector": F.array(F.lit(0.5))})
    return etl.cleanup(v, _edges(spark, d))[0].select("xid", "attribute", "name", "type")


@query(_G + f"select xid, attribute is null or attribute not in ('importantKeywords', 'segmentKeywords', 'segmentId') kept from ({_OLD})")
def remove_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = etl.remove_embeddings(_old_vertices(spark, d).withColumn("embedding_vector", F.array(F.lit(0.5))))
    return v.select("xid", F.col("embedding_vector").isNotNull().alias("kept"))


_USERS = f"select distinct {_ID('spokenBy')} u, {_ID('contextId')} c, {_ID('tenantId')} w from segment_requests where spokenBy is not null and contextId is not null and tenantId is not null"
_META = f"""with us as ({_USERS}), ws as (select distinct t.tenantId w, tenantName n, {_ID('s.contextId')} c, {_ID('s.mindId')} m from segment_requests s join tenants t on lower(t.tenantId) = {_ID('s.tenantId')} where s.contextId is not null),
mv as (select u xid, 'userId' attribute from us union select w, 'workspaceId' from ws union select 'ch-' || w, 'channelId' from ws union select c, 'contextId' from ws union select m, 'mindId' from ws where m is not null union select 'cu-' || w, 'customerId' from ws),
me as (select w src, 'hasMember' relation, u dst from us union select u, 'belongsTo', c from us union select c, 'belongsTo', 'ch-' || w from ws union select 'ch-' || w, 'belongsTo', w from ws union select w, 'belongsTo', 'cu-' || w from ws union select c, 'associatedMind', m from ws where m is not null) """


def _meta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Users and workspaces (tenants; one channel and customer each) in the form of the metadata files."""
    s = table(spark, d, "segment_requests")
    users = s.where("spokenBy is not null and contextId is not null and tenantId is not null").select(dashed(F.col("spokenBy")).alias("user_id"), dashed(F.col("contextId")).alias("context_id"), F.to_json(F.struct(dashed(F.col("tenantId")).alias("workspaceId"))).alias("user_attributes")).distinct()
    t = table(spark, d, "tenants").select(dashed(F.col("tenantId")).alias("workspace_id"), F.col("tenantName").alias("workspace_name"))
    c = s.where("contextId is not null").select(dashed(F.col("tenantId")).alias("workspace_id"), dashed(F.col("contextId")).alias("context_id"), dashed(F.col("mindId")).alias("mind_id")).distinct().join(t, "workspace_id")
    id_of = lambda p: F.concat(F.lit(p), F.col("workspace_id"))
    return users, c.withColumns({"channel_id": id_of("ch-"), "channel_name": F.lit("main"), "customer_id": id_of("cu-")})


@query(_META + "select xid, attribute from mv")
def meta_nodes(spark: SparkSession, d: str) -> DataFrame:
    return etl.meta_graph(*_meta(spark, d))[0].select("xid", "attribute")


@query(_META + "select src, relation, dst from me")
def meta_edges(spark: SparkSession, d: str) -> DataFrame:
    return etl.meta_graph(*_meta(spark, d))[1]


# Topics


@query()
def sentence_features(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its number in its session and its vector (of the pluggable encoder)."""
    s = table(spark, d, "segment_requests").where("originalText is not null and instanceId is not null").select("seg_row_id", dashed(F.col("instanceId")).alias("session"), text.sentences(F.col("originalText")).alias("l"))
    return topics.numbered_sentences(s, "session", "seg_row_id", "l").withColumn("vec", tagging.encode(F.col("sentence"), 16)).select("seg_row_id", "pos", "idx", F.to_json(F.transform("vec", lambda x: F.round(x, 6))).alias("vec"))


_SENT_SQL = "list_filter(string_split(regexp_replace(trim(originalText), '([.?!])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: s <> '')"


@query(f"select seg_row_id, pos, row_number() over (partition by session order by seg_row_id, pos) - 1 idx from (select seg_row_id, session, unnest(range(len(l))) pos from (select seg_row_id, {_ID('instanceId')} session, {_SENT_SQL} l from segment_requests where originalText is not null and instanceId is not null))")
def sentence_index(spark: SparkSession, d: str) -> DataFrame:
    """The number of each sentence in its session."""
    s = table(spark, d, "segment_requests").where("originalText is not null and instanceId is not null").select("seg_row_id", dashed(F.col("instanceId")).alias("session"), text.sentences(F.col("originalText")).alias("l"))
    return topics.numbered_sentences(s, "session", "seg_row_id", "l").select("seg_row_id", "pos", "idx")


@query("select 's' || (vec_id // 20) session, label community, array_to_string(list(vec_id order by vec_id), ',') sentences from embeddings group by 1, 2")
def clusters_from_partition(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of each community (here: label) of a session of twenty."""
    v = rq._vectors(spark, d).select(F.concat(F.lit("s"), F.expr("vec_id div 20").cast("string")).alias("session"), F.col("vec_id").alias("sentence"), F.col("label").alias("community"))
    return v.groupBy("session", "community").agg(F.array_join(F.transform(F.sort_array(F.collect_list("sentence")), lambda x: x.cast("string")), ",").alias("sentences"))


@query(f"select seg_row_id, row_number() over (partition by {_ID('instanceId')} order by seg_row_id) - 1 new_ord from segment_requests where instanceId is not null and originalText <> ''")
def reindex_order(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the segments with a text among those of their session."""
    s = table(spark, d, "segment_requests").where("instanceId is not null and originalText <> ''").select("seg_row_id", dashed(F.col("instanceId")).alias("session"))
    return topics.compact_order(s, "session", "seg_row_id").select("seg_row_id", "new_ord")


_FIVE = f"select {_ID('instanceId')} session, seg_row_id segment, seg_row_id // 5 * 5 grp, originalText t from segment_requests where instanceId is not null"


@query(f"select session, segment, case when len(string_split(t, ' ')) > 3 then grp else segment end \"group\" from ({_FIVE})")
def readd_removed(spark: SparkSession, d: str) -> DataFrame:
    """Groups of five neighbours without the short segments, which return as groups of their own."""
    s = table(spark, d, "segment_requests").where("instanceId is not null").select(dashed(F.col("instanceId")).alias("session"), F.col("seg_row_id").alias("segment"), (F.expr("seg_row_id div 5") * 5).alias("group"), F.col("originalText").alias("t"))
    return topics.readd_removed(s.where("size(split(t, ' ')) > 3").select("session", "segment", "group"), s, "session")


@query(f"select session, grp \"group\", count(*) n, cast(sum(len(coalesce(t, ''))) as bigint) chars, arg_min(segment, segment) first from ({_FIVE}) group by 1, 2")
def restore_text(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their segments' original texts: their number, length and first segment."""
    s = table(spark, d, "segment_requests").where("instanceId is not null").select(dashed(F.col("instanceId")).alias("session"), F.col("seg_row_id").alias("segment"), (F.expr("seg_row_id div 5") * 5).alias("group"))
    texts = table(spark, d, "segment_requests").select(F.col("seg_row_id").alias("segment"), F.col("originalText").alias("text"))
    return s.join(texts, "segment").groupBy("session", "group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.min("segment").alias("first"))


@query()
def get_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of each session; a session without any has its five sentences nearest to a mind."""
    groups = cut(rq.h_communities(spark, d).select("session", F.col("group").cast("bigint").alias("group"), "rank"))
    v = rq._sentence_vectors(spark, d)
    best = topics.mind_scores(v.withColumnRenamed("sentence", "k"), rq._minds(spark, d), "k").join(v.select(F.col("sentence").alias("k"), "session"), "k").join(groups, "session", "left_anti")
    five = graph.first_per_parent(best, "session", 5, [F.desc("score"), F.asc("k")])
    return groups.unionByName(five.select("session", F.col("k").alias("group"), F.lit(1).cast("bigint").alias("rank")))


@query(f"select session, grp \"group\", '[' || string_agg(segment, ',' order by segment) || ']' segments from ({_FIVE}) group by 1, 2")
def format_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group's segments as JSON. A group is a few neighbours, not a session."""
    s = table(spark, d, "segment_requests").where("instanceId is not null").select(dashed(F.col("instanceId")).alias("session"), F.col("seg_row_id").alias("segment"), (F.expr("seg_row_id div 5") * 5).alias("group"))
    return s.groupBy("session", "group").agg(F.to_json(F.sort_array(F.collect_list("segment"))).alias("segments"))


@query(f"select vec_id, round(max((s + 0.7 * case when label = mind then 1.0 else 0.0 end) / 2), 9) score from ({rq._MS}) join embeddings using (vec_id) group by 1")
def pims_score(spark: SparkSession, d: str) -> DataFrame:
    """Best mean of cosine and damped next-sentence score (1 for the vector's own label) over the minds."""
    s = topics.pim_scores(rq._vectors(spark, d), rq._minds(spark, d), "vec_id", lambda mind: (F.col("label") == mind).cast("double"))
    return s.withColumn("score", F.round("score", 9))


_SHORT = "case when contains(originalText, '.') then array_to_string(list_transform(list_filter(string_split(originalText, '.'), lambda s: len(string_split(s, ' ')) > 3), lambda s: trim(s)), '. ') else '' end"


@query(f"""select kp_id, round(case when n < 40 then 0.1 * s else s end, 9) score, round(1 / nullif(case when n < 40 then 0.1 * s else s end, 0), 6) distance
from (select kp_id, score.segsim s, len(string_split({_SHORT}, ' ')) n from keyphrases k join (select {_ID('id')} i, arg_min(originalText, seg_row_id) originalText from segment_requests where originalText is not null group by 1) t on t.i = lower(k.segmentId) where score.segsim is not null and not isnan(score.segsim))""")
def pims_penalty_distance(spark: SparkSession, d: str) -> DataFrame:
    """Similarity and distance of each keyphrase, penalised where its segment has fewer than forty words."""
    texts = table(spark, d, "segment_requests").where("originalText is not null").groupBy(dashed(F.col("id")).alias("segment")).agg(F.min_by("originalText", "seg_row_id").alias("t"))
    k = table(spark, d, "keyphrases").where("score.segsim is not null and not isnan(score.segsim)").select("kp_id", dashed(F.col("segmentId")).alias("segment"), F.col("score.segsim").alias("s"))
    n = F.size(F.split(text.split_sentences_short(F.col("t")), " "))
    score, distance = topics.segment_distance(F.col("s"), n)
    return k.join(texts, "segment").select("kp_id", F.round(score, 9).alias("score"), F.round(distance, 6).alias("distance"))


# Recommendation


@query(f"select query, m.user, matches / 64.0::double score from ({rq._MT}) m")
def word_search(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each query and label over the vectors' length."""
    return rq.lsh_query(spark, d).select("query", "user", (F.col("matches") / 64.0).alias("score"))


@query("select transcriptId transcript, unnest(list(distinct spokenBy)) as user from speakers group by 1")
def active_participants(spark: SparkSession, d: str) -> DataFrame:
    """Who attends, from replies in JSON with ids without dashes."""
    reply = F.to_json(F.struct(F.collect_list(F.struct(F.regexp_replace("spokenBy", "-", "").alias("sourceUserId"))).alias("attendees")))
    r = table(spark, d, "speakers").groupBy(F.col("transcriptId").alias("transcript")).agg(reply.alias("reply"))
    return r.select("transcript", F.explode(recommend.participants(F.col("reply"))).alias("user")).distinct()


_UM = f"with rr as (select * from (select *, row_number() over (partition by query, \"user\" order by s desc, item) r from ({rq._RR})) where r <= 10), sim as (select \"user\", avg(s) similarity from rr where query = 0 group by 1), us as ({rq._US})"


def _similar(spark: SparkSession, d: str) -> DataFrame:
    v = rq._vectors(spark, d)
    return recommend.rerank_all(v.where("vec_id = 0").select(F.col("vec_id").alias("query"), "vec"), v.select(F.col("label").alias("user"), F.col("vec_id").alias("item"), "vec")).select("user", F.col("phrase_score").alias("similarity"))


@query(_UM + " select sim.user, round(similarity, 9) similarity, round(coalesce(v1, (select min(v1) from us)), 9) hash_score, round(similarity * coalesce(v1, (select min(v1) from us)), 9) confidence from sim left join us on us.user = sim.user")
def user_meta(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each user for the first vector: similarity times hash score."""
    c = recommend.confidence(_similar(spark, d), rq._user_scores(spark, d).select("user", F.col("v1").alias("hash_score")), "user")
    return c.select("user", *[F.round(x, 9).alias(x) for x in ("similarity", "hash_score", "confidence")])


@query(_UM + ", c as (select sim.user, similarity * coalesce(v1, (select min(v1) from us)) confidence from sim left join us on us.user = sim.user where sim.user not in (select label from embeddings where vec_id < 3)) select \"user\", confidence >= (select quantile_cont(confidence, 0.75) from c) suggested from c")
def post_process_users(spark: SparkSession, d: str) -> DataFrame:
    """Users other than those of the first three vectors; the best quarter is suggested."""
    speakers = rq._vectors(spark, d).where("vec_id < 3").select(F.col("label").alias("user"))
    c = recommend.confidence(_similar(spark, d), rq._user_scores(spark, d).select("user", F.col("v1").alias("hash_score")), "user")
    return recommend.suggested_users(c, "confidence", speakers).select("user", "suggested")


@query(f"""select distinct * from (select {_ID('spokenBy')} as user, 'keyword' kind, lower(x) "value" from (select spokenBy, unnest(list_transform(keyphrases, lambda k: k.originalForm)) x from segment_requests)
union all select {_ID('spokenBy')}, 'segment', {_ID('id')} from segment_requests union all select {_ID('spokenBy')}, 'context', {_ID('contextId')} from segment_requests)
where "user" is not null and "value" is not null and "user" <> (select min({_ID('spokenBy')}) from segment_requests)""")
def user_profiles_v2(spark: SparkSession, d: str) -> DataFrame:
    """What each user said, where and in which segments; the first user is on the blacklist."""
    s = table(spark, d, "segment_requests").withColumn("u", dashed(F.col("spokenBy")))
    words = F.transform(F.coalesce(F.col("keyphrases")["originalForm"], F.array().cast("array<string>")), F.lower)
    return recommend.profile_rows(s, "u", {"keyword": words, "segment": F.array(dashed(F.col("id"))), "context": F.array(dashed(F.col("contextId")))}, s.agg(F.min("u").alias("user")))


@query(f"select label as user, i, round(avg(x), 9) x, count(*) n from (select label, unnest(range({rq.DIM})) i, unnest(vec) x from ({rq._V})) group by 1, 2")
def user_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each user and how many vectors it stands for, one row per dimension."""
    v = rq._vectors(spark, d).select(F.col("label").alias("user"), F.posexplode("vec").alias("i", "x"))
    return v.groupBy("user", F.col("i").cast("bigint").alias("i")).agg(F.round(F.avg("x"), 9).alias("x"), F.count(F.lit(1)).alias("n"))


def _top_words(spark: SparkSession, d: str) -> DataFrame:
    """(``user``, ``phrases``): the fifty best keyphrases of each speaker."""
    s = table(spark, d, "segment_requests").where("id is not null and spokenBy is not null").groupBy(dashed(F.col("id")).alias("segment")).agg(F.min_by(dashed(F.col("spokenBy")), "seg_row_id").alias("user"))
    k = table(spark, d, "keyphrases").where(rq._OK).select(dashed(F.col("segmentId")).alias("segment"), F.lower("originalForm").alias("phrase"), F.col("score.boosted_sim").alias("b"))
    best = k.join(s, "segment").groupBy("user", "phrase").agg(F.max("b").alias("b"))
    top = graph.first_per_parent(best, "user", 50, [F.desc("b"), F.asc("phrase")])
    return top.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("b")).alias("s"), "phrase"))), lambda x: x["phrase"]).alias("phrases"))


@query()
def filter_related_words(spark: SparkSession, d: str) -> DataFrame:
    """Of each speaker's best phrases those most like a query."""
    r = recommend.related_words(_top_words(spark, d), F.lit("release plan"), ["NN", "NNS", "NNP", "JJ"])
    return r.select("user", F.to_json("words").alias("words"))


@query()
def get_watchers(spark: SparkSession, d: str) -> DataFrame:
    """Whom to recommend for a query, end to end: similarity and hash score of the labels, explained by a speaker's words each."""
    c = recommend.confidence(_similar(spark, d), rq._user_scores(spark, d).select("user", F.col("v1").alias("hash_score")), "user").select("user", "similarity", "hash_score")
    words = graph.first_per_parent(_top_words(spark, d).withColumn("o", F.lit(1)), "o", 10, [F.asc("user")]).withColumn("n", F.pmod(F.xxhash64("user"), F.lit(10)))
    words = words.select(F.concat(F.lit("label_"), F.col("n").cast("string")).alias("user"), "phrases").groupBy("user").agg(F.min("phrases").alias("phrases"))
    speakers = rq._vectors(spark, d).where("vec_id < 3").select(F.col("label").cast("string").alias("user"))
    out = recommend.watchers(c.withColumn("user", F.col("user").cast("string")), speakers, words, F.lit("release plan"))
    return out.select("user", F.round("confidence", 9).alias("confidence"), "rank", "suggested", F.array_join("words", "|").alias("words"))


# Requests


@query('select request_id, contextId, instanceId, mindId, relativeTime, "limit" wish, populateGraph, not populateGraph highlight, (select count(*) from segment_requests s where s.instanceId = r.instanceId) n_segments from requests r')
def src_json_request(spark: SparkSession, d: str) -> DataFrame:
    """Requests as JSON texts, read back: their fields and the number of their segments."""
    n = table(spark, d, "segment_requests").groupBy("instanceId").agg(F.collect_list(F.struct("id", "originalText")).alias("segments"))
    r = table(spark, d, "requests").drop("highlight").join(n, "instanceId", "left")
    raw = r.select("request_id", F.to_json(F.struct("contextId", "instanceId", "mindId", "relativeTime", "limit", "populateGraph", "segments")).alias("v"))
    got = io.decode_requests(raw.select("request_id", F.col("v")), F.col("v"), ["request_id"])
    return got.select("request_id", "contextId", "instanceId", "mindId", "relativeTime", F.col("limit").alias("wish"), "populateGraph", "highlight", F.coalesce(F.size("segments"), F.lit(0)).cast("bigint").alias("n_segments"))


@query(f"select {_ID('id')} id, originalText \"text\", {_ID('spokenBy')} speaker, lower(mindId) mind from segment_requests where originalText is not null")
def src_scorer_request(spark: SparkSession, d: str) -> DataFrame:
    """Scorer requests as JSON texts, read back."""
    raw = table(spark, d, "segment_requests").where("originalText is not null").select(F.to_json(F.struct("mindId", F.array(F.struct("id", "originalText", "spokenBy")).alias("segments"))).alias("v"))
    return io.scorer_requests(raw, F.col("v"))


@query(f"select {_ID('recordingId')} recording, groupId \"group\" from recorded_segments where recordingId is not null and groupId is not null group by 1, 2")
def src_topic_pims_request(spark: SparkSession, d: str) -> DataFrame:
    """Topic requests as JSON texts (one per recording), read back with the groups inverted."""
    r = table(spark, d, "recorded_segments").where("recordingId is not null and groupId is not null").select(dashed(F.col("recordingId")).alias("recordingId"), "groupId").distinct()
    groups = F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.col("groupId").cast("string").alias("k"), F.array(F.struct("recordingId")).alias("v")))))
    raw = r.groupBy("recordingId").agg(F.to_json(F.struct(groups.alias("groups"))).alias("v"))
    return io.topic_pim_groups(raw, F.col("v"))


@query(_G + "select xid \"~id\", \"type\" \"~label\", coalesce(name, '') \"name:string\" from gv")
def graphml_to_csv(spark: SparkSession, d: str) -> DataFrame:
    """The vertices in the columns of a graph store's CSV."""
    return io.node_columns(_vertices(spark, d), "xid", "type")


@query()
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The keyphrases of each session most like its best one."""
    k = table(spark, d, "keyphrases").where(rq._OK).groupBy(dashed(F.col("instanceId")).alias("user"), "originalForm").agg(F.max("score.boosted_sim").alias("b"))
    top = graph.first_per_parent(k, "user", 50, [F.desc("b"), F.asc("originalForm")])
    lists = top.groupBy("user").agg(F.max_by("originalForm", "b").alias("q"), F.sort_array(F.collect_list("originalForm")).alias("p"))
    return lists.select(F.col("user").alias("session"), F.to_json(ranking.best_matches(F.col("q"), F.col("p"))).alias("words"))
