"""Word graph, property graph and ETL queries over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed
from colloquy.functions.tagging import CLOSED
from colloquy.functions.text import STOP_WORDS
from colloquy.operators import etl, graph, wordgraph
from colloquy.runtime import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
_ID = "regexp_replace(replace(lower({0}), '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')".format


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_requests")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return wordgraph.build_word_graph(_segments(spark, d), dashed(F.col("instanceId")), F.col("originalText"))


_W = f"select seg_row_id, {_ID('instanceId')} graph, list_filter(regexp_extract_all(lower(originalText), '[a-z]+'), lambda w: not list_contains({_STOP}, w) and len(w) > 1) w from segment_requests where originalText is not null"
_TOKENS = f"select graph, seg_row_id text_id, unnest(range(len(w))) pos, unnest(w) word from ({_W})"
_EDGES = f"select distinct a.graph, least(a.word, b.word) src, greatest(a.word, b.word) dst from ({_TOKENS}) a join ({_TOKENS}) b on a.graph = b.graph and a.text_id = b.text_id and b.pos - a.pos between 1 and 3 and a.word <> b.word"
_SYM = f"select graph, src, dst from ({_EDGES}) union all select graph, dst, src from ({_EDGES})"
_DEG = f"select graph, src word, count(*) degree from ({_SYM}) group by 1, 2"


@query(_TOKENS)
def tokens_by_position(spark: SparkSession, d: str) -> DataFrame:
    t = wordgraph.text_tokens(_segments(spark, d), dashed(F.col("instanceId")), F.col("seg_row_id"), F.col("originalText"))
    return t.withColumn("pos", F.col("pos").cast("bigint"))


@query(_EDGES)
def build_word_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(_DEG)
def degree(spark: SparkSession, d: str) -> DataFrame:
    return wordgraph.degree(_edges(spark, d))


@query(f"select word, cast(sum(degree) as bigint) total_degree, count(*) sessions from ({_DEG}) group by 1 order by 2 desc, 1 limit 25")
def cooccurrence_top_words(spark: SparkSession, d: str) -> DataFrame:
    """The 25 words with most neighbours over all session graphs."""
    deg = degree(spark, d).groupBy("word").agg(F.sum("degree").alias("total_degree"), F.count(F.lit(1)).alias("sessions"))
    return deg.orderBy(F.desc("total_degree"), "word").limit(25)


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 as (select graph, word, 1.0 / (select count(*) from deg e where e.graph = deg.graph) r from deg)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} as (select s.graph, s.dst word, 0.15 / n + 0.85 * sum(r / degree) r from sym s join deg on deg.graph = s.graph and deg.word = s.src join r{i - 1} p on p.graph = s.graph and p.word = s.src join n on n.graph = s.graph group by s.graph, s.dst, n)")
    return f"with e as materialized ({_EDGES}), sym as materialized (select * from e union all select graph, dst, src from e), deg as materialized (select graph, src word, count(*) degree from sym group by 1, 2), n as materialized (select graph, count(*) n from deg group by 1), " + ", ".join(steps)


@query(_pagerank_sql(8) + " select graph, word, round(r, 9) pagerank from r8")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Eight rounds, rounded to nine digits."""
    return wordgraph.pagerank(_edges(spark, d), 8).withColumn("pagerank", F.round("pagerank", 9))


@query(_pagerank_sql(8) + " select r8.graph, r8.word, round(r / degree, 9) score from r8 join deg on deg.graph = r8.graph and deg.word = r8.word")
def normalize_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = cut(_edges(spark, d))
    return wordgraph.normalize_by_degree(wordgraph.pagerank(e, 8), wordgraph.degree(e)).select("graph", "word", F.round("score", 9).alias("score"))


@query()
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    return wordgraph.pagerank(_edges(spark, d), 100, 1e-4)


@query()
def betweenness_closeness(spark: SparkSession, d: str) -> DataFrame:
    return wordgraph.centrality(_edges(spark, d))


def _marked(spark: SparkSession, d: str, ranked: bool = False) -> DataFrame:
    """All tokens; those of the session's word graph have a score: ``ranked``, their degree-normalised PageRank."""
    return wordgraph.keyword_tokens(_segments(spark, d), dashed(F.col("instanceId")), F.col("seg_row_id"), F.col("originalText"), ranked=ranked)


def _words_sql(*tags: str) -> str:
    return "[" + ", ".join("'" + w + "'" for t in tags for w in CLOSED[t].split()) + "]"


# The default tagger as a rule in SQL: which words are nodes of the graph (syn), which of them plural nouns (nns).
_SUFFIXED = " or ".join(f"(low like '%{x}' and len(low) > {len(x) + 2})" for x in ("ous", "ful", "able", "ive", "al", "ic"))
_NO_NODE = " or ".join(f"(low like '%{x}' and len(low) > {len(x) + 2})" for x in ("ly", "ing", "ed"))
_PLAIN = "not list_contains(" + _words_sql(*CLOSED) + ", low) and not regexp_full_match(tok, '[\\d.,:]+') and regexp_matches(tok, '[\\p{L}\\p{N}_]')"
_SING = "(case when len({0}) < 4 or regexp_matches({0}, '(?:ss|us|is)$') then {0} when {0} like '%ies' then {0}[:-4] || 'y' when regexp_matches({0}, '(?:sses|xes|ches|shes)$') then {0}[:-3] when {0} like '%s' then {0}[:-2] else {0} end)".format
_MARKED = f"""with tk as (select seg_row_id text_id, graph, unnest(range(len(l))) pos, unnest(l) tok from (select seg_row_id, {_ID('instanceId')} graph, regexp_extract_all(originalText, '[\\p{{L}}\\p{{N}}_]+(?:[''-][\\p{{L}}\\p{{N}}_]+)*|[^\\p{{L}}\\p{{N}}_\\s]') l from segment_requests where originalText is not null)),
tg as (select *, list_contains({_words_sql("VB")}, low) or ({_PLAIN} and not ({_NO_NODE})) syn, {_PLAIN} and not ({_NO_NODE} or {_SUFFIXED}) and not regexp_matches(tok, '^\\p{{Lu}}') and low like '%s' and low not like '%ss' and len(low) > 3 nns from (select *, lower(tok) low from tk)),
ns as (select distinct graph, case when nns then {_SING('low')} else low end node from tg where syn and not list_contains({_STOP}, low)),
pl as (select distinct text_id, low from tg where nns),
mk as (select tg.text_id, tg.pos, tg.low word, tg.graph, case when pl.low is not null then 'p' when a.node is not null then 'k' else 'e' end tag, coalesce(pl.low is not null or (a.node is not null and not list_contains({_STOP}, tg.low)), false) marked
  from tg left join pl on pl.text_id = tg.text_id and pl.low = tg.low left join ns a on a.graph is not distinct from tg.graph and a.node = tg.low left join ns b on b.graph is not distinct from tg.graph and b.node = {_SING('tg.low')}
  where pl.low is null or b.node is not null) """


@query(_MARKED + "select text_id, pos, word, tag from mk")
def tag_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("text_id", "pos", "word", "tag")


_RUNS = f"""{_MARKED}, rn as (select text_id, string_agg(word, ' ' order by pos) phrase, min(pos) "start", any_value(graph) graph from (
  select *, sum(case when marked then 0 else 1 end) over (partition by text_id order by pos) i, max(pos) over (partition by text_id) last from mk) where marked group by text_id, i having max(pos) < max(last)) """


@query(_RUNS + 'select text_id, phrase, "start" from rn')
def multi_keyterms(spark: SparkSession, d: str) -> DataFrame:
    """Runs of keywords; their scores are :func:`term_scores`."""
    return wordgraph.keyword_runs(_marked(spark, d)).select("text_id", "phrase", "start")


def _runs(spark: SparkSession, d: str, ranked: bool = False) -> DataFrame:
    texts = _segments(spark, d).select(F.col("seg_row_id").alias("text_id"), dashed(F.col("instanceId")).alias("graph"))
    return wordgraph.keyword_runs(_marked(spark, d, ranked)).join(texts, "text_id")


def _run_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("graph", "phrase").distinct()


@query()
def term_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sum and maximum of the words' degree-normalised PageRank per phrase."""
    return wordgraph.run_scores(_runs(spark, d, ranked=True))


@query(_RUNS + """, p as materialized (select distinct graph, phrase from rn where len(list_distinct(string_split(phrase, ' '))) = len(string_split(phrase, ' ')) and len(list_filter(string_split(phrase, ' '), lambda t: len(t) < 2)) = 0)
select graph, phrase from p where not exists (select 1 from p o where o.graph is not distinct from p.graph and o.phrase <> p.phrase and contains(' ' || o.phrase || ' ', ' ' || p.phrase || ' '))""")
def post_process_phrases(spark: SparkSession, d: str) -> DataFrame:
    return wordgraph.clean_phrases(cut(_run_phrases(spark, d)))


@query()
def get_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each session's phrases, cleaned."""
    scored = cut(term_scores(spark, d))
    kept = wordgraph.clean_phrases(scored.select("graph", "phrase"))
    return wordgraph.top_phrases(scored.join(kept, ["graph", "phrase"], "left_semi").withColumnRenamed("score_sum", "score")).select("graph", "phrase", "score", "rank")


# Property graph

_LIST = "unnest(list_transform({0}, lambda k: k.originalForm))".format
_VERTICES = f"""select distinct * from (
 select {_ID('contextId')} xid, 'Context' "type", null::varchar name from segment_requests union all select {_ID('instanceId')}, 'ContextSession', null from segment_requests
 union all select {_ID('id')}, 'TranscriptionSegment', null from segment_requests union all select {_ID('spokenBy')}, 'User', null from segment_requests
 union all select transcriber, 'TranscriptionProvider', transcriber from segment_requests union all select {_ID('recordingId')}, 'Source', null from segment_requests
 union all select {_ID('mindId')}, 'Mind', null from segment_requests
 union all select sha1(lower(x)), 'Keyphrase', lower(x) from (select {_LIST('keyphrases')} x from segment_requests)
 union all select sha1(lower(x)), 'Entity', lower(x) from (select {_LIST('entities')} x from segment_requests)) where xid is not null"""
_GEDGES = f"""select distinct * from (
 select {_ID('contextId')} src, 'hasMeeting' relation, {_ID('instanceId')} dst from segment_requests union all select {_ID('instanceId')}, 'associatedMind', {_ID('mindId')} from segment_requests
 union all select {_ID('instanceId')}, 'hasSegment', {_ID('id')} from segment_requests union all select {_ID('id')}, 'authoredBy', {_ID('spokenBy')} from segment_requests
 union all select {_ID('id')}, 'providedBy', transcriber from segment_requests union all select {_ID('id')}, 'hasSource', {_ID('recordingId')} from segment_requests
 union all select {_ID('contextId')}, 'hasMember', {_ID('spokenBy')} from segment_requests
 union all select i, 'hasKeywords', sha1(lower(x)) from (select {_ID('id')} i, {_LIST('keyphrases')} x from segment_requests)
 union all select i, 'hasEntities', sha1(lower(x)) from (select {_ID('id')} i, {_LIST('entities')} x from segment_requests)
 union all select i, 'userEntities', sha1(lower(x)) from (select {_ID('spokenBy')} i, {_LIST('entities')} x from segment_requests)) where src is not null and dst is not null"""


@query(_VERTICES)
def populate_segments_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.segment_vertices(_segments(spark, d))


@query(_GEDGES)
def populate_segments_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.segment_edges(_segments(spark, d))


def _rel(name: str) -> str:
    return f"(select src, dst from ge where relation = '{name}')"


_G = f"with ge as materialized ({_GEDGES}), gv as materialized ({_VERTICES}) "


@query(_G + f"select k.dst keyword, count(distinct a.dst) n from {_rel('hasKeywords')} k join {_rel('authoredBy')} a on a.src = k.src group by 1")
def keyword_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct speakers per keyphrase."""
    e = populate_segments_edges(spark, d)
    k, a = (e.where(F.col("relation") == r) for r in ("hasKeywords", "authoredBy"))
    return k.select("src", F.col("dst").alias("keyword")).join(a.select("src", "dst"), "src").groupBy("keyword").agg(F.countDistinct("dst").alias("n"))


_TERMS = ["release", "hiring"]
_ANY = "list_has_any(regexp_split_to_array(lower(name), '\\W+'), ['release', 'hiring'])"


@query(_G + f"select xid, name from gv where \"type\" = 'Keyphrase' and {_ANY}")
def g_anyofterms(spark: SparkSession, d: str) -> DataFrame:
    v = populate_segments_vertices(spark, d)
    return v.where((F.col("type") == "Keyphrase") & graph.any_of_terms(F.col("name"), _TERMS)).select("xid", "name")


@query(_G + f"select a.dst as user, count(distinct k.src) n from gv join {_rel('hasKeywords')} k on k.dst = gv.xid join {_rel('authoredBy')} a on a.src = k.src where \"type\" = 'Keyphrase' and {_ANY} group by 1")
def q_subject_experts(spark: SparkSession, d: str) -> DataFrame:
    """Who spoke in how many segments about the terms: reverse hasKeywords, then authoredBy."""
    e = populate_segments_edges(spark, d)
    said = graph.expand(g_anyofterms(spark, d), e, "hasKeywords", "segment", cascade=True, reverse=True)
    by = graph.expand(said.select(F.col("segment").alias("xid")).distinct(), e, "authoredBy", "user", cascade=True)
    return by.groupBy("user").agg(F.countDistinct("xid").alias("n"))


@query(_G + "select src xid, dst segment from (select gv.xid src, e.dst from gv left join (select * from ge where relation = 'hasSegment') e on e.src = gv.xid where gv.\"type\" = 'ContextSession')")
def g_expand(spark: SparkSession, d: str) -> DataFrame:
    v = populate_segments_vertices(spark, d).where("type = 'ContextSession'").select("xid")
    return graph.expand(v, populate_segments_edges(spark, d), "hasSegment", "segment")


@query(_G + "select gv.xid, e.dst as user from gv join (select * from ge where relation = 'authoredBy') e on e.src = gv.xid where gv.\"type\" = 'TranscriptionSegment'")
def g_cascade(spark: SparkSession, d: str) -> DataFrame:
    v = populate_segments_vertices(spark, d).where("type = 'TranscriptionSegment'").select("xid")
    return graph.expand(v, populate_segments_edges(spark, d), "authoredBy", "user", cascade=True)


@query(_G + "select dst xid, src context from ge where relation = 'hasMeeting'")
def g_reverse(spark: SparkSession, d: str) -> DataFrame:
    v = populate_segments_vertices(spark, d).where("type = 'ContextSession'").select("xid")
    return graph.expand(v, populate_segments_edges(spark, d), "hasMeeting", "context", cascade=True, reverse=True)


@query(_G + "select src, dst from (select *, row_number() over (partition by src order by dst) r from ge where relation = 'hasSegment') where r <= 3")
def g_first(spark: SparkSession, d: str) -> DataFrame:
    e = populate_segments_edges(spark, d).where("relation = 'hasSegment'").select("src", "dst")
    return graph.first_per_parent(e, "src", 3, [F.asc("dst")])


@query(_G + "select dst, count(distinct src) n from ge where relation = 'hasKeywords' group by 1")
def g_groupby_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.count_by(populate_segments_edges(spark, d), "hasKeywords", "dst", "src")


@query(_G + "select src xid from ge where relation = 'associatedMind' and dst in (select dst from (select dst, count(*) n from ge where relation = 'associatedMind' group by 1 order by 2 desc, 1 limit 1))")
def g_var_uid(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the most used mind: a value variable, then a semi-join."""
    e = populate_segments_edges(spark, d).where("relation = 'associatedMind'")
    top = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1)
    return e.join(top, "dst", "left_semi").select(F.col("src").alias("xid"))


@query(_G + "select distinct m.src context, s.dst segment, a.dst as user, k.dst keyword from ge m join ge s on s.src = m.dst join ge a on a.src = s.dst join ge k on k.src = s.dst where m.relation = 'hasMeeting' and s.relation = 'hasSegment' and a.relation = 'authoredBy' and k.relation = 'hasKeywords'")
def q_context_user_info(spark: SparkSession, d: str) -> DataFrame:
    e = populate_segments_edges(spark, d)
    r = lambda n, a, b: e.where(F.col("relation") == n).select(F.col("src").alias(a), F.col("dst").alias(b))
    return r("hasMeeting", "context", "i").join(r("hasSegment", "i", "segment"), "i").join(r("authoredBy", "segment", "user"), "segment").join(r("hasKeywords", "segment", "keyword"), "segment").select("context", "segment", "user", "keyword").distinct()


@query("""
with m as (select recordingId r, groupId g, spokenBy u from recorded_segments where groupId is not null and spokenBy is not null),
e as (select distinct """ + _ID("r") + " || ':' || cast(g as varchar) src, " + _ID("u") + """ u from m)
select a.u as user, b.u other, count(*) groups from e a join e b on a.src = b.src and a.u <> b.u group by 1, 2""")
def q_related_users(spark: SparkSession, d: str) -> DataFrame:
    """Users in the same group of a recording, with the number of such groups."""
    r = table(spark, d, "recorded_segments").where("groupId is not null and spokenBy is not null")
    e = r.select(F.concat(dashed(F.col("recordingId")), F.lit(":"), F.col("groupId").cast("string")).alias("src"), F.lit("hasUser").alias("relation"), dashed(F.col("spokenBy")).alias("dst")).distinct()
    return graph.grouped_with(e, "hasUser")


@query("select " + _ID("id") + """ xid, max(seg_row_id) seq, arg_max(transcriber, seg_row_id) filter (transcriber is not null) transcriber, arg_max(languageCode, seg_row_id) filter (languageCode is not null) lang
from segment_requests group by 1""")
def mutate(spark: SparkSession, d: str) -> DataFrame:
    """Keyed merge of the segments in two halves: the latest known value of each column."""
    s = _segments(spark, d).select(dashed(F.col("id")).alias("xid"), F.col("seg_row_id").alias("seq"), "transcriber", F.col("languageCode").alias("lang"))
    return graph.upsert(s.where("seq % 2 = 0"), s.where("seq % 2 = 1"), "xid", "seq")


@query("select user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) state, epoch_us(max(ts)) at_us from events group by 1")
def user_membership(spark: SparkSession, d: str) -> DataFrame:
    """Latest event of each user."""
    from colloquy.operators.intervals import micros

    e = graph.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return e.select("user_id", F.col("event_type").alias("state"), micros(F.col("ts")).alias("at_us"))


@query()
def graph_to_nested_json(spark: SparkSession, d: str) -> DataFrame:
    return graph.nested_json(populate_segments_vertices(spark, d), populate_segments_edges(spark, d))


# ETL


@query("select sp_row_id, case when trim(spokenBy) not in ('', 'nan', 'NaN', 'null', 'None') then spokenBy end as value from spoken_segments")
def none_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spoken_segments").select("sp_row_id", etl.none_values(F.col("spokenBy")).alias("value"))


@query()
def reformat_datetime(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where("createdAt is not null").select("seg_row_id", etl.reformat_datetime(F.col("createdAt")).alias("value"))


@query(_G + "select src, relation, dst from ge where not exists (select 1 from gv where \"type\" = 'Mind' and (gv.xid = ge.src or gv.xid = ge.dst))")
def remove_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Edges left when all Mind vertices go."""
    v, e = populate_segments_vertices(spark, d), populate_segments_edges(spark, d)
    return etl.drop_vertices(v, e, v.where("type = 'Mind'"))[1]


@query(_G + "select max(m.src) src, 'hasUser' relation, u.dst dst from ge m join ge s on s.src = m.dst and s.relation = 'hasSegment' join ge u on u.src = s.dst and u.relation = 'authoredBy' where m.relation = 'hasMeeting' group by u.dst")
def transitive_has_user(spark: SparkSession, d: str) -> DataFrame:
    """User -> session -> context gives context hasUser user, one context per user."""
    e = populate_segments_edges(spark, d)
    s, u = (e.where(F.col("relation") == r) for r in ("hasSegment", "authoredBy"))
    in_session = s.select(F.col("src").alias("i"), F.col("dst").alias("g")).join(u.select(F.col("src").alias("g"), F.col("dst").alias("u")), "g").select(F.col("u").alias("src"), F.lit("in").alias("relation"), F.col("i").alias("dst")).distinct()
    back = e.where("relation = 'hasMeeting'").select(F.col("dst").alias("src"), F.lit("of").alias("relation"), F.col("src").alias("dst"))
    return etl.transitive(in_session.unionByName(back), "in", "of", "hasUser")


@query()
def keyword_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keyphrase rows whose phrase occurs in their segment's text (that of the first delivery)."""
    texts = _segments(spark, d).where("originalText is not null").groupBy(dashed(F.col("id")).alias("segment")).agg(F.min_by("originalText", "seg_row_id").alias("text"))
    k = table(spark, d, "keyphrases").select("kp_id", dashed(F.col("segmentId")).alias("segment"), F.col("originalForm").alias("phrase"))
    return etl.spoken_keywords(k, texts, "segment").select("kp_id", "phrase")


SQL["keyword_edge_filter"] = f"""select kp_id, originalForm phrase from keyphrases k join (select {_ID('id')} i, arg_min(originalText, seg_row_id) t from segment_requests where originalText is not null group by 1) s
on s.i = k.segmentId where contains(t, originalForm)"""


@query(_G + "select \"type\", count(*) n from gv group by 1")
def vertex_types(spark: SparkSession, d: str) -> DataFrame:
    return populate_segments_vertices(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
