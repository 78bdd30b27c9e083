"""Cleaning of graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed

#: Attribute names written by older producers and what they are called now.
RENAMED = {"authorId": "userId", "importantKeywords": "segmentKeywords", "keyphraseType": "type"}
#: Attribute -> vertex type.
TYPES = {
    "contextId": "Context", "instanceId": "ContextSession", "segmentId": "TranscriptionSegment", "userId": "User", "mindId": "Mind", "workspaceId": "Workspace", "channelId": "Channel",
    "sourceId": "Source", "segmentProvider": "TranscriptionProvider", "importantKeywords": "Keyphrase", "segmentKeywords": "Keyphrase", "customerId": "Customer", "markerId": "Marker",
}
#: Attributes whose ids are UUIDs; attributes of keyphrases that are no longer written.
UUID_ATTRIBUTES = ["userId", "instanceId", "segmentId", "sourceId", "workspaceId"]
DEPRECATED = ["phraseId", "phrase", "word"]


def none_values(c: Column) -> Column:
    """'', 'nan', 'NaN', 'null' and 'None' become null."""
    return F.when(~F.trim(c).isin("", "nan", "NaN", "null", "None"), c)


def rename_label(label: Column, attribute: Column) -> Column:
    """The label, else the attribute, under its present name."""
    c = F.coalesce(label, attribute)
    out = c
    for old, new in RENAMED.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def vertex_type(attribute: Column) -> Column:
    out = F.lit("null")
    for k, v in TYPES.items():
        out = F.when(attribute == k, v).otherwise(out)
    return out


def reformat_datetime(c: Column) -> Column:
    """A readable timestamp as ISO UTC text with microseconds; anything else stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), c)


def drop_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without those whose ``xid`` is in ``gone``."""
    g = gone.select("xid").distinct()
    e = edges.join(g.withColumnRenamed("xid", "src"), "src", "left_anti").join(g.withColumnRenamed("xid", "dst"), "dst", "left_anti")
    return vertices.join(g, "xid", "left_anti"), e.select("src", "relation", "dst")


def transitive(edges: DataFrame, one: str, two: str, relation: str) -> DataFrame:
    """a -one-> b -two-> c gives c -``relation``-> a; per a only the largest c."""
    ab = edges.where(F.col("relation") == one).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    bc = edges.where(F.col("relation") == two).select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return ab.join(bc, "b").groupBy("a").agg(F.max("c").alias("src")).select("src", F.lit(relation).alias("relation"), F.col("a").alias("dst"))


def spoken_keywords(keywords: DataFrame, texts: DataFrame, segment: str) -> DataFrame:
    """Keyword rows whose ``phrase`` occurs in the ``text`` of their segment; a missing text holds nothing."""
    j = keywords.join(texts, segment, "left")
    return j.where(F.position(F.col("phrase"), F.coalesce("text", F.lit(""))) > 0).drop("text")


def ids_to_uuid(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of UUID_ATTRIBUTES in dashed form, in the vertices (``xid``, ``attribute``, ...) and at both ends of the edges.

    A vertex without attribute that has a ``hasMember`` edge is a workspace.
    """
    members = edges.where("relation = 'hasMember'").select(F.col("src").alias("xid"), F.lit(True).alias("_w")).distinct()
    v = vertices.join(members, "xid", "left")
    uuid = F.col("attribute").isin(UUID_ATTRIBUTES) | (F.col("attribute").isNull() & F.coalesce("_w", F.lit(False)))
    marked = v.withColumn("_new", F.when(F.coalesce(uuid, F.lit(False)), dashed(F.col("xid"))).otherwise(F.col("xid")))
    changed = marked.where("_new <> xid").select("xid", "_new").distinct()
    ends = edges.join(changed.select(F.col("xid").alias("src"), F.col("_new").alias("_s")), "src", "left").join(changed.select(F.col("xid").alias("dst"), F.col("_new").alias("_d")), "dst", "left")
    out = ends.select(F.coalesce("_s", "src").alias("src"), "relation", F.coalesce("_d", "dst").alias("dst"))
    return marked.select(F.col("_new").alias("xid"), *[c for c in vertices.columns if c != "xid"]), out


def drop_deprecated(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keyphraseType`` of keyphrases becomes ``type``, DEPRECATED columns and embeddings go, an avatar's parts become columns, and the vertex ``undefinedMind`` goes with its edges."""
    v = vertices.where("xid <> 'undefinedMind'")
    if "keyphraseType" in v.columns:
        v = v.withColumn("type", F.when(F.col("attribute") == "segmentKeywords", F.coalesce("keyphraseType", F.lit(""))).otherwise(F.col("type") if "type" in vertices.columns else F.lit(None).cast("string"))).drop("keyphraseType")
    if "avatars" in v.columns:
        v = v.withColumns({"avatars_image192": F.col("avatars.image192"), "avatars_imageOriginal": F.col("avatars.imageOriginal")}).drop("avatars")
    return v.drop(*DEPRECATED), edges.where("src <> 'undefinedMind' and dst <> 'undefinedMind'")


def remove_embeddings(vertices: DataFrame) -> DataFrame:
    """``embedding_vector`` goes from keyphrases and segments; other vertices keep theirs."""
    if "embedding_vector" not in vertices.columns:
        return vertices
    gone = F.col("attribute").isin("segmentKeywords", "importantKeywords", "segmentId")
    return vertices.withColumn("embedding_vector", F.when(~F.coalesce(gone, F.lit(False)), F.col("embedding_vector")))


def cleanup(vertices: DataFrame, edges: DataFrame, times: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning, in order: deprecated attributes, word graphs, embeddings, timestamps (``times``), empty values."""
    v, e = drop_deprecated(vertices, edges)
    v, e = drop_vertices(v, e, v.where("attribute = 'wordGraph'"))
    v = remove_embeddings(v)
    v = v.withColumns({c: reformat_datetime(F.col(c)) for c in times})
    return v.withColumns({f.name: none_values(F.col(f.name)) for f in v.schema.fields if f.dataType.simpleString() == "string" and f.name != "xid"}), e


def meta_graph(users: DataFrame, workspaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (``xid``, ``attribute``, ``name``) and edges of users, workspaces, channels, contexts, minds and customers.

    ``users`` is (``user_id``, ``context_id``, ``user_attributes`` JSON with ``workspaceId`` and ``name``); ``workspaces`` is (``workspace_id``,
    ``workspace_name``, ``channel_id``, ``channel_name``, ``context_id``, ``mind_id``, ``customer_id``). Null ids give nothing.
    """
    info = F.from_json("user_attributes", "name string, workspaceId string")
    u = users.select("user_id", "context_id", info["name"].alias("name"), info["workspaceId"].alias("workspace"))
    node = lambda xid, attribute, name=None: F.struct(F.col(xid).alias("xid"), F.lit(attribute).alias("attribute"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"))
    edge = lambda a, r, b: F.struct(F.col(a).alias("src"), F.lit(r).alias("relation"), F.col(b).alias("dst"))
    w_nodes = F.array(node("workspace_id", "workspaceId", "workspace_name"), node("channel_id", "channelId", "channel_name"), node("context_id", "contextId"), node("mind_id", "mindId"), node("customer_id", "customerId"))
    w_edges = F.array(edge("context_id", "belongsTo", "channel_id"), edge("channel_id", "belongsTo", "workspace_id"), edge("workspace_id", "belongsTo", "customer_id"), edge("context_id", "associatedMind", "mind_id"))
    v = u.select(F.inline(F.array(node("user_id", "userId", "name")))).unionByName(workspaces.select(F.inline(w_nodes)))
    e = u.select(F.inline(F.array(edge("workspace", "hasMember", "user_id"), edge("user_id", "belongsTo", "context_id")))).unionByName(workspaces.select(F.inline(w_edges)))
    return v.where("xid is not null").groupBy("xid", "attribute").agg(F.max("name").alias("name")), e.where("src is not null and dst is not null").distinct()
