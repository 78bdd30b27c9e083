"""Property graph as tables: vertices, edges, keyed merges and query primitives.

``vertices(xid, type, ...)`` and ``edges(src, relation, dst)``. Keys of phrases and entities are sha1 of their lower-case text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed
from colloquy.runtime import broadcast_if_small


def phrase_key(text: Column) -> Column:
    return F.sha1(F.lower(text))


def segment_vertices(segments: DataFrame) -> DataFrame:
    """(``xid``, ``type``, ``name``): contexts, sessions, segments, users, providers, sources, minds, keyphrases and entities."""
    s = lambda kind, xid, name=None: F.struct(xid.alias("xid"), F.lit(kind).alias("type"), (name if name is not None else F.lit(None).cast("string")).alias("name"))
    c = F.col
    plain = F.array(
        s("Context", dashed(c("contextId"))), s("ContextSession", dashed(c("instanceId"))), s("TranscriptionSegment", dashed(c("id"))), s("User", dashed(c("spokenBy"))),
        s("TranscriptionProvider", c("transcriber"), c("transcriber")), s("Source", dashed(c("recordingId"))), s("Mind", dashed(c("mindId"))),
    )
    listed = lambda col, kind: F.transform(F.coalesce(F.col(col)["originalForm"], F.array().cast("array<string>")), lambda x: s(kind, phrase_key(x), F.lower(x)))
    rows = segments.select(F.inline(F.concat(plain, listed("keyphrases", "Keyphrase"), listed("entities", "Entity"))))
    return rows.where("xid is not null").distinct()


def segment_edges(segments: DataFrame) -> DataFrame:
    """(``src``, ``relation``, ``dst``), each once."""
    e = lambda a, r, b: F.struct(a.alias("src"), F.lit(r).alias("relation"), b.alias("dst"))
    x = lambda n: dashed(F.col(n))
    plain = F.array(
        e(x("contextId"), "hasMeeting", x("instanceId")), e(x("instanceId"), "associatedMind", x("mindId")), e(x("instanceId"), "hasSegment", x("id")), e(x("id"), "authoredBy", x("spokenBy")),
        e(x("id"), "providedBy", F.col("transcriber")), e(x("id"), "hasSource", x("recordingId")), e(x("contextId"), "hasMember", x("spokenBy")),
    )
    listed = lambda col, r, a: F.transform(F.coalesce(F.col(col)["originalForm"], F.array().cast("array<string>")), lambda v: e(x(a), r, phrase_key(v)))
    rows = segments.select(F.inline(F.concat(plain, listed("keyphrases", "hasKeywords", "id"), listed("entities", "hasEntities", "id"), listed("entities", "userEntities", "spokenBy"))))
    return rows.where("src is not null and dst is not null").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Keyed merge: per ``key`` and column the latest value that is not null, by ``seq``; rows of both sides."""
    both = old.unionByName(new, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, seq)]
    return both.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each ``by`` by ``order``."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def grouped_with(edges: DataFrame, relation: str, chunk: int = 64) -> DataFrame:
    """(``user``, ``other``, ``groups``): pairs that share an endpoint of ``relation``, with the number of shared endpoints.

    Members of a large group are dealt by hash into chunks of about ``chunk``, and each pair of chunks is work of its own:
    no task holds a group. A pair is counted once, on the map side first, and given out in both directions.
    """
    a = edges.where(F.col("relation") == relation).select("src", F.col("dst").alias("user")).where("src is not null and user is not null").distinct()
    large = a.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_n")).where("_n > 1")
    placed = a.join(broadcast_if_small(large), "src", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    parts = placed.groupBy("src", "_n", F.pmod(F.xxhash64("user"), F.col("_n")).cast("int").alias("_p")).agg(F.collect_list("user").alias("_x"))
    left = parts.select("src", "_p", "_x", F.explode(F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda q: q >= F.col("_p"))).alias("_q"))
    met = left.join(parts.select("src", F.col("_p").alias("_q"), F.col("_x").alias("_y")), ["src", "_q"])
    one = lambda v: F.transform(F.filter("_y", lambda w: (F.col("_p") < F.col("_q")) | (w > v)), lambda w: F.struct(F.least(v, w).alias("a"), F.greatest(v, w).alias("b")))
    pairs = met.select(F.inline(F.flatten(F.transform("_x", one)))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"))
    both = F.array(F.struct(F.col("a").alias("user"), F.col("b").alias("other")), F.struct(F.col("b").alias("user"), F.col("a").alias("other")))
    return pairs.select(F.inline(both), "groups").select("user", "other", "groups")


def any_of_terms(text: Column, terms: list[str]) -> Column:
    """Whole words, any of them, whatever the case."""
    return F.arrays_overlap(F.split(F.lower(text), r"\W+"), F.array(*[F.lit(t.lower()) for t in terms]))


def expand(parents: DataFrame, edges: DataFrame, relation: str, child: str, cascade: bool = False, reverse: bool = False) -> DataFrame:
    """Follows ``relation`` from ``xid`` (backwards with ``reverse``) into column ``child``; with ``cascade`` childless rows go."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.where(F.col("relation") == relation).select(F.col(a).alias("xid"), F.col(b).alias(child))
    return parents.join(e, "xid", "inner" if cascade else "left")


def root_eq(vertices: DataFrame, column: str, value) -> DataFrame:
    """``func: eq(column, value)``: the vertices to start from."""
    return vertices.where(F.col(column) == F.lit(value))


def by_uid(rows: DataFrame, uids: DataFrame, column: str = "xid") -> DataFrame:
    """``@filter(uid(...))``: rows whose ``column`` is among the ``xid`` of ``uids``."""
    return rows.join(uids.select(F.col("xid").alias(column)).distinct(), column, "left_semi")


def normalize(parents: DataFrame, edges: DataFrame, path: list[tuple[str, str]], root: str) -> DataFrame:
    """``@normalize @cascade``: the flat rows of all walks along ``path`` [(relation, alias)...] from ``xid``, named ``root``.

    A relation that begins with ``~`` is followed backwards. Walks that end early are left out.
    """
    rows = parents.select(F.col("xid").alias(root), "xid")
    for relation, alias in path:
        rows = expand(rows, edges, relation.lstrip("~"), alias, cascade=True, reverse=relation.startswith("~")).withColumn("xid", F.col(alias))
    return rows.select(root, *[alias for _, alias in path]).distinct()


def run_query(text: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """A read-only query over ``tables`` (as ``{name}`` in the text) with named parameters (``:name``)."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, args=args, **tables)


def summary_edges(segments: DataFrame) -> DataFrame:
    """(``src``, ``relation``, ``dst``) of summary groups: segment belongsTo group, group hasUser user, user groupedWith user.

    ``segments`` is (``segment``, ``group``, ``user``).
    """
    s = segments.where("group is not null")
    plain = s.select(F.inline(F.array(F.struct(F.col("segment").alias("src"), F.lit("belongsTo").alias("relation"), F.col("group").alias("dst")), F.struct(F.col("group").alias("src"), F.lit("hasUser").alias("relation"), F.col("user").alias("dst")))))
    plain = plain.where("src is not null and dst is not null").distinct()
    pairs = grouped_with(plain, "hasUser").select(F.col("user").alias("src"), F.lit("groupedWith").alias("relation"), F.col("other").alias("dst"))
    return plain.unionByName(pairs)


def first_per_parent(df: DataFrame, parent: str, n: int, order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def count_by(edges: DataFrame, relation: str, by: str, what: str) -> DataFrame:
    """``@groupby``: (``by``, ``n``) distinct ``what`` per value."""
    return edges.where(F.col("relation") == relation).groupBy(by).agg(F.countDistinct(what).alias("n"))


def nested_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(``xid``, ``doc``): one JSON document per vertex with its out-edges, sorted, by relation."""
    rel = edges.groupBy("src", "relation").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    out = rel.groupBy("src").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "to")))).alias("edges"))
    return vertices.join(out, vertices["xid"] == out["src"], "left").select("xid", F.to_json(F.struct("type", "name", "edges")).alias("doc"))
