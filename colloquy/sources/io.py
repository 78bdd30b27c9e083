"""Readers and writers: JSON requests, CSV metadata, graph tables, GraphML, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.ids import dashed

_TEXTS = ("id", "originalText", "startTime", "endTime", "recordingId", "spokenBy", "languageCode", "transcriber", "status", "transcriptId", "createdAt", "updatedAt", "deletedAt", "tenantId")
SEGMENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in _TEXTS],
    T.StructField("duration", T.LongType()), T.StructField("confidence", T.DoubleType()), T.StructField("deleted", T.BooleanType()),
])
REQUEST = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("contextId", "instanceId", "mindId", "relativeTime")],
    T.StructField("limit", T.IntegerType()), T.StructField("populateGraph", T.BooleanType()), T.StructField("segments", T.ArrayType(SEGMENT)),
])


def decode_requests(df: DataFrame, value: Column, keep: list[str] = ()) -> DataFrame:
    """JSON requests (an object or a list of them) as rows; ``highlight`` = not populateGraph; ``raw`` keeps unknown keys, ``keep`` names columns that stay.

    A text that is no JSON gives a row of nulls.
    """
    one = F.from_json(value, REQUEST)
    many = F.when(value.rlike(r"^\s*\["), F.from_json(value, T.ArrayType(REQUEST))).otherwise(F.array(one))
    rows = df.select(*keep, F.explode_outer(many).alias("r"), value.alias("raw"))
    return rows.select(*keep, "r.*", "raw").withColumn("highlight", ~F.col("populateGraph"))


def request_segments(requests: DataFrame) -> DataFrame:
    """One row per segment with a text, ids dashed, ``ord`` = rank by startTime within the request from 0."""
    s = requests.select("contextId", "instanceId", "mindId", F.inline("segments")).where("trim(originalText) <> ''")
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("contextId", "instanceId").orderBy(F.try_to_timestamp("startTime"), "id")) - 1
    return s.withColumns({"id": dashed(F.col("id")), "spokenBy": dashed(F.col("spokenBy")), "ord": order.cast("bigint")})


def scorer_requests(df: DataFrame, value: Column) -> DataFrame:
    """(``id``, ``text``, ``speaker``, ``mind``): the segments of JSON scorer requests, ids dashed, the mind in lower case. No JSON, no rows."""
    r = df.select(F.from_json(value, "mindId string, segments array<struct<id:string,originalText:string,spokenBy:string>>").alias("r")).select(F.lower("r.mindId").alias("mind"), F.inline("r.segments"))
    return r.select(dashed(F.col("id")).alias("id"), F.col("originalText").alias("text"), dashed(F.col("spokenBy")).alias("speaker"), "mind")


def topic_pim_groups(df: DataFrame, value: Column) -> DataFrame:
    """(``recording``, ``group``) of JSON topic requests: which groups each recording is in."""
    groups = F.from_json(value, "groups map<string,array<struct<recordingId:string>>>")["groups"]
    each = df.select(F.explode(groups).alias("group", "members")).select("group", F.explode("members.recordingId").alias("recording"))
    return each.where("recording is not null").select(dashed(F.col("recording")).alias("recording"), "group").distinct()


def topic_pim_distances(df: DataFrame, value: Column) -> DataFrame:
    """(``recording``, ``distance``) of the segments of JSON topic requests."""
    segments = F.from_json(value, "pims struct<segments:array<struct<recordingId:string,distance:double>>>")["pims"]["segments"]
    return df.select(F.inline(segments)).select(dashed(F.col("recordingId")).alias("recording"), "distance")


_STORE_TYPES = {"string": "string", "int": "int", "bigint": "long", "double": "double", "boolean": "bool", "timestamp": "date"}


def node_columns(rows: DataFrame, xid: str, label: str) -> DataFrame:
    """A graph store's node columns: ``~id``, ``~label`` and ``name:type`` for every other column, missing values empty."""
    rest = [f for f in rows.schema.fields if f.name not in (xid, label)]
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f"{f.name}:{_STORE_TYPES.get(f.dataType.simpleString(), 'string')}") for f in rest]
    return rows.select(F.col(xid).alias("~id"), F.coalesce(label, F.lit("node")).alias("~label"), *cells)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return decode_requests(spark.read.text(path, wholetext=True), F.col("value"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header whose names may be padded; all columns text."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.strip() for c in df.columns])


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as parquet, partitioned by type and relation."""
    vertices.write.mode("overwrite").partitionBy("type").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_neptune_csv(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """``~id, ~label, name:string`` and ``~id, ~from, ~to, ~label``; missing attributes are empty."""
    v = vertices.select(F.col("xid").alias("~id"), F.coalesce("type", F.lit("node")).alias("~label"), F.col("name").alias("name:string"))
    e = edges.select(F.concat_ws("_", "src", "dst").alias("~id"), F.col("src").alias("~from"), F.col("dst").alias("~to"), F.coalesce("relation", F.lit("edge")).alias("~label"))
    v.write.mode("overwrite").csv(f"{path}/nodes", header=True, emptyValue="", nullValue="")
    e.write.mode("overwrite").csv(f"{path}/edges", header=True, emptyValue="", nullValue="")


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as GraphML elements, one XML file set each (``<graph>`` as root)."""
    data = lambda **c: F.array(*[F.struct(F.lit(k).alias("_key"), F.coalesce(F.col(v), F.lit("")).alias("_VALUE")) for k, v in c.items()])
    v = vertices.select(F.col("xid").alias("_id"), data(attribute="type", name="name").alias("data"))
    e = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), data(relation="relation").alias("data"))
    v.write.mode("overwrite").format("xml").option("rootTag", "graph").option("rowTag", "node").save(f"{path}/nodes")
    e.write.mode("overwrite").format("xml").option("rootTag", "graph").option("rowTag", "edge").save(f"{path}/edges")


_DATA = "array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, path: str, keys: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of GraphML files; ``keys`` renames generated key ids (``d0``) to attribute names."""
    names = F.create_map(*[F.lit(x) for kv in (keys or {"": ""}).items() for x in kv])
    attr = lambda n: F.get(F.filter("data", lambda d: F.coalesce(F.try_element_at(names, d["_key"]), d["_key"]) == n), F.lit(0))["_VALUE"]
    v = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {_DATA}").load(f"{path}/nodes")
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {_DATA}").load(f"{path}/edges")
    return v.select(F.col("_id").alias("xid"), attr("attribute").alias("type"), attr("name").alias("name")), e.select(F.col("_source").alias("src"), attr("relation").alias("relation"), F.col("_target").alias("dst"))


def write_features(features: DataFrame, path: str) -> None:
    """(contextId, instanceId, key, vec): one partition folder per context, keyed rows inside."""
    features.write.mode("overwrite").partitionBy("contextId").parquet(path)
