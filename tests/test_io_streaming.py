import json
import time

from pyspark.sql import functions as F

from colloquy.sources import io
from colloquy.streaming import sessions


def test_json_requests(spark):
    seg = {"id": "A67E29E01F0E4010B2207F110E22D905", "originalText": "hi there", "startTime": "2020-01-01T00:00:02Z"}
    req = {"contextId": "c", "instanceId": "i", "populateGraph": False, "segments": [seg, {**seg, "id": "x", "startTime": "2020-01-01T00:00:01Z"}, {"id": "y", "originalText": " "}], "other": 1}
    df = spark.createDataFrame([(json.dumps(req),), (json.dumps([req, {"contextId": "d"}]),), ("no json",)], "value string")
    rows = io.decode_requests(df, F.col("value"))
    assert rows.count() == 4 and rows.where("highlight").count() == 2
    segs = io.request_segments(rows.limit(1)).orderBy("ord").collect()
    assert [(r["id"], r["ord"]) for r in segs] == [("x", 0), ("a67e29e0-1f0e-4010-b220-7f110e22d905", 1)]


def test_graph_files(spark, tmp_path):
    v = spark.createDataFrame([("a", "User", "Ann"), ("b", "Mind", None)], "xid string, type string, name string")
    e = spark.createDataFrame([("a", "likes", "b")], "src string, relation string, dst string")
    io.write_graph(v, e, str(tmp_path / "g"))
    v2, e2 = io.read_graph(spark, str(tmp_path / "g"))
    assert v2.count() == 2 and e2.first()["relation"] == "likes"
    io.write_graphml(v, e, str(tmp_path / "x"))
    v3, e3 = io.read_graphml(spark, str(tmp_path / "x"))
    assert sorted((r["xid"], r["type"]) for r in v3.collect()) == [("a", "User"), ("b", "Mind")]
    assert tuple(e3.first()) == ("a", "likes", "b")
    io.write_neptune_csv(v, e, str(tmp_path / "n"))
    assert io.read_csv(spark, str(tmp_path / "n/edges")).columns == ["~id", "~from", "~to", "~label"]


def test_padded_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("mind_id , context_id\n1,2\n")
    assert io.read_csv(spark, str(tmp_path / "m.csv")).columns == ["mind_id", "context_id"]


def _stream(spark, tmp_path, rows, schema):
    src = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"p{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))


def test_session_state(spark, tmp_path):
    rows = [[("s", 1, "started", "m"), ("s", 2, "segment", None), ("s", 3, "segment", None), ("t", 1, "segment", None), ("u", 1, "started", "n"), ("u", 2, "ended", None)]]
    q = sessions.session_state(_stream(spark, tmp_path, rows, "session string, seq long, event string, mind string"), "default")
    run = q.writeStream.outputMode("update").format("memory").queryName("session_state").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(90):  # with timeouts set, the query never runs out of batches
        if spark.table("session_state").count() >= 3:
            break
        time.sleep(0.5)
    run.stop()
    got = {r["session"]: (r["mind"], r["segments"], r["ended"]) for r in spark.table("session_state").collect()}
    assert got == {"s": ("m", 2, False), "t": ("default", 1, False), "u": ("n", 0, True)}


def test_incremental_word_graph_equals_batch(spark, tmp_path):
    from colloquy.operators.wordgraph import build_word_graph

    rows = [[("g", "alpha beta gamma")], [("g", "alpha beta delta"), ("h", "one two")]]
    stream = _stream(spark, tmp_path, rows, "graph string, text string")
    path = str(tmp_path / "edges")
    run = stream.writeStream.foreachBatch(sessions.merge_word_graph(path)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    batch = build_word_graph(spark.createDataFrame([r for p in rows for r in p], "graph string, text string"), F.col("graph"), F.col("text"))
    assert sorted(map(tuple, spark.read.parquet(path).select("graph", "src", "dst").collect())) == sorted(map(tuple, batch.collect()))


def test_membership_latest_wins(spark):
    e = spark.createDataFrame([("c", "u", "added", 2), ("c", "u", "removed", 1)], "contextId string, userId string, state string, at int")
    assert sessions.membership(e).first()["state"] == "added"


def test_windowed_counts(spark, tmp_path):
    rows = [[("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:07:00", "b")]]
    s = _stream(spark, tmp_path, rows, "t string, event_type string").withColumn("ts", F.to_timestamp("t"))
    run = sessions.windowed_counts(s, "ts").writeStream.outputMode("complete").format("memory").queryName("wc").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("wc").collect()) == [1, 2]


def test_keyed_store(spark, tmp_path):
    from datetime import datetime

    from colloquy.streaming import services

    at = lambda s: datetime(2020, 1, 1, 0, 0, s)
    path = str(tmp_path / "kv")
    rows = [("a", "k", "1", at(0), None), ("a", "k", "2", at(2), 10), ("a", "gone", "x", at(0), None), ("a", "gone", None, at(1), None), ("b", "k", "3", at(0), None), ("b", None, "4", at(0), 1)]
    services.store_set(spark.createDataFrame(rows, "store string, key string, value string, at timestamp, ttl_s int"), path)
    get = lambda s, store=None, p=path: sorted((r["store"], r["key"] or "", r["value"]) for r in services.store_get(spark, p, F.lit(at(s)), store).collect())
    assert get(1) == [("a", "k", "1"), ("b", "k", "3")] and get(5) == [("a", "k", "2"), ("b", "k", "3")] and get(30, "a") == [] and get(0, "a") == [("a", "gone", "x"), ("a", "k", "1")]
    services.store_compact(spark, path, str(tmp_path / "kv2"), F.lit(at(5)))
    assert get(5, p=str(tmp_path / "kv2")) == get(5) and spark.read.parquet(str(tmp_path / "kv2")).count() == 2


def test_replies_and_forwards_come_once(spark, tmp_path):
    from colloquy.streaming import services

    schema = "subject string, contextId string, instanceId string, mindId string, at long"
    e = spark.createDataFrame([("context.instance.started", "A" * 32, "B" * 32, "M", 1), ("context.instance.ended", "a" * 32, "b" * 32, None, 2), ("other", "c", "d", None, 3), ("context.instance.created", "x", None, None, 1)], schema)
    e.write.json(str(tmp_path / "in"))
    answer = services.reply(lambda b: b.groupBy("subject").count(), str(tmp_path / "out"))
    sink = services.both(answer, services.forward({"other": "graph.other"}, str(tmp_path / "fwd")))
    q = spark.readStream.schema(schema).json(str(tmp_path / "in")).writeStream.foreachBatch(lambda b, i: (sink(b, i), sink(b, i))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    services.unsubscribe([q])
    assert spark.read.json(str(tmp_path / "out")).count() == 4 and [r["subject"] for r in spark.read.json(str(tmp_path / "fwd")).collect()] == ["graph.other"]
    life = services.lifecycle(e).collect()
    assert [(r["state"], r["mind"], r["at"]) for r in life] == [("ended", "m", 2)] and services.lifecycle(e.limit(0)).count() == 0
    assert [r["v"] for r in e.select(services.variant(F.col("contextId"), ["x"]).alias("v")).collect()] == ["v1", "v1", "v1", "v2"]
    r = spark.createDataFrame([("1",), ("2",)], "request string")
    a = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "request string, attendees string, at long")
    assert sorted((x["request"], x["attendees"]) for x in services.with_attendees(r, a).collect()) == [("1", "new"), ("2", None)]
