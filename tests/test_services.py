import pytest
from pyspark.sql import functions as F

from colloquy.functions import tagging
from colloquy.operators import actions, etl, graph, ranking, recommend, topics
from colloquy.runtime import bounded_rows, running
from colloquy.sources import io


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_running_equals_a_plain_window(spark, how, chunk):
    data = [("a", i, (i * 7) % 5) for i in range(12)] + [("b", 3, 1), ("c", 0, None)]
    df = spark.createDataFrame(data, "k string, o long, v long").withColumn("c", F.floor(F.col("o") / chunk))
    got = rows(running(df, ["k"], "c", ["o"], F.col("v"), how, "r"), "k", "o", "r")
    fold = {"sum": sum, "max": max}[how]
    exp = []
    for k, o, _ in data:
        before = [v for kk, oo, v in data if kk == k and oo < o and v is not None]
        exp.append((k, o, fold(before) if before else None))
    assert got == sorted(exp, key=repr)


def test_bounded_rows_do_not_cut(spark):
    assert len(bounded_rows(spark.range(3), 3, "x")) == 3
    with pytest.raises(ValueError, match="more than 2"):
        bounded_rows(spark.range(3), 2, "x")


def test_grouped_with_by_brute_force(spark):
    groups = {"big": [f"u{i:03d}" for i in range(150)], "a": ["u001", "u002", "x"], "one": ["x"], "none": []}
    e = spark.createDataFrame([(g, "r", u) for g, us in groups.items() for u in us] + [("a", "r", "u001"), ("a", "other", "y"), (None, "r", "z")], "src string, relation string, dst string")
    exp = {}
    for us in groups.values():
        for a in us:
            for b in us:
                if a != b:
                    exp[a, b] = exp.get((a, b), 0) + 1
    assert rows(graph.grouped_with(e, "r"), "user", "other", "groups") == sorted(((a, b, n) for (a, b), n in exp.items()), key=repr)
    assert graph.grouped_with(e.limit(0), "r").count() == 0


def test_walks_summaries_and_parameters(spark):
    e = spark.createDataFrame([("c", "m", "s1"), ("c", "m", "s2"), ("s1", "h", "g"), ("u", "w", "s1")], "src string, relation string, dst string")
    v = spark.createDataFrame([("c", "x"), ("d", None)], "xid string, name string")
    assert rows(graph.normalize(v, e, [("m", "s"), ("h", "g")], "c"), "c", "s", "g") == [("c", "s1", "g")]
    assert rows(graph.normalize(v, e, [("m", "s"), ("~w", "u")], "c"), "c", "s", "u") == [("c", "s1", "u")]
    assert rows(graph.by_uid(v, spark.createDataFrame([("d",), ("d",)], "xid string")), "xid") == [("d",)]
    assert rows(graph.root_eq(v, "name", "x"), "xid") == [("c",)]
    assert graph.run_query("select * from {e} where relation = :r", {"e": e}, r="m").count() == 2
    s = spark.createDataFrame([("g1", "G", "a"), ("g2", "G", "b"), ("g3", None, "c"), (None, "G", None)], "segment string, group string, user string")
    assert rows(graph.summary_edges(s), "src", "relation", "dst") == [("G", "hasUser", "a"), ("G", "hasUser", "b"), ("a", "groupedWith", "b"), ("b", "groupedWith", "a"), ("g1", "belongsTo", "G"), ("g2", "belongsTo", "G")]


PHRASES = "row_id long, segment string, kind string, phrase string, type string, pagerank double, preference int"


def test_locations(spark):
    p = spark.createDataFrame([
        (1, "s", "keyphrase", "red car", "descriptive", 0.1, None), (2, "s", "keyphrase", "Red Car", "descriptive", 0.1, None), (3, "s", "entity", "Red", None, 0.1, 1),
        (4, "s", "entity", "r*d", None, None, 1), (5, "t", "keyphrase", "", "original", None, None), (6, "gone", "entity", "x", None, 0.1, 1),
    ], PHRASES)
    seg = spark.createDataFrame([("s", "i", "the red car r*d", 100), ("t", "i", "", 160)], "segment string, session string, text string, seconds long")
    assert rows(ranking.located(p, seg), "row_id", "offset", "loc", "removed") == [(1, 0, 4.0, False), (2, 0, None, True), (3, 0, 4.0, False), (4, 0, None, True), (5, 60, 60.0, False)]
    assert ranking.located(p.limit(0), seg).count() == 0


def test_relevance_by_hand(spark):
    p = spark.createDataFrame([(1, "i", "s", "keyphrase", "a b", "descriptive", 0.5, "x"), (2, "i", "s", "keyphrase", "a b c d e", "descriptive", None, "y"), (3, "i", "s", "entity", "", None, 0.2, "gone"), (4, "i", "t", "keyphrase", "c", "original", 0.1, "x")], "row_id long, session string, segment string, kind string, phrase string, type string, pagerank double, pk string")
    vec = spark.createDataFrame([("s", [1.0, 0.0]), ("t", [0.0, 0.0]), ("x", [1.0, 0.0]), ("y", [1.0, 1.0])], "key string, vec array<double>")
    r = ranking.local_relevance(p, vec, "segment", "pk")
    got = {x["row_id"]: (round(x["segsim"], 6), round(x["boosted"], 6)) for x in r.collect()}
    assert got == {1: (0.5, 1.0), 2: (0.353553, 0.353553), 3: (0.0, 0.2), 4: (0.0, 0.1)}
    q = ranking.segment_qualities(r)
    assert {(x["segment"], x["kind"]): (round(x["mean"], 5), round(x["median"], 5)) for x in q.collect()} == {("s", "keyphrase"): (0.67678, 0.67678), ("s", "entity"): (0.2, 0.2), ("t", "keyphrase"): (0.0, 0.0)}
    n = ranking.normalised_relevance(r, q, spark.createDataFrame([("s", 2), ("t", 1)], "segment string, sentences int"))
    assert {x["row_id"]: round(x["norm_boosted"], 5) for x in n.collect()} == {1: 2.0, 2: 0.70711, 3: 0.4, 4: 0.0}


def test_thresholds_and_related_entities(spark):
    rows_ = [
        (1, "s", "keyphrase", "red car park", None, 0.9, False), (2, "s", "keyphrase", "bus", None, 0.4, False), (3, "s", "entity", "car", 3, 0.1, False), (4, "s", "entity", "Bus", 3, 0.9, False),
        (5, "s", "entity", "New York New", 1, 0.5, False), (6, "s", "entity", "York", 1, 0.5, False), (7, "s", "entity", "Zed", 1, 0.5, True), (8, "t", "entity", "Sole", 3, 0.1, False), (9, "s", "keyphrase", "nan", None, float("nan"), False),
    ]
    p = spark.createDataFrame(rows_, "row_id long, segment string, kind string, phrase string, preference int, boosted double, removed boolean")
    r = ranking.related_entities(p)
    assert {x["row_id"]: (x["related"], x["removed"]) for x in r.where("kind = 'entity'").collect()} == {3: (True, False), 4: (True, False), 5: (False, True), 7: (False, True), 8: (False, False)}
    t = ranking.threshold_phrases(r, F.col("boosted"), F.lit(0.5))
    assert {x["row_id"]: x["removed"] for x in t.collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 7: False, 8: False, 9: False}


def test_fuzzy_matches(spark):
    assert ranking.partial_token_set_ratio("release plan", "the plan b") == 100.0 and ranking.partial_token_set_ratio("", "x") == 0.0
    df = spark.createDataFrame([(["release plan", "relase", "zzz", "", None, "release plan"],), (None,)], "p array<string>")
    got = [[(m["phrase"], round(m["score"])) for m in r["m"]] for r in df.select(ranking.best_matches(F.lit("release"), F.col("p")).alias("m")).collect()]
    assert got[0][0] == ("release plan", 100) and got[0][1][0] == "relase" and len(got[0]) == 2 and got[1] == []


def test_action_subjects():
    assert actions.subjects_of("We should send the quarterly report") == ["send the quarterly report"]
    assert actions.subjects_of("We should not send the quarterly report") == []
    assert actions.subjects_of("just we should send the report") == []
    assert actions.subjects_of("") == [] and actions.subjects_of("Nice weather") == []


def test_action_items(spark):
    s = ["I will send the quarterly report", "can you hear me now", "Can we meet tomorrow", "ok", "Should we send the report?", "let's make it happen", "you and i go home", "Let's make it happen", "i scan you all day"]
    df = spark.createDataFrame(list(enumerate(s)), "k int, s string").withColumn("j", actions.action_subjects(F.col("s")))
    out = {r["k"]: (r["item"], r["q"], r["who"]) for r in df.select("k", actions.is_action_item(F.col("s"), F.col("j")).alias("item"), actions.is_question(F.col("s"), F.col("j")).alias("q"), actions.assignee(F.col("s")).alias("who")).collect()}
    assert out == {0: (True, False, 0), 1: (False, False, 0), 2: (True, False, 0), 3: (False, False, 0), 4: (True, True, 0), 5: (True, False, 2), 6: (False, False, 2), 7: (False, False, 2), 8: (False, False, 2)}


def test_grammar_runs():
    tokens = "the old red car park sells".split()
    tags = ["DT", "JJ", "JJ", "NN", "NN", "VBZ"]
    assert tagging.chunk_tags(tokens, tags, tagging.CANDIDATES[0]) == ["old red car park"]
    assert tagging.chunk_tags(["car", ".", "bus"], ["NN", ".", "NN"], tagging.CANDIDATES[2]) == []


def test_etl_chain(spark):
    raw = "A67E29E01F0E4010B2207F110E22D905"
    v = spark.createDataFrame([(raw, "userId", "nan", None, [0.1]), (raw[::-1], None, "w", None, None), ("k", "segmentKeywords", "x", "descriptive", [0.1]), ("undefinedMind", "mindId", None, None, None), ("wg", "wordGraph", None, None, None)], "xid string, attribute string, name string, keyphraseType string, embedding_vector array<double>")
    e = spark.createDataFrame([(raw[::-1], "hasMember", raw), ("k", "r", "undefinedMind"), ("k", "has", "wg")], "src string, relation string, dst string")
    v2, e2 = etl.ids_to_uuid(v, e)
    assert "a67e29e0-1f0e-4010-b220-7f110e22d905" in {r["xid"] for r in v2.collect()} and all(len(r["src"]) == 36 for r in e2.where("relation = 'hasMember'").collect())
    c, ce = etl.cleanup(v, e)
    got = {r["xid"]: (r["name"], r["type"], r["embedding_vector"]) for r in c.collect()}
    assert got == {raw: (None, None, [0.1]), raw[::-1]: ("w", None, None), "k": ("x", "descriptive", None)}
    assert [r["relation"] for r in ce.collect()] == ["hasMember"]
    assert etl.cleanup(v.limit(0), e.limit(0))[0].count() == 0


def test_recommendation_parts(spark):
    json = spark.createDataFrame([('{"attendees":[{"sourceUserId":"' + "a" * 32 + '"},{"sourceUserId":null}]}',), ('{"attendees":null}',), ("no",), (None,)], "j string")
    assert [r["p"] for r in json.select(recommend.participants(F.col("j")).alias("p")).collect()] == [["aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa"], [], [], []]
    users = spark.createDataFrame([("a", 0.5, 4.0), ("b", 0.2, 1.0), ("c", 0.9, 2.0)], "user string, similarity double, hash_score double")
    c = recommend.confidence(users.select("user", "similarity"), users.where("user <> 'a'").select("user", "hash_score"), "user")
    assert rows(c, "user", "hash_score") == [("a", 1.0), ("b", 1.0), ("c", 2.0)]
    words = spark.createDataFrame([("a", ["release plan", "xyz"]), ("c", ["release"])], "user string, phrases array<string>")
    speakers = spark.createDataFrame([("b",)], "user string")
    got = rows(recommend.watchers(users, speakers, words, F.lit("release plan"), ["NN", "NNP"]), "user", "rank", "suggested", "words")
    assert got == [("a", 1, True, ["release plan"]), ("c", 2, False, ["release"])]
    assert recommend.watchers(users, speakers, words, F.lit("x"), least=2.0).count() == 0
    assert recommend.hashed_projections(2, 3, 4).shape == (2, 3, 4) and abs(recommend.hashed_projections(50, 10, 64).mean()) < 0.01


def test_topic_parts(spark):
    s = spark.createDataFrame([("i", 1, ["a", "b"]), ("i", 5000, []), ("i", 9000, ["c"]), ("j", 2, None)], "session string, ord long, l array<string>")
    assert rows(topics.numbered_sentences(s, "session", "ord", "l"), "session", "ord", "pos", "idx", "sentence") == [("i", 1, 0, 0, "a"), ("i", 1, 1, 1, "b"), ("i", 9000, 0, 2, "c")]
    assert rows(topics.compact_order(s, "session", "ord"), "session", "ord", "new_ord") == [("i", 1, 0), ("i", 5000, 1), ("i", 9000, 2), ("j", 2, 0)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "k long, vec array<double>")
    m = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "mind int, mind_vec array<double>")
    assert rows(topics.pim_scores(v, m, "k", lambda mind: (mind == 1).cast("double")), "k", "score") == [(1, 0.5), (2, None)]


def test_requests(spark):
    df = spark.createDataFrame([('{"mindId":"ABC","segments":[{"id":"x","originalText":"t","spokenBy":null}]}', '{"groups":{"g":[{"recordingId":"R"}]},"pims":{"segments":[{"recordingId":"R","distance":0.5}]}}'), (None, None), ("no", "no")], "a string, b string")
    assert rows(io.scorer_requests(df, F.col("a")), "id", "text", "speaker", "mind") == [("x", "t", None, "abc")]
    assert rows(io.topic_pim_groups(df, F.col("b")), "recording", "group") == [("r", "g")]
    assert rows(io.topic_pim_distances(df, F.col("b")), "recording", "distance") == [("r", 0.5)]


def test_offsets_by_brute_force(spark):
    texts = [("s", 1, "the red car and the red bus"), ("s", 2, "red"), ("s", 3, ""), ("t", 4, "a car"), ("s", 5, "scar"), ("u", 6, "xy")]
    seg = spark.createDataFrame([(s, n, n * 10, t) for s, n, t in texts], "session string, segment_no long, offset long, text string")
    p = [(s, w) for s in ("s", "t", "v") for w in ("red", "car", "e", "", "the red", "none", "red bus", None, "red")]
    got = rows(ranking.phrase_offsets(spark.createDataFrame(p, "session string, phrase string"), seg, "session"), "session", "phrase", "offset")
    exp = {(s, w): max(n * 10 for ss, n, t in texts if ss == s and w in t) for s, w in p if w is not None and any(ss == s and w in t for ss, n, t in texts)}
    assert got == sorted(((s, w, o) for (s, w), o in exp.items()), key=repr)


def test_offsets_of_sessions_in_shares_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TEXTS", 4, raising=False)
    monkeypatch.setattr(ranking, "PHRASES", 3, raising=False)
    said = ["naïve Zoë met the cat", "東京 in the sun", "a\u200bb c", "the sun", "ab", "", None]
    texts = [("s" if i % 5 else "t", i * 31 % 50, said[i % 7]) for i in range(50)] + [(None, 77, "the sun")]
    seg = spark.createDataFrame([(s, n, f"o{n}", t) for s, n, t in texts], "session string, segment_no int, offset string, text string")
    p = [(s, w) for s in ("s", "t", "v", None) for w in ("the", "sun", "the sun", "sun ", "e", "ab", "b", "京", "東京 in", "Zoë", "oë m", "\u200b", "", "cat", "cats", "the cat", "abc", None, "sun")]
    got = rows(ranking.phrase_offsets(spark.createDataFrame(p, "session string, phrase string"), seg, "session"), "session", "phrase", "offset")
    exp = {}
    for s, w in p:
        held = [n for ss, n, t in texts if None not in (s, w, t) and ss == s and w in t]
        if held:
            exp[s, w] = f"o{max(held)}"
    assert got == sorted(((s, w, o) for (s, w), o in exp.items()), key=repr)


def test_offsets_shuffle_about_as_much_as_the_texts(spark):
    """Every text travels once, not once for each of its stretches."""
    texts = [(f"s{i % 40}", i, " ".join(f"w{i * k * 7919 % 9973}" for k in range(2, 32))) for i in range(2000)]
    seg = spark.createDataFrame([(s, n, n, t) for s, n, t in texts], "session string, segment_no long, offset long, text string")
    p = spark.createDataFrame([(s, t[:20]) for s, _, t in texts], "session string, phrase string")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(sc.statusStore().executorList(False)))

    before = written()
    assert ranking.phrase_offsets(p, seg, "session").count() == 2000
    assert 0 < written() - before < 2 * sum(len(t) for _, _, t in texts)
