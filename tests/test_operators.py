import pytest
from pyspark.sql import functions as F

from colloquy.functions import tagging, text
from colloquy.functions.ids import dashed
from colloquy.functions.vectors import cosine
from colloquy.operators import graph, ranking, recommend, topics, wordgraph


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (text.missing_space_fix, "aB a.B z?Q", "aB a. B z? Q"),
        (text.split_sentences_short, "a b c d. x y. e f g h", "a b c d. e f g h"),
        (text.split_sentences_short, "a b c d. x y z. e f g h", "a b c d. x y z. e f g h"),
        (text.expand_contractions, "I can't, can't", "I cannot, cannot"),
        (text.ensure_terminal_punct, "well", "well. "),
        (text.mask_numbers, "3.14 and 12", "XnumberX and XnumberX"),
        (text.mask_urls, "see www.x.org/a now", "see __url__ now"),
        (text.mask_urls, "write to me@x.org or see x.de.", "write to me@x.org or see __url__."),
        (text.expand_contractions, "I'd go, he's", "I would go, he is"),
        (text.remove_stopwords, "cat and hand", "cat   h "),
        (text.clean_text, "It’s at: x.com/a \n ok 😀", "It's at. __url__ . ok"),
        (lambda t: F.array_join(text.basic_tokenize(t), " "), "Él Niño 東京!", "el nino 東 京 !"),
        (lambda t: F.array_join(text.capitalize_entities(F.array(t)), "|"), "new york OF the www.example.com/a a.b", "New York of the Example.com A.B"),
        (text.acronym_join, "the a b c test", "the abc test"),
        (text.fix_apostrophes, "it 's", "it's"),
        (dashed, "{A67E29E01F0E4010B2207F110E22D905}", "a67e29e0-1f0e-4010-b220-7f110e22d905"),
        (dashed, "short", "short"),
        (text.url_domain, "www dot example.com slash a", "example.com"),
        (text.word_count, "  ", 0),
        (text.clean_text, None, None),
    ],
)
def test_text(spark, make, value, expected):
    if make is text.url_domain:
        value = "www.example.com/a"
    assert one(spark, make, value) == expected


def test_word_graph_by_hand(spark):
    df = spark.createDataFrame([("g", "aa bb cc aa dd"), ("g", None), ("h", "")], "g string, t string")
    e = wordgraph.build_word_graph(df, F.col("g"), F.col("t"))
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [("aa", "bb"), ("aa", "cc"), ("aa", "dd"), ("bb", "cc"), ("bb", "dd"), ("cc", "dd")]
    assert {r["degree"] for r in wordgraph.degree(e).collect()} == {3}
    ranks = wordgraph.pagerank(e, 30, 1e-6).collect()
    assert all(abs(r["pagerank"] - 0.25) < 1e-9 for r in ranks)
    more = e.union(spark.createDataFrame([("h", "x", f"y{i}") for i in range(9)], "graph string, src string, dst string"))
    by = {k: {(r["graph"], r["word"]): round(r["pagerank"], 9) for r in wordgraph.pagerank(more, 12, local_edges=k).collect()} for k in (0, 7, 1000)}
    assert by[0] == by[7] == by[1000] and len(by[0]) == 14
    norm = wordgraph.normalize_by_degree(wordgraph.pagerank(e, 5), wordgraph.degree(e)).first()
    assert abs(norm["score"] - 0.083333) < 1e-5
    assert wordgraph.build_word_graph(df.limit(0), F.col("g"), F.col("t")).count() == 0


def test_keyword_runs_do_not_flush_the_tail(spark):
    marks = [1.0, 1.0, None, 1.0, 1.0, None, 1.0]
    t = spark.createDataFrame([(1, i, f"w{i + 1}", s) for i, s in enumerate(marks)], "text_id long, pos int, word string, score double")
    assert sorted(r["phrase"] for r in wordgraph.keyword_runs(t).collect()) == ["w1 w2", "w4 w5"]


def test_centrality_of_a_path(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], "graph string, src string, dst string")
    got = {r["word"]: (r["betweenness"], round(r["closeness"], 4)) for r in wordgraph.centrality(e).collect()}
    assert got == {"a": (0.0, 0.6667), "b": (1.0, 1.0), "c": (0.0, 0.6667)}


def test_clean_phrases(spark):
    p = spark.createDataFrame([("g", x) for x in ["red car", "big red car", "car car", "x ray", "bus", "busy"]], "graph string, phrase string")
    assert sorted(r["phrase"] for r in wordgraph.clean_phrases(p).collect()) == ["big red car", "bus", "busy"]


def test_quality_and_selection(spark):
    p = spark.createDataFrame([("s", 0.2), ("s", 0.4), ("s", 0.9), ("s", float("nan")), ("s", None)], "seg string, b double")
    q = ranking.segment_quality(p, ["seg"], F.col("b")).first()
    assert (round(q["quality_mean"], 6), q["quality_median"], q["phrases"]) == (0.5, 0.4, 3)
    wish = spark.createDataFrame([(20, 6), (27, 6), (60, 6), (60, 5), (3, 10)], "t int, n int").select(ranking.dynamic_top_n(F.col("t"), F.col("n")).alias("v"))
    assert [r["v"] for r in wish.collect()] == [6, 9, 10, 5, 10]
    for n_ent, expected in ((3, (3, 7)), (8, (5, 5))):
        rows = [("s", "entity", f"e{i}", 1.0, False) for i in range(n_ent)] + [("s", "keyphrase", f"k{i}", 1.0, False) for i in range(12)]
        out = ranking.quota_slice(spark.createDataFrame(rows, "session string, kind string, phrase string, score double, removed boolean"), "session")
        n = {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()}
        assert (n["entity"], n["keyphrase"]) == expected


def test_fuzzy(spark):
    df = spark.createDataFrame([("a", ["open offer letter", "offer letter open", "weekly sync", None][:3]), ("b", None)], "k string, p array<string>")
    got = {r["k"]: r["p"] for r in ranking.fuzzy_dedupe(df, "k", "p").collect()}
    assert got == {"a": ["open offer letter", "weekly sync"], "b": []}


def test_topics(spark):
    isl = spark.createDataFrame([("c", o) for o in (0, 1, 3, 4, 7)], "c string, ord long")
    g = topics.time_islands(isl, ["c"]).groupBy("c", "island").agg(F.collect_list("ord").alias("o"), F.count(F.lit(1)).alias("size"))
    assert sorted(sorted(r["o"]) for r in topics.drop_singletons(g, "c").collect()) == [[0, 1], [3, 4]]
    m = spark.createDataFrame([("s", 1, 0), ("s", 1, 0), ("s", 1, 1), ("s", 1, 1)], "session string, segment long, community long")
    assert topics.majority_assign(m, "session").first()["community"] == 1
    label = topics.louvain_labels([1, 1, 2, 4, 4, 5, 3], [2, 3, 3, 5, 6, 6, 4], [1, 1, 1, 1, 1, 1, 0.1])
    assert len({label[i] for i in (1, 2, 3)}) == 1 and label[1] != label[5] and len({label[i] for i in (4, 5, 6)}) == 1
    t = spark.createDataFrame([("r1", 0.5), ("r2", 0.2), ("r3", 0.1)], "recording string, distance double")
    gr = spark.createDataFrame([("r1", "g1"), ("r2", "g2"), ("r3", "g1")], "recording string, group string")
    assert [r["group"] for r in topics.topic_order(t, gr, "recording").orderBy("rank").collect()] == ["g1", "g2"]
    iv = spark.createDataFrame([("s", 1, 0, 10, 3), ("s", 2, 2, 2, 1), ("s", 3, 20, 30, 1)], "session string, group long, start long, end long, size int")
    assert {r["group"]: r["into"] for r in topics.merge_contained(iv, "session").collect()} == {1: 1, 2: 1, 3: 3}


def test_recommendation(spark):
    m = spark.createDataFrame([("a", 6), ("b", 2)], "user string, matches long")
    n = spark.createDataFrame([("a", 3), ("b", 1)], "user string, n long")
    got = {r["user"]: (r["v1"], round(r["v2"], 6)) for r in recommend.user_scores(m, n).collect()}
    assert got == {"a": (2.0, 0.15), "b": (2.0, 0.083333)}
    s = recommend.normalise_scores(spark.createDataFrame([(10.0,), (4.0,), (1.0,)], "s double"), "s")
    assert sorted(round(r["norm"], 6) for r in s.collect()) == [-0.444444, -0.111111, 0.555556]
    assert recommend.percentile_cutoff(s, "norm").count() == 1
    alone = recommend.normalise_scores(spark.createDataFrame([(10.0,)], "s double"), "s")
    assert alone.first()["norm"] is None and recommend.relevancy_gate(alone).count() == 0
    assert [recommend.adaptive_hash_size(x) for x in (0, 1, 1000)] == [16, 1, 16]
    import numpy as np

    planes = np.array([[[1.0, 0], [0, 1], [1, 1]]])
    b = recommend.lsh_buckets(spark.createDataFrame([(1, [1.0, -1.0]), (2, None)], "k long, vec array<double>"), "k", planes).collect()
    assert [r["buckets"] for r in b] == [[1]]


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.standard_normal((200, 32))
    near = base[:20] + 0.05 * rng.standard_normal((20, 32))
    df = lambda x, o: spark.createDataFrame([(i + o, v.tolist()) for i, v in enumerate(x)], "k long, vec array<double>")
    planes = recommend.projections(16, 8, 32)
    m = recommend.lsh_matches(recommend.lsh_buckets(df(near, 0), "k", planes).withColumnRenamed("k", "query"), recommend.lsh_buckets(df(base, 0), "k", planes).withColumnRenamed("k", "user"), "user")
    assert m.where("query = user").count() >= 18


def test_graph_primitives(spark):
    e = spark.createDataFrame([("p", "has", "c1"), ("p", "has", "c2"), ("c1", "of", "u")], "src string, relation string, dst string")
    v = spark.createDataFrame([("p",), ("q",)], "xid string")
    assert sorted((r["xid"], r["c"] or "") for r in graph.expand(v, e, "has", "c").collect()) == [("p", "c1"), ("p", "c2"), ("q", "")]
    assert graph.expand(v, e, "has", "c", cascade=True).count() == 2
    assert [r["p"] for r in graph.expand(spark.createDataFrame([("c1",)], "xid string"), e, "has", "p", reverse=True).collect()] == ["p"]
    old = spark.createDataFrame([("x", 1, "a", None)], "xid string, seq int, n string, m string")
    new = spark.createDataFrame([("x", 2, None, "b")], "xid string, seq int, n string, m string")
    r = graph.upsert(old, new, "xid", "seq").first()
    assert (r["seq"], r["n"], r["m"]) == (2, "a", "b")


def test_tagging(spark):
    df = spark.createDataFrame([(1, "We should send the quarterly report"), (2, ""), (3, None)], "k long, t string")
    got = {r["k"]: r["c"] for r in df.select("k", tagging.chunk(tagging.pos_tag(F.col("t"))).alias("c")).collect()}
    assert any("report" in p for p in got[1]) and got[2] == [] and got[3] == []
    w = spark.createDataFrame([("unaffable",), ("zz",), (None,)], "t string").select(tagging.wordpiece(F.col("t"), {"un", "##aff", "##able"}).alias("w")).collect()
    assert [r["w"] for r in w] == [["un", "##aff", "##able"], ["[UNK]"], []]
    b = spark.createDataFrame([("low",)], "t string").select(tagging.bpe(F.col("t"), {("l", "o"): 0, ("lo", "w</w>"): 1}).alias("b")).first()
    assert b["b"] == ["low</w>"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 0.70710678) < 1e-6 and got[1:] == [None, None]


def test_lsh_recall_of_the_registered_index(spark):
    import numpy as np

    from colloquy.plans import ranking_queries as rq

    rows = rq._vectors(spark, "/root/testdata/sf0.1").orderBy("vec_id").collect()
    ids, v = [r["vec_id"] for r in rows], np.array([r["vec"] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    b = rq._index(spark, "/root/testdata/sf0.1")
    m = recommend.lsh_matches(b.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "buckets"), b.withColumnRenamed("vec_id", "user"), "user")
    met = {(r["query"], r["user"]) for r in m.select("query", "user").collect()}
    near = [(q, ids[j]) for i, q in enumerate(ids) if q % 100 == 0 for j in [j for j in np.argsort(-(v @ v[i])) if j != i][:10]]
    assert sum(x in met for x in near) >= 0.9 * len(near)


def test_keywords_are_the_nodes_of_the_graph(spark):
    df = spark.createDataFrame([("g", 1, "The red car and red cars stop."), ("g", 2, "Tree"), ("h", 3, ""), ("h", 4, None)], "g string, i long, t string")
    rows = wordgraph.keyword_tokens(df, F.col("g"), F.col("i"), F.col("t")).orderBy("text_id", "pos").collect()
    assert [(r["text_id"], r["word"], r["tag"]) for r in rows] == [
        (1, "the", "e"), (1, "red", "k"), (1, "car", "k"), (1, "and", "e"), (1, "red", "k"), (1, "cars", "p"), (1, "stop", "k"), (1, ".", "e"), (2, "tree", "k"),
    ]
    # red, car and stop form a triangle; tree stands alone and its mass goes to all: r = 0.85 * (r + o / 4) + 0.15 / 4 and 3 r + o = 1
    o = (0.15 / 4) / (1 - 0.85 / 4)
    by = {r["word"]: r["score"] for r in rows if r["score"] is not None}
    assert abs(by["tree"] - o) < 1e-4 and all(abs(by[w] - (1 - o) / 6) < 1e-4 for w in ("red", "car", "cars", "stop"))
    assert sorted(r["phrase"] for r in wordgraph.keyword_runs(wordgraph.keyword_tokens(df, F.col("g"), F.col("i"), F.col("t"))).collect()) == ["red car", "red cars stop"]


def test_subwords_of_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    from colloquy.plans.text_queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r["seg_row_id"]: r["value"].split(" ") for r in QUERIES["basic_tokenize"](spark, d).collect()}
    vocabulary = {p: i for i, p in enumerate(sorted(tagging.piece_vocabulary() | {"[UNK]"}))}
    merges = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    pieces = Tokenizer(models.WordPiece(vocab=vocabulary, unk_token="[UNK]", max_input_chars_per_word=100))
    for name, by in (("wordpiece", pieces), ("bpe", merges)):
        got = {r["seg_row_id"]: r["value"] for r in QUERIES[name](spark, d).collect()}
        assert got == {i: " ".join(p for w in ws if w for p in by.encode(w, add_special_tokens=False).tokens) for i, ws in texts.items()}
    assert sum(len(ws) for ws in texts.values()) > 5 * len(texts)


def test_full_similarity_graph_has_all_pairs(spark):
    import numpy as np

    from colloquy.plans import ranking_queries as rq

    d = "/root/testdata/sf0.001"
    v = [np.array(r["vec"]) for r in rq._sentence_vectors(spark, d).where("session = 's0'").orderBy("sentence").collect()]
    x = [[float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for b in v] for a in v]
    for i, row in enumerate(x):
        row[i] = sum(row) / len(row)
    n = [[(w - min(row)) / (max(row) - min(row)) for w in row] for row in x]
    got = {(r["i"], r["j"]): r["w"] for r in rq.full_similarity_graph(spark, d).where("session = 's0'").collect()}
    assert len(v) == 20 and len(got) == 210
    assert all(abs(w - (1 if i == j else (n[i][j] + n[j][i]) / 2)) < 1e-8 for (i, j), w in got.items())


def test_rerank_of_every_query(spark):
    import numpy as np

    from colloquy.plans import ranking_queries as rq

    d = "/root/testdata/sf0.001"
    rows = rq._vectors(spark, d).collect()
    got = {(r["query"], r["user"]): (r["phrase_score"], r["phrases"]) for r in rq.rerank_users(spark, d).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    expected = {}
    for q in (r for r in rows if r["vec_id"] % 100 == 0):
        for user in {r["label"] for r in rows}:
            best = sorted(((-cos(q["vec"], r["vec"]), r["vec_id"]) for r in rows if r["label"] == user))[:10]
            expected[q["vec_id"], user] = (-sum(s for s, _ in best) / len(best), ",".join(str(i) for _, i in best))
    assert got.keys() == expected.keys() and len({q for q, _ in got}) == 5
    assert all(got[k][1] == p and abs(got[k][0] - s) < 1e-8 for k, (s, p) in expected.items())


def test_time_groups(spark):
    a = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("s", 4, 0), ("s", 5, 1), ("s", 6, 2), ("s", 7, 1), ("s", 8, 1), ("t", 1, 0), ("t", 2, 1)], "session string, segment long, community long")
    segments = a.select("session", "segment").union(spark.createDataFrame([("s", 3), ("s", 9), ("u", 1)], "session string, segment long"))
    scores = spark.createDataFrame([("s", 1, 0.4), ("s", 2, 0.4), ("s", 4, 0.4), ("s", 7, 0.8), ("s", 8, 0.6), ("t", 2, 0.1)], "session string, segment long, score double")
    got = sorted(tuple(r[k] for k in ("session", "group", "size", "start", "end", "rank")) + (round(r["mean_score"], 9),) for r in topics.time_groups(a, segments, scores, "session").collect())
    assert got == [("s", 1, 4, 1, 4, 2, 0.3), ("s", 7, 2, 7, 8, 1, 0.7), ("t", 1, 1, 1, 1, 2, 0.0), ("t", 2, 1, 2, 2, 1, 0.1), ("u", 1, 1, 1, 1, 1, 0.0)]


def test_hierarchical_split(spark):
    near = {1: [1.0, 0, 0], 2: [1.0, 0.1, 0], 3: [0, 1.0, 0], 4: [0, 1.0, 0.1], 5: [0, 0, 1.0]}
    v = spark.createDataFrame([("s", i, [float(x) for x in v]) for i, v in near.items()], "session string, sentence long, vec array<double>")
    c = spark.createDataFrame([("s", i, 0 if i < 5 else 3) for i in near], "session string, sentence long, community long")
    label = {r["sentence"]: r["community"] for r in topics.hierarchical_split(c, v, "session").collect()}
    assert len(label) == 5 and label[5] not in {label[i] for i in (1, 2, 3, 4)} and label[1] not in (label[3], label[4])


def test_the_registered_groups_are_whole(spark):
    from colloquy.plans import ranking_queries as rq

    d = "/root/testdata/sf0.001"
    for flag in (False, True):
        rows = rq.h_communities(spark, d, flag).collect()
        assert {r["session"] for r in rows} == {r["session"] for r in rq._sentence_vectors(spark, d).select("session").distinct().collect()}
        for s in {r["session"] for r in rows}:
            own = [r for r in rows if r["session"] == s]
            assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))
            assert not any(a is not b and a["start"] <= b["start"] and b["end"] <= a["end"] and max(a["size"], b["size"]) > 1 for a in own for b in own)
