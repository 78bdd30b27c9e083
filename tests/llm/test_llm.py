import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import boosting, copies, mixing, packing, pairs, subjects, topn, turns


# problem 2


def test_copies(spark):
    rows = [(1, "Follow up", 0.5, "a"), (2, " follow-UP!", 0.5, "a"), (3, "Follow up", float("nan"), "a"), (4, "followup…", float("nan"), "a"), (5, "follow up", None, "a"), (6, None, None, "a"), (7, None, None, "a"), (8, "", None, "b"), (9, "x" * 50_000, None, "c"), (10, "Éa", None, "d"), (11, "é A", None, "d"), (12, "ea", None, "d")]
    df = spark.createDataFrame(rows, "row long, form string, s double, hash128 string")
    got = {(r["keep_id"], r["copies"]) for r in copies.hidden_copies({"t": (df, "row", copies.canonical(df, ["form"], [], ["row"]))}).collect()}
    assert got == {(1, 2), (3, 2), (6, 2), (10, 2)}
    groups = copies.count_copies(df, "row", copies.canonical(df, ["form"], [], ["row"]))
    assert groups.agg(F.sum("copies")).first()[0] == 12 and copies.colliding_hashes(groups).count() == 0
    assert copies.count_copies(df.limit(0), "row", F.col("form")).count() == 0


def test_json_layout(spark):
    rows = ['{"a":"X y","n":0.50,"s":{"p":1,"q":2.0}}', '{ "s" : {"q":2, "p":1.0}, "n":5e-1,\n "a":"x-Y" }', '{"a":"X y","n":0.5,"s":null}', '{"n":0.5,"a":"xy"}', "no json", " no json ", None]
    df = spark.createDataFrame(list(enumerate(rows)), "row long, p string")
    got = {(r["keep_id"], r["copies"]) for r in copies.count_copies(df, "row", copies.canonical_json(F.col("p"), ["a"], [], ["n"])).collect()}
    assert got == {(0, 2), (2, 2), (4, 2), (6, 1)}


# problem 3


@pytest.mark.parametrize("small", [True, False])
def test_top_n(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(topn, "BROADCAST_ROWS", 0)
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 9 + ["a", "b", None]), r.choice([None, float("nan"), 1.0, 2.0, r.random()]), r.choice(["p", "q", None]), i, "c") for i in range(3000)]
    rows += [("one", 1.0, "z", -1, "c")] * 2
    df = spark.createDataFrame(rows, "grp string, sc double, form string, row long, bound string").repartition(7)
    n = F.when(F.col("grp") == "b", 0).otherwise(13)
    got = sorted((x["g"], x["pos"], x["id"]) for x in topn.top_n(df, F.col("grp"), n, F.col("sc"), F.col("form"), F.col("row")).collect())
    exp = []
    for g in ("hot", "a", "one"):
        own = sorted((x for x in rows if x[0] == g and x[1] is not None and x[1] == x[1]), key=lambda x: (-x[1], x[2] or "", x[3]))[:13]
        exp += [(g, i + 1, x[3]) for i, x in enumerate(own)]
    assert got == sorted(exp)
    assert topn.top_n(df.limit(0), F.col("grp"), n, F.col("sc"), F.col("form"), F.col("row")).count() == 0


# problem 5


@pytest.mark.parametrize("chunk", [3, 64])
def test_pairs(spark, chunk):
    r = random.Random(5)
    names = [f"i{k}" for k in range(30)]
    baskets = {b: {r.choice(names[:12]) for _ in range(r.choice([1, 2, 9]))} for b in range(120)}
    baskets[999] = set(names)
    rows = [(str(b), list(items) + [None, ""], "x") for b, items in baskets.items()] + [(None, ["i1", "i2"], "x"), ("e", [], "x"), ("n", None, "x")]
    df = spark.createDataFrame(rows, "b string, items array<string>, code string")
    each = pairs.basket_items(df.unionByName(df), F.col("b"), F.col("items"))
    got = {(x["item_a"], x["item_b"], x["n_together"]) for x in pairs.associated_pairs(each, 123, 3, 1.5, chunk).collect()}
    n = {i: sum(i in s for s in baskets.values()) for i in names}
    exp = set()
    for a in names:
        for b in names:
            t = sum(a in s and b in s for s in baskets.values())
            if a < b and t >= 3 and t * 123 >= 1.5 * n[a] * n[b]:
                exp.add((a, b, t))
    assert got == exp and exp
    assert pairs.associated_pairs(each.limit(0), 0, 3, 1.5).count() == 0


# problem 6

WHO = ("3ff39b75-2757-7b03-aa5b-f8a2de85b845", "fe355bbe-cccd-c6b6-b310-e8571077eee1")
ROSTER = ((WHO[0], 1, "Yorick Brackwen"), (WHO[1], 2, "Quilla Nettlesby"))


@pytest.mark.parametrize(
    ("text", "spoken", "expected"),
    [
        ("So umm… the plan [laughter] is, ER on.", WHO[0].replace("-", "").upper(), [(0, 5)]),
        ("Speaker 2 - umm. ok give", None, [(1, 2)]),
        (">> Quilla: Give (inaudible) me <00:03:56.188> it", "null", [(1, 3)]),
        ("yes page Brackwen, Yorick: who owns", "spk_2", [(1, 2), (0, 2)]),
        ("<v Quilla Nettlesby> at 10:30 [Yorick Brackwen]: ok", "unknown", [(1, 2), (0, 1)]),
        ("00:02:12,054 --> 00:02:16,054\nQ. Nettlesby: remind me at 9:15 *coughs* ♪ music ♪ perhaps we hum", "", [(1, 7)]),
        ("[silence]. hmm", "SPEAKER_01", []),
        ("one thing: nobody", "Nettlesby, Quilla", [(1, 3)]),
    ],
)
def test_segment(text, spoken, expected):
    speech = turns.Speech(turns.train_fillers([]))
    assert [(WHO.index(w), n) for w, n, *_ in turns.split_segment(text, spoken, ROSTER, speech)] == expected


def test_fillers_held_out(monkeypatch):
    """Sounds and words the trees were not trained on, spelled in other ways; and every listed one left out in turn."""
    speech = turns.Speech(turns.train_fillers(["we would split the umbrella term on the platform", "an error in the room at noon"]))
    assert all(map(speech.is_hesitation, ["Uuuhm", "ERRRR", "hmmmm", "ummmmm…", "ehhm,", "mmmmm"]))
    assert not any(map(speech.is_hesitation, ["umbrella", "error", "term", "like", "ok", "her", "hear", "Hum,", "room", "me", "12", "uhlmann", "…", "are", "summer"]))
    right = []
    for out in turns.SOUNDS:
        monkeypatch.setattr(turns, "SOUNDS", [s for s in turns.SOUNDS if s != out])
        right.append(turns.Speech(turns.train_fillers([])).is_hesitation(out))
        monkeypatch.undo()
    assert sum(right) / len(right) >= 0.8


def test_turns(spark):
    t = "61920cfa-7bfc-cb75-5a47-66d2f09065d9"
    rows = [
        (1, "a" * 32, t, "spk_1", "hello there", "2020-01-01T00:00:01Z"), (2, "a" * 32, t, "spk_1", "hello there", "2020-01-01T00:00:01Z"), (3, None, t, "spk_1", "um", "2020-01-01T00:00:02.5Z"),
        (4, "c" * 32, t, "spk_1", "more", "2020-01-01T01:59:59.123456789Z"), (5, "d" * 32, t, "spk_2", "x " * 30_000, "2020-01-01T02:00:00Z"), (6, "e" * 32, t, None, None, "2020-01-01T02:00:01Z"),
        (7, "f" * 32, t, "spk_1", "back Speaker 2: yes", "2020-01-01T05:00:00Z"), (8, "9" * 32, None, "spk_1", "lost", "2020-01-01T05:00:00Z"),
    ]
    df = spark.createDataFrame([(*r, r[5], "z") for r in rows], "sp_row_id long, id string, transcriptId string, spokenBy string, originalText string, startTime string, endTime string, roster string")
    who = spark.createDataFrame([(t, 1, WHO[0], "A B"), (t, 2, WHO[1], "C D")], "transcriptId string, speakerNo int, spokenBy string, speakerName string")
    got = sorted((r["turn_no"], WHO.index(r["spoken_by"]), r["sp_row_id"], r["n_words"]) for r in turns.speaker_turns(df, who).collect())
    assert got == [(1, 0, 1, 3), (2, 1, 5, 30_000), (3, 0, 7, 1), (4, 1, 7, 1)]
    assert turns.speaker_turns(df.limit(0), who).count() == 0
    assert {r["names"] for r in turns.boundary_figures(df, who).collect()} == {"shown", "hidden"}


def test_turns_compare_with_the_last_known_speaker(spark, monkeypatch):
    monkeypatch.setattr(boosting.Booster, "column", lambda self, columns: F.lit(-1.0))  # every guess: no boundary
    t = "61920cfa-7bfc-cb75-5a47-66d2f09065d9"
    said = [("spk_1", "00:00:01"), (None, "00:00:02"), ("spk_2", "00:00:03"), (None, "00:00:04"), ("spk_2", "00:00:05"), (None, "00:00:06"), ("spk_1", "02:00:00"), ("spk_1", "02:00:01")]
    rows = [(i, f"{i}" * 32, t, who, "some words", f"2020-01-01T{at}Z", f"2020-01-01T{at}Z") for i, (who, at) in enumerate(said, 1)]
    df = spark.createDataFrame(rows, "sp_row_id long, id string, transcriptId string, spokenBy string, originalText string, startTime string, endTime string")
    who = spark.createDataFrame([(t, 1, WHO[0], "A B"), (t, 2, WHO[1], "C D")], "transcriptId string, speakerNo int, spokenBy string, speakerName string")
    got = sorted((r["turn_no"], WHO.index(r["spoken_by"]), r["sp_row_id"], r["n_words"]) for r in turns.speaker_turns(df, who).collect())
    assert got == [(1, 0, 1, 4), (2, 1, 3, 8), (3, 0, 7, 4)]


def test_boosting_held_out():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.train(x[:1500], y[:1500])
    assert ((m.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.9
    assert boosting.train(x[:0], y[:0]).trees == []


# problem 7


def test_packing(spark):
    r = random.Random(7)
    docs = [(i, r.choice([0, 5, r.randrange(1, 40), r.randrange(1, 400)])) for i in range(400)] + [(400, None), (401, 100), (402, 200)]
    sizes = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    packs = spark.createDataFrame([("s", 100), ("m", 64), (None, 5), ("z", 0)], "pack_name string, capacity_tokens int")
    out = packing.pack_documents(sizes, packs, block_items=50).collect()
    for name, cap in (("s", 100), ("m", 64)):
        own = [x for x in out if x["pack_name"] == name]
        fill, parts = {}, {}
        for x in own:
            fill[x["container"]] = fill.get(x["container"], 0) + x["n_tokens"]
            parts.setdefault(x["doc_id"], []).append((x["token_start"], x["n_tokens"]))
        assert max(fill.values()) <= cap and set(parts) == {d for d, _ in docs}
        for d, n in docs:
            n, at = n or 0, 0
            for s, k in sorted(parts[d]):
                assert s == at
                at += k
            assert at == n and len(parts[d]) == max(1, -(-n // cap))
        assert sum(fill.values()) / (len(fill) * cap) > 0.95
    assert packing.pack_documents(sizes.limit(0), packs).count() == 0


def test_packing_tries_the_next_emptiest():
    for sizes, least in (([30, 16, 54, 43, 26, 59, 22, 62, 56, 37, 65, 20], 5), ([45, 45, 33, 41, 29, 43, 15, 41, 69, 57, 60, 31, 30, 55, 29, 15, 33, 34, 67], 8)):
        bins = packing.empty_by_swaps(packing.best_fit_decreasing(sizes, 100), sizes, 100)
        assert len(bins) == least and max(sum(sizes[i] for i in b) for b in bins) <= 100
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


def test_swaps_empty_a_container():
    sizes = [6, 4, 5, 3, 3, 3]
    bins = packing.empty_by_swaps([[0], [1, 2], [3, 4], [5]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and all(sum(sizes[i] for i in b) <= 10 for b in bins) and len(bins) == 3


# problem 8


def test_permutation():
    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))


def test_mixture(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["a", "a", "a", "b", "c", None, "other"]), r.choice([0, 1, 300, 900, None])) for i in range(900)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix_sources(sizes, targets, block=64, shard_slots=100).cache()
    for x in mixing.share_report(m, targets).collect():
        assert abs(x["actual_share"] - x["target_share"]) < 0.01 and x["most_uses"] <= x["max_repeats"]
    uses = m.groupBy("doc_id", "token_start", "source").count().join(targets, "source").where("count > max_repeats")
    assert uses.count() == 0 and m.groupBy("shard", "slot").agg(F.sum("n_tokens").alias("t")).where("t > 64").count() == 0
    assert sorted(map(tuple, mixing.mix_sources(sizes, targets, block=64, shard_slots=100).collect())) == sorted(map(tuple, m.collect()))
    assert mixing.mix_sources(sizes.limit(0), targets).count() == 0


# problem 9


def test_background_does_not_vote():
    t = "a milking robot. unlike a solar tracker, which belongs to another field, no inverter stage is needed here. the teat cup is clean.\nby way of comparison, a turbine.\n\nthe end"
    f = subjects.foreground(t, ["way of comparison", "unlike a "])
    assert len(f) == len(t) and "inverter" not in f and "turbine" not in f and "teat cup" in f and "the end" in f and "milking robot" in f


def test_sections_without_headings():
    long = "x" * 5_000
    assert subjects.section_starts(f"title\nabstract\n{long}\n\nmore\nclaims\n1. y") == (6, 6 + 9 + 5_000, 6 + 9 + 5_000 + 7)
    assert subjects.section_starts(f"title\nabstract {long}") == (6, 5_015, 5_015)


def test_background_phrases_are_learned(spark):
    rows = [(f"the {own} is new. by way of comparison, the {other} is used. the {own} turns.", [s]) for own, other, s in [("milking robot", "rotor hub", "food"), ("rotor hub", "milking robot", "energy")] * 5]
    docs = spark.createDataFrame(rows, "text string, subjects array<string>")
    cues = subjects.learn_cues(docs, {"milking robot": "food", "rotor hub": "energy"})
    assert "by way of" in cues and "way of comparison" in cues and not any("turns" in c or "new" in c for c in cues)
    assert subjects.learn_cues(docs, {}) == [] and subjects.learn_cues(docs.limit(0), {"a": "b"}) == []


def test_described_terms(spark):
    sample = spark.createDataFrame([(["payment", "order", "lens"],)] + [(["order", "pay"],)] * 9, "terms array<string>")
    table = spark.createDataFrame([("finance", "Money", "Payments and orders"), ("optics", "Light", "Lenses")], "subject string, title string, description string")
    assert [tuple(r) for r in subjects.described_terms(sample, table, stem=4).collect()] == [("lens", "optics"), ("payment", "finance")]


def test_subjects_held_out(spark):
    r = random.Random(9)
    words = {"food": ["milk teat", "seed drill"], "optics": ["lens mount", "light beam"], "sport": ["ski boot", "ball net"], "energy": ["rotor hub", "heat tank"], "pharma": ["salt form", "tablet coat"], "finance": ["card fee", "order book"]}
    rows, truth = [], []
    for i in range(360):
        own = r.sample(sorted(words), r.choice([1, 1, 2]))
        other = r.choice(sorted(words))
        say = lambda: " ".join(f"the {r.choice(words[s])} is made." for s in own)  # noqa: E731, B023
        rows.append((i, f"{say()}\n\nAbstract\n{say()}\n\nDescription\n{say()} By way of comparison, a {r.choice(words[other])} is used.\n\nClaims\n1. {say()}", None, "x", i // 2 if i % 3 else None, 1))
        truth += [(i, s) for s in own]
    rows += [(1000, None, None, None, None, 1), (1001, "", None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, applicant string, source string, family_id long, votes int")
    labels = spark.createDataFrame([t for t in truth if t[0] % 4 == 0], "doc_id long, subject string")
    got = {tuple(x) for x in subjects.assign_subjects(docs, labels).collect()}
    held = {t for t in truth if t[0] % 4}
    hit = len({g for g in got if g[0] % 4} & held)
    assert hit / len(held) > 0.9 and hit / max(1, len({g for g in got if g[0] % 4 and g[0] < 1000})) > 0.9
    assert {t for t in truth if t[0] % 4 == 0} <= got
    assert subjects.assign_subjects(docs.limit(0), labels).count() == 0
    r = subjects.held_out(docs, labels).first()
    assert r["hidden"] > 5 and r["labelled"] + r["hidden"] == 90 and r["precision"] > 0.85 and r["recall"] > 0.85
