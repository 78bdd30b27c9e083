"""Speech transcripts into clean, ordered speaker turns (problem 6).

1. Redelivered segments count once.
2. Each segment's text is cut at speaker labels; the pieces lose time marks, remarks and hesitation sounds, and every way
   to name a speaker is mapped to the roster. One Arrow-batched pass over the texts; nothing is shuffled by transcript
   before it.
3. Whether a token is a hesitation sound is decided by gradient-boosted trees over its letters and marks, trained on
   listed sounds and words and on a bounded sample of the texts' own tokens.
4. Whether a piece begins a turn is decided for every adjacent pair by gradient-boosted trees over names, gap and context,
   trained on a bounded sample of adjacent pieces whose speakers are stated by id; half of the sample has its name
   relation hidden, so that the trees also decide where a speaker is not known. An exact check follows: no turn begins
   inside one known speaker's speech, and no turn holds two.
5. Turns are numbered by counts: inside an hour of a transcript by a window, across hours by prefix sums over one row
   per hour, so that no transcript is ever one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ids import dashed
from colloquy.llm.boosting import Booster, train
from colloquy.runtime import broadcast_if_small, cut

#: Adjacent pieces the boundary trees are trained on, at most.
TRAINING_PAIRS = 20_000
HOUR_NS = 3_600_000_000_000

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_NOISE = re.compile(
    rf"{_CLOCK}\s*-->\s*{_CLOCK}|\[\[[^\]]*\]\]|\(\([^)]*\)\)|\[[^\]\[]*\]|\([^()]*\)|\{{[^{{}}]*\}}|<[^<>]*>|\*[^*\s][^*]*\*|♪[^♪]*♪?|♫[^♫]*♫?"
)
_MAY_BE_NOISE = re.compile(r"[\[({<*♪♫]|-->")
#: Segments whose tokens the filler trees learn from, and tokens of these, at most.
FILLER_SEGMENTS, FILLER_TOKENS = 2_000, 50_000
#: Hesitation sounds, and words and letters made of the same letters.
SOUNDS = "um umm ummm uum uh uhh uhhh uuh uhm uhmm uhhm er err errr eer erm errm eh ehh ehm ehmm hm hmm hhm mm mmm mmmm ah ahh aah ahm äh ähh ähm euh euhh".split()
WORDS = "a am an are area arm ear era ham harm he hear her here hum huma human me mar mama mum mare ram rare re ream rear rum rhum era hare u r m h e ä ha hah hehe heh haha rur mur".split()
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_UUID = re.compile(r"([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})", re.I)
_NUMBERED = re.compile(r"(?:speaker|spk)[ _]?0*(\d+)", re.I)


def token_features(token: str) -> list[float]:
    """What the filler trees see of a token: its letters, without repeats, and the marks around it."""
    core = _EDGE.sub("", token)
    low = core.lower()
    once = "".join(c for i, c in enumerate(low) if i == 0 or c != low[i - 1])
    vowels = [c in "uaeäoiyöü" for c in once]
    start = "uaeä".find(once[:1]) if once else -1
    return [
        float(sum(c not in "umheraä" for c in once)), float(len(once)), float(sum(vowels)), float(start >= 0), float("hm".find(once[:1]) if once else -1), float("rhm".find(once[-1:]) if once else -1),
        float("a" in once), float(len(low) - len(once)), float(sum(x != y for x, y in zip(vowels, vowels[1:], strict=False))), float(len(low)), float(token[-1:] in (",", "…", ".", "-")), float(core != token),
    ]


def train_fillers(texts: list[str]) -> Booster:
    """The filler trees: learned from ``SOUNDS``, from ``WORDS``, and from the tokens of ``texts`` that have a letter no sound has."""
    own = [t for text in texts for t in _NOISE.sub(" ", text).split()][:FILLER_TOKENS]
    other = [x for x in map(token_features, own) if x[0] > 0]
    marked = [t + e for t in SOUNDS for e in ("", ",", "…")], [t + e for t in WORDS for e in ("", ",", ".")]
    x = np.array([*map(token_features, marked[0]), *map(token_features, marked[1]), *other])
    y = np.r_[np.ones(len(marked[0])), np.zeros(len(marked[1]) + len(other))]
    return train(x, y, rounds=40, depth=4, penalty=0.1)


class Speech(dict):
    """Token -> 1 if it is a word of speech, else 0; each distinct token is decided once per task."""

    def __init__(self, fillers: Booster):
        super().__init__()
        self.fillers = fillers

    def is_hesitation(self, token: str) -> bool:
        """Token-level filler decision."""
        x = token_features(token)
        return x[1] > 0 and self.fillers.one(x) > 0

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[token] = int(any(c.isalnum() for c in token) and not self.is_hesitation(token))
        return n

    def count(self, text: str) -> int:
        """Blank-separated tokens that hold a letter or digit, without remarks, time marks and hesitation sounds."""
        return sum(map(self.__getitem__, (_NOISE.sub(" ", text) if _MAY_BE_NOISE.search(text) else text).split()))


@lru_cache(maxsize=4096)
def _roster(entries: tuple[tuple[str, int, str], ...]) -> tuple[dict[str, str | None], int]:
    """(name in lower case -> speaker id, or None where two speakers share it; most words of a name)."""
    names: dict[str, str | None] = {}

    def add(name: str, who: str) -> None:
        key = " ".join(name.lower().split())
        if key:
            names[key] = who if names.get(key, who) == who else None

    for who, number, full in entries:
        add(f"speaker {number}", who)
        words = (full or "").split()
        if words:
            add(full, who)
            add(words[-1], who)
            add(words[0], who)
            if len(words) > 1:
                add(f"{words[-1]}, {' '.join(words[:-1])}", who)
                add(f"{words[0][0]}. {words[-1]}", who)
                add(f"{words[0][0]} {words[-1]}", who)
    return names, max((len(n.split()) for n in names), default=0)


#: Where a label may stand: in brackets, in a voice tag, a numbered speaker, or before a colon.
_LABEL = re.compile(r"\[\s*([^\[\]]{1,200}?)\s*\]:?|<v\s+([^<>]{1,200}?)\s*>|(?<![\w.'-])((?:speaker|spk)[ _]?\d+)(?:\s*:(?!\d)|\s+[-–—]+\s)|:(?!\d)", re.I)
_ARROWS = re.compile(r">>+\s*$")
_LAST = re.compile(r"\S+\s*$")


def find_labels(text: str, names: dict[str, str | None], longest: int) -> list[tuple[int, int, str]]:
    """Speaker labels in ``text``: (start, end, name as written), left to right."""
    out, at = [], 0
    for m in _LABEL.finditer(text):
        start, end = m.span()
        if start < at:
            continue
        name = m[1] or m[2] or m[3]
        if name is not None:
            if m[3] is None and not _NUMBERED.fullmatch(name) and " ".join(name.lower().split()) not in names:
                continue
        else:  # a colon: the longest name that ends before it
            low, begin, found = max(at, start - 200), start, None
            for _ in range(longest):
                w = _LAST.search(text, low, begin)
                if w is None:
                    break
                begin = w.start()
                own = text[begin:start]
                skip = next((i for i, c in enumerate(own) if c.isalnum()), len(own))
                for lead in {0, skip}:
                    before = text[begin + lead - 1 : begin + lead] if begin + lead > at else ""
                    if not (before.isalnum() or before in ("_", ".", "'", "-")) or not before:
                        if " ".join(own[lead:].lower().split()) in names:
                            found = begin + lead
            if found is None:
                continue
            start, name = found, text[found:start].strip()
        arrows = _ARROWS.search(text, max(at, start - 200), start)
        out.append((arrows.start() if arrows else start, end, name))
        at = end
    return out


def resolve(name: str | None, names: dict[str, str | None], ids: set[str]) -> str | None:
    """Speaker id that ``name`` stands for: an id in any notation, a numbered label or a spelling of a roster name."""
    if not name:
        return None
    m = _UUID.search(name)
    if m:
        who = "-".join(m.groups()).lower()
        return who if who in ids or not ids else None
    m = _NUMBERED.search(name)
    if m:
        return names.get(f"speaker {int(m[1])}")
    return names.get(" ".join(name.lower().split()))


def split_segment(text: str, spoken_by: str | None, entries: tuple, speech: Speech) -> list[tuple[str | None, int, bool, bool, bool]]:
    """Pieces of a segment in order: (speaker, words, begins with a label, ends like a sentence, speaker stated by id)."""
    names, longest = _roster(entries)
    ids = {e[0] for e in entries}
    who, labelled, at, out = resolve(spoken_by, names, ids), False, 0, []
    for start, end, name in find_labels(text, names, longest):
        out.append((who, text[at:start], labelled))
        who, labelled, at = resolve(name, names, ids), True, end
    out.append((who, text[at:], labelled))
    by_id = bool(spoken_by and _UUID.search(spoken_by))
    return [(w, n, lab, t.rstrip()[-1:] in (".", "?", "!"), by_id and not lab and w is not None) for w, t, lab in out if (n := speech.count(t))]


PIECES = "transcript string, ns long, end_ns long, row long, piece int, who string, words long, labelled boolean, closed boolean, by_id boolean"
_FIELD, _ENTRY = "\x01", "\x02"


@lru_cache(maxsize=4096)
def _entries(roster: str | None) -> tuple[tuple[str, int, str], ...]:
    each = [e.split(_FIELD) for e in roster.split(_ENTRY)] if roster else []
    return tuple(sorted((who, int(no or 0), name) for who, no, name in each))


def _splitter(fillers: Booster):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, speech = [c.split(" ")[0] for c in PIECES.split(", ")], Speech(fillers)
        for pdf in batches:
            rows = []
            for transcript, ns, end_ns, row, spoken, text, roster in zip(*(pdf[c] for c in ("transcript", "ns", "end_ns", "row", "spoken", "text", "roster")), strict=True):
                for i, piece in enumerate(split_segment(text, spoken, _entries(roster), speech)):
                    rows.append((transcript, ns, end_ns, row, i, *piece))
            yield pd.DataFrame(rows, columns=columns).astype({"piece": "int32"})

    return split


def nanoseconds(col: Column) -> Column:
    """Nanoseconds since 1970 of an ISO UTC text with up to nine fraction digits; null if it is none."""
    fraction = F.regexp_extract(col, r"\.(\d+)Z$", 1)
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(col, 1, 19), F.lit("Z"))))
    return whole * 1_000_000_000 + F.substring(F.rpad(fraction, 9, "0"), 1, 9).cast("bigint")


#: Copies of a roster where the rosters are too many to broadcast: rows of a long transcript spread over so many join keys.
SALTS = 16


def clean_pieces(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speech of ``segments`` cut at labels, one row per piece with at least one word."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\x01\x02]", " ")
    entry = F.concat_ws(_FIELD, plain(dashed(F.col("spokenBy"))), F.coalesce(F.col("speakerNo").cast("string"), F.lit("0")), plain(F.col("speakerName")))
    roster = speakers.where("transcriptId is not null and spokenBy is not null").groupBy(dashed(F.col("transcriptId")).alias("transcript")).agg(F.array_join(F.array_sort(F.collect_set(entry)), _ENTRY).alias("roster"))
    s = segments.where("transcriptId is not null and startTime is not null and originalText is not null")
    key = F.coalesce(dashed(F.col("id")), F.concat(F.lit("row:"), F.col("sp_row_id").cast("string")))
    row = F.struct(F.col("sp_row_id").alias("row"), dashed(F.col("transcriptId")).alias("transcript"), nanoseconds(F.col("startTime")).alias("ns"), nanoseconds(F.col("endTime")).alias("end_ns"), F.col("spokenBy").alias("spoken"), F.col("originalText").alias("text"))
    once = s.groupBy(key.alias("_k")).agg(F.min_by(row, "sp_row_id").alias("r")).select("r.*").where("ns is not null")
    sample = s.select(F.xxhash64("sp_row_id").alias("_h"), "originalText").orderBy("_h", "originalText").limit(FILLER_SEGMENTS)
    fillers = train_fillers([r["originalText"] for r in sample.collect()])
    roster = cut(roster)
    small = broadcast_if_small(roster)
    if small is roster:
        copies = roster.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = once.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(copies, ["transcript", "_salt"], "left").drop("_salt")
    else:
        joined = once.join(small, "transcript", "left")
    return joined.mapInPandas(_splitter(fillers), PIECES)


#: What the boundary trees see of two adjacent pieces.
FEATURES = ["same", "gap", "labelled", "inside", "closed", "words", "before"]


def adjacent_pieces(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Every piece with the features of its step from the piece before; computed once.

    ``f_same`` is 1 or 0 where the roster tells both speakers, else -1; ``stated`` is whether both are the same by the ids
    given with the segments (null where one has none); ``first`` marks a transcript's first piece.
    """
    pieces = cut(clean_pieces(segments, speakers).withColumn("chunk", F.floor(F.col("ns") / HOUR_NS)))
    order = ["ns", "row", "piece"]
    w = Window.partitionBy("transcript", "chunk").orderBy(*order)
    now = F.struct(*order, "who", "end_ns", "closed", "words", "by_id")
    edges = pieces.groupBy("transcript", "chunk").agg(F.max(now).alias("_last"))
    edges = edges.withColumn("_carry", F.lag("_last").over(Window.partitionBy("transcript").orderBy("chunk"))).drop("_last")
    near = pieces.withColumn("_p", F.lag(now).over(w)).join(edges, ["transcript", "chunk"])
    near = near.withColumn("_p", F.coalesce("_p", "_carry")).drop("_carry")
    same = F.when(F.col("_p.who").isNull() | F.col("who").isNull(), F.lit(-1.0)).when(F.col("_p.who") == F.col("who"), F.lit(1.0)).otherwise(F.lit(0.0))
    gap = F.least(F.greatest(F.coalesce((F.col("ns") - F.col("_p.end_ns")) / 1e9, F.lit(0.0)), F.lit(-60.0)), F.lit(600.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = [same, gap, flag(F.col("labelled")), flag(F.col("_p.row") == F.col("row")), flag(F.col("_p.closed")), F.col("words").cast("double"), F.coalesce(F.col("_p.words"), F.lit(0)).cast("double")]
    stated = F.when(F.col("by_id") & F.col("_p.by_id"), F.col("_p.who") == F.col("who"))
    out = near.withColumns({f"f_{n}": v for n, v in zip(FEATURES, values, strict=True)} | {"stated": stated, "first": F.col("_p").isNull()})
    return cut(out.select("transcript", "chunk", *order, "who", "words", "first", "stated", *[f"f_{n}" for n in FEATURES]))


def training_sample(near: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: another speaker by the stated ids) of at most ``most`` adjacent pairs, in hash order."""
    rows = near.where("stated is not null").select(*[f"f_{n}" for n in FEATURES], "stated", F.xxhash64("transcript", "ns", "row", "piece").alias("_h"))
    sample = rows.orderBy("_h", *[f"f_{n}" for n in FEATURES]).limit(most).toPandas()
    return sample[[f"f_{n}" for n in FEATURES]].to_numpy(float), 1.0 - sample["stated"].to_numpy(float)


def boundary_figures(segments: DataFrame, speakers: DataFrame, training_pairs: int = TRAINING_PAIRS) -> DataFrame:
    """(``names``, ``pairs``, ``accuracy``, ``boundaries``): the boundary trees on a fifth of the sample that they were not trained on.

    With the names shown and with all of them hidden; ``boundaries`` is the share of pairs with a boundary.
    """
    x, y = training_sample(adjacent_pieces(segments, speakers), training_pairs)
    n = len(y) * 4 // 5
    known = x[:n].copy()
    known[1::2, 0] = -1.0
    model, rows = train(known, y[:n]), []
    for names in ("shown", "hidden"):
        held = x[n:].copy()
        if names == "hidden":
            held[:, 0] = -1.0
        right = float(((model.log_odds(held) >= 0) == (y[n:] == 1)).mean()) if len(held) else None
        rows.append((names, len(held), right, float(y[n:].mean()) if len(held) else None))
    return segments.sparkSession.createDataFrame(rows, "names string, pairs long, accuracy double, boundaries double")


def speaker_turns(segments: DataFrame, speakers: DataFrame, training_pairs: int = TRAINING_PAIRS) -> DataFrame:
    """(``transcript_id``, ``turn_no``, ``spoken_by``, ``sp_row_id``, ``n_words``), turns of known speakers from 1.

    Segments go by startTime, equal ones by row id; one without transcript, time or text has no speech. A turn whose
    speaker cannot be told has no row but keeps its number. ``speakers`` without a transcript: ids stand for themselves.
    Empty tables give no rows; extra columns are ignored.
    """
    near = adjacent_pieces(segments, speakers)
    x, y = training_sample(near, training_pairs)
    x[1::2, 0] = -1.0
    model = train(x, y)
    order = ["ns", "row", "piece"]
    w = Window.partitionBy("transcript", "chunk").orderBy(*order)
    guess = model.column([F.col(f"f_{n}") for n in FEATURES]) >= 0
    begins = F.col("first") | (guess & (F.col("f_same") != 1))
    marked = near.select("transcript", "chunk", *order, "who", "words", begins.cast("bigint").alias("b"))

    def numbered(rows: DataFrame) -> DataFrame:  # turns by the sum of boundaries, per hour with one row per hour ahead
        local = rows.withColumn("_t", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        ahead = rows.groupBy("transcript", "chunk").agg(F.sum("b").alias("_n"))
        ahead = ahead.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy("transcript").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        return local.join(ahead, ["transcript", "chunk"]).withColumn("turn_no", F.col("_t") + F.col("_off")).drop("_t", "_off")

    # A turn has one speaker: who differs from the last known speaker of the same turn begins another.
    guessed = numbered(marked)
    told = F.when(F.col("who").isNotNull(), F.struct("turn_no", "who"))
    carry = guessed.groupBy("transcript", "chunk").agg(F.max_by(told, F.when(F.col("who").isNotNull(), F.struct(*order))).alias("_l"))
    carry = carry.withColumn("_carry", F.last("_l", ignorenulls=True).over(Window.partitionBy("transcript").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_l")
    last = F.coalesce(F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    checked = guessed.join(carry, ["transcript", "chunk"]).withColumn("_l", last)
    other = F.coalesce((F.col("_l.turn_no") == F.col("turn_no")) & (F.col("_l.who") != F.col("who")), F.lit(False))
    local = numbered(checked.withColumn("b", F.when(other, 1).otherwise(F.col("b"))).drop("turn_no", "_l", "_carry"))
    turns = local.groupBy("transcript", "turn_no")
    first = F.min(F.struct(*order))
    out = turns.agg(first["row"].alias("sp_row_id"), F.min_by("who", F.when(F.col("who").isNotNull(), F.struct(*order))).alias("spoken_by"), F.sum("words").alias("n_words"))
    return out.where("spoken_by is not null").select(F.col("transcript").alias("transcript_id"), "turn_no", "spoken_by", "sp_row_id", "n_words")
