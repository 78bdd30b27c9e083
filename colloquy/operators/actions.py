"""Action items and questions by token rules and a tag grammar."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import tagging
from colloquy.functions.text import CONTRACTIONS, STOP_WORDS, expand_contractions_tok

#: Words that mark a wish or duty; phrases that always make an action item, and phrases that never do.
MARKERS = ["we", "i", "you", "let's", "i'll", "we'll", "go"]
FIXED, OMIT = ["let's take an action", "can you", "can we", "let's work", "let's make"], ["can you hear"]
#: Words for the speaker, for the other side, and for both.
FIRST_PERSON, SECOND_PERSON, COMBINED = ["i", "we", "we'll", "i'll"], ["you"], ["let's"]
#: Stop words that an action item may begin with.
NOT_STOP = ["get", "give", "go", "do", "make", "please", "see"]
#: Words before a phrase that make it no candidate; first words that drop it.
PRESENT, NEGATING = ["just", "now"], ["cannot", "not"]
DROP_FIRST, DROP_VERBS = ["see", "be", "would"], ["tell", "talk", "walk"]

ACTION_STOP = [w for w in STOP_WORDS if w not in NOT_STOP]
EXPANDED_FIXED = ["".join(" " + CONTRACTIONS.get(w, w) for w in p.split(" ")) for p in FIXED]  # each begins a word


def _has_phrase(t: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(t).contains(p)
    return out


def _tokens(t: Column) -> Column:
    """Blank-separated tokens in lower case."""
    return F.split(F.lower(t), " ")


def _holds(t: Column, words: list[str]) -> Column:
    return F.arrays_overlap(_tokens(t), F.array(*[F.lit(w) for w in words]))


def long_enough(sentence: Column) -> Column:
    """More than two blank-separated tokens."""
    return F.size(F.split(sentence, " ")) > 2


def _lookup(sentence: str, candidates: list[str], words: list[str]) -> list[str]:
    """Candidates, once for each place where none of the three tokens before is one of ``words``."""
    line = sentence.translate({ord(c): None for c in ".,?"}).lower().split(" ")
    kept = []
    for c in candidates:
        own = c.split(" ")
        for at in range(len(line) - len(own) + 1):
            if line[at : at + len(own)] == own and not set(line[max(0, at - 3) : at]) & set(words):
                kept.append(c)
    return kept


def subjects_of(sentence: str, tag: Callable[[str], str] = tagging.default_tag) -> list[str]:
    """What is to be done, by the tag grammar: verb phrases that no word of the present or negation stands before."""
    text = " ".join(CONTRACTIONS.get(w, w) for w in sentence.lower().split(" "))
    text = " ".join("I" if w == "i" else w for w in text.split(" "))

    def phrases(t: str, grammars: list[str]) -> list[str]:
        tokens = tagging.tokens_of(t)
        tags = [tag(w) for w in tokens]
        for g in grammars:
            found = [p.lower() for p in tagging.chunk_tags(tokens, tags, g) if p.lower() not in ACTION_STOP]
            if found:
                return [p.replace(" '", "'") for p in found]
        return []

    first = lambda p: p.split(" ")[0]
    actions = [p for p in _lookup(text, phrases(text, tagging.ACTIONS), PRESENT) if first(p) not in DROP_FIRST]
    if not actions:
        return []
    rest = text[max(0, text.lower().find(actions[0])) :]
    found = [p for p in phrases(rest, tagging.SUBJECTS) if first(p) not in DROP_FIRST + DROP_VERBS]
    found = _lookup(text, found, NEGATING)
    return [] if all(first(p) in ACTION_STOP for p in found) else found


def action_subjects(sentence: Column, tag: Callable[[str], str] = tagging.default_tag) -> Column:
    """ARRAY<STRING> of :func:`subjects_of`; null and empty sentences have none. ``tag`` may be a model."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sentences in batches:
            yield pd.Series([subjects_of(s, tag) if s else [] for s in sentences], dtype=object)

    return F.pandas_udf(run, "array<string>")(sentence)


def is_question(sentence: Column, subjects: Column) -> Column:
    """More than two tokens, a question mark at the end and something that is to be done."""
    return long_enough(sentence) & sentence.endswith("?") & (F.size(subjects) > 0)


def has_marker(sentence: Column) -> Column:
    return _holds(sentence, MARKERS)


def is_fixed(sentence: Column) -> Column:
    """A fixed phrase, contractions written out, and no omitted one."""
    full = expand_contractions_tok(sentence)
    return _has_phrase(full, EXPANDED_FIXED) & ~_has_phrase(full, OMIT)


def action_score(sentence: Column) -> Column:
    """Rule score in place of a classifier: 1 for a fixed phrase, 0.8 for a marker, 0 for short sentences."""
    return F.when(~long_enough(sentence), 0.0).when(is_fixed(sentence), 1.0).when(has_marker(sentence), 0.8).otherwise(0.0)


def is_action_item(sentence: Column, subjects: Column, score: Column | None = None) -> Column:
    """A fixed phrase with score >= 0.5 passes; else score >= 0.8, a marker word and something that is to be done."""
    s = action_score(sentence) if score is None else score
    return long_enough(sentence) & F.when(is_fixed(sentence), s >= 0.5).otherwise((s >= 0.8) & has_marker(sentence) & (F.size(subjects) > 0))


def action_text(sentence: Column, subjects: Column) -> Column:
    """The sentence of a fixed phrase; else the words from the first subject to the end of the last, with a capital letter."""
    full = expand_contractions_tok(sentence)
    a = F.position(F.get(subjects, F.lit(0)), F.lower(full))
    last = F.element_at(subjects, -1)
    span = F.substring(full, a, F.position(last, F.lower(full)) + F.length(last) - a)
    own = F.when((F.size(subjects) > 1) & (a > 0), span).otherwise(F.get(subjects, F.lit(0)))
    return F.when(is_fixed(sentence), sentence).otherwise(F.concat(F.upper(F.substring(own, 1, 1)), F.regexp_replace(own, "(?s)^.", "")))


def substantial(item: Column) -> Column:
    """More than four words that are no stop words; or more than three and a last word of over four letters."""
    words = F.split(item, " ")
    kept = F.size(F.filter(words, lambda w: ~w.isin(ACTION_STOP)))
    return (kept > 4) | ((F.length(F.element_at(words, -1)) > 4) & (kept > 3))


def assignee(sentence: Column) -> Column:
    """0 the speaker, 2 both sides, 1 the one who spoke before (never, as no text holds the one word twice as a set)."""
    first, second, both = (_holds(sentence, w) for w in (FIRST_PERSON, SECOND_PERSON, COMBINED))
    return F.when((both & ~first & ~second) | (first & second), 2).otherwise(0).cast("bigint")
