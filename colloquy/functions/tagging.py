"""Pluggable taggers, chunkers, subword tokenizers and encoders, with deterministic defaults.

Each factory takes a plain Python function, so that a model can be put in place of the default; it is loaded once per
Python worker. Texts travel in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import STOP_WORDS

#: Tags of closed-class words (Penn treebank).
CLOSED = {
    "DT": "a an the this that these those each every some any no", "IN": "of in on at by for with from to about into over after before under between if because until",
    "PRP": "i you he she it we they me him her us them", "PRP$": "my your his its our their", "CC": "and or but nor so yet", "MD": "can could will would shall should may might must",
    "VB": "be is are was were do does did have has had go get make take keep send check move see give find think", "RB": "not very now then here there again just also",
}
_LEXICON = {w: tag for tag, ws in CLOSED.items() for w in ws.split()}


def default_tag(token: str) -> str:
    """Tag by closed-class lexicon, shape and suffix."""
    low = token.lower()
    if low in _LEXICON:
        return _LEXICON[low]
    if re.fullmatch(r"[\d.,:]+", token):
        return "CD"
    if not re.search(r"\w", token):
        return "."
    for suffix, tag in (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ive", "JJ"), ("al", "JJ"), ("ic", "JJ")):
        if low.endswith(suffix) and len(low) > len(suffix) + 2:
            return tag
    if token[:1].isupper():
        return "NNP"
    return "NNS" if low.endswith("s") and not low.endswith("ss") and len(low) > 3 else "NN"


TAGGED = "array<struct<tok:string,pos:string>>"
_TOKEN = re.compile(r"\w+(?:['-]\w+)*|[^\w\s]")


def pos_tag(text: Column, tag: Callable[[str], str] = default_tag) -> Column:
    """Tokens and tags of a text; null and empty texts have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"tok": w, "pos": tag(w)} for w in _TOKEN.findall(t)] if t else [] for t in texts])

    return F.pandas_udf(run, TAGGED)(text)


def filter_by_pos(tagged: Column, tags: list[str]) -> Column:
    return F.filter(tagged, lambda x: x["pos"].isin(tags) & (x["tok"] != "XnumberX"))


#: Grammars over tag sequences: candidate phrases, action phrases and what the action is; later ones only where the earlier find nothing (actions, subjects).
CANDIDATES = [r"(?:(?:<JJ[^>]*>)*(?:<NN[^>]*>)+<IN>)?(?:<JJ>)*(?:<NN[^>]*>)+", r"<VB+>(?:<[^>]+>){0,2}(?:<NN[^>]+>)+", r"(?:<NN[^>]+>)+(?:<[^>]+>){0,2}(?:<NN[^>]+>)+"]
_NOUNS = r"(?:<NN[^>]*>)+(?:(?:<[^>]+>){0,2}(?:<JJ[^>]*>)*(?:<NN[^>]*>)+)*"
ACTIONS = [rf"(?:<MD>|<VB>)+(?:<[^>]+>){{0,2}}(?:<VB>)+(?:<[^>]+>){{0,{gap}}}{_NOUNS}" for gap in (2, 5)]
SUBJECTS = [rf"(?:<VB>)+(?:<[^>]+>){{0,{gap}}}{_NOUNS}" for gap in (2, 5)]


def tokens_of(text: str) -> list[str]:
    """Words and single punctuation marks."""
    return _TOKEN.findall(text)


def chunk_tags(tokens: list[str], tags: list[str], grammar: str) -> list[str]:
    """Phrases of the tokens whose tags match ``grammar``; matches that touch are one phrase. No match spans a sentence end."""
    out, at = [], 0
    ends = [i for i, t in enumerate(tags) if t == "." and tokens[i] in ".?!"] + [len(tags)]
    for end in ends:
        starts, n = {}, 0
        for i in range(at, end):
            starts[n] = i
            n += len(tags[i]) + 2
        starts[n] = end
        line, runs = "".join(f"<{t}>" for t in tags[at:end]), []
        for m in re.finditer(grammar, line):
            if m.end() > m.start():
                if runs and runs[-1][1] == m.start():
                    runs[-1][1] = m.end()
                else:
                    runs.append([m.start(), m.end()])
        out += [" ".join(tokens[starts[a] : starts[b]]) for a, b in runs]
        at = end + 1
    return out


def chunk(tagged: Column, grammars: list[str] = CANDIDATES, first_only: bool = False) -> Column:
    """Phrases by all grammars in turn; with ``first_only`` by the first that finds any. Stop words alone are dropped."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for row in rows:
                toks, tags, found = [x["tok"] for x in row], [x["pos"] for x in row], []
                for g in grammars:
                    found += [p for p in chunk_tags(toks, tags, g) if p.lower() not in STOP_WORDS and p not in found]
                    if found and first_only:
                        break
                out.append(found)
            yield pd.Series(out)

    return F.pandas_udf(run, "array<string>")(tagged)


def all_tags_allowed(phrases: Column, tags: list[str], tag: Callable[[str], str] = default_tag) -> Column:
    """The phrases every token of which has one of ``tags``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[p for p in x if all(tag(w) in tags for w in _TOKEN.findall(p))] if x is not None else [] for x in lists], dtype=object)

    return F.pandas_udf(run, "array<string>")(phrases)


def query_text(words: Column, tags: list[str], tag: Callable[[str], str] = default_tag) -> Column:
    """One word stands for itself; of several, joined by blanks, the tokens with one of ``tags`` are kept."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series(["" if x is None or len(x) == 0 else x[0] if len(x) == 1 else " ".join(w for w in _TOKEN.findall(" ".join(x)) if tag(w) in tags) for x in lists], dtype=object)

    return F.pandas_udf(run, "string")(words)


def negated(tokens: Column, at: Column, drop: list[str] = ("cannot", "not")) -> Column:
    """Whether one of the three tokens before position ``at`` (from 0) is a negation."""
    return F.arrays_overlap(F.slice(tokens, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3))), F.array(*[F.lit(w) for w in drop]))


def entities(text: Column, find: Callable[[str], list[tuple[str, str, float]]] | None = None) -> Column:
    """ARRAY<STRUCT<entity, label, score>>; by default runs of capitalised words that do not open a sentence."""

    def default(t: str) -> list[tuple[str, str, float]]:
        return [(m.group(0), "MISC", 0.5) for m in re.finditer(r"(?<=[a-z,;] )[A-Z][\w-]+(?: [A-Z][\w-]+)*", t)]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"entity": e, "label": k, "score": s} for e, k, s in dict.fromkeys((find or default)(t))] if t else [] for t in texts])

    return F.pandas_udf(run, "array<struct<entity:string,label:string,score:double>>")(text)


def entity_preference(label: Column) -> Column:
    """MISC 1, ORG 2, PER 3, LOC 4, O 5, others 6."""
    out = F.lit(6)
    for i, k in enumerate(["MISC", "ORG", "PER", "LOC", "O"]):
        out = F.when(label == k, i + 1).otherwise(out)
    return out


def preferred_label(labels: Column) -> Column:
    """The label of an array that :func:`entity_preference` puts first; equals by name."""
    return F.array_min(F.transform(labels, lambda k: F.struct(entity_preference(k).alias("p"), k.alias("k"))))["k"]


def encode(text: Column, dim: int = 64, model: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """Sentence vector ARRAY<DOUBLE>; by default hashed words, signed and normalised. A blank text is the zero vector."""

    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = hashlib.md5(w.encode()).digest()
                out[i, int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list((model or hashed)(texts.tolist()))) if len(texts) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def _wordpieces(w: str | None, vocabulary: set[str], unknown: str, longest: int) -> list[str]:
    out, at = [], 0
    if not w or len(w) > longest:
        return [unknown] if w else []
    while at < len(w):
        end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(("##" if at else "") + w[at:end])
        at = end
    return out


def wordpiece(token: Column, vocabulary: set[str], unknown: str = "[UNK]", longest: int = 100) -> Column:
    """Greedy longest-match subwords; later pieces start with ``##``."""
    return _series_udf(lambda w: _wordpieces(w, vocabulary, unknown, longest), "array<string>")(token)


def wordpiece_text(tokens: Column, vocabulary: set[str], unknown: str = "[UNK]", longest: int = 100) -> Column:
    """Subwords of all of a text's blank-separated tokens, joined by blanks."""
    return _per_token(lambda w: _wordpieces(w, vocabulary, unknown, longest))(tokens)


def _merged(w: str | None, ranks: dict[tuple[str, str], int]) -> list[str]:
    if not w:
        return []
    s = [*w[:-1], w[-1] + "</w>"]
    while len(s) > 1:
        best = min(zip(s, s[1:]), key=lambda p: ranks.get(p, 1 << 60))  # noqa: B905
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                out.append(s[i] + s[i + 1])
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out
    return s


def bpe(token: Column, ranks: dict[tuple[str, str], int]) -> Column:
    """Byte-pair merges by rank; the last symbol carries ``</w>``."""
    return _series_udf(lambda w: _merged(w, ranks), "array<string>")(token)


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def bpe_text(tokens: Column, ranks: dict[tuple[str, str], int]) -> Column:
    """Byte-pair merges of all of a text's blank-separated tokens by byte-level ``ranks``, joined by blanks."""
    signs = byte_symbols()
    return _per_token(lambda w: _merged("".join(signs[b] for b in w.encode()), ranks))(tokens)


def piece_vocabulary() -> set[str]:
    """Subwords of the installed public 32,000-piece vocabulary; pieces that do not open a word start with ``##``."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kept = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    opening = {p[1:] for p in kept if p.startswith("\u2581")}
    inner = {p for p in kept if "\u2581" not in p}
    return {p for p in opening if p} | {"##" + p for p in inner} | {p for p in inner if len(p) == 1}


def merge_ranks() -> dict[tuple[str, str], int]:
    """Merges of the installed public byte-level vocabulary with word ends."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return {tuple(m): i for i, m in enumerate(json.load(f)["model"]["merges"])}


def _per_token(f: Callable[[str], list[str]]):
    """Each distinct token of a batch's texts goes through ``f`` once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                words = t.split(" ") if t else []
                for w in words:
                    if w not in known:
                        known[w] = " ".join(f(w))
                out.append(" ".join([known[w] for w in words]))
            if len(known) > 500_000:
                known.clear()
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def _series_udf(f: Callable, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([f(x) for x in s], dtype=object)

    return F.pandas_udf(run, kind)
