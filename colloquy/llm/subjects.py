"""Subject areas of documents (problem 9).

Labelling functions vote on each (document, subject): distinct lexicon terms in the title, the abstract, the claims and
the description (sections), the share of the document's lexicon terms that are the subject's (lexicon), the applicant
(address), the source feed and the other members of the patent family. Votes are small integers. Sentences that mention a
field only for comparison or background do not vote; the phrases that tell them are learned too. A latent-class model with
one accuracy table per labelling function gives posterior probabilities (labelled documents are clamped); documents get the
subjects above a threshold fitted on the labelled documents.

The lexicon and the background phrases are learned on bounded samples: from labelled documents, then again from these and
a sample of others with confident posteriors. Everything after that covers all documents. The model is learned by EM over
the counts of all vote patterns, which stay on the cluster: a round sends back sums per labelling function and vote.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import bounded_rows, broadcast_if_small, cut

#: Bounds of the samples the lexicon is learned on, of the lexicon and of the background phrases.
LABELLED_DOCS, OTHER_DOCS, LEXICON_TERMS, CUES = 20_000, 4_000, 20_000, 2_000
#: Most subjects; more are an error.
SUBJECTS = 10_000
#: Times the lexicon is learned again from labelled documents and confident guesses on the sample. A second time takes in
#: wrong guesses: with 236 labels, held-out precision falls from 1.0 to 0.97, a third time from there to 0.93.
ROUNDS = 1
#: A subject with fewer terms than this in the lexicon gets those of its title and description besides.
FEW_TERMS = 20
#: Vote of a text in which no term speaks for any subject.
ABSTAINS = 7

_WORD = re.compile(r"[^\W\d_]+")
_ABSTRACT = re.compile(r"(?m)^(?:<p[^>\n]*>)?[ \t]*(?:\(57\)\s*)?(?:abstract|zusammenfassung|abrégé)\b")
_DESCRIPTION = re.compile(r"(?m)^(?:<p[^>\n]*>)?[ \t]*(?:detailed description|description|background and summary|beschreibung)\b")
_CLAIMS = re.compile(r"(?m)^(?:<p[^>\n]*>)?[ \t]*(?:what is claimed is|claims|we claim|patentansprüche|revendications)\b")

SECTIONS = ("title", "abstract", "claims", "description")
#: Upper ends of the vote levels of each labelling function; one more level lies above the last.
LEVELS = {"title": (0, 1), "abstract": (0, 1, 2, 4), "claims": (0, 1, 2, 4), "description": (0, 1, 3, 6, 12), "share": (0.0, 0.04, 0.12, 0.3, 0.5)}


def background_spans(low: str, cues: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sentences (start, end) of ``low`` around the ``cues`` (start, end in ascending order), without overlaps."""
    spans, at = [], 0
    for start, end in cues:
        if start < at:
            continue
        a = max(low.rfind(". ", at, start) + 1, low.rfind(".\n", at, start) + 1, low.rfind("\n\n", at, start) + 1, low.rfind("]", max(at, start - 400), start) + 1, at)
        ends = [e for e in (low.find(". ", end), low.find(".\n", end), low.find("\n\n", end), low.find(".<", end)) if e >= 0]
        at = min(ends) if ends else len(low)
        spans.append((a, at))
    return spans


def foreground(low: str, cues: list[str]) -> str:
    """``low`` (lower case) with the sentences blanked that hold one of the background phrases ``cues``; its length stays."""
    out, at = [], 0
    found = sorted(m.span() for m in re.finditer("|".join(map(re.escape, cues)), low)) if cues else []
    for a, b in background_spans(low, found):
        out += [low[at:a], " " * (b - a)]
        at = b
    out.append(low[at:])
    return "".join(out)


def section_starts(low: str) -> tuple[int, int, int]:
    """Where abstract, description and claims begin; the title lies before the abstract.

    Without a heading of the description, it begins after the abstract's first blank line, or there is none.
    """
    a, d, c = _ABSTRACT.search(low), _DESCRIPTION.search(low), _CLAIMS.search(low)
    a0 = a.start() if a else min(len(low), low.find("\n") if "\n" in low else len(low))
    d0 = d.start() if d and d.start() >= a0 else None
    c0 = c.start() if c and c.start() >= a0 else len(low)
    if d0 is None:
        blank = low.find("\n\n", a.end() if a else a0)
        blank = low.find("\n\n", blank + 2) if 0 <= blank - (a.end() if a else a0) < 3 else blank
        d0 = min(blank, c0) if blank >= 0 else c0
    return a0, d0, c0


def grams(text: str | None) -> set[str]:
    """Distinct words and word pairs."""
    w = _WORD.findall((text or "").lower())
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}  # noqa: B905


def with_grams(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) plus ``terms``: the distinct words and word pairs of each text."""

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(grams(t)) for t in texts])

    return docs.withColumn("terms", F.pandas_udf(split, "array<string>")("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(``term``, ``subject``, ``n``) over ``docs`` (``terms``, ``subjects``); subject '' counts all documents."""
    each = docs.select(F.explode("terms").alias("term"), F.concat(F.array(F.lit("")), "subjects").alias("subjects"))
    return each.select("term", F.explode("subjects").alias("subject")).groupBy("term", "subject").agg(F.count(F.lit(1)).alias("n"))


def learn_lexicon(docs: DataFrame, seeds: DataFrame | None = None, least: int = 3, purity: float = 0.55, surprise: float = 4.0, terms: int = LEXICON_TERMS) -> dict[str, str]:
    """Term -> subject, for terms most of whose documents have that subject; at most ``terms``, the best supported first.

    ``purity`` bounds the share of the term's documents with the subject, shrunk by half a document; ``surprise`` is how
    many standard deviations that share must lie above the subject's own share of the sample. A subject of few documents
    needs two of them for a term instead of ``least``. Subjects for which fewer than ``FEW_TERMS`` terms are found also
    get those of ``seeds`` (``term``, ``subject``).
    """
    n = cut(term_counts(docs))
    total = float(max(1, docs.count()))
    base = docs.select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("own"), (F.count(F.lit(1)) / F.lit(total)).alias("base"))
    all_docs = n.where("subject = ''").select("term", F.col("n").alias("d"))
    best = n.where("subject <> ''").groupBy("term").agg(F.max_by("subject", F.struct("n", "subject")).alias("subject"), F.max("n").alias("n"))
    kept = best.where(F.col("n") >= 2).join(all_docs, "term").join(broadcast_if_small(base), "subject").where((F.col("n") >= least) | (F.col("own") <= 3 * least))
    expected = F.col("d") * F.col("base")
    kept = kept.withColumns({"p": (F.col("n") - 0.5) / (F.col("d") + 0.5), "z": (F.col("n") - expected) / F.sqrt(expected * (1.02 - F.col("base")))})
    rows = kept.where((F.col("p") >= purity) & (F.col("z") >= surprise)).orderBy(F.desc(F.col("n") * F.col("p")), "term").limit(terms).select("term", "subject").collect()
    found = {r["term"]: r["subject"] for r in rows}
    if seeds is not None:
        size = Counter(found.values())
        found |= {r["term"]: r["subject"] for r in seeds.collect() if size[r["subject"]] < FEW_TERMS and r["term"] not in found}
    return found


def described_terms(sample: DataFrame, subjects: DataFrame, share: float = 0.15, stem: int = 5, terms: int = 1_000) -> DataFrame:
    """(``term``, ``subject``): words of the sample that begin like a word of one subject's title or description, and of no other's.

    ``subjects`` is (``subject``, ``title``, ``description``), a small table. Words in more than ``share`` of the sample's
    documents do not count; at most ``terms`` words, the most frequent first.
    """
    said = subjects.select("subject", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "title", "description")), F.lit(r"(\p{L}+)"))).alias("w"))
    stems = said.where(F.length("w") >= stem).select("subject", F.substring("w", 1, stem).alias("stem")).distinct()
    stems = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("k"), F.min("subject").alias("subject")).where("k = 1").drop("k")
    words = sample.select(F.explode("terms").alias("term")).where(~F.col("term").contains(" ")).groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    near = words.withColumn("stem", F.substring("term", 1, stem)).where(F.col("d") <= share * sample.count()).join(broadcast_if_small(stems), "stem")
    return near.orderBy(F.desc("d"), "term").limit(terms).select("term", "subject")


_SENTENCE = re.compile(r"[^.\n]+(?:\.(?!\s|$)[^.\n]*)*")


def _machine(lexicon: dict[str, str], cues: list[str]):
    """Automaton over the lexicon's terms (number, size, subject) and the background phrases (-1, size, '')."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, t in enumerate(sorted(lexicon)):
        machine.add_word(t, (i, len(t), lexicon[t]))
    for t in cues:
        if t not in lexicon:
            machine.add_word(t, (-1, len(t), ""))
    machine.make_automaton()
    return machine


def _judged_sentences(text: str, own: set[str], machine) -> Iterator[tuple[bool, str]]:
    """Sentences in which lexicon terms speak for other subjects only (True), or for the document's ``own`` only (False)."""
    low = text.lower()
    n, hits = len(low), []
    for end, (_, size, subject) in machine.iter(low):
        start = end - size + 1
        if not ((start and low[start - 1].isalnum()) or (end + 1 < n and low[end + 1].isalnum())):
            hits.append((start, subject))
    hits.sort()
    at = 0
    for m in _SENTENCE.finditer(low):
        a, b = m.span()
        while at < len(hits) and hits[at][0] < a:
            at += 1
        named = set()
        while at < len(hits) and hits[at][0] < b:
            named.add(hits[at][1])
            at += 1
        if named and (named <= own or not named & own):
            yield not named & own, m.group()


def learn_cues(docs: DataFrame, lexicon: dict[str, str], least: int = 3, purity: float = 0.9, most: int = CUES) -> list[str]:
    """Phrases of two to four words that mark background: sentences with them name almost only subjects the document has not.

    ``docs`` is (``text``, ``subjects``), a bounded sample. Phrases with a word of the lexicon do not count. At most ``most``,
    the most frequent first.
    """
    if not lexicon:
        return []
    taken = {w for t in lexicon for w in t.split()}

    def phrases(sentence: str) -> set[str]:
        w = [(m.group(), m.span()) for m in _WORD.finditer(sentence)]
        out = set()
        for i in range(len(w)):
            for k in (2, 3, 4):
                if i + k <= len(w):
                    p = sentence[w[i][1][0] : w[i + k - 1][1][1]]
                    if len(p) <= 60 and not any(x in taken for x, _ in w[i : i + k]):
                        out.add(p)
        return out

    def count(foreign: bool, among: frozenset | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine, n = _machine(lexicon, []), Counter()
            for pdf in batches:
                for text, own in zip(pdf["text"], pdf["subjects"], strict=True):
                    for other, sentence in _judged_sentences(text or "", set(own), machine):
                        if other == foreign:
                            n.update(phrases(sentence) if among is None else phrases(sentence) & among)
            yield pd.DataFrame(list(n.items()), columns=["phrase", "n"])

        return run

    d = docs.select("text", "subjects")
    total = lambda x: x.groupBy("phrase").agg(F.sum("n").alias("n"))
    foreign = total(d.mapInPandas(count(True, None), "phrase string, n long")).where(F.col("n") >= least).orderBy(F.desc("n"), "phrase").limit(most * 10)
    foreign = {r["phrase"]: r["n"] for r in foreign.collect()}
    if not foreign:
        return []
    own = {r["phrase"]: r["n"] for r in total(d.mapInPandas(count(False, frozenset(foreign)), "phrase string, n long")).collect()}
    kept = [p for p, n in foreign.items() if n >= purity * (n + own.get(p, 0))]
    return sorted(sorted(kept), key=lambda p: -foreign[p])[:most]


def _level(value: float, ends: tuple) -> int:
    for i, e in enumerate(ends):
        if value <= e:
            return i
    return len(ends)


def vote(docs: DataFrame, lexicon: dict[str, str], cues: list[str] = ()) -> DataFrame:
    """Votes of the text's labelling functions: (``doc_id``, ``subject``, ``votes`` ARRAY<INT>) where any term speaks for the subject.

    ``docs`` is (``doc_id``, ``text``). A null or empty text gives no vote.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _machine(lexicon, cues)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not text or not lexicon:
                    continue
                low = text.lower()
                n, hits, marks = len(low), [], []
                for end, (i, size, subject) in machine.iter(low):
                    start = end - size + 1
                    if i < 0:
                        marks.append((start, end + 1))
                    elif not ((start and low[start - 1].isalnum()) or (end + 1 < n and low[end + 1].isalnum())):
                        hits.append((start, i, subject))
                spans = background_spans(low, sorted(marks))
                starts, ends = [x for x, _ in spans], [x for _, x in spans]
                a, d, c = section_starts(low)
                seen = defaultdict(lambda: [set(), set(), set(), set()])
                for start, i, subject in hits:
                    if spans and (at := bisect_right(starts, start)) and start < ends[at - 1]:
                        continue
                    seen[subject][0 if start < a else 1 if start < d else 3 if start < c else 2].add(i)
                total = sum(len(set().union(*x)) for x in seen.values())
                for subject, x in seen.items():
                    own = len(set().union(*x))
                    votes = [_level(len(y), LEVELS[name]) for y, name in zip(x, SECTIONS, strict=True)]
                    rows.append((doc, subject, [*votes, _level(own / total, LEVELS["share"])]))
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "votes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id long, subject string, votes array<int>")


def address_votes(docs: DataFrame, labels: DataFrame, column: str, ends: tuple = (0.02, 0.1, 0.3)) -> DataFrame:
    """(``column``, ``subject``, ``level``): how common a subject is among the labelled documents of an applicant or source.

    One row per value and subject seen; counting combines on the map side.
    """
    own = docs.select("doc_id", F.col(column).alias(column)).where(F.col(column).isNotNull()).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    size = own.groupBy(column).agg(F.count(F.lit(1)).alias("_d"))
    n = own.join(labels, "doc_id").groupBy(column, "subject").agg(F.count(F.lit(1)).alias("_n")).join(size, column)
    p = F.col("_n") / (F.col("_d") + 2)
    level = F.lit(len(ends))
    for i, e in reversed(list(enumerate(ends))):
        level = F.when(p <= e, i).otherwise(level)
    return n.select(column, "subject", (level + 1).cast("int").alias("level"))


@dataclass
class Latent:
    """The fitted model: log odds of (``prior``, per subject) and of each vote (``tables``, per labelling function)."""

    prior: dict[str, float]
    tables: list[list[float]]

    def posterior(self, subject: Column, votes: Column) -> Column:
        """P(the document has the subject | its votes) as one expression."""
        odds = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in self.prior.items() for x in kv]), subject), F.lit(0.0))
        for f, table in enumerate(self.tables):
            odds = odds + F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in table]), F.get(votes, F.lit(f))), F.lit(0.0))
        return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-40.0)), F.lit(40.0))))


def fit_latent(patterns: DataFrame, subjects: list[str], functions: int, docs: float, labelled_docs: float, rounds: int = 15) -> Latent:
    """EM over pattern counts: (``subject``, ``votes``, ``u`` unlabelled, ``p`` labelled with the subject, ``n`` labelled without it).

    One accuracy table P(vote | true or not) per labelling function, shared by all subjects; one prior per subject. A round
    is one pass over the patterns where they lie; what comes back are sums per function and vote, and per subject.
    """
    code, levels = {x: i for i, x in enumerate(subjects)}, ABSTAINS + 1

    def sums(prior: np.ndarray | None, tables: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_vote, by_subject = np.zeros((2, functions, levels)), np.zeros((3, len(code)))
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                v, s = np.array(pdf["votes"].tolist()), pdf["subject"].map(code).to_numpy()
                u, yes, no = (pdf[c].to_numpy(float) for c in ("u", "p", "n"))
                if tables is not None:
                    odds = prior[s] + sum(tables[f][v[:, f]] for f in range(functions))
                    post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
                    yes, no = yes + post * u, no + (1 - post) * u
                for f in range(functions):
                    by_vote[0, f] += np.bincount(v[:, f], yes, levels)
                    by_vote[1, f] += np.bincount(v[:, f], no, levels)
                for i, x in enumerate((yes, no, u)):
                    by_subject[i] += np.bincount(s, x, len(code))
            yield pd.DataFrame({"votes": [by_vote.ravel().tolist()], "subjects": [by_subject.ravel().tolist()]})

        rows = patterns.mapInPandas(run, "votes array<double>, subjects array<double>").collect()  # one row per task
        by_vote, by_subject = (np.sum([r[c] for r in rows], axis=0) for c in ("votes", "subjects"))
        return by_vote.reshape(2, functions, levels), by_subject.reshape(3, len(code))

    prior = tables = None
    for r in range(rounds + 1):
        by_vote, (yes, no, u) = sums(prior, tables)
        one, zero = by_vote + 0.5
        new = np.log(one / one.sum(axis=1, keepdims=True)) - np.log(zero / zero.sum(axis=1, keepdims=True))
        share = (yes + 6) / ((docs if r else 0) + labelled_docs + 50)  # as if fifty documents had been seen, one in eight with the subject
        # a vote pattern exists only where some term speaks for the subject: odds among those documents
        named = yes + no + (0 if r else u) + 1
        inside = np.clip(share * (docs + labelled_docs) / named, 1e-4, 0.95)
        still = tables is not None and np.abs(new - tables).max() < 0.01
        prior, tables = np.log(inside / (1 - inside)), new
        if still:
            break
    return Latent({x: float(prior[i]) for x, i in code.items()}, [[float(x) for x in t] for t in tables])


def best_threshold(judged: DataFrame) -> float:
    """Threshold with the highest F1 on the labelled rows of ``judged`` (``posterior``, ``yes``, ``k`` rows alike), in steps of a thousandth; 0.5 without any."""
    step = judged.groupBy(F.floor(F.col("posterior") * 1000).alias("q")).agg(F.sum(F.when(F.col("yes"), F.col("k")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("yes"), 0.0).otherwise(F.col("k"))).alias("b"))
    points = sorted(((r["q"], r["a"], r["b"]) for r in step.collect()), reverse=True)
    total, tp, fp, best = sum(x[1] for x in points), 0.0, 0.0, (0.0, 500.0)
    for i, (q, a, b) in enumerate(points):
        tp, fp = tp + a, fp + b
        low = points[i + 1][0] if i + 1 < len(points) else 0
        f1 = 2 * tp / (tp + fp + total) if total else 0.0
        if f1 > best[0] + 1e-9:
            best = (f1, (q + low + 1) / 2)
    return float(np.clip(best[1] / 1000, 0.1, 0.9))


def _fit(votes: DataFrame, n_docs: int, n_lab: int) -> DataFrame:
    """``votes`` (doc_id, subject, votes, lab, yes, ...) with ``posterior`` and ``threshold`` of the latent model."""
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    patterns = cut(votes.groupBy("subject", "votes").agg(one(F.col("lab").isNull()).alias("u"), one(F.col("yes").isNotNull()).alias("p"), one(F.col("lab").isNotNull() & F.col("yes").isNull()).alias("n")))
    subjects = [r["subject"] for r in bounded_rows(patterns.select("subject").distinct().orderBy("subject"), SUBJECTS, "subjects")]
    if not subjects:
        return votes.withColumns({"posterior": F.lit(0.0), "threshold": F.lit(0.5)})
    functions = patterns.agg(F.max(F.size("votes"))).first()[0]
    model = fit_latent(patterns, subjects, functions, n_docs - n_lab, n_lab)
    judged = patterns.withColumn("posterior", model.posterior(F.col("subject"), F.col("votes")))
    labelled = judged.select("posterior", F.inline(F.array(F.struct(F.lit(True).alias("yes"), F.col("p").alias("k")), F.struct(F.lit(False).alias("yes"), F.col("n").alias("k"))))).where("k > 0")
    threshold = best_threshold(labelled)
    return votes.withColumns({"posterior": model.posterior(F.col("subject"), F.col("votes")), "threshold": F.lit(threshold)})


#: Copies of an address vote where these are too many to broadcast: rows of a hot address spread over so many join keys.
SALTS = 16


def by_address(voted: DataFrame, address: DataFrame, column: str, name: str) -> DataFrame:
    """``voted`` with the level of its (``column``, ``subject``) in ``address`` as ``name``, null where there is none."""
    levels = address.withColumnRenamed("level", name)
    small = broadcast_if_small(levels)
    if small is not levels:
        return voted.join(small, [column, "subject"], "left")
    copies = levels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return voted.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(copies, [column, "subject", "_salt"], "left").drop("_salt")


def family_votes(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(``doc_id``, ``subject``, ``lf``): how sure the other members of a document's family are of a subject.

    ``judged`` is (``doc_id``, ``subject``, ``q``); a family is the documents with one ``family_id``. Level 1 is "no",
    4 is "surely"; documents without family or other members have no row.
    """
    member = docs.where("family_id is not null").select("doc_id", "family_id")
    size = member.groupBy("family_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    total = judged.join(member, "doc_id").groupBy("family_id", "subject").agg(F.sum("q").alias("t")).where("t >= 0.2").join(size, "family_id")
    own = judged.select("doc_id", "subject", "q")
    each = member.join(total, "family_id").join(own, ["doc_id", "subject"], "left")
    mean = (F.col("t") - F.coalesce("q", F.lit(0.0))) / (F.col("m") - 1)
    return each.select("doc_id", "subject", F.when(mean < 0.2, 1).when(mean < 0.5, 2).when(mean < 0.8, 3).otherwise(4).alias("lf"))


def posteriors(docs: DataFrame, known: DataFrame, lexicon: dict[str, str], cues: list[str], by_applicant: DataFrame, by_source: DataFrame) -> DataFrame:
    """(``doc_id``, ``subject``, ``posterior``, ``threshold``) for every document and subject with a vote.

    The model is fitted twice: on the votes of the texts, sources and applicants, and again with the vote of the other
    family members, whose first posteriors (or labels) it counts. ``known`` has each label once.
    """
    meta = docs.select("doc_id", "applicant", "source")
    marked = known.select("doc_id").distinct().withColumn("lab", F.lit(True))
    n_docs, n_lab = docs.count(), marked.count()
    voted = by_address(by_address(vote(docs, lexicon, cues).join(meta, "doc_id"), by_applicant, "applicant", "la"), by_source, "source", "ls")
    voted = voted.select("doc_id", "subject", F.concat("votes", F.array(F.coalesce("la", F.lit(0)), F.coalesce("ls", F.lit(0)))).alias("votes"))
    voted = cut(voted.join(marked, "doc_id", "left").join(known.withColumn("yes", F.lit(True)), ["doc_id", "subject"], "left"))
    first = _fit(voted, n_docs, n_lab).where("lab is null").select("doc_id", "subject", F.col("posterior").alias("q"))
    judged = first.unionByName(known.withColumn("q", F.lit(1.0)))
    # Where the text speaks for other subjects only, its silence is a vote; where it says nothing at all, it abstains.
    speaks = voted.select("doc_id").distinct().withColumn("_t", F.lit(True))
    none = F.concat(F.array_repeat(F.when(F.col("_t"), 0).otherwise(ABSTAINS), len(LEVELS)), F.array(F.lit(0), F.lit(0)))
    family = family_votes(docs, judged).join(speaks, "doc_id", "left")
    both = voted.select("doc_id", "subject", "votes").join(family, ["doc_id", "subject"], "full")
    both = both.select("doc_id", "subject", F.concat(F.coalesce("votes", none), F.array(F.coalesce("lf", F.lit(0)))).alias("votes"))
    both = cut(both.join(marked, "doc_id", "left").join(known.withColumn("yes", F.lit(True)), ["doc_id", "subject"], "left"))
    return _fit(both, n_docs, n_lab).select("doc_id", "subject", "posterior", "threshold")


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(``doc_id``, ``subject``): every subject of every document.

    ``documents`` needs ``doc_id, text, applicant, source, family_id``; ``labels`` is (``doc_id``, ``subject``), all subjects of some
    documents; these documents keep their labels. ``subjects`` (``subject``, ``title``, ``description``) helps where a subject
    has few labelled documents. Documents with a null id are left out; without text, terms or labels a
    document has no subject. Repeated rows give one result. Extra columns are ignored.
    """
    docs = documents.where("doc_id is not null").select("doc_id", "text", "applicant", "source", "family_id")
    known = cut(labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct())
    address = [cut(address_votes(docs, known, c)) for c in ("applicant", "source")]
    chosen = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id")).limit(LABELLED_DOCS)
    by_family = F.xxhash64(F.coalesce("family_id", -F.col("doc_id")))  # families are sampled whole
    others = docs.join(known, "doc_id", "left_anti").select("doc_id", by_family.alias("_h")).orderBy("_h", "doc_id").limit(OTHER_DOCS).drop("_h")
    ids = chosen.unionByName(others.withColumn("subjects", F.lit(None).cast("array<string>")))
    sample = cut(with_grams(docs.join(broadcast_if_small(ids, LABELLED_DOCS + OTHER_DOCS), "doc_id")))
    seeds = None if subjects is None else cut(described_terms(sample, subjects))
    # the labels of these are complete: a term of another subject is background
    learned = sample.where("subjects is not null")
    lexicon = learn_lexicon(learned, seeds)
    for _ in range(ROUNDS):
        cues = learn_cues(learned, lexicon)
        guessed = posteriors(sample.drop("subjects", "terms"), known, lexicon, cues, *address).where("posterior >= 0.8").groupBy("doc_id").agg(F.collect_set("subject").alias("guessed"))
        again = sample.join(guessed, "doc_id", "left").withColumn("subjects", F.coalesce("subjects", "guessed")).where("subjects is not null")
        lexicon = learn_lexicon(cut(again.select("terms", "subjects")), seeds) or lexicon
    cues = learn_cues(learned, lexicon)
    found = posteriors(docs, known, lexicon, cues, *address).where(F.col("posterior") >= F.col("threshold")).select("doc_id", "subject")
    found = found.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    kept = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    return found.unionByName(kept).distinct()


def held_out(documents: DataFrame, labels: DataFrame, subjects: DataFrame | None = None, one_in: int = 5) -> DataFrame:
    """(``labelled``, ``hidden``, ``precision``, ``recall``): the operator's figures on labelled documents whose labels it was not given.

    One labelled document in ``one_in``, by hash, is hidden and predicted from its text like any other.
    """
    hide = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(one_in)) == 0
    known = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    truth = known.where(hide).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    found = assign_subjects(documents, known.where(~hide), subjects).join(truth.select("doc_id").distinct(), "doc_id", "left_semi")
    both = truth.withColumn("t", F.lit(1)).join(found.withColumn("f", F.lit(1)), ["doc_id", "subject"], "full")
    right = F.sum(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0))
    figures = both.agg(F.countDistinct(F.when(F.col("t").isNotNull(), F.col("doc_id"))).alias("hidden"), F.try_divide(right, F.sum("f")).alias("precision"), F.try_divide(right, F.sum("t")).alias("recall"))
    return figures.select(F.lit(known.where(~hide).select("doc_id").distinct().count()).cast("bigint").alias("labelled"), "hidden", "precision", "recall")


def composition(assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """(``subject``, ``documents``, ``n_tokens``, ``share``): the corpus by subject; a document counts for each of its subjects."""
    n = assigned.join(sizes.select("doc_id", "n_tokens"), "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"))
    return n.withColumn("share", F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))))
