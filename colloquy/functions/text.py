"""Text functions as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop word list of a public language toolkit, and three words of agreement. A longer list is a
#: parameter of every function that takes one (:func:`read_words`).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't "
    "wouldn wouldn't right yeah okay"
).split()
#: Punctuation removed by strip_punct.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Contractions and their full forms; letter case counts.
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "cannot", "'cause": "because", "could've": "could have", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not", "he'd": "he would", "he'll": "he will", "he's": "he is", "how'd": "how did", "how'd'y": "how do you",
    "how'll": "how will", "how's": "how is", "I'd": "I would", "I'd've": "I would have", "I'll": "I will", "I'll've": "I will have", "I'm": "I am", "I've": "I have", "i'd": "i would",
    "i'd've": "i would have", "i'll": "i will", "i'll've": "i will have", "i'm": "i am", "i've": "i have", "isn't": "is not", "it'd": "it would", "it'd've": "it would have",
    "it'll": "it will", "it'll've": "it will have", "it's": "it is", "let's": "let us", "ma'am": "madam", "mayn't": "may not", "might've": "might have", "mightn't": "might not",
    "mightn't've": "might not have", "must've": "must have", "mustn't": "must not", "mustn't've": "must not have", "needn't": "need not", "needn't've": "need not have",
    "o'clock": "of the clock", "oughtn't": "ought not", "oughtn't've": "ought not have", "shan't": "shall not", "sha'n't": "shall not", "shan't've": "shall not have", "she'd": "she would",
    "she'd've": "she would have", "she'll": "she will", "she'll've": "she will have", "she's": "she is", "should've": "should have", "shouldn't": "should not",
    "shouldn't've": "should not have", "so've": "so have", "so's": "so as", "this's": "this is", "that'd": "that would", "that'd've": "that would have", "that's": "that is",
    "there'd": "there would", "there'd've": "there would have", "there's": "there is", "here's": "here is", "they'd": "they would", "they'd've": "they would have", "they'll": "they will",
    "they'll've": "they will have", "they're": "they are", "they've": "they have", "to've": "to have", "wasn't": "was not", "we'd": "we would", "we'd've": "we would have", "we'll": "we will",
    "we'll've": "we will have", "we're": "we are", "we've": "we have", "weren't": "were not", "what'll": "what will", "what'll've": "what will have", "what're": "what are",
    "what's": "what is", "what've": "what have", "when's": "when is", "when've": "when have", "where'd": "where did", "where's": "where is", "where've": "where have", "who'll": "who will",
    "who'll've": "who will have", "who's": "who is", "who've": "who have", "why's": "why is", "why've": "why have", "will've": "will have", "won't": "will not", "won't've": "will not have",
    "would've": "would have", "wouldn't": "would not", "wouldn't've": "would not have", "y'all": "you all", "y'all'd": "you all would", "y'all'd've": "you all would have",
    "y'all're": "you all are", "y'all've": "you all have", "you'd": "you would", "you'd've": "you would have", "you'll": "you will", "you'll've": "you will have", "you're": "you are",
    "you've": "you have",
}


def contraction_map() -> dict[str, str]:
    """Contraction -> full form."""
    return dict(CONTRACTIONS)


def read_words(path: str) -> list[str]:
    """A word list from a text file, one or more words a line; longer stop word lists come this way."""
    with open(path, encoding="utf-8") as f:
        return sorted({w for line in f for w in line.split()})


def _map(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def missing_space_fix(t: Column) -> Column:
    """``aB a.B`` -> ``aB a. B``: a blank after a sentence end that lacks one."""
    return F.regexp_replace(t, r"([a-z][.?])([A-Z])", "$1 $2")


def ensure_terminal_punct(t: Column) -> Column:
    """A text not ending in ``. ? !`` gets ``". "``; ``?.`` becomes ``?``."""
    return F.replace(F.when(t.rlike(r"[.?!]$"), t).otherwise(F.concat(t, F.lit(". "))), F.lit("?."), F.lit("?"))


def sentences(t: Column) -> Column:
    """Array of sentences: cut after ``. ? !`` followed by white space; an empty text has none."""
    return F.filter(F.split(F.regexp_replace(F.trim(t), r"([.?!])\s+", "$1\x01"), "\x01"), lambda s: s != "")


def split_sentences_short(t: Column) -> Column:
    """Parts between full stops with more than three blank-separated tokens, trimmed and joined by ``". "``; '' without a full stop.

    Blanks at the ends of a part count: what follows a full stop and a blank has an empty token in front.
    """
    parts = F.filter(F.split(t, r"\."), lambda s: F.size(F.split(s, " ")) > 3)
    return F.when(t.contains("."), F.array_join(F.transform(parts, lambda s: F.trim(s)), ". ")).otherwise("")


def expand_contractions(t: Column, m: dict[str, str] | None = None) -> Column:
    """For each blank-separated token that is a contraction, that string is replaced everywhere in the text, in order."""
    table = _map(m or contraction_map())
    return F.aggregate(F.split(t, " "), t, lambda acc, w: F.replace(acc, w, F.coalesce(F.try_element_at(table, w), w)))


def expand_contractions_tok(t: Column, m: dict[str, str] | None = None) -> Column:
    """Token-exact expansion; the result starts with a blank."""
    table = _map(m or contraction_map())
    return F.concat(F.lit(" "), F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " "))


def newline_to_period(t: Column) -> Column:
    return F.replace(t, F.lit("\n"), F.lit(". "))


def strip_punct(t: Column) -> Column:
    return F.translate(t, PUNCTUATION, "")


def mask_numbers(t: Column) -> Column:
    """Every number, also with decimals, becomes ``XnumberX``."""
    return F.regexp_replace(t, r"\d+\.+\d+|\d+", "XnumberX")


def remove_stopwords(t: Column, words: list[str] = STOP_WORDS) -> Column:
    """For each blank-separated token that is a stop word (in lower case), that string becomes a blank everywhere in the text, in order.

    Like :func:`expand_contractions` this replaces strings, not tokens: removing ``a`` leaves no ``a`` anywhere. Empty
    tokens are left alone.
    """
    stop = F.array(*[F.lit(w) for w in words])
    return F.aggregate(F.split(t, " "), t, lambda acc, w: F.when((w != "") & F.array_contains(stop, F.lower(w)), F.replace(acc, w, F.lit(" "))).otherwise(acc))


#: General top-level domains of an address; any two letters are taken for a country's.
DOMAINS = "com net org edu gov mil aero asia biz cat coop info int jobs mobi museum name post pro tel travel xxx".split()
_TLD = "(?:" + "|".join(DOMAINS) + "|[a-z]{2})"
URL = rf"(?i)(^|[^@a-z0-9.\-])(?:https?:/{{1,3}}[^\s()<>]+|[a-z0-9][a-z0-9.\-]*\.{_TLD}/[^\s()<>]*|[a-z0-9]+(?:[.\-][a-z0-9]+)*\.{_TLD}\b)"


def mask_urls(t: Column) -> Column:
    """Addresses with a scheme, and names with a top-level domain that stand after no ``@``, become ``__url__``."""
    return F.regexp_replace(t, URL, "$1__url__")


EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"


def strip_emoji(t: Column) -> Column:
    return F.regexp_replace(t, EMOJI, "")


def clean_text(t: Column, remove_punct: bool = False, mask: bool = False) -> Column:
    """One sentence cleaned: emoji, contractions, line ends, punctuation and numbers if asked for, quotes, addresses, colons, blanks; in this order."""
    t = newline_to_period(expand_contractions(strip_emoji(t)))
    if remove_punct:
        t = strip_punct(t)
    if mask:
        t = mask_numbers(t)
    for old, new in (("\\n", ""), ("\u2019", "'"), ("\\", ""), ("\u2018", "'")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = mask_urls(t)
    for old, new in ((":", ". "), ("\u201d", "'"), ("\u201c", "'"), ("\u200a\u2014\u200a", " "), ("\xa0", "")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.replace(F.replace(F.regexp_replace(t, " +", " "), F.lit("\t"), F.lit("")), F.lit("\n"), F.lit("")))


def preprocess_text(t: Column, stop_words: list[str] | None = None, lemmas: bool = False, remove_punct: bool = False, mask: bool = False) -> Column:
    """A text's sentences, each cleaned; then, if asked for, without stop words and with nouns in their singular."""

    def one(s: Column) -> Column:
        s = clean_text(s, remove_punct, mask)
        if stop_words is not None:
            s = remove_stopwords(s, stop_words)
        return F.array_join(F.transform(F.split(s, " "), lemma), " ") if lemmas else s

    return F.transform(sentences(t), one)


def words(t: Column) -> Column:
    """Runs of ASCII letters in lower case."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([a-z]+)"))


def word_count(t: Column) -> Column:
    """White-space separated tokens; 0 for blank texts."""
    return F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+")))


def loc_find(text: Column, phrase: Column) -> Column:
    """0-based position of ``phrase``, else of its lower case, else -1."""
    at = F.position(phrase, text)
    return F.when(at > 0, at - 1).otherwise(F.position(F.lower(phrase), F.lower(text)) - 1)


def ner_tokenize(t: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(t, F.lit(r"(\w+|[^\w\s])"))


def clean_word(w: Column) -> Column:
    return F.trim(F.regexp_replace(w, r"[^A-Za-z0-9'.&-]", " "))


def _accents() -> tuple[str, str]:
    """Letters that are a plain letter with marks, and these plain letters, by Unicode's decompositions."""
    import unicodedata

    plain = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x2000))}
    kept = {c: d[0] for c, d in plain.items() if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])}
    return "".join(kept), "".join(kept.values())


_MARKED, _BARE = _accents()


def strip_accents(t: Column) -> Column:
    """Letters without their marks, also where these are characters of their own."""
    return F.regexp_replace(F.translate(t, _MARKED, _BARE), r"\p{Mn}+", "")


IDEOGRAPH = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2CEAF}\x{2F800}-\x{2FA1F}])"


def basic_tokenize(t: Column) -> Column:
    """Lower case without accents; every punctuation mark and every ideograph a token of its own."""
    t = strip_accents(F.lower(F.regexp_replace(t, IDEOGRAPH, " $1 ")))
    return F.filter(F.split(F.trim(F.regexp_replace(t, r"([\p{P}\p{S}])", " $1 ")), r"\s+"), lambda w: w != "")


#: Runs of marks that stand apart.
MARK_RUNS = r"(-+|~+|!+|\"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}+|\{+|\|+|_+)"


def text_standardize(t: Column) -> Column:
    """Dashes and ellipses unified, runs of punctuation set apart by blanks, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(t, "[—–―]", "-"), "…", "...")
    return F.trim(F.regexp_replace(F.regexp_replace(t, MARK_RUNS, " $1 "), r"\s+", " "))


def url_domain(t: Column) -> Column:
    """Domain of a spoken or written address: ``dot`` and ``slash`` are read as signs."""
    u = F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+dot\s+", "."), r"\s+slash\s+", "/")
    return F.regexp_extract(u, r"^(?:https?://)?(?:www\.)?([^/\s]+)", 1)


def reformat_list(values: Column) -> Column:
    """Numbers with two decimals of their exact binary value, joined by ``", "``.

    Built-in formatting rounds the shortest decimal form instead, hence an Arrow batch function.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([", ".join(f"{v:.2f}" for v in x if v is not None) if x is not None else None for x in lists], dtype=object)

    return F.pandas_udf(run, "string")(values)


def capitalize_entities(names: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Each blank-separated word of each name: an address becomes its domain, a dotted word title case, a stop word lower
    case, another word opens with a capital letter (its other letters then become small).
    """
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.regexp_replace(w, "(?s)^.", "")))
    dotted = lambda w: F.array_join(F.transform(F.split(w, r"\."), upper_first), ".")

    def one(w: Column) -> Column:
        address = w.rlike(rf"(?i)^(?:https?:|www\.)|\.{_TLD}(?:/|$)")
        out = F.when(w.contains("."), F.when(address, upper_first(url_domain(w))).otherwise(dotted(w)))
        return out.when(F.lower(w).isin(stop), F.lower(w)).when(w.rlike(r"^\p{Lu}"), w).otherwise(upper_first(w))

    return F.transform(names, lambda n: F.array_join(F.transform(F.filter(F.split(n, r"\s+"), lambda w: w != ""), one), " "))


def first_upper(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.regexp_replace(t, "(?s)^.", ""))


def lemma(w: Column) -> Column:
    """Singular of a plural noun by rule: ``ies``, ``sses``, ``xes/ches/shes`` and ``s``."""
    return (
        F.when(w.rlike("(?:ss|us|is)$") | (F.length(w) < 4), w)
        .when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:sses|xes|ches|shes)$"), F.regexp_replace(w, "es$", ""))
        .otherwise(F.regexp_replace(w, "s$", ""))
    )


def acronym_join(t: Column) -> Column:
    """``a b c`` spelled letter by letter -> ``ABC``; ``A. B.`` -> ``AB``."""
    return F.regexp_replace(F.regexp_replace(t, r"\b([A-Za-z])[.]?\s(?=[A-Za-z]\b[.]?(?:\s|$))", "$1"), r"\b([A-Z]+)([A-Z])\.", "$1$2")


def fix_apostrophes(t: Column) -> Column:
    """A token that starts with an apostrophe joins the one before it."""
    return F.replace(t, F.lit(" '"), F.lit("'"))
