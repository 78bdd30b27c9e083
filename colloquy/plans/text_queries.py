"""Text operators over the whole of segment_requests, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import tagging, text
from colloquy.operators import actions
from colloquy.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

T = "originalText"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_requests")


def _each(name: str, make, sql: str | None = None, where: str = "originalText is not null") -> None:
    """A query that gives ``value`` per segment."""
    QUERIES[name] = lambda spark, d: _segments(spark, d).where(where).select("seg_row_id", make(F.col(T)).alias("value"))
    if sql:
        SQL[name] = f"select seg_row_id, {sql} as value from segment_requests where {where}"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_CM = text.contraction_map()
_CMAP = "map(" + _sql_list(list(_CM)) + ", " + _sql_list(list(_CM.values())) + ")"
_STOP = _sql_list(text.STOP_WORDS)
_SENT = "list_filter(string_split(regexp_replace(trim(originalText), '([.?!])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: s <> '')"

_each("missing_space_fix", text.missing_space_fix, "regexp_replace(originalText, '([a-z][.?])([A-Z])', '\\1 \\2', 'g')")
_each("ensure_terminal_punct", text.ensure_terminal_punct, "replace(case when regexp_matches(originalText, '[.?!]$') then originalText else originalText || '. ' end, '?.', '?')")
_each("sent_tokenize", lambda t: F.array_join(text.sentences(t), "|"), f"array_to_string({_SENT}, '|')")
_each("split_sentences_short", text.split_sentences_short, "case when contains(originalText, '.') then array_to_string(list_transform(list_filter(string_split(originalText, '.'), lambda s: len(string_split(s, ' ')) > 3), lambda s: trim(s)), '. ') else '' end")
_each("expand_contractions", text.expand_contractions, f"list_reduce(list_prepend(originalText, string_split(originalText, ' ')), lambda acc, w: replace(acc, w, coalesce({_CMAP}[w], w)))")
_each("expand_contractions_tok", text.expand_contractions_tok, f"' ' || array_to_string(list_transform(string_split(originalText, ' '), lambda w: coalesce({_CMAP}[w], w)), ' ')")
_each("contraction_map", lambda t: F.size(F.filter(F.split(t, " "), lambda w: w.isin(list(_CM)))).cast("bigint"), f"cast(len(list_filter(string_split(originalText, ' '), lambda w: list_contains({_sql_list(list(_CM))}, w))) as bigint)")
_each("newline_to_period", text.newline_to_period, "replace(originalText, chr(10), '. ')")
_each("strip_punct", text.strip_punct, "translate(originalText, '" + text.PUNCTUATION.replace("'", "''") + "', '')")
_each("mask_numbers", text.mask_numbers, "regexp_replace(originalText, '\\d+\\.+\\d+|\\d+', 'XnumberX', 'g')")


def _swapped(t: str, condition: str, new: str) -> str:
    """For each blank-separated token ``w`` of ``t`` with ``condition``, the string is replaced everywhere, in order."""
    return f"list_reduce(list_prepend({t}, string_split({t}, ' ')), lambda acc, w: case when {condition} then replace(acc, w, {new}) else acc end)"


def _stopped(t: str) -> str:
    return _swapped(t, f"w <> '' and list_contains({_STOP}, lower(w))", "' '")


def _clean(t: str) -> str:
    """``text.clean_text`` of the SQL expression ``t``."""
    t = f"replace(list_reduce(list_prepend({_NOEMOJI(t)}, string_split({_NOEMOJI(t)}, ' ')), lambda acc, w: replace(acc, w, coalesce({_CMAP}[w], w))), '\n', '. ')"
    for old, new in (("\\n", ""), ("\u2019", "''"), ("\\", ""), ("\u2018", "''")):
        t = f"replace({t}, '{old}', '{new}')"
    t = f"regexp_replace({t}, '{text.URL}', '\\1__url__', 'g')"
    for old, new in ((":", ". "), ("\u201d", "''"), ("\u201c", "''"), ("\u200a\u2014\u200a", " "), ("\xa0", "")):
        t = f"replace({t}, '{old}', '{new}')"
    return f"trim(replace(replace(regexp_replace({t}, ' +', ' ', 'g'), '\t', ''), '\n', ''))"


_NOEMOJI = lambda t: f"regexp_replace({t}, '{text.EMOJI}', '', 'g')"

_each("remove_stopwords", text.remove_stopwords, _stopped(T))
_each("mask_urls", text.mask_urls, f"regexp_replace(originalText, '{text.URL}', '\\1__url__', 'g')")
_each("strip_emoji", text.strip_emoji, _NOEMOJI(T))
_each("clean_text", text.clean_text, _clean(T))
_each("preprocess_text", lambda t: F.array_join(text.preprocess_text(t, text.STOP_WORDS), "|"), f"array_to_string(list_transform(list_transform({_SENT}, lambda s: {_clean('s')}), lambda c: {_stopped('c')}), '|')")
_each("word_count", lambda t: text.word_count(t).cast("bigint"), "cast(case when trim(originalText) = '' then 0 else len(regexp_split_to_array(trim(originalText), '\\s+')) end as bigint)")
_each("ner_tokenize", lambda t: F.array_join(text.ner_tokenize(t), " "), "array_to_string(regexp_extract_all(originalText, '([\\w]+|[^\\w\\s])'), ' ')")
_each("clean_word", text.clean_word, "trim(regexp_replace(originalText, '[^A-Za-z0-9''.&-]', ' ', 'g'))")
_each("strip_accents", text.strip_accents, "strip_accents(originalText)")
_BASIC = f"strip_accents(lower(regexp_replace(originalText, '{text.IDEOGRAPH}', ' \\1 ', 'g')))"
_each("basic_tokenize", lambda t: F.array_join(text.basic_tokenize(t), " "), f"array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace({_BASIC}, '([\\p{{P}}\\p{{S}}])', ' \\1 ', 'g')), '\\s+'), lambda w: w <> ''), ' ')")
_each("text_standardize", text.text_standardize, f"trim(regexp_replace(regexp_replace(replace(regexp_replace(originalText, '[—–―]', '-', 'g'), '…', '...'), '{text.MARK_RUNS}', ' \\1 ', 'g'), '\\s+', ' ', 'g'))")
_each("fix_apostrophes", text.fix_apostrophes, "replace(originalText, ' ''', '''')")
_each("first_upper", text.first_upper, "upper(substr(originalText, 1, 1)) || substr(originalText, 2)", "originalText <> ''")
_each("url_domain", text.url_domain, "regexp_extract(regexp_replace(regexp_replace(lower(originalText), '\\s+dot\\s+', '.', 'g'), '\\s+slash\\s+', '/', 'g'), '^(?:https?://)?(?:www\\.)?([^/\\s]+)', 1)")
_each("acronym_join", text.acronym_join)
_each("hash_md5", F.md5, "md5(originalText)")
_each("hash_sha1", lambda t: F.sha1(F.lower(t)), "sha1(lower(originalText))")
_each("pos_tag", lambda t: F.array_join(F.transform(tagging.pos_tag(t), lambda x: F.concat(x["tok"], F.lit("/"), x["pos"])), " "))
_each("filter_by_pos", lambda t: F.array_join(F.transform(tagging.filter_by_pos(tagging.pos_tag(t), ["NN", "NNS", "NNP", "JJ"]), lambda x: x["tok"]), " "))
_each("segment_nouns", lambda t: F.array_join(F.transform(F.filter(tagging.pos_tag(t), lambda x: x["pos"].startswith("NN")), lambda x: x["tok"]), " "))
_each("candidate_phrases", lambda t: F.array_join(tagging.chunk(tagging.pos_tag(t)), "|"))
_each("action_grammar", lambda t: F.array_join(tagging.chunk(tagging.pos_tag(t), tagging.ACTIONS, first_only=True), "|"))
_each("query_text", lambda t: tagging.query_text(F.split(t, " "), ["NN", "NNS", "NNP", "JJ"]))
_each("negation_filter", lambda t: F.size(F.filter(F.sequence(F.lit(0), F.size(text.words(t))), lambda i: tagging.negated(text.words(t), i))).cast("bigint"))
_each("udf_ner", lambda t: F.to_json(tagging.entities(t)))
_each("udf_encode", lambda t: F.to_json(F.transform(tagging.encode(t, 16), lambda x: F.round(x, 6))))
_each("wordpiece", lambda t: tagging.wordpiece_text(F.array_join(text.basic_tokenize(t), " "), tagging.piece_vocabulary()))
_each("bpe", lambda t: tagging.bpe_text(F.array_join(text.basic_tokenize(t), " "), tagging.merge_ranks()))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("seg_row_id", F.posexplode(text.sentences(F.col(T))).alias("pos", "s"))


_SENTS = f"select seg_row_id, unnest(range(len(l))) pos, unnest(l) s from (select seg_row_id, {_SENT} l from segment_requests where originalText is not null)"


def _sentence(name: str, make, sql: str | None = None) -> None:
    """A query that gives ``value`` per sentence."""
    QUERIES[name] = lambda spark, d: _sentences(spark, d).select("seg_row_id", F.col("pos").cast("bigint").alias("pos"), make(F.col("s")).alias("value"))
    if sql:
        SQL[name] = f"select seg_row_id, pos, {sql} as value from ({_SENTS})"


_WC = "(case when trim(s) = '' then 0 else len(regexp_split_to_array(trim(s), '\\s+')) end)"
_TOK = "string_split(lower(s), ' ')"
_any = lambda ws: f"list_has_any({_TOK}, {_sql_list(ws)})"
_EXPANDED = f"(' ' || array_to_string(list_transform(string_split(s, ' '), lambda w: coalesce({_CMAP}[w], w)), ' '))"
_phr = lambda ps: "(" + " or ".join("contains(lower(" + _EXPANDED + "), '" + p.replace("'", "''") + "')" for p in ps) + ")"
_KEPT = f"len(list_filter(string_split(s, ' '), lambda w: not list_contains({_sql_list(actions.ACTION_STOP)}, w)))"
_SUBST = f"({_KEPT} > 4 or (len(string_split(s, ' ')[-1]) > 4 and {_KEPT} > 3))"
_IS_FIXED = f"({_phr(actions.EXPANDED_FIXED)} and not {_phr(actions.OMIT)})"
_SCORE = f"(case when len(string_split(s, ' ')) <= 2 then 0.0 when {_IS_FIXED} then 1.0 when {_any(actions.MARKERS)} then 0.8 else 0.0 end)"
_FIRST, _SECOND, _COMBINED = (_any(ws) for ws in (actions.FIRST_PERSON, actions.SECOND_PERSON, actions.COMBINED))

_sentence("questions", lambda s: actions.is_question(s, actions.action_subjects(s)))
_sentence("ai_subjects", lambda s: F.array_join(actions.action_subjects(s), "|"))
_sentence("ai_postcheck", actions.has_marker, _any(actions.MARKERS))
_sentence("ai_fixed_lists", actions.is_fixed, _IS_FIXED)
_sentence("udf_ai_prob", actions.action_score, f"cast({_SCORE} as double)")
_sentence("ai_response_filter", actions.substantial, _SUBST)
_sentence("ai_candidates", lambda s: actions.is_action_item(s, actions.action_subjects(s)))
_sentence("ai_assignee", actions.assignee, f"cast(case when ({_COMBINED} and not {_FIRST} and not {_SECOND}) or ({_FIRST} and {_SECOND}) then 2 else 0 end as bigint)")
_LEMMA = "case when len(w) < 4 or regexp_matches(w, '(?:ss|us|is)$') then w when w like '%ies' then w[:-4] || 'y' when regexp_matches(w, '(?:sses|xes|ches|shes)$') then w[:-3] when w like '%s' then w[:-2] else w end"
_sentence("lemmatize", lambda s: F.array_join(F.transform(text.words(s), text.lemma), " "), f"array_to_string(list_transform(regexp_extract_all(lower(s), '[a-z]+'), lambda w: {_LEMMA}), ' ')")
_sentence("gs_preprocess_filter", lambda s: text.word_count(s) > 10, f"{_WC} > 10")


def ai_api(spark: SparkSession, d: str) -> DataFrame:
    """Action items and questions per segment: (``seg_row_id``, ``pos``, ``kind``, ``subject``, ``is_assignee_both``).

    An item that came by no fixed phrase must be substantial.
    """
    s = _sentences(spark, d).withColumn("subjects", actions.action_subjects(F.col("s")))
    s = s.withColumns({"question": actions.is_question(F.col("s"), F.col("subjects")), "item": actions.is_action_item(F.col("s"), F.col("subjects")), "text": actions.action_text(F.col("s"), F.col("subjects"))})
    item = F.col("item") & (actions.is_fixed(F.col("s")) | actions.substantial(F.col("text")))
    both = actions.assignee(F.col("s")) == 2
    found = F.array_compact(F.array(
        F.when(item, F.struct(F.lit("action_item").alias("kind"), F.col("text").alias("subject"), both.alias("is_assignee_both"))),
        F.when(F.col("question"), F.struct(F.lit("question").alias("kind"), F.col("s").alias("subject"), F.lit(None).cast("boolean").alias("is_assignee_both"))),
    ))
    return s.select("seg_row_id", F.col("pos").cast("bigint").alias("pos"), F.inline(found))


QUERIES["ai_api"] = ai_api


def _phrases(name: str, make, sql: str) -> None:
    """A query that gives ``value`` per keyphrase row."""
    QUERIES[name] = lambda spark, d: table(spark, d, "keyphrases").select("kp_id", make(F.col("originalForm")).alias("value"))
    SQL[name] = f"select kp_id, {sql} as value from keyphrases"


_phrases("phrase_embedding_key", F.md5, "md5(originalForm)")
_phrases("phrase_xid", lambda c: F.sha1(F.lower(c)), "sha1(lower(originalForm))")


def loc_find(spark: SparkSession, d: str) -> DataFrame:
    """Position of each named keyphrase in its segment's text."""
    rows = _segments(spark, d).where("originalText is not null").select("seg_row_id", T, F.explode(F.col("keyphrases")["originalForm"]).alias("phrase"))
    return rows.select("seg_row_id", "phrase", text.loc_find(F.col(T), F.col("phrase")).cast("bigint").alias("loc"))


QUERIES["loc_find"] = loc_find
SQL["loc_find"] = """
select seg_row_id, phrase, cast(case when strpos(t, phrase) > 0 then strpos(t, phrase) - 1 else strpos(lower(t), lower(phrase)) - 1 end as bigint) loc
from (select seg_row_id, originalText t, unnest(list_transform(keyphrases, lambda k: k.originalForm)) phrase from segment_requests where originalText is not null)"""


def segment_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyphrases found in the text after its first character."""
    return loc_find(spark, d).where("loc > 0").select("seg_row_id", "phrase").distinct()


QUERIES["segment_search"] = segment_search
SQL["segment_search"] = f"select distinct seg_row_id, phrase from ({SQL['loc_find']}) where loc > 0"


def reformat_list(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "keyphrases").where("score is not null")
    return s.select("kp_id", text.reformat_list(F.array("score.pagerank", "score.segsim")).alias("value"))


QUERIES["reformat_list"] = reformat_list
SQL["reformat_list"] = "select kp_id, printf('%.2f, %.2f', score.pagerank, score.segsim) as value from keyphrases where score is not null"


def uuid_normalize(spark: SparkSession, d: str) -> DataFrame:
    from colloquy.functions.ids import dashed

    return _segments(spark, d).select("seg_row_id", dashed(F.col("id")).alias("id"), dashed(F.col("spokenBy")).alias("spoken_by"))


QUERIES["uuid_normalize"] = uuid_normalize
_U = "regexp_replace(replace(lower({0}), '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
SQL["uuid_normalize"] = f"select seg_row_id, {_U.format('id')} id, {_U.format('spokenBy')} spoken_by from segment_requests"


def format_time(spark: SparkSession, d: str) -> DataFrame:
    """End of each segment in microseconds; finer digits are cut off."""
    return _segments(spark, d).select("seg_row_id", F.unix_micros(F.try_to_timestamp("endTime")).alias("end_us"))


QUERIES["format_time"] = format_time
SQL["format_time"] = "select seg_row_id, epoch_us(try_cast(regexp_replace(endTime, '(\\.\\d{6})\\d+', '\\1') as timestamptz)) end_us from segment_requests"


_TLD_SQL = "(?:" + "|".join(text.DOMAINS) + "|[a-z]{2})"
_UP = "(upper(substr({0}, 1, 1)) || lower(substr({0}, 2)))".format
_DOMAIN = SQL["url_domain"].split("seg_row_id, ")[1].split(" as value")[0].replace("originalText", "w")


def capitalize_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities' names, word by word."""
    e = table(spark, d, "entities").where("originalForm is not null")
    return e.select("ent_id", F.get(text.capitalize_entities(F.array("originalForm")), F.lit(0)).alias("value"))


QUERIES["capitalize_entities"] = capitalize_entities
SQL["capitalize_entities"] = f"""select ent_id, array_to_string(list_transform(list_filter(regexp_split_to_array(originalForm, '\\s+'), lambda w: w <> ''), lambda w:
case when contains(w, '.') then case when regexp_matches(w, '(?i)^(?:https?:|www\\.)|\\.{_TLD_SQL}(?:/|$)') then {_UP(_DOMAIN)} else array_to_string(list_transform(string_split(w, '.'), lambda x: {_UP('x')}), '.') end
when list_contains({_STOP}, lower(w)) then lower(w) when regexp_matches(w, '^\\p{{Lu}}') then w else {_UP('w')} end), ' ') as value from entities where originalForm is not null"""


def ner_label_priority(spark: SparkSession, d: str) -> DataFrame:
    """Of the labels that an entity got in its segment the preferred one."""
    from colloquy.functions.ids import dashed

    e = table(spark, d, "entities").where("segmentId is not null and originalForm is not null and label is not null")
    labels = e.groupBy(dashed(F.col("segmentId")).alias("segment"), F.lower("originalForm").alias("name")).agg(F.collect_set("label").alias("labels"))
    return labels.select("segment", "name", tagging.preferred_label(F.col("labels")).alias("label"))


QUERIES["ner_label_priority"] = ner_label_priority
SQL["ner_label_priority"] = """select lower(segmentId) segment, lower(originalForm) "name", arg_min(label, (case label when 'MISC' then '1' when 'ORG' then '2' when 'PER' then '3' when 'LOC' then '4' when 'O' then '5' else '6' end) || label) label
from entities where segmentId is not null and originalForm is not null and label is not null group by 1, 2"""
