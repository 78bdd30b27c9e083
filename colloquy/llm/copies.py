"""Duplicates hidden by formatting differences (problem 2).

Each record is rewritten into one canonical text (characters, case, white space, punctuation, field order), hashed to
128 bits, and counted per hash. The group key also carries a second, independent 64-bit hash and the length of the
canonical text: should two different texts ever share the 128 bits, they come out as two groups, and
:func:`colliding_hashes` lists them. Counting is a hash aggregate: it combines on the map side, so a group that holds a
third of all rows sends one partial count per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.ids import dashed
from colloquy.runtime import once

_NULL, _SEP = "\x00", "\x01"


def bare_text(col: Column) -> Column:
    """Letters and digits of any script (with their combining marks), in lower case; nothing else."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}\p{M}]+", ""))


def _text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.concat_ws(_SEP, *[F.coalesce(_text(col[f.name], f.dataType), F.lit(_NULL)) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (col.cast("double") + F.lit(0.0)).cast("string")  # -0.0 becomes 0.0; NaN equals NaN
    if isinstance(kind, T.ArrayType):
        return F.when(col.isNotNull(), F.concat_ws(_SEP, F.transform(col, lambda x: F.coalesce(_text(x, kind.elementType), F.lit(_NULL)))))
    if isinstance(kind, T.MapType):
        return F.when(col.isNotNull(), _text(F.array_sort(F.map_entries(col)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))))
    return col.cast("string")


def canonical(df: DataFrame, spelled: list[str], ids: list[str], leave_out: list[str]) -> Column:
    """Canonical text of a row of ``df``: fields by name, whatever their order; ``spelled`` fields as :func:`bare_text`."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name in leave_out:
            continue
        c = F.col(f"`{f.name}`")
        c = bare_text(c) if f.name in spelled else dashed(c) if f.name in ids else _text(c, f.dataType)
        parts.append(F.concat(F.lit(f.name + "="), F.coalesce(c, F.lit(_NULL))))
    return F.concat_ws("\x02", *parts)


def canonical_json(payload: Column, spelled: list[str], ids: list[str], numbers: list[str]) -> Column:
    """Canonical text of a flat or once-nested JSON object: keys sorted, numbers by value, null and missing keys alike.

    A text that is no JSON object stands for itself, trimmed.
    """
    top = F.from_json(payload, "map<string,string>")

    def value(k: Column, v: Column) -> Column:
        number = v.try_cast("double")
        nested = F.from_json(v, "map<string,string>")
        entries = F.array_sort(F.map_entries(F.map_filter(nested, lambda _, x: x.isNotNull())))
        inner = F.concat_ws(_SEP, F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), F.coalesce((e["value"].try_cast("double") + F.lit(0.0)).cast("string"), e["value"]))))
        plain = F.when(k.isin(spelled), bare_text(v)).when(k.isin(ids), dashed(v)).when(k.isin(numbers) & number.isNotNull(), (number + F.lit(0.0)).cast("string"))
        return plain.when(v.startswith("{") & nested.isNotNull(), inner).otherwise(v)

    entries = F.array_sort(F.map_entries(F.map_filter(top, lambda _, x: x.isNotNull())))
    text = F.concat_ws("\x02", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), value(e["key"], e["value"]))))
    return F.when(F.size(F.map_keys(top)) > 0, text).otherwise(F.trim(payload))


def count_copies(df: DataFrame, row_id: str, text: Column) -> DataFrame:
    """One row per distinct canonical text: (``hash128``, ``check``, ``length``, ``keep_id``, ``copies``).

    ``keep_id`` is the smallest ``row_id`` of the group, ``copies`` its number of rows. Null texts form one group. An
    empty table gives no rows. Rows with the same ``row_id`` count as often as they occur.
    """
    t = F.col("_t")
    keyed = once(df.select(F.col(row_id).alias("_id"), text.alias("_t0")), _t=F.coalesce("_t0", F.lit(_NULL)))
    keyed = keyed.select("_id", F.unhex(F.md5(t)).alias("hash128"), F.xxhash64(t).alias("check"), F.length(t).alias("length"))
    return keyed.groupBy("hash128", "check", "length").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def colliding_hashes(groups: DataFrame) -> DataFrame:
    """128-bit hashes shared by different canonical texts, with the number of texts; normally none."""
    return groups.groupBy("hash128").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")


def hidden_copies(tables: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Groups of two or more rows per table: (``tab``, ``keep_id``, ``copies``). ``tables``: name -> (rows, row id, canonical text)."""
    found = None
    for name, (df, row_id, text) in tables.items():
        one = count_copies(df, row_id, text).where("copies > 1").select(F.lit(name).alias("tab"), F.col("keep_id").cast("bigint").alias("keep_id"), "copies")
        found = one if found is None else found.unionByName(one)
    return found


def _phrase_texts(keyphrases: DataFrame, entities: DataFrame, records: DataFrame) -> dict[str, tuple[DataFrame, str, Column]]:
    ids = ["contextId", "instanceId", "segmentId"]
    numbers = ["preference", "confidence_score"]
    return {
        "keyphrases": (keyphrases, "kp_id", canonical(keyphrases, ["originalForm"], ids, ["kp_id", "value"])),
        "entities": (entities, "ent_id", canonical(entities, ["originalForm"], ids, ["ent_id", "value"])),
        "phrase_records": (records, "record_id", canonical_json(F.col("payload"), ["originalForm"], ids, numbers)),
    }


def phrase_copies(keyphrases: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """:func:`hidden_copies` of Keyphrase rows, Entity rows and published phrase records."""
    return hidden_copies(_phrase_texts(keyphrases, entities, records))


def phrase_collisions(keyphrases: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """(``tab``, ``collisions``): how many 128-bit hashes of :func:`phrase_copies` stand for different texts."""
    found = None
    for name, (df, row_id, text) in _phrase_texts(keyphrases, entities, records).items():
        one = colliding_hashes(count_copies(df, row_id, text)).agg(F.count(F.lit(1)).alias("collisions")).select(F.lit(name).alias("tab"), "collisions")
        found = one if found is None else found.unionByName(one)
    return found
