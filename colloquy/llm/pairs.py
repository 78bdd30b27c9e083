"""Items that appear together (problem 5).

1. Basket -> its distinct items; the number of baskets of each item.
2. Items that cannot be in any reported pair are dropped, exactly: a pair's count is at most the smaller item count, so
   an item needs ``min_together`` baskets, and ``together * N >= lift * a * b`` with ``together <= a`` needs
   ``b <= N / lift``. Hot items go this way before any pair exists.
3. A basket of at most ``chunk`` items is one task unit. The items of a larger one are dealt by hash into chunks of about
   that size, so that no task sorts or holds the basket, and every pair of its chunks becomes a row of its own, spread
   over the cluster.
4. Pairs are counted per unit with map-side combining, then scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import broadcast_if_small, cut, once


def _pairs(x: Column, y: Column, same: Column) -> Column:
    """All pairs (a < b) of an item of ``x`` and one of ``y``; of one array with itself (``same``) each pair once."""
    each = lambda v: F.transform(F.filter(y, lambda w: ~same | (w > v)), lambda w: F.struct(F.least(v, w).alias("a"), F.greatest(v, w).alias("b")))
    return F.flatten(F.transform(x, each))


def basket_items(df: DataFrame, basket: Column, items: Column) -> DataFrame:
    """(``basket``, ``item``), each once. Null baskets, null and empty items give nothing."""
    return df.select(basket.alias("basket"), F.explode(items).alias("item")).where("basket is not null and item is not null and item <> ''").distinct()


def associated_pairs(pairs_of: DataFrame, n_baskets: int, min_together: int, lift: float, chunk: int = 64, most: DataFrame | None = None) -> DataFrame:
    """Pairs with ``together >= min_together`` and ``together * N >= lift * a * b``.

    ``pairs_of`` is (``basket``, ``item``) without repetition, ``n_baskets`` counts all baskets, also empty ones. ``most``
    (``basket``, ``n``) tells how many items a basket has at most, where that is known without counting them. Returns
    (``item_a``, ``item_b``, ``n_together``, ``n_a``, ``n_b``, ``lift``, ``pmi``), ``item_a < item_b``. No pairs: no rows.
    """
    counts = pairs_of.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    keep = cut(counts.where((F.col("n") >= min_together) & (F.col("n") * F.lit(float(lift)) <= F.lit(float(n_baskets)))).withColumn("h", F.xxhash64("item")))
    # Items travel as 64-bit hashes if these are distinct among the kept items, else as themselves.
    sums = keep.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("d")).first()
    code = F.col("h") if sums["n"] == sums["d"] else F.col("item")
    coded = keep.select("item", code.alias("code"), "n")
    baskets = pairs_of.join(coded.select("item", "code"), "item").select("basket", "code")
    sizes = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("n")) if most is None else most
    large = sizes.select("basket", F.ceil(F.col("n") / chunk).cast("int").alias("n_parts")).where("n_parts > 1")
    large = broadcast_if_small(cut(large))
    placed = baskets.join(large, "basket", "left").withColumns({"n_parts": F.coalesce("n_parts", F.lit(1)), "part": F.coalesce(F.pmod(F.xxhash64("code"), F.col("n_parts")).cast("int"), F.lit(0))})
    parts = placed.groupBy("basket", "part").agg(F.collect_list("code").alias("codes"), F.first("n_parts").alias("n_parts"))
    units = parts.select(F.col("codes").alias("x"), F.col("codes").alias("y"), F.lit(True).alias("same"))
    big = parts.where("n_parts > 1")
    left = big.select("basket", F.col("part").alias("p"), F.col("codes").alias("x"), F.explode(F.filter(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda q: q > F.col("part"))).alias("q"))
    right = big.select("basket", F.col("part").alias("q"), F.col("codes").alias("y"))
    met = left.join(right, ["basket", "q"]).repartition("basket", "p", "q").select("x", "y", F.lit(False).alias("same"))
    pair = once(units.unionByName(met), _p=_pairs(F.col("x"), F.col("y"), F.col("same"))).select(F.explode("_p").alias("p")).select("p.a", "p.b")
    together = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_together")).where(F.col("n_together") >= min_together)
    one, two = (coded.select(F.col("code").alias(k), F.col("item").alias(f"i{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    scored = together.join(one, "a").join(two, "b")
    expected = F.col("na").cast("double") * F.col("nb") / F.lit(float(n_baskets))
    scored = scored.where(F.col("n_together") * F.lit(float(n_baskets)) >= F.lit(float(lift)) * F.col("na") * F.col("nb"))
    first = F.col("ia") < F.col("ib")
    return scored.select(
        F.least("ia", "ib").alias("item_a"), F.greatest("ia", "ib").alias("item_b"), "n_together",
        F.when(first, F.col("na")).otherwise(F.col("nb")).alias("n_a"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("n_b"),
        (F.col("n_together") / expected).alias("lift"), F.log2(F.col("n_together") / expected).alias("pmi"),
    )


def segment_pairs(segments: DataFrame, min_together: int = 8, lift: float = 12.0) -> DataFrame:
    """:func:`associated_pairs` of keyphrases and entities of delivered segments.

    A segment delivered more than once is one basket with the items of all its deliveries; a row without an id is a
    segment of its own.
    """
    from colloquy.functions.ids import dashed

    key = F.coalesce(dashed(F.col("id")), F.concat(F.lit("row:"), F.col("seg_row_id").cast("string")))
    # a UUID as its 16 bytes; any other text with more bytes than that
    basket = F.when(key.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.unhex(F.replace(key, F.lit("-")))).otherwise(F.encode(F.concat(F.lit("no UUID, as text:"), key), "utf-8"))
    names = lambda c: F.transform(F.coalesce(F.col(c)["originalForm"], F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")))
    items = F.concat(names("keyphrases"), names("entities"))
    listed = F.coalesce(F.size("keyphrases"), F.lit(0)) + F.coalesce(F.size("entities"), F.lit(0))
    most = segments.groupBy(basket.alias("basket")).agg(F.sum(F.greatest(listed, F.lit(0))).alias("n"))
    return associated_pairs(basket_items(segments, basket, items), most.count(), min_together, lift, most=most)
