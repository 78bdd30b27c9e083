"""Filling fixed-capacity containers with items (problem 7).

Items are spread by hash over blocks of a bounded number of items. In a block best-fit decreasing gives a start, then a
swap-based local search takes the emptiest container apart: its items are moved into, or exchanged one for one and two
for one with smaller items of, fuller containers. Every step makes a fuller container fuller, so the sum of squared fills
grows, and it ends when the emptiest container is empty or nothing fits; then the next emptiest is tried, each one once
since the last that was emptied. The containers a block leaves underfull go into a second round together with those of
other blocks.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import bounded_rows, cut

#: Most container sizes that ``pack_documents`` takes; more are an error.
MOST_PACKS = 1_000
#: Items packed together in one task; bounds its memory and time.
BLOCK_ITEMS = 4_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of indices into ``sizes`` (each at most ``capacity``)."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (-free space, container), ascending: the last that fits is the tightest
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_right(free, (-sizes[i], len(bins))) - 1
        if at >= 0:
            left, b = free.pop(at)
            bins[b].append(i)
            insort(free, (left + sizes[i], b))
        else:
            bins.append([i])
            insort(free, (sizes[i] - capacity, len(bins) - 1))
    return bins


def empty_by_swaps(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: takes emptiest containers apart as long as that empties them; see the module."""
    bins = [list(b) for b in bins if b]
    fill = [sum(sizes[i] for i in b) for b in bins]
    total = sum(fill)
    emptiest = lambda bs: sorted(bs, key=lambda b: (fill[b], b), reverse=True)
    fullest = lambda: sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: -fill[b])
    left, loose = emptiest(range(len(bins))), fullest()  # not tried since the last one was emptied; with space
    while len(bins) > 1 and len(bins) * capacity - total >= capacity and left:  # else no search can empty one
        d = left.pop()
        before, into_of = {d: (list(bins[d]), fill[d])}, loose
        while True:
            moved = False
            pool = sorted((sizes[i], i) for i in bins[d])
            for a in into_of:
                if a == d:
                    continue
                if a not in before:
                    before[a] = (list(bins[a]), fill[a])
                space = capacity - fill[a]
                while pool and (at := bisect_right(pool, (space, len(sizes)))) > 0 and space > 0:  # move
                    s, i = pool.pop(at - 1)
                    bins[a].append(i)
                    fill[a], fill[d], space, moved = fill[a] + s, fill[d] - s, space - s, True
                if not pool or space == 0:
                    continue
                best = None  # (gain, out of a, into a)
                for x in bins[a]:
                    limit = sizes[x] + space
                    at = bisect_right(pool, (limit, len(sizes)))
                    if at and pool[at - 1][0] > sizes[x] and (best is None or pool[at - 1][0] - sizes[x] > best[0]):  # one for one
                        best = (pool[at - 1][0] - sizes[x], x, (pool[at - 1],))
                    lo, hi = 0, at - 1
                    while lo < hi:  # two for one
                        two = pool[lo][0] + pool[hi][0]
                        if two > limit:
                            hi -= 1
                        else:
                            if two > sizes[x] and (best is None or two - sizes[x] > best[0]):
                                best = (two - sizes[x], x, (pool[lo], pool[hi]))
                            lo += 1
                    if best and best[0] == space:
                        break
                if best:
                    gain, x, into = best
                    for y in into:
                        pool.remove(y)
                        bins[a].append(y[1])
                    bins[a].remove(x)
                    insort(pool, (sizes[x], x))
                    fill[a], fill[d], moved = fill[a] + gain, fill[d] - gain, True
            bins[d] = [i for _, i in pool]
            if not pool or not moved:
                break
            into_of = fullest()
        if not bins[d]:
            del bins[d], fill[d]
            left, loose = emptiest(range(len(bins))), fullest()
        elif sum(fill[b] ** 2 - f * f for b, (_, f) in before.items()) <= 0:
            for b, (own, f) in before.items():
                bins[b], fill[b] = own, f
        else:
            left, loose = emptiest(left), fullest()
    return bins


def pack_items(items: DataFrame, block_items: int = BLOCK_ITEMS, underfull: float = 0.97) -> DataFrame:
    """Containers for ``items`` (pack, capacity, item..., size): the same rows with ``container`` (text).

    Needs ``pack`` STRING, ``capacity`` BIGINT, ``size`` BIGINT at most ``capacity``, ``_key`` BIGINT; other columns pass.
    """
    schema = items.schema.add("container", "string")

    def rounds(rows: DataFrame, name: str, count: DataFrame) -> DataFrame:
        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
            sizes, capacity = pdf["size"].tolist(), int(pdf["capacity"].iloc[0])
            bins = empty_by_swaps(best_fit_decreasing(sizes, capacity), sizes, capacity)
            where = [0] * len(sizes)
            for b, own in enumerate(bins):
                for i in own:
                    where[i] = b
            pdf["container"] = [f"{name}{key[1]}-{b}" for b in where]
            return pdf[[*schema.names]]

        blocks = rows.join(F.broadcast(count), "pack").withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(name)), "_blocks"))
        return blocks.groupBy("pack", "_block").applyInPandas(pack, schema)

    def blocks(rows: DataFrame) -> DataFrame:  # one row per pack size
        return rows.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / block_items).cast("bigint").alias("_blocks"))

    first = cut(rounds(items, "a", blocks(items)))
    loose = first.groupBy("pack", "container").agg((F.sum("size") < underfull * F.max("capacity")).alias("_loose"))
    judged = first.join(loose, ["pack", "container"])
    again = judged.where("_loose").select(*items.columns)
    return judged.where("not _loose").select(*schema.names).unionByName(rounds(again, "b", blocks(again)))


def pack_documents(sizes: DataFrame, packs: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(``pack_name``, ``container``, ``doc_id``, ``piece_no``, ``token_start``, ``n_tokens``, ``capacity_tokens``).

    ``sizes`` is (``doc_id``, ``n_tokens``); ``packs`` is (``pack_name``, ``capacity_tokens``), a small fixed table (an
    error beyond ``MOST_PACKS`` rows); of a pack given twice the smaller capacity holds. A
    document longer than a container is cut into full containers and a rest, which is an item like the others; all other
    documents stay whole. Documents without tokens take part with size 0. Packs without a name or a positive capacity
    are left out. Repeated documents are items of their own. Empty tables give no rows.
    """
    packs = packs.where("capacity_tokens > 0 and pack_name is not null").groupBy(F.col("pack_name").alias("pack")).agg(F.min(F.col("capacity_tokens").cast("bigint")).alias("capacity"))
    known = [F.struct(F.lit(r["pack"]).alias("pack"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in bounded_rows(packs.orderBy("pack"), MOST_PACKS, "packs")]
    each = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"), F.inline(F.array(*known).cast("array<struct<pack:string,capacity:bigint>>")))
    full, rest = F.floor(F.col("n") / F.col("capacity")), F.col("n") % F.col("capacity")
    each = each.withColumns({"full": full, "rest": rest})
    whole = each.where("full > 0").select("pack", "capacity", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("piece_no"))
    whole = whole.select("pack", F.concat(F.lit("f"), F.xxhash64("doc_id").cast("string"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container"), "doc_id", "piece_no", F.col("capacity").alias("size"), "capacity")
    items = each.where("rest > 0 or n = 0").select("pack", "capacity", "doc_id", (F.col("full") + 1).alias("piece_no"), F.col("rest").alias("size"), F.xxhash64("doc_id").alias("_key"))
    packed = pack_items(items, block_items).select("pack", "container", "doc_id", "piece_no", "size", "capacity").unionByName(whole)
    return packed.select(
        F.col("pack").alias("pack_name"), "container", "doc_id", "piece_no", ((F.col("piece_no") - 1) * F.col("capacity")).alias("token_start"),
        F.col("size").alias("n_tokens"), F.col("capacity").alias("capacity_tokens"),
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """(``pack_name``, ``containers``, ``least_containers``, ``n_tokens``, ``fill``): how full each size came out."""
    bins = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("c"))
    total: Column = F.sum("t")
    return bins.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(total / F.max("c")).cast("bigint").alias("least_containers"), total.alias("n_tokens"), (total / F.sum("c")).alias("fill")
    )
