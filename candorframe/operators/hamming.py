"""Near matches of 64-bit fingerprints, and what is built on them: pairs, components, leak-free group splits.

Two hashes within k bits agree on at least r of k + r bit blocks, so an equi-join on every choice of r blocks finds all of them (an exact
banding, no recall loss). Copies are collapsed to one row per hash value first. A (choice, value) bucket that holds too many hashes is
refined by k + 1 bands over the remaining bits, one of which must agree too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.operators.identity import partition_split
from candorframe.session import durable

C = F.col

# Match distances.
IMAGE_MATCH_BITS = 6
NEAR_DUPLICATE_BITS = 2

HOT_BUCKET = 20_000


def join_halves(hi: Column, lo: Column) -> Column:
    """One BIGINT bit pattern from two unsigned 32-bit halves."""
    return F.shiftleft(hi.cast("bigint"), 32).bitwiseOR(lo.cast("bigint"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _split_bits(bits: list[int], parts: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(bits, parts)]


def _mask(bits) -> int:
    out = 0
    for b in bits:
        out |= 1 << int(b)
    return _signed(out)


def _banding(k: int, r: int) -> tuple[list[int], list[list[int]]]:
    """Masks of every choice of r of k + r blocks, and for each the masks of k + 1 bands over the bits left over."""
    blocks = _split_bits(list(range(64)), k + r)
    masks, refinements = [], []
    for chosen in combinations(range(k + r), r):
        inside = [b for i in chosen for b in blocks[i]]
        outside = [b for b in range(64) if b not in set(inside)]
        masks.append(_mask(inside))
        refinements.append([_mask(p) for p in _split_bits(outside, k + 1)])
    return masks, refinements


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v != -(1 << 63) else "shiftleft(1L, 63)" for v in values) + ")"


def _spread(df: DataFrame) -> DataFrame:
    """The distinct hashes of ``df``, each of which becomes many rows: by a number of partitions, as few tasks would do for the hashes alone."""
    values = df.select("hash").where("hash IS NOT NULL").distinct()
    # By another key than the distinct, or Spark takes both for one shuffle and merges its parts.
    return values.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("hash"))


def hamming_pairs(left: DataFrame, right: DataFrame | None, k: int, r: int = 2, hot: int = HOT_BUCKET) -> DataFrame:
    """(hash_a, hash_b, distance) for every two distinct hash values within k bits.

    ``left`` and ``right`` have a column ``hash``; without ``right`` the unordered pairs inside ``left`` (hash_a < hash_b).
    """
    masks, refinements = _banding(k, r)
    choices = _longs(masks)
    bands = "array(" + ", ".join(_longs(x) for x in refinements) + ")"

    def keyed(df: DataFrame) -> DataFrame:
        return _spread(df).select("hash", F.posexplode(F.expr(f"transform({choices}, m -> hash & m)")).alias("choice", "part"))

    a = keyed(left)
    b = a if right is None else keyed(right)
    busy = b.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("_c")).where(C("_c") > hot).select("choice", "part", F.lit(True).alias("_hot"))

    def refined(df: DataFrame) -> DataFrame:
        sub = F.expr(f"IF(_hot, transform({bands}[choice], m -> hash & m), array(0L))")
        return df.join(busy, ["choice", "part"], "left").select(
            "hash", "choice", "part", F.coalesce("_hot", F.lit(False)).alias("_hot"), F.posexplode(sub).alias("band", "sub")
        )

    x = refined(a).withColumnRenamed("hash", "hash_a").drop("_hot")
    y = (refined(a) if right is None else refined(b)).withColumnRenamed("hash", "hash_b")
    diff = "(hash_a ^ hash_b)"
    # Sizes are known before the rows are written out per choice, so Spark would take many times its limit for small enough to broadcast.
    pairs = x.join(y.hint("merge"), ["choice", "part", "band", "sub"]).where(F.expr(f"bit_count{diff} <= {k}"))
    if right is None:
        pairs = pairs.where("hash_a < hash_b")
    first_choice = F.expr(f"array_position(transform({choices}, m -> {diff} & m), 0L) - 1 = choice")
    first_band = F.expr(f"NOT _hot OR array_position(transform({bands}[choice], m -> {diff} & m), 0L) - 1 = band")
    return pairs.where(first_choice & first_band).select("hash_a", "hash_b", F.expr(f"CAST(bit_count{diff} AS INT)").alias("distance"))


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of every choice of at most ``most`` of the given bits."""
    return [_mask(c) for n in range(most + 1) for c in combinations(bits, n)]


def may_have_near(left: DataFrame, right: DataFrame, k: int, parts: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """The distinct hashes of ``left`` that have one of ``right`` within k bits, for many hashes on the left and far fewer on the right.

    k differing bits in ``parts`` blocks leave one block with at most its share of k - parts + 1 of them. The right side is written out with every
    such change of a block, so a left hash is looked up ``parts`` times instead of once per choice of blocks. A block value that more than ``hot``
    rows of the right share is not looked into: its left hashes are returned as well, and the caller compares them.
    """
    blocks = _split_bits(list(range(64)), parts)
    share = [(k - parts + 1) // parts + (i < (k - parts + 1) % parts) for i in range(parts)]
    keep = _longs([_mask(b) for b in blocks])
    flips = "array(" + ", ".join(_longs(_flips(b, n)) for b, n in zip(blocks, share)) + ")"

    def keyed(values: DataFrame) -> DataFrame:
        return values.select("hash", F.posexplode(F.expr(f"transform({keep}, m -> hash & m)")).alias("block", "part"))

    asked = keyed(left.select("hash").where("hash IS NOT NULL").distinct())
    held = keyed(_spread(right)).select(C("hash").alias("near"), "block", F.explode(F.expr(f"transform({flips}[block], m -> part ^ m)")).alias("part"))
    crowded = held.groupBy("block", "part").agg(F.count(F.lit(1)).alias("_c")).where(C("_c") > hot).select("block", "part", F.lit(True).alias("_hot"))
    close = (asked["block"] == held["block"]) & (asked["part"] == held["part"]) & F.expr(f"bit_count(hash ^ near) <= {k}")
    # As in hamming_pairs, Spark sizes the right side before its rows are written out: it would send all of them through the driver.
    found = asked.join(held.join(crowded, ["block", "part"], "left_anti").hint("merge"), close, "left_semi").select("hash")
    return found.unionByName(asked.join(crowded, ["block", "part"], "left_semi").select("hash")).distinct()


def phash_match(query: DataFrame, index: DataFrame, max_bits: int = IMAGE_MATCH_BITS) -> DataFrame:
    """(hash_a, hash_b, distance, n_items, n_refs): query and reference hashes within the distance, one row per pair of hash values, with the
    items and references that have them. Input: item_id, hash; ref_id, hash.

    Joining back by hash names the items; copies times copies are not written out.
    """
    items = query.where("hash IS NOT NULL").groupBy(C("hash").alias("hash_a")).agg(F.count(F.lit(1)).alias("n_items"))
    refs = index.where("hash IS NOT NULL").groupBy(C("hash").alias("hash_b")).agg(F.count(F.lit(1)).alias("n_refs"))
    pairs = hamming_pairs(query, index, max_bits)
    return pairs.join(items, "hash_a").join(refs, "hash_b").select("hash_a", "hash_b", "distance", "n_items", "n_refs")


def phash_findings(query: DataFrame, index: DataFrame, max_bits: int = IMAGE_MATCH_BITS) -> DataFrame:
    """One finding per query item: WARN with the number of matches and the nearest distance, else INFO; a note when the index is empty.

    References are counted per hash before any join, so copies on either side do not multiply.
    """
    m = phash_match(query, index, max_bits).groupBy(C("hash_a").alias("hash")).agg(F.sum("n_refs").alias("matches"), F.min("distance").alias("nearest"))
    size = index.agg(F.count(F.lit(1))).scalar()
    out = query.select("item_id", "hash").join(m, "hash", "left").withColumn("_n", size)
    return out.select(
        "item_id", F.when(C("matches") > 0, "WARN").otherwise("INFO").alias("status"), F.coalesce("matches", F.lit(0)).alias("matches"), "nearest",
        F.when(C("_n") == 0, "no reference index").alias("note"),
    )


def near_duplicate_pairs(items: DataFrame, max_bits: int = NEAR_DUPLICATE_BITS) -> DataFrame:
    """(hash_a, hash_b, distance, n_a, n_b): all pairs within the distance, one row per pair of hash values, with the copies on each side.

    Copies of one value appear as (h, h, 0, n, n). Joining back to the items by hash gives the item pairs; they are not written out here
    because n copies would give n * n of them.
    """
    sizes = items.where("hash IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    near = hamming_pairs(items, None, max_bits, r=3)
    near = near.join(sizes.select(C("hash").alias("hash_a"), C("n").alias("n_a")), "hash_a").join(
        sizes.select(C("hash").alias("hash_b"), C("n").alias("n_b")), "hash_b"
    )
    copies = sizes.where("n > 1").select(C("hash").alias("hash_a"), C("hash").alias("hash_b"), F.lit(0).alias("distance"), C("n").alias("n_a"), C("n").alias("n_b"))
    return near.select("hash_a", "hash_b", "distance", "n_a", "n_b").unionByName(copies)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of the component, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps; each round is kept in the checkpoint folder. Goes on until nothing moves.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(C("b").alias("a"), C("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return oriented(both.where("b > a").join(low, "a").select(C("b").alias("a"), C("m").alias("b")))

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").where("b <> m").select(C("b").alias("a"), C("m").alias("b"))
        return oriented(moved.unionByName(low.select("a", C("m").alias("b"))))

    def digest(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    current = durable(oriented(edges))
    mark = digest(current)
    while True:
        current = durable(small_star(large_star(current)))
        fresh = digest(current)
        if fresh == mark:
            roots = current.select(C("b").alias("node"), C("b").alias("root")).distinct()
            return current.select(C("a").alias("node"), C("b").alias("root")).unionByName(roots)
        mark = fresh


def near_duplicate_groups(items: DataFrame, max_bits: int = NEAR_DUPLICATE_BITS) -> DataFrame:
    """``items`` (item_id, hash) with group_id, the smallest item of the chain of near duplicates; without a hash an item is its own group."""
    near = hamming_pairs(items, None, max_bits, r=3).select(C("hash_a").alias("a"), C("hash_b").alias("b"))
    roots = connected_components(near).select(C("node").alias("hash"), "root")
    tied = items.where("hash IS NOT NULL").join(roots, "hash", "left").withColumn("_g", F.coalesce("root", "hash"))
    smallest = tied.groupBy("_g").agg(F.min("item_id").alias("group_id"))
    named = tied.join(smallest, "_g").select(*items.columns, "group_id")
    return named.unionByName(items.where("hash IS NULL").withColumn("group_id", C("item_id")))


def group_split(items: DataFrame) -> DataFrame:
    """(item_id, group_id, split): the whole near-duplicate group goes to the side of its smallest sha256. Input: item_id, hash, sha256."""
    g = near_duplicate_groups(items)
    low = g.groupBy("group_id").agg(F.min("sha256").alias("_low"))
    return g.join(low, "group_id").select("item_id", "group_id", partition_split(C("_low")).alias("split"))


def dhash_bits(gray: Column, rows: int = 8, cols: int = 9) -> Column:
    """16 hex digits of a row-major grey array: one bit per neighbour pair, first pair highest, set when the right pixel is brighter."""
    pairs = [(r * cols + c, r * cols + c + 1) for r in range(rows) for c in range(cols - 1)]
    halves = []
    for part in (pairs[:32], pairs[32:]):
        total = F.lit(0).cast("bigint")
        for n, (i, j) in enumerate(part):
            total = total + F.when(F.get(gray, F.lit(j)) > F.get(gray, F.lit(i)), F.lit(1 << (31 - n)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        halves.append(F.lpad(F.lower(F.hex(total)), 8, "0"))
    return F.concat(*halves)
