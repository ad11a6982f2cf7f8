"""Near copies of texts by one-permutation hashing.

A text is the set of its five-word shingles. One hash puts every shingle into one of ``BINS`` bins, the smallest of a bin is its value, and an
empty bin borrows from the first filled one in an order of its own (optimal densification), so equal sets keep equal values and every bin
agrees with probability equal to the similarity. Bins are read in bands; texts that share a band meet in its bucket.

Candidates of a bucket are stars: its most central text against the others, so a bucket of n copies costs about n pairs. Verified links join
components. What then still lies in several components of one bucket is compared block against block inside tasks, which return one edge per
text and never their pairs. So every two texts of a bucket are either compared or inside one component, and no candidate is lost. Verification
counts the full shingle sets.

Sets that are equal are one node from the start, whatever the number of their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import WordHash, free, mix64, signed, stage, texts, wide_rows, words
from candorframe.llm.graph import components, joined

SHINGLE = 5
#: Bins, and the most of them in a band; the share of pairs just at the threshold that may meet in no band.
BINS, ROWS = 180, 6
MISSED = 1e-6
#: Rounds of stars before what is still open is compared in blocks of this many texts.
STARS, BLOCK = 2, 128
#: A clump of buckets is compared as one while it has at most this many times the pairs of its buckets.
SPARSE = 8
#: Bits of the filter that tells which documents must be read again; at most 2 ** 20 words of it reach the driver (16 MB).
FILTER_BITS = 26

_EDGES = np.array([-(-(b << 64) // BINS) for b in range(BINS)], dtype=np.uint64)
_ORDERS = np.stack([np.random.default_rng(1_000 + b).permutation(BINS) for b in range(BINS)])
_SEEDS = mix64(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, memo: WordHash) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text; with one to four words, the whole sequence as one; without words, none."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = memo.of(ws)
    width = min(SHINGLE, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * _STEP + h[k : len(h) - width + 1 + k]
    return np.unique(mix64(acc))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin of a set that is not empty."""
    at = np.searchsorted(shingles, _EDGES)
    end = np.append(at[1:], len(shingles))
    filled = at < end
    values = shingles[np.minimum(at, len(shingles) - 1)]
    if filled.all():
        return values
    lender = _ORDERS[np.arange(BINS), filled[_ORDERS].argmax(axis=1)]
    return np.where(filled, values, values[lender])


def banding(percent: int) -> int:
    """Bins in a band: the most for which a pair at ``percent`` meets in no band at most in MISSED of all cases."""
    return next((rows for rows in range(ROWS, 1, -1) if BINS % rows == 0 and (1 - (percent / 100) ** rows) ** (BINS // rows) <= MISSED), 1)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    acc = _SEEDS[: BINS // rows].copy()
    for col in sig.reshape(BINS // rows, rows).T:
        acc = mix64(acc * _STEP + col)
    return acc


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, node, buckets): node names the shingle set, null if it is empty; buckets are the band keys for links from ``percent`` on."""
    rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            n, node, keys = [], [], []
            for text in texts(batch.column("text")):
                s = shingle_set(text, memo)
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                keys.append(signed(bands(signature(s), rows)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "buckets"],
            )

    wide_rows(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, buckets array<bigint>")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit per hashed id. Full or not, it never hides an id; the exact join follows."""
    rows = (
        ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("h"))
        .groupBy(F.expr("h div 64").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("b"))
        .toPandas()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return bits.view(np.uint64)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the sets named in ``nodes`` (node, doc_id), once each, worked out again from the whole texts.

    The filter of ids keeps most texts from being worked out; the join is exact.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_id_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = WordHash(), sent.value
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.uint64)
            hit = np.flatnonzero((bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1))
            for at in range(0, len(hit), 128):
                some = pa.array(hit[at : at + 128])
                sets = [shingle_set(t, memo) for t in texts(batch.column("text").take(some))]
                part = [(d, s) for d, s in zip(batch.column("doc_id").take(some).to_pylist(), sets) if len(s)]
                if part:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in part], pa.int64()), pa.array([_node(s) for _, s in part], pa.int64()), pa.array([signed(s) for _, s in part], pa.list_(pa.int64()))],
                        names=["of", "node", "shingles"],
                    )

    src = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << FILTER_BITS)).alias("h"), F.col("text").cast("string").alias("text")
    )
    named = src.mapInArrow(run, "of bigint, node bigint, shingles array<bigint>").join(nodes.select("node", "doc_id"), "node").where("of = doc_id")
    return named.select("node", "shingles").dropDuplicates(["node"])


def _star(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of each open bucket: one text of its rarest component, the most central of them, against those of other components.

    ``open_``: bucket, node, comp, central. The centre is an aggregate, so a hot bucket combines before the shuffle.
    """
    rarity = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("rarity"), F.min_by(F.struct("node", "central"), F.struct(-F.col("central"), "node")).alias("best"))
    first = F.struct("rarity", -F.col("best.central"), "best.node")
    centre = rarity.groupBy("bucket").agg(F.min_by(F.struct("best.node", "comp"), first).alias("c"))
    met = open_.join(centre, "bucket").where("comp <> c.comp")
    return met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    same = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(left, "a").join(right, "b").where(same * 100 >= (F.size("s_a") + F.size("s_b") - same) * percent).select("a", "b").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share: products of slices of the incidence matrix, so its width does not matter."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((n, n), np.float64)
    step = 1 << 14
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        at = slice(*np.searchsorted(code, [low, low + step]))
        if at.start < at.stop:
            used, column = np.unique(code[at], return_inverse=True)
            part = np.zeros((n, len(used)), np.float32)
            part[owner[at], column] = 1
            out += part @ part.T
    return out


def _tiles(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is left in open buckets: all its texts of different components are compared, block against block.

    Buckets that overlap form a clump and are compared once as such, unless a clump is mostly pairs that share no bucket: then each of its
    buckets is a group for itself. A task holds two blocks of a group and returns one edge per text at most, never its pairs.
    """
    low = open_.groupBy("bucket").agg(F.min("node").alias("b"))
    clump = components(open_.join(low, "bucket").select(F.col("node").alias("a"), "b")).withColumnRenamed("root", "clump")
    placed = stage(open_.join(clump, "node"), "placed")
    per_bucket = placed.groupBy("clump", "bucket").agg(F.count(F.lit(1)).alias("m")).groupBy("clump").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    per_clump = placed.select("clump", "node").distinct().groupBy("clump").agg(F.count(F.lit(1)).alias("m"))
    dense = stage(per_bucket.join(per_clump, "clump").select("clump", "m", (F.col("m") * F.col("m") <= SPARSE * F.col("pairs")).alias("dense")), "clumps")
    member = _with_density(placed, dense).select(F.when(F.col("dense"), F.col("clump")).otherwise(F.col("bucket")).alias("group"), "dense", "node", "comp").distinct()
    size = member.groupBy("group", "dense").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = member.join(size, ["group", "dense"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tile = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", "dense", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "own"
    )

    def compare(table: pa.Table) -> pa.Table:
        node, comp, own = (table.column(c).to_numpy() for c in ("node", "comp", "own"))
        lists = table.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets_ = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        size_ = np.array([len(x) for x in sets_], np.float64)
        common = _common(sets_)
        linked = (common * 100 >= (size_[:, None] + size_ - common) * percent) & (comp[:, None] != comp)
        # One edge to the smallest text that a text is joined to here.
        root = node.copy()
        rows, cols = np.nonzero(linked)
        while True:
            before = root.copy()
            np.minimum.at(root, rows, root[cols])
            if (before == root).all():
                break
        hit = root != node
        return pa.table([pa.array(node[hit]), pa.array(root[hit])], names=["a", "b"])

    whole = tile.join(sets, "node")
    return whole.groupBy("group", "dense", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _with_density(placed: DataFrame, dense: DataFrame) -> DataFrame:
    """``placed`` with the column dense of its clump. Clumps that hold over a thousandth of the texts are fewer than a thousand: they are broadcast, so
    that the rows of a large one stay where they are; the rows of the others are joined."""
    total = dense.agg(F.sum("m")).first()[0] or 0
    large = dense.where(F.col("m") * 1_000 > total).select("clump", "dense")
    met = placed.join(F.broadcast(large), "clump", "left")
    others = met.where("dense IS NULL").drop("dense").join(dense.where(F.col("m") * 1_000 <= total).select("clump", "dense"), "clump")
    return met.where("dense IS NOT NULL").unionByName(others)


def _still_open(open_: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets whose texts lie in several components, with those components."""
    now = open_.drop("comp").join(comps.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return now.join(split, "bucket")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Documents with the component of near copies that each belongs to.

    Input: doc_id, text (other columns are ignored). Two documents link when 100 * intersection >= percent * union of their shingle sets.
    Returns, for every input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Null or empty texts, and texts of white space, have an empty set and link with nothing. A null doc_id links with nothing: its component_id
    is null and it is kept. Rows that repeat a doc_id are judged by their own text and share the id. Long texts count whole. An empty table
    gives an empty result.
    """
    sk = stage(sketches(docs, percent), "sketches")
    named = sk.where("doc_id IS NOT NULL AND node IS NOT NULL")
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    # Equal sets have equal buckets: one row a set, whatever the number of copies, combined before the shuffle.
    keys = named.groupBy("node").agg(F.first("buckets").alias("buckets")).select("node", F.explode("buckets").alias("bucket"))
    crowded = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = stage(keys.join(crowded, "bucket"), "buckets")
    central = member.groupBy("node").agg(F.sum("size").alias("central"))
    known = stage(central.join(nodes, "node"), "nodes")
    sets = stage(full_sets(docs, known.select("node", "doc_id")), "sets")

    open_ = member.join(known.select("node", "central"), "node").select("bucket", "node", "central", F.col("node").alias("comp"))
    comps: DataFrame | None = None
    for _ in range(STARS):
        open_ = stage(open_, "open")
        links = stage(_verified(_star(open_), sets, percent), "links")
        comps = stage(components(links) if comps is None else joined(comps, links), "components")
        open_ = _still_open(open_, comps)
        free(docs.sparkSession)
    open_ = stage(open_, "open")
    if not open_.isEmpty():
        comps = stage(joined(comps, stage(_tiles(open_, sets, percent), "links")), "components")
        free(docs.sparkSession)
    # The smallest document of a component; only linked sets take part, the others stand for themselves.
    tied = nodes.join(comps, "node")
    low = tied.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = tied.select("node", "root").join(low, "root").select("node", "component_id")
    alone = nodes.join(comps, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    label = own.unionByName(alone)
    out = sk.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(label, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, one document of each group of near copies, with the columns of ``docs``.

    Rows with a null doc_id stay, and so do blank and null texts: they link with nothing. Rows that share a kept doc_id are one when their texts are equal;
    rows of other texts stay each for themselves. An empty table gives an empty result.
    """
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    # Rows travel whole in a struct, so no name of theirs can clash.
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").alias("_text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    mine = rows.join(kept, "doc_id")
    # Only ids that come in several rows need their rows compared.
    once = mine.where("_rows = 1").select("row.*")
    more = mine.where("_rows > 1").dropDuplicates(["doc_id", "_text"]).select("row.*")
    return once.unionByName(more).unionByName(docs.where("doc_id IS NULL"))
