"""Hard negatives: for an anchor and each of its positives, the best other-label rows inside a window of the positive's score, from shared lists.

Anchors are clustered by direction. With every anchor of a cluster within an angle b of its centre, the product of such an anchor u with a row i at
angle t from the centre is at most |u| |i| cos(max(0, t - b)). So one list of all rows, sorted by |i| cos(max(0, t - b)), serves all members: each
walks it from the top and stops, certified, when no later row can enter its results.

A list is cut into levels of growing size by an exact histogram of its bounds, a level into blocks of bounded size. Level after level the members
that are still open meet its blocks in tiles; inside a tile the rows are sorted by bound and walked in chunks. A tile returns its best rows per
member, so what is merged is a few rows per member and tile. Levels that no member reaches are never sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.llm.common import drop_stage, stage
from candorframe.llm.vectors import common_length, finite_rows, matrix, packed, unpacked

SCALE, LIMIT = 256, 1 << 20
#: Anchor clusters, and about how many anchors their centres are fitted on; every anchor gets a cluster.
CLUSTERS, SAMPLE, TURNS = 16, 4_096, 8
#: Rows of the first level; a later one holds ``GROWTH`` times those of the one before. Rows of a block, anchors of a block, rows of a chunk.
FIRST, GROWTH, ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 16_384, 4, 16_384, 1_024, 1_024
CELLS = 1_024
NONE = np.iinfo(np.int64).min
KEPT = "label string, vec_id bigint, own bigint, vector binary, norm double"
KEPT_NAMES = ["label", "vec_id", "own", "vector", "norm"]
FOUND = "anchor_id bigint, own bigint, window int, vec_id bigint, score bigint"


def whole(column: pa.Array, dim: int) -> np.ndarray:
    return np.clip(np.floor(matrix(column, dim) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def measured(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows that take part, in whole numbers, with their lengths; rows repeated with the same id, label and vector are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(batch.column("embedding"), dim)
            norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("vec_id"), packed(v), pa.array(norm)], names=["label", "vec_id", "vector", "norm"])

    use = finite_rows(vectors, dim).where("label IS NOT NULL AND vec_id IS NOT NULL").withColumn("label", F.col("label").cast("string"))
    rows = use.mapInArrow(run, "label string, vec_id bigint, vector binary, norm double").distinct()
    return rows.select("label", "vec_id", F.xxhash64("label", "vector").alias("own"), "vector", "norm")


def centres(sample: np.ndarray, clusters: int = CLUSTERS, turns: int = TURNS) -> np.ndarray:
    """Unit directions of clusters of the sample's rows (spherical k-means from rows spread by a fixed draw)."""
    x = sample[np.abs(sample).max(axis=1) > 0].astype(float)
    if not len(x):
        return np.eye(1, sample.shape[1])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    c = x[np.random.default_rng(7).choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(turns):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _angles(v: np.ndarray, norm: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((v @ c.T) / np.maximum(norm, 1e-300)[:, None], -1, 1))


def bounds(v: np.ndarray, norm: np.ndarray, c: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """(rows, clusters): what a member's product with a row cannot exceed, divided by the member's length; rounding errors included."""
    t = np.maximum(_angles(v, norm, c) - widest - 1e-6, 0)
    return norm[:, None] * (np.cos(t) + 1e-9)


def clustered(anchors: DataFrame, c: np.ndarray, dim: int) -> DataFrame:
    """``anchors`` with their clusters and the angle to its centre; anchors of length zero are in the first, at angle zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            t = _angles(unpacked(batch.column("vector"), np.int32, dim).astype(float), norm, c)
            of = np.where(norm > 0, t.argmin(axis=1), 0)
            angle = np.where(norm > 0, t[np.arange(len(t)), of], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

    return stage(anchors.mapInArrow(run, KEPT + ", cluster int, angle double"), "anchors")


class Lists:
    """The lists of all clusters: level of every cell of bounds, highest bound and rows of every level."""

    def __init__(self, rows: DataFrame, dim: int, c: np.ndarray, widest: np.ndarray):
        self.rows, self.dim, self.c, self.widest = rows, dim, c, widest
        self.top = float(rows.agg(F.max("norm")).first()[0]) * (1 + 1e-8) + 1e-9
        counts = self._histogram()
        self.levels, self.sizes, self.highest = np.zeros((len(c), CELLS), np.int32), [], []
        for k in range(len(c)):
            level, held, room, sizes, highest = -1, 0, 0, [], []
            for cell in range(CELLS):  # from the highest bound down
                if level < 0 or held >= room:
                    level, held, room = level + 1, 0, FIRST * GROWTH ** (level + 1)
                    sizes.append(0)
                    highest.append(self.top - 2 * self.top * cell / CELLS)
                self.levels[k, cell] = level
                held += counts[k, cell]
                sizes[-1] += int(counts[k, cell])
            self.sizes.append(sizes)
            self.highest.append(highest)
        self.depth = max(map(len, self.sizes))

    def _cells(self, bound: np.ndarray) -> np.ndarray:
        """Cell 0 holds the highest bounds."""
        return np.clip(np.floor((self.top - bound) / (2 * self.top) * CELLS), 0, CELLS - 1).astype(np.int64)

    def _bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        return bounds(unpacked(batch.column("vector"), np.int32, self.dim).astype(float), batch.column("norm").to_numpy(), self.c, self.widest)

    def _histogram(self) -> np.ndarray:
        k = len(self.c)
        at, cells_of = self._bounds, self._cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(k * CELLS, np.int64)
            for batch in batches:
                counts += np.bincount((cells_of(at(batch)) + np.arange(k) * CELLS).ravel(), minlength=k * CELLS)
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], names=["cell", "n"])

        out = np.zeros(k * CELLS, np.int64)
        for r in self.rows.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CLUSTERS * CELLS rows
            out[r["cell"]] = r["n"]
        return out.reshape(k, CELLS)

    def above(self, cluster: int, level: int) -> float:
        """The highest bound of a level; below every bound where the list has ended."""
        return self.highest[cluster][level] if level < len(self.highest[cluster]) else -float("inf")

    def entries(self, level: int, clusters: list[int]) -> DataFrame:
        """(cluster, bound and the row's columns) of one level of the given lists."""
        levels, at, cells_of = self.levels, self._bounds, self._cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = at(batch)
                cells = cells_of(bound)
                for k in clusters:
                    hit = np.flatnonzero(levels[k][cells[:, k]] == level)
                    if len(hit):
                        part = batch.take(pa.array(hit))
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array(np.full(len(hit), k, np.int32)), pa.array(bound[hit, k])], names=[*part.schema.names, "cluster", "bound"]
                        )

        return self.rows.mapInArrow(run, KEPT + ", cluster int, bound double")

    def __getstate__(self):  # the frame does not go to the workers
        return {n: v for n, v in self.__dict__.items() if n != "rows"}


def walk(table: pa.Table, dim: int, k: int, same: bool) -> pa.Table:
    """The tile of some anchors and some rows of their list: per anchor and window its ``k`` best rows here, as far as they can matter."""
    is_anchor = table.column("lo").is_valid()
    labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    pick = is_anchor.to_numpy()
    mine, theirs = table.filter(is_anchor), table.filter(pc.invert(is_anchor))
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    if mine.num_rows and theirs.num_rows:
        u, norm, uid, own, ulabel = unpacked(mine.column("vector"), np.int32, dim).astype(float), mine.column("norm").to_numpy(), mine.column("vec_id").to_numpy(), mine.column("own").to_numpy(), labels[pick]
        windows = max(map(len, mine.column("lo").to_pylist()))
        grid = lambda name, fill: np.array([r + [fill] * (windows - len(r)) for r in mine.column(name).to_pylist()], np.int64)
        lo, hi, reach = grid("lo", 1), grid("hi", 0), grid("reach", NONE)
        bound = theirs.column("bound").to_numpy()
        by_bound = np.argsort(-bound, kind="stable")
        v, vid, vlabel = unpacked(theirs.column("vector"), np.int32, dim), theirs.column("vec_id").to_numpy(), labels[~pick]
        score, ids = np.full((len(u), windows, k), NONE), np.full((len(u), windows, k), np.iinfo(np.int64).max)
        live = np.arange(len(u))
        for at in range(0, len(by_bound), CHUNK):
            cap = norm[live] * bound[by_bound[at]] * (1 + 1e-9) + 1e-3
            best = np.maximum(score[live, :, k - 1], reach[live])
            ended = (best > cap[:, None]) | (cap[:, None] < lo[live]) | (lo[live] > hi[live])
            live = live[~ended.all(axis=1)]
            if not len(live):
                break
            chunk = by_bound[at : at + CHUNK]
            chunk = chunk[np.argsort(vid[chunk], kind="stable")]  # columns in the order of ties
            s = (u[live] @ v[chunk].T.astype(float)).astype(np.int64)
            fit = (uid[live, None] != vid[chunk]) & ((ulabel[live, None] == vlabel[chunk]) == same)
            key = s * CHUNK + (CHUNK - 1 - np.arange(len(chunk)))
            few = min(k, len(chunk))
            for w in range(windows):
                got = np.where(fit & (s >= lo[live, w, None]) & (s <= hi[live, w, None]), key, NONE)
                col = np.argpartition(got, len(chunk) - few, axis=1)[:, -few:]
                row = np.arange(len(live))[:, None]
                there = got[row, col] != NONE
                both = np.hstack([score[live, w], np.where(there, s[row, col], NONE)])
                whose = np.hstack([ids[live, w], np.where(there, vid[chunk][col], np.iinfo(np.int64).max)])
                order = np.lexsort((whose, -both.astype(float)), axis=1)[:, :k]
                score[live, w], ids[live, w] = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)
        a, w, r = np.nonzero(score != NONE)
        out = [[x] for x in (uid[a], own[a], w, ids[a, w, r], score[a, w, r])]
    names = ["anchor_id", "own", "window", "vec_id", "score"]
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int64)
    return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.empty(0, t)) for c, t in zip(out, kinds)], names=names)


def best_rows(anchors: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """(anchor_id, own, window, rank, vec_id, score): the ``k`` best rows of each window [lo, hi] of each anchor, of its own label or of all others.

    ``anchors``: KEPT, cluster, and arrays ``lo`` and ``hi`` with one whole number per window.
    """
    spark, dim = anchors.sparkSession, lists.dim
    found = spark.createDataFrame([], FOUND).withColumn("rank", F.lit(1))
    first = W.partitionBy("anchor_id", "own", "window").orderBy(F.desc("score"), "vec_id")
    open_ = anchors.withColumn("reach", F.transform("lo", lambda x: F.lit(NONE))).where(F.exists(F.arrays_zip("lo", "hi"), lambda z: z["lo"] <= z["hi"]))
    old: list[DataFrame] = []
    for level in range(lists.depth):
        members = {r["cluster"]: r["count"] for r in open_.groupBy("cluster").count().collect()}  # at most CLUSTERS rows
        members = {c: n for c, n in members.items() if level < len(lists.sizes[c])}
        if not members:
            break
        blocks = F.create_map(*[F.lit(x) for c, n in members.items() for x in (c, F.array(F.lit(-(-n // ANCHOR_BLOCK)), F.lit(max(1, -(-lists.sizes[c][level] // ROW_BLOCK)))))])
        open_here = open_.where(F.col("cluster").isin(list(members))).withColumn("b", blocks[F.col("cluster")])
        part = lambda seed, n: F.pmod(F.xxhash64("vec_id", "own", F.lit(seed)), n).cast("int")
        # Every block of open anchors meets every block of the level: a stated query set against the rows it can still need.
        a = open_here.select(KEPT_NAMES + ["cluster", "lo", "hi", "reach", F.lit(None).cast("double").alias("bound"), part(1, F.col("b")[0]).alias("ab"), F.explode(F.sequence(F.lit(0), F.col("b")[1] - 1)).alias("rb")])
        r = lists.entries(level, list(members)).withColumn("b", blocks[F.col("cluster")])
        empty = F.lit(None).cast("array<bigint>")
        r = r.select(KEPT_NAMES + ["cluster", empty.alias("lo"), empty.alias("hi"), empty.alias("reach"), "bound", F.explode(F.sequence(F.lit(0), F.col("b")[0] - 1)).alias("ab"), part(2, F.col("b")[1]).alias("rb")])
        if same:  # rows of labels that no open anchor of the cluster has stay where they are
            r = r.join(open_here.select("cluster", "label").distinct(), ["cluster", "label"], "left_semi").select(a.columns)
        tile = ["cluster", "ab", "rb", *(["label"] if same else [])]
        got = a.unionByName(r).groupBy(*tile).applyInArrow(lambda t: walk(t, dim, k, same), FOUND)
        found = stage(found.drop("rank").unionByName(got).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "negatives")
        kth = found.where(F.col("rank") == k).groupBy("anchor_id", "own").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # one entry a window
        above = F.create_map(*[F.lit(x) for c in members for x in (c, lists.above(c, level + 1))])
        joined = open_here.drop("b", "reach").join(kth.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "own"], "left")
        joined = joined.withColumn("cap", F.col("norm") * above[F.col("cluster")] * (1 + 1e-9) + 1e-3)
        joined = joined.withColumn("reach", F.transform("lo", lambda x, i: F.coalesce(F.col("kth")[i.cast("int")], F.lit(NONE))))
        more = F.exists(F.arrays_zip("lo", "hi", "reach"), lambda z: (z["lo"] <= z["hi"]) & (z["reach"] <= F.col("cap")) & (z["lo"] <= F.col("cap")))
        open_ = stage(joined.where(more).select(open_.columns), "open") if level + 1 < lists.depth else open_
        old += [found, *([open_] if level + 1 < lists.depth else [])]
    for frame in old[:-2]:
        if frame is not found:
            drop_stage(frame)
    return found.select("anchor_id", "own", "window", "rank", "vec_id", "score")


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the vectors that fulfil ``anchors`` (SQL over vec_id).

    Input: vec_id, embedding, label (other columns are ignored). A component x becomes floor(256 * x); a score is the whole inner product with the
    anchor; higher scores come first, ties go to the smaller vec_id. An anchor's positives are its first ``positives`` rows of the same label; a
    positive's negatives are the first ``negatives`` rows of other labels with ``low`` * positive_score <= 100 * negative_score <= ``high`` *
    positive_score. Fewer are all returned; a positive without negatives has no row. Only rows with another vec_id than the anchor's count; rows
    repeated with the same id, label and vector count once, rows that share only the id each for themselves. Rows without label or vec_id, or whose
    vector is null, empty, holds null or non-finite components or has not the most common length, take no part. Components beyond 2**20 / 256 count
    as that. An empty table gives an empty result. The result is exact: the lists only decide what need not be looked at.
    """
    spark = vectors.sparkSession
    dim = common_length(vectors)
    nothing = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if dim == 0:
        return nothing
    rows = stage(measured(vectors, dim), "rows")
    asked = rows.where(anchors)
    n = asked.count()
    if n == 0:
        return nothing
    share = min(1 << 30, int(SAMPLE / n * (1 << 30)) + 1)
    some = asked.where(F.pmod(F.xxhash64("vec_id", "own"), F.lit(1 << 30)) < share).orderBy("vec_id", "own").limit(2 * SAMPLE).select("vector").collect() or asked.orderBy("vec_id", "own").limit(1).select("vector").collect()
    c = centres(np.frombuffer(b"".join(bytes(r["vector"]) for r in some), np.int32).reshape(-1, dim))
    members = clustered(asked, c, dim)
    widest = np.zeros(len(c))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():
        widest[r["cluster"]] = r["angle"]
    lists = Lists(rows, dim, c, widest)
    members = members.drop("angle")
    any_score = members.withColumn("lo", F.array(F.lit(-(1 << 52)))).withColumn("hi", F.array(F.lit(1 << 52)))
    near = best_rows(any_score, lists, positives, True).select("anchor_id", "own", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Windows in whole numbers: the least score not under low, the greatest not over high; none under a negative score.
    lists_of = near.groupBy("anchor_id", "own").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most ``positives`` entries
    windows = lists_of.select(
        F.col("anchor_id").alias("vec_id"), "own",
        F.expr(f"transform(p, z -> IF(z.positive_score < 0, 1L, ({low} * z.positive_score + 99) div 100))").alias("lo"),
        F.expr(f"transform(p, z -> IF(z.positive_score < 0, 0L, ({high} * z.positive_score) div 100))").alias("hi"),
    )
    hard = best_rows(members.join(windows, ["vec_id", "own"]), lists, negatives, False)
    hard = hard.select("anchor_id", "own", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near, ["anchor_id", "own", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
