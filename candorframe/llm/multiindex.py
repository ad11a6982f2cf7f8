"""Near copies among vectors over an inverted multi-index.

The two halves of a unit vector are quantised by codebooks of their own; a pair of half-cells is a cell of a product grid. A vector visits cells
in the order of the sum of its two half-distances (the multi-sequence order). How many is calibrated, so that the target share of all links is
found. A bound that needs no link is the share of pairs made just at the threshold, the furthest a link can be, from vectors of the table. Links
seen can only raise it: vectors chosen by hash are compared with every vector, block after block, until links of enough groups are seen, all are
probed or the probing costs what the search does. Within a cell the visitors are compared with the residents in double precision.

Crowded cells are cut into blocks on both sides, so a task holds two blocks whatever the crowd. A block returns, per vector, a number of links and
one edge to the smallest vector it is joined to there; pairs are never written out. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import stage
from candorframe.llm.graph import components
from candorframe.llm.vectors import dimension, matrix, packed, unit, unpacked, usable

#: Rows that the codebooks are fitted on, at most about this many, chosen by hash; vectors of the first and of the largest block of probes.
FIT_ROWS, PROBES, PROBE_BLOCK = 20_000, 256, 4_096
#: Groups whose links end the probing; pairs made at the threshold, for each kind of direction.
GROUPS, MADE = 64, 4_096
CELL_ROWS, MOST_CODES, BLOCK = 64, 512, 2_048
TARGET = 0.99


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of ``x`` by Lloyd's rounds from evenly spread rows; an empty centre stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def half_distances(u: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    parts = (u[:, :half], u[:, half:])
    return tuple(np.maximum((p**2).sum(axis=1)[:, None] - 2 * p @ b.T + (b**2).sum(axis=1), 0) for p, b in zip(parts, books))


def cells(u: np.ndarray, books) -> np.ndarray:
    a, b = half_distances(u, books)
    return a.argmin(axis=1).astype(np.int64) * len(books[1]) + b.argmin(axis=1)


def traversal(u: np.ndarray, books, steps: int) -> np.ndarray:
    """The first ``steps`` cells of each row's multi-sequence order.

    The cell at places (i, j) of the sorted halves comes after (i + 1) * (j + 1) - 1 others, so only places with (i + 1) * (j + 1) <= steps count.
    """
    a, b = half_distances(u, books)
    steps = min(steps, a.shape[1] * b.shape[1])
    i, j = (p.ravel() for p in np.indices((min(steps, a.shape[1]), min(steps, b.shape[1]))))
    near = (i + 1) * (j + 1) <= steps
    i, j = i[near], j[near]
    oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    total = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
    first = np.argsort(total, axis=1, kind="stable")[:, :steps]
    return oa[np.arange(len(u))[:, None], i[first]].astype(np.int64) * b.shape[1] + ob[np.arange(len(u))[:, None], j[first]]


def places(u: np.ndarray, books, cell: np.ndarray) -> np.ndarray:
    """The place of ``cell[n]`` in the order of row n: how many cells are nearer."""
    a, b = half_distances(u, books)
    ca, cb = cell // b.shape[1], cell % b.shape[1]
    at = a[np.arange(len(u)), ca] + b[np.arange(len(u)), cb]
    b = np.sort(b, axis=1)
    return np.array([np.searchsorted(b[n], at[n] - a[n] - 1e-12, side="left").sum() for n in range(len(u))], np.int64)


def threshold_steps(u: np.ndarray, books, least: float, target: float) -> int:
    """How many cells hold the target share of pairs whose cosine is exactly ``least``, made from the unit vectors ``u``.

    The second vector of a pair departs from the first in any direction, or as vectors of the table differ; the wider of the two counts.
    """
    rng = np.random.default_rng(20_241)
    u = u[rng.permutation(max(len(u), MADE))[:MADE] % len(u)]
    steps = 1
    for way in (rng.standard_normal(u.shape), u[rng.permutation(len(u))] - u[rng.permutation(len(u))]):
        way = way - (way * u).sum(axis=1, keepdims=True) * u
        size = np.sqrt((way * way).sum(axis=1, keepdims=True))
        some = size[:, 0] > 1e-9
        if some.any():
            v = least * u[some] + math.sqrt(max(0.0, 1 - least * least)) * way[some] / size[some]
            at = np.concatenate([places(u[some], books, cells(v, books)), places(v, books, cells(u[some], books))])
            steps = max(steps, int(np.quantile(at, target, method="higher")) + 1)
    return steps


def share_steps(place: np.ndarray, weight: np.ndarray, target: float) -> int:
    """How many cells hold the target share of links with the given places."""
    order = np.argsort(place, kind="stable")
    total = np.cumsum(weight[order])
    return int(place[order][int((total >= target * total[-1] * (1 - 1e-12)).argmax())]) + 1


def _roots(near: np.ndarray, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a block is joined to inside it."""
    lp, lr = p.copy(), r.copy()
    rows, cols = np.nonzero(near)
    while True:
        before = lp.sum(), lr.sum()
        np.minimum.at(lp, rows, lr[cols])
        np.minimum.at(lr, cols, lp[rows])
        if (lp.sum(), lr.sum()) == before:
            return lp, lr


def near_duplicates(vectors: DataFrame, least: float = 0.9, target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Links are pairs with cosine >= ``least`` that the index finds. Vectors that are null, zero, hold null or non-finite components, have another
    length than most, or no vec_id, link with nothing; without a vec_id, component_id is null and the row is kept. Equal vectors are linked with
    each other, and with what any of them is linked. Rows that repeat a vec_id count as vectors of their own. An empty table gives an empty result.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    nothing = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = dimension(vectors)
    if dim < 2:
        return nothing
    key = F.md5(F.col("embedding").cast("array<double>").cast("string"))
    good = usable(vectors, dim).withColumn("key", key)
    single = stage(good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")), "vectors")
    n = single.count()
    if n == 0:
        return nothing
    part = lambda m: F.pmod(F.xxhash64("key", F.lit(m)), F.lit(1 << 30)) < int(min(1.0, m / max(n, 1)) * (1 << 30))
    fit = np.array([r["embedding"] for r in single.where(part(FIT_ROWS)).orderBy("key").limit(2 * FIT_ROWS).select("embedding").toLocalIterator()], float)
    if not len(fit):
        fit = np.array([r["embedding"] for r in single.limit(FIT_ROWS).select("embedding").collect()], float)
    u = unit(fit)
    codes = max(1, min(MOST_CODES, len(u), math.isqrt(max(1, n // CELL_ROWS))))
    books = sc.broadcast((codebook(u[:, : dim // 2], codes), codebook(u[:, dim // 2 :], codes)))

    def linked(asked):
        """(probe, place, links) of the links that the probes (id, embedding) have in the whole table."""
        probes = sc.broadcast((asked["id"].to_numpy(np.int64), unit(np.array(asked["embedding"].tolist(), float).reshape(-1, dim))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (pid, p), b = probes.value, books.value
            for batch in batches:
                v, ids = unit(matrix(batch.column("embedding"), dim)), batch.column("id").to_numpy()
                for at in range(0, len(v), BLOCK):
                    near = (v[at : at + BLOCK] @ p.T >= least) & (ids[at : at + BLOCK, None] != pid)
                    row, col = np.nonzero(near)
                    if len(row):
                        n_cells = len(b[0]) * len(b[1])
                        pair, times = np.unique(col * n_cells + cells(v[at : at + BLOCK], b)[row], return_counts=True)
                        place = places(p[pair // n_cells], b, pair % n_cells)
                        yield pa.RecordBatch.from_arrays([pa.array(pid[pair // n_cells]), pa.array(place), pa.array(times)], names=["probe", "place", "links"])

        found = single.select("id", "embedding").mapInArrow(run, "probe bigint, place bigint, links bigint")
        out = found.groupBy("probe", "place").agg(F.sum("links").alias("links")).toPandas()
        probes.destroy()
        return out

    steps = threshold_steps(u, books.value, least, target)
    # Probes in the order of a hash; of the links, each counts once, or each probe with links.
    turn = F.pmod(F.xxhash64("key", F.lit(PROBES)), F.lit(1 << 30))
    seen, groups, done, block = [], np.empty((0, dim)), 0, PROBES
    while done < n and (done == 0 or (len(groups) < GROUPS and done < steps * CELL_ROWS)):
        low, done = done, min(n, done + block)
        asked = single.where((turn >= (low << 30) // n) & (turn < (done << 30) // n)).select("id", "embedding").toPandas()
        block = min(2 * block, PROBE_BLOCK)
        got = linked(asked) if len(asked) else None
        if got is not None and len(got):
            seen.append(got)
            for v in unit(np.array(asked.loc[asked["id"].isin(got["probe"]).to_numpy(), "embedding"].tolist(), float)):
                if not (groups @ v >= least).any():
                    groups = np.vstack([groups, v])
            place, links = (np.concatenate([s[c].to_numpy(np.int64) for s in seen]) for c in ("place", "links"))
            each = np.concatenate([(s["links"] / s.groupby("probe")["links"].transform("sum")).to_numpy(float) for s in seen])
            steps = max(steps, share_steps(place, links, target), share_steps(place, each, target))

    # Vectors travel in the precision that they have in the table.
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64

    def visits(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_024):
                    part = batch.slice(at, 1_024)
                    x = matrix(part.column("embedding"), dim)
                    way = traversal(unit(x), books.value, steps)
                    for cell, own, visitor in ((cells(unit(x), books.value), np.arange(len(x)), False), (way.ravel(), np.repeat(np.arange(len(x)), way.shape[1]), True)):
                        out = [pa.array(cell), pa.array(np.full(len(own), visitor))]
                        out += [*(pa.array(part.column(c).to_numpy()[own]) for c in ("id", "weight")), packed(x[own].astype(kind))] if whole else []
                        yield pa.RecordBatch.from_arrays(out, names=["cell", "visitor", "id", "weight", "vector"][: len(out)])

        return run

    met = single.select("id", "weight", "embedding").mapInArrow(visits(True), "cell bigint, visitor boolean, id bigint, weight bigint, vector binary")
    # Blocks of crowded cells: residents and visitors are both cut by hash, and every block of one meets every block of the other.
    home = single.select("embedding").mapInArrow(visits(False), "cell bigint, visitor boolean").groupBy("cell").agg(
        F.count_if(~F.col("visitor")).alias("residents"), F.count_if("visitor").alias("visitors")
    ).where("residents > 0").select("cell", F.expr(f"CAST(ceil(residents / {BLOCK}) AS INT)").alias("rb"), F.expr(f"CAST(ceil(visitors / {BLOCK}) AS INT)").alias("vb"))
    cut = met.join(home, "cell")
    mine = lambda b: F.pmod(F.xxhash64("id"), F.col(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.greatest(F.col(b), F.lit(1)) - 1))
    columns = ("cell", "visitor", "id", "weight", "vector")
    residents = cut.where("NOT visitor").select(*columns, mine("rb").alias("r"), every("vb").alias("v"))
    visitors = cut.where("visitor").select(*columns, mine("vb").alias("v"), every("rb").alias("r")).select(*columns, "r", "v")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("visitor").to_numpy(zero_copy_only=False)
        p, r = table.filter(pa.array(side)), table.filter(pa.array(~side))
        pid, rid = p.column("id").to_numpy(), r.column("id").to_numpy()
        # Each pair is looked at once, from its smaller id.
        near = (unit(unpacked(p.column("vector"), kind, dim).astype(np.float64)) @ unit(unpacked(r.column("vector"), kind, dim).astype(np.float64)).T >= least) & (pid[:, None] < rid)
        hp, hr = near.any(axis=1), near.any(axis=0)
        near = near[hp][:, hr]
        pid, rid = pid[hp], rid[hr]
        lp, lr = _roots(near, pid, rid)
        links_ = np.concatenate([near @ r.column("weight").to_numpy()[hr], near.T @ p.column("weight").to_numpy()[hp]]).astype(np.int64)
        return pa.table([pa.array(np.concatenate([pid, rid])), pa.array(links_), pa.array(np.concatenate([lp, lr]))], names=["id", "links", "root"])

    found = stage(residents.unionByName(visitors).groupBy("cell", "r", "v").applyInArrow(compare, "id bigint, links bigint, root bigint"), "links")
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    label = single.drop("embedding").join(total, "id", "left").join(comps, "id", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "id").alias("root")
    )
    out = good.select("vec_id", "key").join(label, "key").select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"), (F.col("vec_id") == F.col("root")).alias("kept"))
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    takes = F.coalesce(F.expr(f"vec_id IS NOT NULL AND size(embedding) = {dim} AND {finite} AND exists(embedding, x -> x <> 0)"), F.lit(False))
    rest = rows.where(~takes).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)
