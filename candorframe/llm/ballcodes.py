"""Short codes of vectors: every part of a vector becomes the number of its codebook's nearest entry, learned by ball k-means on whole numbers.

An entry and the parts that started at it are a ball. A part at distance d from its ball's centre can only be nearer to entries within 2 d of that
centre. So an entry's neighbours are the entries within twice the ball's radius; a part closer than half the way to the nearest neighbour (the
stable core) keeps its entry without further work; any other lies in a ring between two neighbours' halves and is compared with the neighbours
inside that ring only. All comparisons are in whole numbers, so pruning never changes an assignment.

Vectors are staged once with the entries their parts belong to, and again after the rounds in ``REHOME``, when entries have moved far. A round is
one pass over the staged rows, without a shuffle of vectors: tasks return sums per entry, the driver holds the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import drop_stage, stage
from candorframe.llm.vectors import common_length, finite_rows, matrix, packed, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4_096
#: Rounds after which a part's ball is that of its entry at that time.
REHOME = (1, 3)
#: Whole components beyond this count as this, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: What a task returns beside sums: ``at`` of the number of parts, of a ball's largest squared distance, of the distances worked out.
COUNT, RADIUS, WORK = -1, -2, -3


def whole_parts(x: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """(rows, parts, width): floors of the scaled components; a length that ``parts`` does not divide is filled up with zeros."""
    v = np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)
    return np.pad(v, ((0, 0), (0, -v.shape[1] % parts))).reshape(len(v), parts, -1)


@dataclass(frozen=True)
class Balls:
    """Codebooks (parts, entries, width), and per part and entry its neighbours by distance."""

    books: np.ndarray
    order: list[list[np.ndarray]]
    apart: list[list[np.ndarray]]


def balls(books: np.ndarray, radii: np.ndarray | None) -> Balls:
    """``radii``: upper bounds of the squared ball radii; None where not known, which makes every other entry a neighbour."""
    order, apart = [], []
    for p in range(len(books)):
        order.append([])
        apart.append([])
        for h in range(len(books[p])):
            far = ((books[p] - books[p][h]) ** 2).sum(axis=1)
            near = np.argsort(far, kind="stable")
            near = near[(near != h) & (far[near] <= (4 * radii[p, h] if radii is not None else np.inf))]
            order[p].append(near)
            apart[p].append(far[near])
    return Balls(books, order, apart)


def assign(x: np.ndarray, home: np.ndarray, b: Balls) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, squared distances, squared distances to the home entries, distances worked out); ties go to the lower entry."""
    code, best, own = home.copy(), np.empty(home.shape, np.int64), np.empty(home.shape, np.int64)
    work = home.size
    for p in range(x.shape[1]):
        for h in np.unique(home[:, p]):
            rows = np.flatnonzero(home[:, p] == h)
            part = x[rows, p]
            d = ((part - b.books[p][h]) ** 2).sum(axis=1)
            own[rows, p] = d
            ring = np.searchsorted(b.apart[p][h], 4 * d, side="right")  # neighbours that can be as near
            c, low = np.full(len(rows), h, code.dtype), d.copy()
            for k in range(ring.max(initial=0)):
                j, reach = b.order[p][h][k], np.flatnonzero(ring > k)
                e = ((part[reach] - b.books[p][j]) ** 2).sum(axis=1)
                work += len(reach)
                won = (e < low[reach]) | (e == low[reach]) & (j < c[reach])
                low[reach[won]], c[reach[won]] = e[won], j
            code[rows, p], best[rows, p] = c, low
    return code, best, own, work


def _rows(batch: pa.RecordBatch, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return unpacked(batch.column("vector"), np.int32, parts * width).astype(np.int64).reshape(-1, parts, width), unpacked(batch.column("home"), np.uint8, parts)


def rehomed(rows: DataFrame, b: Balls) -> DataFrame:
    """``rows`` with the entries of now as homes, staged."""
    parts, _, width = b.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = assign(*_rows(batch, parts, width), b)[0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), packed(code)], names=batch.schema.names)

    return stage(rows.mapInArrow(run, rows.schema), "balls")


def measure(rows: DataFrame, b: Balls) -> dict[tuple[int, int, int], int]:
    """Sums of the parts by the entry they are nearest to, with counts, ball radii and work: (part, entry, at) to value. One pass; exact whole numbers."""
    parts, entries, width = b.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, far = np.zeros((parts, entries, width + 3), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, home = _rows(batch, parts, width)
            code, _, own, work = assign(x, home, b)
            sums[0, 0, width + 2] += work
            for p in range(parts):
                np.add.at(sums[p], (code[:, p], slice(0, width)), x[:, p])
                sums[p, :, width] += np.bincount(code[:, p], minlength=entries)
                np.maximum.at(far[p], home[:, p], own[:, p])
        sums[:, :, width + 1] = far
        p, e, at = (i.ravel().astype(np.int32) for i in np.indices(sums.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(np.array([*range(width), COUNT, RADIUS, WORK], np.int32)[at]), pa.array(sums.ravel())], names=["part", "entry", "at", "value"])

    got = rows.mapInArrow(run, "part int, entry int, at int, value bigint").groupBy("part", "entry", "at")
    got = got.agg(F.when(F.col("at") == RADIUS, F.max("value").cast("decimal(38,0)")).otherwise(F.sum(F.col("value").cast("decimal(28,0)"))).alias("value"))
    return {(r["part"], r["entry"], r["at"]): int(r["value"]) for r in got.collect()}  # one row per number of the codebooks


def moved(b: Balls, got: dict[tuple[int, int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks, and how far the balls can reach from their new centres (squared): the old radius and the way the centre went."""
    parts, entries, width = b.books.shape
    books = b.books.copy()
    for p in range(parts):
        for e in range(entries):
            n = got[p, e, COUNT]
            if n:
                books[p, e] = [got[p, e, at] // n for at in range(width)]
    went = np.sqrt(((books - b.books) ** 2).sum(axis=2).astype(float))
    radius = np.sqrt(np.array([[got[p, e, RADIUS] for e in range(entries)] for p in range(parts)], float))
    return books, ((radius + went) * (1 + 1e-9) + 1e-6) ** 2


def seeds(vectors: DataFrame, dim: int, entries: int, parts: int, scale: int) -> np.ndarray | None:
    """The parts of the ``entries`` smallest vec_ids; of rows that share one, the smallest vector. Tasks keep that many rows, no more are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            x = whole_parts(matrix(batch.column("embedding"), dim), scale, parts).reshape(batch.num_rows, -1)
            for i, v in zip(batch.column("vec_id").to_pylist(), x.tolist()):
                if i not in kept or v < kept[i]:
                    kept[i] = v
            if len(kept) > entries:
                kept = dict(sorted(kept.items(), key=lambda kv: (kv[0] is None, kv[0] or 0))[:entries])
        yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.int64()), pa.array(kept.values(), pa.list_(pa.int64()))], names=["vec_id", "v"])

    few = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, v array<bigint>").groupBy("vec_id").agg(F.min("v").alias("v"))
    found = few.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2).copy() if found else None


def learn(vectors: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame | None, Balls | None, list[int]]:
    """(staged rows, final codebooks, distances worked out in each round) for the vectors of ``finite_rows``; None, None without any."""
    books = seeds(vectors, dim, entries, parts, scale)
    if books is None:
        return None, None, []
    first = balls(books, None)
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_parts(matrix(batch.column("embedding"), dim), scale, parts)
            code = assign(x, np.zeros((len(x), parts), np.uint8), first)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), packed(x.reshape(len(x), parts * width).astype(np.int32)), packed(code)], names=["vec_id", "label", "vector", "home"]
            )

    label = vectors.schema["label"].dataType.simpleString()
    rows = stage(vectors.mapInArrow(run, f"vec_id bigint, label {label}, vector binary, home binary"), "balls")
    radii, works = None, []
    for turn in range(1, rounds + 1):
        b = balls(books, radii)
        if turn in REHOME and turn > 1:
            old, rows = rows, rehomed(rows, b)
            drop_stage(old)
            b = balls(books, None)
        got = measure(rows, b)
        works.append(got[0, 0, WORK])
        books, radii = moved(b, got)
    return rows, balls(books, radii), works


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row of ``vectors`` (vec_id, embedding, label) that takes part.

    A component x becomes floor(scale * x). Codes hold two hexadecimal digits a part; ``error`` is the squared distance to the entries, summed over
    the parts; ``label_error`` sums it over rows of the same label. ``codebooks_sha256`` covers all final entries. Rows whose vector is null, empty,
    holds null or non-finite components or has not the most common length are left out. Repeated rows count each for themselves, but an id gives one
    entry (its smallest vector); rows without an id come last there and stay in the result; null labels are one label. With fewer ids than
    ``entries`` the codebooks are shorter. Lengths that ``parts`` does not divide are filled up with zeros; components beyond 2**27 / ``scale`` count as
    that. Sums beyond 64 bits are null. An empty table gives an empty result. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    dim = common_length(vectors)
    use = finite_rows(vectors, dim)
    rows, last, _ = learn(use, dim, entries, rounds, parts, scale) if dim else (None, None, [])
    if last is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = last.books.shape[2]
    digest = hashlib.sha256(",".join(map(str, last.books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, best, _, _ = assign(*_rows(batch, parts, width), last)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(best.sum(axis=1))], names=["vec_id", "label", "code", "error"]
            )

    label = vectors.schema["label"].dataType.simpleString()
    coded = stage(rows.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    drop_stage(rows)
    sums = coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
