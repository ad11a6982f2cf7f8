"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector, less the mean of all, is put into a space of more dimensions and rotated at random; the signs of the result are its code, packed into
64-bit words. With three scalars (length, how well the signs point along the vector, product with the mean) the code gives an estimate of every
inner product and an error bound that holds with high probability. A query is rotated as well and rounded to a few bit planes, so the product of
its plane with a code is a count of common bits.

Queries and codes meet in tiles of bounded size: a block of queries against a block of codes with their vectors. In a tile the vectors whose upper
bound reaches the query's k-th lower bound are reranked, and the k best per query leave it. (Fetching the vectors of what is left afterwards costs
more than it saves: with honest bounds a query reranks a tenth or more of a small table.) Equal vectors are one code with their k + 1 smallest ids,
which is all that a query can need of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.llm.common import stage
from candorframe.llm.vectors import dimension, matrix, packed, unpacked, usable

#: Bits of a code for each dimension.
EXPANSION = 4
#: Width of the error bound in standard deviations of the estimate.
SIGMAS = 3.0
#: Bit planes that a rotated query is rounded to.
PLANES = 6
QUERY_BLOCK, VECTOR_BLOCK = 2_048, 32_768
CODED = "first bigint, mark bigint, ids array<bigint>, n int, code binary, length double, along double, centred double, vector binary"


def rotation(dim: int) -> np.ndarray:
    """Orthonormal columns that take ``dim`` dimensions to the code's, the same for every caller."""
    bits = -(-dim * EXPANSION // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(20_240).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, length, along, centred): packed sign bits; the distance to the mean; cosine of code and vector; product with the mean."""
    d = x - mean
    length = np.sqrt((d * d).sum(axis=1))
    turned = d @ rotate.T
    along = np.abs(turned).sum(axis=1) / np.maximum(length, 1e-300) / math.sqrt(rotate.shape[0])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, along, 1.0), x @ mean


def planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, low, step): rows rounded to ``PLANES`` bits, as packed words (rows, planes, words); a component is about low + step * its number."""
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-300) / ((1 << PLANES) - 1)
    number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    bits = np.stack([np.packbits((number >> k) & 1, axis=1) for k in range(PLANES)], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64), low, step


def bit_products(query: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, codes): sum of a query's numbers over the set bits of a code, by counting common bits plane by plane."""
    out = np.zeros((len(query), len(codes)), np.int32)
    for k in range(query.shape[1]):
        common = np.zeros(out.shape, np.int32)
        for w in range(codes.shape[1]):
            common += np.bitwise_count(query[:, k, w, None] & codes[None, :, w])
        out += common << k
    return out


def index(vectors: DataFrame, dim: int, mean: np.ndarray, k: int) -> DataFrame:
    """One row per distinct usable vector: its smallest id and a hash of it (together its name), its k + 1 smallest ids, its code, and the vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate = rotation(dim)
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            codes, length, along, centred = encode(x, mean, rotate)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("first", "mark", "ids", "n")), packed(codes), pa.array(length), pa.array(along), pa.array(centred), packed(x)],
                names=["first", "mark", "ids", "n", "code", "length", "along", "centred", "vector"],
            )

    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = usable(vectors, dim).distinct().withColumn("_n", place).where(F.col("_n") <= k + 1)
    one = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    named = one.select(F.get("ids", F.lit(0)).alias("first"), F.xxhash64("embedding").alias("mark"), "ids", F.size("ids").alias("n"), "embedding")
    return named.mapInArrow(run, CODED)


def nearest(vectors: DataFrame, queries: str, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product for each vector that fulfils ``queries`` (SQL over vec_id).

    Input: vec_id, embedding (other columns are ignored). Candidates are all vectors with another vec_id; ties go to the smaller vec_id; fewer
    than ``k`` candidates are all returned. Vectors that are null, zero, or hold null or non-finite components, or whose length is not the most
    common one, or without a vec_id, take no part. Rows that repeat id and vector count once. An empty table gives an empty result.
    """
    from pyspark.ml.functions import array_to_vector  # not for the workers
    from pyspark.ml.stat import Summarizer

    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = dimension(vectors)
    use = usable(vectors, dim)
    if dim == 0 or use.isEmpty():
        return nothing
    stats = use.select(Summarizer.metrics("mean").summary(array_to_vector(F.col("embedding").cast("array<double>"))).alias("s")).select("s.mean").first()
    mean = np.array(stats["mean"].toArray())
    coded = stage(index(vectors, dim, mean, k), "codes")
    asked = stage(use.where(queries).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("of"), F.col("embedding").cast("array<double>").alias("question")), "asked")
    n_blocks = max(1, -(-coded.count() // VECTOR_BLOCK))
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # Each block of queries goes to every block of codes and back: a stated query set against all rows, in tiles.
    q = asked.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"), "vb": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    v = coded.withColumns({"vb": F.pmod(F.xxhash64("first", "mark"), F.lit(n_blocks)).cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))})

    def tile(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        if mine.num_rows and theirs.num_rows:
            rotate = rotation(dim)
            bits = rotate.shape[0]
            qid, of, question = mine.column("query_id").to_numpy(), mine.column("of").to_numpy(), matrix(mine.column("question").combine_chunks(), dim)
            first, n, length, along, centred = (theirs.column(c).to_numpy() for c in ("first", "n", "length", "along", "centred"))
            ids, x = theirs.column("ids").combine_chunks().flatten().to_numpy(), unpacked(theirs.column("vector"), np.float64, dim)
            start = np.concatenate([[0], np.cumsum(n)])
            codes = unpacked(theirs.column("code"), np.uint64, bits // 64)
            ones = np.bitwise_count(codes).sum(axis=1).astype(float)
            scale = length / np.maximum(along, 1e-9) / math.sqrt(bits)
            slack = length * np.sqrt(np.maximum(1 - along**2, 0) / (bits - 1)) / np.maximum(along, 1e-9) * SIGMAS
            for at in range(0, len(qid), 64):
                part = question[at : at + 64]
                d = part - mean
                turned = d @ rotate.T
                words, low, step = planes(turned)
                # The product with the signs: twice that with the set bits, less the sum of all.
                signed = 2 * (step[:, None] * bit_products(words, codes) + low[:, None] * ones) - turned.sum(axis=1)[:, None]
                guess = signed * scale + centred + (part @ mean - mean @ mean)[:, None]
                rounded = SIGMAS * step * math.sqrt(bits / 12)
                wide = np.sqrt((d * d).sum(axis=1))[:, None] * slack + rounded[:, None] * scale + 1e-5 * (1 + np.abs(guess))
                own = (qid[at : at + 64, None] == first[None, :]) & (n == 1)
                least = np.where(own, -np.inf, guess - wide)
                reach = np.partition(least, -k, axis=1)[:, -k] if len(first) >= k else np.full(len(part), -np.inf)
                hit = ~own & (guess + wide >= reach[:, None])
                for i, row in enumerate(hit):
                    near = np.flatnonzero(row)
                    score = x[near] @ part[i]
                    if len(near) > k:  # with every vector that is as near as the k-th
                        best = score >= np.partition(score, -k)[-k]
                        near, score = near[best], score[best]
                    who = np.concatenate([ids[start[j] : start[j + 1]] for j in near]) if len(near) else np.empty(0, np.int64)
                    score = np.repeat(score, n[near])
                    other = who != qid[at + i]
                    who, score = who[other], score[other]
                    best = np.lexsort((who, -score))[:k]
                    for c, y in zip(out, (np.full(len(best), qid[at + i]), np.full(len(best), of[at + i]), who[best], score[best])):
                        c.append(y)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.empty(0, t)) for c, t in zip(out, kinds)], names=["query_id", "of", "vec_id", "score"])

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(tile, "query_id bigint, of bigint, vec_id bigint, score double")
    best = F.row_number().over(W.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
