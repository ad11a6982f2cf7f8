"""Mixing to target weights with soft membership.

Documents carry no domain. A classifier fitted on a labelled table gives each one a probability for every domain; a document drawn at rate r adds
r * tokens * probability to a domain. The rates are the non-negative ones nearest to the corpus as it is whose expected domain totals match the
targets: least squares by projected gradient from rate 1. The number of domains is small, so a step needs one sum per domain over all documents
and sends back as many numbers. A document's rate follows from its own probabilities and the steps so far, so no state is kept between steps.

The gradient is scaled by the second moments of the domains over the documents whose rate is not held at zero, which makes the descent short;
a step that does not come nearer is shortened.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import WordHash, stage, texts, wide_rows, words

#: About this many labelled rows, chosen by hash, fit the classifier; the labels of twice as many at most are broadcast.
FIT_ROWS = 12_000
#: Hash buckets of words, and how many of them the classifier looks at.
BUCKETS, CHOSEN = 1 << 16, 384
STEPS, CLOSE = 40, 1e-4
SEED = 4


def _buckets(column: pa.Array, memo: WordHash) -> list[np.ndarray]:
    """Sorted distinct word buckets of each text, from its letters alone."""
    return [np.unique(memo.of([w.strip(b".,;:!?\"'()") for w in words(t)]) % np.uint64(BUCKETS)).astype(np.int64) for t in texts(column)]


def _style(text: bytes | None) -> tuple[float, ...]:
    """Shares that words do not show: signs, capitals, words without letters, repeated words."""
    ws = text.split() if text else []
    if not ws:
        return (0.0,) * 4
    n, size = len(ws), sum(map(len, ws))
    solid = b"".join(ws)
    signs, capitals = len(solid.translate(None, _PLAIN)), size - len(solid.translate(None, _CAPITALS))
    bare = sum(1 for w in ws if not w.translate(None, _SIGNS)) / n
    return signs / size, capitals / size, bare, sum(map(bytes.__eq__, ws, ws[1:])) / n


_PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
_CAPITALS = bytes(range(65, 91))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Membership:
    """A linear classifier over chosen word buckets and style."""

    domains: tuple[str, ...]
    chosen: np.ndarray
    weights: np.ndarray  # domain, feature
    intercept: np.ndarray

    def features(self, column: pa.Array, memo: WordHash) -> np.ndarray:
        place = np.full(BUCKETS, -1)
        place[self.chosen] = np.arange(len(self.chosen))
        out = np.zeros((len(column), len(self.chosen) + 4))
        for row, (b, t) in enumerate(zip(_buckets(column, memo), texts(column))):
            at = place[b]
            out[row, at[at >= 0]] = 1
            out[row, len(self.chosen) :] = _style(t)
        return out

    def column(self) -> Column:
        """struct(tokens, p): the number of words, and the probability of each domain."""
        model = self

        def run(column: pa.Array) -> pa.Array:
            memo, tokens, rows = WordHash(), [], []
            for at in range(0, len(column), 500):
                part = column.slice(at, 500)
                tokens += [len(words(t)) for t in texts(part)]
                s = model.features(part, memo) @ model.weights.T + model.intercept
                e = np.exp(s - s.max(axis=1, keepdims=True))
                rows += list(e / e.sum(axis=1, keepdims=True))
            return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["tokens", "p"])

        return F.arrow_udf(run, "struct<tokens:bigint,p:array<double>>")(F.col("text").cast("string"))


def fit(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], fit_rows: int = FIT_ROWS) -> Membership:
    """Fits on about ``fit_rows`` rows of ``labelled`` (doc_id, domain), whose texts are looked up in ``docs``."""
    from pyspark.ml.classification import LogisticRegression  # not for the workers
    from pyspark.ml.functions import array_to_vector

    wide_rows(docs.sparkSession)
    number = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(float(i)))])
    known = labelled.where("doc_id IS NOT NULL").select("doc_id", number[F.col("domain")].alias("label")).where("label IS NOT NULL")
    share = min(1.0, fit_rows / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * fit_rows)
    known_texts = stage(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", F.col("text").cast("string").alias("text")), "labelled")

    def spread(column: pa.Array) -> pa.Array:
        return pa.array(_buckets(column, WordHash()), pa.list_(pa.int64()))

    sizes = {r["label"]: r["count"] for r in known_texts.groupBy("label").count().collect()}
    if len(sizes) < 2:
        bias = np.array([0.0 if float(i) in sizes or not sizes else -700.0 for i in range(len(domains))])
        return Membership(domains, np.empty(0, np.int64), np.zeros((len(domains), 4)), bias)
    total = sum(sizes.values())
    # How much more often a word's bucket occurs in a domain than elsewhere, in standard deviations; the strongest are looked at.
    seen = known_texts.select("label", F.explode(F.arrow_udf(spread, "array<bigint>")("text")).alias("bucket"))
    held = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == label).alias(f"n{int(label)}") for label in sizes])
    strength = [F.abs(F.col(f"n{int(k)}") - F.col("n") * (m / total)) / F.sqrt(F.col("n") * (m / total) * (1 - m / total) + 1) for k, m in sizes.items()]
    chosen = np.sort(np.array([r["bucket"] for r in held.where("n >= 5").withColumn("s", F.greatest(*strength)).orderBy(F.desc("s"), "bucket").limit(CHOSEN).collect()], np.int64))
    shape = Membership(domains, chosen, np.empty(0), np.empty(0))

    def dense(column: pa.Array) -> pa.Array:
        return pa.array(list(shape.features(column, WordHash())), pa.list_(pa.float64()))

    rows = known_texts.select("label", array_to_vector(F.arrow_udf(dense, "array<double>")("text")).alias("features"))
    got = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    weights, intercept = np.zeros((len(domains), len(chosen) + 4)), np.full(len(domains), -700.0)
    fitted = got.coefficientMatrix.toArray()
    for label in sizes:
        weights[int(label)], intercept[int(label)] = fitted[int(label)], got.interceptVector[int(label)]
    return Membership(domains, chosen, weights, intercept)


def rate_column(steps: list[np.ndarray], p: str = "p") -> Column:
    """The rate after the given steps: from 1, each takes off the product of the probabilities with its direction, and zero is the least."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(F.col(p)[i] * F.lit(float(s)) for i, s in enumerate(step)))
    return rate


def solve(members: DataFrame, weights: list[float], anchor: int) -> list[np.ndarray]:
    """Steps whose rates bring the expected domain totals of ``members`` (tokens, p) to ``weights`` times a common size.

    The size is such that domain ``anchor`` keeps its tokens.
    """
    d, t = len(weights), F.col("tokens")

    def look(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals at these rates, and the second moments of the documents that are not held at zero."""
        free = F.when(F.col("r") > 0, t).otherwise(0)
        sums = [F.sum(t * F.col("r") * F.col("p")[i]) for i in range(d)] + [F.sum(free * F.col("p")[i] * F.col("p")[j]) for i in range(d) for j in range(d)]
        got = np.array([x or 0.0 for x in members.select(t, "p", rate.alias("r")).agg(*sums).first()])
        return got[:d], got[d:].reshape(d, d)

    now, moments = look(F.lit(1.0))
    share = np.array(weights) / sum(weights)
    size = now[anchor] / share[anchor]
    if size <= 0:
        return []
    target = share * size
    steps: list[np.ndarray] = []
    scale = 1.0
    while len(steps) < STEPS and (off := np.abs(now - target).max()) > CLOSE * size:
        # Rounded, so that the order in which Spark adds does not show in the rates.
        step = np.round(scale * np.linalg.solve(moments / size + 1e-9 * np.eye(d), (now - target) / size), 9)
        then, fresh = look(rate_column([*steps, step]))
        if np.abs(then - target).max() >= off:
            if scale < 1e-3:
                break
            scale /= 4
            continue
        steps.append(step)
        now, moments, scale = then, fresh, min(1.0, 2 * scale)
    return steps


def _draw() -> Column:
    """A number in [0, 1) from id and text; a rate plus it, rounded down, has the rate as expectation."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``labelled``: doc_id, domain. ``targets``: weight of each domain; ``anchor`` keeps its tokens. Null and empty texts have no tokens, the
    probabilities of a text that says nothing, and the rate that follows from these. Null ids and repeated rows are documents of their own. Without labels
    every domain is equally likely; with labels of one domain only, that one is certain. An empty table gives an empty result.
    """
    domains = tuple(targets)
    members = stage(docs.select("doc_id", _draw().alias("draw"), fit(docs, labelled, domains).column().alias("m")).select("doc_id", "draw", "m.tokens", "m.p"), "members")
    rate = rate_column(solve(members, list(targets.values()), domains.index(anchor)))
    named = [F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(domains)]
    rated = members.select("doc_id", "tokens", *named, F.round(rate, 6).alias("rate"), "draw")
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col("draw")).cast("int")).drop("draw")


def draw(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with the columns of ``docs``."""
    domains = tuple(targets)
    member = fit(docs, labelled, domains).column()
    members = stage(docs.select(member.alias("m")).select("m.tokens", "m.p"), "members")
    steps = solve(members, list(targets.values()), domains.index(anchor))
    # Rows travel whole in a struct, so no name of theirs can clash.
    rated = docs.select(F.struct(*docs.columns).alias("row"), _draw().alias("draw"), member.alias("m")).select("row", "draw", F.col("m.p").alias("p"))
    times = F.floor(F.round(rate_column(steps), 6) + F.col("draw")).cast("int")
    return rated.withColumn("times", times).where("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
