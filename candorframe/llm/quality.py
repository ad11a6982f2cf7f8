"""A quality classifier from weak labels.

Heuristic labellers look at a text and vote good, bad or nothing. How far each can be trusted is not given: expectation-maximisation estimates, from
their agreements over the whole corpus, how often a labeller votes what on good and on bad texts, and from that the posterior of every text. The
posteriors are the labels of a linear scorer over hashed character trigrams and repeats, which is what decides: it sees every text whole, also where all
labellers keep silent.

The estimation runs on counts of vote patterns, at most 3 ** labellers of them whatever the corpus. The scorer is fitted on at most about FIT_ROWS
texts chosen by hash, which bounds the training; votes, estimates and decisions cover all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import let_go, stage, texts, wide_rows

FIT_ROWS = 12_000
BUCKETS = 1_024
#: Least probability of a good text that is kept.
LEAST = 0.5
#: Most of the good texts that a labeller may call bad.
FALSE_ALARM = 0.002
SEED = 5

# Common function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it was for on are as with at by an be this der die und das ist zu den mit von ein eine nicht auf für im dem "
    "le la les et de du des en un une est que pour dans il au ce qui el los las y es por con se del al lo como".encode().split()
)
_ALNUM = bytes(c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128)
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _vote(good: bool, bad: bool) -> int:
    return 1 if good else 2 if bad else 0


def votes(text: bytes) -> tuple[int, ...]:
    """Each labeller's vote: 0 silent, 1 good, 2 bad."""
    ws = text.split()
    n = len(ws)
    if n < 3:
        return (0,) * LABELLERS
    chars = len(text.translate(None, _SPACE))
    symbols = len(text.translate(None, _ALNUM + _SPACE)) / chars
    bare = sum(1 for w in ws if not w.strip(_PUNCT)) / n
    ends = sum(1 for w in ws if len(w) > 2 and w[-1] in _MARKS and w[-2] in _MARKS) / n
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = (len(text) - len(text.translate(None, _UPPER))) / max(letters, 1)
    known = sum(map(FUNCTION_WORDS.__contains__, [w.lower() for w in ws])) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(len(lines), 1)
    varied = len(set(ws)) / n
    length = chars / n
    again = sum(map(bytes.__eq__, ws, ws[1:])) / n
    return (
        _vote(symbols < 0.10, symbols > 0.16),
        _vote(bare < 0.02, bare > 0.15),
        _vote(ends < 0.02, ends > 0.2),
        _vote(upper < 0.2, upper > 0.5),
        _vote(known > 0.15, n >= 20 and known < 0.03),
        _vote(len(lines) > 3 and repeated < 0.05, len(lines) > 3 and repeated > 0.3),
        _vote(n >= 50 and varied > 0.3, n >= 50 and varied < 0.12),
        _vote(3.0 <= length <= 8.0, length < 2.0 or length > 12.0),
        _vote(again < 0.03, again > 0.2),
    )


LABELLERS = 9
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MARKS = frozenset(c for c in _PUNCT if c not in b"\"')")


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and for each labeller the probability of its votes by class (bad, good), given that it votes."""

    good: float
    table: np.ndarray  # labeller, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        logs = np.log(self.table)[np.arange(LABELLERS), :, patterns].sum(axis=1) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Of what a labeller says, the share that is right."""
        prior = np.array([1 - self.good, self.good])
        joint = self.table * prior[None, :, None]
        return (joint[:, 1, 1] + joint[:, 0, 2]) / np.maximum(joint[:, :, 1:].sum(axis=(1, 2)), 1e-12)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation; labellers are independent given the class, each with a vote table per class.

    There are several ways to be bad, which two classes cannot tell apart: left alone, the estimate spends its second class on the commonest way
    and calls the others good. So it starts from bad votes weighing more than good ones, and holds FALSE_ALARM as the most that a labeller
    calls good texts bad.
    """
    said = (patterns == 1).sum(axis=1) - 4.0 * (patterns == 2).sum(axis=1)
    p = 1 / (1 + np.exp(-said))
    model = LabelModel(0.5, np.full((LABELLERS, 2, 3), 1 / 3))
    for _ in range(rounds):
        mass = np.stack([(1 - p) * counts, p * counts])
        table = np.stack([[[mass[c][patterns[:, j] == v].sum() + 0.5 for v in range(3)] for c in range(2)] for j in range(LABELLERS)])
        table[:, :, 1:] /= table[:, :, 1:].sum(axis=2, keepdims=True)
        table[:, :, 0] = 1  # silence says nothing
        over = np.maximum(table[:, 1, 2] - FALSE_ALARM, 0)
        table[:, 1, 1] += over
        table[:, 1, 2] -= over
        fresh = LabelModel(float((mass[1].sum() + 1) / (counts.sum() + 2)), table)
        p = fresh.posterior(patterns)
        moved = np.abs(fresh.table - model.table).max()
        model = fresh
        if moved < 1e-9:
            break
    return model


def buckets(joined: np.ndarray) -> np.ndarray:
    """The hash bucket of the byte trigram at each place."""
    a = joined.astype(np.uint32)
    return (((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2_654_435_761)) >> np.uint32(32 - 10)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    let_go()
    return (t or b"" for t in texts(column))


def _patterns(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(LABELLERS)) % 3


def vote_codes(text: pa.Array) -> pa.Array:
    """The votes as one number in base three; null for a text without words."""
    power = [3**j for j in range(LABELLERS)]
    return pa.array([sum(v * p for v, p in zip(votes(t), power)) if t.strip() else None for t in _texts(text)], pa.int32())


def repeats(text: bytes) -> tuple[float, float, float]:
    """Share of words equal to the word before, of lines that came before, and of words that came before."""
    ws, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(len(ws), 1)
    return sum(map(bytes.__eq__, ws, ws[1:])) / n, 1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(ws)) / n


def features(text: pa.Array) -> pa.Array:
    """Share of each bucket among a text's trigrams, and its repeats."""
    out = []
    for t in _texts(text):
        b = buckets(np.frombuffer(b" " + t + b" ", np.uint8))
        out.append(np.append(np.bincount(b, minlength=BUCKETS) / len(b), repeats(t)).astype(np.float32))
    return pa.array(out, pa.list_(pa.float32()))


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    intercept: float
    labels: LabelModel

    def column(self):
        """The probability of a good text, null without words: the mean of its trigrams' weights, and its repeats times theirs."""
        weights, intercept = self.weights, self.intercept

        def run(text: pa.Array) -> pa.Array:
            out = []
            for t in _texts(text):
                if not t.strip():
                    out.append(None)
                    continue
                s = weights[buckets(np.frombuffer(b" " + t + b" ", np.uint8))].mean() + weights[BUCKETS:] @ repeats(t) + intercept
                out.append(1 / (1 + np.exp(-np.clip(s, -700, 700))))
            return pa.array(out, pa.float64())

        return F.arrow_udf(run, "double")(F.col("text").cast("string"))

    def posterior_column(self):
        labels = self.labels

        def run(text: pa.Array) -> pa.Array:
            code = vote_codes(text)
            p = labels.posterior(_patterns(code.fill_null(0).to_numpy().astype(np.int64)))
            return pa.array(p, pa.float64(), mask=code.is_null().to_numpy(zero_copy_only=False))

        return F.arrow_udf(run, "double")(F.col("text").cast("string"))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """Estimates the labellers over all texts of ``docs`` (doc_id, text) and fits the scorer on about ``fit_rows`` of them."""
    from pyspark.ml.classification import LogisticRegression  # not for the workers
    from pyspark.ml.functions import array_to_vector

    wide_rows(docs.sparkSession)
    text = F.col("text").cast("string")
    vote_code, shares = F.arrow_udf(vote_codes, "int"), F.arrow_udf(features, "array<float>")
    seen = docs.select(vote_code(text).alias("code")).where("code IS NOT NULL").groupBy("code").count().orderBy("code").toPandas()
    if not len(seen):
        return Scorer(np.zeros(BUCKETS + 3), 0.0, LabelModel(0.5, np.full((LABELLERS, 2, 3), 1 / 3)))
    patterns, counts = _patterns(seen["code"].to_numpy(np.int64)), seen["count"].to_numpy(float)
    model = estimate(patterns, counts)
    share = min(1.0, fit_rows / counts.sum())
    picked = docs.where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * fit_rows)
    known = stage(
        picked.select(vote_code(text).alias("code"), shares(text).alias("shares")).where("code IS NOT NULL"), "quality"
    )
    table = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(seen["code"], model.posterior(patterns))], "code int, p double")
    rows = known.join(F.broadcast(table), "code").select(  # at most 3 ** LABELLERS rows
        array_to_vector(F.col("shares").cast("array<double>")).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("y")
    ).select("features", "y.label", "y.w").where("w > 0.001")
    if rows.select("label").distinct().count() < 2:
        return Scorer(np.zeros(BUCKETS + 3), 8.0 if model.good >= 0.5 else -8.0, model)
    got = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=40, standardization=True).fit(rows)
    return Scorer(got.coefficients.toArray(), float(got.intercept), model)


def classify(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, posterior, score, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``posterior`` is the label model's probability of a good text, ``score`` the scorer's; kept when score >= ``least``. Null, empty and blank texts
    have null posterior and score and are not kept. Rows are judged by their text alone, so repeated rows and null ids do not matter. Without any
    words in the table nothing is kept; if the labellers see only one class, every text gets it. Texts count whole.
    """
    scorer = fit(docs)
    out = docs.select("doc_id", scorer.posterior_column().alias("posterior"), scorer.column().alias("score"))
    return out.withColumn("kept", F.coalesce(F.col("score") >= least, F.lit(False)))


def keep_good(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``."""
    scorer = fit(docs)
    return docs.where(F.coalesce(scorer.column() >= least, F.lit(False)))
