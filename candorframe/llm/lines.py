"""Content and boilerplate lines by a linear-chain conditional random field, and documents kept by their share of content.

A line with a word is one step of a chain with two states. A line's state scores are a linear function of what can be seen in it (marks, case,
digits, repeats, length), neighbouring states have scores of their own, and Viterbi decoding gives the most likely states of a whole text.

The weights are fitted by maximum likelihood on a bounded sample of labelled documents: lines of good documents are content; lines of low ones are
boilerplate, save those that a first fit without transitions takes for content (low documents hold good lines too). A step of the fit is one pass
over the staged sample: tasks run forward-backward over their texts and return one gradient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import WordHash, drop_stage, mix64, stage, texts, wide_rows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: About how many labelled documents the field is fitted on (never more than twice as many), steps of each of the two fits, ridge, parts of the sample.
FIT_ROWS, STEPS, RIDGE, FIT_PARTS = 4_000, 15, 1e-3, 16
#: Least share of the word characters on content lines in a document that is kept.
LEAST = 0.5
FEATURES = 20
BLANKS, DIGITS, UPPER = b" \t\n\x0b\x0c\r", b"0123456789", bytes(range(65, 91))
CONTENT, BOILERPLATE = 0, 1


def line_features(line: bytes, ws: list[bytes], repeated: bool) -> list[float]:
    """What a line shows, each about in [0, 1]; the last is constant."""
    n, size = len(ws), len(line)
    symbols, digits, upper = (size - len(line.translate(None, of)) for of in (SYMBOLS, DIGITS, UPPER))
    again = sum(map(bytes.__eq__, ws, ws[1:])) / n
    distinct = len(set(ws)) / n
    letters = sum(map(len, ws))
    ends = line.rstrip()[-1:]
    return [
        min(symbols / letters, 1.0), float(symbols * 10 > letters), line.count(b"|") / n if n > 1 else 0.0, min(digits / letters, 1.0), float(digits * 3 > letters),
        upper / letters, float(upper * 2 > letters), min(line.count(b"!") / n, 2.0) / 2, float(b"!!" in line), again, float(again > 0.3), 1 - distinct,
        float(n > 8 and distinct < 0.5), float(repeated), float(ends in (b".", b"!", b"?", b":")), float(n < 4), min(n, 200) / 200, min(letters / n, 30) / 30,
        float(b"http" in line or b"@" in line), 1.0,
    ]


def text_lines(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(features of each line with a word, characters in its words, how many equal an earlier line)."""
    rows, chars, seen, dup = [], [], set(), 0
    for line in text.split(b"\n"):
        ws = line.split()
        if not ws:
            continue
        repeated = line in seen
        seen.add(line)
        dup += repeated
        rows.append(line_features(line, ws, repeated))
        chars.append(word_chars(line))
    return np.array(rows, np.float32).reshape(-1, FEATURES), np.array(chars, np.int64), dup


def word_chars(text: bytes) -> int:
    """Code points in words: all bytes but blanks and those that go on a code point."""
    bare = text.translate(None, BLANKS)
    return len(bare) - int(np.count_nonzero((np.frombuffer(bare, np.uint8) & 0xC0) == 0x80))


def repeat_words(h: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more, the first included; windows are told apart by 64-bit hashes."""
    if len(h) <= WINDOW:
        return 0
    n = len(h) - WINDOW + 1
    whole = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        whole = mix64(whole ^ h[k : k + n]) + np.uint64(k)
    _, of, count = np.unique(whole, return_inverse=True, return_counts=True)
    step = np.zeros(len(h) + 1, np.int64)
    hit = np.flatnonzero(count[of] > 1)
    step[hit] += 1
    step[hit + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(step[:-1])))


class Chains:
    """Texts of unlike length side by side: step t of all that have one, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[self.order] if len(lengths) else np.empty(0, np.int64)
        self.lengths = lengths[self.order]
        self.longest = int(self.lengths[0]) if len(lengths) else 0

    def at(self, t: int) -> np.ndarray:
        """Places of the t-th lines; those of later steps are a prefix of the texts."""
        return self.start[: np.searchsorted(-self.lengths, -t, side="left")] + t


@dataclass(frozen=True)
class Field:
    """``weights`` (features, 2) and ``step`` (state before, state)."""

    weights: np.ndarray
    step: np.ndarray

    def states(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely states of the lines of texts of the given lengths (Viterbi); of equals content."""
        score = x @ self.weights
        chains, back = Chains(lengths), np.zeros(score.shape, np.int8)
        best = score.copy()
        for t in range(1, chains.longest):
            now = chains.at(t)
            ways = best[now - 1][:, :, None] + self.step
            back[now] = ways.argmax(axis=1)
            best[now] += ways.max(axis=1)
        out = np.zeros(len(score), np.int8)
        ends = chains.start + chains.lengths - 1
        out[ends] = best[ends].argmax(axis=1)
        for t in range(chains.longest - 1, 0, -1):
            now = chains.at(t)
            out[now - 1] = back[now, out[now]]
        return out

    def likelihood(self, x: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood of the states ``gold``, its gradients by weights and by steps) of texts with at least one line each (forward-backward)."""
        score, chains = x @ self.weights, Chains(lengths)
        ahead, behind = score.copy(), np.zeros(score.shape)
        for t in range(1, chains.longest):
            now = chains.at(t)
            ahead[now] += np.logaddexp.reduce(ahead[now - 1][:, :, None] + self.step, axis=1)
        for t in range(chains.longest - 1, 0, -1):
            now = chains.at(t)
            behind[now - 1] = np.logaddexp.reduce(self.step + (score + behind)[now][:, None, :], axis=2)
        ends = chains.start + chains.lengths - 1
        total = np.empty(len(lengths))
        total[chains.order] = np.logaddexp.reduce(ahead[ends], axis=1)
        of = np.repeat(total, lengths)
        share = np.exp(ahead + behind - of[:, None])
        truth = np.eye(2)[gold]
        inner = np.ones(len(score), bool)
        inner[chains.start] = False
        now = np.flatnonzero(inner)
        pair = np.exp(ahead[now - 1][:, :, None] + self.step + (score + behind)[now][:, None, :] - of[now][:, None, None]).sum(axis=0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[now - 1], gold[now]), 1.0)
        value = (score * truth).sum() + (seen * self.step).sum() - total.sum()
        return float(value), x.T @ (truth - share), seen - pair


def ascend(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """The maximum of a concave function by limited-memory BFGS with halved steps."""
    value, slope = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(np.abs(way).sum(), 1e-12)
        for (s, y), a in zip(pairs, reversed(kept)):
            way += s * (a - (y @ way) / (s @ y))
        length = 1.0
        while length > 1e-6:
            then, then_slope = value_and_slope(x + length * way)
            if then >= value + 1e-4 * length * (way @ slope):
                break
            length /= 2
        else:
            return x
        s, y = length * way, slope - then_slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        gain, x, value, slope = then - value, x + s, then, then_slope
        if gain < 1e-6 * abs(value):
            break
    return x


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(good, x): line features of about ``fit_rows`` labelled documents, staged; the same ones in every run.

    Labels of one doc_id that disagree, or are null, are left out; of texts that share a doc_id the one of smallest hash is taken.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r")
    known = known.select("doc_id", (F.col("q") > 0).alias("good"))
    share = min(1.0, fit_rows / max(known.count(), 1))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_lines(t)[0] for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array([f.tobytes() for f in x], pa.binary())], names=["good", "x"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(few), "doc_id").where("text IS NOT NULL")  # at most 2 * fit_rows
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "good")).alias("s")).select("s.text", "s.good")
    return stage(one.repartition(FIT_PARTS, F.xxhash64("text")).mapInArrow(run, "good boolean, x binary").where("length(x) > 0"), "lines")


def _gradient(rows: DataFrame, field: Field, gold: Callable[[np.ndarray, bool], np.ndarray], step: bool) -> tuple[float, np.ndarray]:
    """Log-likelihood of all rows and its gradient: one small row per partition of the sample."""
    size = FEATURES * 2 + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            xs = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in batch.column("x").to_pylist()]
            want = np.concatenate([gold(x, g) for x, g in zip(xs, batch.column("good").to_pylist())])
            lengths, x = np.array(list(map(len, xs))), np.concatenate(xs).astype(float)
            value, w, s = field.likelihood(x, lengths, want)
            total += np.concatenate([w.ravel(), s.ravel() * step, [value, len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    got = np.sum(np.sort(np.stack([np.frombuffer(bytes(r["g"])) for r in rows.mapInArrow(run, "g binary").collect()]), axis=0), axis=0)  # FIT_PARTS rows or fewer
    flat = np.concatenate([field.weights.ravel(), field.step.ravel()])
    lines = max(got[-1], 1.0)
    return got[-2] / lines - RIDGE * (flat @ flat) / 2, got[:-2] / lines - RIDGE * flat


def _fit(rows: DataFrame, gold: Callable[[np.ndarray, bool], np.ndarray], step: bool, steps: int) -> Field:
    as_field = lambda f: Field(f[: FEATURES * 2].reshape(FEATURES, 2), f[FEATURES * 2 :].reshape(2, 2))
    return as_field(ascend(lambda f: _gradient(rows, as_field(f), gold, step), np.zeros(FEATURES * 2 + 4), steps))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, steps: int = STEPS) -> Field:
    """The field fitted on labelled documents (``labels``: doc_id, quality above 0 for good). Without any usable label every line is content."""
    wide_rows(docs.sparkSession)
    rows = sample(docs, labels, fit_rows)
    if rows.isEmpty():
        return Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    alone = _fit(rows, lambda x, good: np.full(len(x), CONTENT if good else BOILERPLATE), False, steps)
    looks = lambda x: (x.astype(float) @ alone.weights).argmax(axis=1)
    field = _fit(rows, lambda x, good: np.full(len(x), CONTENT) if good else looks(x), True, steps)
    drop_stage(rows)
    return field


COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "content_chars": "bigint", "content": "array<boolean>"}


def label_lines(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text among its columns) and, per row: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word equal to an earlier line), n_repeat_words (words in windows of 8 words that the text holds twice or more), content_chars (code points in words
    of content lines) and content (one flag per line with a word). Columns of ``keep`` with these names are left out."""
    wide_rows(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COLUMNS]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in COLUMNS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            xs, sizes, flat = [], [], []
            for t in texts(batch.column("_text")):
                t = t or b""
                ws = t.split()
                x, chars, dup = text_lines(t)
                flat.append((len(ws), int(chars.sum()), len(t) - len(t.translate(None, SYMBOLS)), dup, repeat_words(hashes.of(ws))))
                xs.append(x)
                sizes.append(chars)
            lengths = np.array(list(map(len, xs)), np.int64)
            full = np.flatnonzero(lengths)
            state = field.states(np.concatenate(xs).astype(float), lengths[full]) if len(full) else np.empty(0, np.int8)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            good = state == CONTENT
            chars = np.concatenate([[0], np.cumsum(np.concatenate(sizes) * good)]) if len(sizes) else np.zeros(1, np.int64)
            base = np.array(flat, np.int64).reshape(-1, 5)
            flags = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(base[:, k]) for k in range(5)), pa.array(chars[ends[1:]] - chars[ends[:-1]]), flags], names=[*keep, *COLUMNS]
            )

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(run, ", ".join(kinds))


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, the columns of ``label_lines``, base_failed, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows. Kept unless that, when content lines hold at least ``least`` of
    the word characters. Null, empty and blank texts have no words and fail. Rows are judged by their text alone, so repeated rows and null ids do not
    matter; an empty table gives an empty result. Texts count whole, however long. Without usable labels every line is content.
    """
    field = fit(docs, labels, fit_rows)
    out = label_lines(docs.select("doc_id", "text"), field, ["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_chars") >= least * F.col("word_chars")))


def content_only(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with the text of its content lines, blank lines between them as they were; null stays null."""
    wide_rows(docs.sparkSession)

    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in texts(column):
            if not t or not t.strip():
                out.append(None if t is None else t.decode())
                continue
            x, _, _ = text_lines(t)
            good = iter(field.states(x.astype(float), np.array([len(x)])) == CONTENT)
            out.append(b"\n".join([line for line in t.split(b"\n") if not line.split() or next(good)]).decode())
        return pa.array(out, pa.string())

    return docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text").cast("string")))
