"""Packing of tokenised documents into sequences by non-negative least squares over length patterns.

Everything that decides is a function of the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus: among all patterns
of up to six length classes that fill a sequence, non-negative least squares finds those to use and how often, the counts are rounded
down and given real lengths, and what is left over goes best-fit first into the gaps and into new sequences. The plan says, for every length,
which run of its pieces goes to which slot, so that a piece finds its place from its rank among pieces of its length. That rank is a count
per input chunk plus the total of the chunks before it: no sort of the corpus, and no group is gathered.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.llm.common import left, stage, texts, wide_rows

CAPACITY = 4096
#: Lengths are put into this many classes for the fit.
CLASSES = 192
#: Most documents of a pattern.
PARTS = 6
SLICE = 500
#: Words of each of a worker's two memos, some 200 bytes each; they only save time. An executor of two cores has up to four workers.
MEMO_WORDS = 174_000
#: Flags for words met once, a byte each.
MET = 1 << 21
#: Signs that the pre-tokenizer parts from the letters before them, and takes as one run.
SIGNS = b"!#$%&*,.:;?"


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens(dict):
    """Token ids (little-endian unsigned 32-bit) of words between ASCII white space, which this tokenizer never joins.

    A word's ids do not depend on its neighbours: the pre-tokenizer drops white space and no rule reaches across it. ASCII capitals are lower-cased
    first, as the normaliser does. Words of Latin letters are single pre-tokens and go straight to the model; ``SIGNS`` after them are a pre-token of
    their own; all other words take the whole way.
    A full memo becomes the older one, from which words come back when they are met again, so rare words do not push out the common ones. From then
    on a new word is kept when it is met a second time: most words of a corpus are met once, and keeping them would take most of the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.older: dict[bytes, bytes] = {}
        self.met = bytearray(MET)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else chr(next(spare)) for b in range(256)]

    def __missing__(self, word: bytes) -> bytes:
        known = self.older.get(word)
        if known is not None:
            return self._keep(word, known)
        stem = word.rstrip(SIGNS)
        text = stem.decode()
        if not (text.isalpha() and (stem.isascii() or (max(text) < "ɐ" and unicodedata.is_normalized("NFC", text) and "İ" not in text))):
            ids = _as_bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        elif len(stem) < len(word):
            ids = self[stem] + self[word[len(stem) :]]
        else:
            seen = "".join(map(self.letters.__getitem__, text.lower().encode())) if not stem.isascii() else text
            ids = _as_bytes([t.id for t in self.model.tokenize(seen)])
        return self._keep(word, ids)

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        if self.older and word not in self.older:
            at = hash(word) & (MET - 1)
            if not self.met[at]:
                self.met[at] = 1
                return ids
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
            self.met = bytearray(MET)
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))


def word_tokens(path: str) -> WordTokens:
    """One for all tasks of a worker process, until it goes on to another operator: reading the tokenizer and learning the common words again would cost every task."""
    return left(f"tokens {path}", lambda: WordTokens(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, chunk, nth): each document's ids and ``end_id``, cut into pieces of at most ``capacity`` ids.

    ``nth`` counts the pieces of one length within a chunk (an input partition).
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, chunk = word_tokens(tokenizer), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text"))):
                    ids = (memo.of(text) if text else b"") + end
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), chunk, seen[size]))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    wide_rows(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk bigint, nth bigint")


def best_pattern(worth: np.ndarray, full: int, parts: int) -> tuple[np.ndarray, float]:
    """(how often each class is in it, worth for its length as a column) of the most worthy pattern of at most ``parts`` classes that add up to ``full``.

    ``worth[c]`` is that of class c. One table per number of parts: the most worth that fills each size exactly.
    """
    sizes = np.arange(full + 1)
    table, last = [np.where(sizes == 0, 0.0, -np.inf)], []
    spread = np.full((full + 1, full + 1), -np.inf)  # [size, class]
    for _ in range(parts):
        spread[:] = -np.inf
        for c in range(1, full + 1):
            spread[c:, c] = table[-1][: full + 1 - c] + worth[c]
        last.append(spread.argmax(axis=1))
        table.append(spread[sizes, last[-1]])
    best, found = -np.inf, np.zeros(full + 1)
    for k in range(1, parts + 1):
        if np.isfinite(table[k][full]):
            column, size = np.zeros(full + 1), full
            for step in range(k, 0, -1):
                c = last[step - 1][size]
                column[c] += 1
                size -= c
            value = table[k][full] / np.sqrt((column**2).sum())
            if value > best:
                best, found = value, column
    return found, best


def fit_patterns(target: np.ndarray, weight: np.ndarray, parts: int = PARTS, rounds: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): non-negative least squares of ``target`` (pieces per class) over all patterns of at most ``parts`` classes that fill a sequence.

    The active-set method needs the column of steepest gradient only: it is found among all patterns by dynamic programming, so they are never
    written out. A pattern whose repeats turn negative leaves.
    """
    full = len(target) - 1
    goal = target * weight
    columns, x = np.zeros((0, full + 1)), np.zeros(0)
    floor = 1e-6 * max(np.abs(goal).max(), 1e-300)
    before = np.inf
    for _ in range(rounds):
        rest = goal - (x @ columns) * weight
        column, slope = best_pattern(np.append([-np.inf], (rest * weight)[1:]), full, parts)
        size = float(rest @ rest)
        if slope <= floor or (len(columns) and (columns == column).all(axis=1).any()) or size > before * (1 - 1e-6):
            break
        before = size
        columns, x = np.vstack([columns, column]), np.append(x, 0.0)
        while True:
            a = columns * weight
            gram = a @ a.T
            best = np.linalg.solve(gram + 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram)), a @ goal)
            if (best > 0).all():
                x = best
                break
            low = best <= 0
            step = (x[low] / np.maximum(x[low] - best[low], 1e-300)).min()
            x = x + step * (best - x)
            stay = x > 1e-12 * max(x.max(), 1.0)
            if stay.all():
                stay[int(best.argmin())] = False
            columns, x = columns[stay], x[stay]
            if not len(x):
                break
    return columns, x


def plan(histogram: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces in a sequence, number of such sequences), for ``histogram[length]`` pieces of each length up to ``capacity``.

    Works on counts: its cost depends on the number of lengths, not on the number of pieces. If best fit alone needs fewer sequences, it is taken.
    """
    fitted, alone = _packed(histogram, capacity, classes, PARTS), _packed(histogram, capacity, classes, 0)
    return min(fitted, alone, key=lambda made: sum(times for _, times in made))


def _packed(histogram: np.ndarray, capacity: int, classes: int, parts_: int) -> list[tuple[tuple[int, ...], int]]:
    left = histogram.astype(np.int64).copy()
    classes = min(classes, capacity)
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    of = -(-np.arange(capacity + 1) // width)  # the class of a length: its own, rounded up
    target = np.bincount(of, weights=left, minlength=classes + 1)[: classes + 1]
    target[0] = 0
    # Short pieces fill gaps later, so missing one of them costs little.
    weight = np.where(np.arange(classes + 1) * 8 < classes, 0.1, 1.0)
    patterns, repeats = fit_patterns(target, weight, parts_) if parts_ and target.any() else (np.zeros((0, classes + 1)), np.zeros(0))
    repeats = np.floor(repeats + 1e-6).astype(np.int64)

    # The larger parts of a pattern take the longest pieces of their classes; the smallest takes the piece that fills the rest best, which
    # makes up for the rounding to classes.
    def longest(low: int, high: int, chosen: list[int]) -> int:
        for n in range(high, low - 1, -1):
            if left[n] > chosen.count(n):
                return n
        return 0

    open_: dict[int, list[list]] = defaultdict(list)  # free ids: [lengths, number of sequences]
    for pattern, count in zip(patterns[repeats > 0], repeats[repeats > 0]):
        parts = [c for c in range(classes, 0, -1) for _ in range(int(pattern[c]))]
        while count > 0:
            chosen: list[int] = []
            for k, c in enumerate(parts):
                rest = capacity - sum(chosen)
                last = k == len(parts) - 1 and k > 0
                n = longest((c - 1) * width + 1, rest if last else min(c * width, rest), chosen)
                if not n:
                    break
                chosen.append(n)
            if len(chosen) < len(parts):
                break
            times = min(int(count), *[int(left[n]) // chosen.count(n) for n in chosen])
            for n in chosen:
                left[n] -= times
            count -= times
            open_[capacity - sum(chosen)].append([tuple(chosen), times])

    free = np.zeros(capacity + 1, bool)
    free[[f for f, groups in open_.items() if groups]] = True
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo > 0:
            gaps = np.flatnonzero(free[n:])
            if len(gaps):
                gap = n + int(gaps[0])
                lengths, times = open_[gap].pop()
                free[gap] = bool(open_[gap])
                used = min(todo, times)
                if used < times:
                    open_[gap].append([lengths, times - used])
                    free[gap] = True
                made = lengths + (n,)
                gap -= n
            else:  # a new sequence takes as many of this length as fit
                per = min(capacity // n, todo)
                used = todo // per
                made, gap = (n,) * per, capacity - n * per
                todo -= used * (per - 1)
            open_[gap].append([made, used])
            free[gap] = True
            todo -= used
    return [(lengths, times) for groups in open_.values() for lengths, times in groups]


def slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first rank): pieces of rank first.. of a length go to sequence + (rank - first), at offset."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in made:
        at = 0
        for n in lengths:
            rows.append((n, taken[n], sequence, at))
            taken[n] += times
            at += n
        sequence += times
    rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": rows[:, 0], "first": rows[:, 1], "sequence": rows[:, 2], "offset": rows[:, 3]}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each goes to.

    Input: doc_id, text (other columns are ignored). Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences are
    filled without gaps from offset 0. A null or empty text is the end token alone. Repeated rows, also with equal or null doc_ids, are packed
    each for itself. Texts longer than a sequence are the only ones cut. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_chunk = cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    base = stage(per_chunk.select("length", "chunk", "n", F.coalesce(before, F.lit(0)).alias("base")), "bases")

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.column("b").to_pylist():
                row = np.zeros(capacity + 1, np.int64)
                row[[x["length"] for x in b]] = [x["base"] for x in b]
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], names=["chunk", "bases"])

    # One row per chunk: pieces of each length in the chunks before.
    bases = stage(base.groupBy("chunk").agg(F.collect_list(F.struct("length", "base")).alias("b")).mapInArrow(by_length, "chunk bigint, bases array<bigint>"), "bases")
    counts = base.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counts["length"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    table = slots(plan(histogram, capacity), capacity) if len(counts) else slots([], capacity)
    sent = spark.sparkContext.broadcast(table)  # bounded by the number of lengths, not by the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        runs = (t["length"] << 48) + t["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            key = np.searchsorted(runs, (length << 48) + rank, side="right") - 1
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(t["sequence"][key] + rank - t["first"][key]), pa.array(t["offset"][key])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(bases, "chunk").withColumn("rank", F.get("bases", F.col("length").cast("int")) + F.col("nth")).drop("bases", "nth", "chunk")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)
