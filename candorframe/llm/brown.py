"""Scoring with a class-based bigram model.

Words are put into classes by exchange clustering: a word moves to the class in which the bigrams around it are likeliest, round after round.
The probability of a text is the product, over its words and its end, of the transition from the class before to the class of the word and of the
emission of the word by its class; both are smoothed by adding one.

What is clustered are the commonest words, and the others by their endings: every word, seen or not, belongs to one of a fixed number of items,
so the classes, the transitions and the exchange have bounded size, while all counts come from the whole training corpus: transitions from every bigram,
emissions from the exact count of every word. Counts of words that are not common are joined by hash, never sent to the driver.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import signed, stage, texts, wide_rows, words

#: Commonest words that are items of their own; items of other words, by their last two letters.
HEAD, ENDINGS = 6_144, 2_048
MEMO = 150_000
CLASSES, ROUNDS = 64, 6
#: Words whose counts every task holds; the others' counts are joined.
CACHED = 100_000
MODULUS, HELD_OUT = 7, 2


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and binascii.crc32(str(doc_id).encode()) % MODULUS == HELD_OUT


class WordIds(dict):
    """Ids of words, remembered while they fit: 53 bits of a hash, and in the low bits the item of the word's ending."""

    def __missing__(self, word: bytes) -> int:
        ending = binascii.crc32(word.rstrip(b".,;:!?\"')")[-2:]) % ENDINGS
        n = xxhash.xxh3_64_intdigest(word) // ENDINGS * ENDINGS + ending
        if len(self) < MEMO:
            self[word] = n
        return n

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


#: The text's end, and its start for transitions, are items after the others.
END = HEAD + ENDINGS
ITEMS = END + 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[bytes]]]:
    return ((d, words(t)) for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))))


def _source(docs: DataFrame) -> DataFrame:
    wide_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its id, occurs in the training documents; the end of a text is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 2_500):
                got = [memo.of(ws) for d, ws in _texts(batch.slice(at, 2_500)) if ws and not is_held_out(d)]
                if got:
                    u, n = np.unique(np.concatenate(got), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], names=["word", "n"])

    return _source(docs).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Head:
    """The commonest words: sorted hashes with counts; the first HEAD of them are items."""

    word: np.ndarray
    count: np.ndarray
    item: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known here, place) of hashes."""
        at = np.minimum(np.searchsorted(self.word, h), max(len(self.word) - 1, 0))
        return (self.word[at] == h if len(self.word) else np.zeros(len(h), bool)), at

    def items(self, h: np.ndarray, hit: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = self.item[at] if len(self.word) else np.full(len(h), -1)
        return np.where(hit & (own >= 0), own, HEAD + (h % np.uint64(ENDINGS)).astype(np.int64))


def head(counts: DataFrame) -> Head:
    """The CACHED commonest words, ties by hash."""
    rows = counts.orderBy(F.desc("n"), "word").limit(CACHED).select("word", "n").toPandas()
    h, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    item = np.where(np.arange(len(h)) < HEAD, np.arange(len(h)), -1)
    order = np.argsort(h)
    return Head(h[order], n[order], item[order])


def item_bigrams(docs: DataFrame, common: Head) -> DataFrame:
    """(a, b, n): how often item b follows item a in the training documents; a text begins after END and ends with it."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, common_, held, size = WordIds(), sent.value, [], 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code // ITEMS).astype(np.int32)), pa.array((code % ITEMS).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for d, ws in _texts(batch):
                if is_held_out(d):
                    continue
                h = memo.of(ws)
                way = np.concatenate([[END], common_.items(h, *common_.find(h)), [END]]).astype(np.int64)
                held.append(way[:-1] * ITEMS + way[1:])
                size += len(way)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    parts = _source(docs).mapInArrow(run, "a int, b int, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(bigrams: DataFrame, frequency: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each item, class transition counts, mutual information by round).

    Begins with the items dealt to classes by frequency. In a round Spark sums, for every item, its bigrams by the class of the neighbour, and
    blocks of items find their best class; half of the items may move, by turns, so that two that attract each other do not swap for ever. The best round counts.
    END has the last class to itself.
    """
    import pandas as pd  # not for the other workers

    spark = bigrams.sparkSession
    own = np.full(ITEMS, classes - 1, np.int64)
    own[np.argsort(-frequency[:END], kind="stable")] = np.arange(END) % (classes - 1)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    gains: list[float] = []
    for turn in range(rounds + 1):
        table = F.broadcast(spark.createDataFrame(pd.DataFrame({"item": np.arange(ITEMS), "c": own}), "item int, c int"))  # ITEMS rows
        near = bigrams.join(table.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(table.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b")
        after = near.groupBy(F.col("a").alias("item"), F.col("cb").alias("c")).agg(F.sum("n").alias("n")).withColumn("after", F.lit(True))
        before = near.groupBy(F.col("b").alias("item"), F.col("ca").alias("c")).agg(F.sum("n").alias("n")).withColumn("after", F.lit(False))
        sums = stage(after.unionByName(before), "exchange")
        cells = sums.where("after").join(table.withColumnRenamed("c", "ca"), "item").groupBy("ca", "c").agg(F.sum("n").alias("n")).toPandas()
        matrix = np.zeros((classes, classes))
        matrix[cells["ca"].to_numpy(int), cells["c"].to_numpy(int)] = cells["n"].to_numpy(float)
        total, left, right = matrix.sum(), matrix.sum(axis=1), matrix.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = float(np.nansum(matrix / total * np.log(matrix * total / np.outer(left, right)))) if total else 0.0
        gains.append(gain)
        if best is None or gain > best[0]:
            best = (gain, own.copy(), matrix)
        if turn == rounds or not total:
            break
        # How likely a neighbour of each class is, relative to chance, given that the item is in a class.
        smooth = matrix + 0.5
        lift = np.log(smooth * smooth.sum() / np.outer(smooth.sum(axis=1), smooth.sum(axis=0)))

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            item, row = np.unique(pdf["item"].to_numpy(), return_inverse=True)
            seen = np.zeros((2, len(item), classes))
            np.add.at(seen, (pdf["after"].to_numpy().astype(int), row, pdf["c"].to_numpy()), pdf["n"].to_numpy())
            score = seen[1] @ lift.T + seen[0] @ lift
            return pd.DataFrame({"item": item, "c": score[:, : classes - 1].argmax(axis=1)})

        block = F.pmod(F.xxhash64("item"), F.lit(64))
        moved = sums.where(F.col("item") != END).where(F.pmod(F.xxhash64("item", F.lit(turn % 2)), F.lit(4)) != turn % 4).groupBy(block).applyInPandas(choose, "item int, c int").toPandas()
        own[moved["item"].to_numpy(int)] = moved["c"].to_numpy(int)
    return best[1], best[2], gains


@dataclass(frozen=True)
class Model:
    common: Head
    own: np.ndarray  # class of each item
    step: np.ndarray  # log10 of class transitions
    mass: np.ndarray  # log10 of a class's emission total
    texts: int
    tokens: int  # the base's N and V, ends included
    types: int


def learn(docs: DataFrame, counts: DataFrame) -> Model:
    """The model of the training documents. ``counts``: word_counts of them."""
    import pandas as pd

    common = head(counts)
    learnt = docs.where(~_held_out()).count()
    bigrams = stage(item_bigrams(docs, common), "bigrams")
    item = F.coalesce("own", F.pmod("word", F.lit(ENDINGS)).cast("int") + HEAD)
    mine = docs.sparkSession.createDataFrame(pd.DataFrame({"word": common.word.view(np.int64)[common.item >= 0], "own": common.item[common.item >= 0]}), "word bigint, own int")
    held = counts.join(F.broadcast(mine), "word", "left").groupBy(item.alias("item")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toPandas()  # at most ITEMS rows
    frequency, types = np.zeros(ITEMS), np.zeros(ITEMS)
    frequency[held["item"].to_numpy(int)], types[held["item"].to_numpy(int)] = held["n"], held["types"]
    frequency[END], types[END] = learnt, 1 if learnt else 0
    own, matrix, _ = exchange(bigrams, frequency)
    step = np.log10((matrix + 1) / (matrix.sum(axis=1, keepdims=True) + CLASSES))
    mass = np.log10(np.bincount(own, frequency, CLASSES) + np.bincount(own, types, CLASSES) + 1)
    return Model(common, own, step, mass, learnt, int(frequency.sum()), int(types.sum()))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % MODULUS == HELD_OUT, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Learns from the documents whose crc32 of the id, as text, leaves another remainder by 7 than 2; a null id is learnt from. Tokens are the words
    and one end, so a null or empty text has one. ``base_score`` is the add-one unigram score, ``score`` the model's, both log10. Rows that
    repeat are texts of their own. Without training documents every token is unseen. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = stage(word_counts(docs), "words")
    model = learn(docs, counts)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m, part, row = WordIds(), sent.value, TaskContext.get().partitionId(), 0
        log_count = np.log10(m.common.count + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for d, ws in _texts(batch.slice(at, 500)):
                    h = memo.of(ws)
                    hit, place = m.common.find(h)
                    way = np.concatenate([[END], m.common.items(h, hit, place), [END]]).astype(np.int64)
                    c = m.own[way]
                    moves = m.step[c[:-1], c[1:]].sum() - m.mass[c[1:]].sum()
                    rare, times = np.unique(h[~hit], return_counts=True)
                    out.append(((part << 33) + row, d, is_held_out(d), len(ws) + 1, int(hit.sum()), float(log_count[place[hit]].sum()), float(moves), signed(rare), times))
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "moves", "rare", "times"]
    kinds = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, moves double, rare array<bigint>, times array<bigint>"
    scored = stage(_source(docs).mapInArrow(run, kinds), "scores")
    # Rare words meet their counts by hash; a word that is not found was never seen and adds the logarithm of one.
    asked = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = asked.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    end_log = float(np.log10(model.texts + 1.0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end_log
    unit = float(np.log10(model.tokens + model.types + 1.0))
    known = F.col("known") + F.coalesce("more", F.lit(0)) + (1 if model.texts else 0)
    return scored.drop("rare", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * unit).alias("base_score"), (logs + F.col("moves")).alias("score"),
    )
