"""What the operators of this folder share: reading tables, durable cut points, words."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from candorframe.session import checkpoint_root

#: Entries a worker's word memo may hold. It only saves time: what is not in it is worked out again.
MEMO_WORDS = 120_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    return (spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)).rstrip("/")


def wide_rows(spark: SparkSession, rows: int = 1_000) -> None:
    """Lowers the session's rows per Arrow batch to at most ``rows``: a text or a page is a wide row, and a batch is held in memory whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files, so that lost executors cost no rework and the plan stays short."""
    spark, schema = df.sparkSession, df.schema
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a staged frame that nothing reads any more."""
    p, fs = _path(df.sparkSession, df._stage_path)
    fs.delete(p, True)


def free(spark: SparkSession) -> None:
    """Collects the driver's garbage. Spark keeps shuffle files and broadcasts of finished jobs until then, and over many short jobs the heap would grow to its limit."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.Array, rows: int = 500) -> Iterator[bytes | None]:
    """The texts of a column in UTF-8, taken out of it a slice at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.large_binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; none for a null text. Bytes split at exactly these characters."""
    return text.lower().split() if text else []


#: What tasks of a worker process leave for the next ones, by name: one thing at a time.
_LEFT: dict[str, object] = {}


def left(name: str, make: Callable[[], object]) -> object:
    """What earlier tasks of this worker process made under ``name``, or a new one. It takes the place of what another operator left."""
    if name not in _LEFT:
        let_go()
        _LEFT[name] = make()
    return _LEFT[name]


def let_go() -> None:
    """Drops what another operator's tasks left in this worker process: Spark goes on with the same workers, and up to two a core would hold it in vain."""
    _LEFT.clear()


class WordHash(dict):
    """64-bit hashes of words, remembered while they fit. Who begins one has no use for what others left."""

    def __init__(self) -> None:
        super().__init__()
        let_go()

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix64(a: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def signed(a: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark holds."""
    return np.ascontiguousarray(a).view(np.int64)
