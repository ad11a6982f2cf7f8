"""Where media tables come from: folders, index and block-list files, annotation tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candorframe.functions.bytesniff import extension
from candorframe.functions.textscan import blocklist_entry
from candorframe.session import shared_folder
from candorframe.sources import sha256

C = F.col

#: Bytes of a file that one task digests whole, and of a larger one that a task goes on with.
WHOLE = PIECE = 128 << 20
#: Spark's line reader would decompress these.
_SQUEEZED = [".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst"]
_BOM = b"\xef\xbb\xbf"


def scan_media(spark: SparkSession, roots: list[str], extensions: list[str], recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, size_bytes, modified[, content]) of every file under the roots with one of the extensions. The bytes are read only on request."""
    wanted = _files(spark, roots, extensions, recursive)
    cols = [C("path"), C("length").alias("size_bytes"), C("modificationTime").alias("modified")]
    return wanted.select(*cols, *(["content"] if content else []))


def _files(spark: SparkSession, roots: list[str], extensions: list[str], recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
    return files.where(extension(C("path")).isin([e.lower() for e in extensions]))


def file_digests(spark: SparkSession, roots: list[str], extensions: list[str], recursive: bool = True, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """(path, size_bytes, modified, sha256) of every file that ``scan_media`` lists, whatever its size.

    A digest goes through its file in order, but no task does: files of more than ``whole`` bytes are read block by block, and in round k one task a file
    goes on with the digest's state over the next ``piece`` bytes. Blocks are cut by Spark's partition size and end with the line that crosses their end, so
    a line of any length stays in one task. Compressed files (by their names) are taken whole.
    """
    # Conditions on a file's metadata alone leave out files before any is read.
    ending = extension(F.url_decode(F.replace(C("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    cut = (C("_metadata.file_size") > whole) & ~ending.isin(_SQUEEZED)
    key, wanted = C("_metadata.file_path").alias("key"), _files(spark, roots, extensions, recursive)
    cols = [C("path"), C("length").alias("size_bytes"), C("modificationTime").alias("modified")]
    small = wanted.where(~cut).select(*cols, F.sha2("content", 256).alias("sha256"))
    large = wanted.where(cut).select(*cols, key)
    files = large.count()
    if not files:
        return small
    lines = spark.read.format("text").option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").load(roots)
    of_large = lines.where(cut & ending.isin([e.lower() for e in extensions]))
    blocks = of_large.select(key, C("_metadata.file_size").alias("size"), C("_metadata.file_block_start").alias("at"), C("value").cast("binary").alias("line"))
    if not sha256.resumable():  # then one task has to go through a file
        piece = 1 << 62
    folder = shared_folder(spark, "pieces")
    blocks.mapInArrow(_lines_joined, _PARTS).withColumn("round", F.floor(C("at") / piece)).write.option("compression", "none").partitionBy("round").parquet(folder)
    parts = spark.read.schema(f"{_PARTS}, round bigint").parquet(folder)
    # The line reader leaves out a byte order mark, and a line break is put after the last line in any case.
    read = parts.groupBy("key", "size").agg(F.sum("n").alias("n")).withColumn("short", C("size") - C("n"))
    if (odd := read.where("short NOT IN (-1, 0, 2, 3)").first()) or read.count() < files:
        raise OSError(f"not read as listed: {odd.key if odd else roots}")
    states = read.where("short > 0").select("key", "size", F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("part"), F.lit(bytearray(sha256.after(_BOM))).alias("bytes"))
    for k in range(parts.agg(F.max("round")).first()[0] + 1):
        now = parts.where(C("round") == k).select(states.columns).unionByName(states)
        to = shared_folder(spark, "digests")
        now.repartition(files, "key").sortWithinPartitions("key", "at", "part").mapInArrow(_folded, f"{_STATE}, sha256 string").write.parquet(to)
        done = spark.read.schema(f"{_STATE}, sha256 string").parquet(to)
        states = done.drop("sha256")
    return small.unionByName(large.join(done.select("key", "sha256"), "key").select(small.columns))


_STATE = "key string, size bigint, at bigint, part int, bytes binary"
_PARTS = f"{_STATE}, n bigint"


def _lines_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each block, line breaks put back, in parts of an Arrow batch. Spark gives a block's lines in a row and in order."""
    last, part = None, 0
    for batch in batches:
        key, at = batch.column("key"), batch.column("at").to_numpy()
        names = key.dictionary_encode().indices.to_numpy()
        ends = [*(np.flatnonzero((np.diff(at) != 0) | (np.diff(names) != 0)) + 1), batch.num_rows]
        for a, b in zip([0, *ends], ends):
            if a == b:
                continue
            now = (key[a].as_py(), int(at[a]))
            last, part = now, part + 1 if now == last else 0
            data = b"\n".join(batch.column("line").slice(a, b - a).to_pylist()) + b"\n"
            row = (now[0], batch.column("size")[a].as_py(), now[1], part, data, len(data))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["key", "size", "at", "part", "bytes", "n"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's state after the rows of this round, and the digest when all of its bytes are in."""

    def row(key: str, size: int, digest: sha256.Sha256) -> pa.RecordBatch:
        values = (key, size, -1, 0, digest.state(), digest.hexdigest() if digest.count == size else None)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["key", "size", "at", "part", "bytes", "sha256"])

    file, digest = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            now, at, data = (batch.column("key")[i].as_py(), batch.column("size")[i].as_py()), batch.column("at")[i].as_py(), batch.column("bytes")[i].as_py()
            if now != file:
                if file:
                    yield row(*file, digest)
                file, digest = now, sha256.Sha256(data if at < 0 else None)
            if at >= 0:
                digest.update(data[: now[1] - digest.count])
    if file:
        yield row(*file, digest)


def truth_from_folder(path: Column) -> Column:
    """1 below ``ai_generated/``, 0 below ``real/``, NULL elsewhere."""
    folder = F.regexp_extract(path, r"/(ai_generated|real)/", 1)
    return F.when(folder == "ai_generated", 1).when(folder == "real", 0)


def scan_labelled_folders(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, size_bytes, truth) from the two label folders; finding no file is an error."""
    found = scan_media(spark, [root], extensions).withColumn("truth", truth_from_folder(C("path"))).where("truth IS NOT NULL")
    if not found.take(1):
        raise ValueError(f"no supported file in {root}/ai_generated or {root}/real")
    return found.select("path", "size_bytes", "truth")


def parse_reference_lines(lines: DataFrame, schema: str, required: list[str], line: str = "value") -> DataFrame:
    """Rows of a JSON-lines index; a blank, unparseable or incomplete line is left out."""
    row = F.from_json(F.trim(C(line)), schema, {"mode": "PERMISSIVE"})
    parsed = lines.where(F.trim(C(line)) != "").select(row.alias("r")).select("r.*")
    for c in required:
        parsed = parsed.where(C(c).isNotNull())
    return parsed


def read_reference_index(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    return parse_reference_lines(spark.read.text(path), schema, required)


def read_hash_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sha256 of a text block list."""
    return spark.read.text(path).select(blocklist_entry(C("value")).alias("sha256")).where("sha256 IS NOT NULL").distinct()


ANNOTATIONS = (
    "img_name string, age int, face_x0 int, face_y0 int, face_x1 int, face_y1 int, person_x0 int, person_y0 int, person_x1 int, person_y1 int"
)


def clean_annotations(rows: DataFrame) -> DataFrame:
    """Rows with an age and a face box; -1 in the person box means there is none."""
    known = rows.where((C("age") != -1) & (C("face_x0") != -1))
    person = {c: F.when(C("person_x0") != -1, C(c)) for c in ("person_y0", "person_x1", "person_y1")}
    return known.withColumns(person).withColumn("person_x0", F.nullif(C("person_x0"), F.lit(-1))).withColumn(
        "img_name", F.regexp_extract("img_name", r"([^/\\]+)$", 1)
    )


def read_annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_annotations(spark.read.option("header", True).option("enforceSchema", False).schema(ANNOTATIONS).csv(path))


def read_sample_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.parquet(path).select(*columns)
