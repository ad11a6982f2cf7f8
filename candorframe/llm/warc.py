"""A deterministic, sharded WARC writer, and its reader.

Pages are range-sorted by page_id into shards. The shard borders come from an exact histogram of payload bytes over page_id, refined where a
range is heavy, so they depend on the pages alone, not on how the table is split. A task writes the shards it holds, one record at a time: each
record is a gzip member of its own with headers and digests made anew, and a file is closed when its compressed size reaches the limit. Files
appear under temporary names and are moved to their final names when whole; each task reports its files, the reports form the manifest, and the
manifest is moved to its final name last. A reader trusts the manifest only, so leftovers of lost tasks are never read; running a task again
writes the same bytes.

Equal payloads of at least ``least`` bytes are stored once: the largest page_id holds the response, the others are revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorframe.llm.common import new_folder, stage, wide_rows

LEAST = 1000
SHARD_BYTES = 256 << 20
FILE_BYTES = 64 << 20
#: Ranges a histogram round looks at.
CELLS = 4096
DATE = "2000-01-01T00:00:00Z"


def shard_borders(pages: DataFrame, shard_bytes: int) -> list[float]:
    """Page ids at which a new shard begins. ``pages``: page_id, payload_bytes. At most one border per ``shard_bytes`` of payload and one per CELLS.

    A range is cut into CELLS equal parts; parts heavier than a shard are cut again until they hold one id.
    """
    size = F.col("payload_bytes") + 1
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    todo, cells = [(low, high)], []
    while todo:
        parts = []
        for lo, hi in todo:
            width = -(-(hi - lo + 1) // CELLS)
            inside = pages.where(F.col("page_id").between(lo, hi))
            rows = inside.groupBy(F.expr(f"(page_id - {lo}L) div {width}L").alias("cell")).agg(F.sum(size).alias("bytes")).collect()
            parts += [(lo + r["cell"] * width, min(lo + (r["cell"] + 1) * width - 1, hi), r["bytes"]) for r in rows]
        todo = [(lo, hi) for lo, hi, n in parts if n > shard_bytes and hi > lo]
        cells += [(lo, n) for lo, hi, n in parts if n <= shard_bytes or hi == lo]
    borders, held = [], 0
    for lo, n in sorted(cells):
        if held and held + n > shard_bytes:
            borders.append(float(lo))
            held = 0
        held += n
    return borders


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): what is to be written. The largest page_id of equal payloads is found from
    digests alone; the page rows meet it by digest, which skew-join handling may split when one payload is common."""
    src = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")
    ).select("page_id", "url", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("_same"))
    large = src.where(F.col("payload_bytes") >= least)
    twice = large.groupBy("_same").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    # Kept as a table, so that Spark knows its size and moves it to the pages instead of the pages to it while it is small.
    joined = src.join(stage(twice.select("_same", "_first"), "copies"), "_same", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(F.col("_first").isNotNull(), refers).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member. Line ends and other control characters of a url are percent-encoded."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class _Files:
    """Rolls files of one shard by compressed size, each under a temporary name until it is whole."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.limit, self.out, self.done = file_bytes, None, []

    def write(self, shard: int, page_id: int | None, data: bytes) -> None:
        if self.out and (self.shard != shard or self.size + len(data) > self.limit):
            self.close()
        if not self.out:
            number = self.number + 1 if self.done and self.shard == shard else 0
            self.shard, self.number, self.size, self.count, self.sha, self.first = shard, number, 0, 0, hashlib.sha256(), page_id
            self.name = f"part-{shard:06d}-{number:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(data)
        self.sha.update(data)
        self.size, self.count, self.last = self.size + len(data), self.count + 1, page_id

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.out = None
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.count, self.size, self.sha.hexdigest(), self.first, self.last))


MANIFEST = "file string, shard bigint, records bigint, bytes bigint, sha256 string, first_page bigint, last_page bigint"


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; other columns are ignored) below ``folder`` and returns the manifest, one row per file.

    A null html is an empty payload; a null url gets an urn; a null page_id is written without its header and comes first. Rows that repeat the
    largest page_id of a payload all stay responses. An empty table gives an empty manifest. Writing the same pages again gives the same files.
    """
    from pyspark.ml.feature import Bucketizer  # not for the workers

    spark = pages.sparkSession
    wide_rows(spark)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    sizes = stage(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("bigint").alias("payload_bytes")), "sizes")
    borders = shard_borders(sizes, shard_bytes)
    rows = planned(pages, least)
    if borders:
        cut = Bucketizer(splits=[-float("inf"), *borders, float("inf")], inputCol="_id", outputCol="_shard")
        rows = cut.transform(rows.withColumn("_id", F.coalesce(F.col("page_id"), F.lit(-(2**62))).cast("double"))).drop("_id")
    else:
        rows = rows.withColumn("_shard", F.lit(0.0))
    rows = rows.withColumn("_shard", F.col("_shard").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, file_bytes)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for shard, page, url, payload, digest, refers in zip(*(part.column(c).to_pylist() for c in ("_shard", "page_id", "url", "payload", "digest", "refers_to"))):
                    files.write(shard, page, record(page, url, payload, digest, refers))
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "records", "bytes", "sha256", "first_page", "last_page"), f)) for f in files.done])

    dealt = rows.repartition(len(borders) + 1, "_shard").sortWithinPartitions("_shard", F.asc_nulls_first("page_id"), "digest", "url")
    manifest = stage(dealt.mapInArrow(run, MANIFEST), "manifest")
    commit(manifest, folder)
    return manifest


def commit(manifest: DataFrame, folder: str) -> None:
    """Puts the manifest in its place by one move. It holds a line for each file: a few hundred bytes per ``file_bytes`` of archive, streamed."""
    fs, root = pafs.FileSystem.from_uri(folder)
    temp = f"{root}/_temporary/manifest.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        for r in manifest.orderBy("file").toLocalIterator():
            out.write(json.dumps(r.asDict(), sort_keys=True).encode() + b"\n")
    fs.move(temp, f"{root}/manifest.jsonl")
    fs.delete_dir(f"{root}/_temporary")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    held, box = b"", zlib.decompressobj(31)
    out: list[bytes] = []
    while True:
        data = held or stream.read(1 << 20)
        if not data:
            if out:
                raise ValueError("the archive ends inside a record")
            return
        out.append(box.decompress(data))
        held = box.unused_data
        if box.eof:
            yield b"".join(out)
            out, box = [], zlib.decompressobj(31)


def parse(raw: bytes) -> dict:
    """A record's fields; its digests are checked against its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    return {
        "page_id": number["X-Page-Id"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number["X-Refers-To-Page-Id"],
        "record_id": fields["WARC-Record-ID"], "target_uri": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
    }


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, target_uri string, file string"


def read_archives(spark: SparkSession, folder: str, *, payload: bool = False) -> DataFrame:
    """One row per record of the files that the manifest of ``folder`` names; ``payload`` adds the responses' bytes. Files are streamed."""
    lines = spark.read.schema("file string").json(f"{folder}/manifest.jsonl")
    names = [*(c.split()[0] for c in RECORD.split(", ")), *["payload"] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for raw in _members(stream):
                        row = parse(raw) | {"file": name}
                        rows.append([row[n] for n in names])
                        held += len(raw) if payload else 500
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = max(1, min(lines.count(), 16 * spark.sparkContext.defaultParallelism))
    return lines.repartition(n, "file").mapInArrow(run, RECORD + ", payload binary" * payload)


def round_trip(pages: DataFrame, *, least: int = LEAST, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives to a new folder of the shared place and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, least=least, shard_bytes=shard_bytes, file_bytes=file_bytes)
    return read_archives(pages.sparkSession, folder)
