"""Recordings and clips that use known material: fingerprint matches of audio and video, and one finding per item.

Audio: errors at every offset come from the correlation of bit planes, worked out by FFT for a piece of the query and a window of the reference
(n log n instead of n squared). Windows overlap so that every offset of a piece lies whole in one of them. A query of one piece is decided where
it meets a window, and only matches leave the task. A longer one can only match where one of its pieces is below the error rate by itself (else
the sum is above it), so all other pairs of recordings end there too; partial counts per offset are written for what is left.

Video: a clip of n frames that needs t matches must meet a reference on the n - t + 1 of its frames that the fewest references have. Candidates
come from those frames only; frames that everything shares (black, titles) never pair clips with references by themselves. Before that, clips of
few frames of which n - t + 1, whichever they are, have no near reference hash at all are put aside: most clips match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candorframe.operators.hamming import hamming_pairs, may_have_near
from candorframe.operators.ordering import prefix_scan
from candorframe.session import durable

C = F.col

# The video and audio reuse rules.
VIDEO_MATCH_BITS, VIDEO_MIN_FRAMES, VIDEO_MIN_SHARE = 8, 4, 0.5
AUDIO_MATCH_BER, AUDIO_MIN_OVERLAP, AUDIO_SHORTEST = 0.30, 100, 20

#: Clips of at most so many frames are first asked for any near reference hash.
SHORT_CLIP = 64

#: Frames of a query piece; a reference window has twice as many.
PIECE = 1_024
#: Pieces and windows that meet in one task, and how many of each are transformed at a time.
TILE_PIECES, TILE_WINDOWS, SLICE = 512, 2_048, 32


def bit_planes(bits: list[np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    """(length / 2 + 1, rows, 32): Fourier transforms of the 32 bit planes as +1 and -1, with 0 where a row has no frame."""
    planes = np.zeros((len(bits), 32, length), np.float32)
    for row, (values, start) in enumerate(zip(bits, starts)):
        on = (values[None, :].astype(np.int64) >> np.arange(32)[:, None]) & 1
        planes[row, :, start : start + len(values)] = 2 * on - 1
    return np.ascontiguousarray(np.fft.rfft(planes, axis=2).astype(np.complex64).transpose(2, 0, 1))


def offset_errors(q: np.ndarray, r: np.ndarray, frames: np.ndarray, piece: int) -> np.ndarray:
    """(pieces, windows, offsets): bit errors for the piece laid on the window from each of its first ``piece`` frames."""
    agree = np.fft.irfft(np.matmul(q.conj(), r.transpose(0, 2, 1)), n=2 * piece, axis=0)[:piece].transpose(1, 2, 0)
    return np.rint((32 * frames - agree) / 2).astype(np.int64)


def overlaps(sizes: np.ndarray, first: np.ndarray, last: np.ndarray, piece: int) -> np.ndarray:
    """(pieces, windows, offsets): frames that a piece of the given size shares with a window whose frames run from ``first`` to ``last``."""
    at = np.arange(piece)
    return np.clip(np.minimum(at + sizes[:, None, None], last[None, :, None]) - np.maximum(at, first[None, :, None]), 0, None)


def _frames(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint32) for b in column.to_pylist()]


def _window(start: np.ndarray, n: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Places inside a window that starts at ``start`` at which its recording begins and ends."""
    return np.where(start < 0, piece, 0), np.minimum(2 * piece, n - start)


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, n, bits): the frames of each (key, start, n) in order, as one binary of unsigned 32-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("f").flatten().field("bits").to_numpy().astype(np.uint32)
            ends = np.concatenate([[0], np.cumsum(batch.column("f").value_lengths().to_numpy())])
            bits = [values[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "start", "n")), pa.array(bits, pa.binary())], names=[key, "start", "n", "bits"])

    lists = rows.groupBy(key, "start", "n").agg(F.sort_array(F.collect_list(F.struct("idx", "bits"))).alias("f"))  # at most two pieces long
    return lists.mapInArrow(run, f"{key} bigint, start bigint, n bigint, bits binary")


def _copies(df: DataFrame, key: str) -> DataFrame:
    """(key, rep, n): recordings of enough frames, with the smallest one of the same frames (told apart by two 64-bit sums)."""
    frame = F.xxhash64("idx", "bits")
    marks = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(frame).alias("x"), F.sum(F.shiftright(F.xxhash64(frame, F.lit(1)), 20)).alias("s")).where(C("n") >= AUDIO_SHORTEST)
    return marks.join(marks.groupBy("n", "x", "s").agg(F.min(key).alias("rep")), ["n", "x", "s"]).select(key, "rep", "n")


def audio_fingerprint_match(query: DataFrame, index: DataFrame, piece: int = PIECE, tile: tuple[int, int] = (TILE_PIECES, TILE_WINDOWS)) -> DataFrame:
    """(query_id, ref_id, ber): the lowest bit error rate over all frame offsets with enough overlap, where it is at most 0.30.

    Input: query_id, idx, bits; ref_id, idx, bits with dense idx from 0 and 32-bit values. No exact key exists at a 30 % error rate, so every piece
    of a query meets every window of the references, in tiles of bounded size; copies of a recording meet once. What leaves a tile grows with the
    matches, not with the pairs.
    """
    q_of, r_of = durable(_copies(query, "query_id")), durable(_copies(index, "ref_id"))  # one row a recording
    one = lambda of, key: of.where(C(key) == C("rep")).select(key, "n")
    long_blocks = F.expr(f"idx div {piece}")
    q_rows = query.join(one(q_of, "query_id"), "query_id").withColumn("start", long_blocks * piece)
    r_rows = index.join(one(r_of, "ref_id"), "ref_id").withColumn("start", F.explode(F.array((long_blocks - 1) * piece, long_blocks * piece)))
    pieces = _packed(q_rows.select("query_id", "start", "n", "idx", "bits"), "query_id")
    windows = _packed(r_rows.select("ref_id", "start", "n", "idx", "bits"), "ref_id")

    def parts(of: DataFrame, key: str, most: int) -> int:
        total = one(of, key).agg(F.sum(F.ceil(C("n") / piece) + (0 if key == "query_id" else 1))).first()[0] or 0
        return max(1, -(-int(total) // most))

    gq, gr = parts(q_of, "query_id", tile[0]), parts(r_of, "ref_id", tile[1])

    def dealt(df: DataFrame, key: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        home = F.pmod(F.xxhash64(key, "start"), F.lit(n)).cast("int")
        return df.select("*", home.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for a in range(0, q.num_rows if r.num_rows else 0, SLICE):
            some = q.slice(a, SLICE)
            q_bits, q_id, q_n = _frames(some.column("bits")), some.column("query_id").to_numpy(), some.column("n").to_numpy()
            sizes = np.array([len(b) for b in q_bits])
            left = bit_planes(q_bits, np.zeros(len(q_bits), int), 2 * piece)
            for b in range(0, r.num_rows, SLICE):
                other = r.slice(b, SLICE)
                r_id, r_n, start = (other.column(c).to_numpy() for c in ("ref_id", "n", "start"))
                first, last = _window(start, r_n, piece)
                frames = overlaps(sizes, first, last, piece)
                errors = offset_errors(left, bit_planes(_frames(other.column("bits")), first, 2 * piece), frames, piece)
                least = np.where((q_n > piece)[:, None], 1, np.minimum(AUDIO_MIN_OVERLAP, np.minimum(q_n[:, None], r_n[None, :])))
                rate = np.where(frames >= least[:, :, None], errors / (32.0 * np.maximum(frames, 1)), 2.0).min(axis=2)
                for i, j in zip(*np.nonzero(rate <= AUDIO_MATCH_BER)):
                    out.append((q_id[i], r_id[j], rate[i, j] if q_n[i] <= piece else None))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["q", "r", "ber"])

    tiles = dealt(pieces, "query_id", "h", gq, "g", gr).groupBy("h", "g").cogroup(dealt(windows, "ref_id", "g", gr, "h", gq).groupBy("h", "g"))
    found = tiles.applyInArrow(meet, "q bigint, r bigint, ber double")
    if one(q_of, "query_id").where(C("n") > piece).isEmpty():
        best = found.groupBy("q", "r").agg(F.min("ber").alias("ber"))
    else:
        met = found.groupBy("q", "r").agg(F.min("ber").alias("ber"))
        best = met.where("ber IS NOT NULL").unionByName(_long_matches(met.where("ber IS NULL").select("q", "r"), pieces, windows, piece))
    named = best.join(q_of.select("query_id", C("rep").alias("q")), "q").join(r_of.select("ref_id", C("rep").alias("r")), "r")
    return named.select("query_id", "ref_id", "ber")


def _long_matches(pairs: DataFrame, pieces: DataFrame, windows: DataFrame, piece: int) -> DataFrame:
    """(q, r, ber) of the pairs whose query has several pieces: counts of all pieces by offset, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                q_bits, q_start, r_start, r_n = _frames(batch.column("q_bits")), *(batch.column(c).to_numpy() for c in ("q_start", "r_start", "r_n"))
                first, last = _window(r_start, r_n, piece)
                for i, bits in enumerate(q_bits):
                    frames = overlaps(np.array([len(bits)]), first[i : i + 1], last[i : i + 1], piece)
                    left = bit_planes([bits], np.zeros(1, int), 2 * piece)
                    errors = offset_errors(left, bit_planes(_frames(batch.column("r_bits").slice(i, 1)), first[i : i + 1], 2 * piece), frames, piece)
                    hit = np.flatnonzero(frames[0, 0])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(hit), batch.column("q")[i].as_py())), pa.array(np.full(len(hit), batch.column("r")[i].as_py())),
                            pa.array(hit + r_start[i] - q_start[i]), pa.array(errors[0, 0][hit]), pa.array(frames[0, 0][hit]),
                        ],
                        names=["q", "r", "off", "e", "f"],
                    )

    q = pieces.select(C("query_id").alias("q"), C("start").alias("q_start"), C("n").alias("q_n"), C("bits").alias("q_bits"))
    r = windows.select(C("ref_id").alias("r"), C("start").alias("r_start"), C("n").alias("r_n"), C("bits").alias("r_bits"))
    sizes = pairs.join(q.select("q", "q_n").distinct(), "q").join(r.select("r", "r_n").distinct(), "r")
    met = pairs.join(q, "q").join(r, "r").select("q", "r", "q_start", "r_start", "r_n", "q_bits", "r_bits")
    summed = met.mapInArrow(run, "q bigint, r bigint, off bigint, e bigint, f bigint").groupBy("q", "r", "off").agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    enough = summed.join(sizes, ["q", "r"]).where(C("f") >= F.least(F.lit(AUDIO_MIN_OVERLAP), C("q_n"), C("r_n")))
    return enough.groupBy("q", "r").agg(F.min(C("e") / (C("f") * 32.0)).alias("ber")).where(C("ber") <= AUDIO_MATCH_BER)


def _worth_matching(query: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """The frames of ``query`` without the clips that cannot match: those of at most ``SHORT_CLIP`` frames none of whose first n - need + 1 frames
    (in the order of the hashes) has a reference hash within the distance."""
    frames = query.where("hash IS NOT NULL").select("clip_id", "hash").join(sizes, "clip_id")
    at = F.row_number().over(Window.partitionBy("clip_id").orderBy("hash"))  # clips of a bounded number of frames
    asked = frames.where(C("n") <= SHORT_CLIP).withColumn("_at", at).where(C("_at") <= C("n") - C("need") + 1).select("clip_id", "hash")
    clips = asked.join(may_have_near(asked, index, VIDEO_MATCH_BITS), "hash").select("clip_id").distinct()
    clips = durable(clips.unionByName(sizes.where(C("n") > SHORT_CLIP).select("clip_id")))
    return query.join(clips, "clip_id", "left_semi")


def video_fingerprint_match(query: DataFrame, index: DataFrame) -> DataFrame:
    """(clip_id, ref_id, frames_matched): at least four and at least half of the clip's frames have a reference hash within eight bits.

    Input: clip_id, frame_idx, hash; ref_id, hash. Frames are counted per (clip, hash) before any join.
    """
    sizes = query.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).where(C("n") >= VIDEO_MIN_FRAMES)
    sizes = sizes.withColumn("need", F.greatest(F.lit(VIDEO_MIN_FRAMES).cast("bigint"), F.ceil(VIDEO_MIN_SHARE * C("n"))))
    query = durable(_worth_matching(query, index, sizes))
    sizes = sizes.join(query.select("clip_id").distinct(), "clip_id", "left_semi")
    per_hash = query.groupBy("clip_id", "hash").agg(F.count(F.lit(1)).alias("c"))
    refs = index.where("hash IS NOT NULL").select("ref_id", C("hash").alias("hash_b")).distinct()
    pairs = durable(hamming_pairs(query, index, VIDEO_MATCH_BITS).select(C("hash_a").alias("hash"), "hash_b"))
    held = pairs.join(refs.groupBy("hash_b").agg(F.count(F.lit(1)).alias("d")), "hash_b").groupBy("hash").agg(F.sum("d").alias("d"))
    # A match leaves at most n - need frames unmatched, so one of the n - need + 1 rarest frames must match; frames without any reference are rarest.
    ranked = per_hash.join(held, "hash", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    ranked = prefix_scan(ranked, ["clip_id"], ["d", "hash"], sums={"before": C("c")}).join(sizes, "clip_id")
    rare = ranked.where((C("before") <= C("n") - C("need")) & (C("d") > 0)).select("clip_id", "hash")
    reached = pairs.join(refs, "hash_b").select("hash", "ref_id").distinct()
    candidates = rare.join(reached, "hash").select("clip_id", "ref_id").distinct()
    hits = candidates.join(per_hash, "clip_id").join(reached, ["hash", "ref_id"]).groupBy("clip_id", "ref_id").agg(F.sum("c").alias("frames_matched"))
    return hits.join(sizes, "clip_id").where(C("frames_matched") >= C("need")).select("clip_id", "ref_id", "frames_matched")


def _findings(frames: DataFrame, item: str, shortest: int, index: DataFrame, matches: DataFrame, strength: str) -> DataFrame:
    """One finding per item: how many frames it has, how many references match, and the first of them (smallest ref_id) with its strength."""
    sizes = frames.groupBy(item).agg(F.count("*").alias("frames"))
    found = matches.groupBy(item).agg(F.count("*").alias("matches"), F.min("ref_id").alias("first_ref"), F.min_by(strength, "ref_id").alias(strength))
    loaded = index.agg(F.count(F.lit(1)) > 0).scalar()
    out = sizes.join(found, item, "left").withColumn("_loaded", loaded)
    short = C("frames") < shortest
    return out.select(
        item,
        F.when(short, "NOT_APPLICABLE").when(C("matches") > 0, "WARN").otherwise("INFO").alias("status"),
        F.when(~short & (C("matches") > 0), "MEDIUM").otherwise("NONE").alias("severity"),
        "frames", F.coalesce("matches", F.lit(0)).alias("matches"), "first_ref", strength,
        F.when(short, "too short to fingerprint").when(~C("_loaded"), "no reference index").alias("note"),
    )


def audio_findings(query: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, status, severity, frames, matches, first_ref, ber, note): WARN with matches, INFO without, a note without an index; recordings of fewer
    than 20 frames are NOT_APPLICABLE. Input as ``audio_fingerprint_match``; a recording without frames has one row with NULL bits."""
    real = query.where("bits IS NOT NULL")
    out = _findings(real, "query_id", AUDIO_SHORTEST, index, audio_fingerprint_match(real, index), "ber")
    return _with_empty(query, "query_id", "bits", out)


def video_findings(query: DataFrame, index: DataFrame) -> DataFrame:
    """(clip_id, status, severity, frames, matches, first_ref, frames_matched, note): as ``audio_findings``, for clips of at least four frames; a clip
    without frames has one row with NULL hash."""
    real = query.where("hash IS NOT NULL")
    out = _findings(real, "clip_id", VIDEO_MIN_FRAMES, index, video_fingerprint_match(real, index), "frames_matched")
    return _with_empty(query, "clip_id", "hash", out)


def _with_empty(query: DataFrame, item: str, value: str, out: DataFrame) -> DataFrame:
    bare = query.groupBy(item).agg(F.count(value).alias("_n")).where("_n = 0").select(item)
    nothing = {"status": F.lit("NOT_APPLICABLE"), "severity": F.lit("NONE"), "frames": F.lit(0).cast("bigint"), "matches": F.lit(0).cast("bigint"), "note": F.lit("too short to fingerprint")}
    return out.unionByName(bare.withColumns(nothing), allowMissingColumns=True)
