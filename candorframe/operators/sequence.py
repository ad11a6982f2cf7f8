"""Frames, segments, spans and windows on a timeline.

A clip is addressed by a dense frame number, so ``frame_idx div CHUNK`` cuts it into bounded pieces and neighbours are carried across the
cuts (see ``ordering.prefix_scan``): a clip that holds a third of all frames is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.operators.ordering import CHUNK, exact_quantiles, prefix_scan

C = F.col
AI_LABEL = "LIKELY AI-GENERATED"

# Motion, flicker, cadence, combing and hum limits.
MOTION = {"high_var": 140.0, "suspicious_var": 75.0, "freeze_var": 0.8, "high_mean": 32.0, "suspicious_mean": 22.0, "freeze_mean": 1.2}
BLANK_VARIANCE = 5.0
FLICKER_RATIO, FLICKER_JUMP = 0.65, 3.5
CADENCE = {"min_frames": 20, "still": 0.5, "repeat": 0.15, "heavy": 0.40, "cut_factor": 4.0, "cut_min": 20.0, "regular": 0.8}
COMB_RATIO, COMB_MOTION = 1.0, 0.3
HUM = {"snr": 6.0, "present": 0.60, "tone": 0.003, "erratic": 0.30, "jump": 0.15}


def cut(index: str, size: int = CHUNK) -> Column:
    return F.expr(f"CAST({index} AS BIGINT) div {size}")


def frame_deltas(frames: DataFrame, value: str, chunk: int = CHUNK) -> DataFrame:
    """Each frame with the value and index of the frame before it in its clip (NULL for the first)."""
    return prefix_scan(
        frames, ["clip_id"], ["frame_idx"], last={"prev_value": C(value), "prev_idx": C("frame_idx")}, chunk=cut("frame_idx", chunk)
    )


def motion_variance(frames: DataFrame, step: int = 1, limits: dict[str, float] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Mean and variance of the change between successive non-blank frames, and the warping risk. Input: clip_id, frame_idx, luminance,
    gray_variance. Fewer than three changes is not measured (NULL)."""
    t = {**MOTION, **(limits or {})}
    clips = frames.select("clip_id").distinct()
    kept = frames.where(C("gray_variance") >= BLANK_VARIANCE)
    d = frame_deltas(kept, "luminance", chunk).select("clip_id", (F.abs(C("luminance") - C("prev_value")) / max(1, step) ** 0.5).alias("d"))
    agg = d.groupBy("clip_id").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v"))
    n, m, v = C("n"), C("m"), C("v")
    risk = (
        F.when((v > t["high_var"]) | ((m > t["high_mean"]) & (v > t["high_var"] * 4.0 / 7.0)), "HIGH_WARPING_DETECTED")
        .when((v > t["suspicious_var"]) | (m > t["suspicious_mean"]), "SUSPICIOUS_FLICKER")
        .when(F.lit(step <= 2) & (v < t["freeze_var"]) & (m < t["freeze_mean"]), "UNNATURAL_FREEZE")
        .otherwise("LOW")
    )
    ok = F.coalesce(n >= 3, F.lit(False))
    return clips.join(agg, "clip_id", "left").select(
        "clip_id", F.when(ok, m).alias("mean_motion_delta"), F.when(ok, v).alias("motion_variance"), F.when(ok, risk).alias("warping_risk"), ok.alias("measured")
    )


def flicker(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Share of direction reversals between successive luminance changes, mean jump, flicker flag and score."""
    d = frame_deltas(frames, "luminance", chunk).withColumn("d", C("luminance") - C("prev_value"))
    pairs = prefix_scan(d, ["clip_id"], ["frame_idx"], last={"prev_d": C("d")}, chunk=cut("frame_idx", chunk))
    agg = pairs.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.abs("d")).alias("jump"), F.count_if(C("d") * C("prev_d") < 0).alias("turns")
    )
    ratio = C("turns") / F.greatest(F.lit(1), C("frames") - 2)
    ok = C("frames") >= 3
    return agg.select(
        "clip_id",
        F.when(ok, ratio).alias("flicker_ratio"),
        F.when(ok, C("jump")).alias("mean_lum_jump"),
        F.when(ok, (ratio > FLICKER_RATIO) & (C("jump") > FLICKER_JUMP)).alias("has_flicker"),
        F.when(ok, ratio * F.least(F.lit(1.0), C("jump") / 10)).alias("flicker_score"),
        C("frames").alias("frames_compared"),
    )


def timeline_segments(frames: DataFrame, durations: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Runs of one label: (clip_id, start_s, end_s, duration_s, label, frame_count). Input: clip_id, frame_idx, t (seconds), label.

    Only the first frame of each run survives the first scan; its end and length come from the next run's first frame, so nothing is
    grouped by run. ``durations`` (clip_id, duration_s) stretches the last run.
    """
    piece = cut("frame_idx", chunk)
    seen = prefix_scan(frames, ["clip_id"], ["frame_idx"], last={"prev_label": C("label")}, chunk=piece)
    starts = seen.where(C("prev_label").isNull() | (C("prev_label") != C("label"))).select("clip_id", "frame_idx", "t", "label")
    runs = prefix_scan(starts, ["clip_id"], ["frame_idx"], last={"next_t": C("t"), "next_idx": C("frame_idx")}, chunk=piece, reverse=True)
    clips = frames.groupBy("clip_id").agg(F.max("t").alias("last_t"), (F.max("frame_idx") + 1).alias("n"))
    if durations is not None:
        clips = clips.join(durations, "clip_id", "left").withColumn("last_t", F.greatest("last_t", "duration_s")).drop("duration_s")
    end = F.coalesce("next_t", "last_t")
    return runs.join(clips, "clip_id").select(
        "clip_id", C("t").alias("start_s"), end.alias("end_s"), F.greatest(F.lit(0.01), end - C("t")).alias("duration_s"), "label",
        (F.coalesce("next_idx", "n") - C("frame_idx")).alias("frame_count"),
    )


def ai_duration_pct(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Share of the timeline in AI segments, at most 100, NULL when the duration is unknown."""
    ai = segments.groupBy("clip_id").agg(F.sum(F.when(C("label") == AI_LABEL, C("duration_s")).otherwise(0.0)).alias("ai_s"))
    return durations.join(ai, "clip_id", "left").select(
        "clip_id", F.when(C("duration_s") > 0, F.least(F.lit(100.0), F.coalesce("ai_s", F.lit(0.0)) / C("duration_s") * 100)).alias("ai_duration_pct")
    )


def covered_seconds(spans: DataFrame) -> DataFrame:
    """(clip_id, label, covered_s): length of the union of overlapping spans; each span adds what lies beyond the furthest end so far."""
    s = prefix_scan(spans, ["clip_id", "label"], ["start_s", "end_s"], maxes={"reached": C("end_s")})
    fresh = F.greatest(F.lit(0.0), C("end_s") - F.greatest(C("start_s"), F.coalesce("reached", "start_s")))
    return s.groupBy("clip_id", "label").agg(F.sum(fresh).alias("covered_s"))


def overlapping_windows(samples: DataFrame, rate: int, seconds: float = 3.0) -> DataFrame:
    """Windows of ``seconds`` every half window: each sample goes to the at most two windows that hold it and is aggregated there.

    A clip no longer than one window is a single window; a tail under half a second is dropped. Input: recording_id, idx, value.
    """
    win = int(seconds * rate)
    step = win // 2
    sizes = samples.groupBy("recording_id").agg((F.max("idx") + 1).alias("total"))
    k = F.expr(f"idx div {step}")
    homes = F.array_compact(F.array(k, F.when(k >= 1, k - 1)))
    rows = samples.join(sizes, "recording_id").withColumn("w", F.explode(F.when(C("total") <= win, F.array(F.lit(0).cast("bigint"))).otherwise(homes)))
    agg = rows.groupBy("recording_id", "w", "total").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs("value") < 1e-5).alias("zeros"), F.avg(C("value") * C("value")).alias("power")
    )
    start = C("w") * step
    length = F.least(F.lit(win), C("total") - start)
    p = F.lit(0.10) + F.when(C("zeros") / C("n") > 0.12, 0.30).otherwise(0.0)
    kept = agg.where((C("total") <= win) | (length >= rate // 2))
    return kept.select(
        "recording_id", (start / rate).alias("start_s"), F.least(C("total") / rate, (start + length) / rate).alias("end_s"), "n", F.sqrt("power").alias("rms"),
        p.alias("ai_prob"), F.when(p >= 0.55, AI_LABEL).otherwise("LIKELY REAL").alias("label"),
    )


def hum_trace(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """State of a mains-hum track: NO_TRACE, STABLE_TONE, ERRATIC, SPLICED or CONTINUOUS, with its log-odds. Input: clip_id, frame_idx, hz,
    snr."""
    f = frames.withColumn("good", C("snr") >= HUM["snr"])
    seen = prefix_scan(f, ["clip_id"], ["frame_idx"], last={"prev_hz": C("hz"), "prev_good": C("good")}, chunk=cut("frame_idx", chunk))
    jump = C("good") & C("prev_good") & (F.abs(C("hz") - C("prev_hz")) > HUM["jump"])
    agg = seen.groupBy("clip_id").agg(
        F.avg(C("good").cast("double")).alias("frac"), F.stddev_pop(F.when(C("good"), C("hz"))).alias("std"), F.count_if(jump).alias("jumps")
    )
    mid = exact_quantiles(f.where("good"), ["clip_id"], "hz", {"median_hz": 0.5}).drop("n_measured")
    state = (
        F.when(C("frac") < HUM["present"], "NO_TRACE")
        .when(C("std") < HUM["tone"], "STABLE_TONE")
        .when(C("std") > HUM["erratic"], "ERRATIC")
        .when(C("jumps") > 0, "SPLICED")
        .otherwise("CONTINUOUS")
    )
    there = C("state") != "NO_TRACE"
    return agg.join(mid, "clip_id", "left").withColumn("state", state).select(
        "clip_id", "state", C("frac").alias("good_fraction"), F.when(there, C("median_hz")).alias("median_hz"), F.when(there, C("std")).alias("std_hz"),
        F.when(C("state").isin("SPLICED", "CONTINUOUS"), C("jumps")).alias("jumps"),
        F.when(C("state") == "SPLICED", 0.15).when(C("state") == "CONTINUOUS", -0.15).alias("llr"),
    )


def stream_page_continuity(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sequence gaps, granule regressions and failed checksums per file. Input: clip_id, page, serial, seq, granule, crc_ok."""
    s = prefix_scan(pages, ["clip_id", "serial"], ["page"], last={"pseq": C("seq"), "pgran": C("granule")}, chunk=cut("page", chunk))
    back = (C("pgran") >= 0) & (C("granule") >= 0) & (C("granule") < C("pgran"))
    per = s.groupBy("clip_id", "serial").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~C("crc_ok")).alias("bad"), F.count_if(C("seq") != C("pseq") + 1).alias("gaps"), F.count_if(back).alias("back")
    )
    agg = per.groupBy("clip_id").agg(
        F.sum("n").alias("pages"), F.sum("bad").alias("crc_failures"), F.sum("gaps").alias("sequence_gaps"), F.sum("back").alias("granule_regressions"),
        F.count(F.lit(1)).alias("serials"),
    )
    bad = C("crc_failures") + C("sequence_gaps") + C("granule_regressions") > 0
    return agg.withColumn("status", F.when(bad, "WARN").when(C("serials") > 1, "INFO").otherwise("PASS"))


def frame_cadence(frames: DataFrame, value: str = "luminance", chunk: int = CHUNK) -> DataFrame:
    """Duplicate-frame pattern per clip: NOT_APPLICABLE, HEAVY_DUPLICATION, PULLDOWN_3_2, REGULAR_DUPLICATION, ISOLATED_DUPLICATES, NONE."""
    k = CADENCE
    d = frame_deltas(frames, value, chunk).where("prev_value IS NOT NULL").select("clip_id", "frame_idx", F.abs(C(value) - C("prev_value")).alias("d"))
    level = exact_quantiles(d, ["clip_id"], "d", {"motion": 0.75}).drop("n_measured")
    j = d.join(level, "clip_id")
    agg = j.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("diffs"), F.max("motion").alias("motion"), F.count_if(C("d") < k["repeat"] * C("motion")).alias("repeats"),
        F.count_if((C("d") > k["cut_factor"] * C("motion")) & (C("d") > k["cut_min"])).alias("cuts"),
    )
    rep = j.where(C("d") < k["repeat"] * C("motion"))
    gaps = prefix_scan(rep, ["clip_id"], ["frame_idx"], last={"prev_rep": C("frame_idx")}, chunk=cut("frame_idx", chunk)).where("prev_rep IS NOT NULL")
    counted = gaps.groupBy("clip_id", (C("frame_idx") - C("prev_rep")).alias("gap")).agg(F.count(F.lit(1)).alias("c"))
    top = counted.groupBy("clip_id").agg(F.max(F.struct(C("c"), (-C("gap")).alias("g"))).alias("top"), F.sum("c").alias("n_gaps"))
    clips = frames.select("clip_id").distinct()
    x = clips.join(agg, "clip_id", "left").join(top, "clip_id", "left")
    frac = C("repeats") / C("diffs")
    usable = F.coalesce((C("diffs") + 1 >= k["min_frames"]) & (C("motion") >= k["still"]), F.lit(False))
    regular = F.coalesce((C("repeats") >= 3) & (C("top.c") >= k["regular"] * C("n_gaps")), F.lit(False))
    period = -C("top.g")
    pattern = (
        F.when(~usable, "NOT_APPLICABLE")
        .when(frac >= k["heavy"], "HEAVY_DUPLICATION")
        .when(regular & (period == 5), "PULLDOWN_3_2")
        .when(regular, "REGULAR_DUPLICATION")
        .when(C("repeats") >= 1, "ISOLATED_DUPLICATES")
        .otherwise("NONE")
    )
    return x.withColumn("pattern", pattern).select(
        "clip_id", "pattern", F.when(usable, C("repeats")).alias("repeat_frames"), F.when(usable, frac).alias("repeat_fraction"),
        F.when(usable, C("cuts")).alias("hard_cuts"), F.when(C("pattern").isin("PULLDOWN_3_2", "REGULAR_DUPLICATION"), period).alias("period"),
    )


def combing(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Median row-difference ratio over moving frames; needs three. Input: clip_id, frame_idx, luminance, row_diff, two_row_diff."""
    d = frame_deltas(frames, "luminance", chunk).where(F.abs(C("luminance") - C("prev_value")) >= COMB_MOTION)
    r = d.select("clip_id", (C("row_diff") / (C("two_row_diff") + 1e-6)).alias("ratio"))
    mid = exact_quantiles(r, ["clip_id"], "ratio", {"combing_ratio": 0.5})
    ok = F.coalesce(C("n_measured") >= 3, F.lit(False))
    return frames.select("clip_id").distinct().join(mid, "clip_id", "left").select(
        "clip_id", F.coalesce("n_measured", F.lit(0)).alias("moving_frames"), F.when(ok, C("combing_ratio")).alias("combing_ratio"),
        F.when(ok, C("combing_ratio") > COMB_RATIO).alias("combed"),
    )


def block_max_difference(a: Column, b: Column, height: int, width: int, grid: tuple[int, int] = (6, 8)) -> Column:
    """Largest mean absolute difference of two row-major thumbnails over a grid of blocks; rows and columns beyond a whole block are left
    out."""
    gh, gw = grid
    bh, bw = (height - height % gh) // gh, (width - width % gw) // gw
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))

    def block(i: int, j: int) -> Column:
        rows = [F.slice(diff, (i * bh + r) * width + j * bw + 1, bw) for r in range(bh)]
        return F.aggregate(rows[0] if bh == 1 else F.flatten(F.array(*rows)), F.lit(0.0), lambda acc, v: acc + v) / (bh * bw)

    return F.array_max(F.array(*[block(i, j) for i in range(gh) for j in range(gw)]))


def scene_changes(thumbs: DataFrame, height: int, width: int, floor: float = 0.03, factor: float = 5.0, chunk: int = CHUNK) -> DataFrame:
    """(clip_id, frame_idx, diff) of the probes that start a shot or bring a visible change. Input: clip_id, frame_idx, thumb."""
    s = prefix_scan(thumbs, ["clip_id"], ["frame_idx"], last={"prev": C("thumb")}, chunk=cut("frame_idx", chunk)).where("prev IS NOT NULL")
    d = s.select("clip_id", "frame_idx", block_max_difference(C("thumb"), C("prev"), height, width).alias("diff"))
    mid = exact_quantiles(d, ["clip_id"], "diff", {"median": 0.5}).drop("n_measured")
    return d.join(mid, "clip_id").where(C("diff") > F.greatest(F.lit(floor), factor * C("median"))).select("clip_id", "frame_idx", "diff")


def longest_unexamined(times: DataFrame, durations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Longest gap between examined moments, start and end included. Input: clip_id, frame_idx, t."""
    s = prefix_scan(times, ["clip_id"], ["frame_idx"], last={"prev_t": C("t")}, chunk=cut("frame_idx", chunk))
    agg = s.groupBy("clip_id").agg(F.max(C("t") - F.coalesce("prev_t", F.lit(0.0))).alias("inner"), F.max("t").alias("last_t"))
    return durations.join(agg, "clip_id", "left").select(
        "clip_id", F.when((C("duration_s") > 0) & C("last_t").isNotNull(), F.greatest(C("inner"), C("duration_s") - C("last_t"))).alias("longest_s")
    )


def sample_frames_even(frames: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` frames per clip spread evenly, first and last included; positions are rounded half to even."""
    n = frames.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("n"))
    if k <= 0:
        return frames.where(F.lit(False))
    spread = F.expr(f"bround(i * (n - 1) / {k - 1}.0D)").cast("bigint") if k > 1 else F.lit(0).cast("bigint")
    wanted = n.where(C("n") > k).select("clip_id", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    picks = wanted.select("clip_id", spread.alias("frame_idx")).distinct()
    short = n.where(C("n") <= k).select("clip_id")
    return frames.join(picks, ["clip_id", "frame_idx"], "left_semi").unionByName(frames.join(short, "clip_id", "left_semi"))


def sample_frames_strided(frames: DataFrame, k: int) -> DataFrame:
    """Every max(1, n div k)-th frame, at most ``k`` of them."""
    n = frames.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("n"))
    step = F.greatest(F.lit(1), F.expr(f"n div {k}"))
    return frames.join(n, "clip_id").where((C("frame_idx") % step == 0) & (C("frame_idx") / step < k)).drop("n")
