"""Calibration from ordered corrections.

Every correction moves a parameter by a damped step and clamps it. A clamped step is x -> min(hi, max(lo, x + d)), and two of them in a row
are one of the same kind, so corrections are composed inside chunks in parallel and the chunk results in order: one modality's whole history
is never folded in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.functions.scoring import damped
from candorframe.operators.identity import dedupe_feedback
from candorframe.operators.ordering import CHUNK, position
from candorframe.functions.whitespace import strip

C = F.col
INF = float("inf")

# Per modality (section, key, start, [(answer, measurement, comparison, limit, step, low, high)]).
RULES = {
    "image": [
        ("feature_weights", "noise_residual", 0.35, [("AI", "noise", "<", 2.5, 0.02, None, 0.60)]),
        ("feature_weights", "surface_smoothness", 0.30, [("AI", "smooth", "<", 3.0, 0.02, None, 0.55)]),
        ("sensitivity_offsets", "noise_center_offset", 0.0, [("AI", "noise", "<", 2.5, -0.03, -0.40, None), ("REAL", "noise", "<", 2.0, 0.03, None, 0.35)]),
        ("sensitivity_offsets", "smooth_center_offset", 0.0, [("AI", "smooth", "<", 3.0, 0.03, None, 0.40), ("REAL", "smooth", "<", 2.0, -0.03, -0.35, None)]),
    ],
    "audio": [
        ("acoustic_weights", "vocoder_cutoff", 0.40, [("AI", None, None, None, 0.02, None, 0.60)]),
        ("thresholds", "flatness_synthetic_max", 0.002, [("AI", "flatness", ">", 0.002, 0.0005, None, 0.010)]),
        ("sensitivity_offsets", "audio_ai_offset", 0.0, [("AI", None, None, None, 0.03, None, 0.35), ("REAL", None, None, None, -0.03, -0.35, None)]),
    ],
    "video": [
        ("motion_thresholds", "high_warping_var", 140.0, [("REAL", "motion_var", ">", 60.0, 3.0, None, 200.0)]),
        ("motion_thresholds", "suspicious_flicker_var", 75.0, [("AI", "motion_var", "<", 100.0, -2.0, 50.0, None)]),
        ("sensitivity_offsets", "video_ai_offset", 0.0, [("AI", "motion_var", "<", 100.0, 0.03, None, 0.30), ("REAL", "motion_var", ">", 60.0, -0.03, -0.30, None)]),
    ],
}

# Accepted range of a number by the kind of section, and every default of the three calibrations.
RANGES = [("weights", 0.0, 2.0), ("offsets", -1.0, 1.0), ("thresholds", 0.0, 1.0e6)]
DEFAULTS = [
    ("image", "feature_weights", "noise_residual", 0.35), ("image", "feature_weights", "surface_smoothness", 0.30), ("image", "feature_weights", "fft_decay", 0.20),
    ("image", "feature_weights", "facial_shading", 0.25), ("image", "feature_weights", "ela_discrepancy", 0.15),
    ("image", "sensitivity_offsets", "noise_center_offset", 0.0), ("image", "sensitivity_offsets", "smooth_center_offset", 0.0),
    ("image", "sensitivity_offsets", "fft_decay_offset", 0.0), ("audio", "acoustic_weights", "vocoder_cutoff", 0.40),
    ("audio", "acoustic_weights", "spectral_flatness", 0.30), ("audio", "acoustic_weights", "silence_ratio", 0.20), ("audio", "acoustic_weights", "high_freq_roll", 0.10),
    ("audio", "thresholds", "flatness_synthetic_max", 0.002), ("audio", "thresholds", "silence_synthetic_min", 0.12), ("audio", "sensitivity_offsets", "audio_ai_offset", 0.0),
    ("video", "motion_thresholds", "high_warping_var", 140.0), ("video", "motion_thresholds", "suspicious_flicker_var", 75.0),
    ("video", "motion_thresholds", "unnatural_freeze_var", 0.8), ("video", "temporal_weights", "frame_ai_ratio", 0.60), ("video", "temporal_weights", "motion_warping", 0.25),
    ("video", "temporal_weights", "diffusion_flicker", 0.15), ("video", "sensitivity_offsets", "video_ai_offset", 0.0),
]


def _moves(modality: str) -> list[Column]:
    """One struct(param, d, lo, hi) per parameter that a correction moves, NULL where it moves nothing."""
    out = []
    for section, key, _, rules in RULES[modality]:
        move = F
        for answer, measure, op, limit, step, low, high in rules:
            cond = C("user_label") == answer
            if measure:
                cond = cond & (C(measure) < limit if op == "<" else C(measure) > limit)
            move = move.when(
                cond,
                F.struct(
                    F.lit(f"{section}.{key}").alias("param"), damped(step, C("n")).alias("d"), F.lit(-INF if low is None else low).alias("lo"),
                    F.lit(INF if high is None else high).alias("hi"),
                ),
            )
        out.append(move)
    return out


def _compose(a: Column, b: Column) -> Column:
    """The clamped step that is ``a`` and then ``b``."""
    lo = F.least(b["hi"], F.greatest(b["lo"], a["lo"] + b["d"]))
    hi = F.least(b["hi"], F.greatest(b["lo"], a["hi"] + b["d"]))
    return F.struct((a["d"] + b["d"]).alias("d"), lo.alias("lo"), hi.alias("hi"))


def _fold(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "d", "lo", "hi"))).alias("s"), F.min(order).alias(order))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"))
    return listed.select(*keys, order, F.aggregate("s", start, _compose).alias("f")).select(*keys, order, "f.d", "f.lo", "f.hi")


def calibrate(feedback: DataFrame, modality: str, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """(section, key, value, samples) after all corrections of one modality, each (content, answer) counted once, in order.

    Input: sha256, user_label and the measurements named in RULES; a NULL measurement moves nothing.
    """
    answers = feedback.withColumn("user_label", F.upper(strip("user_label"))).where(C("user_label").isin("AI", "REAL"))
    once = position(dedupe_feedback(answers, order), [], [*order, "sha256", "user_label"], "n")
    moves = once.select("n", F.explode_outer(F.array(*_moves(modality))).alias("m")).where("m IS NOT NULL").select("n", "m.*")
    pieces = _fold(moves.withColumn("chunk", F.expr(f"n div {chunk}")), ["param", "chunk"], "n")
    total = _fold(pieces, ["param"], "n")
    spark = feedback.sparkSession
    start = spark.createDataFrame([(f"{s}.{k}", s, k, float(v)) for s, k, v, _ in RULES[modality]], "param string, section string, key string, start double")
    samples = once.agg(F.count(F.lit(1))).scalar()
    moved = F.least(C("hi"), F.greatest(C("lo"), C("start") + C("d")))
    return start.join(total, "param", "left").select("section", "key", F.coalesce(moved, C("start")).alias("value"), samples.alias("samples"))


def sanitise_calibration(loaded: DataFrame, defaults: list[tuple[str, str, float]]) -> DataFrame:
    """(calib_id, section, key, value): every default filled in, and a missing, non-numeric, non-finite or out-of-range value replaced by it.

    ``loaded``: calib_id, section, key, value (text); ``defaults``: section, key, value, a fixed list that goes along with each calibration as
    a map-side array. ``samples_processed`` (section '') falls back to 0.
    """
    number = C("value").try_cast("double")
    low, high = F.lit(-1.0e9), F.lit(1.0e9)
    for kind, lo, hi in reversed(RANGES):
        low = F.when(C("section").contains(kind), lo).otherwise(low)
        high = F.when(C("section").contains(kind), hi).otherwise(high)
    fine = number.isNotNull() & ~F.isnan(number) & number.between(low, high)
    count = C("value").try_cast("bigint")
    given = loaded.select(
        "calib_id", "section", "key", F.when(C("key") == "samples_processed", F.when(count >= 0, count.cast("double"))).when(fine, number).alias("given")
    )
    every = F.array(
        F.struct(F.lit("").alias("section"), F.lit("samples_processed").alias("key"), F.lit(0.0).alias("default")),
        *[F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), F.lit(float(value)).alias("default")) for section, key, value in defaults],
    )
    wanted = loaded.select("calib_id").distinct().withColumn("w", F.explode(every)).select("calib_id", "w.*")
    one = given.groupBy("calib_id", "section", "key").agg(F.max("given").alias("given"))
    return wanted.join(one, ["calib_id", "section", "key"], "left").select("calib_id", "section", "key", F.coalesce("given", "default").alias("value"))


def sanitise_metrics(metrics: Column, excluded: list[str]) -> Column:
    """A map<string,string> of JSON values without arrays, nulls, non-finite numbers and excluded keys."""
    def fine(k: Column, v: Column) -> Column:
        text = F.trim(v)
        return v.isNotNull() & ~text.startswith("[") & ~F.lower(text).isin("null", "nan", "infinity", "-infinity") & ~k.isin(excluded)

    return F.map_filter(metrics, fine)
