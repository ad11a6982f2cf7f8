"""Scoring rules as column expressions: percentages, log-odds, weighted pools, frame score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical baselines (mean, sigma) and term weights of the image score.
REAL_NOISE = (2.45, 0.65)
AI_NOISE = (0.85, 0.45)
REAL_SMOOTH = (1.95, 0.50)
AI_SMOOTH = (0.75, 0.40)
SLOPE_JPEG = (2.68, 0.35)
SLOPE_OPTICAL = (2.15, 0.25)
PIXEL_WEIGHTS = {"noise": 0.35, "smooth": 0.30, "fft": 0.20, "ela": 0.15}
PRIORS = {"aggressive": 0.40, "high": 0.20, "balanced": 0.00}
SMALL_SIDE = 400
MIN_SLOPE_SIDE = 512
EXIF_CONTRADICTION = 2.0
EXIF_TRUSTED = -1.4
EXIF_UNTRUSTED = -0.3
ART_SCALE = 0.8

# Cue weights of the audio and video pools and of the frame score.
AUDIO_WEIGHTS = {"vocoder": 0.40, "flatness": 0.30, "silence": 0.20, "hf": 0.10}
VIDEO_WEIGHTS = {"frame": 0.60, "warp": 0.25, "flicker": 0.15, "neural": 0.35}
FRAME = {"baseline": 0.70, "noise_at": 2.0, "noise_at_sensitive": 2.4, "smooth_at": 3.1, "smooth_at_sensitive": 3.6}

# Fixed values: (floor, ceiling, factor) of the undecided margin per modality.
UNDECIDED_MARGIN = {"image": (3.0, 24.0, 20.0), "audio": (3.0, 22.0, 18.0), "video": (4.0, 25.0, 20.0)}


def at_least(c: Column, low: float) -> Column:
    """``c`` raised to ``low``; NULL stays NULL (a bare ``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), c))


def at_most(c: Column, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def _triple(ai: Column, real: Column, undecided: Column) -> Column:
    return F.struct(ai.alias("ai"), real.alias("real"), undecided.alias("undecided"))


def normalise_with_margin(ai: Column, real: Column, undecided: Column, floor: float = 3.0, decimals: int = 1) -> Column:
    """struct(ai, real, undecided) scaled together to 100, the undecided share not below ``floor``."""
    a, r = at_least(ai, 0.0), at_least(real, 0.0)
    u = at_least(undecided, float(floor))
    scale = F.lit(100.0) / (a + r + u)
    pa, pr = F.round(a * scale, decimals), F.round(r * scale, decimals)
    shares = _triple(pa, pr, F.round(F.greatest(F.lit(0.0), 100 - (pa + pr)), decimals))
    return F.when(a + r + u <= 0, _triple(F.lit(0.0), F.lit(0.0), F.lit(100.0))).when(a + r + u > 0, shares)


def normalise_by_gap(ai: Column, real: Column, floor: float = 3.0, decimals: int = 1) -> Column:
    """struct(ai, real, undecided): the closer the two, the larger the undecided share."""
    a, r = at_least(ai, 0.0), at_least(real, 0.0)
    u = F.greatest(F.lit(float(floor)), (1 - F.least(F.lit(1.0), F.abs(a - r) / 100)) * 20)
    rest = F.greatest(F.lit(0.0), 100 - u)
    pa, pr = F.round(a / (a + r) * rest, decimals), F.round(r / (a + r) * rest, decimals)
    return F.when(a + r > 0, _triple(pa, pr, F.round(100 - (pa + pr), decimals))).when(
        a + r == 0, _triple(F.lit(0.0), F.lit(0.0), F.lit(100.0))
    )


def binary_entropy(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return clip(-q * F.log2(q) - (1 - q) * F.log2(1 - q), 0.0, 1.0)


def undecided_margin(p: Column, modality: Column) -> Column:
    def pick(i: int) -> Column:
        out = F
        for name, limits in UNDECIDED_MARGIN.items():
            out = out.when(modality == name, F.lit(limits[i]))
        return out

    return F.when(p.isNotNull() & pick(0).isNotNull(), F.greatest(pick(0), F.least(pick(1), binary_entropy(p) * pick(2))))


def log_odds10(p: Column) -> Column:
    return F.log10(p / (1 - p))


def probability10(log_odds: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -log_odds))


def finite(c: Column) -> Column:
    """``c``, or NULL when it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def shift_log_odds(p: Column, total: Column) -> Column:
    """Shift p by a base-10 log-odds total held within +/-1; a zero or missing total leaves p as it is.

    Terms that cancel sum to zero or to the last bit of a double, depending on the order, so zero is read with a tolerance.
    """
    t = clip(F.coalesce(total, F.lit(0.0)), -1.0, 1.0)
    return F.when(F.abs(t) < 1e-12, p).otherwise(clip(probability10(log_odds10(clip(p, 0.01, 0.99)) + t), 0.01, 0.99))


def sum_of_terms(terms: Column) -> Column:
    """Sum of the finite values of a map<string,double>."""
    return F.aggregate(F.map_values(terms), F.lit(0.0), lambda acc, v: acc + F.coalesce(finite(v), F.lit(0.0)))


def gaussian_llr(x: Column, real: tuple[float, float], ai: tuple[float, float], ai_offset: Column | float = 0.0) -> Column:
    """Base-10 log-likelihood ratio, AI against real, held within +/-3."""
    ln10 = math.log(10)
    shift = ai_offset if isinstance(ai_offset, Column) else F.lit(float(ai_offset))
    d_ai, d_real = x - (F.lit(ai[0]) + shift), x - F.lit(real[0])
    lr = F.lit(math.log10(real[1] / ai[1])) - d_ai * d_ai / (2 * ai[1] ** 2 * ln10) + d_real * d_real / (2 * real[1] ** 2 * ln10)
    return clip(lr, -3.0, 3.0)


def pixel_terms(c: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Noise and smoothness terms and the camera-tag credit.

    ``c``: noise, flat_noise, smooth, w, h, lossy_jpeg, has_camera, is_scanned, is_art, noise_offset, smooth_offset.
    """
    weights = weights or PIXEL_WEIGHTS
    total = sum(weights.values())
    share = {k: (v / total if total > 0 else v) for k, v in weights.items()}
    noise = F.when(c["is_art"], F.coalesce(c["flat_noise"], c["noise"])).otherwise(c["noise"])
    raw_n = gaussian_llr(noise, REAL_NOISE, AI_NOISE, c["noise_offset"])
    raw_s = gaussian_llr(c["smooth"], REAL_SMOOTH, AI_SMOOTH, c["smooth_offset"])
    unreadable = (F.greatest(c["w"], c["h"]) <= SMALL_SIDE) | c["lossy_jpeg"]
    n = F.when(unreadable, at_most(raw_n, 0.0)).otherwise(raw_n)
    s = F.when(unreadable, at_most(raw_s, 0.0)).otherwise(raw_s)
    against = F.greatest(n, F.lit(0.0)) + F.greatest(s, F.lit(0.0)) >= EXIF_CONTRADICTION
    untrusted = c["has_camera"] & ~c["is_scanned"] & against
    discount = (c["has_camera"] & ~untrusted) | c["is_scanned"]
    n = F.when(discount, at_most(n, 0.15)).otherwise(n)
    n = F.when(c["is_art"], at_least(n, 0.15)).otherwise(n)
    s = F.when(discount, at_most(s, 0.10)).otherwise(s)
    s = F.when(c["is_art"], at_least(s, 0.20)).otherwise(s)
    return {
        "sensor_noise": n * share["noise"],
        "surface_smoothness": s * share["smooth"],
        "exif_hardware": F.when(c["has_camera"], F.when(untrusted, EXIF_UNTRUSTED).otherwise(EXIF_TRUSTED)),
    }


def spectral_slope_term(c: dict[str, Column], weight: float = 0.20) -> Column:
    """Term of the spectral slope ``alpha``; NULL when not scored. ``c``: alpha, w, h, lossy_jpeg, is_jpeg, has_camera, is_scanned,
    anomalous_decay."""
    alpha = c["alpha"]
    camera_like = c["has_camera"] | c["is_jpeg"] | c["is_scanned"]
    z_jpeg, z_opt = (alpha - SLOPE_JPEG[0]) / SLOPE_JPEG[1], (alpha - SLOPE_OPTICAL[0]) / SLOPE_OPTICAL[1]
    z = F.when(camera_like, z_jpeg).otherwise(z_opt)
    odd = F.when(camera_like, (alpha > 3.45) | (alpha < 1.65)).otherwise(c["anomalous_decay"] | (F.abs(z_opt) > 2.0))
    term = F.when(odd, clip(F.abs(z) * 0.4, 0.2, 1.5)).otherwise(-0.4) * weight
    scored = alpha.isNotNull() & ~c["lossy_jpeg"] & (F.least(c["w"], c["h"]) >= MIN_SLOPE_SIDE)
    return F.when(scored, term)


def declared_terms(c: dict[str, Column]) -> Column:
    """map<string,double> of the terms that metadata and the discrete detectors declare.

    ``c``: ai_signature, enhancer_signature, has_camera, c2pa_present, watermark, is_scanned, inpainted, inpaint_confidence, w, h, is_art,
    art_confidence.
    """

    def entry(cond: Column, name: str, value: Column | float) -> Column:
        v = value if isinstance(value, Column) else F.lit(float(value))
        return F.when(cond, F.struct(F.lit(name).alias("k"), v.cast("double").alias("v")))

    absent = ~c["has_camera"] & ~c["ai_signature"] & ~c["enhancer_signature"] & ~c["c2pa_present"]
    rows = F.array_compact(
        F.array(
            entry(c["ai_signature"], "exif_ai_signature", 3.2),
            entry(~c["ai_signature"] & c["enhancer_signature"], "ai_enhancer_signature", 1.2),
            entry(~c["ai_signature"] & ~c["enhancer_signature"] & c["has_camera"], "exif_hardware", EXIF_TRUSTED),
            entry(absent, "metadata_absent", 0.0),
            entry(c["watermark"], "ai_watermark", 3.5),
            entry(c["is_scanned"], "scanned_print", -2.2),
            entry(c["inpainted"] & (F.greatest(c["w"], c["h"]) > SMALL_SIDE), "inpainting_splicing", c["inpaint_confidence"] * 1.8),
            entry(c["is_art"] & ~c["has_camera"] & ~c["is_scanned"], "digital_art_synthesis", c["art_confidence"] * ART_SCALE),
        )
    )
    return F.map_from_entries(rows)


def pool_audio(
    c: dict[str, Column], offset: Column | float = 0.0, flatness_max: Column | float = 0.002, silence_min: Column | float = 0.12, weights: dict[str, Column | float] | None = None
) -> Column:
    """P(AI) of a recording. Offset, thresholds and weights may be columns, such as a joined calibration; weights that are not given keep
    their defaults. ``c``: has_vocoder_cutoff, spectral_flatness, digital_silence_ratio (NULL = not measured), high_freq_ratio,
    neural_prob (NULL = none)."""
    w = AUDIO_WEIGHTS | (weights or {})
    measured = c["digital_silence_ratio"].isNotNull()
    without = F.lit(1.0) - w["silence"]
    scale = F.when(measured, F.lit(1.0)).otherwise(1 / without)
    vocoder = F.when(c["has_vocoder_cutoff"], 0.90).otherwise(0.10) * w["vocoder"]
    flat = F.when(c["spectral_flatness"] < flatness_max, 0.85).otherwise(0.15) * w["flatness"]
    hf = F.when(c["high_freq_ratio"] < 0.01, 0.70).otherwise(0.20) * w["hf"]
    silence = F.when(measured, F.when(c["digital_silence_ratio"] > silence_min, 0.85).otherwise(0.15) * w["silence"]).otherwise(0.0)
    acoustic = (vocoder + flat + hf) * scale + silence
    blended = F.when(c["neural_prob"].isNotNull(), c["neural_prob"] * 0.55 + acoustic * 0.45).otherwise(acoustic)
    return clip(blended + offset, 0.01, 0.99)


def pool_video(c: dict[str, Column], offset: Column | float = 0.0, weights: dict[str, Column | float] | None = None) -> Column:
    """P(AI) of a clip. Offset and weights may be columns, such as a joined calibration; a cue that was not measured gives its weight to the
    others. ``c``: mean_frame_ai, warping_risk, has_flicker, neural_prob."""
    w = VIDEO_WEIGHTS | (weights or {})
    warp_w = F.when(c["warping_risk"].isNull(), 0.0).otherwise(w["warp"])
    flick_w = F.when(c["has_flicker"].isNull(), 0.0).otherwise(w["flicker"])
    neural_w = F.when(c["neural_prob"].isNull(), 0.0).otherwise(w["neural"])
    total = F.lit(0.0) + w["frame"] + warp_w + flick_w + neural_w
    risky = F.coalesce(c["warping_risk"].isin("HIGH_WARPING_DETECTED", "SUSPICIOUS_FLICKER", "UNNATURAL_FREEZE"), F.lit(False))
    raw = (
        c["mean_frame_ai"] * w["frame"]
        + F.when(risky, 0.85).otherwise(0.15) * warp_w
        + F.when(F.coalesce(c["has_flicker"], F.lit(False)), 0.80).otherwise(0.20) * flick_w
        + F.coalesce(c["neural_prob"], F.lit(0.0)) * neural_w
    ) / total
    return clip(raw + offset, 0.01, 0.99)


def score_frame(noise: Column, smooth: Column, sensitivity: str = "balanced") -> Column:
    """struct(ai_prob, label) of one frame from its two residuals, shrunk to 0.4 around one half."""
    sensitive = sensitivity in ("high", "aggressive")
    noise_at = FRAME["noise_at_sensitive" if sensitive else "noise_at"]
    smooth_at = FRAME["smooth_at_sensitive" if sensitive else "smooth_at"]
    p_noise = 1 / (1 + F.exp((at_least(noise - FRAME["baseline"], 0.2) - noise_at) * 2.0))
    p_smooth = 1 / (1 + F.exp((smooth - smooth_at) * 1.3))
    score = F.lit(0.5) + (p_noise * 0.55 + p_smooth * 0.45 - 0.5) * 0.4
    label = F.when(score >= (0.50 if sensitive else 0.60), "LIKELY AI-GENERATED").when(score <= 0.35, "LIKELY REAL").when(score.isNotNull(), "UNDECIDED")
    return F.struct(score.alias("ai_prob"), label.alias("label"))


def moire_flag(peak_ratio: Column, azimuthal_var: Column) -> Column:
    """struct(is_screen_recapture, confidence, moire_score) from a spectrum's peak ratio and azimuthal variance."""
    strong = (peak_ratio >= 4.5) & (azimuthal_var >= 1.25)
    very = peak_ratio >= 6.5
    both = F.least(F.lit(0.95), (peak_ratio - 4.5) * 0.10 + (azimuthal_var - 1.25) * 0.20 + 0.50)
    single = F.least(F.lit(0.92), (peak_ratio - 6.5) * 0.05 + 0.60)
    return F.struct(
        (strong | very).alias("is_screen_recapture"),
        F.round(F.when(strong, both).when(very, single).otherwise(0.0), 2).alias("confidence"),
        F.round(peak_ratio / 4.0 + azimuthal_var, 2).alias("moire_score"),
    )


def damped(step: float, n: Column) -> Column:
    """``step`` after ``n`` earlier corrections: step / (1 + n/10)^2."""
    base = F.lit(1.0) + F.greatest(F.lit(0), n) / 10
    return F.lit(float(step)) / (base * base)


def feedback_quality(answer: Column, p_ai: Column) -> Column:
    """struct(quality_score, is_suspect): the model's probability of the answer, 1.0 when there is none to compare with."""
    usable = p_ai.between(0.0, 1.0) & ~F.isnan(p_ai)
    score = F.when(answer == "AI", p_ai).otherwise(1 - p_ai)
    suspect = usable & (score < 0.20) & (F.greatest(p_ai, 1 - p_ai) >= 0.80)
    return F.struct(
        F.when(usable, score).otherwise(1.0).alias("quality_score"), F.coalesce(suspect, F.lit(False)).alias("is_suspect")
    )
