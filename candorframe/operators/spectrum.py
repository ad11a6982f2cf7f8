"""Audio measurements over long spectrum and sample tables.

A recording's frames are reduced to one row per frequency bin by a partial aggregation; what runs per recording afterwards has at most as
many rows as the transform has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.operators.ordering import CHUNK, exact_quantiles, prefix_scan
from candorframe.operators.sequence import cut

C = F.col

# Vocoder cut-off bands, scene limits and telephony limits.
VOCODER_LOW = (6500, 8200)
VOCODER_HIGH = (15000, 16500)
NYQUIST_SHARE = 0.92
SPEECH_BAND = (300.0, 3400.0)
SCENE = {"speech": 0.65, "high_from": 4000.0, "high": 0.35, "flat": 0.40, "dynamic": 8.0, "compressed": 3.5, "strong_rms": 0.05}


def mean_spectrum(spectrum: DataFrame, rate: int, bins: int) -> DataFrame:
    """(recording_id, bin, hz, mag): mean magnitude per frequency bin of ``bins`` bins from 0 to half the rate."""
    return spectrum.groupBy("recording_id", "bin").agg(F.avg("magnitude").alias("mag")).withColumn("hz", C("bin") * (rate / 2.0 / (bins - 1)))


def spectral_features(spectrum: DataFrame, rate: int, bins: int, levels: DataFrame | None = None) -> DataFrame:
    """Cut-off frequency, vocoder flag, flatness, share above 5 kHz and the heuristic probability per recording.

    ``levels`` (recording_id, silence_ratio) adds the digital-silence cue; without it the cue is not measured.
    """
    by_rec = W.partitionBy("recording_id")
    total = F.sum("mag").over(by_rec) + 1e-10
    cum = F.sum("mag").over(by_rec.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / total
    m = mean_spectrum(spectrum, rate, bins).withColumns({"total": total, "cum": cum})
    agg = m.groupBy("recording_id").agg(
        F.coalesce(F.min(F.when(C("cum") >= 0.985, C("hz"))), F.max("hz")).alias("cutoff_hz"),
        F.exp(F.avg(F.ln(C("mag") + 1e-12))).alias("geo"),
        F.avg(C("mag") + 1e-12).alias("ari"),
        (F.sum(F.when(C("hz") >= 5000, C("mag")).otherwise(0.0)) / F.max("total")).alias("high_freq_ratio"),
    )
    cutoff = C("cutoff_hz")
    low = cutoff.between(*VOCODER_LOW) & F.lit(rate >= 16000)
    high = cutoff.between(*VOCODER_HIGH) & F.lit(rate >= 44100)
    out = agg.withColumns(
        {"has_vocoder_cutoff": (cutoff <= NYQUIST_SHARE * rate / 2) & (low | high), "spectral_flatness": C("geo") / F.greatest(F.lit(1e-12), C("ari"))}
    )
    out = out.join(levels.select("recording_id", "silence_ratio"), "recording_id", "left") if levels is not None else out.withColumn("silence_ratio", F.lit(None).cast("double"))
    p = (
        F.lit(0.10)
        + F.when(C("has_vocoder_cutoff"), 0.50).otherwise(0.0)
        + F.when(C("spectral_flatness") < 0.002, 0.25).otherwise(0.0)
        + F.when(C("silence_ratio") > 0.12, 0.30).otherwise(0.0)
    )
    return out.select(
        "recording_id", "cutoff_hz", "has_vocoder_cutoff", "spectral_flatness", "silence_ratio", "high_freq_ratio",
        F.greatest(F.lit(0.05), F.least(F.lit(0.95), p)).alias("p_audio_ai"),
    )


def silence_and_level(samples: DataFrame, eight_bit: Column | None = None) -> DataFrame:
    """Silence share (NULL for 8-bit), RMS, peak, crest, clipping share, DC offset and the level status per recording."""
    x = C("value")
    agg = samples.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.abs(x) < 1e-5).cast("double")).alias("zero_share"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.max(F.abs(x)).alias("peak"),
        F.avg((F.abs(x) >= 0.999).cast("double")).alias("clipping_ratio"),
        F.avg(x).alias("dc_offset"),
    )
    crest = 20 * F.log10(F.greatest(C("peak"), F.lit(1e-9))) - 20 * F.log10(C("rms"))
    quiet = (C("n") < 1000) | (C("rms") < 1e-4)
    silent = C("zero_share") if eight_bit is None else F.when(~eight_bit, C("zero_share"))
    return agg.select(
        "recording_id", silent.alias("silence_ratio"), "rms", "peak", F.when(C("rms") > 0, crest).alias("crest_db"), "clipping_ratio", "dc_offset",
        F.when(quiet, "NOT_APPLICABLE").when(C("clipping_ratio") > 0.001, "WARN").otherwise("INFO").alias("status"),
    )


def dynamic_range_db(samples: DataFrame, rate: int, frame_ms: float = 50.0) -> DataFrame:
    """20 log10(p95 / p10) of the RMS of whole short frames, digital silence left out; 0 with fewer than two frames."""
    frame = max(1, int(rate * frame_ms / 1000))
    sizes = samples.groupBy("recording_id").agg(F.expr(f"(max(idx) + 1) div {frame}").alias("frames"))
    rms = samples.groupBy("recording_id", cut("idx", frame).alias("f")).agg(F.sqrt(F.avg(C("value") * C("value"))).alias("rms"))
    kept = rms.join(sizes, "recording_id").where((C("f") < C("frames")) & (C("rms") > 1e-5))
    q = exact_quantiles(kept, ["recording_id"], "rms", {"p95": 0.95, "p10": 0.10})
    ok = (C("frames") >= 2) & (C("n_measured") >= 2)
    db = 20 * F.log10(C("p95") / F.greatest(F.lit(1e-9), C("p10")))
    return sizes.join(q, "recording_id", "left").select("recording_id", F.when(ok, db).otherwise(0.0).alias("dynamic_range_db"))


def audio_scene(spectrum: DataFrame, levels: DataFrame, rate: int, bins: int) -> DataFrame:
    """Dominant sound type, delivery and level per recording. ``levels``: recording_id, rms, peak."""
    m = mean_spectrum(spectrum, rate, bins)
    voice = C("hz").between(*SPEECH_BAND)
    agg = m.groupBy("recording_id").agg(
        (F.sum("mag") + 1e-10).alias("total"),
        F.sum(F.when(voice, C("mag")).otherwise(0.0)).alias("voice"),
        F.sum(F.when(C("hz") > SCENE["high_from"], C("mag")).otherwise(0.0)).alias("high"),
        (F.exp(F.avg(F.ln(C("mag") + 1e-10))) / (F.avg("mag") + 1e-10)).alias("flatness"),
    )
    x = agg.join(levels, "recording_id", "left").withColumns(
        {
            "speech_ratio": F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("voice") / C("total"))),
            "crest_factor": C("peak") / F.greatest(F.lit(1e-6), C("rms")),
        }
    )
    kind = (
        F.when(C("speech_ratio") > SCENE["speech"], "SPEECH_LIKE")
        .when((C("high") / C("total") > SCENE["high"]) & (C("flatness") < SCENE["flat"]), "MUSIC_LIKE")
        .otherwise("AMBIENT")
    )
    delivery = F.when(C("crest_factor") > SCENE["dynamic"], "DYNAMIC").when(C("crest_factor") < SCENE["compressed"], "COMPRESSED").otherwise("NATURAL")
    level = F.when(C("rms") > SCENE["strong_rms"], "STRONG").otherwise("LOW")
    return x.select("recording_id", kind.alias("dominant"), delivery.alias("delivery"), level.alias("signal_level"), "speech_ratio", "crest_factor")


def telephony_band(spectrum: DataFrame, rate: int, bins: int) -> DataFrame:
    """High and low band power against 300-3400 Hz in dB, and the two band-limit flags."""
    hz = C("bin") * (rate / 2.0 / (bins - 1))

    def band(lo: float, hi: float) -> Column:
        return F.sum(F.when(hz.between(lo, hi), C("magnitude") * C("magnitude")).otherwise(0.0)) + 1e-20

    agg = spectrum.groupBy("recording_id").agg(
        band(300, 3400).alias("mid"), band(3800, min(7800, rate / 2 - 1)).alias("hf"), band(20, 200).alias("lf")
    )
    hf_db, lf_db = 10 * F.log10(C("hf") / C("mid")), 10 * F.log10(C("lf") / C("mid"))
    return agg.select(
        "recording_id", hf_db.alias("hf_ratio_db"), lf_db.alias("lf_ratio_db"), (hf_db <= -35.0).alias("band_limited"),
        ((hf_db <= -35.0) & (lf_db <= -20.0)).alias("narrowband"),
    )


def bandwidth_step(spectrum: DataFrame, rate: int, bins: int, first: float = 4000.0, width: float = 250.0) -> DataFrame:
    """Edge of the largest drop between the four bands before and after it, and the high-resolution verdict.

    Input: recording_id, bin, db. Needs twelve bands, a drop of 25 dB and a quiet upper part (deviation at most 6 dB).
    """
    hz = C("bin") * (rate / 2.0 / (bins - 1))
    edges = int(-(-(rate / 2.0 - 250.0 - first) // width))
    banded = spectrum.withColumn("band", F.floor((hz - first) / width)).where((C("band") >= 0) & (C("band") < edges))
    means = banded.groupBy("recording_id", "band").agg(F.avg("db").alias("m"))
    w = W.partitionBy("recording_id").orderBy("band")
    by_rec = W.partitionBy("recording_id")
    steps = means.withColumns(
        {
            "drop": F.avg("m").over(w.rowsBetween(-4, -1)) - F.avg("m").over(w.rowsBetween(0, 3)),
            "i": F.row_number().over(w) - 1,
            "n": F.count(F.lit(1)).over(by_rec),
        }
    )
    inner = (C("i") >= 4) & (C("i") < C("n") - 4) & (C("drop") > 0)
    best = steps.withColumn("_best", F.max(F.when(inner, F.struct(C("drop"), (-C("i")).alias("ni")))).over(by_rec))
    agg = best.groupBy("recording_id").agg(
        F.max("_best").alias("b"), F.max("n").alias("n"), F.stddev_pop(F.when(C("i") > -C("_best.ni"), C("m"))).alias("sd"),
        F.count(F.when(C("i") > -C("_best.ni"), C("m"))).alias("above"), F.max(F.when(C("i") == -C("_best.ni"), C("band"))).alias("edge_band"),
    )
    found = (C("n") >= 12) & (C("b.drop") >= 25.0) & ~((C("above") >= 4) & (C("sd") > 6.0))
    cutoff = F.when(found, C("edge_band") * width + first)
    mid_rate = 32000 <= rate <= 64000
    up = F.lit(rate >= 88200) & (C("cutoff_hz") <= 24000) | F.lit(mid_rate) & (C("cutoff_hz") < 15000)
    lossy = F.lit(mid_rate) & (C("cutoff_hz").between(15000, 16800) | C("cutoff_hz").between(18000, 20800))
    return agg.withColumn("cutoff_hz", cutoff).select(
        "recording_id", "cutoff_hz", F.when(up, "UPSAMPLED_FROM_LOWER_RATE").when(lossy, "POSSIBLE_LOSSY_ORIGIN").otherwise("NO_ANOMALY").alias("verdict")
    )


def fingerprint_bits(energies: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(recording_id, frame, bits): 32 bits per frame, the sign over time of adjacent-band energy differences; the first frame is dropped.

    Input: recording_id, frame, bands (array of at least 33 energies).
    """
    s = prefix_scan(energies, ["recording_id"], ["frame"], last={"before": C("bands")}, chunk=cut("frame", chunk)).where("before IS NOT NULL")
    bits = F.expr(
        "aggregate(sequence(0, 31), 0L, (acc, b) -> acc + IF((bands[b] - bands[b + 1]) - (before[b] - before[b + 1]) > 0, shiftleft(1L, b), 0L))"
    )
    return s.select("recording_id", "frame", bits.alias("bits"))
