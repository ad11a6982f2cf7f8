"""Verdict rules over one wide row per media item: taxonomy, face blend, final decision, provenance, open set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candorframe.functions.labels import classify_band

# Score limits of the taxonomy stages.
INPAINT_MIN = 35.0
COMPOSITE_MIN = 60.0
ART_MIN = 58.0

# State sets of the decision rule.
SCORE_BACKED = ["AUTHENTIC_REAL_PHOTOGRAPH", "AUTHENTIC_EDITED", "AUTHENTIC_RECAPTURED_SCREEN"]
AI_CLAIMING = ["FULLY_AI_GENERATED", "AI_ENHANCED_COMPOSITE", "PROCEDURAL_CGI_SYNTHETIC"]
REAL_LEANING = ["LIKELY_AUTHENTIC", "LIKELY REAL", "AUTHENTIC (CONVENTIONALLY EDITED)", "AUTHENTIC_EDITED"]
AI_STATUSES = [
    "LIKELY_SYNTHETIC", "PARTIALLY_SYNTHETIC_OR_EDITED", "LIKELY AI-GENERATED", "AI-ENHANCED / COMPOSITE", "PROCEDURAL CGI SYNTHETIC",
]


def _codes(*pairs: tuple[Column | None, str]) -> Column:
    """Reason codes whose condition holds, in order (None = always)."""
    return F.array_compact(F.array(*[F.lit(code) if cond is None else F.when(cond, F.lit(code)) for cond, code in pairs]))


def _outcome(state: str, reasons: Column) -> Column:
    return F.struct(F.lit(state).alias("state"), reasons.alias("reasons"))


def image_taxonomy(c: dict[str, Column]) -> Column:
    """struct(state, reasons) by nine ordered stages; the first that applies decides.

    ``c``: ai_pct, real_pct, noise, smooth, is_screenshot, watermark, ai_iptc, pure_ai_meta, enhancer, composite_label, inpainted, is_art,
    cgi_medium, has_camera, camera_make, is_scanned, is_cutout, canvas_match, metadata_absent, synthetic_signals, recapture, graphic_edit,
    text_count, optics.
    """
    ai, art = c["ai_pct"], c["is_art"]
    declares = c["watermark"] | c["ai_iptc"] | c["pure_ai_meta"]
    plain = ~c["has_camera"] & ~c["is_scanned"]

    screen_ai = declares | (ai >= 62.0) | (art & (ai >= ART_MIN))
    screen = (
        F.when(
            screen_ai,
            _outcome("AI_GENERATED_SCREENSHOT", _codes((None, "screen_capture"), (c["watermark"], "watermark"), (c["ai_iptc"], "ai_label"), (art, "digital_art"))),
        )
        .when(
            c["enhancer"] | c["inpainted"],
            _outcome("AI_ENHANCED_SCREENSHOT", _codes((None, "screen_capture"), (c["inpainted"], "inpainting"), (c["enhancer"], "enhancer"))),
        )
        .otherwise(_outcome("AUTHENTIC_SCREENSHOT", _codes((None, "screen_capture"), (None, "no_ai_sign"))))
    )
    synthesis = F.when(
        art & c["cgi_medium"] & ~declares, _outcome("PROCEDURAL_CGI_SYNTHETIC", _codes((None, "cgi_rendering"), (None, "no_camera_grain")))
    ).otherwise(
        _outcome(
            "FULLY_AI_GENERATED",
            _codes(
                (c["watermark"], "watermark"), (c["ai_iptc"], "ai_label"), (c["pure_ai_meta"], "generator_metadata"), (art, "digital_art"),
                (art, "non_optical_rendering"), (art & c["is_cutout"], "cutout_asset"), (~art, "pixel_metrics"), (c["canvas_match"], "canvas_size"),
            ),
        )
    )
    inpaint_counts = c["inpainted"] & (ai >= COMPOSITE_MIN)
    composite = _outcome(
        "AI_ENHANCED_COMPOSITE",
        _codes((inpaint_counts, "inpainting"), (c["enhancer"], "enhancer"), (c["enhancer"] & c["camera_make"].isNotNull(), "camera_base")),
    )
    altered = _outcome("AI_ENHANCED_COMPOSITE", _codes((None, "camera_tags"), (None, "pixel_evidence_against_camera")))
    pixels = _outcome(
        "FULLY_AI_GENERATED",
        _codes((None, "high_posterior"), (None, "over_smooth"), (c["canvas_match"], "canvas_size"), (c["is_cutout"], "cutout_asset")),
    )
    recapture = _outcome("AUTHENTIC_RECAPTURED_SCREEN", _codes((None, "screen_recapture"), (c["camera_make"].isNotNull(), "camera_base")))
    typography = c["text_count"] >= 3
    edited = _outcome(
        "AUTHENTIC_EDITED",
        _codes((c["is_cutout"], "background_removed"), (c["graphic_edit"], "graphic_software"), (typography, "typography"), (None, "noise_not_ai")),
    )
    cutout_ai = _outcome("FULLY_AI_GENERATED", _codes((None, "isolated_subject"), (None, "no_camera_grain")))
    local = _outcome("AUTHENTIC_EDITED", _codes((None, "uneven_noise"), (None, "ordinary_processing")))
    default = F.when(c["is_scanned"], _outcome("AUTHENTIC_REAL_PHOTOGRAPH", _codes((None, "print_scan"), (None, "scan_consistent")))).otherwise(
        _outcome(
            "AUTHENTIC_REAL_PHOTOGRAPH", _codes((c["camera_make"].isNotNull(), "camera_tags"), (c["optics"], "lens_parameters"), (None, "nothing_found"))
        )
    )

    edit_stage = c["is_cutout"] | c["graphic_edit"] | (typography & ~art)
    edit_real = (c["has_camera"] | (c["noise"] >= 1.35) | (c["real_pct"] >= 50.0)) & (ai < 50.0)
    real_noise = (c["noise"] > 1.85) & (c["smooth"] > 1.60)
    uncorroborated = c["metadata_absent"] & (c["synthetic_signals"] < 2)
    by_pixels = ((ai >= 58.0) | ((ai >= 48.0) & c["canvas_match"])) & plain & ~real_noise & ~uncorroborated
    return (
        F.when(c["is_screenshot"], screen)
        .when(declares | (art & plain & (ai >= ART_MIN)), synthesis)
        .when(c["enhancer"] | c["composite_label"] | inpaint_counts, composite)
        .when(c["has_camera"] & ~c["is_scanned"] & (ai >= 62.0), altered)
        .when(by_pixels, pixels)
        .when(c["recapture"], recapture)
        .when(edit_stage & edit_real, edited)
        .when(edit_stage & ((ai >= 50.0) | (c["noise"] < 1.10)), cutout_ai)
        .when(c["inpainted"] & ~c["is_scanned"] & (ai < INPAINT_MIN), local)
        .otherwise(default)
    )


def face_led_blend(ai: Column, real: Column, undecided: Column, state: Column, face_p: Column) -> Column:
    """struct(ai, real, undecided, state, blended): a dominant face at 0.95 or more leads the score, upwards only."""
    mixed = F.round(ai * 0.35 + face_p * 65.0, 1)
    exempt = F.coalesce(state.isin("AI_GENERATED_SCREENSHOT", "AI_ENHANCED_SCREENSHOT"), F.lit(False))
    leads = F.coalesce((face_p >= 0.95) & ~exempt & (mixed > ai), F.lit(False))
    und = F.least(undecided, 100 - mixed)
    upgrade = leads & (mixed >= 65.0) & (state.isNull() | state.isin(SCORE_BACKED))
    return F.struct(
        F.when(leads, mixed).otherwise(ai).alias("ai"),
        F.when(leads, F.round(100 - mixed - und, 1)).otherwise(real).alias("real"),
        F.when(leads, F.round(und, 1)).otherwise(undecided).alias("undecided"),
        F.when(upgrade, "FULLY_AI_GENERATED").otherwise(state).alias("state"),
        leads.alias("blended"),
    )


def final_status(p_ai: Column, p_real: Column) -> Column:
    return (
        F.when(p_ai >= 65.0, "LIKELY_SYNTHETIC")
        .when((p_real >= 55.0) & (p_ai < 35.0), "LIKELY_AUTHENTIC")
        .when(p_ai >= 50.0, "PARTIALLY_SYNTHETIC_OR_EDITED")
        .otherwise("UNDETERMINED")
    )


def taxonomy_from_fused(status: Column, p_ai: Column, p_real: Column) -> Column:
    return (
        F.when((status == "UNDETERMINED") & (p_ai < 50.0), "UNDETERMINED")
        .when(status.isin("LIKELY_SYNTHETIC", "LIKELY AI-GENERATED") | (p_ai >= 65.0), "FULLY_AI_GENERATED")
        .when(status.isin("PARTIALLY_SYNTHETIC_OR_EDITED", "AI-ENHANCED / COMPOSITE") | (p_ai >= 40.0), "AI_ENHANCED_COMPOSITE")
        .when(status.isin("AUTHENTIC (CONVENTIONALLY EDITED)", "AUTHENTIC_EDITED"), "AUTHENTIC_EDITED")
        .when(status.isin("LIKELY_AUTHENTIC", "LIKELY REAL") | (p_real >= 60.0), "AUTHENTIC_REAL_PHOTOGRAPH")
        .otherwise("UNDETERMINED")
    )


def provenance_verdict(c: dict[str, Column]) -> Column:
    """struct(verdict, ai_confidence, c2pa_status); presence only, never 'verified'. ``c``: c2pa_present, ai_declaration, is_signed,
    ai_signature, camera_make, camera_model."""

    def row(verdict: str, conf: float) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(conf).alias("ai_confidence"))

    here = c["c2pa_present"]
    verdict = (
        F.when(here & c["ai_declaration"], row("C2PA_DECLARED_SYNTHETIC", 0.98))
        .when(here & c["is_signed"], row("C2PA_SIGNATURE_MARKER_UNVERIFIED", 0.50))
        .when(here, row("C2PA_PRESENT_UNVERIFIED", 0.50))
        .when(c["ai_signature"], row("METADATA_DECLARED_SYNTHETIC", 0.95))
        .when(c["camera_make"].isNotNull() & c["camera_model"].isNotNull(), row("HARDWARE_EXIF_PRESENT", 0.25))
        .otherwise(row("PROVENANCE_UNKNOWN", 0.50))
    )
    status = (
        F.when(~here, "NO_C2PA")
        .when(c["ai_declaration"], "AI_DECLARED_CREDENTIALS")
        .when(c["is_signed"], "SIGNATURE_MARKER_UNVERIFIED")
        .otherwise("UNVERIFIED_MANIFEST")
    )
    return F.struct(verdict.getField("verdict").alias("verdict"), verdict.getField("ai_confidence").alias("ai_confidence"), status.alias("c2pa_status"))


def open_set_flag(model_key: Column, ai_pct: Column) -> Column:
    """struct(unknown_source, band): unknown generator with an AI score of 60 or more; the band is NULL without a score."""
    return F.struct(
        F.coalesce((model_key == "unknown") & (ai_pct >= 60.0), F.lit(False)).alias("unknown_source"),
        F.when(ai_pct.isNotNull(), classify_band(ai_pct / 100)).alias("band"),
    )


def validate_media(c: dict[str, Column], max_mb: float = 10.0, min_side: int = 64) -> Column:
    """struct(error, quality flags, quality_score): the first failed rule, or the measured quality. ``c``: ext, size_mb, w, h, blur, mean,
    contrast, channel_std."""
    from candorframe.functions.labels import MEDIA_EXTENSIONS

    error = (
        F.when(~c["ext"].isin(MEDIA_EXTENSIONS["image"]), "unsupported_extension")
        .when(c["size_mb"] > max_mb, "too_large")
        .when((c["w"] < min_side) | (c["h"] < min_side), "too_small")
    )
    blurry, under, over, flat = c["blur"] < 80.0, c["mean"] < 35.0, c["mean"] > 225.0, c["contrast"] < 25.0
    score = (
        F.lit(1.0) - F.when(blurry, 0.30).otherwise(0.0) - F.when(under | over, 0.25).otherwise(0.0) - F.when(flat, 0.20).otherwise(0.0)
    )
    ok = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(ok, c["channel_std"] < 1.0).alias("is_blank"),
        F.when(ok, blurry).alias("is_blurry"),
        F.when(ok, under).alias("is_underexposed"),
        F.when(ok, over).alias("is_overexposed"),
        F.when(ok, F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 2)).alias("quality_score"),
    )
