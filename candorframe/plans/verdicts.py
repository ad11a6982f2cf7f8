"""The whole way from files and raw scores to one explained verdict per media item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.functions.labels import classify_band, verdict_headline
from candorframe.functions.scoring import normalise_with_margin, shift_log_odds, undecided_margin
from candorframe.operators.evidence import cap_evidence, decide
from candorframe.operators.identity import apply_gates, hard_block_gate

C = F.col
_SHORT = {"image": "img", "video": "vid", "audio": "aud"}


def modality_percentages(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(media_id, modality, ai, real, undecided): each score shifted by the media's capped findings, with the margin its entropy asks for."""
    total = cap_evidence(findings).groupBy("media_id").agg(F.sum("term").alias("total"))
    p = shift_log_odds(C("p_ai"), C("total"))
    shifted = scores.join(total, "media_id", "left").withColumn("p", p)
    shifted = shifted.withColumn("margin", undecided_margin(C("p"), C("modality")))
    x = normalise_with_margin(C("p") * 100, (1 - C("p")) * 100, C("margin"))
    return shifted.select("media_id", "modality", x.alias("x")).select("media_id", "modality", "x.*")


def media_verdicts(files: DataFrame, blocklist: DataFrame | None, scores: DataFrame, findings: DataFrame, facts: DataFrame) -> DataFrame:
    """(media_id, final_status, taxonomy_state, p_ai, p_real, p_undecided, ai_detected, band, headline).

    ``files``: media_id, sha256, recognised. ``scores``: media_id, modality, p_ai. ``findings``: as for ``cap_evidence``. ``facts``: one row
    per media with readable, is_blank, img_state, img_label, face_flag, face_worst_p, enhancer, manifest_ai, metadata_ai. Gated files leave
    before any score is joined.
    """
    blocked, open_ = apply_gates(hard_block_gate(files, blocklist))
    keys = open_.select("media_id")
    percent = modality_percentages(scores.join(keys, "media_id", "left_semi"), findings)
    wide = percent.groupBy("media_id").agg(
        *[F.max(F.when(C("modality") == m, C(src))).alias(f"{short}_{dst}") for m, short in _SHORT.items() for src, dst in (("ai", "ai"), ("real", "real"), ("undecided", "und"))]
    )
    state = F.when(C("img_ai").isNotNull(), C("img_state"))
    rows = keys.join(facts, "media_id").join(wide, "media_id", "left").withColumn("img_state", state)
    decided = decide(rows).select("media_id", "final_status", "taxonomy_state", "p_ai", "p_real", "p_undecided", "ai_detected")
    gated = blocked.select("media_id", "final_status", F.lit("UNDETERMINED").alias("taxonomy_state"), "p_ai", "p_real", "p_undecided", "ai_detected")
    shown = decided.withColumn("band", classify_band(C("p_ai") / 100)).unionByName(gated, allowMissingColumns=True)
    return shown.withColumn("headline", verdict_headline(C("taxonomy_state"), C("final_status"))["headline"])
