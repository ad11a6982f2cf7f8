"""From findings and modality results to one explained verdict per media item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.functions.decisions import AI_CLAIMING, AI_STATUSES, REAL_LEANING, SCORE_BACKED, final_status, taxonomy_from_fused
from candorframe.functions.scoring import PRIORS, clip, finite, normalise_by_gap, probability10
from candorframe.operators.ordering import CHUNK, prefix_scan
from candorframe.functions.whitespace import strip

# Classes that may carry log-odds, classes that reach the trail, the total cap and the display stage order.
SCORED_CLASSES = ["PHYSICAL_SIGNAL", "LEARNED_SIGNAL", "METADATA_WEAK"]
TRAIL_CLASSES = ["SECURITY", "METADATA_WEAK", "PHYSICAL_SIGNAL", "LEARNED_SIGNAL"]
TOTAL_CAP = 0.40
REASON_STAGES = ["file_integrity", "metadata", "formats", "container", "signal", "faces"]
STATUSES = ["PASS", "WARN", "FAIL", "INFO", "NOT_APPLICABLE", "NOT_CALIBRATED", "RECOGNIZED_OOS", "ERROR"]

# Evidence weight per modality, and the (ai, real, weight) of the two kinds of declaration.
MODALITY_WEIGHT = {"image": 1.0, "audio": 1.0, "video": 1.2}
MANIFEST_DECLARATION = (98.0, 1.0, 2.0)
METADATA_DECLARATION = (95.0, 5.0, 1.5)


def cap_evidence(findings: DataFrame) -> DataFrame:
    """(media_id, check_id, term): each finding held to its own cap, summed per check, the media's total held to 0.40.

    The window runs over (media, check) sums, so its partitions are no longer than the list of checks.
    """
    llr, cap = finite(F.col("llr")), F.abs("llr_cap")
    used = findings.where(F.col("evidence_class").isin(SCORED_CLASSES) & llr.isNotNull() & (llr != 0))
    terms = used.groupBy("media_id", "check_id").agg(F.sum(F.greatest(-cap, F.least(cap, llr))).alias("term"))
    total = F.abs(F.sum("term").over(W.partitionBy("media_id")))
    return terms.select("media_id", "check_id", (F.col("term") * F.when(total > TOTAL_CAP, TOTAL_CAP / total).otherwise(1.0)).alias("term"))


def dimension_report(findings: DataFrame, order: list[str]) -> DataFrame:
    """Per media: total, one count per status, findings per stage (map) and the level of the first RELIABILITY finding that has one.

    The findings grouped by stage are the findings table itself; only bounded aggregates are gathered per media.
    """
    per_stage = findings.groupBy("media_id", "stage").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    )
    counts = per_stage.groupBy("media_id").agg(
        F.sum("n").alias("total"),
        *[F.sum(s.lower()).alias(s.lower()) for s in STATUSES],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "n")))).alias("by_stage"),
    )
    reliable = findings.where((F.col("evidence_class") == "RELIABILITY") & F.col("level").isNotNull())
    first = reliable.groupBy("media_id").agg(F.min(F.struct(*order, "level")).getField("level").alias("reliability_level"))
    return counts.join(first, "media_id", "left")


def evidence_trail(findings: DataFrame, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """(media_id, pos, line): FAIL and WARN findings of the weighty classes, stages in order of first appearance.

    ``order`` starts with the finding's number in its media. Lines are numbered inside (media, stage), which is cut into chunks of that
    number; the lines of earlier stages are added from one row per stage.
    """
    weighty = F.col("status").isin("FAIL", "WARN") & F.col("evidence_class").isin(TRAIL_CLASSES)
    stages = findings.groupBy("media_id", "stage").agg(F.min(F.struct(*order)).alias("_at"), F.count_if(weighty).alias("_lines"))
    before = W.partitionBy("media_id").orderBy("_at", "stage").rowsBetween(W.unboundedPreceding, -1)
    stages = stages.select("media_id", "stage", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_offset"))
    line = F.concat(F.lit("["), F.col("evidence_class"), F.lit("] "), F.col("title"), F.lit(": "), F.col("detail"))
    rows = findings.where(weighty).select("media_id", "stage", *order, line.alias("line"))
    inside = prefix_scan(
        rows, ["media_id", "stage"], [*order, "line"], sums={"_pos": F.lit(1).cast("bigint")}, chunk=F.expr(f"CAST({order[0]} AS BIGINT) div {chunk}")
    )
    return inside.join(stages, ["media_id", "stage"]).select("media_id", (F.col("_offset") + F.col("_pos")).alias("pos"), "line")


def key_reasons(reasons: DataFrame, findings: DataFrame, trail: DataFrame, order: list[str], limit: int = 4) -> DataFrame:
    """(media_id, rank, reason): taxonomy reasons, then flagged findings in stage order; the trail only if there is neither.

    Ranking is by row_number under a small limit, which Spark cuts per map task before the shuffle.
    """
    stage = F.array_position(F.array(*[F.lit(s) for s in REASON_STAGES]), F.col("stage"))
    flagged = findings.where(F.col("stage").isin(REASON_STAGES) & F.col("status").isin("FAIL", "WARN"))
    text = strip(F.concat(F.col("title"), F.lit(": "), F.coalesce("detail", F.lit(""))))
    own = reasons.select("media_id", F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("stage_no"), F.col("pos").cast("bigint").alias("at"), "reason")
    found = flagged.select("media_id", F.lit(1).alias("tier"), stage.cast("bigint").alias("stage_no"), F.col(order[0]).cast("bigint").alias("at"), text.alias("reason"))
    backup = trail.select("media_id", F.lit(2).alias("tier"), F.lit(0).cast("bigint").alias("stage_no"), F.col("pos").cast("bigint").alias("at"), F.col("line").alias("reason"))
    pool = own.unionByName(found).unionByName(backup).where(strip("reason") != "")
    w = W.partitionBy("media_id").orderBy("tier", "stage_no", "at", "reason")
    top = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    best = F.min("tier").over(W.partitionBy("media_id"))
    return top.withColumn("_best", best).where((F.col("tier") < 2) | (F.col("_best") == 2)).select("media_id", "rank", "reason")


def union_phases(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Findings of both phases with the phase number, before the report is built."""
    return pre.withColumn("phase", F.lit(0)).unionByName(post.withColumn("phase", F.lit(1)), allowMissingColumns=True)


def evidence_weight(base: Column, undecided: Column) -> Column:
    return base * clip(1 - F.coalesce(undecided, F.lit(0.0)) / 100, 0.0, 1.0)


def evidence_rows(results: DataFrame, declarations: DataFrame) -> DataFrame:
    """(media_id, ai_pct, real_pct, weight) rows from modality results and from declared-AI provenance (kind manifest / metadata)."""
    base = F
    for name, w in MODALITY_WEIGHT.items():
        base = base.when(F.col("modality") == name, F.lit(w))
    measured = results.where((F.col("modality") == "video") | (F.col("ai_pct") > 0) | (F.col("real_pct") > 0))
    rows = measured.select("media_id", "ai_pct", "real_pct", evidence_weight(base, F.col("undecided_pct")).alias("weight"))
    best = declarations.groupBy("media_id").agg(F.max(F.when(F.col("kind") == "manifest", 1).otherwise(0)).alias("m"))

    def pick(i: int) -> Column:
        return F.when(F.col("m") == 1, MANIFEST_DECLARATION[i]).otherwise(METADATA_DECLARATION[i])

    return rows.unionByName(best.select("media_id", pick(0).alias("ai_pct"), pick(1).alias("real_pct"), pick(2).alias("weight")))


def log_ratio(ai_pct: Column, real_pct: Column) -> Column:
    """Natural-log odds of two percentages clipped to [1e-4, 1 - 1e-4]."""
    return F.ln(clip(ai_pct / 100, 1e-4, 1 - 1e-4) / clip(real_pct / 100, 1e-4, 1 - 1e-4))


def logistic(pooled: Column) -> Column:
    """Probability of pooled natural log-odds held within +/-6."""
    return 1 / (1 + F.exp(-clip(pooled, -6.0, 6.0)))


def fuse_modalities(evidence: DataFrame) -> DataFrame:
    """(media_id, p_ai, p_real, p_undecided) from weighted natural-log-odds pooling, one partial sum per map task."""
    pooled = evidence.groupBy("media_id").agg(F.sum(F.col("weight") * log_ratio(F.col("ai_pct"), F.col("real_pct"))).alias("pooled"))
    p = pooled.select("media_id", logistic(F.col("pooled")).alias("p"))
    return p.select("media_id", normalise_by_gap(F.col("p") * 100, (1 - F.col("p")) * 100).alias("f")).select(
        "media_id", F.col("f.ai").alias("p_ai"), F.col("f.real").alias("p_real"), F.col("f.undecided").alias("p_undecided")
    )


def pool_log_odds(terms: DataFrame, sensitivity: str = "balanced") -> DataFrame:
    """(media_id, log_odds, p_ai) from a long table of base-10 terms (media_id, term, value); smoothness counts 0.70 next to noise."""
    prior = PRIORS.get(sensitivity.lower(), 0.0)
    smooth = F.col("term") == "surface_smoothness"
    sums = terms.groupBy("media_id").agg(
        F.sum(F.when(smooth, 0.0).otherwise(F.col("value"))).alias("rest"),
        F.sum(F.when(smooth, F.col("value")).otherwise(0.0)).alias("smooth"),
        F.bool_or(F.col("term") == "sensor_noise").alias("has_noise"),
    )
    total = F.lit(prior) + F.col("rest") + F.col("smooth") * F.when(F.col("has_noise"), 0.70).otherwise(1.0)
    return sums.select("media_id", total.alias("log_odds"), probability10(clip(total, -6.0, 6.0)).alias("p_ai"))


def cross_modal_consistency(video: DataFrame, audio: DataFrame) -> DataFrame:
    """Left join of a clip's video result (media_id, vid_ai, outdoor) with its audio result (media_id, aud_ai, silence_ratio)."""
    gap = F.abs(F.col("vid_ai") - F.col("aud_ai"))
    apart = (gap >= 40.0).cast("int")
    quiet = (F.coalesce("outdoor", F.lit(False)) & (F.coalesce("silence_ratio", F.lit(0.0)) > 0.15)).cast("int")
    alone = F.col("aud_ai").isNull()
    n = F.when(~alone, apart + quiet)
    return video.join(audio, "media_id", "left").select(
        "media_id",
        F.when(alone, "SINGLE_MODALITY_VIDEO").when(n >= 2, "CROSS_MODAL_INCONSISTENT").when(n == 1, "SUSPICIOUS_ASYMMETRY")
        .otherwise("CROSS_MODAL_COHERENT").alias("status"),
        F.when(alone, 0.0).otherwise(F.round(gap, 1)).alias("asymmetry_score"),
        F.when(alone, F.lit("LOW")).when(n >= 2, "HIGH").when(n == 1, "MEDIUM").otherwise("LOW").alias("tampering_risk"),
        F.coalesce(n, F.lit(0)).alias("anomalies"),
    )


def decide(df: DataFrame) -> DataFrame:
    """Final decision of one wide row per media.

    Input: media_id, readable, is_blank, img_ai/img_real/img_und/img_label/img_state, face_flag, face_worst_p, enhancer, vid_ai/vid_real/vid_und,
    aud_ai/aud_real/aud_und, manifest_ai, metadata_ai. A NULL percentage means the modality was not measured.
    """
    c = F.col
    w = MODALITY_WEIGHT

    def term(name: str, present: Column) -> Column:
        return F.when(
            present, evidence_weight(F.lit(w[{"img": "image", "vid": "video", "aud": "audio"}[name]]), c(f"{name}_und")) * log_ratio(c(f"{name}_ai"), c(f"{name}_real"))
        )

    img = F.coalesce((c("img_ai") > 0) | (c("img_real") > 0), F.lit(False))
    vid = c("vid_ai").isNotNull()
    aud = F.coalesce((c("aud_ai") > 0) | (c("aud_real") > 0), F.lit(False))
    declared = c("manifest_ai") | c("metadata_ai")
    m, d = MANIFEST_DECLARATION, METADATA_DECLARATION
    said = F.when(c("manifest_ai"), F.lit(m[2]) * log_ratio(F.lit(m[0]), F.lit(m[1]))).when(
        c("metadata_ai"), F.lit(d[2]) * log_ratio(F.lit(d[0]), F.lit(d[1]))
    )
    zero = F.lit(0.0)
    pooled = F.coalesce(term("img", img), zero) + F.coalesce(term("vid", vid), zero) + F.coalesce(term("aud", aud), zero) + F.coalesce(said, zero)
    any_evidence = img | vid | aud | declared
    alone = c("img_state").isNotNull() & ~vid & ~F.coalesce(c("aud_ai") + c("aud_real") > 0, F.lit(False))

    # Each stage is a column of its own: the later ones mention the earlier ones many times.
    step = df.withColumns({"_pooled": pooled, "_any": any_evidence, "_alone": alone, "_declared": declared})
    step = step.withColumn("_p", logistic(c("_pooled"))).withColumn("_f", normalise_by_gap(c("_p") * 100, (1 - c("_p")) * 100))
    step = step.withColumns(
        {
            "_ai": F.when(c("_alone"), c("img_ai")).otherwise(c("_f.ai")),
            "_real": F.when(c("_alone"), c("img_real")).otherwise(c("_f.real")),
            "_und": F.when(c("_alone"), F.coalesce("img_und", F.lit(0.0))).otherwise(c("_f.undecided")),
            "_fused_status": final_status(c("_f.ai"), c("_f.real")),
        }
    )
    status0 = F.when(c("_alone"), F.coalesce("img_label", "_fused_status")).otherwise(c("_fused_status"))
    backed = c("img_state").isin(SCORE_BACKED)
    override = (
        F.when(~c("_alone"), F.lit(None))
        .when(backed & c("face_flag"), "face_looks_ai")
        .when(c("img_state").isin(AI_CLAIMING) & (F.coalesce("face_worst_p", F.lit(1.0)) < 0.10), "face_disagrees")
        .when(backed & (final_status(c("_ai"), c("_real")) != "LIKELY_AUTHENTIC"), "score_too_close")
    )
    step = step.withColumns({"_s0": status0, "_o1": override})
    step = step.withColumn("_s1", F.when(c("_o1").isNotNull(), "UNDETERMINED").otherwise(c("_s0")))
    step = step.withColumn(
        "_t1",
        F.when(c("_o1").isin("face_looks_ai", "face_disagrees"), "UNDETERMINED")
        .when(c("_o1") == "score_too_close", taxonomy_from_fused(F.lit("UNDETERMINED"), c("_ai"), c("_real")))
        .when(c("_alone"), c("img_state"))
        .otherwise(taxonomy_from_fused(c("_s1"), c("_ai"), c("_real"))),
    )
    conflict = c("_declared") & c("_s1").isin(REAL_LEANING)
    step = step.withColumns(
        {
            "_s2": F.when(conflict, "UNDETERMINED").otherwise(c("_s1")),
            "_t2": F.when(conflict, taxonomy_from_fused(F.lit("UNDETERMINED"), c("_ai"), c("_real"))).otherwise(c("_t1")),
            "_o2": F.when(conflict, "declared_ai_conflict").otherwise(c("_o1")),
        }
    )
    means_ai = c("_s2").isin(AI_STATUSES) | (~c("_s2").isin("UNDETERMINED", "UNDECIDED", "BLANK_OR_DEGRADED", *REAL_LEANING) & (c("_ai") >= 50.0))
    terminal = F.when(~c("readable"), "INVALID_FILE").when(c("is_blank"), "BLANK_OR_DEGRADED").when(~c("_any"), "UNDETERMINED")
    open_ = terminal.isNull()
    return step.select(
        "media_id",
        F.coalesce(terminal, c("_s2")).alias("final_status"),
        F.when(open_, c("_t2")).otherwise("UNDETERMINED").alias("taxonomy_state"),
        F.when(open_, c("_ai")).otherwise(0.0).alias("p_ai"),
        F.when(open_, c("_real")).otherwise(0.0).alias("p_real"),
        F.when(open_, c("_und")).otherwise(100.0).alias("p_undecided"),
        F.when(open_, means_ai).otherwise(False).alias("ai_detected"),
        F.when(open_, F.when(c("_alone"), "image_authoritative").otherwise("fused")).alias("decision_mode"),
        F.when(open_, c("_o2")).alias("override_reason"),
        F.when(open_, c("_t2").isin("AUTHENTIC_REAL_PHOTOGRAPH", "AUTHENTIC_EDITED") & ~c("enhancer")).otherwise(False).alias("drops_generator"),
    )


def batch_table(results: DataFrame) -> DataFrame:
    """One display row per input. Input: pos, filename, success, gate_blocked, error, headline, p_ai, band, origin."""
    c = F.col
    shown = c("success") & ~c("gate_blocked")
    return results.select(
        "pos",
        F.coalesce("filename", F.lit("unknown")).alias("file"),
        F.when(~c("success"), "Could not process").when(c("gate_blocked"), "Blocked by a safety gate: not analysed").otherwise(c("headline")).alias("verdict"),
        F.when(shown, F.round("p_ai", 1)).alias("ai_likelihood"),
        F.when(shown, c("band")).alias("band"),
        F.when(shown, c("origin")).alias("origin_guess"),
        F.when(~c("success"), F.coalesce("error", F.lit(""))).when(c("gate_blocked"), "see the file's own page").alias("note"),
    )
