"""Detection boxes: overlaps, best matches, suppression, face-person pairs, screening summaries.

Boxes of one image meet only where they share a grid cell, so an image is never compared all against all. Order-dependent choices are rounds of
joins over all images at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.functions.subjects import classify_minor
from candorframe.session import durable

C = F.col
CELL = 128.0

# Suppression, matching and texture limits.
MERGE_IOU = 0.40
MATCH_IOU = 0.5
FACE_GROW = 0.3
TEXTURE = {"waxy": 3.2, "noise": 1.8, "high": 0.70, "suspicious": 0.45}


def _cells(x: Column, y: Column, x1: Column, y1: Column, cell: float) -> Column:
    """One row per grid cell that the box touches."""

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / cell), F.floor(hi / cell))

    return F.explode(F.flatten(F.transform(span(x, x1), lambda i: F.transform(span(y, y1), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def _side(df: DataFrame, prefix: str, keep: list[str], cell: float) -> DataFrame:
    cols = [C(c).alias(f"{prefix}_{c}") for c in (*keep, "x", "y", "w", "h")]
    return df.where("w > 0 AND h > 0").select("image_id", *cols, _cells(C("x"), C("y"), C("x") + C("w"), C("y") + C("h"), cell).alias("cell"))


def overlap_pairs(a: DataFrame, b: DataFrame, keep: list[str], distinct: Column | None = None, cell: float = CELL) -> DataFrame:
    """(image_id, a_*, b_*, iou) for boxes of one image that overlap. ``distinct`` is a condition on a_* and b_* columns.

    A pair that shares several cells is emitted by the cell that holds the upper left corner of its intersection.
    """
    j = _side(a, "a", keep, cell).join(_side(b, "b", keep, cell), ["image_id", "cell"])
    if distinct is not None:
        j = j.where(distinct)
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    iw = F.least(C("a_x") + C("a_w"), C("b_x") + C("b_w")) - left
    ih = F.least(C("a_y") + C("a_h"), C("b_y") + C("b_h")) - top
    home = (F.floor(left / cell) == C("cell.i")) & (F.floor(top / cell) == C("cell.j"))
    hit = j.withColumns({"_iw": iw, "_ih": ih}).where((C("_iw") > 0) & (C("_ih") > 0) & home)
    inter = C("_iw") * C("_ih")
    return hit.withColumn("iou", inter / (C("a_w") * C("a_h") + C("b_w") * C("b_h") - inter)).drop("cell", "_iw", "_ih")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Join of ``points`` (image_id, px, py, ...) with the ``boxes`` (image_id, x, y, x1, y1, ...) that contain them, edges included."""
    p = points.withColumn("cell", F.struct(F.floor(C("px") / cell).alias("i"), F.floor(C("py") / cell).alias("j")))
    sound = boxes.where("x1 >= x AND y1 >= y")
    b = sound.withColumn("cell", _cells(C("x"), C("y"), C("x1"), C("y1"), cell))
    return p.join(b, ["image_id", "cell"]).where(C("px").between(C("x"), C("x1")) & C("py").between(C("y"), C("y1"))).drop("cell")


def iou_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, a_box_id, b_box_id, iou) of overlapping boxes; a pair that is absent has IoU 0."""
    return overlap_pairs(a, b, ["box_id"]).select("image_id", "a_box_id", "b_box_id", "iou")


def match_annotations(subjects: DataFrame, truth: DataFrame) -> DataFrame:
    """``truth`` (image_id, ann_id, fx0..fy1, px0..py1 NULL without a person) with the matched subject_id, NULL when there is none.

    ``subjects``: image_id, subject_id, face x/y/w/h as fx, fy, fw, fh (NULL without a face), person as px, py, pw, ph. The nearest face
    centre inside the grown annotated face wins; else the best person overlap of at least one half. Costs that agree on nine decimals are equal
    and go to the lowest subject_id.
    """
    gw, gh = (C("fx1") - C("fx0")) * FACE_GROW, (C("fy1") - C("fy0")) * FACE_GROW
    grown = truth.select(
        "image_id", "ann_id", (C("fx0") - gw).alias("x"), (C("fy0") - gh).alias("y"), (C("fx1") + gw).alias("x1"),
        (C("fy1") + gh).alias("y1"), ((C("fx0") + C("fx1")) / 2).alias("gx"), ((C("fy0") + C("fy1")) / 2).alias("gy"),
    )
    centres = subjects.where("fx IS NOT NULL").select("image_id", "subject_id", (C("fx") + C("fw") / 2).alias("px"), (C("fy") + C("fh") / 2).alias("py"))
    dx, dy = C("px") - C("gx"), C("py") - C("gy")
    by_face = points_in_boxes(centres, grown).select("image_id", "ann_id", F.lit(0).alias("tier"), (dx * dx + dy * dy).alias("cost"), "subject_id")
    people = subjects.where("px IS NOT NULL").select("image_id", "subject_id", C("px").alias("x"), C("py").alias("y"), C("pw").alias("w"), C("ph").alias("h"))
    told = truth.where("px0 IS NOT NULL").select(
        "image_id", C("ann_id").alias("subject_id"), C("px0").alias("x"), C("py0").alias("y"), (C("px1") - C("px0")).alias("w"), (C("py1") - C("py0")).alias("h")
    )
    by_person = overlap_pairs(told, people, ["subject_id"]).where(C("iou") >= MATCH_IOU).select(
        "image_id", C("a_subject_id").alias("ann_id"), F.lit(1).alias("tier"), (-C("iou")).alias("cost"), C("b_subject_id").alias("subject_id")
    )
    best = by_face.unionByName(by_person).groupBy("image_id", "ann_id").agg(F.min(F.struct("tier", F.round("cost", 9).alias("cost"), "subject_id")).alias("m"))
    return truth.select("image_id", "ann_id").join(best, ["image_id", "ann_id"], "left").select(
        "image_id", "ann_id", C("m.subject_id").alias("subject_id"), F.when(C("m.tier") == 0, "face").when(C("m.tier") == 1, "person").alias("matched_by")
    )


def nms(boxes: DataFrame, iou: float = MERGE_IOU) -> DataFrame:
    """Greedy non-maximum suppression: (image_id, box_id) of the kept boxes. Input: image_id, box_id (unique per image), x, y, w, h, score.

    Equal scores keep the order of box_id; a box without a score, or with NaN, is the weakest. Goes by rounds: a box without an undecided better
    neighbour is kept and removes its worse neighbours. The state of a round is one table of the boxes.
    """
    known = F.when(C("score").isNotNull() & ~F.isnan("score"), C("score").cast("double"))
    ranked = boxes.select("image_id", "box_id", "x", "y", "w", "h", F.coalesce(known, F.lit(float("-inf"))).alias("score"))
    better = (C("a_score") > C("b_score")) | ((C("a_score") == C("b_score")) & (C("a_box_id") < C("b_box_id")))
    edges = overlap_pairs(ranked, ranked, ["box_id", "score"], better).where(C("iou") >= iou).select("image_id", "a_box_id", "b_box_id")
    edges = durable(edges)
    # A box that overlaps no better one is settled at once; only the others take part in the rounds.
    worse = edges.select("image_id", C("b_box_id").alias("box_id")).distinct().withColumn("_worse", F.lit(True))
    state = ranked.select("image_id", "box_id").join(worse, ["image_id", "box_id"], "left")
    state = durable(state.select("image_id", "box_id", F.when(C("_worse").isNull(), True).alias("kept")))
    while not state.where("kept IS NULL").isEmpty():
        ends = edges.join(state.select("image_id", C("box_id").alias("a_box_id"), C("kept").alias("_a")), ["image_id", "a_box_id"])
        seen = ends.groupBy("image_id", C("b_box_id").alias("box_id")).agg(F.bool_or(F.coalesce("_a", F.lit(False))).alias("_beaten"), F.bool_or(C("_a").isNull()).alias("_waits"))
        now = F.when(C("kept").isNotNull(), C("kept")).when(C("_beaten"), False).when(~C("_waits"), True)
        state = durable(state.join(seen, ["image_id", "box_id"], "left").select("image_id", "box_id", now.alias("kept")))
    return state.where("kept").select("image_id", "box_id")


def pair_faces_persons(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(image_id, face_id, person_id): largest face first, to the smallest free person box that holds its centre; the rest stay one-sided.

    Input: image_id, box_id, x, y, w, h on both sides. Ties go to the lower box_id.
    """
    f = faces.select("image_id", C("box_id").alias("face_id"), (C("w") * C("h")).alias("f_area"), (C("x") + C("w") / 2).alias("px"), (C("y") + C("h") / 2).alias("py"))
    p = persons.select("image_id", C("box_id").alias("person_id"), (C("w") * C("h")).alias("p_area"), "x", "y", (C("x") + C("w")).alias("x1"), (C("y") + C("h")).alias("y1"))
    owners = points_in_boxes(f, p).select("image_id", "face_id", "f_area", "person_id", "p_area")
    pairs = pair_by_rounds(owners)
    lone_f = f.select("image_id", "face_id").join(pairs, ["image_id", "face_id"], "left_anti")
    lone_p = p.select("image_id", "person_id").join(pairs, ["image_id", "person_id"], "left_anti")
    return pairs.unionByName(lone_f, allowMissingColumns=True).unionByName(lone_p, allowMissingColumns=True)


def pair_by_rounds(owners: DataFrame) -> DataFrame:
    """The greedy pairs by rounds of proposals: every face without a person asks its smallest untried one, every person keeps the largest
    face that ever asked; a person's choice only improves, so the outcome is that of the greedy pass."""
    open_ = durable(owners)
    held = None
    while True:
        ask = open_.groupBy("image_id", "face_id").agg(
            F.max("f_area").alias("f_area"), F.min(F.struct("p_area", "person_id")).getField("person_id").alias("person_id")
        )
        best = ask.groupBy("image_id", "person_id").agg(F.max(F.struct("f_area", (-C("face_id")).alias("nf"))).alias("b"))
        held = durable(best.select("image_id", (-C("b.nf")).cast(dict(owners.dtypes)["face_id"]).alias("face_id"), "person_id"))
        lost = ask.join(held, ["image_id", "face_id", "person_id"], "left_anti").select("image_id", "face_id", "person_id")
        if not lost.take(1):
            return held
        open_ = durable(open_.join(lost, ["image_id", "face_id", "person_id"], "left_anti"))


def subject_verdicts(variants: DataFrame) -> DataFrame:
    """Youngest age and largest child share over a subject's crops, with the assessment. Input: image_id, subject, est_age, child_share."""
    agg = variants.groupBy("image_id", "subject").agg(
        F.min(F.when(~F.isnan("est_age"), C("est_age"))).alias("age"), F.max("child_share").alias("minor_share"), F.bool_or(C("est_age").isNotNull()).alias("usable")
    )
    return agg.withColumn("assessment", classify_minor(C("age"), C("minor_share"), C("usable")))


def image_screening(subjects: DataFrame) -> DataFrame:
    a = C("assessment")
    return subjects.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_subjects"), F.min("age").alias("youngest_age"), F.bool_or(a == "LIKELY_MINOR").alias("contains_minor"),
        F.bool_or(a.isin("LIKELY_MINOR", "POSSIBLE_MINOR")).alias("contains_possible_minor"), F.bool_or(a != "ADULT").alias("review_required"),
    )


def video_screening(frames: DataFrame) -> DataFrame:
    """Per clip: status, flagged frames, priority, youngest age. Input: clip_id, status, flagged, likely_minor, youngest_age.

    The flagged frames themselves are ``frames.where('flagged')``; only their number is gathered per clip.
    """
    agg = frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames_examined"), F.count_if("flagged").alias("frames_flagged"), F.bool_or(C("status") == "UNAVAILABLE").alias("_gone"),
        F.bool_or(C("flagged") & C("likely_minor")).alias("contains_minor"), F.min("youngest_age").alias("youngest_age"),
    )
    n = C("frames_flagged")
    priority = F.when(n == 0, "NONE").when((n >= 2) & (n / C("frames_examined") >= 0.25), "REPEATED").otherwise("SINGLE_FRAME")
    return agg.select(
        "clip_id", F.when(C("_gone"), "UNAVAILABLE").otherwise("OK").alias("status"), "frames_examined", "frames_flagged", priority.alias("priority"), "contains_minor",
        (n > 0).alias("contains_possible_minor"), ((n > 0) | C("_gone")).alias("review_required"), "youngest_age",
    )


def face_texture_score(texture: Column, noise: Column) -> Column:
    risk = F.when(texture < TEXTURE["waxy"], 1.5).otherwise(0.0) + F.when(noise < TEXTURE["noise"], 1.0).otherwise(0.0)
    return F.least(F.lit(0.95), risk / 2.5 * 0.75 + 0.15)


def face_texture_risk(faces: DataFrame) -> DataFrame:
    """Per clip: frames with faces, most faces in a frame, mean score and risk. Input: clip_id, frame_idx, texture, noise; a frame without
    a face has a NULL texture. A frame's score is that of its most suspicious face, in whole hundredths, so that the mean meets its limits exactly
    and in any order of rows."""
    hundredths = F.round(face_texture_score(C("texture"), C("noise")) * 100).cast("bigint")
    per = faces.groupBy("clip_id", "frame_idx").agg(F.count("texture").alias("n"), F.max(F.when(C("texture").isNotNull(), hundredths)).alias("s"))
    agg = per.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.max("n").alias("faces_max"), F.count("s").alias("k"), F.sum("s").alias("total"))
    at_least = lambda limit: C("total") >= F.round(F.lit(limit * 100)).cast("bigint") * C("k")
    risk = (
        F.when(C("faces_max") == 0, "NO_FACES_DETECTED").when(at_least(TEXTURE["high"]), "HIGH_SYNTHETIC_RISK")
        .when(at_least(TEXTURE["suspicious"]), "SUSPICIOUS_ARTIFACTS").otherwise("LOW_RISK_NATURAL_TEXTURE")
    )
    mean = F.coalesce(C("total") / (C("k") * 100.0), F.lit(0.0))
    return agg.select("clip_id", "frames", "faces_max", mean.alias("mean_score"), risk.alias("risk"))


def tile_noise_inconsistency(tiles: DataFrame, ela: DataFrame | None = None) -> DataFrame:
    """Uneven noise over the tiles of an image (at least ten), stronger with an error-level ratio above 4.5.

    Input: image_id, tile, noise; ``ela``: image_id, ela_mean, ela_p98.
    """
    agg = tiles.groupBy("image_id").agg(
        F.count("noise").alias("n"), F.avg("noise").alias("m"), F.stddev_pop("noise").alias("sd"), F.min("noise").alias("lo"), F.max("noise").alias("hi")
    )
    agg = agg.join(ela, "image_id", "left") if ela is not None else agg.withColumns({"ela_mean": F.lit(None).cast("double"), "ela_p98": F.lit(None).cast("double")})
    ok = C("n") >= 10
    ratio = F.when(ok, C("sd") / F.greatest(F.lit(0.2), C("m"))).otherwise(0.0)
    uneven = ok & (ratio >= 0.40) & (C("m") >= 1.5) & (C("lo") < 0.25) & (C("hi") - C("lo") > 2.0)
    ela_odd = F.coalesce((C("ela_mean") > 2.0) & (C("ela_p98") / F.greatest(F.lit(0.1), C("ela_mean")) > 4.5), F.lit(False))
    return agg.select(
        "image_id", uneven.alias("is_manipulated"),
        F.when(uneven & ela_odd, "generative_inpainting_or_splicing").when(uneven, "localized_noise_discrepancy").alias("manipulation_type"),
        F.when(uneven & ela_odd, 0.85).when(uneven, 0.75).otherwise(0.0).alias("confidence"), F.round(ratio, 2).alias("noise_inconsistency"),
    )


def luminance_profile(histogram: DataFrame) -> DataFrame:
    """Grey-level statistics and entropy from (image_id, level, cnt); at most 256 levels per image, so the weighted median is bounded."""
    lv, n = C("level").cast("double"), C("cnt")
    total = F.sum("cnt")
    agg = histogram.groupBy("image_id").agg(
        total.alias("pixels"), (F.sum(lv * n) / total).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(lv * lv * n) / total - (F.sum(lv * n) / total) * (F.sum(lv * n) / total))).alias("std"),
        F.expr("percentile(level, 0.5D, cnt)").alias("median"), F.min("level").alias("low"), F.max("level").alias("high"),
        F.sum(F.when(C("level") >= 252, n).otherwise(0)).alias("clipped"), F.sum(F.when(C("level") <= 4, n).otherwise(0)).alias("crushed"),
        (F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n))) / total).alias("entropy"),
    )
    return agg.select(
        "image_id", F.round("mean", 1).alias("luminance_mean"), F.round("median", 1).alias("luminance_median"), F.round("std", 1).alias("luminance_std"),
        (C("high") - C("low")).alias("dynamic_range"), "clipped", F.round(C("clipped") / C("pixels") * 100, 2).alias("clipped_pct"), "crushed",
        F.round(C("crushed") / C("pixels") * 100, 2).alias("crushed_pct"), F.round("entropy", 3).alias("entropy"),
    )
