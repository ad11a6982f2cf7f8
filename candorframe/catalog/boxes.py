"""Box, subject and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.operators import boxes as bx
from candorframe.tables import round6, view

C = F.col

UNIQ = """u AS (SELECT image_id, box_id, kind, s.x AS x, s.y AS y, s.w AS w, s.h AS h, s.score AS score FROM
 (SELECT image_id, box_id, kind, min({'x': x, 'y': y, 'w': w, 'h': h, 'score': score}) AS s FROM boxes GROUP BY 1, 2, 3) g)"""
IOU = """CASE WHEN least({a}.x+{a}.w,{b}.x+{b}.w) > greatest({a}.x,{b}.x) AND least({a}.y+{a}.h,{b}.y+{b}.h) > greatest({a}.y,{b}.y) THEN
 (least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x))*(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y)) /
 ({a}.w*{a}.h+{b}.w*{b}.h-(least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x))*(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y))) ELSE 0 END"""


def unique_boxes(spark, sf):
    """One box per (image_id, box_id): the source table repeats line numbers."""
    b = view(spark, sf, "boxes")
    return b.groupBy("image_id", "box_id", "kind").agg(F.min(F.struct("x", "y", "w", "h", "score")).alias("s")).select("image_id", "box_id", "kind", "s.*")


@query(
    "iou_join",
    f"""WITH {UNIQ} SELECT a.image_id, a.box_id AS a_box_id, b.box_id AS b_box_id, round({IOU.format(a='a', b='b')}, 6) AS iou FROM u a JOIN u b ON a.image_id = b.image_id AND a.kind = 'face' AND b.kind = 'person'
        WHERE {IOU.format(a='a', b='b')} > 0""",
    ("boxes",),
)
def _(spark, sf):
    u = unique_boxes(spark, sf)
    return bx.iou_join(u.where("kind = 'face'"), u.where("kind = 'person'")).select("image_id", "a_box_id", "b_box_id", round6("iou"))


# Greedy suppression as a recursion over boxes in score order; a list of kept positions is the state.
@query(
    "nms",
    f"""WITH RECURSIVE {UNIQ}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rn FROM u),
       g AS (SELECT image_id, max(rn) AS n FROM r GROUP BY 1),
       c AS (SELECT a.image_id, a.rn AS hi, b.rn AS lo FROM r a JOIN r b ON a.image_id = b.image_id AND a.rn < b.rn WHERE {IOU.format(a='a', b='b')} >= 0.40),
       cl AS (SELECT image_id, lo, list(hi) AS his FROM c GROUP BY 1, 2),
       k AS (SELECT image_id, 1 AS rn, [1] AS kept FROM g UNION ALL
        SELECT k.image_id, k.rn + 1, CASE WHEN len(list_intersect(k.kept, coalesce(cl.his, []))) > 0 THEN k.kept ELSE list_append(k.kept, k.rn + 1) END
        FROM k JOIN g ON g.image_id = k.image_id AND k.rn < g.n LEFT JOIN cl ON cl.image_id = k.image_id AND cl.lo = k.rn + 1),
       f AS (SELECT k.image_id, unnest(kept) AS rn FROM k JOIN g ON g.image_id = k.image_id AND k.rn = g.n)
       SELECT r.image_id, r.box_id FROM f JOIN r ON r.image_id = f.image_id AND r.rn = f.rn""",
    ("boxes",),
)
def _(spark, sf):
    return bx.nms(unique_boxes(spark, sf))


@query(
    "match_annotations",
    f"""WITH {UNIQ}, s AS (SELECT image_id, box_id AS sid, x+w*0.3 AS fx, y+h*0.1 AS fy, w*0.3 AS fw, h*0.3 AS fh, x AS px, y AS py, w AS pw, h AS ph, box_id % 3 <> 0 AS hf FROM u WHERE kind = 'person'),
       t AS (SELECT image_id, box_id AS aid, x+w*0.2 AS x0, y+h*0.2 AS y0, x+w*0.5 AS x1, y+h*0.5 AS y1, CASE WHEN box_id % 4 <> 0 THEN x END AS p0, y AS q0, x+w AS p1, y+h AS q1 FROM u WHERE kind = 'face'),
       f AS (SELECT t.image_id, aid, 0 AS tier, pow(fx+fw/2-(x0+x1)/2, 2)+pow(fy+fh/2-(y0+y1)/2, 2) AS cost, sid FROM t JOIN s ON t.image_id = s.image_id AND hf AND fx+fw/2 BETWEEN x0-(x1-x0)*0.3 AND x1+(x1-x0)*0.3 AND fy+fh/2 BETWEEN y0-(y1-y0)*0.3 AND y1+(y1-y0)*0.3),
       i AS (SELECT t.image_id, aid, sid, (least(px+pw,p1)-greatest(px,p0)) AS iw, (least(py+ph,q1)-greatest(py,q0)) AS ih, pw*ph AS a1, (p1-p0)*(q1-q0) AS a2 FROM t JOIN s ON t.image_id = s.image_id AND p0 IS NOT NULL),
       p AS (SELECT image_id, aid, 1 AS tier, -(iw*ih/(a1+a2-iw*ih)) AS cost, sid FROM i WHERE iw > 0 AND ih > 0 AND iw*ih/(a1+a2-iw*ih) >= 0.5),
       b AS (SELECT image_id, aid, tier, sid, row_number() OVER (PARTITION BY image_id, aid ORDER BY tier, round(cost, 9), sid) AS rn FROM (SELECT * FROM f UNION ALL SELECT * FROM p))
       SELECT t.image_id, t.aid AS ann_id, sid AS subject_id, CASE tier WHEN 0 THEN 'face' WHEN 1 THEN 'person' END AS matched_by FROM t LEFT JOIN b ON b.image_id = t.image_id AND b.aid = t.aid AND rn = 1""",
    ("boxes",),
)
def _(spark, sf):
    u = unique_boxes(spark, sf)
    has = "box_id % 3 <> 0"
    s = u.where("kind = 'person'").selectExpr(
        "image_id", "box_id AS subject_id", f"IF({has}, x + w * 0.3D, NULL) AS fx", "y + h * 0.1D AS fy", "w * 0.3D AS fw", "h * 0.3D AS fh", "x AS px", "y AS py", "w AS pw", "h AS ph"
    )
    t = u.where("kind = 'face'").selectExpr(
        "image_id", "box_id AS ann_id", "x + w * 0.2D AS fx0", "y + h * 0.2D AS fy0", "x + w * 0.5D AS fx1", "y + h * 0.5D AS fy1", "IF(box_id % 4 <> 0, x, NULL) AS px0", "y AS py0", "x + w AS px1", "y + h AS py1"
    )
    return bx.match_annotations(s, t)


# Greedy pairing as a recursion over candidate pairs in order; the pairs taken so far are the state.
@query(
    "pair_faces_persons",
    f"""WITH RECURSIVE {UNIQ}, f AS (SELECT * FROM u WHERE kind = 'face'), p AS (SELECT * FROM u WHERE kind = 'person'),
       e AS (SELECT f.image_id, f.box_id AS fi, p.box_id AS pi, row_number() OVER (PARTITION BY f.image_id ORDER BY f.w*f.h DESC, f.box_id, p.w*p.h, p.box_id) AS rn FROM f JOIN p ON f.image_id = p.image_id
          AND f.x+f.w/2 BETWEEN p.x AND p.x+p.w AND f.y+f.h/2 BETWEEN p.y AND p.y+p.h),
       g AS (SELECT image_id, max(rn) AS n FROM e GROUP BY 1),
       k AS (SELECT image_id, rn, [fi] AS fs, [pi] AS ps FROM e WHERE rn = 1 UNION ALL
        SELECT k.image_id, e.rn, CASE WHEN list_contains(k.fs, e.fi) OR list_contains(k.ps, e.pi) THEN k.fs ELSE list_append(k.fs, e.fi) END,
         CASE WHEN list_contains(k.fs, e.fi) OR list_contains(k.ps, e.pi) THEN k.ps ELSE list_append(k.ps, e.pi) END FROM k JOIN e ON e.image_id = k.image_id AND e.rn = k.rn + 1),
       m AS (SELECT k.image_id, unnest(fs) AS face_id, unnest(ps) AS person_id FROM k JOIN g ON g.image_id = k.image_id AND g.n = k.rn)
       SELECT image_id, face_id, person_id FROM m UNION ALL SELECT image_id, box_id, NULL FROM f WHERE (image_id, box_id) NOT IN (SELECT (image_id, face_id) FROM m)
       UNION ALL SELECT image_id, NULL, box_id FROM p WHERE (image_id, box_id) NOT IN (SELECT (image_id, person_id) FROM m)""",
    ("boxes",),
)
def _(spark, sf):
    u = unique_boxes(spark, sf)
    return bx.pair_faces_persons(u.where("kind = 'face'"), u.where("kind = 'person'"))


VERDICT_SQL = """v AS (SELECT image_id, subject, min(est_age) AS age, max(child_share) AS sh FROM age_rows GROUP BY 1, 2),
 w AS (SELECT *, CASE WHEN age < 18 THEN 'LIKELY_MINOR' WHEN age < 27 THEN 'POSSIBLE_MINOR' WHEN sh >= 0.5 THEN 'POSSIBLE_MINOR' WHEN age IS NOT NULL THEN 'ADULT' ELSE 'UNDETERMINED' END AS asm FROM v)"""


@query("subject_verdicts", f"WITH {VERDICT_SQL} SELECT image_id, subject, age, round(sh, 6) AS minor_share, asm AS assessment FROM w", ("age_rows",))
def _(spark, sf):
    return bx.subject_verdicts(view(spark, sf, "age_rows")).select("image_id", "subject", "age", round6("minor_share"), "assessment")


@query(
    "image_screening",
    f"""WITH {VERDICT_SQL} SELECT image_id, count(*) AS n_subjects, min(age) AS youngest_age, bool_or(asm='LIKELY_MINOR') AS contains_minor, bool_or(asm LIKE '%MINOR') AS contains_possible_minor,
        bool_or(asm <> 'ADULT') AS review_required FROM w GROUP BY 1""",
    ("age_rows",),
)
def _(spark, sf):
    return bx.image_screening(bx.subject_verdicts(view(spark, sf, "age_rows")))


@query(
    "video_screening",
    """WITH f AS (SELECT clip_id, CASE WHEN clip_id % 20 = 3 AND frame_idx = 5 THEN 'UNAVAILABLE' ELSE 'OK' END AS st, luminance < clip_id AS fl, luminance < 5 AS lm, CASE WHEN frame_idx % 3 = 0 THEN luminance END AS age FROM frame_stats),
       a AS (SELECT clip_id, count(*) n, count(*) FILTER (fl) k, bool_or(st='UNAVAILABLE') g, bool_or(fl AND lm) m, min(age) y FROM f GROUP BY 1)
       SELECT clip_id, CASE WHEN g THEN 'UNAVAILABLE' ELSE 'OK' END AS status, n AS frames_examined, k AS frames_flagged, CASE WHEN k=0 THEN 'NONE' WHEN k>=2 AND k/n>=0.25 THEN 'REPEATED' ELSE 'SINGLE_FRAME' END AS priority,
        m AS contains_minor, k>0 AS contains_possible_minor, k>0 OR g AS review_required, y AS youngest_age FROM a""",
    ("frame_stats",),
)
def _(spark, sf):
    f = view(spark, sf, "frame_stats").selectExpr(
        "clip_id", "IF(clip_id % 20 = 3 AND frame_idx = 5, 'UNAVAILABLE', 'OK') AS status", "luminance < clip_id AS flagged", "luminance < 5 AS likely_minor", "IF(frame_idx % 3 = 0, luminance, NULL) AS youngest_age"
    )
    return bx.video_screening(f)


@query(
    "face_texture_risk",
    """WITH f AS (SELECT image_id % 500 AS clip_id, image_id AS fr, CASE WHEN kind = 'face' AND image_id % 500 <> 7 THEN w/10 END AS tx, h/20 AS nz FROM boxes),
       p AS (SELECT clip_id, fr, count(tx) n, max(CASE WHEN tx IS NOT NULL THEN CASE WHEN tx < 3.2 AND nz < 1.8 THEN 90 WHEN tx < 3.2 THEN 60 WHEN nz < 1.8 THEN 45 ELSE 15 END END) s FROM f GROUP BY 1,2),
       a AS (SELECT clip_id, count(*) fr, max(n) mx, count(s) k, sum(s) t FROM p GROUP BY 1)
       SELECT clip_id, fr AS frames, mx AS faces_max, round(coalesce(t / (k * 100.0::DOUBLE), 0), 6) AS mean_score, CASE WHEN mx = 0 THEN 'NO_FACES_DETECTED' WHEN t >= 70 * k THEN 'HIGH_SYNTHETIC_RISK' WHEN t >= 45 * k THEN 'SUSPICIOUS_ARTIFACTS' ELSE 'LOW_RISK_NATURAL_TEXTURE' END AS risk FROM a""",
    ("boxes",),
)
def _(spark, sf):
    f = view(spark, sf, "boxes").select(
        (C("image_id") % 500).alias("clip_id"), C("image_id").alias("frame_idx"), F.when((C("kind") == "face") & (C("image_id") % 500 != 7), C("w") / 10).alias("texture"), (C("h") / 20).alias("noise")
    )
    return bx.face_texture_risk(f).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "tile_noise_inconsistency",
    """WITH t AS (SELECT image_id, noise * 2 AS noise FROM tiles UNION ALL SELECT image_id + 10000000, noise * 2 FROM tiles WHERE tile < 9), a AS (SELECT image_id, count(*) n, avg(noise) m, stddev_pop(noise) sd, min(noise) lo, max(noise) hi, image_id % 3 = 0 AS el FROM t GROUP BY 1),
       r AS (SELECT *, CASE WHEN n>=10 THEN sd/greatest(0.2,m) ELSE 0 END AS ra FROM a), u AS (SELECT *, n>=10 AND ra>=0.40 AND m>=1.5 AND lo<0.25 AND hi-lo>2 AS un FROM r)
       SELECT image_id, un AS is_manipulated, CASE WHEN un AND el THEN 'generative_inpainting_or_splicing' WHEN un THEN 'localized_noise_discrepancy' END AS manipulation_type,
        (CASE WHEN un AND el THEN 0.85 WHEN un THEN 0.75 ELSE 0 END)::DOUBLE AS confidence, round(ra, 2) AS noise_inconsistency FROM u""",
    ("tiles",),
)
def _(spark, sf):
    t = view(spark, sf, "tiles").withColumn("noise", C("noise") * 2)
    t = t.unionByName(t.where("tile < 9").withColumn("image_id", C("image_id") + 10000000))  # every image once more, with too few tiles
    ela = view(spark, sf, "vectors").select(C("vec_id").alias("image_id"), F.lit(3.0).alias("ela_mean"), F.when(C("vec_id") % 3 == 0, 15.0).otherwise(9.0).alias("ela_p98"))
    return bx.tile_noise_inconsistency(t, ela)


@query(
    "luminance_profile",
    """WITH e AS (SELECT image_id, level, cnt, unnest(range(cnt)) FROM histogram), a AS (SELECT image_id, count(*) n, avg(level) m, stddev_pop(level) sd, quantile_cont(level, 0.5) md, max(level)-min(level) dr, count(*) FILTER (level>=252) cl, count(*) FILTER (level<=4) cr FROM e GROUP BY 1),
       h AS (SELECT image_id, -sum(p*log2(p)) AS en FROM (SELECT image_id, cnt/sum(cnt) OVER (PARTITION BY image_id) AS p FROM histogram) GROUP BY 1)
       SELECT image_id, round(m,1) AS luminance_mean, round(md,1) AS luminance_median, round(sd,1) AS luminance_std, dr AS dynamic_range, cl AS clipped, round(cl/n*100,2) AS clipped_pct, cr AS crushed, round(cr/n*100,2) AS crushed_pct, round(en,3) AS entropy
       FROM a JOIN h USING (image_id)""",
    ("histogram",),
)
def _(spark, sf):
    return bx.luminance_profile(view(spark, sf, "histogram"))
