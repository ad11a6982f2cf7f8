"""Timeline and spectrum queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.operators import sequence as sq
from candorframe.operators import spectrum as sp
from candorframe.tables import round6, view

C = F.col
RATE, BINS = 44100, 64


def _frames(spark, sf):
    return view(spark, sf, "frame_stats")


@query(
    "motion_variance",
    """WITH k AS (SELECT clip_id, frame_idx, luminance FROM frame_stats WHERE frame_idx % 11 <> 0), d AS (SELECT clip_id, abs(luminance - lag(luminance) OVER
        (PARTITION BY clip_id ORDER BY frame_idx)) AS d FROM k), a AS (SELECT clip_id, count(d) n, avg(d) m, var_pop(d) v FROM d GROUP BY 1),
       c AS (SELECT DISTINCT clip_id FROM frame_stats)
       SELECT c.clip_id, CASE WHEN n>=3 THEN round(m,6) END AS mean_motion_delta, CASE WHEN n>=3 THEN round(v,6) END AS motion_variance,
        CASE WHEN n>=3 THEN CASE WHEN v>140 OR (m>32 AND v>80) THEN 'HIGH_WARPING_DETECTED' WHEN v>75 OR m>22 THEN 'SUSPICIOUS_FLICKER'
         WHEN v<0.8 AND m<1.2 THEN 'UNNATURAL_FREEZE' ELSE 'LOW' END END AS warping_risk, coalesce(n>=3,false) AS measured FROM c LEFT JOIN a USING (clip_id)""",
    ("frame_stats",),
)
def _(spark, sf):
    f = _frames(spark, sf).withColumn("gray_variance", F.when(C("frame_idx") % 11 == 0, 1.0).otherwise(50.0))
    return sq.motion_variance(f).select("clip_id", round6("mean_motion_delta"), round6("motion_variance"), "warping_risk", "measured")


@query(
    "flicker",
    """WITH d AS (SELECT clip_id, frame_idx, luminance - lag(luminance) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS d FROM frame_stats),
       e AS (SELECT *, lag(d) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS pd FROM d),
       a AS (SELECT clip_id, count(*) n, avg(abs(d)) j, count(*) FILTER (sign(d)*sign(pd) < 0) t FROM e GROUP BY 1), r AS (SELECT *, t/greatest(1, n-2) AS ra FROM a)
       SELECT clip_id, CASE WHEN n>=3 THEN round(ra,6) END AS flicker_ratio, CASE WHEN n>=3 THEN round(j,6) END AS mean_lum_jump,
        CASE WHEN n>=3 THEN ra>0.65 AND j>3.5 END AS has_flicker, CASE WHEN n>=3 THEN round(ra*least(1.0,j/10),6) END AS flicker_score, n AS frames_compared FROM r""",
    ("frame_stats",),
)
def _(spark, sf):
    t = sq.flicker(_frames(spark, sf))
    return t.select("clip_id", round6("flicker_ratio"), round6("mean_lum_jump"), "has_flicker", round6("flicker_score"), "frames_compared")


SEG_SQL = """f AS (SELECT clip_id, frame_idx, CAST(epoch_us(ts) AS DOUBLE)/1000000 - 1704067200.0 AS t, label FROM frame_stats),
 g AS (SELECT *, lag(label) OVER w AS pl FROM f WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
 i AS (SELECT *, sum(CASE WHEN pl IS DISTINCT FROM label THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS island FROM g),
 r AS (SELECT clip_id, island, min(t) AS st, any_value(label) AS label, count(*) AS frame_count FROM i GROUP BY 1, 2),
 du AS (SELECT clip_id, max(t) + 5 AS duration_s FROM f GROUP BY 1),
 seg AS (SELECT r.clip_id, st, coalesce(lead(st) OVER (PARTITION BY r.clip_id ORDER BY island), duration_s) AS en, label, frame_count FROM r JOIN du USING (clip_id))"""


def _timed(spark, sf):
    f = _frames(spark, sf).withColumn("t", F.unix_micros(C("ts").cast("timestamp")) / 1000000.0 - 1704067200.0)
    return f, f.groupBy("clip_id").agg((F.max("t") + 5).alias("duration_s"))


@query(
    "timeline_segments",
    f"WITH {SEG_SQL} SELECT clip_id, round(st, 2) AS start_s, round(en, 2) AS end_s, round(greatest(0.01, en-st), 2) AS duration_s, label, frame_count FROM seg",
    ("frame_stats",),
)
def _(spark, sf):
    f, dur = _timed(spark, sf)
    t = sq.timeline_segments(f, dur)
    return t.select("clip_id", *[F.round(c, 2).alias(c) for c in ("start_s", "end_s", "duration_s")], "label", "frame_count")


@query(
    "ai_duration_pct",
    f"""WITH {SEG_SQL}, d2 AS (SELECT clip_id, CASE WHEN clip_id % 10 = 0 THEN 0 ELSE duration_s END AS d FROM du)
        SELECT clip_id, CASE WHEN d > 0 THEN round(least(100.0, sum(CASE WHEN label='LIKELY AI-GENERATED' THEN greatest(0.01, en-st) ELSE 0 END)/d*100), 4) END AS ai_duration_pct
        FROM d2 JOIN seg USING (clip_id) GROUP BY clip_id, d""",
    ("frame_stats",),
)
def _(spark, sf):
    f, dur = _timed(spark, sf)
    known = dur.withColumn("duration_s", F.when(C("clip_id") % 10 == 0, 0.0).otherwise(C("duration_s")))
    return sq.ai_duration_pct(sq.timeline_segments(f, dur), known).select("clip_id", F.round("ai_duration_pct", 4).alias("ai_duration_pct"))


@query(
    "covered_seconds",
    """WITH s AS (SELECT *, max(end_s) OVER (PARTITION BY clip_id, label ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
       i AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, label ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS isl FROM s)
       SELECT clip_id, label, round(sum(len), 3) AS covered_s FROM (SELECT clip_id, label, isl, max(end_s)-min(start_s) AS len FROM i GROUP BY 1,2,3) GROUP BY 1,2""",
    ("spans",),
)
def _(spark, sf):
    return sq.covered_seconds(view(spark, sf, "spans")).select("clip_id", "label", F.round("covered_s", 3).alias("covered_s"))


@query(
    "overlapping_windows",
    """WITH z AS (SELECT recording_id, max(idx)+1 AS total FROM samples GROUP BY 1), k AS (SELECT recording_id, total, unnest(range(0, CASE WHEN total <= 3000 THEN 1 ELSE total END, 1500)) AS st FROM z),
       w AS (SELECT *, CASE WHEN total <= 3000 THEN total ELSE least(3000, total-st) END AS len FROM k), v AS (SELECT * FROM w WHERE total <= 3000 OR len >= 500),
       a AS (SELECT v.recording_id, st, len, total, count(*) n, avg(value*value) p, count(*) FILTER (abs(value)<1e-5) AS z FROM v JOIN samples s ON s.recording_id=v.recording_id AND s.idx>=st AND s.idx<st+len GROUP BY 1,2,3,4)
       SELECT recording_id, round(st/1000, 6) AS start_s, round(least(total/1000, (st+len)/1000), 6) AS end_s, n, round(sqrt(p), 6) AS rms,
        (CASE WHEN z/n > 0.12 THEN 0.4 ELSE 0.1 END)::DOUBLE AS ai_prob, CASE WHEN z/n > 0.12 AND 0.4 >= 0.55 THEN 'LIKELY AI-GENERATED' ELSE 'LIKELY REAL' END AS label FROM a""",
    ("samples",),
)
def _(spark, sf):
    t = sq.overlapping_windows(view(spark, sf, "samples"), rate=1000)
    return t.select("recording_id", round6("start_s"), round6("end_s"), "n", round6("rms"), "ai_prob", "label")


@query(
    "spectral_features",
    """WITH m AS (SELECT recording_id, bin, avg(magnitude) AS mag, bin*(22050.0/63)::DOUBLE AS hz FROM spectrum GROUP BY 1,2),
       c AS (SELECT *, sum(mag) OVER (PARTITION BY recording_id)+1e-10 AS tot, sum(mag) OVER (PARTITION BY recording_id ORDER BY bin) AS cm FROM m),
       s AS (SELECT recording_id, avg((abs(value)<1e-5)::INT) AS sr FROM samples GROUP BY 1),
       a AS (SELECT recording_id, coalesce(min(CASE WHEN cm/tot >= 0.985 THEN bin END), max(bin))*(22050.0/63)::DOUBLE AS co, exp(avg(ln(mag+1e-12)))/avg(mag+1e-12) AS fl,
             sum(CASE WHEN hz>=5000 THEN mag ELSE 0 END)/max(tot) AS hf FROM c GROUP BY 1),
       v AS (SELECT *, co <= 0.92*22050 AND (co BETWEEN 6500 AND 8200 OR co BETWEEN 15000 AND 16500) AS vc FROM a JOIN s USING (recording_id))
       SELECT recording_id, round(co,6) AS cutoff_hz, vc AS has_vocoder_cutoff, round(fl,6) AS spectral_flatness, round(sr,6) AS silence_ratio, round(hf,6) AS high_freq_ratio,
        round(least(0.95, 0.10 + CASE WHEN vc THEN 0.5 ELSE 0 END + CASE WHEN fl<0.002 THEN 0.25 ELSE 0 END + CASE WHEN sr>0.12 THEN 0.3 ELSE 0 END),6)::DOUBLE AS p_audio_ai FROM v""",
    ("spectrum", "samples"),
)
def _(spark, sf):
    levels = sp.silence_and_level(view(spark, sf, "samples"))
    t = sp.spectral_features(view(spark, sf, "spectrum"), RATE, BINS, levels)
    return t.select(
        "recording_id", round6("cutoff_hz"), "has_vocoder_cutoff", round6("spectral_flatness"), round6("silence_ratio"), round6("high_freq_ratio"), round6("p_audio_ai")
    )


@query(
    "silence_and_level",
    """WITH a AS (SELECT recording_id, count(*) n, avg((abs(value)<1e-5)::INT) z, sqrt(avg(value*value)) rms, max(abs(value)) pk, avg((abs(value)>=0.999)::INT) cl, avg(value) dc FROM samples GROUP BY 1)
       SELECT recording_id, CASE WHEN recording_id % 5 <> 0 THEN round(z,6) END AS silence_ratio, round(rms,6) AS rms, round(pk,6) AS peak, round(20*log10(greatest(pk,1e-9))-20*log10(rms),6) AS crest_db,
        round(cl,6) AS clipping_ratio, round(dc,6)+0.0 AS dc_offset, CASE WHEN n<1000 OR rms<1e-4 THEN 'NOT_APPLICABLE' WHEN cl>0.001 THEN 'WARN' ELSE 'INFO' END AS status FROM a""",
    ("samples",),
)
def _(spark, sf):
    t = sp.silence_and_level(view(spark, sf, "samples"), eight_bit=C("recording_id") % 5 == 0)
    return t.select(
        "recording_id", round6("silence_ratio"), round6("rms"), round6("peak"), round6("crest_db"), round6("clipping_ratio"), (F.round("dc_offset", 6) + 0.0).alias("dc_offset"), "status"
    )


@query(
    "dynamic_range_db",
    """WITH z AS (SELECT recording_id, (max(idx)+1)//50 AS fr FROM samples GROUP BY 1), r AS (SELECT recording_id, idx//50 AS f, sqrt(avg(value*value)) AS rms FROM samples GROUP BY 1,2),
       q AS (SELECT recording_id, any_value(fr) fr, count(*) n, quantile_cont(rms, 0.95) p95, quantile_cont(rms, 0.10) p10 FROM r JOIN z USING (recording_id) WHERE f < fr AND rms > 1e-5 GROUP BY 1)
       SELECT recording_id, CASE WHEN fr>=2 AND n>=2 THEN round(20*log10(p95/greatest(1e-9,p10)),6) ELSE 0 END AS dynamic_range_db FROM q""",
    ("samples",),
)
def _(spark, sf):
    return sp.dynamic_range_db(view(spark, sf, "samples"), rate=1000).select("recording_id", round6("dynamic_range_db"))


@query(
    "audio_scene",
    """WITH m AS (SELECT recording_id, bin, avg(magnitude) AS mag, bin*(22050.0/63)::DOUBLE AS hz FROM spectrum GROUP BY 1,2),
       a AS (SELECT recording_id, sum(mag)+1e-10 AS tot, sum(CASE WHEN hz BETWEEN 300 AND 3400 THEN mag ELSE 0 END) AS v, sum(CASE WHEN hz>4000 THEN mag ELSE 0 END) AS h,
             exp(avg(ln(mag+1e-10)))/(avg(mag)+1e-10) AS fl FROM m GROUP BY 1), l AS (SELECT recording_id, sqrt(avg(value*value)) rms, max(abs(value)) pk FROM samples GROUP BY 1)
       SELECT recording_id, CASE WHEN v/tot > 0.65 THEN 'SPEECH_LIKE' WHEN h/tot > 0.35 AND fl < 0.40 THEN 'MUSIC_LIKE' ELSE 'AMBIENT' END AS dominant,
        CASE WHEN pk/rms > 8 THEN 'DYNAMIC' WHEN pk/rms < 3.5 THEN 'COMPRESSED' ELSE 'NATURAL' END AS delivery, CASE WHEN rms > 0.05 THEN 'STRONG' ELSE 'LOW' END AS signal_level,
        round(v/tot,6) AS speech_ratio, round(pk/greatest(1e-6,rms),6) AS crest_factor FROM a JOIN l USING (recording_id)""",
    ("spectrum", "samples"),
)
def _(spark, sf):
    levels = sp.silence_and_level(view(spark, sf, "samples")).select("recording_id", "rms", "peak")
    t = sp.audio_scene(view(spark, sf, "spectrum"), levels, RATE, BINS)
    return t.select("recording_id", "dominant", "delivery", "signal_level", round6("speech_ratio"), round6("crest_factor"))


@query(
    "telephony_band",
    """WITH s AS (SELECT recording_id, bin*(22050.0/63)::DOUBLE AS hz, magnitude*magnitude * CASE WHEN recording_id%2=0 AND bin > 10 THEN 1e-7 ELSE 1 END AS p FROM spectrum),
       a AS (SELECT recording_id, sum(CASE WHEN hz BETWEEN 300 AND 3400 THEN p ELSE 0 END)+1e-20 AS mid, sum(CASE WHEN hz BETWEEN 3800 AND 7800 THEN p ELSE 0 END)+1e-20 AS hf,
        sum(CASE WHEN hz BETWEEN 20 AND 200 THEN p ELSE 0 END)+1e-20 AS lf FROM s GROUP BY 1)
       SELECT recording_id, round(10*log10(hf/mid),4) AS hf_ratio_db, round(10*log10(lf/mid),4) AS lf_ratio_db, 10*log10(hf/mid) <= -35 AS band_limited,
        10*log10(hf/mid) <= -35 AND 10*log10(lf/mid) <= -20 AS narrowband FROM a""",
    ("spectrum",),
)
def _(spark, sf):
    s = view(spark, sf, "spectrum").withColumn(
        "magnitude", F.sqrt(C("magnitude") * C("magnitude") * F.when((C("recording_id") % 2 == 0) & (C("bin") > 10), 1e-7).otherwise(1.0))
    )
    t = sp.telephony_band(s, RATE, BINS)
    return t.select("recording_id", F.round("hf_ratio_db", 4).alias("hf_ratio_db"), F.round("lf_ratio_db", 4).alias("lf_ratio_db"), "band_limited", "narrowband")


STEP_DB = "20 * log10(magnitude + 1e-3) - CASE WHEN recording_id % 3 = 0 AND bin > 45 THEN 60 WHEN recording_id % 3 = 1 AND bin > 30 THEN 60 ELSE 0 END"


@query(
    "bandwidth_step",
    f"""WITH s AS (SELECT recording_id, floor((bin*(22050.0/63)::DOUBLE - 4000)/500) AS band, {STEP_DB} AS db FROM spectrum),
       b AS (SELECT recording_id, band, avg(db) m FROM s WHERE band >= 0 AND band < 36 GROUP BY 1,2),
       w AS (SELECT *, avg(m) OVER (PARTITION BY recording_id ORDER BY band ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - avg(m) OVER (PARTITION BY recording_id ORDER BY band ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS dr,
             row_number() OVER (PARTITION BY recording_id ORDER BY band)-1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM b),
       x AS (SELECT recording_id, i AS bi, band AS bb, dr FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY dr DESC, i) AS rk FROM w WHERE i >= 4 AND i < n-4 AND dr > 0) WHERE rk = 1),
       g AS (SELECT w.recording_id, max(n) n, max(dr2) dr, max(bb) bb, stddev_pop(CASE WHEN i > bi THEN m END) sd, count(CASE WHEN i > bi THEN m END) ab
             FROM w LEFT JOIN (SELECT recording_id, bi, bb, dr AS dr2 FROM x) x USING (recording_id) GROUP BY 1),
       c AS (SELECT recording_id, CASE WHEN n >= 12 AND dr >= 25 AND NOT (ab >= 4 AND sd > 6) THEN bb*500 + 4000.0 END AS co FROM g)
       SELECT recording_id, co::DOUBLE AS cutoff_hz, CASE WHEN co < 15000 THEN 'UPSAMPLED_FROM_LOWER_RATE' WHEN co BETWEEN 15000 AND 16800 OR co BETWEEN 18000 AND 20800 THEN 'POSSIBLE_LOSSY_ORIGIN'
        ELSE 'NO_ANOMALY' END AS verdict FROM c""",
    ("spectrum",),
)
def _(spark, sf):
    s = view(spark, sf, "spectrum").withColumn("db", F.expr(STEP_DB))
    return sp.bandwidth_step(s, RATE, BINS, width=500.0)


@query(
    "hum_trace",
    """WITH f AS (SELECT clip_id, frame_idx, 50 + (luminance - 50) * CASE clip_id % 4 WHEN 0 THEN 0.00001 WHEN 1 THEN 0.003 WHEN 2 THEN 0.02 ELSE 0.002 END AS hz,
         CASE WHEN frame_idx % 10 < CASE WHEN clip_id % 5 = 0 THEN 5 ELSE 8 END THEN 9.0 ELSE 2.0 END AS snr FROM frame_stats),
       g AS (SELECT *, snr >= 6 AS good, lag(hz) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS ph, lag(snr) OVER (PARTITION BY clip_id ORDER BY frame_idx) >= 6 AS pg FROM f),
       a AS (SELECT clip_id, avg(good::INT) fr, stddev_pop(CASE WHEN good THEN hz END) sd, quantile_cont(CASE WHEN good THEN hz END, 0.5) md, count(*) FILTER (good AND pg AND abs(hz-ph) > 0.15) j FROM g GROUP BY 1),
       s AS (SELECT *, CASE WHEN fr < 0.6 THEN 'NO_TRACE' WHEN sd < 0.003 THEN 'STABLE_TONE' WHEN sd > 0.30 THEN 'ERRATIC' WHEN j > 0 THEN 'SPLICED' ELSE 'CONTINUOUS' END AS state FROM a)
       SELECT clip_id, state, round(fr,6) AS good_fraction, CASE WHEN state <> 'NO_TRACE' THEN round(md,6) END AS median_hz, CASE WHEN state <> 'NO_TRACE' THEN round(sd,6) END AS std_hz,
        CASE WHEN state IN ('SPLICED','CONTINUOUS') THEN j END AS jumps, (CASE state WHEN 'SPLICED' THEN 0.15 WHEN 'CONTINUOUS' THEN -0.15 END)::DOUBLE AS llr FROM s""",
    ("frame_stats",),
)
def _(spark, sf):
    f = _frames(spark, sf).selectExpr(
        "clip_id", "frame_idx",
        "50 + (luminance - 50) * CASE clip_id % 4 WHEN 0 THEN 0.00001D WHEN 1 THEN 0.003D WHEN 2 THEN 0.02D ELSE 0.002D END AS hz",
        "CASE WHEN frame_idx % 10 < CASE WHEN clip_id % 5 = 0 THEN 5 ELSE 8 END THEN 9.0D ELSE 2.0D END AS snr",
    )
    return sq.hum_trace(f).select("clip_id", "state", round6("good_fraction"), round6("median_hz"), round6("std_hz"), "jumps", "llr")


@query(
    "fingerprint_bits",
    """WITH f AS (SELECT label::BIGINT AS recording_id, vec_id AS frame, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings),
       g AS (SELECT *, lag(e) OVER (PARTITION BY recording_id ORDER BY frame) AS p FROM f)
       SELECT recording_id, frame, list_sum(list_transform(range(0,32), lambda b: CASE WHEN (e[b+1]-e[b+2])-(p[b+1]-p[b+2]) > 0 THEN (1::BIGINT << b) ELSE 0 END))::BIGINT AS bits FROM g WHERE p IS NOT NULL""",
)
def _(spark, sf):
    e = view(spark, sf, "vectors").select(
        C("label").cast("bigint").alias("recording_id"), C("vec_id").alias("frame"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("bands")
    )
    return sp.fingerprint_bits(e)


@query(
    "stream_page_continuity",
    """WITH p AS (SELECT clip_id, frame_idx AS page, frame_idx % 2 AS serial, frame_idx // 2 + CASE WHEN frame_idx % 97 = 96 THEN 1 ELSE 0 END AS seq,
        CASE WHEN frame_idx % 13 = 0 THEN -1 ELSE frame_idx * 10 - CASE WHEN frame_idx % 29 = 5 THEN 90 ELSE 0 END END AS granule, frame_idx % 53 <> 7 AS ok
        FROM (SELECT clip_id, frame_idx FROM frame_stats UNION ALL SELECT clip_id + 10000000, frame_idx FROM frame_stats WHERE frame_idx < 5)),
       l AS (SELECT *, lag(seq) OVER w AS ps, lag(granule) OVER w AS pg FROM p WINDOW w AS (PARTITION BY clip_id, serial ORDER BY page)),
       a AS (SELECT clip_id, count(*) pages, count(*) FILTER (NOT ok) cf, count(*) FILTER (seq <> ps+1) sg, count(*) FILTER (pg>=0 AND granule>=0 AND granule<pg) gr, count(DISTINCT serial) se FROM l GROUP BY 1)
       SELECT clip_id, pages, cf AS crc_failures, sg AS sequence_gaps, gr AS granule_regressions, se AS serials, CASE WHEN cf+sg+gr > 0 THEN 'WARN' WHEN se > 1 THEN 'INFO' ELSE 'PASS' END AS status FROM a""",
    ("frame_stats",),
)
def _(spark, sf):
    f = _frames(spark, sf).select("clip_id", "frame_idx")
    f = f.unionByName(f.where("frame_idx < 5").withColumn("clip_id", C("clip_id") + 10000000))  # every clip once more, as a short one
    p = f.selectExpr(
        "clip_id", "frame_idx AS page", "frame_idx % 2 AS serial", "frame_idx div 2 + CASE WHEN frame_idx % 97 = 96 THEN 1 ELSE 0 END AS seq",
        "CASE WHEN frame_idx % 13 = 0 THEN -1 ELSE frame_idx * 10 - CASE WHEN frame_idx % 29 = 5 THEN 90 ELSE 0 END END AS granule", "frame_idx % 53 <> 7 AS crc_ok",
    )
    return sq.stream_page_continuity(p)


CAD = """CASE clip_id % 5 WHEN 0 THEN CAST(frame_idx div 2 AS DOUBLE) * 3 WHEN 1 THEN CAST(frame_idx - (frame_idx + 4) div 5 AS DOUBLE) * 4 WHEN 2 THEN luminance
 WHEN 3 THEN CAST(1 AS DOUBLE) ELSE CAST(frame_idx - (frame_idx + 3) div 7 AS DOUBLE) * 2 END"""


@query(
    "frame_cadence",
    f"""WITH f AS (SELECT clip_id, frame_idx, {CAD.replace(' div ', ' // ')} AS v FROM frame_stats), d AS (SELECT clip_id, frame_idx, abs(v - lag(v) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS d FROM f),
       q AS (SELECT clip_id, quantile_cont(d, 0.75) mo, count(d) n FROM d WHERE d IS NOT NULL GROUP BY 1), j AS (SELECT d.*, mo FROM d JOIN q USING (clip_id) WHERE d IS NOT NULL),
       a AS (SELECT clip_id, count(*) FILTER (d < 0.15*mo) r, count(*) FILTER (d > 4*mo AND d > 20) c FROM j GROUP BY 1),
       g AS (SELECT clip_id, frame_idx - lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS gap FROM j WHERE d < 0.15*mo),
       h AS (SELECT clip_id, gap, count(*) c FROM g WHERE gap IS NOT NULL GROUP BY 1,2), t AS (SELECT clip_id, sum(c) ng, first(gap ORDER BY c DESC, gap) tg, max(c) tc FROM h GROUP BY 1),
       x AS (SELECT q.clip_id, n, mo, r, c, ng, tg, tc, n+1 >= 20 AND mo >= 0.5 AS u, r >= 3 AND tc >= 0.8*ng AS reg FROM q JOIN a USING (clip_id) LEFT JOIN t USING (clip_id)),
       y AS (SELECT *, CASE WHEN NOT u THEN 'NOT_APPLICABLE' WHEN r/n >= 0.4 THEN 'HEAVY_DUPLICATION' WHEN reg AND tg = 5 THEN 'PULLDOWN_3_2' WHEN reg THEN 'REGULAR_DUPLICATION'
         WHEN r >= 1 THEN 'ISOLATED_DUPLICATES' ELSE 'NONE' END AS pattern FROM x)
       SELECT clip_id, pattern, CASE WHEN u THEN r END AS repeat_frames, CASE WHEN u THEN round(r/n, 6) END AS repeat_fraction, CASE WHEN u THEN c END AS hard_cuts,
        CASE WHEN pattern IN ('PULLDOWN_3_2','REGULAR_DUPLICATION') THEN tg END AS period FROM y""",
    ("frame_stats",),
)
def _(spark, sf):
    f = _frames(spark, sf).withColumn("v", F.expr(CAD))
    return sq.frame_cadence(f, "v").withColumn("repeat_fraction", F.round("repeat_fraction", 6))


@query(
    "combing",
    """WITH f AS (SELECT *, luminance / 40 + clip_id % 3 AS rd, 1.0 + frame_idx % 7 / 3 AS td, lag(luminance) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS p FROM frame_stats),
       a AS (SELECT clip_id, count(*) FILTER (abs(luminance-p) >= 0.3) n, quantile_cont(CASE WHEN abs(luminance-p) >= 0.3 THEN rd/(td+1e-6) END, 0.5) r FROM f GROUP BY 1)
       SELECT clip_id, n AS moving_frames, CASE WHEN n>=3 THEN round(r,6) END AS combing_ratio, CASE WHEN n>=3 THEN r > 1.0 END AS combed FROM a""",
    ("frame_stats",),
)
def _(spark, sf):
    f = _frames(spark, sf).withColumns({"row_diff": F.expr("luminance / 40 + clip_id % 3"), "two_row_diff": F.expr("1.0D + frame_idx % 7 / 3")})
    return sq.combing(f).select("clip_id", "moving_frames", round6("combing_ratio"), "combed")


@query(
    "scene_changes",
    """WITH f AS (SELECT label AS clip_id, vec_id AS frame_idx, embedding AS e FROM embeddings), g AS (SELECT *, lag(e) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS p FROM f),
       d AS (SELECT clip_id, frame_idx, list_max(list_transform(range(1,49), lambda i: abs(e[i]-p[i])::DOUBLE)) AS diff FROM g WHERE p IS NOT NULL),
       m AS (SELECT clip_id, quantile_cont(diff, 0.5) AS md FROM d GROUP BY 1)
       SELECT clip_id, frame_idx, round(diff, 6) AS diff FROM d JOIN m USING (clip_id) WHERE diff > greatest(0.03, 1.2*md)""",
)
def _(spark, sf):
    t = view(spark, sf, "vectors").select(C("label").alias("clip_id"), C("vec_id").alias("frame_idx"), C("embedding").alias("thumb"))
    return sq.scene_changes(t, 8, 8, factor=1.2).select("clip_id", "frame_idx", round6("diff"))


@query(
    "longest_unexamined",
    """WITH f AS (SELECT clip_id, CAST(epoch_us(ts) AS DOUBLE)/1000000 - 1704067200.0 AS t FROM frame_stats), l AS (SELECT clip_id, t, t - coalesce(lag(t) OVER (PARTITION BY clip_id ORDER BY t), 0) AS g FROM f)
       SELECT clip_id, round(greatest(max(g), max(t) + 5 - max(t)), 4) AS longest_s FROM l GROUP BY 1""",
    ("frame_stats",),
)
def _(spark, sf):
    f, dur = _timed(spark, sf)
    return sq.longest_unexamined(f, dur).select("clip_id", F.round("longest_s", 4).alias("longest_s"))


@query(
    "sample_frames",
    """WITH n AS (SELECT clip_id, max(frame_idx)+1 AS n FROM frame_stats GROUP BY 1),
       e AS (SELECT DISTINCT clip_id, CASE WHEN n <= 12 THEN i ELSE round_even(i*(n-1)/11.0::DOUBLE, 0)::BIGINT END AS frame_idx FROM n, range(0,12) r(i) WHERE n > 12 OR i < n),
       s AS (SELECT clip_id, frame_idx FROM frame_stats JOIN n USING (clip_id) WHERE frame_idx % greatest(1, n//12) = 0 AND frame_idx/greatest(1, n//12) < 12)
       SELECT 'even' AS mode, clip_id, frame_idx FROM e UNION ALL SELECT 'strided', clip_id, frame_idx FROM s""",
    ("frame_stats",),
)
def _(spark, sf):
    f = _frames(spark, sf).select("clip_id", "frame_idx")
    even = sq.sample_frames_even(f, 12).select(F.lit("even").alias("mode"), "clip_id", "frame_idx")
    return even.unionByName(sq.sample_frames_strided(f, 12).select(F.lit("strided").alias("mode"), "clip_id", "frame_idx"))
