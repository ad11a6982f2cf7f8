"""Evidence, scoring and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.functions import decisions as dec
from candorframe.functions import labels as lab
from candorframe.functions import scoring as sc
from candorframe.operators import evidence as evd
from candorframe.tables import round6, view

C = F.col
FLAG = "CAST(media_id % {m} = {r} AS BOOLEAN)"


def expr_cols(text: str) -> dict:
    """Column dictionary from 'name: sql' lines."""
    out = {}
    for part in text.strip().split("\n"):
        name, sql = part.split(":", 1)
        out[name.strip()] = F.expr(sql.strip())
    return out


def names_cols(*names: str) -> dict:
    return {n: C(n) for n in names}


@query(
    "cap_evidence",
    """WITH t AS (SELECT media_id, check_id, sum(greatest(-llr_cap, least(llr_cap, llr))) AS term FROM findings
        WHERE evidence_class IN ('PHYSICAL_SIGNAL','LEARNED_SIGNAL','METADATA_WEAK') AND llr <> 0 GROUP BY 1, 2),
       s AS (SELECT media_id, abs(sum(term)) AS tot FROM t GROUP BY 1)
       SELECT media_id, check_id, round(CASE WHEN tot > 0.40 THEN term * (0.40 / tot) ELSE term END, 6) + 0.0 AS term FROM t JOIN s USING (media_id)""",
    ("findings",),
)
def _(spark, sf):
    return evd.cap_evidence(view(spark, sf, "findings")).select("media_id", "check_id", (F.round("term", 6) + 0.0).alias("term"))


ORDER = ["seq", "check_id", "status", "evidence_class", "llr"]


def _findings(spark, sf):
    return view(spark, sf, "findings").withColumns(
        {
            "title": F.concat(F.lit("check "), C("check_id")),
            "detail": F.concat(F.lit("row "), C("seq").cast("string")),
            "level": F.when(C("seq") % 2 == 0, F.when(C("check_id") == "c1", "LOW").otherwise("REDUCED")),
        }
    )


@query(
    "dimension_report",
    """WITH f AS (SELECT *, CASE WHEN seq % 2 = 0 THEN CASE WHEN check_id = 'c1' THEN 'LOW' ELSE 'REDUCED' END END AS level FROM findings),
       a AS (SELECT media_id, count(*) AS total, count(*) FILTER (status='PASS') AS pass, count(*) FILTER (status='WARN') AS warn,
        count(*) FILTER (status='FAIL') AS fail, count(*) FILTER (status='INFO') AS info, count(*) FILTER (status='NOT_APPLICABLE') AS not_applicable,
        count(*) FILTER (status='NOT_CALIBRATED') AS not_calibrated, count(*) FILTER (status='RECOGNIZED_OOS') AS recognized_oos,
        count(*) FILTER (status='ERROR') AS error FROM f GROUP BY 1),
       b AS (SELECT media_id, string_agg(stage || '=' || n::VARCHAR, ',' ORDER BY stage) AS by_stage FROM (SELECT media_id, stage, count(*) n FROM f GROUP BY 1,2) GROUP BY 1),
       l AS (SELECT media_id, level FROM (SELECT media_id, level, row_number() OVER (PARTITION BY media_id ORDER BY seq, check_id, status, evidence_class, llr) rn
             FROM f WHERE evidence_class='RELIABILITY' AND level IS NOT NULL) WHERE rn = 1)
       SELECT a.*, by_stage, level AS reliability_level FROM a JOIN b USING (media_id) LEFT JOIN l USING (media_id)""",
    ("findings",),
)
def _(spark, sf):
    r = evd.dimension_report(_findings(spark, sf), ORDER)
    text = F.array_join(F.transform(F.map_entries("by_stage"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.withColumn("by_stage", text)


TRAIL_SQL = """SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY st, stage, seq, check_id, status, evidence_class, llr) - 1 AS pos, line FROM (
 SELECT media_id, stage, seq, check_id, status, evidence_class, llr, '[' || evidence_class || '] check ' || check_id || ': row ' || seq::VARCHAR AS line,
  min({'a': seq, 'b': check_id, 'c': status, 'd': evidence_class, 'e': llr}) OVER (PARTITION BY media_id, stage) AS st FROM findings) q
 WHERE status IN ('FAIL','WARN') AND evidence_class IN ('SECURITY','METADATA_WEAK','PHYSICAL_SIGNAL','LEARNED_SIGNAL')"""


@query("evidence_trail", TRAIL_SQL, ("findings",))
def _(spark, sf):
    return evd.evidence_trail(_findings(spark, sf), ORDER)


@query(
    "key_reasons",
    f"""WITH trail AS ({TRAIL_SQL}),
       own AS (SELECT DISTINCT media_id, 0 AS tier, 0 AS st, 0 AS ord, 'score and metadata agree' AS reason FROM findings WHERE media_id % 3 = 0),
       fl AS (SELECT media_id, 1 AS tier, substr(stage, 6)::INT + 1 AS st, seq AS ord, 'check ' || check_id || ': row ' || seq::VARCHAR AS reason
              FROM findings WHERE status IN ('FAIL','WARN') AND media_id % 2 = 0),
       tr AS (SELECT media_id, 2 AS tier, 0 AS st, pos AS ord, line AS reason FROM trail),
       u AS (SELECT * FROM own UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM tr),
       k AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY tier, st, ord, reason) AS "rank", min(tier) OVER (PARTITION BY media_id) AS best FROM u)
       SELECT media_id, "rank", reason FROM k WHERE "rank" <= 4 AND (tier < 2 OR best = 2)""",
    ("findings",),
)
def _(spark, sf):
    f = _findings(spark, sf)
    trail = evd.evidence_trail(f, ORDER)
    own = f.where("media_id % 3 = 0").select("media_id").distinct().select("media_id", F.lit(0).alias("pos"), F.lit("score and metadata agree").alias("reason"))
    names = F.array(*[F.lit(s) for s in evd.REASON_STAGES])
    staged = f.where("media_id % 2 = 0").withColumn("stage", F.element_at(names, F.substring("stage", 6, 2).cast("int") + 1))
    return evd.key_reasons(own, staged, trail, ["seq"])


@query(
    "union_phases",
    """SELECT CASE WHEN seq <= 3 THEN 0 ELSE 1 END AS phase, status, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM findings GROUP BY 1, 2""",
    ("findings",),
)
def _(spark, sf):
    f = view(spark, sf, "findings")
    both = evd.union_phases(f.where("seq <= 3"), f.where("seq > 3"))
    return both.groupBy("phase", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


GAP_SQL = """(SELECT media_id, a, r, greatest(3.0, (1 - least(1.0, abs(a - r) / 100)) * 20) AS u FROM {src})"""
DECL_SQL = "SELECT DISTINCT media_id, CASE WHEN media_id % 14 = 0 THEN 1 ELSE 0 END AS m FROM modality_results WHERE media_id % 7 = 0"
FUSE_SQL = f"""e AS (SELECT media_id, ai_pct, real_pct, CASE modality WHEN 'video' THEN 1.2 ELSE 1.0 END * greatest(0.0, least(1.0, 1 - undecided_pct/100)) AS w
  FROM modality_results WHERE modality = 'video' OR ai_pct > 0 OR real_pct > 0
  UNION ALL SELECT media_id, CASE m WHEN 1 THEN 98.0 ELSE 95.0 END, CASE m WHEN 1 THEN 1.0 ELSE 5.0 END, CASE m WHEN 1 THEN 2.0 ELSE 1.5 END FROM ({DECL_SQL})),
 p AS (SELECT media_id, sum(w * ln(greatest(1e-4, least(1-1e-4, ai_pct/100)) / greatest(1e-4, least(1-1e-4, real_pct/100)))) AS pooled FROM e GROUP BY 1),
 o AS (SELECT media_id, exp(greatest(-6.0, least(6.0, pooled))) AS od FROM p), ar AS (SELECT media_id, od/(1+od)*100 AS a, (1-od/(1+od))*100 AS r FROM o),
 g AS {GAP_SQL.format(src='ar')},
 n AS (SELECT media_id, round(a/(a+r)*(100-u), 1) AS p_ai, round(r/(a+r)*(100-u), 1) AS p_real FROM g)"""


@query(
    "fuse_modalities",
    f"WITH {FUSE_SQL} SELECT media_id, p_ai, p_real, round(100 - (p_ai + p_real), 1) AS p_undecided FROM n",
    ("modality_results",),
)
def _(spark, sf):
    r = view(spark, sf, "modality_results")
    declared = r.where("media_id % 7 = 0").select("media_id", F.when(C("media_id") % 14 == 0, "manifest").otherwise("metadata").alias("kind"))
    return evd.fuse_modalities(evd.evidence_rows(r, declared))


@query(
    "cross_modal_consistency",
    """WITH v AS (SELECT media_id, ai_pct va, media_id % 4 = 0 AS outdoor FROM modality_results WHERE modality = 'video'),
       a AS (SELECT media_id, ai_pct aa, undecided_pct/100 AS sil FROM modality_results WHERE modality = 'audio'),
       j AS (SELECT v.media_id, va, aa, (abs(va-aa) >= 40)::INT + (outdoor AND sil > 0.15)::INT AS n FROM v LEFT JOIN a USING (media_id))
       SELECT media_id, CASE WHEN aa IS NULL THEN 'SINGLE_MODALITY_VIDEO' WHEN n >= 2 THEN 'CROSS_MODAL_INCONSISTENT' WHEN n = 1 THEN 'SUSPICIOUS_ASYMMETRY'
        ELSE 'CROSS_MODAL_COHERENT' END AS status, CASE WHEN aa IS NULL THEN 0.0 ELSE round(abs(va-aa), 1) END AS asymmetry_score,
        CASE WHEN aa IS NULL THEN 'LOW' WHEN n >= 2 THEN 'HIGH' WHEN n = 1 THEN 'MEDIUM' ELSE 'LOW' END AS tampering_risk, coalesce(n, 0) AS anomalies FROM j""",
    ("modality_results",),
)
def _(spark, sf):
    r = view(spark, sf, "modality_results")
    v = r.where("modality = 'video'").select("media_id", C("ai_pct").alias("vid_ai"), (C("media_id") % 4 == 0).alias("outdoor"))
    a = r.where("modality = 'audio'").select("media_id", C("ai_pct").alias("aud_ai"), (C("undecided_pct") / 100).alias("silence_ratio"))
    return evd.cross_modal_consistency(v, a)


@query(
    "normalise_percentages",
    f"""WITH q AS (SELECT media_id, modality, CASE WHEN media_id % 50 = 0 THEN 0.0 ELSE ai_pct END AS a, CASE WHEN media_id % 50 = 0 THEN 0.0 ELSE real_pct END AS r,
         undecided_pct AS u0 FROM modality_results),
       x AS (SELECT *, greatest(3.0, u0) AS u1, greatest(3.0, (1 - least(1.0, abs(a-r)/100))*20) AS u2 FROM q),
       y AS (SELECT *, round(a*(100.0/(a+r+u1)), 1) AS a1, round(r*(100.0/(a+r+u1)), 1) AS r1,
             CASE WHEN a+r > 0 THEN round(a/(a+r)*(100-u2), 1) ELSE 0 END AS a2, CASE WHEN a+r > 0 THEN round(r/(a+r)*(100-u2), 1) ELSE 0 END AS r2 FROM x)
       SELECT media_id, modality, a1 AS ai_margin, r1 AS real_margin, round(greatest(0.0, 100-(a1+r1)), 1) AS undecided_margin,
        a2::DOUBLE AS ai_gap, r2::DOUBLE AS real_gap, CASE WHEN a+r > 0 THEN round(100-(a2+r2), 1) ELSE 100.0 END AS undecided_gap FROM y""",
    ("modality_results",),
)
def _(spark, sf):
    r = view(spark, sf, "modality_results")
    zero = C("media_id") % 50 == 0
    a, b = F.when(zero, 0.0).otherwise(C("ai_pct")), F.when(zero, 0.0).otherwise(C("real_pct"))
    t = r.select("media_id", "modality", sc.normalise_with_margin(a, b, C("undecided_pct")).alias("m"), sc.normalise_by_gap(a, b).alias("g"))
    return t.select(
        "media_id", "modality", C("m.ai").alias("ai_margin"), C("m.real").alias("real_margin"), C("m.undecided").alias("undecided_margin"),
        C("g.ai").alias("ai_gap"), C("g.real").alias("real_gap"), C("g.undecided").alias("undecided_gap"),
    )


ENT_SQL = "(-q*log2(q) - (1-q)*log2(1-q))"


@query(
    "undecided_margin",
    f"""WITH x AS (SELECT media_id, modality, greatest(1e-6, least(1-1e-6, ai_pct/100)) AS q FROM modality_results)
       SELECT media_id, modality, round({ENT_SQL}, 6) AS entropy, round(CASE modality WHEN 'image' THEN greatest(3.0, least(24.0, 20*{ENT_SQL}))
        WHEN 'audio' THEN greatest(3.0, least(22.0, 18*{ENT_SQL})) ELSE greatest(4.0, least(25.0, 20*{ENT_SQL})) END, 6) AS margin FROM x""",
    ("modality_results",),
)
def _(spark, sf):
    p = C("ai_pct") / 100
    return view(spark, sf, "modality_results").select(
        "media_id", "modality", F.round(sc.binary_entropy(p), 6).alias("entropy"), F.round(sc.undecided_margin(p, C("modality")), 6).alias("margin")
    )


@query(
    "shift_log_odds",
    """WITH t AS (SELECT media_id, greatest(-1.0, least(1.0, sum(llr))) AS tot FROM findings GROUP BY 1),
       x AS (SELECT media_id, tot, (media_id % 101) / 100 AS p, greatest(0.01, least(0.99, (media_id % 101) / 100)) AS pc FROM t)
       SELECT media_id, round(CASE WHEN abs(tot) < 1e-12 THEN p ELSE greatest(0.01, least(0.99, 1/(1+pow(10.0, -(log10(pc/(1-pc)) + tot))))) END, 6) AS p_shifted FROM x""",
    ("findings",),
)
def _(spark, sf):
    f = view(spark, sf, "findings").groupBy("media_id").agg(F.sum("llr").alias("total"))
    return f.select("media_id", F.round(sc.shift_log_odds(C("media_id") % 101 / 100, C("total")), 6).alias("p_shifted"))


TERM_SQL = "CASE check_id WHEN 'c0' THEN 'sensor_noise' WHEN 'c1' THEN 'surface_smoothness' WHEN 'c2' THEN 'surface_smoothness' ELSE check_id END"


@query(
    "pool_log_odds",
    f"""WITH t AS (SELECT media_id, {TERM_SQL} AS term, llr FROM findings),
       a AS (SELECT media_id, sum(CASE WHEN term <> 'surface_smoothness' THEN llr ELSE 0 END) rest, sum(CASE WHEN term = 'surface_smoothness' THEN llr ELSE 0 END) sm,
        bool_or(term = 'sensor_noise') hn FROM t GROUP BY 1), b AS (SELECT media_id, 0.20 + rest + sm * CASE WHEN hn THEN 0.70 ELSE 1.0 END AS lo FROM a)
       SELECT media_id, round(lo, 6) + 0.0 AS log_odds, round(1/(1+pow(10.0, -greatest(-6.0, least(6.0, lo)))), 6) AS p_ai FROM b""",
    ("findings",),
)
def _(spark, sf):
    t = view(spark, sf, "findings").select("media_id", F.expr(TERM_SQL).alias("term"), C("llr").alias("value"))
    return evd.pool_log_odds(t, "high").select("media_id", (F.round("log_odds", 6) + 0.0).alias("log_odds"), round6("p_ai"))


def llr_sql(x, mr, sr, ma, sa):
    return (
        f"greatest(-3.0, least(3.0, log10({sr}/{sa}) - pow({x}-({ma}),2)/(2*pow({sa},2)*ln(10.0)) + pow({x}-({mr}),2)/(2*pow({sr},2)*ln(10.0))))"
    )


# Given measurements, derived from the row's own numbers.
MEASURED = """noise: p_ai_pct / 25
smooth: latency_s * 4
w: CAST(media_id % 7 * 150 + 300 AS INT)
h: CAST(media_id % 5 * 200 + 256 AS INT)
lossy_jpeg: media_id % 6 = 0
has_camera: media_id % 4 = 0
is_scanned: media_id % 17 = 0
is_art: media_id % 13 = 0
flat_noise: CASE WHEN media_id % 2 = 0 THEN p_ai_pct / 30 END
noise_offset: CAST((media_id % 3) * 0.05 AS DOUBLE)
smooth_offset: CAST((media_id % 3) * -0.05 AS DOUBLE)"""
MEASURED_SQL = ", ".join(f"{line.split(':', 1)[1]} AS {line.split(':', 1)[0]}" for line in MEASURED.split("\n"))


@query(
    "gaussian_llr",
    f"SELECT media_id, round({llr_sql('p_ai_pct/25', 2.45, 0.65, 0.85, 0.45)}, 6) + 0.0 AS noise_llr, round({llr_sql('latency_s*4', 1.95, 0.5, 0.75, 0.4)}, 6) + 0.0 AS smooth_llr FROM predictions",
    ("predictions",),
)
def _(spark, sf):
    n = sc.gaussian_llr(C("p_ai_pct") / 25, sc.REAL_NOISE, sc.AI_NOISE)
    s = sc.gaussian_llr(C("latency_s") * 4, sc.REAL_SMOOTH, sc.AI_SMOOTH)
    return view(spark, sf, "predictions").select("media_id", (F.round(n, 6) + 0.0).alias("noise_llr"), (F.round(s, 6) + 0.0).alias("smooth_llr"))


@query(
    "pixel_terms",
    f"""WITH m AS (SELECT media_id, {MEASURED_SQL} FROM predictions),
       r AS (SELECT *, {llr_sql('(CASE WHEN is_art THEN coalesce(flat_noise, noise) ELSE noise END)', 2.45, 0.65, '0.85+noise_offset', 0.45)} AS n0,
             {llr_sql('smooth', 1.95, 0.5, '0.75+smooth_offset', 0.4)} AS s0 FROM m),
       g AS (SELECT *, CASE WHEN greatest(w,h) <= 400 OR lossy_jpeg THEN least(n0, 0) ELSE n0 END AS n1, CASE WHEN greatest(w,h) <= 400 OR lossy_jpeg THEN least(s0, 0) ELSE s0 END AS s1 FROM r),
       u AS (SELECT *, has_camera AND NOT is_scanned AND greatest(n1,0) + greatest(s1,0) >= 2.0 AS untrusted FROM g),
       d AS (SELECT *, (has_camera AND NOT untrusted) OR is_scanned AS dis FROM u)
       SELECT media_id, round((CASE WHEN is_art THEN greatest(0.15, CASE WHEN dis THEN least(0.15, n1) ELSE n1 END) WHEN dis THEN least(0.15, n1) ELSE n1 END) * 0.35, 6) + 0.0 AS sensor_noise,
        round((CASE WHEN is_art THEN greatest(0.20, CASE WHEN dis THEN least(0.10, s1) ELSE s1 END) WHEN dis THEN least(0.10, s1) ELSE s1 END) * 0.30, 6) + 0.0 AS surface_smoothness,
        CASE WHEN has_camera THEN CASE WHEN untrusted THEN -0.3 ELSE -1.4 END END::DOUBLE AS exif_hardware FROM d""",
    ("predictions",),
)
def _(spark, sf):
    m = view(spark, sf, "predictions").select("media_id", *[c.alias(n) for n, c in expr_cols(MEASURED).items()])
    t = sc.pixel_terms({n: C(n) for n in m.columns if n != "media_id"})
    return m.select(
        "media_id", (F.round(t["sensor_noise"], 6) + 0.0).alias("sensor_noise"), (F.round(t["surface_smoothness"], 6) + 0.0).alias("surface_smoothness"),
        t["exif_hardware"].alias("exif_hardware"),
    )


SLOPE = """alpha: CASE WHEN media_id % 9 = 0 THEN NULL ELSE latency_s * 4 END
w: CAST(media_id % 7 * 150 + 300 AS INT)
h: CAST(media_id % 5 * 200 + 456 AS INT)
lossy_jpeg: media_id % 6 = 0
is_jpeg: media_id % 2 = 0
has_camera: media_id % 4 = 0
is_scanned: media_id % 17 = 0
anomalous_decay: media_id % 11 = 0"""
SLOPE_SQL = ", ".join(f"{line.split(':', 1)[1]} AS {line.split(':', 1)[0]}" for line in SLOPE.split("\n"))


@query(
    "spectral_slope_term",
    f"""WITH m AS (SELECT media_id, {SLOPE_SQL} FROM predictions), z AS (SELECT *, has_camera OR is_jpeg OR is_scanned AS cam FROM m)
       SELECT media_id, CASE WHEN alpha IS NULL OR lossy_jpeg OR least(w,h) < 512 THEN NULL WHEN cam THEN
         round(CASE WHEN alpha > 3.45 OR alpha < 1.65 THEN greatest(0.2, least(1.5, abs((alpha-2.68)/0.35)*0.4)) ELSE -0.4 END * 0.2, 6) ELSE
         round(CASE WHEN anomalous_decay OR abs((alpha-2.15)/0.25) > 2 THEN greatest(0.2, least(1.5, abs((alpha-2.15)/0.25)*0.4)) ELSE -0.4 END * 0.2, 6) END AS term FROM z""",
    ("predictions",),
)
def _(spark, sf):
    m = view(spark, sf, "predictions").select("media_id", *[c.alias(n) for n, c in expr_cols(SLOPE).items()])
    return m.select("media_id", F.round(sc.spectral_slope_term({n: C(n) for n in m.columns}), 6).alias("term"))


DECLARED = """ai_signature: media_id % 6 = 0
enhancer_signature: media_id % 5 = 0
has_camera: make IS NOT NULL AND model IS NOT NULL
c2pa_present: media_id % 8 = 0
watermark: media_id % 19 = 0
is_scanned: media_id % 17 = 0
inpainted: media_id % 9 = 0
inpaint_confidence: CAST(0.75 AS DOUBLE)
w: w
h: h
is_art: media_id % 13 = 0
art_confidence: CAST(0.8 AS DOUBLE)"""


@query(
    "declared_terms",
    """WITH m AS (SELECT media_id, media_id%6=0 AS sig, media_id%5=0 AS enh, make IS NOT NULL AND model IS NOT NULL AS cam, media_id%8=0 AS c2, media_id%19=0 AS wm,
        media_id%17=0 AS scan, media_id%9=0 AND greatest(w,h) > 400 AS inp, media_id%13=0 AS art FROM media_tags)
       SELECT media_id, concat_ws(',', CASE WHEN sig THEN 'exif_ai_signature=3.2' WHEN enh THEN 'ai_enhancer_signature=1.2' WHEN cam THEN 'exif_hardware=-1.4' END,
        CASE WHEN NOT cam AND NOT sig AND NOT enh AND NOT c2 THEN 'metadata_absent=0.0' END, CASE WHEN wm THEN 'ai_watermark=3.5' END, CASE WHEN scan THEN 'scanned_print=-2.2' END,
        CASE WHEN inp THEN 'inpainting_splicing=1.35' END, CASE WHEN art AND NOT cam AND NOT scan THEN 'digital_art_synthesis=0.64' END) AS terms FROM m""",
    ("media_tags",),
)
def _(spark, sf):
    m = view(spark, sf, "media_tags").select("media_id", *[c.alias(n) for n, c in expr_cols(DECLARED).items()], "make")
    terms = sc.declared_terms({n: C(n) for n in m.columns})
    text = F.array_join(F.transform(F.map_entries(terms), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("string"))), ",")
    return m.select("media_id", text.alias("terms"))


@query(
    "pool_audio",
    """WITH q AS (SELECT media_id, media_id%3=0 AS voc, p_ai_pct/25000 AS flat, CASE WHEN media_id%5=0 THEN NULL ELSE latency_s/4 END AS sil,
        p_ai_pct/2000 AS hf, CASE WHEN media_id%4=0 THEN p_ai_pct/100 END AS nn FROM predictions),
       a AS (SELECT media_id, nn, (CASE WHEN voc THEN 0.9 ELSE 0.1 END*0.4 + CASE WHEN flat < 0.002 THEN 0.85 ELSE 0.15 END*0.3 + CASE WHEN hf < 0.01 THEN 0.7 ELSE 0.2 END*0.1)
         * CASE WHEN sil IS NULL THEN 1.25 ELSE 1.0 END + CASE WHEN sil IS NULL THEN 0 WHEN sil > 0.12 THEN 0.85*0.2 ELSE 0.15*0.2 END AS ac FROM q)
       SELECT media_id, round(greatest(0.01, least(0.99, CASE WHEN nn IS NULL THEN ac::DOUBLE ELSE 0.55*nn + 0.45*ac END)), 6) AS p_ai FROM a""",
    ("predictions",),
)
def _(spark, sf):
    c = expr_cols("""has_vocoder_cutoff: media_id % 3 = 0
spectral_flatness: p_ai_pct / 25000
digital_silence_ratio: CASE WHEN media_id % 5 = 0 THEN NULL ELSE latency_s / 4 END
high_freq_ratio: p_ai_pct / 2000
neural_prob: CASE WHEN media_id % 4 = 0 THEN p_ai_pct / 100 END""")
    return view(spark, sf, "predictions").select("media_id", F.round(sc.pool_audio(c), 6).alias("p_ai"))


@query(
    "pool_video",
    """WITH q AS (SELECT media_id, p_ai_pct/100 AS fa, CASE media_id%5 WHEN 0 THEN NULL WHEN 1 THEN 'HIGH_WARPING_DETECTED' WHEN 2 THEN 'UNNATURAL_FREEZE' ELSE 'LOW' END AS wr,
        CASE media_id%3 WHEN 0 THEN NULL ELSE media_id%3=1 END AS fl, CASE WHEN media_id%4=0 THEN latency_s END AS nn FROM predictions),
       w AS (SELECT *, CASE WHEN wr IS NULL THEN 0.0 ELSE 0.25 END AS ww, CASE WHEN fl IS NULL THEN 0.0 ELSE 0.15 END AS wf, CASE WHEN nn IS NULL THEN 0.0 ELSE 0.35 END AS wn FROM q)
       SELECT media_id, round(greatest(0.01, least(0.99, (fa*0.60 + CASE WHEN wr IN ('HIGH_WARPING_DETECTED','UNNATURAL_FREEZE') THEN 0.85 ELSE 0.15 END*ww
         + CASE WHEN fl THEN 0.80 ELSE 0.20 END*wf + coalesce(nn,0)*wn) / (0.60+ww+wf+wn))), 6) AS p_ai FROM w""",
    ("predictions",),
)
def _(spark, sf):
    c = expr_cols("""mean_frame_ai: p_ai_pct / 100
warping_risk: CASE media_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HIGH_WARPING_DETECTED' WHEN 2 THEN 'UNNATURAL_FREEZE' ELSE 'LOW' END
has_flicker: CASE media_id % 3 WHEN 0 THEN NULL ELSE media_id % 3 = 1 END
neural_prob: CASE WHEN media_id % 4 = 0 THEN latency_s END""")
    return view(spark, sf, "predictions").select("media_id", F.round(sc.pool_video(c), 6).alias("p_ai"))


@query(
    "score_frame",
    """WITH q AS (SELECT event_id, 0.5 + (0.55/(1+exp((greatest(0.2, noise-0.7)-2.0)*2.0)) + 0.45/(1+exp((smooth-3.1)*1.3)) - 0.5)*0.4 AS s FROM feedback)
       SELECT event_id, round(s, 6) AS ai_prob, CASE WHEN s >= 0.60 THEN 'LIKELY AI-GENERATED' WHEN s <= 0.35 THEN 'LIKELY REAL' ELSE 'UNDECIDED' END AS label FROM q""",
    ("feedback",),
)
def _(spark, sf):
    t = view(spark, sf, "feedback").select("event_id", sc.score_frame(C("noise"), C("smooth")).alias("s"))
    return t.select("event_id", F.round("s.ai_prob", 6).alias("ai_prob"), "s.label")


@query(
    "three_way_label",
    """SELECT media_id, modality, CASE WHEN ai_pct >= 55 THEN 'LIKELY AI-GENERATED' WHEN real_pct >= 55 THEN 'LIKELY REAL' ELSE 'UNDECIDED' END AS balanced,
       CASE WHEN ai_pct >= 50 THEN 'LIKELY AI-GENERATED' WHEN real_pct >= 55 THEN 'LIKELY REAL' ELSE 'UNDECIDED' END AS aggressive FROM modality_results""",
    ("modality_results",),
)
def _(spark, sf):
    a, r = C("ai_pct"), C("real_pct")
    return view(spark, sf, "modality_results").select(
        "media_id", "modality", lab.three_way_label(a, r).alias("balanced"), lab.three_way_label(a, r, "aggressive").alias("aggressive")
    )


TAX = """ai_pct: CAST(media_id * 37 % 101 AS DOUBLE)
real_pct: CAST(100 - media_id * 37 % 101 AS DOUBLE)
noise: CAST(media_id * 13 % 40 AS DOUBLE) / 13
smooth: CAST(media_id * 7 % 40 AS DOUBLE) / 13
is_screenshot: media_id % 10 = 3
watermark: media_id % 23 = 0
ai_iptc: media_id % 29 = 0
pure_ai_meta: media_id % 31 = 0
enhancer: media_id % 19 = 0
composite_label: media_id % 37 = 0
inpainted: media_id % 7 = 0
is_art: media_id % 11 = 0
cgi_medium: media_id % 2 = 0
has_camera: make IS NOT NULL AND model IS NOT NULL
camera_make: make
is_scanned: media_id % 17 = 0
is_cutout: media_id % 13 = 0
canvas_match: w = h
metadata_absent: make IS NULL
synthetic_signals: CAST(media_id % 4 AS INT)
recapture: media_id % 41 = 0
graphic_edit: coalesce(software LIKE 'Adobe%', false)
text_count: CAST(media_id % 5 AS INT)
optics: model IS NOT NULL"""
TAX_SQL = ", ".join(f"{line.split(':', 1)[1]} AS {line.split(':', 1)[0]}" for line in TAX.split("\n"))


@query(
    "image_taxonomy",
    f"""WITH c AS (SELECT media_id, {TAX_SQL} FROM media_tags),
       d AS (SELECT *, watermark OR ai_iptc OR pure_ai_meta AS dec, NOT has_camera AND NOT is_scanned AS plain, inpainted AND ai_pct >= 60 AS ic,
             is_cutout OR graphic_edit OR (text_count >= 3 AND NOT is_art) AS es,
             (has_camera OR noise >= 1.35 OR real_pct >= 50) AND ai_pct < 50 AS er FROM c),
       k AS (SELECT *, CASE WHEN is_screenshot AND (dec OR ai_pct >= 62 OR (is_art AND ai_pct >= 58)) THEN 'S1' WHEN is_screenshot AND (enhancer OR inpainted) THEN 'S2'
        WHEN is_screenshot THEN 'S3' WHEN (dec OR (is_art AND plain AND ai_pct >= 58)) AND is_art AND cgi_medium AND NOT dec THEN 'G1'
        WHEN dec OR (is_art AND plain AND ai_pct >= 58) THEN 'G2' WHEN enhancer OR composite_label OR ic THEN 'C1' WHEN has_camera AND NOT is_scanned AND ai_pct >= 62 THEN 'C2'
        WHEN (ai_pct >= 58 OR (ai_pct >= 48 AND canvas_match)) AND plain AND NOT (noise > 1.85 AND smooth > 1.60) AND NOT (metadata_absent AND synthetic_signals < 2) THEN 'P1'
        WHEN recapture THEN 'R1' WHEN es AND er THEN 'E1' WHEN es AND (ai_pct >= 50 OR noise < 1.10) THEN 'E2' WHEN inpainted AND NOT is_scanned AND ai_pct < 35 THEN 'L1'
        WHEN is_scanned THEN 'D1' ELSE 'D2' END AS st FROM d)
       SELECT media_id, CASE st WHEN 'S1' THEN 'AI_GENERATED_SCREENSHOT' WHEN 'S2' THEN 'AI_ENHANCED_SCREENSHOT' WHEN 'S3' THEN 'AUTHENTIC_SCREENSHOT'
         WHEN 'G1' THEN 'PROCEDURAL_CGI_SYNTHETIC' WHEN 'G2' THEN 'FULLY_AI_GENERATED' WHEN 'C1' THEN 'AI_ENHANCED_COMPOSITE' WHEN 'C2' THEN 'AI_ENHANCED_COMPOSITE'
         WHEN 'P1' THEN 'FULLY_AI_GENERATED' WHEN 'R1' THEN 'AUTHENTIC_RECAPTURED_SCREEN' WHEN 'E1' THEN 'AUTHENTIC_EDITED' WHEN 'E2' THEN 'FULLY_AI_GENERATED'
         WHEN 'L1' THEN 'AUTHENTIC_EDITED' ELSE 'AUTHENTIC_REAL_PHOTOGRAPH' END AS state,
        CASE st WHEN 'S1' THEN concat_ws(',', 'screen_capture', CASE WHEN watermark THEN 'watermark' END, CASE WHEN ai_iptc THEN 'ai_label' END, CASE WHEN is_art THEN 'digital_art' END)
         WHEN 'S2' THEN concat_ws(',', 'screen_capture', CASE WHEN inpainted THEN 'inpainting' END, CASE WHEN enhancer THEN 'enhancer' END) WHEN 'S3' THEN 'screen_capture,no_ai_sign'
         WHEN 'G1' THEN 'cgi_rendering,no_camera_grain'
         WHEN 'G2' THEN concat_ws(',', CASE WHEN watermark THEN 'watermark' END, CASE WHEN ai_iptc THEN 'ai_label' END, CASE WHEN pure_ai_meta THEN 'generator_metadata' END,
            CASE WHEN is_art THEN 'digital_art,non_optical_rendering' END, CASE WHEN is_art AND is_cutout THEN 'cutout_asset' END, CASE WHEN NOT is_art THEN 'pixel_metrics' END,
            CASE WHEN canvas_match THEN 'canvas_size' END)
         WHEN 'C1' THEN concat_ws(',', CASE WHEN ic THEN 'inpainting' END, CASE WHEN enhancer THEN 'enhancer' END, CASE WHEN enhancer AND camera_make IS NOT NULL THEN 'camera_base' END)
         WHEN 'C2' THEN 'camera_tags,pixel_evidence_against_camera'
         WHEN 'P1' THEN concat_ws(',', 'high_posterior,over_smooth', CASE WHEN canvas_match THEN 'canvas_size' END, CASE WHEN is_cutout THEN 'cutout_asset' END)
         WHEN 'R1' THEN concat_ws(',', 'screen_recapture', CASE WHEN camera_make IS NOT NULL THEN 'camera_base' END)
         WHEN 'E1' THEN concat_ws(',', CASE WHEN is_cutout THEN 'background_removed' END, CASE WHEN graphic_edit THEN 'graphic_software' END, CASE WHEN text_count >= 3 THEN 'typography' END, 'noise_not_ai')
         WHEN 'E2' THEN 'isolated_subject,no_camera_grain' WHEN 'L1' THEN 'uneven_noise,ordinary_processing' WHEN 'D1' THEN 'print_scan,scan_consistent'
         ELSE concat_ws(',', CASE WHEN camera_make IS NOT NULL THEN 'camera_tags' END, CASE WHEN optics THEN 'lens_parameters' END, 'nothing_found') END AS reasons FROM k""",
    ("media_tags",),
)
def _(spark, sf):
    m = view(spark, sf, "media_tags").select("media_id", *[c.alias(n) for n, c in expr_cols(TAX).items()])
    t = m.select("media_id", dec.image_taxonomy({n: C(n) for n in m.columns}).alias("t"))
    return t.select("media_id", "t.state", F.array_join("t.reasons", ",").alias("reasons"))


WIDE_STATE = """CASE media_id % 8 WHEN 0 THEN 'AUTHENTIC_REAL_PHOTOGRAPH' WHEN 1 THEN 'AUTHENTIC_EDITED' WHEN 2 THEN 'FULLY_AI_GENERATED' WHEN 3 THEN 'AI_ENHANCED_COMPOSITE'
 WHEN 4 THEN 'AUTHENTIC_RECAPTURED_SCREEN' WHEN 5 THEN 'AI_GENERATED_SCREENSHOT' END"""


@query(
    "face_led_blend",
    f"""WITH q AS (SELECT media_id, ai_pct ai, real_pct re, undecided_pct un, {WIDE_STATE} AS st, CASE WHEN media_id % 3 = 0 THEN NULL ELSE 0.90 + (media_id % 11)/100 END AS fp
         FROM modality_results WHERE modality = 'image'),
       b AS (SELECT *, round(ai*0.35 + fp*65.0, 1) AS mx FROM q), l AS (SELECT *, coalesce(fp >= 0.95 AND mx > ai AND coalesce(st,'') <> 'AI_GENERATED_SCREENSHOT', false) AS ld FROM b)
       SELECT media_id, CASE WHEN ld THEN mx ELSE ai END AS ai, CASE WHEN ld THEN round(100 - mx - least(un, 100-mx), 1) ELSE re END AS "real",
        CASE WHEN ld THEN round(least(un, 100-mx), 1) ELSE un END AS undecided,
        CASE WHEN ld AND mx >= 65 AND (st IS NULL OR st IN ('AUTHENTIC_REAL_PHOTOGRAPH','AUTHENTIC_EDITED','AUTHENTIC_RECAPTURED_SCREEN')) THEN 'FULLY_AI_GENERATED' ELSE st END AS state,
        ld AS blended FROM l""",
    ("modality_results",),
)
def _(spark, sf):
    q = view(spark, sf, "modality_results").where("modality = 'image'")
    fp = F.when(C("media_id") % 3 != 0, F.lit(0.90) + C("media_id") % 11 / 100)
    b = dec.face_led_blend(C("ai_pct"), C("real_pct"), C("undecided_pct"), F.expr(WIDE_STATE), fp)
    return q.select("media_id", b.alias("b")).select("media_id", "b.*")


FUSED_STATUS = "CASE WHEN {a} >= 65 THEN 'LIKELY_SYNTHETIC' WHEN {r} >= 55 AND {a} < 35 THEN 'LIKELY_AUTHENTIC' WHEN {a} >= 50 THEN 'PARTIALLY_SYNTHETIC_OR_EDITED' ELSE 'UNDETERMINED' END"
FUSED_TAX = """CASE WHEN {s} = 'UNDETERMINED' AND {a} < 50 THEN 'UNDETERMINED' WHEN {s} IN ('LIKELY_SYNTHETIC','LIKELY AI-GENERATED') OR {a} >= 65 THEN 'FULLY_AI_GENERATED'
 WHEN {s} IN ('PARTIALLY_SYNTHETIC_OR_EDITED','AI-ENHANCED / COMPOSITE') OR {a} >= 40 THEN 'AI_ENHANCED_COMPOSITE' WHEN {s} = 'AUTHENTIC_EDITED' THEN 'AUTHENTIC_EDITED'
 WHEN {s} IN ('LIKELY_AUTHENTIC','LIKELY REAL') OR {r} >= 60 THEN 'AUTHENTIC_REAL_PHOTOGRAPH' ELSE 'UNDETERMINED' END"""


@query(
    "fused_status",
    f"""WITH q AS (SELECT media_id, modality, ai_pct, real_pct, {FUSED_STATUS.format(a='ai_pct', r='real_pct')} AS s FROM modality_results)
        SELECT media_id, modality, s AS final_status, {FUSED_TAX.format(s='s', a='ai_pct', r='real_pct')} AS taxonomy_state FROM q""",
    ("modality_results",),
)
def _(spark, sf):
    s = dec.final_status(C("ai_pct"), C("real_pct"))
    return view(spark, sf, "modality_results").select(
        "media_id", "modality", s.alias("final_status"), dec.taxonomy_from_fused(s, C("ai_pct"), C("real_pct")).alias("taxonomy_state")
    )


def decision_input(spark, sf):
    """One wide row per media from the modality results, with derived flags."""
    r = view(spark, sf, "modality_results")
    aggs = [
        F.max(F.when(C("modality") == m, C(src))).alias(f"{p}_{dst}")
        for m, p in (("image", "img"), ("video", "vid"), ("audio", "aud"))
        for src, dst in (("ai_pct", "ai"), ("real_pct", "real"), ("undecided_pct", "und"))
    ]
    return r.groupBy("media_id").agg(*aggs).withColumns(
        expr_cols(f"""readable: media_id % 97 <> 0
is_blank: media_id % 89 = 0
img_state: CASE WHEN img_ai IS NOT NULL THEN {' '.join(WIDE_STATE.split())} END
img_label: CASE WHEN media_id % 4 < 3 THEN CASE WHEN img_ai >= 55 THEN 'LIKELY AI-GENERATED' WHEN img_real >= 55 THEN 'LIKELY REAL' ELSE 'UNDECIDED' END END
face_flag: media_id % 11 = 0
face_worst_p: CASE WHEN media_id % 3 = 0 THEN CAST(0.05 AS DOUBLE) END
enhancer: media_id % 13 = 0
manifest_ai: media_id % 41 = 0
metadata_ai: media_id % 7 = 0""")
    )


DECIDE_SQL = f"""w AS (SELECT media_id, max(ai_pct) FILTER (modality='image') ia, max(real_pct) FILTER (modality='image') ir, max(undecided_pct) FILTER (modality='image') iu,
  max(ai_pct) FILTER (modality='video') va, max(real_pct) FILTER (modality='video') vr, max(undecided_pct) FILTER (modality='video') vu,
  max(ai_pct) FILTER (modality='audio') aa, max(real_pct) FILTER (modality='audio') ar, max(undecided_pct) FILTER (modality='audio') au FROM modality_results GROUP BY 1),
 x AS (SELECT *, CASE WHEN ia IS NOT NULL THEN {WIDE_STATE} END AS st,
   CASE WHEN media_id%4<3 THEN CASE WHEN ia >= 55 THEN 'LIKELY AI-GENERATED' WHEN ir >= 55 THEN 'LIKELY REAL' ELSE 'UNDECIDED' END END AS lb,
   coalesce(ia>0 OR ir>0, false) AS hi, va IS NOT NULL AS hv, coalesce(aa>0 OR ar>0, false) AS ha FROM w),
 y AS (SELECT *, CASE WHEN hi THEN greatest(0,least(1,1-iu/100))*ln(greatest(1e-4,least(1-1e-4,ia/100))/greatest(1e-4,least(1-1e-4,ir/100))) ELSE 0 END
   + CASE WHEN hv THEN 1.2*greatest(0,least(1,1-vu/100))*ln(greatest(1e-4,least(1-1e-4,va/100))/greatest(1e-4,least(1-1e-4,vr/100))) ELSE 0 END
   + CASE WHEN ha THEN greatest(0,least(1,1-au/100))*ln(greatest(1e-4,least(1-1e-4,aa/100))/greatest(1e-4,least(1-1e-4,ar/100))) ELSE 0 END
   + CASE WHEN media_id%41=0 THEN 2.0*ln(0.98/0.01) WHEN media_id%7=0 THEN 1.5*ln(0.95/0.05) ELSE 0 END AS pooled,
   st IS NOT NULL AND NOT hv AND NOT coalesce(aa+ar>0,false) AS al, media_id%41=0 OR media_id%7=0 AS de FROM x),
 o AS (SELECT *, exp(greatest(-6.0,least(6.0,pooled))) od FROM y), pr AS (SELECT *, od/(1+od)*100 a, (1-od/(1+od))*100 r FROM o),
 gp AS (SELECT *, greatest(3.0,(1-least(1.0,abs(a-r)/100))*20) u FROM pr), nn AS (SELECT *, round(a/(a+r)*(100-u),1) na, round(r/(a+r)*(100-u),1) nr FROM gp),
 z AS (SELECT *, CASE WHEN al THEN ia ELSE na END pa, CASE WHEN al THEN ir ELSE nr END pe, CASE WHEN al THEN coalesce(iu,0) ELSE round(100-(na+nr),1) END pu FROM nn),
 s0 AS (SELECT *, CASE WHEN al THEN coalesce(lb, {FUSED_STATUS.format(a='na', r='nr')}) ELSE {FUSED_STATUS.format(a='na', r='nr')} END s, CASE WHEN NOT al THEN NULL
   WHEN st IN ('AUTHENTIC_REAL_PHOTOGRAPH','AUTHENTIC_EDITED','AUTHENTIC_RECAPTURED_SCREEN') AND media_id%11=0 THEN 'face_looks_ai'
   WHEN st IN ('FULLY_AI_GENERATED','AI_ENHANCED_COMPOSITE') AND media_id%3=0 THEN 'face_disagrees'
   WHEN st IN ('AUTHENTIC_REAL_PHOTOGRAPH','AUTHENTIC_EDITED','AUTHENTIC_RECAPTURED_SCREEN') AND NOT (pe >= 55 AND pa < 35) THEN 'score_too_close' END ov FROM z),
 s1 AS (SELECT *, CASE WHEN ov IS NOT NULL THEN 'UNDETERMINED' ELSE s END s1c FROM s0),
 t1 AS (SELECT *, CASE WHEN ov IN ('face_looks_ai','face_disagrees') THEN 'UNDETERMINED' WHEN ov = 'score_too_close' THEN {FUSED_TAX.format(s="'UNDETERMINED'", a='pa', r='pe')}
   WHEN al THEN st ELSE {FUSED_TAX.format(s='s1c', a='pa', r='pe')} END tx, de AND s1c IN ('LIKELY_AUTHENTIC','LIKELY REAL') cf FROM s1),
 fin AS (SELECT *, CASE WHEN cf THEN 'UNDETERMINED' ELSE s1c END fs, CASE WHEN cf THEN {FUSED_TAX.format(s="'UNDETERMINED'", a='pa', r='pe')} ELSE tx END tt,
   CASE WHEN cf THEN 'declared_ai_conflict' ELSE ov END oo, CASE WHEN media_id%97=0 THEN 'INVALID_FILE' WHEN media_id%89=0 THEN 'BLANK_OR_DEGRADED'
   WHEN NOT (hi OR hv OR ha OR de) THEN 'UNDETERMINED' END tm FROM t1)"""


@query(
    "final_decision",
    f"""WITH {DECIDE_SQL} SELECT media_id, coalesce(tm, fs) AS final_status, CASE WHEN tm IS NULL THEN tt ELSE 'UNDETERMINED' END AS taxonomy_state,
        CASE WHEN tm IS NULL THEN pa ELSE 0.0 END AS p_ai, CASE WHEN tm IS NULL THEN pe ELSE 0.0 END AS p_real, CASE WHEN tm IS NULL THEN pu ELSE 100.0 END AS p_undecided,
        CASE WHEN tm IS NULL THEN fs IN ('LIKELY_SYNTHETIC','PARTIALLY_SYNTHETIC_OR_EDITED','LIKELY AI-GENERATED') ELSE false END AS ai_detected,
        CASE WHEN tm IS NULL THEN CASE WHEN al THEN 'image_authoritative' ELSE 'fused' END END AS decision_mode, CASE WHEN tm IS NULL THEN oo END AS override_reason,
        CASE WHEN tm IS NULL THEN tt IN ('AUTHENTIC_REAL_PHOTOGRAPH','AUTHENTIC_EDITED') AND media_id%13<>0 ELSE false END AS drops_generator FROM fin""",
    ("modality_results",),
)
def _(spark, sf):
    return evd.decide(decision_input(spark, sf))


@query(
    "provenance_verdict",
    """WITH q AS (SELECT *, media_id%5=0 AS c2, media_id%15=0 AS ad, media_id%2=0 AS sg, coalesce(software LIKE 'Midjourney%', false) AS sig FROM media_tags)
       SELECT media_id, CASE WHEN c2 AND ad THEN 'C2PA_DECLARED_SYNTHETIC' WHEN c2 AND sg THEN 'C2PA_SIGNATURE_MARKER_UNVERIFIED' WHEN c2 THEN 'C2PA_PRESENT_UNVERIFIED'
        WHEN sig THEN 'METADATA_DECLARED_SYNTHETIC' WHEN make IS NOT NULL AND model IS NOT NULL THEN 'HARDWARE_EXIF_PRESENT' ELSE 'PROVENANCE_UNKNOWN' END AS verdict,
        (CASE WHEN c2 AND ad THEN 0.98 WHEN c2 THEN 0.5 WHEN sig THEN 0.95 WHEN make IS NOT NULL AND model IS NOT NULL THEN 0.25 ELSE 0.5 END)::DOUBLE AS ai_confidence,
        CASE WHEN NOT c2 THEN 'NO_C2PA' WHEN ad THEN 'AI_DECLARED_CREDENTIALS' WHEN sg THEN 'SIGNATURE_MARKER_UNVERIFIED' ELSE 'UNVERIFIED_MANIFEST' END AS c2pa_status FROM q""",
    ("media_tags",),
)
def _(spark, sf):
    c = expr_cols("""c2pa_present: media_id % 5 = 0
ai_declaration: media_id % 15 = 0
is_signed: media_id % 2 = 0
ai_signature: coalesce(software LIKE 'Midjourney%', false)
camera_make: make
camera_model: model""")
    return view(spark, sf, "media_tags").select("media_id", dec.provenance_verdict(c).alias("p")).select("media_id", "p.*")


@query(
    "open_set_flag",
    """SELECT media_id, modality, media_id % 3 = 0 AND ai_pct >= 60 AS unknown_source, CASE WHEN ai_pct/100 BETWEEN 0.4 AND 0.6 THEN 'INCONCLUSIVE' WHEN ai_pct/100 > 0.6
       THEN 'LEANING_SYNTHETIC' ELSE 'LEANING_AUTHENTIC' END AS band FROM modality_results""",
    ("modality_results",),
)
def _(spark, sf):
    key = F.when(C("media_id") % 3 == 0, "unknown").otherwise("flux1")
    return view(spark, sf, "modality_results").select("media_id", "modality", dec.open_set_flag(key, C("ai_pct")).alias("o")).select("media_id", "modality", "o.*")


@query(
    "validate_media",
    """WITH q AS (SELECT media_id, CASE media_id%9 WHEN 0 THEN '.gif' ELSE '.jpg' END AS ext, p_ai_pct/9 AS mb, media_id%7*100+40 AS w, media_id%5*200+90 AS h, p_ai_pct*2 AS bl,
        p_ai_pct*2.5 AS mn, p_ai_pct/2 AS ct, latency_s AS cs FROM predictions),
       e AS (SELECT *, CASE WHEN ext = '.gif' THEN 'unsupported_extension' WHEN mb > 10 THEN 'too_large' WHEN w < 64 OR h < 64 THEN 'too_small' END AS er FROM q)
       SELECT media_id, er AS error, CASE WHEN er IS NULL THEN cs < 1 END AS is_blank, CASE WHEN er IS NULL THEN bl < 80 END AS is_blurry, CASE WHEN er IS NULL THEN mn < 35 END AS is_underexposed,
        CASE WHEN er IS NULL THEN mn > 225 END AS is_overexposed, CASE WHEN er IS NULL THEN round(greatest(0.1, least(1.0, 1.0 - CASE WHEN bl < 80 THEN 0.3 ELSE 0 END
        - CASE WHEN mn < 35 OR mn > 225 THEN 0.25 ELSE 0 END - CASE WHEN ct < 25 THEN 0.2 ELSE 0 END)), 2)::DOUBLE END AS quality_score FROM e""",
    ("predictions",),
)
def _(spark, sf):
    c = expr_cols("""ext: CASE media_id % 9 WHEN 0 THEN '.gif' ELSE '.jpg' END
size_mb: p_ai_pct / 9
w: media_id % 7 * 100 + 40
h: media_id % 5 * 200 + 90
blur: p_ai_pct * 2
mean: p_ai_pct * 2.5
contrast: p_ai_pct / 2
channel_std: latency_s""")
    return view(spark, sf, "predictions").select("media_id", dec.validate_media(c).alias("v")).select("media_id", "v.*")


@query(
    "batch_table",
    """WITH q AS (SELECT l_orderkey*8+l_linenumber AS pos, l_tax <> 0.08 AS ok, l_discount = 0.05 AS gate, l_quantity*2 AS p, l_returnflag AS rf FROM lineitem)
       SELECT pos, concat('file', pos::VARCHAR) AS file, CASE WHEN NOT ok THEN 'Could not process' WHEN gate THEN 'Blocked by a safety gate: not analysed'
        WHEN p >= 65 THEN 'Likely AI-generated' ELSE 'Inconclusive' END AS verdict, CASE WHEN ok AND NOT gate THEN round(p, 1) END AS ai_likelihood,
        CASE WHEN ok AND NOT gate THEN CASE WHEN p/100 BETWEEN 0.4 AND 0.6 THEN 'INCONCLUSIVE' WHEN p > 60 THEN 'LEANING_SYNTHETIC' ELSE 'LEANING_AUTHENTIC' END END AS band,
        CASE WHEN ok AND NOT gate THEN rf END AS origin_guess, CASE WHEN NOT ok THEN 'decoder failed' WHEN gate THEN 'see the file''s own page' END AS note FROM q""",
)
def _(spark, sf):
    p = view(spark, sf, "predictions").selectExpr("media_id", "failed", "p_ai_pct", "latency_s")
    from candorframe.tables import table

    q = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey*8+l_linenumber AS pos", "l_tax <> 0.08 AS success", "l_discount = 0.05 AS gate_blocked", "l_quantity*2 AS p_ai", "l_returnflag AS origin"
    )
    q = q.withColumns(
        {
            "filename": F.concat(F.lit("file"), C("pos").cast("string")),
            "error": F.lit("decoder failed"),
            "headline": lab.verdict_headline(F.lit(None).cast("string"), dec.final_status(C("p_ai"), F.lit(0.0)))["headline"],
            "band": lab.classify_band(C("p_ai") / 100),
        }
    )
    q = q.withColumn("headline", F.when(C("p_ai") >= 65, C("headline")).otherwise("Inconclusive"))
    return evd.batch_table(q)


@query(
    "moire_flag",
    """WITH q AS (SELECT media_id, p_ai_pct/12 AS pr, latency_s*2 AS av FROM predictions), f AS (SELECT *, pr >= 4.5 AND av >= 1.25 AS s, pr >= 6.5 AS v FROM q)
       SELECT media_id, s OR v AS is_screen_recapture, round(CASE WHEN s THEN least(0.95, 0.5+(pr-4.5)*0.1+(av-1.25)*0.2) WHEN v THEN least(0.92, 0.6+(pr-6.5)*0.05) ELSE 0 END, 2)::DOUBLE
        AS confidence, round(pr/4+av, 2) AS moire_score FROM f""",
    ("predictions",),
)
def _(spark, sf):
    m = sc.moire_flag(C("p_ai_pct") / 12, C("latency_s") * 2)
    return view(spark, sf, "predictions").select("media_id", m.alias("m")).select("media_id", "m.*")


@query(
    "feedback_quality",
    """WITH q AS (SELECT event_id, user_label, CASE WHEN event_id%20=0 THEN NULL WHEN event_id%23=0 THEN 1.7 ELSE noise/4 END AS p FROM feedback),
       s AS (SELECT *, CASE WHEN user_label='AI' THEN p ELSE 1-p END AS sc FROM q)
       SELECT event_id, CASE WHEN p BETWEEN 0 AND 1 THEN round(sc, 6) ELSE 1.0 END::DOUBLE AS quality_score, coalesce(p BETWEEN 0 AND 1 AND sc < 0.2 AND greatest(p, 1-p) >= 0.8, false) AS is_suspect FROM s""",
    ("feedback",),
)
def _(spark, sf):
    p = F.expr("CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 23 = 0 THEN CAST(1.7 AS DOUBLE) ELSE noise / 4 END")
    return view(spark, sf, "feedback").select("event_id", sc.feedback_quality(C("user_label"), p).alias("q")).select("event_id", F.round("q.quality_score", 6).alias("quality_score"), "q.is_suspect")


@query(
    "damped_step",
    "SELECT event_id, round(0.03/pow(1+event_id/10, 2), 9) AS step FROM feedback",
    ("feedback",),
)
def _(spark, sf):
    return view(spark, sf, "feedback").select("event_id", F.round(sc.damped(0.03, C("event_id")), 9).alias("step"))
