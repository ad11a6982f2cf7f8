"""Whole-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.evaluation import BAND_SQL, PAIRS_SQL
from candorframe.catalog.evidence import FUSED_STATUS, FUSED_TAX, WIDE_STATE, expr_cols
from candorframe.catalog.registry import query
from candorframe.plans.trust import trust_report
from candorframe.plans.verdicts import media_verdicts
from candorframe.tables import round6, table, view

C = F.col


@query(
    "trust_report",
    f"""WITH q AS ({PAIRS_SQL}), b AS (SELECT least(9, floor(p*10)::BIGINT) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM q WHERE y IS NOT NULL GROUP BY 1), e AS (SELECT sum(n*gap)/sum(n) AS ece FROM b),
       r AS (SELECT y, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2) AS rk FROM q WHERE y IS NOT NULL),
       u AS (SELECT (sum(CASE WHEN y=1 THEN rk END) - count(*) FILTER (y=1)::DOUBLE*(count(*) FILTER (y=1)+1)/2)/(count(*) FILTER (y=1)::DOUBLE*count(*) FILTER (y=0)) AS auc FROM r),
       a AS (SELECT count(y) n, round(count(*) FILTER ((y=1) = (p>=0.5))/count(y), 4) AS accuracy, round(avg(CASE WHEN y IS NOT NULL THEN (p-y)*(p-y) END), 4) AS brier FROM q)
       SELECT n, accuracy, brier, round(ece, 6) AS ece, round(auc, 6) AS auc FROM a, e, u""",
    ("predictions",),
)
def _(spark, sf):
    t = trust_report(view(spark, sf, "predictions"), "truth", "p_ai_pct")
    return t.select("n", "accuracy", "brier", round6("ece"), round6("auc"))


FACTS = f"""readable: media_id % 97 <> 0
is_blank: media_id % 89 = 0
img_state: {' '.join(WIDE_STATE.split())}
img_label: CAST(NULL AS STRING)
face_flag: media_id % 11 = 0
face_worst_p: CASE WHEN media_id % 3 = 0 THEN CAST(0.05 AS DOUBLE) END
enhancer: media_id % 13 = 0
manifest_ai: media_id % 41 = 0
metadata_ai: media_id % 7 = 0"""

ENT = "(-q*log2(q) - (1-q)*log2(1-q))"


@query(
    "media_verdicts",
    f"""WITH bl AS (SELECT DISTINCT sha256(c_name) AS sha FROM customer WHERE c_custkey % 10 = 3), o AS (SELECT o_orderkey AS media_id, sha256(c_name) AS sha, o_orderkey % 53 = 0 AS rec FROM orders JOIN customer ON c_custkey = o_custkey),
       g AS (SELECT media_id, CASE WHEN sha IN (SELECT sha FROM bl) THEN 'HARD_BLOCK_ESCALATE' WHEN rec THEN 'RECOGNIZED_OUT_OF_SCOPE' END AS gs FROM o),
       t0 AS (SELECT media_id, check_id, sum(greatest(-llr_cap, least(llr_cap, llr))) AS term FROM findings WHERE evidence_class IN ('PHYSICAL_SIGNAL','LEARNED_SIGNAL','METADATA_WEAK') AND llr <> 0 GROUP BY 1, 2),
       t1 AS (SELECT media_id, CASE WHEN abs(sum(term)) > 0.40 THEN sum(term)*(0.40/abs(sum(term))) ELSE sum(term) END AS tot FROM t0 GROUP BY 1),
       p0 AS (SELECT media_id, modality, ai_pct/100 AS p, greatest(-1, least(1, coalesce(tot, 0))) AS tot FROM modality_results LEFT JOIN t1 USING (media_id) WHERE media_id IN (SELECT media_id FROM g WHERE gs IS NULL)),
       p1 AS (SELECT media_id, modality, CASE WHEN abs(tot) < 1e-12 THEN p ELSE greatest(0.01, least(0.99, 1/(1+pow(10.0, -(log10(greatest(0.01, least(0.99, p))/(1-greatest(0.01, least(0.99, p))))+tot))))) END AS p FROM p0),
       p2 AS (SELECT *, greatest(1e-6, least(1-1e-6, p)) AS q FROM p1),
       p3 AS (SELECT media_id, modality, p, CASE modality WHEN 'image' THEN greatest(3.0, least(24.0, 20*{ENT})) WHEN 'audio' THEN greatest(3.0, least(22.0, 18*{ENT})) ELSE greatest(4.0, least(25.0, 20*{ENT})) END AS mg FROM p2),
       p4 AS (SELECT media_id, modality, round(p*100*(100/(100+mg)), 1) AS ai_pct, round((1-p)*100*(100/(100+mg)), 1) AS real_pct FROM p3),
       m AS (SELECT media_id, modality, ai_pct, real_pct, round(greatest(0, 100-(ai_pct+real_pct)), 1) AS undecided_pct FROM p4),
       w AS (SELECT media_id, max(ai_pct) FILTER (modality='image') ia, max(real_pct) FILTER (modality='image') ir, max(undecided_pct) FILTER (modality='image') iu, max(ai_pct) FILTER (modality='video') va, max(real_pct) FILTER (modality='video') vr,
        max(undecided_pct) FILTER (modality='video') vu, max(ai_pct) FILTER (modality='audio') aa, max(real_pct) FILTER (modality='audio') ar, max(undecided_pct) FILTER (modality='audio') au FROM m GROUP BY 1),
       x AS (SELECT g.media_id, ia, ir, iu, va, vr, vu, aa, ar, au, CASE WHEN ia IS NOT NULL THEN {WIDE_STATE.replace('media_id', 'g.media_id')} END AS st, coalesce(ia>0 OR ir>0, false) AS hi, va IS NOT NULL AS hv, coalesce(aa>0 OR ar>0, false) AS ha FROM g LEFT JOIN w USING (media_id) WHERE gs IS NULL),
       y AS (SELECT *, CASE WHEN hi THEN greatest(0,least(1,1-iu/100))*ln(greatest(1e-4,least(1-1e-4,ia/100))/greatest(1e-4,least(1-1e-4,ir/100))) ELSE 0 END
        + CASE WHEN hv THEN 1.2*greatest(0,least(1,1-vu/100))*ln(greatest(1e-4,least(1-1e-4,va/100))/greatest(1e-4,least(1-1e-4,vr/100))) ELSE 0 END
        + CASE WHEN ha THEN greatest(0,least(1,1-au/100))*ln(greatest(1e-4,least(1-1e-4,aa/100))/greatest(1e-4,least(1-1e-4,ar/100))) ELSE 0 END
        + CASE WHEN media_id%41=0 THEN 2.0*ln(0.98/0.01) WHEN media_id%7=0 THEN 1.5*ln(0.95/0.05) ELSE 0 END AS pooled, st IS NOT NULL AND NOT hv AND NOT coalesce(aa+ar>0,false) AS al, media_id%41=0 OR media_id%7=0 AS de FROM x),
       od AS (SELECT *, exp(greatest(-6.0,least(6.0,pooled))) od FROM y), pr AS (SELECT *, od/(1+od)*100 a, (1-od/(1+od))*100 r FROM od), gp AS (SELECT *, greatest(3.0,(1-least(1.0,abs(a-r)/100))*20) u FROM pr),
       nn AS (SELECT *, round(a/(a+r)*(100-u),1) na, round(r/(a+r)*(100-u),1) nr FROM gp),
       z AS (SELECT *, CASE WHEN al THEN ia ELSE na END pa, CASE WHEN al THEN ir ELSE nr END pe, CASE WHEN al THEN coalesce(iu,0) ELSE round(100-(na+nr),1) END pu FROM nn),
       s0 AS (SELECT *, {FUSED_STATUS.format(a='na', r='nr')} s, CASE WHEN NOT al THEN NULL WHEN st IN ('AUTHENTIC_REAL_PHOTOGRAPH','AUTHENTIC_EDITED','AUTHENTIC_RECAPTURED_SCREEN') AND media_id%11=0 THEN 'a'
        WHEN st IN ('FULLY_AI_GENERATED','AI_ENHANCED_COMPOSITE') AND media_id%3=0 THEN 'a' WHEN st IN ('AUTHENTIC_REAL_PHOTOGRAPH','AUTHENTIC_EDITED','AUTHENTIC_RECAPTURED_SCREEN') AND NOT (pe >= 55 AND pa < 35) THEN 'b' END ov FROM z),
       s1 AS (SELECT *, CASE WHEN ov IS NOT NULL THEN 'UNDETERMINED' ELSE s END sc FROM s0),
       t AS (SELECT *, CASE WHEN ov = 'a' THEN 'UNDETERMINED' WHEN ov = 'b' THEN {FUSED_TAX.format(s="'UNDETERMINED'", a='pa', r='pe')} WHEN al THEN st ELSE {FUSED_TAX.format(s='sc', a='pa', r='pe')} END tx, de AND sc = 'LIKELY_AUTHENTIC' cf FROM s1),
       f AS (SELECT *, CASE WHEN cf THEN 'UNDETERMINED' ELSE sc END fs, CASE WHEN cf THEN {FUSED_TAX.format(s="'UNDETERMINED'", a='pa', r='pe')} ELSE tx END tt, CASE WHEN media_id%97=0 THEN 'INVALID_FILE' WHEN media_id%89=0 THEN 'BLANK_OR_DEGRADED'
        WHEN NOT (hi OR hv OR ha OR de) THEN 'UNDETERMINED' END tm FROM t),
       d AS (SELECT media_id, coalesce(tm, fs) AS final_status, CASE WHEN tm IS NULL THEN tt ELSE 'UNDETERMINED' END AS taxonomy_state, CASE WHEN tm IS NULL THEN pa ELSE 0.0 END AS p_ai, CASE WHEN tm IS NULL THEN pe ELSE 0.0 END AS p_real,
        CASE WHEN tm IS NULL THEN pu ELSE 100.0 END AS p_undecided, tm IS NULL AND fs IN ('LIKELY_SYNTHETIC','PARTIALLY_SYNTHETIC_OR_EDITED') AS ai_detected FROM f),
       al2 AS (SELECT *, {BAND_SQL.format(p='(p_ai/100)')} AS band FROM d UNION ALL SELECT media_id, gs, 'UNDETERMINED', 0.0, 0.0, 100.0, false, NULL FROM g WHERE gs IS NOT NULL)
       SELECT *, CASE WHEN final_status = 'BLANK_OR_DEGRADED' THEN 'No usable content' WHEN taxonomy_state = 'AI_GENERATED_SCREENSHOT' THEN 'Screenshot of AI-generated media' WHEN taxonomy_state = 'AUTHENTIC_EDITED' THEN 'Real photo, conventionally edited'
        WHEN taxonomy_state = 'AI_ENHANCED_COMPOSITE' OR final_status = 'PARTIALLY_SYNTHETIC_OR_EDITED' THEN 'Partly AI-generated or AI-enhanced' WHEN taxonomy_state = 'FULLY_AI_GENERATED' OR final_status = 'LIKELY_SYNTHETIC' THEN 'Likely AI-generated'
        WHEN taxonomy_state = 'AUTHENTIC_REAL_PHOTOGRAPH' OR final_status = 'LIKELY_AUTHENTIC' THEN 'Likely a real capture' ELSE 'Inconclusive' END AS headline FROM al2""",
    ("modality_results", "findings"),
)
def _(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha256"))
    orders = table(spark, sf, "orders").select(C("o_orderkey").alias("media_id"), C("o_custkey").alias("c_custkey"))
    files = orders.join(customers, "c_custkey").select("media_id", "sha256", F.when(C("media_id") % 53 == 0, "FITS").alias("recognised"))
    listed = customers.where("c_custkey % 10 = 3").select("sha256").distinct()
    scores = view(spark, sf, "modality_results").select("media_id", "modality", (C("ai_pct") / 100).alias("p_ai"))
    facts = orders.select("media_id", *[c.alias(n) for n, c in expr_cols(FACTS).items()])
    return media_verdicts(files, listed, scores, view(spark, sf, "findings"), facts)
