"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.functions.labels import bucket_of, classify_band, label_class, verdict_headline, verdict_of
from candorframe.functions.subjects import classify_minor
from candorframe.operators import evaluation as ev
from candorframe.tables import round6, view

BAND_SQL = """CASE WHEN {p} IS NULL THEN 'INCONCLUSIVE' WHEN {p} >= 0.995 THEN 'LEANING_SYNTHETIC' WHEN {p} <= 0.005 THEN 'LEANING_AUTHENTIC'
 WHEN {p} BETWEEN 0.4 AND 0.6 THEN 'INCONCLUSIVE' WHEN {p} > 0.6 THEN 'LEANING_SYNTHETIC' ELSE 'LEANING_AUTHENTIC' END"""
PAIRS_SQL = """SELECT CASE WHEN lower(truth) IN ('ai','synthetic') THEN 1 WHEN lower(truth) IN ('real','human') THEN 0 END AS y,
 least(100.0, greatest(0.0, p_ai_pct)) / 100 AS p FROM predictions"""
MINOR_SQL = """CASE WHEN {a} < 18 THEN 'LIKELY_MINOR' WHEN {a} < 27 THEN 'POSSIBLE_MINOR' WHEN {s} >= 0.5 THEN 'POSSIBLE_MINOR'
 WHEN {a} IS NOT NULL THEN 'ADULT' ELSE 'UNDETERMINED' END"""
STATE_SQL = """CASE media_id % 11 WHEN 0 THEN 'FULLY_AI_GENERATED' WHEN 1 THEN 'AI_ENHANCED_COMPOSITE' WHEN 2 THEN 'PROCEDURAL_CGI_SYNTHETIC'
 WHEN 3 THEN 'AI_GENERATED_SCREENSHOT' WHEN 4 THEN 'AI_ENHANCED_SCREENSHOT' WHEN 5 THEN 'AUTHENTIC_REAL_PHOTOGRAPH' WHEN 6 THEN 'AUTHENTIC_EDITED'
 WHEN 7 THEN 'AUTHENTIC_RECAPTURED_SCREEN' WHEN 8 THEN 'AUTHENTIC_SCREENSHOT' WHEN 9 THEN 'UNDETERMINED' END"""
STATUS_SQL = """CASE media_id % 9 WHEN 0 THEN 'LIKELY_SYNTHETIC' WHEN 1 THEN 'likely ai-generated' WHEN 2 THEN 'PARTIALLY_SYNTHETIC_OR_EDITED'
 WHEN 3 THEN 'LIKELY_AUTHENTIC' WHEN 4 THEN 'AUTHENTIC_EDITED' WHEN 5 THEN 'BLANK_OR_DEGRADED' WHEN 6 THEN 'UNDETERMINED' WHEN 7 THEN 'LIKELY REAL' END"""


@query(
    "classify_band",
    f"SELECT media_id, {BAND_SQL.format(p='(p_ai_pct/100)')} AS band FROM predictions",
    ("predictions",),
)
def _(spark, sf):
    return view(spark, sf, "predictions").select("media_id", classify_band(F.col("p_ai_pct") / 100).alias("band"))


@query(
    "label_class",
    "SELECT media_id, CASE lower(truth) WHEN 'ai' THEN 1 WHEN 'real' THEN 0 END AS label_class FROM predictions",
    ("predictions",),
)
def _(spark, sf):
    return view(spark, sf, "predictions").select("media_id", label_class(F.col("truth")).alias("label_class"))


@query(
    "calibration_metrics",
    f"""WITH q AS ({PAIRS_SQL}), a AS (SELECT count(*) pairs, count(y) n, count(*) FILTER (y = 1) n_ai, count(*) FILTER (y IS NULL) u,
        count(*) FILTER (y=1 AND p>=0.5) tp, count(*) FILTER (y=0 AND p>=0.5) fp, count(*) FILTER (y=1 AND p<0.5) fn,
        count(*) FILTER (y=0 AND p<0.5) tn, avg(CASE WHEN y IS NOT NULL THEN (p-y)*(p-y) END) br FROM q)
        SELECT n, n_ai, n - n_ai AS n_real, tp, fp, fn, tn, round((tp+tn)/n, 4) AS accuracy, round(tp/(tp+fp), 4) AS precision,
        round(tp/(tp+fn), 4) AS recall, round(2*tp/(2*tp+fp+fn), 4) AS f1, round(fp/(fp+tn), 4) AS false_positive_rate, round(br, 4) AS brier,
        (pairs-n)::VARCHAR || ' left out (' || u::VARCHAR || ' unlabelled)' AS warnings FROM a""",
    ("predictions",),
)
def _(spark, sf):
    return ev.calibration_metrics(view(spark, sf, "predictions"), "truth", "p_ai_pct")


@query(
    "reliability_table",
    f"""WITH q AS ({PAIRS_SQL}) SELECT least(9, floor(p*10)::BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted,
        round(avg(y), 6) AS observed_ai_rate FROM q WHERE y IS NOT NULL GROUP BY 1""",
    ("predictions",),
)
def _(spark, sf):
    t = ev.reliability_table(view(spark, sf, "predictions"), "truth", "p_ai_pct")
    return t.select("bin", "n", round6("mean_predicted"), round6("observed_ai_rate"))


@query(
    "expected_calibration_error",
    f"""WITH q AS ({PAIRS_SQL}), b AS (SELECT least(9, floor(p*10)::BIGINT) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM q
        WHERE y IS NOT NULL GROUP BY 1) SELECT round(sum(n*gap)/sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""",
    ("predictions",),
)
def _(spark, sf):
    return ev.expected_calibration_error(view(spark, sf, "predictions"), "truth", "p_ai_pct").select(round6("ece"), "n")


@query(
    "band_occupancy",
    f"""WITH q AS ({PAIRS_SQL}) SELECT CASE y WHEN 1 THEN 'ai' ELSE 'real' END AS truth_class, {BAND_SQL.format(p='p')} AS band, count(*) AS n
        FROM q WHERE y IS NOT NULL GROUP BY 1, 2""",
    ("predictions",),
)
def _(spark, sf):
    return ev.band_occupancy(view(spark, sf, "predictions"), "truth", "p_ai_pct")


@query(
    "verdict_and_bucket",
    f"""SELECT media_id, CASE WHEN st IN ('FULLY_AI_GENERATED','AI_ENHANCED_COMPOSITE','PROCEDURAL_CGI_SYNTHETIC','AI_GENERATED_SCREENSHOT',
        'AI_ENHANCED_SCREENSHOT') THEN 'AI' WHEN st LIKE 'AUTHENTIC%' THEN 'REAL' ELSE 'UNSURE' END AS verdict,
        CASE WHEN failed OR media_id % 13 = 0 THEN 'errors' WHEN upper(fs) IN ('LIKELY_SYNTHETIC','LIKELY AI-GENERATED') THEN 'ai_generated'
        WHEN fs = 'PARTIALLY_SYNTHETIC_OR_EDITED' THEN 'composite' WHEN fs IN ('LIKELY_AUTHENTIC','AUTHENTIC_EDITED','LIKELY REAL') THEN 'real'
        WHEN fs = 'BLANK_OR_DEGRADED' THEN 'no_content' ELSE 'undecided' END AS bucket
        FROM (SELECT *, {STATE_SQL} AS st, {STATUS_SQL} AS fs FROM predictions) q""",
    ("predictions",),
)
def _(spark, sf):
    q = view(spark, sf, "predictions").withColumns({"st": F.expr(STATE_SQL), "fs": F.expr(STATUS_SQL)})
    return q.select(
        "media_id", verdict_of(F.col("st")).alias("verdict"), bucket_of(F.col("fs"), F.col("failed"), F.col("media_id") % 13 != 0).alias("bucket")
    )


@query(
    "verdict_headline",
    f"""SELECT media_id, r[1] AS level, r[2] AS headline FROM (SELECT media_id, CASE WHEN fs = 'BLANK_OR_DEGRADED' THEN ['info','No usable content']
        WHEN st = 'AUTHENTIC_SCREENSHOT' THEN ['info','Authentic screenshot'] WHEN st = 'AI_ENHANCED_SCREENSHOT' THEN ['warning','Screenshot of AI-edited media']
        WHEN st = 'AI_GENERATED_SCREENSHOT' THEN ['error','Screenshot of AI-generated media']
        WHEN st = 'AUTHENTIC_EDITED' OR fs = 'AUTHENTIC_EDITED' THEN ['info','Real photo, conventionally edited']
        WHEN st = 'AI_ENHANCED_COMPOSITE' OR fs = 'PARTIALLY_SYNTHETIC_OR_EDITED' THEN ['warning','Partly AI-generated or AI-enhanced']
        WHEN st = 'FULLY_AI_GENERATED' OR fs = 'LIKELY_SYNTHETIC' THEN ['error','Likely AI-generated']
        WHEN st = 'AUTHENTIC_REAL_PHOTOGRAPH' OR fs IN ('LIKELY_AUTHENTIC','LIKELY REAL') THEN ['success','Likely a real capture']
        ELSE ['info','Inconclusive'] END AS r FROM (SELECT media_id, {STATE_SQL} AS st, {STATUS_SQL} AS fs FROM modality_results) q) z""",
    ("modality_results",),
)
def _(spark, sf):
    q = view(spark, sf, "modality_results")
    return q.select("media_id", verdict_headline(F.expr(STATE_SQL), F.expr(STATUS_SQL)).alias("r")).select("media_id", "r.level", "r.headline")


@query(
    "roc_auc",
    """WITH q AS (SELECT p_ai_pct AS s, (truth='AI')::INT AS t FROM predictions WHERE truth IN ('AI','real')),
       r AS (SELECT t, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2) AS rk FROM q),
       a AS (SELECT count(*) FILTER (t=1) p, count(*) FILTER (t=0) n, sum(CASE WHEN t=1 THEN rk END) rs FROM r)
       SELECT p AS n_pos, n AS n_neg, round((rs - p::DOUBLE*(p+1)/2)/(p::DOUBLE*n), 6) AS auc FROM a""",
    ("predictions",),
)
def _(spark, sf):
    q = view(spark, sf, "predictions").withColumn("t", label_class(F.col("truth")))
    return ev.roc_auc(q, "p_ai_pct", "t").select("n_pos", "n_neg", round6("auc"))


@query(
    "benchmark",
    """WITH q AS (SELECT *, (truth='AI')::INT AS t FROM predictions WHERE truth IN ('AI','real')), s AS (SELECT * FROM q WHERE NOT failed),
       r AS (SELECT t, (rank() OVER (ORDER BY p_ai_pct) + (count(*) OVER (PARTITION BY p_ai_pct) - 1) / 2) AS rk FROM s),
       u AS (SELECT (sum(CASE WHEN t=1 THEN rk END) - count(*) FILTER (t=1)::DOUBLE*(count(*) FILTER (t=1)+1)/2)
             / (count(*) FILTER (t=1)::DOUBLE * count(*) FILTER (t=0)) AS auc FROM r),
       a AS (SELECT count(*) files, count(*) FILTER (failed) failed, count(*) FILTER (NOT failed) scored,
        count(*) FILTER (NOT failed AND t=1 AND label='LIKELY AI-GENERATED') tp, count(*) FILTER (NOT failed AND t=0 AND label='LIKELY AI-GENERATED') fp,
        count(*) FILTER (NOT failed AND t=0 AND label='LIKELY REAL') tn, count(*) FILTER (NOT failed AND t=1 AND label='LIKELY REAL') fn,
        count(*) FILTER (NOT failed AND label='UNDECIDED') abstained, avg(CASE WHEN NOT failed THEN latency_s END) ml,
        quantile_cont(CASE WHEN NOT failed THEN latency_s END, 0.95) pl FROM q)
       SELECT files, scored, tp+fp+tn+fn AS decided, abstained, failed, tp, fp, tn, fn, round((tp+fp+tn+fn)/files,4) AS coverage,
        round((tp+tn)/(tp+fp+tn+fn),4) AS accuracy, round(tp/(tp+fp),4) AS precision, round(tp/(tp+fn),4) AS recall,
        round(2*tp/(2*tp+fp+fn),4) AS f1, round(auc,4) AS roc_auc, round(ml,3) AS mean_latency_s, round(pl,3) AS p95_latency_s FROM a, u""",
    ("predictions",),
)
def _(spark, sf):
    q = view(spark, sf, "predictions").withColumn("truth", label_class(F.col("truth"))).where("truth IS NOT NULL")
    return ev.benchmark(q)


@query(
    "verdict_summary",
    """WITH q AS (SELECT CASE truth WHEN 'AI' THEN 'ai' WHEN 'real' THEN 'real' ELSE 'unlabelled' END AS g, CASE WHEN failed THEN 'ERROR'
        WHEN label='LIKELY AI-GENERATED' THEN 'AI' WHEN label='LIKELY REAL' THEN 'REAL' ELSE 'UNSURE' END AS v FROM predictions),
       a AS (SELECT g, count(*) n, count(*) FILTER (v='AI') n_ai, count(*) FILTER (v='REAL') n_real, count(*) FILTER (v='UNSURE') unsure,
        count(*) FILTER (v='ERROR') errors, count(*) FILTER (v=upper(g)) c, count(*) FILTER (v IN ('AI','REAL') AND v<>upper(g)) w FROM q GROUP BY g)
       SELECT g AS truth_group, n, n_ai, n_real, unsure, errors, CASE WHEN g<>'unlabelled' THEN c END AS correct, CASE WHEN g<>'unlabelled' THEN w END AS wrong,
        CASE WHEN g<>'unlabelled' THEN round(c/n,4) END AS accuracy_all, CASE WHEN g<>'unlabelled' THEN round(c/(c+w),4) END AS accuracy_when_decided FROM a
       UNION ALL SELECT '(all)', sum(n)::BIGINT, sum(n_ai)::BIGINT, sum(n_real)::BIGINT, sum(unsure)::BIGINT, sum(errors)::BIGINT, NULL, NULL, NULL, NULL FROM a""",
    ("predictions",),
)
def _(spark, sf):
    q = view(spark, sf, "predictions").selectExpr(
        "CASE truth WHEN 'AI' THEN 'ai' WHEN 'real' THEN 'real' END AS truth_group",
        "CASE WHEN failed THEN 'ERROR' WHEN label='LIKELY AI-GENERATED' THEN 'AI' WHEN label='LIKELY REAL' THEN 'REAL' ELSE 'UNSURE' END AS verdict",
    )
    return ev.verdict_summary(q)


@query(
    "batch_summary",
    f"""WITH q AS (SELECT failed, latency_s, media_id % 13 = 0 AS bad, upper({STATUS_SQL}) AS fs FROM predictions),
        b AS (SELECT latency_s, CASE WHEN failed OR bad THEN 'errors' WHEN fs IN ('LIKELY_SYNTHETIC','LIKELY AI-GENERATED') THEN 'ai_generated'
        WHEN fs = 'PARTIALLY_SYNTHETIC_OR_EDITED' THEN 'composite' WHEN fs IN ('LIKELY_AUTHENTIC','AUTHENTIC_EDITED','LIKELY REAL') THEN 'real'
        WHEN fs = 'BLANK_OR_DEGRADED' THEN 'no_content' ELSE 'undecided' END AS k FROM q)
        SELECT count(*) AS total_processed, count(*) FILTER (k='ai_generated') AS ai_generated, count(*) FILTER (k='composite') AS composite,
        count(*) FILTER (k='real') AS "real", count(*) FILTER (k='undecided') AS undecided, count(*) FILTER (k='no_content') AS no_content,
        count(*) FILTER (k='errors') AS errors, count(*) FILTER (k IN ('ai_generated','composite')) AS flagged,
        round(avg(latency_s), 3) AS mean_latency_s FROM b""",
    ("predictions",),
)
def _(spark, sf):
    q = view(spark, sf, "predictions").select(
        F.expr(STATUS_SQL).alias("final_status"), F.col("failed").alias("has_error"), (F.col("media_id") % 13 != 0).alias("content_valid"), "latency_s"
    )
    return ev.batch_summary(q)


AGE_BAND_SQL = """CASE WHEN true_age <= 4 THEN '0-4' WHEN true_age <= 9 THEN '5-9' WHEN true_age <= 12 THEN '10-12' WHEN true_age <= 15 THEN '13-15'
 WHEN true_age <= 17 THEN '16-17' WHEN true_age <= 20 THEN '18-20' WHEN true_age <= 25 THEN '21-25' WHEN true_age <= 35 THEN '26-35'
 WHEN true_age <= 60 THEN '36-60' ELSE '61-200' END"""


def _assessed(spark, sf):
    rows = view(spark, sf, "age_rows")
    return rows.withColumn("assessment", classify_minor(F.col("est_age"), F.col("child_share"), F.col("est_age").isNotNull()))


@query(
    "age_error_by_band",
    f"""WITH q AS (SELECT {AGE_BAND_SQL} AS band, est_age - true_age AS err, {MINOR_SQL.format(a='est_age', s='child_share')} AS asm FROM age_rows)
        SELECT band, count(*) AS n, round(avg(err), 6) AS mean_signed_error, round(quantile_cont(abs(err), 0.5), 6) AS median_abs_error,
        round(100 * count(*) FILTER (asm IN ('LIKELY_MINOR','POSSIBLE_MINOR')) / count(*), 6) AS flagged_pct FROM q GROUP BY 1""",
    ("age_rows",),
)
def _(spark, sf):
    t = ev.age_error_by_band(_assessed(spark, sf))
    return t.select("band", "n", round6("mean_signed_error"), round6("median_abs_error"), round6("flagged_pct"))


@query(
    "minor_recall",
    f"""WITH q AS (SELECT {MINOR_SQL.format(a='est_age', s='child_share')} AS asm FROM age_rows WHERE true_age < 18)
        SELECT count(*) AS minors, count(*) FILTER (asm LIKE '%MINOR') AS caught, round(100 * count(*) FILTER (asm LIKE '%MINOR') / count(*), 6) AS pct FROM q""",
    ("age_rows",),
)
def _(spark, sf):
    return ev.minor_recall(_assessed(spark, sf)).select("minors", "caught", round6("pct"))


@query(
    "age_recall_by_face_size",
    f"""WITH q AS (SELECT true_age, face_w, est_age IS NOT NULL AS found, est_age IS NOT NULL AND {MINOR_SQL.format(a='est_age', s='child_share')} <> 'ADULT' AS flagged
        FROM age_rows) SELECT CASE WHEN true_age >= 18 THEN 'adults found' WHEN face_w < 24 THEN '0-24' WHEN face_w < 40 THEN '24-40' WHEN face_w < 80 THEN '40-80'
        ELSE '80-up' END AS face_size, count(*) AS n, round(100*count(*) FILTER (found)/count(*), 6) AS found_pct,
        round(100*count(*) FILTER (flagged)/count(*), 6) AS review_pct, count(*) FILTER (NOT found) AS not_found,
        count(*) FILTER (found) - count(*) FILTER (flagged) AS found_not_flagged FROM q WHERE true_age < 18 OR found GROUP BY 1""",
    ("age_rows",),
)
def _(spark, sf):
    q = _assessed(spark, sf).withColumn("found", F.col("est_age").isNotNull())
    q = q.withColumn("flagged", F.col("found") & (F.col("assessment") != "ADULT"))
    t = ev.age_recall_by_face_size(q)
    return t.select("face_size", "n", round6("found_pct"), round6("review_pct"), "not_found", "found_not_flagged")


GROUP_SQL = "CASE WHEN true_age <= 2 THEN 0 WHEN true_age <= 9 THEN 1 WHEN true_age >= 70 THEN 8 ELSE CAST(floor(true_age / 10) AS BIGINT) + 1 END"


@query(
    "review_rate_by_group",
    f"""WITH q AS (SELECT {GROUP_SQL} AS group_id, est_age, {MINOR_SQL.format(a='est_age', s='child_share')} AS asm FROM age_rows)
        SELECT q.group_id::BIGINT AS group_id, ['0-2','3-9','10-19','20-29','30-39','40-49','50-59','60-69','more than 70'][q.group_id+1] AS age_group, count(*) AS n,
        round(quantile_cont(est_age, 0.5), 6) AS median_est, round(100*count(*) FILTER (asm <> 'ADULT')/count(*), 6) AS review_pct FROM q GROUP BY q.group_id""",
    ("age_rows",),
)
def _(spark, sf):
    t = ev.review_rate_by_group(_assessed(spark, sf).withColumn("group_id", F.expr(GROUP_SQL).cast("bigint")))
    return t.select("group_id", "age_group", "n", round6("median_est"), round6("review_pct"))


@query(
    "classifier_accuracy",
    """WITH q AS (SELECT (truth='AI')::INT AS y, p_ai_pct/100 AS p FROM predictions WHERE truth IN ('AI','real'))
       SELECT count(*) AS n, round(avg((CASE WHEN (p>=0.5) = (y=1) THEN 1.0 ELSE 0.0 END)::DOUBLE), 6) AS accuracy,
       round(avg(CASE WHEN y=1 THEN (p>=0.5)::INT END), 6) AS ai_recall, round(avg(CASE WHEN y=0 THEN (p<0.5)::INT END), 6) AS real_specificity,
       round(count(*) FILTER (y=0)/count(*) FILTER (y=1), 6) AS ai_weight FROM q""",
    ("predictions",),
)
def _(spark, sf):
    q = view(spark, sf, "predictions").select(label_class(F.col("truth")).alias("y"), (F.col("p_ai_pct") / 100).alias("p")).where("y IS NOT NULL")
    t = ev.classifier_accuracy(q)
    return t.select("n", *[round6(c) for c in ("accuracy", "ai_recall", "real_specificity", "ai_weight")])


@query(
    "drift_report",
    """WITH r AS (SELECT size_bytes v FROM media_files WHERE label = 'real'), c AS (SELECT size_bytes v FROM media_files WHERE label = 'ai_generated'),
       n AS (SELECT (SELECT count(*) FROM r) nr, (SELECT count(*) FROM c) nc),
       d AS (SELECT v, sum(r) r, sum(c) c FROM (SELECT v, 1 r, 0 c FROM r UNION ALL SELECT v, 0, 1 FROM c) GROUP BY v),
       s AS (SELECT max(abs(cr/nr - cc/nc)) st FROM (SELECT sum(r) OVER (ORDER BY v) cr, sum(c) OVER (ORDER BY v) cc FROM d), n)
       SELECT nr AS n_reference, nc AS n_current, round(st, 6) AS statistic, (st > sqrt(-0.5*ln(0.025))*sqrt((nr+nc)/(nr::DOUBLE*nc)))::INT AS drifted_features,
       (st > sqrt(-0.5*ln(0.025))*sqrt((nr+nc)/(nr::DOUBLE*nc)))::INT::DOUBLE AS drift_share, st > sqrt(-0.5*ln(0.025))*sqrt((nr+nc)/(nr::DOUBLE*nc)) AS drift_detected,
       'complete' AS message FROM s, n""",
    ("media_files",),
)
def _(spark, sf):
    q = view(spark, sf, "media_files").select("label", "size_bytes")
    t = ev.drift_report(q.where("label = 'real'"), q.where("label = 'ai_generated'"), "size_bytes")
    return t.withColumn("statistic", F.round("statistic", 6))


@query(
    "stratified_sample",
    f"""WITH q AS (SELECT {AGE_BAND_SQL} AS band, CASE WHEN true_age < 18 THEN 40 ELSE 15 END AS quota FROM age_rows)
        SELECT band, least(count(*), max(quota)) AS sampled FROM q GROUP BY 1""",
    ("age_rows",),
)
def _(spark, sf):
    q = view(spark, sf, "age_rows").withColumn("row_id", F.col("image_id") * 8 + F.col("subject")).withColumn("band", ev.age_band(F.col("true_age")))
    picked = ev.stratified_sample(q, "band", F.when(F.col("true_age") < 18, 40).otherwise(15), "row_id", seed=4)
    return picked.groupBy("band").agg(F.count(F.lit(1)).alias("sampled"))
