"""How far the scores can be trusted: AUC, confusion, calibration, drift, group summaries.

Every metric is one aggregation (partial on the map side), or class counts per distinct score followed by a prefix scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.functions.labels import BUCKETS, bucket_of, classify_band, label_class
from candorframe.operators.ordering import exact_quantiles, prefix_scan

# Age bands, face-width bins and age-group order of the evaluation reports.
AGE_BANDS = [(0, 4), (5, 9), (10, 12), (13, 15), (16, 17), (18, 20), (21, 25), (26, 35), (36, 60), (61, 200)]
FACE_BINS = [(0, 24), (24, 40), (40, 80), (80, 10000)]
AGE_GROUPS = ["0-2", "3-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "more than 70"]
MIN_RELIABLE_SAMPLES = 30
MIN_DRIFT_SAMPLES = 10


def ratio(num: Column, den: Column) -> Column:
    """num / den to four decimals, NULL on a zero denominator."""
    return F.round(num / F.nullif(den, F.lit(0)), 4)


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Mann-Whitney AUC with ties counting half: one row (n_pos, n_neg, auc), auc NULL when a class is missing."""
    counts = df.where(F.col(score).isNotNull() & F.col(truth).isin(0, 1)).groupBy(F.col(score).alias("_v")).agg(
        F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) == 0).alias("_q")
    )
    ranked = prefix_scan(counts, [], ["_v"], sums={"_below": F.col("_q")})
    won = F.col("_p") * (F.col("_below").cast("double") + F.col("_q") / 2)
    total = ranked.agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum(won).alias("_won"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select(
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), (F.col("_won") / F.nullif(pairs, F.lit(0.0))).alias("auc")
    )


def benchmark(df: DataFrame) -> DataFrame:
    """Decided confusion counts, coverage and latency of labelled predictions (truth 0/1, label, p_ai_pct, latency_s, failed)."""
    scored = df.where(~F.col("failed"))
    ai, real = F.col("label") == "LIKELY AI-GENERATED", F.col("label") == "LIKELY REAL"
    pos, neg = F.col("truth") == 1, F.col("truth") == 0
    ok = ~F.col("failed")
    base = df.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(ok).alias("scored"),
        F.count_if(ok & ai & pos).alias("tp"),
        F.count_if(ok & ai & neg).alias("fp"),
        F.count_if(ok & real & neg).alias("tn"),
        F.count_if(ok & real & pos).alias("fn"),
        F.count_if(ok & ~ai & ~real).alias("abstained"),
        F.count_if(~ok).alias("failed"),
        F.round(F.avg(F.when(ok, F.col("latency_s"))), 3).alias("mean_latency_s"),
    )
    ranked = _ranked_values(scored).select(F.round("p95", 3).alias("p95_latency_s"), F.round("auc", 4).alias("roc_auc"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    decided = tp + fp + tn + fn
    one = F.lit(1).alias("_one")
    joined = base.withColumn("_one", one).join(ranked.withColumn("_one", one), "_one", "left")
    return joined.select(
        "files", "scored", decided.alias("decided"), "abstained", "failed", "tp", "fp", "tn", "fn",
        ratio(decided, F.col("files")).alias("coverage"),
        ratio(tp + tn, decided).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "roc_auc", "mean_latency_s", "p95_latency_s",
    )


def _ranked_values(scored: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row (auc, p95): scores and latencies are counted by value in one pass and ranked in one sort, as two kinds of values."""
    pos, neg = F.col("truth") == 1, F.col("truth") == 0
    kinds = F.array(
        F.struct(F.lit("score").alias("kind"), F.when(pos | neg, F.col("p_ai_pct").cast("double")).alias("v"), pos.cast("bigint").alias("p"), neg.cast("bigint").alias("q")),
        F.struct(F.lit("late").alias("kind"), F.nanvl(F.col("latency_s").cast("double"), F.lit(None)).alias("v"), F.lit(1).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q")),
    )
    counts = scored.select(F.explode(kinds).alias("k")).select("k.*").where("v IS NOT NULL").groupBy("kind", "v").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    below = prefix_scan(counts, ["kind"], ["v"], sums={"p_below": F.col("p"), "q_below": F.col("q")}, totals=True)
    score, late = F.col("kind") == "score", F.col("kind") == "late"
    rank = F.lit(quantile) * (F.col("total_p_below") - 1)
    low, end = F.floor(rank), F.col("p_below") + F.col("p")
    high = F.least(low + 1, F.col("total_p_below") - 1)
    holds = lambda at: late & (F.col("p_below") <= at) & (at < end)
    got = below.agg(
        F.sum(F.when(score, F.col("p"))).alias("n_pos"), F.sum(F.when(score, F.col("q"))).alias("n_neg"),
        F.sum(F.when(score, F.col("p") * (F.col("q_below").cast("double") + F.col("q") / 2))).alias("won"),
        F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"), F.max(F.when(late, rank - low)).alias("share"),
    )
    auc = F.col("won") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return got.select(auc.alias("auc"), (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("p95"))


def _pairs(df: DataFrame, label: str, pct: str) -> DataFrame:
    p = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(pct))) / 100
    return df.select(
        label_class(F.col(label)).alias("y"),
        F.when(F.col(pct).isNotNull() & ~F.isnan(pct), p).alias("p"),
    )


def calibration_metrics(df: DataFrame, label: str, pct: str, threshold: float = 50.0) -> DataFrame:
    """Confusion at the threshold, rates, Brier score and the warnings, in one pass."""
    y, p, t = F.col("y"), F.col("p"), threshold / 100.0
    use = y.isNotNull() & p.isNotNull()
    agg = _pairs(df, label, pct).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(use).alias("n"),
        F.count_if(use & (y == 1)).alias("n_ai"),
        F.count_if(y.isNull()).alias("unlabelled"),
        F.count_if(use & (y == 1) & (p >= t)).alias("tp"),
        F.count_if(use & (y == 0) & (p >= t)).alias("fp"),
        F.count_if(use & (y == 1) & (p < t)).alias("fn"),
        F.count_if(use & (y == 0) & (p < t)).alias("tn"),
        F.avg(F.when(use, (p - y) * (p - y))).alias("_brier"),
    )
    n, tp, fp, tn, fn = (F.col(c) for c in ("n", "tp", "fp", "tn", "fn"))
    warn = F.array_compact(
        F.array(
            F.when(F.col("pairs") > n, F.concat((F.col("pairs") - n).cast("string"), F.lit(" left out ("), F.col("unlabelled").cast("string"), F.lit(" unlabelled)"))),
            F.when(n == 0, F.lit("nothing can be measured")).when(n < MIN_RELIABLE_SAMPLES, F.lit("too few samples")),
            F.when((n > 0) & F.col("n_ai").isin(F.lit(0), n), F.lit("only one class present")),
        )
    )
    return agg.select(
        "n", "n_ai", (n - F.col("n_ai")).alias("n_real"), "tp", "fp", "fn", "tn",
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
        F.round("_brier", 4).alias("brier"),
        F.array_join(warn, "; ").alias("warnings"),
    )


def reliability_table(df: DataFrame, label: str, pct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the predicted probability, the last closed at 1.0, empty ones left out."""
    binned = _pairs(df, label, pct).where("y IS NOT NULL AND p IS NOT NULL")
    return binned.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_ai_rate")
    )


def expected_calibration_error(df: DataFrame, label: str, pct: str, bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("observed_ai_rate"))
    return reliability_table(df, label, pct, bins).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def band_occupancy(df: DataFrame, label: str, pct: str) -> DataFrame:
    """Count per (truth class, band)."""
    pairs = _pairs(df, label, pct).where("y IS NOT NULL AND p IS NOT NULL")
    return pairs.groupBy(F.when(F.col("y") == 1, "ai").otherwise("real").alias("truth_class"), classify_band(F.col("p")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


def verdict_summary(df: DataFrame) -> DataFrame:
    """Per truth group and overall (group NULL): n, verdict counts, correct, wrong, unsure, accuracy over all and when decided.

    Input: truth_group ('ai', 'real' or anything else, NULL = unlabelled), verdict (AI / REAL / UNSURE / ERROR).
    """
    rows = df.select(F.coalesce("truth_group", F.lit("unlabelled")).alias("truth_group"), "verdict")
    want = F.upper("truth_group")
    judged = F.col("truth_group").isin("ai", "real")
    decided = F.col("verdict").isin("AI", "REAL")
    agg = rows.rollup("truth_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "AI").alias("n_ai"),
        F.count_if(F.col("verdict") == "REAL").alias("n_real"),
        F.count_if(F.col("verdict") == "UNSURE").alias("unsure"),
        F.count_if(F.col("verdict") == "ERROR").alias("errors"),
        F.count_if(judged & (F.col("verdict") == want)).alias("_right"),
        F.count_if(judged & decided & (F.col("verdict") != want)).alias("_wrong"),
    )
    shown = F.col("truth_group").isin("ai", "real")
    return agg.select(
        F.coalesce("truth_group", F.lit("(all)")).alias("truth_group"), "n", "n_ai", "n_real", "unsure", "errors",
        F.when(shown, F.col("_right")).alias("correct"),
        F.when(shown, F.col("_wrong")).alias("wrong"),
        F.when(shown, ratio(F.col("_right"), F.col("n"))).alias("accuracy_all"),
        F.when(shown, ratio(F.col("_right"), F.col("_right") + F.col("_wrong"))).alias("accuracy_when_decided"),
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """Counts of the six buckets (zeros kept), total, mean latency, flagged and failed. Input: final_status, has_error, content_valid,
    latency_s."""
    b = bucket_of(F.col("final_status"), F.col("has_error"), F.col("content_valid"))
    rows = df.select(b.alias("bucket"), "latency_s")
    return rows.agg(
        F.count(F.lit(1)).alias("total_processed"),
        *[F.count_if(F.col("bucket") == name).alias(name) for name in BUCKETS],
        F.count_if(F.col("bucket").isin("ai_generated", "composite")).alias("flagged"),
        F.round(F.avg("latency_s"), 3).alias("mean_latency_s"),
    )


def age_band(age: Column) -> Column:
    out = F
    for lo, hi in AGE_BANDS:
        out = out.when(age.between(lo, hi), f"{lo}-{hi}")
    return out


def age_error_by_band(df: DataFrame) -> DataFrame:
    """Per age band: n, median |error|, mean signed error, share flagged. Input: true_age, est_age, assessment."""
    rows = df.select(
        age_band(F.col("true_age")).alias("band"),
        (F.col("est_age") - F.col("true_age")).alias("err"),
        F.col("assessment").isin("LIKELY_MINOR", "POSSIBLE_MINOR").alias("flag"),
    ).withColumn("abs_err", F.abs("err"))
    base = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean_signed_error"), (100 * F.count_if("flag") / F.count(F.lit(1))).alias("flagged_pct")
    )
    mid = exact_quantiles(rows, ["band"], "abs_err", {"median_abs_error": 0.5}).drop("n_measured")
    return base.join(mid, "band", "left")


def minor_recall(df: DataFrame) -> DataFrame:
    """Under-18s sent to review: (minors, caught, pct)."""
    minors = df.where(F.col("true_age") < 18)
    return minors.agg(
        F.count(F.lit(1)).alias("minors"), F.count_if(F.col("assessment").isin("LIKELY_MINOR", "POSSIBLE_MINOR")).alias("caught")
    ).withColumn("pct", 100 * F.col("caught") / F.nullif(F.col("minors"), F.lit(0)))


def age_recall_by_face_size(df: DataFrame) -> DataFrame:
    """Minors by face width, and one row for the adults that were found. Input: true_age, face_w, found, flagged."""
    size = F
    for lo, hi in FACE_BINS:
        size = size.when((F.col("face_w") >= lo) & (F.col("face_w") < hi), f"{lo}-{hi if hi < 10000 else 'up'}")
    kept = df.where((F.col("true_age") < 18) | F.col("found"))
    group = F.when(F.col("true_age") < 18, size).otherwise("adults found")
    return kept.groupBy(group.alias("face_size")).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.count_if("found") / F.count(F.lit(1))).alias("found_pct"),
        (100 * F.count_if("flagged") / F.count(F.lit(1))).alias("review_pct"),
        F.count_if(~F.col("found")).alias("not_found"),
        (F.count_if("found") - F.count_if("flagged")).alias("found_not_flagged"),
    )


def review_rate_by_group(df: DataFrame) -> DataFrame:
    """Per age group (index into AGE_GROUPS): n, median estimate, share not ADULT, with the fixed order of the groups."""
    names = F.array(*[F.lit(g) for g in AGE_GROUPS])
    base = df.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.count_if(F.col("assessment") != "ADULT") / F.count(F.lit(1))).alias("review_pct")
    )
    mid = exact_quantiles(df, ["group_id"], "est_age", {"median_est": 0.5}).drop("n_measured")
    return base.join(mid, "group_id", "left").select(
        "group_id", F.element_at(names, F.col("group_id").cast("int") + 1).alias("age_group"), "n", "median_est", "review_pct"
    )


def classifier_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy, AI recall, real specificity at 0.5, and the inverse-frequency weight of the AI class. Input: y 0/1, p."""
    hit = F.col("p") >= 0.5
    ai, real = F.col("y") == 1, F.col("y") == 0
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((hit == ai).cast("double")).alias("accuracy"),
        F.avg(F.when(ai, hit.cast("double"))).alias("ai_recall"),
        F.avg(F.when(real, (~hit).cast("double"))).alias("real_specificity"),
        (F.count_if(real) / F.greatest(F.lit(1), F.count_if(ai))).alias("ai_weight"),
    )


def drift_report(reference: DataFrame, current: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov on one numeric feature, skipped below MIN_DRIFT_SAMPLES on either side."""
    both = reference.select(F.col(value).alias("_v"), F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        current.select(F.col(value).alias("_v"), F.lit(0).alias("_r"), F.lit(1).alias("_c"))
    )
    counts = both.groupBy("_v").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    ranked = prefix_scan(counts, [], ["_v"], sums={"_rb": F.col("_r"), "_cb": F.col("_c")}, totals=True)
    gap = F.abs((F.col("_rb") + F.col("_r")) / F.col("total__rb") - (F.col("_cb") + F.col("_c")) / F.col("total__cb"))
    stat = ranked.agg(F.max(gap).alias("statistic"), F.max("total__rb").alias("n_reference"), F.max("total__cb").alias("n_current"))
    critical = math.sqrt(-0.5 * math.log(alpha / 2))
    limit = critical * F.sqrt((F.col("n_reference") + F.col("n_current")) / (F.col("n_reference").cast("double") * F.col("n_current")))
    enough = F.least("n_reference", "n_current") >= MIN_DRIFT_SAMPLES
    drifted = F.coalesce(enough & (F.col("statistic") > limit), F.lit(False))
    return stat.select(
        F.coalesce("n_reference", F.lit(0)).alias("n_reference"),
        F.coalesce("n_current", F.lit(0)).alias("n_current"),
        F.when(enough, F.col("statistic")).alias("statistic"),
        drifted.cast("int").alias("drifted_features"),
        drifted.cast("double").alias("drift_share"),
        (drifted.cast("double") > 0.5).alias("drift_detected"),
        F.when(enough, F.lit("complete")).otherwise(F.lit("too few samples")).alias("message"),
    )


#: Leading bits of a hash that rows are counted by.
HASH_BITS = 12


def first_by_hash(df: DataFrame, strata: list[str], quota: Column, row_id: str, seed: int) -> DataFrame:
    """min(n, quota) rows of each stratum, the first in a seeded hash order; ``quota`` is the same for all rows of a stratum.

    Rows are counted per leading bits of the hash. That small table says up to which bits the quota reaches, so only about a quota of rows is
    shuffled and ranked, whatever the size of a stratum.
    """
    from pyspark.sql import Window as W

    key = F.xxhash64(F.lit(seed), F.col(row_id))
    marked = df.withColumns({"_k": key, "_b": F.shiftrightunsigned(key, 64 - HASH_BITS), "_quota": quota.cast("bigint")})
    size = marked.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_quota").alias("_q"))
    before = F.sum("_n").over(W.partitionBy(*strata).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    reached = size.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before < _q").select(*strata, "_b", "_before")
    on = marked["_b"] == reached["_b"]
    for s in strata:
        on = on & marked[s].eqNullSafe(reached[s])
    kept = marked.join(reached, on).select(marked["*"], "_before")
    inside = F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_k", row_id))
    return kept.withColumn("_at", F.col("_before") + inside).where("_at <= _quota").drop("_k", "_b", "_quota", "_before", "_at")


def stratified_sample(df: DataFrame, stratum: str, quota: Column, row_id: str, seed: int) -> DataFrame:
    """min(n, quota) rows of each stratum in a seeded hash order."""
    return first_by_hash(df, [stratum], quota, row_id, seed)
