"""Worked cases of the scalar rules and the evaluation metrics."""

import math

import pytest
from pyspark.sql import functions as F

from candorframe.functions import bytesniff as by
from candorframe.functions import labels as lab
from candorframe.functions import links as ln
from candorframe.functions import metadata as md
from candorframe.functions import scoring as sc
from candorframe.functions import textscan as tx
from candorframe.functions.subjects import classify_minor
from candorframe.operators import evaluation as ev
from candorframe.operators import evidence as evd
from candorframe.operators import identity as idn
from candorframe.sources.media import parse_reference_lines


def values(df, col="out"):
    return [r[col] for r in df.collect()]


@pytest.mark.parametrize(
    "p,band",
    [
        (1.0, "LEANING_SYNTHETIC"), (0.995, "LEANING_SYNTHETIC"), (0.61, "LEANING_SYNTHETIC"), (0.6, "INCONCLUSIVE"), (0.5, "INCONCLUSIVE"), (0.4, "INCONCLUSIVE"),
        (0.39, "LEANING_AUTHENTIC"), (0.005, "LEANING_AUTHENTIC"), (-3.0, "LEANING_AUTHENTIC"), (7.0, "LEANING_SYNTHETIC"), (float("nan"), "INCONCLUSIVE"), (None, "INCONCLUSIVE"),
    ],
)
def test_bands(spark, p, band):
    df = spark.createDataFrame([(p,)], "p double").select(lab.classify_band(F.col("p")).alias("out"))
    assert values(df) == [band]


def test_high_confidence_bands_are_opt_in(spark):
    df = spark.createDataFrame([(0.999,), (0.001,)], "p double").select(lab.classify_band(F.col("p"), True).alias("out"))
    assert values(df) == ["HIGH_CONFIDENCE_SYNTHETIC", "HIGH_CONFIDENCE_AUTHENTIC"]


def test_unknown_labels_are_never_real(spark):
    df = spark.createDataFrame([(" AI ",), ("Authentic",), ("maybe",), (None,)], "x string").select(lab.label_class(F.col("x")).alias("out"))
    assert values(df) == [1, 0, None, None]


def test_null_is_not_measured(spark):
    df = spark.createDataFrame([(None,)], "x double")
    x = F.col("x")
    row = df.select(
        sc.clip(x, 0, 1).alias("a"), sc.binary_entropy(x).alias("b"), sc.shift_log_odds(x, F.lit(0.3)).alias("c"), sc.gaussian_llr(x, sc.REAL_NOISE, sc.AI_NOISE).alias("d"),
        sc.normalise_by_gap(x, F.lit(1.0)).alias("e"), sc.normalise_with_margin(x, F.lit(1.0), F.lit(3.0)).alias("f"), sc.score_frame(x, F.lit(1.0))["label"].alias("g"),
    ).first()
    assert all(v is None for v in row)


def test_percentages_sum_to_100(spark):
    rows = [(float(a), float(b), float(c)) for a in (0, 3, 33.3, 100) for b in (0, 7, 66.6) for c in (0, 4, 90)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for col in (sc.normalise_with_margin(F.col("a"), F.col("b"), F.col("c")), sc.normalise_by_gap(F.col("a"), F.col("b"))):
        for r in df.select(col.alias("t")).select("t.*").collect():
            assert math.isclose(r.ai + r.real + r.undecided, 100.0, abs_tol=1e-6) and min(r) >= 0


def test_auc_counts_ties_half_and_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, t int")
    assert ev.roc_auc(df, "s", "t").first()["auc"] == pytest.approx(0.875)
    assert ev.roc_auc(df.where("t = 1"), "s", "t").first()["auc"] is None


def test_calibration_on_nothing(spark):
    row = ev.calibration_metrics(spark.createDataFrame([("maybe", 3.0)], "l string, p double"), "l", "p").first()
    assert row["n"] == 0 and row["accuracy"] is None and "nothing can be measured" in row["warnings"]


def test_cap_rules(spark):
    rows = [
        (1, "a", "PHYSICAL_SIGNAL", 5.0, 0.25), (1, "b", "LEARNED_SIGNAL", 0.3, -0.4), (1, "c", "SECURITY", 9.0, 9.0), (1, "d", "METADATA_WEAK", float("nan"), 0.2),
        (1, "e", "METADATA_WEAK", float("inf"), 0.2), (2, "a", "METADATA_WEAK", -0.1, 0.25),
    ]
    df = spark.createDataFrame(rows, "media_id long, check_id string, evidence_class string, llr double, llr_cap double")
    got = {(r.media_id, r.check_id): r.term for r in evd.cap_evidence(df).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a")}
    assert got[1, "a"] + got[1, "b"] == pytest.approx(0.40) and got[1, "a"] / got[1, "b"] == pytest.approx(0.25 / 0.3) and got[2, "a"] == -0.1


def test_split_is_by_hash(spark):
    df = spark.createDataFrame([("00000005" + "0" * 56,), ("00000006" + "0" * 56,)], "s string").select(idn.partition_split(F.col("s")).alias("out"))
    assert values(df) == ["val", "train"]


def test_empty_blocklist_never_reads_clear(spark):
    files = spark.createDataFrame([(1, "a" * 64)], "media_id long, sha256 string")
    empty = spark.createDataFrame([], "sha256 string")
    assert values(idn.hard_block_gate(files, empty), "gate_status") == ["INACTIVE"]
    assert values(idn.hard_block_gate(files, None), "gate_status") == ["INACTIVE"]


@pytest.mark.parametrize(
    "age,share,usable,want",
    [(17.9, None, True, "LIKELY_MINOR"), (26.9, 0.0, True, "POSSIBLE_MINOR"), (40.0, 0.5, True, "POSSIBLE_MINOR"), (float("nan"), None, False, "UNDETERMINED"), (40.0, None, True, "ADULT")],
)
def test_minor_rule(spark, age, share, usable, want):
    df = spark.createDataFrame([(age, share, usable)], "a double, s double, u boolean").select(classify_minor(F.col("a"), F.col("s"), F.col("u")).alias("out"))
    assert values(df) == [want]


def test_blocklist_lines(spark):
    h = "ab" * 32
    lines = [f" SHA256:{h.upper()} x", f"# {h}", "", f"a,b;sha-256:{h}", h + "0", "﻿" + h]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(tx.blocklist_entry(F.col("line")).alias("out"))
    assert values(df) == [h, None, None, h, None, h]


def test_urls(spark):
    cases = {
        "": "empty", "http://a\\b": "forbidden_character", "ftp://x": "protocol", "http://u@x.com": "credentials", "http:///p": "missing_host", "http://LOCALHOST./": "internal_host",
        "http://x.internal/": "internal_host", "http://x.com:99999/": "invalid_port", "http://x.com:8080/": "port", "http://10.1.2.3/": "restricted_address", "http://8.8.8.8:80/": None, "https://x.com/a": None,
        "http://[::1]/": "internal_host",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select(ln.url_reason(F.col("u")).alias("out"))
    assert values(df) == list(cases.values())


def test_whole_word_signatures(spark):
    rows = [("imagenumber 7", "imagenumber 7"), ("caption gemini", ""), ("x", "Gemini"), ("Midjourney v6", "")]
    df = spark.createDataFrame(rows, "e string, s string").select(md.ai_signature(F.col("e"), F.col("s")).alias("out"))
    assert values(df) == [None, None, "gemini", "midjourney"]


def test_polyglot_needs_both_zip_ends(spark):
    rows = [(bytearray(b"PK\x03\x04 only"),), (bytearray(b"PK\x03\x04 PK\x05\x06 <html5"),), (bytearray(b"<SCRIPT >%PDF-"),)]
    df = spark.createDataFrame(rows, "c binary").select(by.scan_polyglot(F.col("c")).alias("out"))
    assert values(df) == [[], ["ZIP"], ["HTML/Script", "PDF"]]


def test_declared_sizes(spark):
    def wav(size, body):
        return bytearray(b"RIFF" + size.to_bytes(4, "little") + b"WAVE" + body)

    rows = [(wav(104, b"x" * 100),), (wav(0, b"x"),), (wav(0xFFFFFFFF, b"x"),), (wav(500, b"x"),), (wav(4, b"xyz"),), (bytearray(b"plain"),)]
    df = spark.createDataFrame(rows, "c binary").select(by.trailing_bytes(F.col("c"))["status"].alias("out"))
    assert values(df) == ["PASS", "NOT_APPLICABLE", "NOT_APPLICABLE", "WARN_TRUNCATED", "WARN_TRAILING", "NOT_APPLICABLE"]


def test_reference_lines(spark):
    lines = spark.createDataFrame([("",), ("{bad",), ('{"label":"x"}',), ('{"phash":"ff","label":"y"}',)], "value string")
    assert values(parse_reference_lines(lines, "phash string, label string", ["phash"]), "label") == ["y"]


def test_formula_cells(spark):
    df = tx.formula_safe(spark.createDataFrame([("=1+1", 1), ("@x", 2), ("ok", 3), ("\tq", 4)], "a string, n int"))
    assert values(df, "a") == ["'=1+1", "'@x", "ok", "'\tq"]


def test_file_names(spark):
    names = ["../../etc/passwd", "a\\b\\c.png", "...", "", "x" * 200 + ".jpeg", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(tx.sanitise_filename(F.col("n")).alias("out"))
    assert values(df) == ["passwd", "c.png", "sanitized_media", "unnamed_file", "x" * 85 + ".jpeg", "unnamed_file"]
