"""Calibration, source, sink, check and stream queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.functions import textscan as tx
from candorframe.operators import feedback as fb
from candorframe.operators.checks import CheckRegistry, score_files
from candorframe.sources import media as md
from candorframe.session import shared_folder
from candorframe.sources import sinks as sk
from candorframe.streaming import work as st
from candorframe.tables import round6, spark_sql, table, view
from candorframe.sources.stored import stream_table

C = F.col
ORDER = ["ts", "event_id"]


def _fold_sql(modality: str) -> str:
    """The corrections of one modality folded one by one."""
    n = "f.rn - 1"
    step = "{s} / pow(1 + (" + n + ") / 10, 2)"
    def d(s):
        return step.replace("{s}", str(s))
    rules = {
        "image": [
            ("feature_weights", "noise_residual", "0.35", f"CASE WHEN l='AI' AND noise < 2.5 THEN least(0.60, k.p0 + {d(0.02)}) ELSE k.p0 END"),
            ("feature_weights", "surface_smoothness", "0.30", f"CASE WHEN l='AI' AND smooth < 3.0 THEN least(0.55, k.p1 + {d(0.02)}) ELSE k.p1 END"),
            ("sensitivity_offsets", "noise_center_offset", "0.0", f"CASE WHEN l='AI' AND noise < 2.5 THEN greatest(-0.40, k.p2 - {d(0.03)}) WHEN l='REAL' AND noise < 2.0 THEN least(0.35, k.p2 + {d(0.03)}) ELSE k.p2 END"),
            ("sensitivity_offsets", "smooth_center_offset", "0.0", f"CASE WHEN l='AI' AND smooth < 3.0 THEN least(0.40, k.p3 + {d(0.03)}) WHEN l='REAL' AND smooth < 2.0 THEN greatest(-0.35, k.p3 - {d(0.03)}) ELSE k.p3 END"),
        ],
        "audio": [
            ("acoustic_weights", "vocoder_cutoff", "0.40", f"CASE WHEN l='AI' THEN least(0.60, k.p0 + {d(0.02)}) ELSE k.p0 END"),
            ("thresholds", "flatness_synthetic_max", "0.002", f"CASE WHEN l='AI' AND noise/100 > 0.002 THEN least(0.010, k.p1 + {d(0.0005)}) ELSE k.p1 END"),
            ("sensitivity_offsets", "audio_ai_offset", "0.0", f"CASE WHEN l='AI' THEN least(0.35, k.p2 + {d(0.03)}) ELSE greatest(-0.35, k.p2 - {d(0.03)}) END"),
        ],
        "video": [
            ("motion_thresholds", "high_warping_var", "140.0", f"CASE WHEN l='REAL' AND motion_var > 60 THEN least(200.0, k.p0 + {d(3.0)}) ELSE k.p0 END"),
            ("motion_thresholds", "suspicious_flicker_var", "75.0", f"CASE WHEN l='AI' AND motion_var < 100 THEN greatest(50.0, k.p1 - {d(2.0)}) ELSE k.p1 END"),
            ("sensitivity_offsets", "video_ai_offset", "0.0", f"CASE WHEN l='AI' AND motion_var < 100 THEN least(0.30, k.p2 + {d(0.03)}) WHEN l='REAL' AND motion_var > 60 THEN greatest(-0.30, k.p2 - {d(0.03)}) ELSE k.p2 END"),
        ],
    }[modality]
    starts = ", ".join(f"{v}::DOUBLE AS p{i}" for i, (_, _, v, _) in enumerate(rules))
    steps = ", ".join(f"({e})::DOUBLE" for _, _, _, e in rules)
    rows = " UNION ALL ".join(f"SELECT '{s}' AS section, '{k}' AS key, round(p{i}, 9) AS value, rn AS samples FROM fin" for i, (s, k, _, _) in enumerate(rules))
    return f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM (SELECT sha256, user_label AS l, min(event_id) AS event_id, arg_min(noise, event_id) AS noise, arg_min(smooth, event_id) AS smooth,
        arg_min(motion_var, event_id) AS motion_var FROM feedback WHERE modality = '{modality}' AND user_label IN ('AI','REAL') GROUP BY 1, 2) g),
       k AS (SELECT 0::BIGINT AS rn, {starts} UNION ALL SELECT f.rn, {steps} FROM k JOIN f ON f.rn = k.rn + 1), fin AS (SELECT * FROM k ORDER BY rn DESC LIMIT 1) {rows}"""


def _calibration(modality):
    @query(f"calibrate_{modality}", _fold_sql(modality), ("feedback",))
    def _(spark, sf):
        f = view(spark, sf, "feedback").where(C("modality") == modality).withColumn("flatness", C("noise") / 100)
        return fb.calibrate(f, modality, ORDER).select("section", "key", F.round("value", 9).alias("value"), "samples")


for _m in ("image", "audio", "video"):
    _calibration(_m)


@query("stream_feedback", _fold_sql("video"), ("feedback",))
def _(spark, sf):
    events = stream_table(spark, sf, "events")
    rows = events.selectExpr(
        "event_id", "ts", "CASE user_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS modality", "sha2(CAST(user_id AS STRING), 256) AS sha256",
        "CASE event_type WHEN 'purchase' THEN 'AI' WHEN 'view' THEN 'REAL' ELSE 'NOT SURE' END AS user_label", "CAST(NULL AS DOUBLE) AS noise", "CAST(NULL AS DOUBLE) AS smooth",
        "CAST(NULL AS DOUBLE) AS flatness", "value AS motion_var",
    )
    base = st.workspace(spark, "feedback")
    st.stream_feedback(rows, f"{base}/store", f"{base}/state", ORDER).awaitTermination()
    stored = spark.read.parquet(f"{base}/store").where("modality = 'video'")
    return fb.calibrate(stored, "video", ORDER).select("section", "key", F.round("value", 9).alias("value"), "samples")


# A document whose number ends in 5 cannot be scored: its row says why, and the others are scored.
@query(
    "stream_scoring",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 5 THEN CASE WHEN strlen(text) > 3000 THEN 'large' ELSE 'small' END END AS label, CASE WHEN doc_id % 10 <> 5 THEN (strlen(text) % 101)::DOUBLE END AS ai_pct,
       doc_id % 10 <> 5 AS success, CASE WHEN doc_id % 10 = 5 THEN 'ValueError: cannot score ' || doc_id::VARCHAR END AS error FROM documents""",
)
def _(spark, sf):
    landing = stream_table(spark, sf, "documents").select("doc_id", "text")
    base = st.workspace(spark, "scoring")

    def scorer(row):
        if row["doc_id"] % 10 == 5:
            raise ValueError(f"cannot score {row['doc_id']}")
        size = len(row["text"].encode())
        return {"label": "large" if size > 3000 else "small", "ai_percentage": float(size % 101)}

    st.stream_scoring(landing, lambda rows: score_files(rows, scorer, key="doc_id"), f"{base}/results", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/results").drop("latency_s")


LOADED = """SELECT user_id AS calib_id, e.section, e.key, max_by(e.value, event_id) AS value FROM (SELECT user_id, event_id, CASE event_id % 5
 WHEN 0 THEN named_struct('section', 'feature_weights', 'key', 'noise_residual', 'value', CAST(value / 100 AS STRING)) WHEN 1 THEN named_struct('section', 'sensitivity_offsets', 'key', 'noise_center_offset', 'value', CAST(value / 200 AS STRING))
 WHEN 2 THEN named_struct('section', 'motion_thresholds', 'key', 'high_warping_var', 'value', IF(user_id % 2 = 0, 'NaN', CAST(value AS STRING)))
 WHEN 3 THEN named_struct('section', '', 'key', 'samples_processed', 'value', IF(user_id % 3 = 0, '-4', IF(user_id % 3 = 1, '2.5', CAST(user_id AS STRING))))
 ELSE named_struct('section', 'thresholds', 'key', 'flatness_synthetic_max', 'value', 'true') END AS e FROM {events}) q GROUP BY 1, 2, 3"""


@query(
    "sanitise_calibration",
    """WITH u AS (SELECT DISTINCT user_id AS id FROM events), v AS (SELECT user_id AS id, event_id % 5 AS c, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2),
       d(section, key, dv, c) AS (VALUES ('','samples_processed',0.0,3),""" + ",".join(f"('{x[1]}','{x[2]}',{x[3]}," + {"noise_residual": "0", "noise_center_offset": "1", "high_warping_var": "2"}.get(x[2], "NULL") + ")" for x in fb.DEFAULTS) + """)
       SELECT id AS calib_id, section, key, round((CASE d.c WHEN 0 THEN CASE WHEN v/100 <= 2 THEN v/100 ELSE dv END WHEN 1 THEN CASE WHEN v/200 <= 1 THEN v/200 ELSE dv END WHEN 2 THEN CASE WHEN id % 2 = 1 THEN coalesce(v, dv) ELSE dv END
        WHEN 3 THEN CASE WHEN id % 3 = 2 AND v IS NOT NULL THEN id ELSE 0 END ELSE dv END)::DOUBLE, 6) AS value FROM u CROSS JOIN d LEFT JOIN v USING (id, c)""",
)
def _(spark, sf):
    defaults = [d[1:] for d in fb.DEFAULTS]
    return fb.sanitise_calibration(spark_sql(spark, sf, LOADED), defaults).select("calib_id", "section", "key", round6("value"))


@query(
    "sanitise_metrics",
    """SELECT event_id, concat_ws(',', 'label=' || event_type, CASE WHEN event_id % 3 <> 0 THEN 'noise=' || floor(value)::BIGINT::VARCHAR END) AS kept FROM events""",
)
def _(spark, sf):
    m = F.expr(
        """map('label', event_type, 'noise', IF(event_id % 3 = 0, 'NaN', CAST(CAST(floor(value) AS BIGINT) AS STRING)), 'heatmap', '[1,2]', 'gone', CAST(NULL AS STRING), 'path', '/x')"""
    )
    kept = fb.sanitise_metrics(m, ["path"])
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


def _checks() -> CheckRegistry:
    reg = CheckRegistry()

    @reg.register("image", "large_file")
    def _(df):
        return df.where("size_bytes > 5000").select("media_id", F.lit("WARN").alias("status"), F.lit(0.2).alias("llr"))

    @reg.register("image", "bad_plan")
    def _(df):
        return df.select("media_id", "no_such_column")

    @reg.register("image", "label")
    def _(df):
        return df.select("media_id", F.lit("FAIL").alias("status"))

    @reg.register("image", "label")
    def _(df):
        return df.select("media_id", F.when(C("label").isNull(), "ERROR").otherwise("PASS").alias("status"))

    @reg.register("image", "later", phase="post")
    def _(df):
        return df.select("media_id", F.lit("INFO").alias("status"))

    @reg.register("audio", "short")
    def _(df):
        return df.where("size_bytes < 1000").select("media_id", F.lit("WARN").alias("status"))

    @reg.register("video", "named", phase="post")
    def _(df):
        return df.select("media_id", F.when(C("path").endswith(".mp4"), "PASS").otherwise("FAIL").alias("status"))

    return reg


@query(
    "run_checks",
    """WITH u AS (SELECT modality m, 'pre' p, 'large_file' c, 'WARN' s FROM media_files WHERE modality = 'image' AND size_bytes > 5000 UNION ALL SELECT modality, 'pre', 'bad_plan', 'ERROR' FROM media_files WHERE modality = 'image'
        UNION ALL SELECT modality, 'pre', 'label', CASE WHEN label IS NULL THEN 'ERROR' ELSE 'PASS' END FROM media_files WHERE modality = 'image' UNION ALL SELECT modality, 'post', 'later', 'INFO' FROM media_files WHERE modality = 'image'
        UNION ALL SELECT modality, 'pre', 'short', 'WARN' FROM media_files WHERE modality = 'audio' AND size_bytes < 1000 UNION ALL SELECT modality, 'post', 'named', CASE WHEN path LIKE '%.mp4' THEN 'PASS' ELSE 'FAIL' END FROM media_files WHERE modality = 'video')
       SELECT m AS modality, p AS phase, c AS check_id, s AS status, count(*) AS n FROM u GROUP BY ALL""",
    ("media_files",),
)
def _(spark, sf):
    m, reg = view(spark, sf, "media_files"), _checks()
    runs = [(kind, phase, reg.run(m.where(C("modality") == kind), kind, phase)) for kind in ("image", "audio", "video") for phase in ("pre", "post")]
    found = reduce(DataFrame.unionByName, [f.select(F.lit(kind).alias("modality"), F.lit(phase).alias("phase"), "check_id", "status") for kind, phase, f in runs])
    return found.groupBy("modality", "phase", "check_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _scorer(row: dict) -> dict:
    if row["size_bytes"] % 11 == 0:
        raise ValueError("unreadable")
    return {"label": "LIKELY REAL" if row["size_bytes"] % 2 else "LIKELY AI-GENERATED", "ai_percentage": float(row["size_bytes"] % 101)}


@query(
    "score_files",
    """SELECT path, CASE WHEN size_bytes % 11 <> 0 THEN CASE WHEN size_bytes % 2 = 1 THEN 'LIKELY REAL' ELSE 'LIKELY AI-GENERATED' END END AS label, CASE WHEN size_bytes % 11 <> 0 THEN (size_bytes % 101)::DOUBLE END AS ai_pct,
       size_bytes % 11 <> 0 AS success, CASE WHEN size_bytes % 11 = 0 THEN 'ValueError: unreadable' END AS error FROM media_files""",
    ("media_files",),
)
def _(spark, sf):
    return score_files(view(spark, sf, "media_files").select("path", "size_bytes"), _scorer).drop("latency_s")


@query(
    "append_results",
    """SELECT path, CASE WHEN size_bytes % 11 = 0 THEN 'ERROR' WHEN size_bytes % 2 = 1 THEN 'LIKELY REAL' ELSE 'LIKELY AI-GENERATED' END AS verdict, CASE WHEN size_bytes % 11 <> 0 THEN (size_bytes % 101)::DOUBLE END AS ai_pct,
       CASE WHEN size_bytes % 11 = 0 THEN 'ValueError: unreadable' END AS error FROM media_files WHERE media_id % 3 <> 1""",
    ("media_files",),
)
def _(spark, sf):
    m = view(spark, sf, "media_files").select("media_id", "path", "size_bytes")
    log = f"{st.workspace(spark, 'results')}/log"

    def score(rows):
        return score_files(rows.select("path", "size_bytes"), _scorer)

    sk.append_results(m.where("media_id % 3 = 1"), log, score)
    return sk.append_results(m, log, score)


@query(
    "feature_bank_upsert",
    """WITH s AS (SELECT media_id, CASE WHEN media_id % 10 = 9 THEN '' ELSE sha256 END AS sha FROM media_files), b AS (SELECT DISTINCT sha FROM s WHERE media_id % 3 = 0 AND sha <> '')
       SELECT count(*) AS processed, count(*) FILTER (sha IN (SELECT sha FROM b)) AS reused FROM s WHERE media_id % 7 <> 0 OR sha IN (SELECT sha FROM b)""",
    ("media_files",),
)
def _(spark, sf):
    m = view(spark, sf, "media_files").select(C("media_id").alias("sample_id"), F.lit(1).alias("label"), F.when(C("media_id") % 10 == 9, "").otherwise(C("sha256")).alias("sha256"))
    bank = f"{st.workspace(spark, 'bank')}/features"

    def extract(rows):
        return rows.withColumn("embedding", F.array(F.octet_length("sha256").cast("float")))

    def partial(rows):
        return extract(rows).where("sample_id % 7 <> 0")

    sk.feature_bank_upsert(m.where("sample_id % 3 = 0"), bank, "backbone-1", extract)
    return sk.feature_bank_upsert(m, bank, "backbone-1", partial)


@query(
    "scan_media",
)
def _(spark, sf):
    t = md.file_digests(spark, [sf], [".PARQUET"])
    return t.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size_bytes", "sha256")


# Files of the documents' numbers in the two label folders and one more; a folder without files says so.
@query(
    "scan_labelled_folders",
    """SELECT CASE label WHEN 'ai_generated' THEN 1 ELSE 0 END AS truth, sum(strlen(media_id::VARCHAR) + 1)::BIGINT AS bytes, NULL::VARCHAR AS error FROM media_files WHERE label IS NOT NULL GROUP BY 1
       UNION ALL SELECT NULL, 0, 'no supported file'""",
    ("media_files",),
)
def _(spark, sf):
    root = shared_folder(spark, "labelled")
    m = view(spark, sf, "media_files")
    for folder, rows in (("ai_generated", "label = 'ai_generated'"), ("real", "label = 'real'"), ("unsorted", "label IS NULL")):
        m.where(rows).select(C("media_id").cast("string")).write.text(f"{root}/{folder}")
    found = md.scan_labelled_folders(spark, root, [".TXT"]).groupBy("truth").agg(F.sum("size_bytes").alias("bytes")).withColumn("error", F.lit(None).cast("string"))
    try:
        md.scan_labelled_folders(spark, root, [".jpg"])
    except ValueError as exc:
        return found.unionByName(spark.createDataFrame([(None, 0, str(exc)[:17])], found.schema))
    return found


@query(
    "read_reference_index",
    """SELECT doc_id, sha256(text)[1:16] AS phash, lang AS label, source FROM documents WHERE doc_id % 6 IN (1, 2, 4)""",
)
def _(spark, sf):
    line = F.expr(
        """CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 3 THEN '{"phash": broken' WHEN 5 THEN to_json(named_struct('doc_id', doc_id, 'label', lang))
           ELSE to_json(named_struct('doc_id', doc_id, 'phash', substr(sha2(text, 256), 1, 16), 'label', lang, 'source', source)) END"""
    )
    lines = table(spark, sf, "documents").select(line.alias("value"))
    return md.parse_reference_lines(lines, "doc_id bigint, phash string, label string, source string", ["phash"])


@query(
    "clean_annotations",
    """SELECT image_id::VARCHAR || '.jpg' AS img_name, true_age::INT AS age, face_w::INT AS face_x0, CASE WHEN subject % 3 <> 0 THEN subject END::INT AS person_x0, CASE WHEN subject % 3 <> 0 THEN 50 END::INT AS person_x1
       FROM age_rows WHERE true_age <> 7 AND face_w % 10 <> 3""",
    ("age_rows",),
)
def _(spark, sf):
    a = view(spark, sf, "age_rows").selectExpr(
        "concat('dir/sub/', CAST(image_id AS STRING), '.jpg') AS img_name", "CAST(IF(true_age = 7, -1, true_age) AS INT) AS age", "CAST(IF(face_w % 10 = 3, -1, face_w) AS INT) AS face_x0",
        "CAST(IF(subject % 3 = 0, -1, subject) AS INT) AS person_x0", "1 AS person_y0", "50 AS person_x1", "50 AS person_y1",
    )
    return md.clean_annotations(a).select("img_name", "age", "face_x0", "person_x0", "person_x1")


@query("read_sample_parquet", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return md.read_sample_parquet(spark, f"{sf}/embeddings.parquet", ["vec_id", "label"]).groupBy("label").agg(F.count("vec_id").alias("n"))


@query(
    "export_batch_csv",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '''=' || lang WHEN doc_id % 4 = 1 THEN '''@' || lang ELSE lang END AS cell, source FROM documents""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN concat('=', lang) WHEN 1 THEN concat('@', lang) ELSE lang END AS cell"), "source")
    path = f"{st.workspace(spark, 'export')}/table"
    sk.export_batch_csv(d, path)
    return spark.read.option("header", True).schema("doc_id bigint, cell string, source string").csv(path)


@query(
    "export_reports_json",
    """SELECT media_id, modality, ai_pct FROM modality_results WHERE media_id % 3 <> 0""",
    ("modality_results",),
)
def _(spark, sf):
    r = view(spark, sf, "modality_results").select(
        C("media_id").cast("string").alias("filename"), (C("media_id") % 3 != 0).alias("success"), F.struct("modality", "ai_pct").alias("decision")
    )
    path = f"{st.workspace(spark, 'export')}/reports"
    sk.export_reports_json(r, path)
    back = spark.read.schema("file string, decision struct<modality:string,ai_pct:double>").json(path)
    return back.select(C("file").cast("bigint").alias("media_id"), "decision.modality", "decision.ai_pct")
