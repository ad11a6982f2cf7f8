"""Registry, gate and learning-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.functions.labels import media_type
from candorframe.operators import identity as idn
from candorframe.tables import round6, spark_sql, table, view

C = F.col

BASE = """SELECT d.doc_id AS media_id, {SHA} AS sha256, CAST({BYTES} AS BIGINT) AS size_bytes,
 CASE WHEN l.quality = 1 THEN 'real' WHEN l.quality = 0 THEN 'ai_generated' WHEN d.doc_id % 2 = 0 THEN 'real' ELSE 'ai_generated' END AS label,
 concat('/media/', d.source, '/', CAST(d.doc_id AS {STR})) AS path, CASE d.doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS modality
 FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
# A quarter of the registry's entries are of other content than the file that is there now; a third of the files were edited and stored elsewhere.
REGISTRY = f"""SELECT sha256, {{MINBY}}(label, media_id) AS label, {{MINBY}}(path, media_id) AS path_hint, {{MINBY}}(modality, media_id) AS modality, min(size_bytes) AS size_bytes,
 CASE WHEN min(media_id) % 2 = 0 THEN 'seen' ELSE 'new' END AS status 
 FROM (SELECT media_id, CASE WHEN media_id % 4 = 0 THEN concat(substr(sha256, 9), substr(sha256, 1, 8)) ELSE sha256 END AS sha256, label, path, modality, size_bytes FROM ({BASE}) b) c GROUP BY sha256"""
SCAN = f"""SELECT media_id AS pos, CASE WHEN media_id % 3 = 0 THEN concat(substr(sha256, 17), substr(sha256, 1, 16)) ELSE sha256 END AS sha256,
 CASE WHEN media_id % 3 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN media_id % 3 = 0 THEN concat(path, '.v2') WHEN media_id % 5 = 0 THEN concat(path, '.moved') ELSE path END AS path,
 CASE WHEN media_id % 7 = 0 THEN CASE label WHEN 'real' THEN 'ai_generated' ELSE 'real' END ELSE label END AS label FROM ({BASE}) b"""


def registry(spark, sf):
    return spark_sql(spark, sf, REGISTRY.replace("{MINBY}", "min_by"))


def scan(spark, sf):
    return spark_sql(spark, sf, SCAN)


def duck(text):
    from candorframe.tables import duck_sql

    return duck_sql(text.replace("{MINBY}", "arg_min"))


REG_CTE = f"registry AS ({duck(REGISTRY)}), scan_rows AS ({duck(SCAN)})"
ALIVE = f"""{REG_CTE}, alive AS (SELECT DISTINCT r.sha256 FROM registry r JOIN scan_rows s ON r.path_hint = s.path AND (r.size_bytes = s.size_bytes OR r.sha256 = s.sha256))"""
SPLIT = "CASE WHEN ('0x' || substr({c}, 1, 8))::BIGINT % 5 = 0 THEN 'val' ELSE 'train' END"


@query("content_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text)::BIGINT AS size_bytes FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return idn.content_digests(d).drop("content")


@query(
    "media_type",
    """WITH p AS (SELECT link_id, CASE link_id % 6 WHEN 0 THEN '/a/B.JPG' WHEN 1 THEN '/a/b.tar.webm' WHEN 2 THEN '/a/b.flac' WHEN 3 THEN '/a.mp4/readme' WHEN 4 THEN '/a/.png' ELSE url END AS path FROM links)
       SELECT link_id, CASE link_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'unknown' END AS modality FROM p""",
    ("links",),
)
def _(spark, sf):
    path = F.expr(
        "CASE link_id % 6 WHEN 0 THEN '/a/B.JPG' WHEN 1 THEN '/a/b.tar.webm' WHEN 2 THEN '/a/b.flac' WHEN 3 THEN '/a.mp4/readme' WHEN 4 THEN '/a/.png' ELSE url END"
    )
    return view(spark, sf, "links").select("link_id", media_type(path).alias("modality"))


@query("partition_split", f"SELECT media_id, {SPLIT.format(c='sha256')} AS split FROM media_files", ("media_files",))
def _(spark, sf):
    return view(spark, sf, "media_files").select("media_id", idn.partition_split(C("sha256")).alias("split"))


@query(
    "normalise_feedback",
    "SELECT event_id, CASE user_label WHEN 'AI' THEN 'ai_generated' ELSE 'real' END AS label FROM feedback WHERE user_label IN ('AI','REAL')",
    ("feedback",),
)
def _(spark, sf):
    f = view(spark, sf, "feedback").withColumn("user_label", F.concat(F.lit(" "), F.lower("user_label")))
    return idn.normalise_feedback(f).select("event_id", "label")


@query(
    "hard_block_gate",
    """WITH f AS (SELECT media_id, CASE WHEN media_id % 50 = 0 THEN NULL ELSE sha256 END AS sha256 FROM media_files), b AS (SELECT DISTINCT sha256 FROM media_files WHERE media_id % 17 = 3)
       SELECT media_id, CASE WHEN f.sha256 IS NULL THEN 'INACTIVE' WHEN b.sha256 IS NOT NULL THEN 'HARD_BLOCK_ESCALATE' ELSE 'CLEAR' END AS gate_status,
        CASE WHEN f.sha256 IS NULL THEN 'not hashed' END AS gate_note FROM f LEFT JOIN b USING (sha256)""",
    ("media_files",),
)
def _(spark, sf):
    m = view(spark, sf, "media_files")
    listed = m.where("media_id % 17 = 3").select("sha256").distinct()
    f = m.select("media_id", F.when(C("media_id") % 50 != 0, C("sha256")).alias("sha256"))
    return idn.hard_block_gate(f, listed).select("media_id", "gate_status", "gate_note")


@query(
    "apply_gates",
    """WITH b AS (SELECT DISTINCT sha256 FROM media_files WHERE media_id % 17 = 3), g AS (SELECT media_id, CASE WHEN b.sha256 IS NOT NULL THEN 'HARD_BLOCK_ESCALATE'
        WHEN media_id % 23 = 0 THEN 'RECOGNIZED_OUT_OF_SCOPE' END AS fs FROM media_files LEFT JOIN b USING (sha256))
       SELECT media_id, fs AS final_status, CASE WHEN fs IS NOT NULL THEN 0.0::DOUBLE END AS p_ai, CASE WHEN fs IS NOT NULL THEN 100.0::DOUBLE END AS p_undecided FROM g""",
    ("media_files",),
)
def _(spark, sf):
    m = view(spark, sf, "media_files")
    g = idn.hard_block_gate(m, m.where("media_id % 17 = 3").select("sha256").distinct())
    blocked, rest = idn.apply_gates(g.withColumn("recognised", F.when(C("media_id") % 23 == 0, "FITS")))
    cols = ["media_id", "final_status", "p_ai", "p_undecided"]
    return blocked.select(*cols).unionByName(rest.select("media_id"), allowMissingColumns=True)


@query(
    "select_samples",
    f"""WITH {ALIVE} SELECT sha256, path_hint, label FROM registry JOIN alive USING (sha256) WHERE label = 'real' AND status = 'new' AND {SPLIT.format(c='sha256')} = 'train'""",
)
def _(spark, sf):
    return idn.select_samples(registry(spark, sf), scan(spark, sf), label="real", split="train", status="new")


@query("missing_entries", f"WITH {ALIVE} SELECT sha256, path_hint FROM registry WHERE sha256 NOT IN (SELECT sha256 FROM alive)")
def _(spark, sf):
    return idn.missing_entries(registry(spark, sf), scan(spark, sf)).select("sha256", "path_hint")


@query(
    "relink",
    f"""WITH {ALIVE}, gone AS (SELECT * FROM registry WHERE sha256 NOT IN (SELECT sha256 FROM alive)), f AS (SELECT sha256, min(path) AS new_path FROM scan_rows GROUP BY 1)
        SELECT sha256, path_hint AS old_path, new_path FROM gone JOIN f USING (sha256)""",
)
def _(spark, sf):
    return idn.relink(registry(spark, sf), scan(spark, sf))


@query(
    "mark_seen",
    f"""WITH {REG_CTE} SELECT sha256, CASE WHEN sha256 IN (SELECT sha256 FROM scan_rows WHERE pos % 3 = 1) THEN 'seen' ELSE status END AS status FROM registry""",
)
def _(spark, sf):
    return idn.mark_seen(registry(spark, sf), scan(spark, sf).where("pos % 3 = 1")).select("sha256", "status")


@query(
    "registry_counts",
    f"""WITH {ALIVE} SELECT count(*) FILTER (label='ai_generated') AS ai_generated, count(*) FILTER (label='real') AS "real", count(*) AS total, count(*) FILTER (status='new') AS "new",
        (SELECT count(*) FROM registry WHERE sha256 NOT IN (SELECT sha256 FROM alive)) AS missing FROM registry""",
)
def _(spark, sf):
    return idn.registry_counts(registry(spark, sf), scan(spark, sf))


@query(
    "registry_upsert",
    f"""WITH {REG_CTE}, s AS (SELECT *, lag(label) OVER (PARTITION BY sha256 ORDER BY pos) AS pl FROM scan_rows),
       b AS (SELECT sha256, arg_min(label,pos) bf, arg_max(label,pos) bl, arg_min(path,pos) bp, arg_min(size_bytes,pos) bs, count(*) FILTER (pl <> label) bt FROM s GROUP BY 1),
       j AS (SELECT coalesce(r.sha256, b.sha256) AS sha256, r.sha256 IS NOT NULL AS old, b.sha256 IS NOT NULL AS inb, r.label, r.path_hint, r.size_bytes, r.status, bf, bl, bp, bs, bt,
              r.path_hint IN (SELECT path FROM scan_rows) AS al FROM registry r FULL JOIN b ON r.sha256 = b.sha256),
       k AS (SELECT *, CASE WHEN NOT inb THEN 0 ELSE bt + CASE WHEN NOT old THEN 1 WHEN bf <> label THEN 1 ELSE 0 END END AS ch FROM j)
       SELECT sha256, coalesce(bl, label) AS label, CASE WHEN inb AND (NOT old OR NOT al) THEN bp ELSE path_hint END AS path_hint, CASE WHEN inb AND (NOT old OR NOT al) THEN bs ELSE size_bytes END AS size_bytes,
        CASE WHEN ch > 0 THEN 'new' ELSE status END AS status, ch AS changes FROM k""",
)
def _(spark, sf):
    s = scan(spark, sf)
    return idn.registry_upsert(registry(spark, sf).drop("modality"), s, s.select("path"))


@query(
    "dedupe_feedback",
    """SELECT sha256, user_label, min(event_id) AS event_id, count(*) FILTER (false) AS again FROM feedback GROUP BY 1, 2""",
    ("feedback",),
)
def _(spark, sf):
    once = idn.dedupe_feedback(view(spark, sf, "feedback"), ["ts", "event_id"])
    return once.select("sha256", "user_label", "event_id", F.lit(0).cast("bigint").alias("again"))


@query(
    "select_for_retrain",
    f"""WITH {ALIVE}, r AS (SELECT r.*, {SPLIT.format(c='r.sha256')} AS sp FROM registry r JOIN alive USING (sha256)),
       c AS (SELECT count(*) FILTER (sp='train' AND status='new') nn, count(*) FILTER (sp='train' AND status='seen') ns, count(*) FILTER (sp='val') nv FROM r)
       SELECT 'train' AS side, nn + least(ns, greatest(50, 1*nn)) AS n FROM c UNION ALL SELECT 'val', nv FROM c""",
)
def _(spark, sf):
    t = idn.select_for_retrain(registry(spark, sf), scan(spark, sf), replay_ratio=1)
    return t.groupBy("side").agg(F.countDistinct("sha256").alias("n"))


LOG = "SELECT vec_id AS row_no, vec_id + 1 AS version, 0.5 + CAST(vec_id * 7 % 40 AS DOUBLE) / 100 AS accuracy, CAST(label + 3 AS BIGINT) AS new_samples FROM {embeddings}"


@query(
    "promotion_log",
    f"""WITH l AS ({LOG.replace('{embeddings}', 'embeddings')}) SELECT round(arg_max(accuracy, row_no), 6) AS last_accuracy, arg_max(version, row_no)+1 AS next_version, sum(new_samples)::BIGINT AS cumulative_samples FROM l""",
)
def _(spark, sf):
    return idn.promotion_log(spark_sql(spark, sf, LOG)).select(round6("last_accuracy"), "next_version", "cumulative_samples")


@query(
    "promotion_decision",
    f"""WITH {ALIVE}, l AS ({LOG.replace('{embeddings}', 'embeddings')}), n AS (SELECT count(*) nn FROM registry JOIN alive USING (sha256) WHERE status='new'),
       a AS (SELECT arg_max(accuracy, row_no) la, sum(new_samples)::BIGINT cu, arg_max(version, row_no)+1 nv FROM l), q AS (SELECT unnest([0.95, 0.01, 1.5, NULL])::DOUBLE AS acc)
       SELECT acc AS accuracy, coalesce(acc BETWEEN 0 AND 1 AND acc >= la, false) AS promoted, CASE WHEN acc IS NULL OR acc > 1 THEN 'accuracy_not_a_probability' WHEN acc < la THEN 'below_last_promoted' ELSE 'promoted' END AS reason,
        CASE WHEN acc BETWEEN 0 AND 1 AND acc >= la THEN nn ELSE 0 END AS folded, cu + CASE WHEN acc BETWEEN 0 AND 1 AND acc >= la THEN nn ELSE 0 END AS cumulative,
        CASE WHEN acc BETWEEN 0 AND 1 AND acc >= la THEN nv END AS version FROM q, n, a""",
)
def _(spark, sf):
    r, s, log = registry(spark, sf), scan(spark, sf), spark_sql(spark, sf, LOG)
    out = None
    for acc in (0.95, 0.01, 1.5, None):
        one = idn.promotion_decision(r, s, log, acc, min_new=5).select(F.lit(acc).cast("double").alias("accuracy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


MODELS = """SELECT CASE p_partkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS modality, p_brand AS model, p_size % 2 = 0 AS active,
 CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size * 10 AS BIGINT) END AS trained_files FROM {part}"""


@query(
    "training_manifest",
    f"""WITH m AS ({MODELS.replace('{part}', 'part')}), a AS (SELECT modality, coalesce(sum(trained_files) FILTER (active), 0)::BIGINT AS training_files_total,
        array_to_string(list_sort(list_distinct(list(model) FILTER (active AND trained_files IS NOT NULL))), ', ') AS trained_models FROM m GROUP BY 1), c AS (SELECT modality, count(*) AS corrections FROM feedback GROUP BY 1)
       SELECT * FROM a LEFT JOIN c USING (modality)""",
    ("feedback",),
)
def _(spark, sf):
    return idn.training_manifest(spark_sql(spark, sf, MODELS), view(spark, sf, "feedback"))


@query(
    "learning_dashboard",
    f"""WITH {REG_CTE}, f AS (SELECT coalesce(modality, '(all)') AS modality, count(*) AS corrections, count(*) FILTER (user_label='AI') AS marked_ai, count(*) FILTER (user_label='REAL') AS marked_real
        FROM feedback GROUP BY ROLLUP (modality)), p AS (SELECT coalesce(modality, '(all)') AS modality, count(*) AS pending FROM registry WHERE status='new' GROUP BY ROLLUP (modality))
       SELECT f.*, coalesce(pending, 0) AS pending, modality <> '(all)' AND pending >= 15 AS retrain_hint FROM f LEFT JOIN p USING (modality)""",
    ("feedback",),
)
def _(spark, sf):
    return idn.learning_dashboard(view(spark, sf, "feedback"), registry(spark, sf))


@query("recent_corrections", "SELECT event_id, modality, user_label FROM feedback ORDER BY ts DESC, event_id DESC LIMIT 15", ("feedback",))
def _(spark, sf):
    return idn.recent_corrections(view(spark, sf, "feedback"), [C("ts").desc(), C("event_id").desc()]).select("event_id", "modality", "user_label")


# The nations' numbers say what some of the batches hold already.
@query(
    "admit_batch",
    """WITH RECURSIVE h AS (SELECT n_nationkey % 16 AS batch, sum(n_nationkey * 1500)::BIGINT AS held FROM nation WHERE n_nationkey % 16 < 12 GROUP BY 1),
       f AS (SELECT media_id % 16 AS batch, media_id AS pos, size_bytes, row_number() OVER (PARTITION BY media_id % 16 ORDER BY media_id) AS rn FROM media_files),
       w AS (SELECT f.batch, 0::BIGINT AS pos, 0::BIGINT AS size_bytes, 0::BIGINT AS rn, false AS ok, coalesce(any_value(held), 0) AS used FROM f LEFT JOIN h USING (batch) GROUP BY f.batch
        UNION ALL SELECT f.batch, f.pos, f.size_bytes, f.rn, f.size_bytes <= 20000 AND w.used + f.size_bytes <= 60000, w.used + CASE WHEN f.size_bytes <= 20000 AND w.used + f.size_bytes <= 60000 THEN f.size_bytes ELSE 0 END
        FROM w JOIN f ON f.batch = w.batch AND f.rn = w.rn + 1) SELECT batch, pos, size_bytes, ok AS admitted FROM w WHERE rn > 0""",
    ("media_files",),
)
def _(spark, sf):
    m = view(spark, sf, "media_files").select((C("media_id") % 16).alias("batch"), C("media_id").alias("pos"), "size_bytes")
    held = table(spark, sf, "nation").where("n_nationkey % 16 < 12").select((C("n_nationkey") % 16).alias("batch"), (C("n_nationkey") * 1500).alias("bytes"))
    return idn.admit_batch(m, 20000, 60000, held)
