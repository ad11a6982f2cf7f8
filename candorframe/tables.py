"""Input tables, and the media-shaped views over them that the registered queries run on.

Each view is one SQL text with engine tokens. Views that need an index inside a key are built from DataFrame operations on the Spark side,
because a plain window would put one key's rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorframe.operators.ordering import position

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TOKENS = {
    "SHA": "sha2(d.text,256)",
    "SHAU": "sha2(CAST(user_id AS STRING),256)",
    "BYTES": "octet_length(d.text)",
    "EPOCH": "unix_micros(CAST(ts AS TIMESTAMP))/1000000.0D",
    "STR": "STRING",
}
DUCK_TOKENS = {
    "SHA": "sha256(d.text)",
    "SHAU": "sha256(CAST(user_id AS VARCHAR))",
    "BYTES": "strlen(d.text)",
    "EPOCH": "CAST(epoch_us(ts) AS DOUBLE)/1000000",
    "STR": "VARCHAR",
}

VIEW_SQL = {
    "media_files": """SELECT d.doc_id AS media_id,
        CASE d.doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS modality,
        {SHA} AS sha256, CAST({BYTES} AS BIGINT) AS size_bytes,
        CASE l.quality WHEN 1 THEN 'real' WHEN 0 THEN 'ai_generated' END AS label,
        concat('/media/', d.source, '/', CAST(d.doc_id AS {STR}),
               CASE d.doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.wav' ELSE '.mp4' END) AS path
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "findings": """SELECT l_orderkey AS media_id, l_linenumber AS seq, concat('c', CAST(l_partkey % 12 AS {STR})) AS check_id,
        concat('stage', CAST(l_suppkey % 6 AS {STR})) AS stage,
        CASE l_suppkey % 7 WHEN 0 THEN 'PHYSICAL_SIGNAL' WHEN 1 THEN 'LEARNED_SIGNAL' WHEN 2 THEN 'METADATA_WEAK' WHEN 3 THEN 'SECURITY'
             WHEN 4 THEN 'LEGAL_FLAG' WHEN 5 THEN 'CONTEXT' ELSE 'RELIABILITY' END AS evidence_class,
        CASE l_partkey % 8 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 2 THEN 'FAIL' WHEN 3 THEN 'INFO' WHEN 4 THEN 'NOT_APPLICABLE'
             WHEN 5 THEN 'NOT_CALIBRATED' WHEN 6 THEN 'RECOGNIZED_OOS' ELSE 'ERROR' END AS status,
        round(l_discount * 10 - 0.5, 2) AS llr, CAST(CASE WHEN l_returnflag = 'A' THEN 0.40 ELSE 0.25 END AS DOUBLE) AS llr_cap
        FROM {lineitem}""",
    "modality_results": """SELECT media_id, modality, ai_pct, greatest(0.0, 100.0 - ai_pct - undecided_pct) AS real_pct, undecided_pct
        FROM (SELECT l_orderkey AS media_id, CASE l_linenumber % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'audio' END AS modality,
                     max(l_quantity) * 2 AS ai_pct, max(l_tax) * 300 AS undecided_pct FROM {lineitem} GROUP BY 1, 2) q""",
    "predictions": """SELECT l_orderkey * 8 + l_linenumber AS media_id,
        CASE l_returnflag WHEN 'R' THEN 'AI' WHEN 'N' THEN 'real' ELSE 'not sure' END AS truth, l_quantity * 2 AS p_ai_pct,
        CASE WHEN l_quantity >= 28 THEN 'LIKELY AI-GENERATED' WHEN l_quantity <= 22 THEN 'LIKELY REAL' ELSE 'UNDECIDED' END AS label,
        l_extendedprice / 100000 AS latency_s, l_tax = 0.08 AS failed FROM {lineitem}""",
    "frame_stats": """SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, ts,
        value AS luminance,
        CASE event_type WHEN 'signup' THEN 'LIKELY AI-GENERATED' WHEN 'purchase' THEN 'LIKELY AI-GENERATED'
             WHEN 'error' THEN 'UNDECIDED' ELSE 'LIKELY REAL' END AS label FROM {events}""",
    "spans": """SELECT user_id AS clip_id, event_type AS label, {EPOCH} AS start_s, {EPOCH} + value * 60 AS end_s FROM {events}""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
    "boxes": """SELECT l_orderkey AS image_id, l_linenumber AS box_id, CASE WHEN l_linenumber % 2 = 0 THEN 'face' ELSE 'person' END AS kind,
        CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, 10 + l_quantity AS w, 12 + l_quantity AS h,
        l_discount * 10 AS score FROM {lineitem}""",
    "text_fields": """SELECT doc_id AS media_id, 'body' AS field, text FROM {documents}
        UNION ALL SELECT conv_id AS media_id, concat(role, CAST(turn AS {STR})) AS field, text FROM {conversations}""",
    "links": """SELECT page_id AS link_id, CASE page_id % 10
        WHEN 0 THEN concat('http://10.0.', CAST(page_id % 256 AS {STR}), '.7:8080/x')
        WHEN 1 THEN concat('https://www.youtube.com/watch?v=', CAST(page_id AS {STR}))
        WHEN 2 THEN concat('ftp://host', CAST(page_id AS {STR}), '.example.com/')
        WHEN 3 THEN concat('http://172.', CAST(page_id % 40 AS {STR}), '.1.2/p')
        WHEN 4 THEN concat('https://user:pw@h', CAST(page_id AS {STR}), '.example.org/')
        WHEN 5 THEN concat('http://LOCALHOST/', CAST(page_id AS {STR}))
        WHEN 6 THEN concat('https://api.svc.internal:443/', CAST(page_id AS {STR}))
        WHEN 7 THEN concat('http://a b.example.com/', CAST(page_id AS {STR}))
        WHEN 8 THEN CASE page_id % 9 WHEN 0 THEN 'http://[::ffff:127.0.0.1]/' WHEN 1 THEN 'http://[FD00::1]/a' WHEN 2 THEN 'http://[fe80::1]/' WHEN 3 THEN 'http://localhost../'
             WHEN 4 THEN 'http://[2606:4700::1111]/' WHEN 5 THEN 'http://[::]/' WHEN 6 THEN 'http://[::ffff:8.8.8.8]/' WHEN 7 THEN 'http://[1::2::3]/' ELSE 'https://[2001:db8::7]:443/' END
        ELSE url END AS url FROM {pages}""",
    "feedback": """SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS modality,
        {SHAU} AS sha256, CASE event_type WHEN 'purchase' THEN 'AI' WHEN 'view' THEN 'REAL' ELSE 'NOT SURE' END AS user_label,
        CAST(CAST(floor(value * 100) AS BIGINT) % 400 AS DOUBLE) / 100 AS noise,
        CAST(CAST(floor(value * 100) AS BIGINT) % 350 AS DOUBLE) / 100 AS smooth, value AS motion_var FROM {events}""",
    "media_tags": """SELECT o.o_orderkey AS media_id,
        CASE o.o_custkey % 4 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Apple' WHEN 2 THEN 'SONY' END AS make,
        CASE o.o_custkey % 5 WHEN 0 THEN 'EOS R5' WHEN 1 THEN 'iPhone 14' WHEN 2 THEN 'ILCE-7M4' WHEN 3 THEN 'X-T5' END AS model,
        CASE o.o_orderkey % 6 WHEN 0 THEN 'Midjourney v6' WHEN 1 THEN 'Adobe Photoshop 25' WHEN 2 THEN 'ComfyUI'
             WHEN 3 THEN 'imagenumber 7' END AS software,
        CASE o.o_orderkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1080 ELSE 4032 END AS w,
        CASE o.o_orderkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2400 ELSE 3024 END AS h,
        o.o_orderdate AS original, l.shipped AS modified
        FROM {orders} o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM {lineitem} GROUP BY l_orderkey) l
             ON o.o_orderkey = l.l_orderkey""",
    "age_rows": """SELECT l_orderkey AS image_id, l_linenumber AS subject, l_partkey % 90 AS true_age,
        CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity * 1.5 END AS est_age, l_discount * 10 AS child_share, l_suppkey % 100 AS face_w
        FROM {lineitem}""",
}

# Views whose Spark and DuckDB texts differ beyond tokens.
SPARK_ONLY = {
    "spectrum": """SELECT CAST(label AS BIGINT) AS recording_id, vec_id AS frame, e.pos AS bin, abs(CAST(e.col AS DOUBLE)) AS magnitude
        FROM {embeddings} LATERAL VIEW posexplode(embedding) e""",
    "samples": """SELECT CAST(label AS BIGINT) AS recording_id, vec_id * 64 + e.pos AS idx, CAST(e.col AS DOUBLE) AS value
        FROM {embeddings} LATERAL VIEW posexplode(embedding) e""",
    "tiles": """SELECT vec_id AS image_id, e.pos AS tile, abs(CAST(e.col AS DOUBLE)) * 10 AS noise
        FROM {embeddings} LATERAL VIEW posexplode(embedding) e""",
    "histogram": """SELECT image_id, level, count(*) AS cnt FROM (SELECT vec_id AS image_id,
        CAST(least(255, greatest(0, floor((CAST(e.col AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS level
        FROM {embeddings} LATERAL VIEW posexplode(embedding) e) q GROUP BY 1, 2""",
}
DUCK_ONLY = {
    "spectrum": """SELECT CAST(label AS BIGINT) AS recording_id, vec_id AS frame, u.i - 1 AS bin,
        abs(CAST(embedding[u.i] AS DOUBLE)) AS magnitude FROM {embeddings} CROSS JOIN unnest(range(1,65)) u(i)""",
    "samples": """SELECT CAST(label AS BIGINT) AS recording_id, vec_id * 64 + u.i - 1 AS idx, CAST(embedding[u.i] AS DOUBLE) AS value
        FROM {embeddings} CROSS JOIN unnest(range(1,65)) u(i)""",
    "tiles": """SELECT vec_id AS image_id, u.i - 1 AS tile, abs(CAST(embedding[u.i] AS DOUBLE)) * 10 AS noise
        FROM {embeddings} CROSS JOIN unnest(range(1,65)) u(i)""",
    "histogram": """SELECT image_id, level, count(*) AS cnt FROM (SELECT vec_id AS image_id,
        CAST(least(255, greatest(0, floor((CAST(embedding[u.i] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS level
        FROM {embeddings} CROSS JOIN unnest(range(1,65)) u(i)) q GROUP BY 1, 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a view text with every ``{table}`` read straight from its parquet file."""
    for name in TABLES:
        text = text.replace("{" + name + "}", f"parquet.`{sf_dir}/{name}.parquet`")
    for token, value in SPARK_TOKENS.items():
        text = text.replace("{" + token + "}", value)
    return spark.sql(text)


def duck_sql(text: str) -> str:
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    for token, value in DUCK_TOKENS.items():
        text = text.replace("{" + token + "}", value)
    return text


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``frame_stats`` view: the frame number comes from a prefix count, not from a window over a whole clip."""
    rows = spark_sql(
        spark,
        sf_dir,
        """SELECT user_id AS clip_id, event_id, ts, value AS luminance,
           CASE event_type WHEN 'signup' THEN 'LIKELY AI-GENERATED' WHEN 'purchase' THEN 'LIKELY AI-GENERATED'
                WHEN 'error' THEN 'UNDECIDED' ELSE 'LIKELY REAL' END AS label FROM {events}""",
    )
    return position(rows, ["clip_id"], ["ts", "event_id"], "frame_idx").drop("event_id")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "frame_stats":
        return frames(spark, sf_dir)
    return spark_sql(spark, sf_dir, SPARK_ONLY.get(name) or VIEW_SQL[name])


def view_oracle(name: str) -> str:
    """The view's text for DuckDB."""
    return duck_sql(DUCK_ONLY.get(name) or VIEW_SQL[name])


def round6(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)
