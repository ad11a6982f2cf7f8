"""The registered queries of this folder: each applies its operator to a whole table and shapes the rows of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorframe.llm import ballcodes, brown, lines, minhash, mixing, multiindex, negatives, onebit, packing, quality, secrets, urltree, warc
from candorframe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles, md5(array_to_string(list_sort(sh), chr(10))) AS k, sh FROM s),
r AS (SELECT k, min(doc_id) AS rep, any_value(n_shingles) AS c, any_value(sh) AS sh FROM n WHERE n_shingles > 0 GROUP BY k),
x AS (SELECT rep, c, unnest(sh) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep
      HAVING 100 * count(*) >= 85 * (any_value(a.c) + any_value(b.c) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t(node, root) AS (SELECT rep, rep FROM r UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
m AS (SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, coalesce(m.root, n.doc_id) AS component_id, n.doc_id = coalesce(m.root, n.doc_id) AS kept
FROM n LEFT JOIN r ON n.k = r.k AND n.n_shingles > 0 LEFT JOIN m ON m.node = r.rep
"""


@query("op7_minhash_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""


@query("op1_warc_round_trip", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read(spark, sf_dir, "pages"), shard_bytes=16 << 20, file_bytes=8 << 20)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The rules of the contract.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A page shows the document whose number ends its path; that document's labels are the page's.
SHOWN = {
    engine: f"""SELECT p.url, l.quality = 1 AND l.toxic = 0 AS good FROM {pages} p JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l
        ON l.doc_id = TRY_CAST(regexp_extract(p.url, '/([0-9]+)([.][A-Za-z]+)?/?([?#]|$)', 1) AS BIGINT) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL"""
    for engine, pages, labels in (("spark", "{pages}", "{labels}"), ("duckdb", "pages", "labels"))
}


@query("op9_url_tree", urltree.oracle(URL_RULES, SHOWN["duckdb"]))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    labelled = spark.sql(SHOWN["spark"], pages=pages.select("url"), labels=labels)
    return urltree.judge_pages(pages, labelled, URL_RULES)


@query("op10_one_bit_search")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


@query("op8_multi_index_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op5_weak_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


#: Domains are the classes of the labels; weights are shares of the mixture's tokens, and clean text keeps all of its own.
MIX_TARGETS, MIX_ANCHOR = {"clean": 0.93, "low": 0.03, "toxic": 0.04}, "clean"


def label_domains(labels: DataFrame) -> DataFrame:
    return labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'clean' END AS domain")


@query("op4_soft_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), label_domains(read(spark, sf_dir, "labels")), MIX_TARGETS, MIX_ANCHOR)


@query("op6_class_bigrams")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(read(spark, sf_dir, "documents"))


def op11_sql(rounds: int = ballcodes.ROUNDS) -> str:
    """The rounds written out one after the other; ``d * 16 + entry`` orders by distance, then entry."""
    finite = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE {finite})""",
        "p AS MATERIALIZED (SELECT rid, g AS part, v[g * len(v) // 8 + 1 : (g + 1) * len(v) // 8] AS x FROM v, range(8) r(g))",
        "b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) AS n FROM v QUALIFY n <= 16) USING (rid))",
    ]
    for t in range(rounds + 1):
        ctes.append(
            f"""a{t} AS MATERIALIZED (SELECT rid, p.part, any_value(p.x) AS x,
                min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.entry) AS m FROM p JOIN b{t} b ON p.part = b.part GROUP BY rid, p.part)"""
        )
        if t < rounds:
            ctes.append(
                f"""s{t} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
                    SELECT part, m % 16 AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, len(x) + 1) r(i) GROUP BY ALL) GROUP BY part, entry)"""
            )
            ctes.append(f"b{t + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM b{t} b LEFT JOIN s{t} s ON s.part = b.part AND s.entry = b.entry)")
    ctes += [
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
        f"""e AS (SELECT rid, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum((m - m % 16) // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)""",
    ]
    return f"""WITH {", ".join(ctes)}
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM v JOIN e ON v.rid = e.rid CROSS JOIN h"""


@query("op11_ball_codes", op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballcodes.compress(read(spark, sf_dir, "embeddings"))


@query("op12_line_crf")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_chars")


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
     WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
       CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
     FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
     QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""


@query("op13_shared_list_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 50 = 0")
