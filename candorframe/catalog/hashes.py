"""Fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.operators import hamming as hm
from candorframe.operators import reuse as ru
from candorframe.operators.ordering import position
from candorframe.operators.spectrum import fingerprint_bits
from candorframe.tables import spark_sql, table, view

C = F.col

HALF_SPARK = "aggregate(sequence(0, 31), 0L, (a, i) -> a + IF(embedding[i + {o}] > 0, shiftleft(1L, i), 0L))"
FLIP_SPARK = """aggregate(sequence(0, 3), {h}, (a, j) -> IF(j < vec_id % 4 AND (vec_id * 7 + j * 13) % 64 BETWEEN {o} AND {o} + 31,
 a ^ shiftleft(1L, CAST((vec_id * 7 + j * 13) % 64 - {o} AS INT)), a))"""
HASH_SPARK = f"""WITH h AS (SELECT vec_id, {HALF_SPARK.format(o=0)} AS lo, {HALF_SPARK.format(o=32)} AS hi FROM {{embeddings}})
 SELECT vec_id + v * 1000000 AS item_id, IF(v = 0, hi, {FLIP_SPARK.format(h='hi', o=32)}) AS hi, IF(v = 0, lo, {FLIP_SPARK.format(h='lo', o=0)}) AS lo
 FROM h LATERAL VIEW explode(array(0, 1)) x AS v"""
HALF_DUCK = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {o} + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"
FLIP_DUCK = """xor({h}, coalesce(list_sum(list_transform(range(0, vec_id % 4), lambda j: CASE WHEN (vec_id * 7 + j * 13) % 64 BETWEEN {o} AND {o} + 31
 THEN (1::BIGINT << ((vec_id * 7 + j * 13) % 64 - {o})) ELSE 0 END)), 0)::BIGINT)"""
HASH_DUCK = f"""h0 AS (SELECT vec_id, {HALF_DUCK.format(o=0)} AS lo, {HALF_DUCK.format(o=32)} AS hi FROM embeddings),
 hash64 AS (SELECT vec_id AS item_id, hi, lo FROM h0 UNION ALL SELECT vec_id + 1000000, {FLIP_DUCK.format(h='hi', o=32)}, {FLIP_DUCK.format(h='lo', o=0)} FROM h0)"""
DIST = "(bit_count(xor({a}.hi, {b}.hi)) + bit_count(xor({a}.lo, {b}.lo)))"


def hash64(spark, sf):
    h = spark_sql(spark, sf, HASH_SPARK)
    return h.select("item_id", hm.join_halves(C("hi"), C("lo")).alias("hash"))


def halves(name: str, prefix: str):
    return [F.expr(f"shiftrightunsigned({name}, 32)").alias(f"{prefix}_hi"), F.expr(f"{name} & 4294967295L").alias(f"{prefix}_lo")]


@query(
    "phash_match",
    f"""WITH {HASH_DUCK}, q AS (SELECT hi, lo, count(*) n FROM hash64 WHERE item_id < 1000000 AND item_id % 2 = 0 GROUP BY 1, 2),
         r AS (SELECT hi, lo, count(*) n FROM hash64 WHERE item_id >= 1000000 OR item_id % 2 = 1 GROUP BY 1, 2)
        SELECT q.hi AS a_hi, q.lo AS a_lo, r.hi AS b_hi, r.lo AS b_lo, {DIST.format(a='q', b='r')}::INT AS distance, q.n AS n_items, r.n AS n_refs FROM q JOIN r ON {DIST.format(a='q', b='r')} <= 6""",
)
def _(spark, sf):
    h = hash64(spark, sf)
    index = h.where("item_id >= 1000000 OR item_id % 2 = 1").withColumnRenamed("item_id", "ref_id")
    p = hm.phash_match(h.where("item_id < 1000000 AND item_id % 2 = 0"), index)
    return p.select(*halves("hash_a", "a"), *halves("hash_b", "b"), "distance", "n_items", "n_refs")


@query(
    "phash_findings",
    f"""WITH {HASH_DUCK}, m AS (SELECT q.item_id, count(*) n, min({DIST.format(a='q', b='r')})::INT d FROM hash64 q JOIN hash64 r ON q.item_id < 1000000 AND r.item_id >= 1000000
         AND {DIST.format(a='q', b='r')} <= 6 GROUP BY 1)
       SELECT h.item_id, CASE WHEN n > 0 THEN 'WARN' ELSE 'INFO' END AS status, coalesce(n, 0) AS matches, d AS nearest, NULL::VARCHAR AS note FROM hash64 h LEFT JOIN m USING (item_id) WHERE h.item_id < 1000000""",
)
def _(spark, sf):
    h = hash64(spark, sf)
    return hm.phash_findings(h.where("item_id < 1000000"), h.where("item_id >= 1000000").withColumnRenamed("item_id", "ref_id"))


@query(
    "near_duplicate_pairs",
    f"""WITH {HASH_DUCK}, v AS (SELECT hi, lo, count(*) n FROM hash64 GROUP BY 1, 2)
        SELECT a.hi AS a_hi, a.lo AS a_lo, b.hi AS b_hi, b.lo AS b_lo, {DIST.format(a='a', b='b')}::INT AS distance, a.n AS n_a, b.n AS n_b FROM v a JOIN v b ON {DIST.format(a='a', b='b')} <= 2
         AND (((a.hi < 2147483648) = (b.hi < 2147483648) AND (a.hi, a.lo) < (b.hi, b.lo)) OR (a.hi >= 2147483648 AND b.hi < 2147483648))
        UNION ALL SELECT hi, lo, hi, lo, 0, n, n FROM v WHERE n > 1""",
)
def _(spark, sf):
    p = hm.near_duplicate_pairs(hash64(spark, sf))
    return p.select(*halves("hash_a", "a"), *halves("hash_b", "b"), "distance", "n_a", "n_b")


COMPONENTS = f"""{HASH_DUCK}, e AS (SELECT a.item_id AS u, b.item_id AS v FROM hash64 a JOIN hash64 b ON {DIST.format(a='a', b='b')} <= 2),
 reach AS (SELECT item_id AS u, item_id AS v FROM hash64 UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), grp AS (SELECT u AS item_id, min(v) AS group_id FROM reach GROUP BY 1)"""


@query("near_duplicate_groups", f"WITH RECURSIVE {COMPONENTS} SELECT item_id, group_id FROM grp UNION ALL SELECT vec_id + 2000000, vec_id + 2000000 FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, sf):
    h = hash64(spark, sf)
    bare = h.where("item_id < 1000000 AND item_id % 50 = 0").select((C("item_id") + 2000000).alias("item_id"), F.lit(None).cast("bigint").alias("hash"))
    return hm.near_duplicate_groups(h.unionByName(bare)).select("item_id", "group_id")


@query(
    "group_split",
    f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT item_id, group_id, min(sha256(item_id::VARCHAR)) OVER (PARTITION BY group_id) AS low FROM grp)
        SELECT item_id, group_id, CASE WHEN ('0x' || substr(low, 1, 8))::BIGINT % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM s""",
)
def _(spark, sf):
    return hm.group_split(hash64(spark, sf).withColumn("sha256", F.sha2(C("item_id").cast("string"), 256)))


VIDEO_DUCK = f"""{HASH_DUCK}, q AS (SELECT item_id % 40 AS clip_id, hi, lo FROM hash64 WHERE item_id < 1000000), r AS (SELECT CASE WHEN item_id % 3 = 0 THEN 999 ELSE item_id % 40 END AS ref_id, hi, lo FROM hash64 WHERE item_id >= 1000000),
       n AS (SELECT clip_id, count(*) n FROM q GROUP BY 1), qq AS (SELECT *, row_number() OVER () AS f FROM q), m AS (SELECT q.clip_id, r.ref_id, count(DISTINCT q.f) AS hit FROM qq q JOIN r ON {DIST.format(a='q', b='r')} <= 8 GROUP BY 1, 2),
       video AS (SELECT clip_id, ref_id, hit AS frames_matched FROM m JOIN n USING (clip_id) WHERE n >= 4 AND hit >= 4 AND hit/n >= 0.5)"""


def clips(spark, sf):
    h = hash64(spark, sf)
    q = h.where("item_id < 1000000").select((C("item_id") % 40).alias("clip_id"), C("item_id").alias("frame_idx"), "hash")
    return q, h.where("item_id >= 1000000").select(F.when(C("item_id") % 3 == 0, 999).otherwise(C("item_id") % 40).alias("ref_id"), "hash")


@query("video_fingerprint_match", f"WITH {VIDEO_DUCK} SELECT clip_id, ref_id, frames_matched FROM video")
def _(spark, sf):
    return ru.video_fingerprint_match(*clips(spark, sf))


# Beside the clips, each order is a clip of none to seven frames: none match, and those of fewer than four are too short.
@query(
    "video_findings",
    f"""WITH {VIDEO_DUCK}, f AS (SELECT clip_id, count(*) matches, min(ref_id) first_ref, arg_min(frames_matched, ref_id) frames_matched FROM video GROUP BY 1)
        SELECT n.clip_id, CASE WHEN matches > 0 THEN 'WARN' ELSE 'INFO' END AS status, CASE WHEN matches > 0 THEN 'MEDIUM' ELSE 'NONE' END AS severity, n AS frames,
          coalesce(matches, 0) AS matches, first_ref, frames_matched, NULL::VARCHAR AS note FROM n LEFT JOIN f USING (clip_id)
        UNION ALL SELECT 1000 + o_orderkey, CASE WHEN c < 4 THEN 'NOT_APPLICABLE' ELSE 'INFO' END, 'NONE', c, 0, NULL, NULL, CASE WHEN c < 4 THEN 'too short to fingerprint' END
          FROM (SELECT o_orderkey, count(l_orderkey) c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""",
)
def _(spark, sf):
    q, r = clips(spark, sf)
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    far = F.xxhash64("l_partkey", "l_suppkey", "l_linenumber")  # no reference is near
    more = orders.join(lines, C("l_orderkey") == C("o_orderkey"), "left").select((C("o_orderkey") + 1000).alias("clip_id"), C("l_linenumber").alias("frame_idx"), F.when(C("l_orderkey").isNotNull(), far).alias("hash"))
    return ru.video_findings(q.unionByName(more), r)


AUDIO_DUCK = """f AS (SELECT label::BIGINT AS rec, vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings), g AS (SELECT *, lag(e) OVER (PARTITION BY rec ORDER BY vec_id) AS p FROM f),
       b AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY vec_id) - 1 AS idx, list_sum(list_transform(range(0,32), lambda b: CASE WHEN (e[b+1]-e[b+2])-(p[b+1]-p[b+2]) > 0 THEN (1::BIGINT << b) ELSE 0 END))::BIGINT AS bits FROM g WHERE p IS NOT NULL),
       r AS (SELECT rec + 100 AS rec, idx - 5 AS idx, CASE WHEN idx % 3 = 0 THEN xor(bits, 1049601) ELSE bits END AS bits FROM b WHERE idx >= 5), nq AS (SELECT rec, count(*) n FROM b GROUP BY 1), nr AS (SELECT rec, count(*) n FROM r GROUP BY 1),
       o AS (SELECT b.rec AS q, r.rec AS t, r.idx - b.idx AS off, sum(bit_count(xor(b.bits, r.bits))) AS e, count(*) AS f FROM b CROSS JOIN r GROUP BY 1, 2, 3),
       k AS (SELECT q, t, e/(32.0*f)::DOUBLE AS ber FROM o JOIN nq ON nq.rec = q JOIN nr ON nr.rec = t WHERE nq.n >= 20 AND nr.n >= 20 AND f >= least(100, nq.n, nr.n)),
       audio AS (SELECT q AS query_id, t AS ref_id, round(min(ber), 6) AS ber FROM k GROUP BY 1, 2 HAVING min(ber) <= 0.30)"""


def as_sql(c):
    """Six decimals as DuckDB takes them: the scaled double is rounded. Spark's own rounding goes by decimal digits and parts from it on ties."""
    return F.round(c * 1e6) / 1e6


def recordings(spark, sf):
    e = view(spark, sf, "vectors").select(
        C("label").cast("bigint").alias("recording_id"), C("vec_id").alias("frame"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("bands")
    )
    b = position(fingerprint_bits(e), ["recording_id"], ["frame"], "idx").select(C("recording_id").alias("query_id"), "idx", "bits")
    return b, b.where("idx >= 5").select((C("query_id") + 100).alias("ref_id"), (C("idx") - 5).alias("idx"), F.expr("IF(idx % 3 = 0, bits ^ 1049601L, bits)").alias("bits"))


@query("audio_fingerprint_match", f"WITH {AUDIO_DUCK} SELECT query_id, ref_id, ber FROM audio")
def _(spark, sf):
    return ru.audio_fingerprint_match(*recordings(spark, sf)).select("query_id", "ref_id", as_sql(C("ber")).alias("ber"))


# Without recordings 7, 8 and 9 in the index, and with each order as a recording of none to seven frames.
@query(
    "audio_findings",
    f"""WITH {AUDIO_DUCK}, m AS (SELECT query_id, count(*) matches, min(ref_id) first_ref, arg_min(ber, ref_id) ber FROM audio WHERE ref_id < 107 GROUP BY 1)
        SELECT rec AS query_id, CASE WHEN n < 20 THEN 'NOT_APPLICABLE' WHEN matches > 0 THEN 'WARN' ELSE 'INFO' END AS status, CASE WHEN matches > 0 THEN 'MEDIUM' ELSE 'NONE' END AS severity, n AS frames,
          coalesce(matches, 0) AS matches, first_ref, ber, CASE WHEN n < 20 THEN 'too short to fingerprint' END AS note FROM nq LEFT JOIN m ON query_id = rec
        UNION ALL SELECT 1000 + o_orderkey, 'NOT_APPLICABLE', 'NONE', c, 0, NULL, NULL, 'too short to fingerprint'
          FROM (SELECT o_orderkey, count(l_orderkey) c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""",
)
def _(spark, sf):
    q, r = recordings(spark, sf)
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    short = orders.join(lines, C("l_orderkey") == C("o_orderkey"), "left").select((C("o_orderkey") + 1000).alias("query_id"), (C("l_linenumber") - 1).cast("bigint").alias("idx"), C("l_partkey").cast("bigint").alias("bits"))
    return ru.audio_findings(q.unionByName(short), r.where("ref_id < 107")).withColumn("ber", as_sql(C("ber")))


@query(
    "dhash_bits",
    """WITH g AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings), p AS (SELECT vec_id, list_transform(range(0, 64), lambda n: CASE WHEN g[(n//8)*9+n%8+2] > g[(n//8)*9+n%8+1] THEN 1 ELSE 0 END) AS b FROM g)
       SELECT vec_id, printf('%08x', list_sum(list_transform(range(0,32), lambda n: b[n+1]::BIGINT << (31-n)))::BIGINT) || printf('%08x', list_sum(list_transform(range(0,32), lambda n: b[n+33]::BIGINT << (31-n)))::BIGINT) AS dhash FROM p""",
)
def _(spark, sf):
    v = view(spark, sf, "vectors")
    gray = F.concat(C("embedding"), F.slice("embedding", 1, 8))
    return v.select("vec_id", gray.alias("gray")).select("vec_id", hm.dhash_bits(C("gray")).alias("dhash"))
