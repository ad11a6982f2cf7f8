"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candorframe.catalog.registry import query
from candorframe.operators import sequence as sq
from candorframe.operators import spectrum as sp
from candorframe.operators import vectors as vc
from candorframe.tables import round6, spark_sql, view

C = F.col
SPLIT = "CASE WHEN ('0x' || substr({c}, 1, 8))::BIGINT % 5 = 0 THEN 'val' ELSE 'train' END"


# The inverse by Gauss-Jordan steps over [covariance | unit matrix], one a row.
@query(
    "ood_gate",
    """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT count(*) AS n FROM v),
       u AS MATERIALIZED (SELECT vec_id, i, e[i] - avg(e[i]) OVER (PARTITION BY i) AS d FROM v, range(1, 65) r(i)),
       c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.d * b.d) / (any_value(n.n) - 1) AS x FROM u a JOIN u b ON a.vec_id = b.vec_id CROSS JOIN n GROUP BY 1, 2),
       g AS (SELECT 1e-3 * (sum(x) / 64 + 1e-12) AS ridge FROM c WHERE i = j),
       m0 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list_concat(list(x + CASE WHEN i = j THEN ridge ELSE 0 END ORDER BY j), list_transform(range(1, 65), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0 END)) AS row FROM c, g GROUP BY i)),
       r(k, m) AS (SELECT 1::BIGINT, m FROM m0 UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k]) ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM r WHERE k <= 64),
       w AS MATERIALIZED (SELECT list_transform(m, lambda row: row[65:128]) AS w FROM r WHERE k = 65),
       d AS MATERIALIZED (SELECT vec_id, list(d ORDER BY i) AS d FROM u GROUP BY 1),
       t AS MATERIALIZED (SELECT vec_id, sqrt(greatest(0.0, list_sum(list_transform(w, lambda row, i: d[i] * list_inner_product(row, d))))) AS distance FROM d, w)
       SELECT vec_id, CASE WHEN n >= 64 THEN round(distance, 6) END AS distance,
         CASE WHEN n < 64 THEN 'NOT_CALIBRATED' WHEN distance > quantile_cont(distance, 0.99) OVER () THEN 'OUT_OF_DISTRIBUTION' ELSE 'IN_DISTRIBUTION' END AS ood_status FROM t, n""",
)
def _(spark, sf):
    v = view(spark, sf, "vectors").select("vec_id", "embedding")
    return vc.ood_score(v, "embedding", vc.ood_fit(v, "embedding")).select("vec_id", round6("distance"), "ood_status")


@query(
    "ood_vectors",
    """WITH m AS (SELECT recording_id, bin, avg(magnitude) AS mag, bin*(22050.0/63)::DOUBLE AS hz FROM spectrum GROUP BY 1,2),
       c AS (SELECT *, sum(mag) OVER (PARTITION BY recording_id)+1e-10 AS tot, sum(mag) OVER (PARTITION BY recording_id ORDER BY bin) AS cm FROM m),
       a AS (SELECT recording_id AS id, coalesce(min(CASE WHEN cm/tot >= 0.985 THEN bin END), max(bin))*(22050.0/63)::DOUBLE AS co, exp(avg(ln(mag+1e-12)))/avg(mag+1e-12) AS fl, sum(CASE WHEN hz>=5000 THEN mag ELSE 0 END)/max(tot) AS hf FROM c GROUP BY 1),
       d AS (SELECT clip_id, frame_idx, luminance - lag(luminance) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS d FROM frame_stats), e AS (SELECT *, lag(d) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS pd FROM d),
       v AS (SELECT clip_id AS id, avg(abs(d)) mn, var_pop(abs(d)) vr, count(*) FILTER (d*pd < 0)/greatest(1, count(*)-2) AS fr FROM e GROUP BY 1)
       SELECT 'audio' AS kind, id, round((co <= 0.92*22050 AND (co BETWEEN 6500 AND 8200 OR co BETWEEN 15000 AND 16500))::INT::DOUBLE, 6) AS v1, round(co/10000, 6) AS v2, round(fl*100, 6) AS v3, 0.0::DOUBLE AS v4, round(hf, 6) AS v5 FROM a
       UNION ALL SELECT 'video', id, round(mn,6), round(ln(1+vr),6), round(fr*least(1.0,mn/10),6), round(fr,6), round(mn,6) FROM v""",
    ("spectrum", "frame_stats"),
)
def _(spark, sf):
    a = sp.spectral_features(view(spark, sf, "spectrum"), 44100, 64)
    audio = a.select(F.lit("audio").alias("kind"), C("recording_id").alias("id"), vc.audio_vector({n: C(n) for n in a.columns}).alias("v"))
    f = view(spark, sf, "frame_stats")
    v = sq.motion_variance(f.withColumn("gray_variance", F.lit(50.0))).join(sq.flicker(f), "clip_id")
    video = v.select(F.lit("video").alias("kind"), C("clip_id").alias("id"), vc.video_vector({n: C(n) for n in v.columns}).alias("v"))
    both = audio.unionByName(video)
    return both.select("kind", "id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i + 1}") for i in range(5)])


@query(
    "zero_shot_classify",
    """WITH w AS (SELECT 'w' || vec_id::VARCHAR AS label, embedding AS e FROM embeddings WHERE vec_id < 12),
       d AS (SELECT v.vec_id, w.label, 10 * list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * w.e[i]::DOUBLE)) AS x FROM embeddings v CROSS JOIN w),
       m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS ex FROM d), p AS (SELECT vec_id, label, ex/sum(ex) OVER (PARTITION BY vec_id) AS p FROM m),
       r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rn FROM p)
       SELECT vec_id, rn AS place, label, round(p, 6) AS probability, rn = 1 AND p < 0.30 AS not_sure FROM r WHERE rn <= 3""",
)
def _(spark, sf):
    v = view(spark, sf, "vectors")
    vocab = v.where("vec_id < 12").select(F.concat(F.lit("w"), C("vec_id").cast("string")).alias("label"), "embedding")
    t = vc.zero_shot_classify(v.select("vec_id", "embedding"), "embedding", vocab, scale=10.0)
    t = t.withColumn("named", vc.recognised_as(C("labels"))).select("vec_id", "named", F.posexplode("labels").alias("p", "l"))
    return t.select("vec_id", (C("p") + 1).alias("place"), "l.label", F.round("l.probability", 6).alias("probability"), ((C("p") == 0) & C("named").isNull()).alias("not_sure"))


# Greedy groups as a recursion over an album's faces; the positions of the first members are the state.
@query(
    "group_same_person",
    """WITH RECURSIVE f AS (SELECT label AS album, vec_id AS pos, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE vec_id % 20 <> 7),
       d AS (SELECT a.album, a.rn, list(list_sum(list_transform(range(1, 65), lambda i: a.e[i]::DOUBLE * b.e[i]::DOUBLE)) ORDER BY b.rn) AS cs FROM f a JOIN f b ON a.album = b.album AND b.rn <= a.rn GROUP BY 1, 2),
       k AS (SELECT album, 1::BIGINT AS rn, [1::BIGINT] AS firsts, 0::BIGINT AS g FROM f WHERE rn = 1 UNION ALL
        SELECT k.album, d.rn, CASE WHEN list_max(list_transform(k.firsts, lambda l: d.cs[l])) >= 0.2 THEN k.firsts ELSE list_append(k.firsts, d.rn) END,
         CASE WHEN list_max(list_transform(k.firsts, lambda l: d.cs[l])) >= 0.2 THEN list_position(list_transform(k.firsts, lambda l: d.cs[l]), list_max(list_transform(k.firsts, lambda l: d.cs[l]))) - 1 ELSE len(k.firsts) END
        FROM k JOIN d ON d.album = k.album AND d.rn = k.rn + 1)
       SELECT f.album, f.pos, k.g AS group_no FROM k JOIN f ON f.album = k.album AND f.rn = k.rn UNION ALL SELECT label, vec_id, -1 FROM embeddings WHERE vec_id % 20 = 7""",
)
def _(spark, sf):
    v = view(spark, sf, "vectors")
    f = v.select(C("label").alias("album"), C("vec_id").alias("pos"), F.when(C("vec_id") % 20 != 7, C("embedding")).alias("embedding"))
    return vc.group_same_person(f, threshold=0.2)


@query(
    "reuse_static_frames",
    """WITH RECURSIVE f AS (SELECT label AS clip_id, vec_id AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE / 20) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
       d AS (SELECT a.clip_id, a.rn, list(list_max(list_transform(range(1, 49), lambda i: abs(a.e[i] - b.e[i]))) ORDER BY b.rn) AS ds FROM f a JOIN f b ON a.clip_id = b.clip_id AND b.rn <= a.rn GROUP BY 1, 2),
       k AS (SELECT clip_id, 1::BIGINT AS rn, 1::BIGINT AS at FROM f WHERE rn = 1 UNION ALL SELECT k.clip_id, d.rn, CASE WHEN d.ds[k.at] < 0.012 THEN k.at ELSE d.rn END FROM k JOIN d ON d.clip_id = k.clip_id AND d.rn = k.rn + 1)
       SELECT f.clip_id, f.frame_idx, g.frame_idx AS assessed_at FROM k JOIN f ON f.clip_id = k.clip_id AND f.rn = k.rn JOIN f g ON g.clip_id = k.clip_id AND g.rn = k.at""",
)
def _(spark, sf):
    v = view(spark, sf, "vectors")
    t = v.select(C("label").alias("clip_id"), C("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double") / 20).alias("thumb"))
    return vc.reuse_static_frames(t, 8, 8)


CHANGES = """SELECT user_id AS clip_id, min(t) AS first_t, max(t) AS last_t, max(t) + 3 AS duration_s, {LIST} AS changes FROM (
 SELECT user_id, CAST(event_id % 240 AS DOUBLE) / 4 AS t, value > 300 AS hit FROM {events}) q GROUP BY 1"""


@query(
    "choose_moments",
    f"""WITH RECURSIVE c AS ({CHANGES.replace('{LIST}', 'coalesce(list_sort(list_distinct(list(t) FILTER (hit))), [])').replace('{events}', 'events')}),
       p AS (SELECT clip_id, duration_s, greatest(1.0, duration_s/20) AS sp, [first_t, last_t] || coalesce(flatten(list_transform(changes, lambda t: [t, least(last_t, t + 0.5)])), []) AS p FROM c),
       o AS (SELECT clip_id, p[1:12] || list_transform(range(0, ceil((duration_s - sp/2)/sp)::BIGINT), lambda i: sp/2 + i*sp) || p[13:] AS o FROM p),
       k AS (SELECT clip_id, 1 AS i, len(o) AS n, [o[1]] AS kept FROM o UNION ALL SELECT k.clip_id, k.i + 1, k.n, CASE WHEN len(list_filter(k.kept, lambda x: abs(x - o.o[k.i+1]) < 0.4)) > 0 THEN k.kept ELSE list_append(k.kept, o.o[k.i+1]) END FROM k JOIN o USING (clip_id) WHERE k.i < k.n),
       s AS (SELECT clip_id, list_sort(kept) AS s FROM k WHERE i = n)
       SELECT clip_id, round(unnest(CASE WHEN len(s) > 20 THEN list_transform(list_distinct(list_transform(range(0, 20), lambda i: round_even(i*(len(s)-1)/19.0::DOUBLE, 0)::INT)), lambda j: s[j+1]) ELSE s END), 6) AS t FROM s""",
)
def _(spark, sf):
    c = spark_sql(spark, sf, CHANGES.replace("{LIST}", "array_sort(collect_set(IF(hit, t, NULL)))"))
    return vc.choose_moments(c, max_frames=20).select("clip_id", round6("t"))


# The label says whether the first component is above zero, which a head can learn; twelve measurements go with each vector.
@query(
    "train_head",
    f"""WITH s AS (SELECT {SPLIT.format(c="sha256('42:' || vec_id::VARCHAR)")} AS side FROM embeddings)
        SELECT count(*) FILTER (side = 'val') AS n_held_out, count(*) FILTER (side = 'train') AS n_trained, true AS learned FROM s""",
)
def _(spark, sf):
    measured = F.transform(F.slice("embedding", 1, 12), lambda x: x * 10)
    bank = view(spark, sf, "vectors").select("vec_id", "embedding", measured.alias("m"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("y"))
    found = vc.train_head(bank, "embedding", "y", "vec_id", measurements="m", epochs=40)[1]
    return found.select("n_held_out", "n_trained", (C("accuracy") > 0.7).alias("learned"))
