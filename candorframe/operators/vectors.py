"""Embeddings: out-of-distribution gate, closed-vocabulary labels, same-person groups, static-frame reuse, examined moments, a small head."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candorframe.operators.ordering import CHUNK, chunked_fold, exact_quantiles, position
from candorframe.operators.sequence import cut
from candorframe.operators.identity import partition_split
from candorframe.session import durable, shared_folder

C = F.col

# Gate, vocabulary, grouping, reuse and sampling limits.
MIN_FIT = 20
SAME_PERSON_COSINE = 0.363
MIN_LABEL_CONFIDENCE = 0.30
REUSE_DIFFERENCE = 0.012
MOMENTS = {"grid_s": 1.0, "min_gap_s": 0.4, "second_look_s": 0.5, "priority_share": 0.6}
#: Labels of a vocabulary that goes to the tasks whole, and of a block of a larger one; distinct vectors of a part that meets a block.
MAP_SIDE_LABELS, ROWS_A_PART = 4_096, 65_536


def finite_vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(column v of the vectors of the most common length with finite components, that length); length 0 without any."""
    real = df.select(C(vector).cast("array<double>").alias("v")).where("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    size = real.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (real.where(F.size("v") == size["d"]), size["d"]) if size else (real, 0)


def vector_moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(n, mean, sample covariance) over all usable rows, None without any. Both come from tree aggregates in the JVM; the driver gets d x d numbers."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation, Summarizer

    rows, d = finite_vectors(df, vector)
    if d == 0:
        return None
    features = rows.select(array_to_vector("v").alias("v"))
    s = features.select(Summarizer.metrics("count", "mean", "variance").summary(C("v")).alias("s")).select("s.*").first()
    spread = np.sqrt(np.maximum(0.0, s["variance"].toArray()))
    if s["count"] < 2:
        return int(s["count"]), s["mean"].toArray(), np.zeros((d, d))
    related = np.nan_to_num(Correlation.corr(features, "v").first()[0].toArray())  # constant components are related with nothing
    np.fill_diagonal(related, 1.0)
    return int(s["count"]), s["mean"].toArray(), related * np.outer(spread, spread)


def ood_fit(df: DataFrame, vector: str) -> dict | None:
    """Mean, inverse covariance and the 99th-percentile distance; None (not calibrated) below max(20, d) usable rows."""
    moments = vector_moments(df, vector)
    if moments is None or moments[0] < max(MIN_FIT, len(moments[1])):
        return None
    n, mean, cov = moments
    ridge = 1e-3 * (np.trace(cov) / len(cov) + 1e-12)
    stats = {"n": int(n), "mean": mean, "inverse": np.linalg.pinv(cov + ridge * np.eye(len(cov))), "threshold": None}
    distances = df.select(mahalanobis(C(vector), stats).alias("distance"))
    stats["threshold"] = exact_quantiles(distances, [], "distance", {"t": 0.99}).first()["t"]
    return stats


def mahalanobis(vector: Column, stats: dict) -> Column:
    """Distance of a vector column, NULL when its length differs or a value is not finite."""
    mean, inverse = stats["mean"], stats["inverse"]

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        good = np.flatnonzero((v.str.len() == len(mean)).to_numpy())
        if len(good):
            diff = np.concatenate(v.iloc[good].to_list()).astype(np.float64).reshape(len(good), -1) - mean
            ok = np.isfinite(diff).all(axis=1)
            out[good[ok]] = np.sqrt(np.maximum(0.0, ((diff[ok] @ inverse) * diff[ok]).sum(axis=1)))
        return pd.Series(out)

    return F.nanvl(distance(vector), F.lit(None).cast("double"))


def ood_score(df: DataFrame, vector: str, stats: dict | None) -> DataFrame:
    """Adds distance and ood_status: IN_DISTRIBUTION, OUT_OF_DISTRIBUTION or NOT_CALIBRATED."""
    if stats is None:
        return df.withColumns({"distance": F.lit(None).cast("double"), "ood_status": F.lit("NOT_CALIBRATED")})
    status = F.when(C("distance").isNull(), "NOT_CALIBRATED").when(C("distance") > stats["threshold"], "OUT_OF_DISTRIBUTION").otherwise("IN_DISTRIBUTION")
    return df.withColumn("distance", mahalanobis(C(vector), stats)).withColumn("ood_status", status)


def audio_vector(c: dict[str, Column]) -> Column:
    return F.array(
        c["has_vocoder_cutoff"].cast("double"), c["cutoff_hz"] / 10000.0, c["spectral_flatness"] * 100.0, F.coalesce(c["silence_ratio"], F.lit(0.0)), c["high_freq_ratio"]
    )


def video_vector(c: dict[str, Column]) -> Column:
    """Five temporal measurements, NULL when one was not measured."""
    parts = [c["mean_motion_delta"], F.log1p(F.greatest(F.lit(0.0), c["motion_variance"])), c["flicker_score"], c["flicker_ratio"], c["mean_lum_jump"]]
    missing = parts[0].isNull()
    for p in (c["motion_variance"], *parts[2:]):
        missing = missing | p.isNull()
    return F.when(~missing, F.array(*parts))


def zero_shot_classify(df: DataFrame, vector: str, vocabulary: DataFrame, scale: float, top_k: int = 3, block: int = MAP_SIDE_LABELS) -> DataFrame:
    """Adds labels: array<struct<label, probability>>, the best ``top_k`` of a closed vocabulary (label, embedding), ties to the smaller label.

    A vocabulary of at most ``block`` labels goes to the tasks, and rows stay where they are. A larger one is cut into blocks of that size; every
    part of the distinct vectors meets every block, keeps a mergeable soft-max (greatest logit, sum of exponentials under it, best ``top_k``), and the
    blocks' results are merged per vector. Rows without a vector get NULL; an empty vocabulary gives empty lists.
    """
    words = vocabulary.where("label IS NOT NULL AND embedding IS NOT NULL").select("label", C("embedding").cast("array<double>").alias("embedding"))
    total = words.count()
    kind = "array<struct<label:string,probability:double>>"
    if total <= block:
        rows = sorted(words.collect(), key=lambda r: r["label"])  # at most ``block`` labels
        names, matrix = np.array([r["label"] for r in rows], object), np.array([r["embedding"] for r in rows], np.float64)

        @F.pandas_udf(kind)
        def classify(v: pd.Series) -> pd.Series:
            there = v.notna().to_numpy()
            out: list = [None] * len(v)
            if there.any():
                high, mass, at, logit = soft_max_part(_stacked(v[there]), matrix, scale, top_k)
                p = np.exp(logit - high[:, None]) / mass[:, None]
                for i, row, best in zip(np.flatnonzero(there), p, at):
                    out[i] = [{"label": names[j], "probability": float(q)} for j, q in zip(best, row)]
            return pd.Series(out, dtype=object)

        return df.withColumn("labels", classify(C(vector).cast("array<double>")))

    sides = max(1, -(-df.count() // ROWS_A_PART))
    blocks = -(-total // block)
    v = df.where(C(vector).isNotNull()).select(C(vector).cast("array<double>").alias("v")).distinct()
    v = v.select("v", F.pmod(F.xxhash64("v"), F.lit(sides)).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    w = words.select("label", "embedding", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))

    def part(rows: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        names = ["v", "high", "mass", "best"]
        if not len(rows) or not len(labels):
            return pd.DataFrame(columns=names)
        labels = labels.sort_values("label")
        named, matrix, out = labels["label"].to_numpy(object), _stacked(labels["embedding"]), []
        for at in range(0, len(rows), 4_096):
            some = rows["v"].iloc[at : at + 4_096]
            high, mass, which, logit = soft_max_part(_stacked(some), matrix, scale, top_k)
            best = [[{"logit": -float(q), "label": named[j]} for j, q in zip(js, qs)] for js, qs in zip(which, logit)]
            out.append(pd.DataFrame({"v": some.to_list(), "high": high, "mass": mass, "best": best}))
        return pd.concat(out)

    parts = v.groupBy("block", "side").cogroup(w.groupBy("block", "side")).applyInPandas(part, "v array<double>, high double, mass double, best array<struct<logit:double,label:string>>")
    # One entry a block: a few numbers each.
    merged = parts.groupBy("v").agg(F.max("high").alias("high"), F.collect_list(F.struct("high", "mass")).alias("m"), F.flatten(F.collect_list("best")).alias("best"))
    mass = F.aggregate("m", F.lit(0.0), lambda a, x: a + x["mass"] * F.exp(x["high"] - C("high")))
    top = F.transform(F.slice(F.array_sort("best"), 1, top_k), lambda b: F.struct(b["label"].alias("label"), (F.exp(-b["logit"] - C("high")) / C("mass")).alias("probability")))
    merged = merged.withColumn("mass", mass).select(C("v").alias("_v"), top.cast(kind).alias("labels"))
    return df.join(merged, C(vector).cast("array<double>") == C("_v"), "left").drop("_v")


def soft_max_part(x: np.ndarray, matrix: np.ndarray, scale: float, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(greatest logit, sum of exponentials under it, columns of the best ``top_k``, their logits) of every row; ties to the earlier column."""
    if not len(matrix):
        return np.zeros(len(x)), np.ones(len(x)), np.empty((len(x), 0), int), np.empty((len(x), 0))
    logits = scale * (x @ matrix.T)
    high = logits.max(axis=1)
    at = np.argsort(-logits, axis=1, kind="stable")[:, :top_k]
    return high, np.exp(logits - high[:, None]).sum(axis=1), at, np.take_along_axis(logits, at, 1)


def recognised_as(labels: Column) -> Column:
    """The best label, NULL ('not sure') below 0.30."""
    best = F.get(labels, F.lit(0))
    return F.when(best["probability"] >= MIN_LABEL_CONFIDENCE, best["label"])


def group_same_person(faces: DataFrame, threshold: float = SAME_PERSON_COSINE, block: int = 4_096, most: int = 16_384, piece: int = 32_768) -> DataFrame:
    """(album, pos, group_no): greedy, order-stable groups of unit embeddings; -1 without an embedding. Input: album, pos, embedding.

    A face joins the earlier group whose first member is most similar, if at least ``threshold``, else it starts a group. ``pos`` is a unique whole
    number in its album.

    A round takes the next ``block`` undecided faces of every album (twice as many in the next round, up to ``most``), finds the first members among
    them, and lets the faces of the album, in pieces, look for their best new first member. First members and what faces found are appended to two
    tables, (album, pos, leader, cosine); embeddings are written for first members only, so an album of unlike faces costs its own size.
    """
    spark = faces.sparkSession
    kind = dict(faces.dtypes)
    known = faces.where("embedding IS NOT NULL").select("album", C("pos").cast("bigint").alias("pos"), C("embedding").cast("array<double>").alias("embedding"))
    first_schema = f"album {kind['album']}, pos bigint, embedding array<double>, upto bigint, round int"
    found_schema = f"album {kind['album']}, pos bigint, leader bigint, cosine double"
    firsts, found = shared_folder(spark, "firsts"), shared_folder(spark, "found")
    stored = lambda path, schema: spark.read.schema(schema).parquet(path)
    order, turn = W.partitionBy("album").orderBy("pos"), 0
    undecided = known
    while undecided.take(1):
        head = undecided.withColumn("_n", F.row_number().over(order)).where(C("_n") <= min(most, block << turn)).drop("_n")
        elected = head.groupBy("album").applyInPandas(lambda p: first_members(p, threshold), first_schema.rsplit(",", 1)[0])
        elected.withColumn("round", F.lit(turn)).write.mode("append").parquet(firsts)
        leaders = stored(firsts, first_schema)
        fresh = leaders.where(C("round") == turn)
        # The faces of finished albums stay where they are.
        rows = known.join(fresh.select("album").distinct(), "album", "left_semi").withColumn("piece", F.expr(f"pos div {piece}"))
        panel = rows.select("album", "piece").distinct().join(fresh, "album")
        panel = panel.select(*[C(c).alias(c) for c in panel.columns])
        similar = rows.groupBy("album", "piece").cogroup(panel.groupBy("album", "piece"))
        similar.applyInPandas(lambda r, l: nearest_first(r, l, threshold), found_schema).write.mode("append").parquet(found)
        after = known.join(leaders.groupBy("album").agg(F.max("upto").alias("upto")), "album").where("pos > upto").drop("upto")
        undecided = after.join(stored(found, found_schema).select("album", "pos"), ["album", "pos"], "left_anti")
        turn += 1
    alone = faces.where("embedding IS NULL").select("album", "pos", F.lit(-1).cast("bigint").alias("group_no"))
    if turn == 0:
        return alone
    numbered = position(leaders.select("album", C("pos").alias("leader")), ["album"], ["leader"], "group_no")
    best = stored(found, found_schema).groupBy("album", "pos").agg(F.min(F.struct((-C("cosine")).alias("c"), "leader"))["leader"].alias("leader"))
    own = leaders.select("album", "pos", C("pos").alias("leader"))
    named = best.unionByName(own).join(numbered, ["album", "leader"]).select("album", C("pos").cast(kind["pos"]).alias("pos"), "group_no")
    return named.unionByName(alone)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.concatenate(vectors.to_list()).reshape(len(vectors), -1)


def first_members(faces: pd.DataFrame, threshold: float, step: int = 256) -> pd.DataFrame:
    """Faces, in order, that no earlier one of those kept is similar to; and the last place looked at. A step of faces meets those kept at once."""
    p = faces.sort_values("pos")
    x = _stacked(p["embedding"])
    kept = np.empty(0, np.int64)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        open_ = (part @ x[kept].T < threshold).all(axis=1)
        near = part @ part.T >= threshold
        for i in range(len(part)):
            if open_[i]:
                open_[i + 1 :] &= ~near[i, i + 1 :]
        kept = np.append(kept, at + np.flatnonzero(open_))
    return p.iloc[kept][["album", "pos", "embedding"]].assign(upto=p["pos"].max())


def nearest_first(faces: pd.DataFrame, firsts: pd.DataFrame, threshold: float, pivots: int = 16, rows: int = 4_096) -> pd.DataFrame:
    """(album, pos, leader, cosine): for each face its most similar earlier first member among ``firsts``, the earliest of equals, if similar enough.

    First members are grouped around a few of them (pivots). A face whose angle to a pivot exceeds the group's radius by more than the threshold's
    angle can be similar to none of the group, so the group is skipped for it.
    """
    out = [[], [], []]
    if len(faces) and len(firsts):
        firsts = firsts.sort_values("pos")
        lead, y = firsts["pos"].to_numpy(), _stacked(firsts["embedding"])
        angle = lambda c: np.arccos(np.clip(c, -1, 1))
        heads = y[:: max(1, -(-len(y) // pivots))]
        to_heads = angle(y @ heads.T)
        of = to_heads.argmin(axis=1)
        groups = [np.flatnonzero(of == g) for g in range(len(heads))]
        reach = np.array([to_heads[m, g].max(initial=0) for g, m in enumerate(groups)]) + np.arccos(min(1.0, threshold)) + 1e-6
        faces = faces[faces["pos"] > lead[0]]
        for at in range(0, len(faces), rows):
            part = faces.iloc[at : at + rows]
            pos, x = part["pos"].to_numpy(), _stacked(part["embedding"])
            top, who = np.full(len(x), -np.inf), np.full(len(x), np.iinfo(np.int64).max)
            may = angle(x @ heads.T) <= reach
            for g, m in enumerate(groups):
                some = np.flatnonzero(may[:, g])
                if not len(some) or not len(m):
                    continue
                sims = x[some] @ y[m].T
                sims[lead[m][None, :] >= pos[some][:, None]] = -np.inf
                best = sims.argmax(axis=1)  # the earliest of equals
                value, name = sims[np.arange(len(some)), best], lead[m][best]
                better = (value > top[some]) | (value == top[some]) & (name < who[some])
                top[some[better]], who[some[better]] = value[better], name[better]
            hit = np.flatnonzero(top >= threshold)
            for c, v in zip(out, (pos[hit], who[hit], top[hit])):
                c.append(v)
    pos, leader, cosine = (np.concatenate(c) if c else np.empty(0) for c in out)
    album = faces["album"].iloc[0] if len(pos) else None
    return pd.DataFrame({"album": pd.Series([album] * len(pos), dtype=faces["album"].dtype if len(faces) else None), "pos": pos.astype(np.int64), "leader": leader.astype(np.int64), "cosine": cosine})


def reuse_static_frames(frames: DataFrame, height: int, width: int, limit: float = REUSE_DIFFERENCE, chunk: int = CHUNK) -> DataFrame:
    """(clip_id, frame_idx, assessed_at): the frame whose result is used, which is the last assessed one while the picture stays within
    ``limit`` of it. Input: clip_id, frame_idx, thumb. A frame without a picture is assessed itself, and so is the one after it; a
    difference that is not a number counts as none."""
    src = frames.select("clip_id", "frame_idx", "thumb")
    bh, bw = (height - height % 6) // 6, (width - width % 8) // 8

    def fold(rows: pd.DataFrame, state):
        at = []
        for idx, thumb in zip(rows["frame_idx"], rows["thumb"]):
            if thumb is None:
                state = None
                at.append(int(idx))
                continue
            t = np.asarray(thumb, dtype=np.float64).reshape(height, width)
            if state is not None:
                d = np.abs(t - state[1])[: bh * 6, : bw * 8].reshape(6, bh, 8, bw).mean(axis=(1, 3)).max()
            if state is None or d >= limit:
                state = (int(idx), t)
            at.append(state[0])
        return rows[["clip_id", "frame_idx"]].assign(assessed_at=at), state

    kinds = dict(src.dtypes)
    return chunked_fold(src, ["clip_id"], ["frame_idx"], cut("frame_idx", chunk), fold, f"clip_id {kinds['clip_id']}, frame_idx bigint, assessed_at bigint")


def choose_moments(clips: DataFrame, max_frames: int = 60) -> DataFrame:
    """(clip_id, t): at most ``max_frames`` moments per clip. Input: clip_id, first_t, last_t, duration_s, changes (sorted array of seconds).

    The start, the end and each change with a second look come first (up to 60 % of the budget), then an even grid, then what is left of the
    priority list; a moment within 0.4 s of a kept one is dropped, and too many are thinned evenly. All probes of a clip count.
    """
    head = max(2, max_frames * 6 // 10)
    looks = F.flatten(F.transform("changes", lambda t: F.array(t, F.least(C("last_t"), t + MOMENTS["second_look_s"]))))
    priority = F.concat(F.array("first_t", "last_t"), looks)
    spacing = F.greatest(F.lit(MOMENTS["grid_s"]), C("duration_s") / max(1, max_frames))
    count = F.ceil((C("duration_s") - C("spacing") / 2) / C("spacing"))
    grid = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: C("spacing") / 2 + i * C("spacing"))).otherwise(F.array().cast("array<double>"))
    x = clips.withColumn("spacing", spacing).withColumn("p", priority)
    ordered = F.concat(F.slice("p", 1, head), grid, F.when(F.size("p") > head, F.slice(C("p"), F.lit(head + 1), F.size("p"))).otherwise(F.array().cast("array<double>")))

    def keep(acc: Column, t: Column) -> Column:
        return F.when(F.exists(acc, lambda k: F.abs(t - k) < MOMENTS["min_gap_s"]), acc).otherwise(F.array_append(acc, t))

    x = x.withColumn("kept", F.sort_array(F.aggregate(ordered, F.array().cast("array<double>"), keep)))
    n = F.size("kept")
    marks = F.transform(F.sequence(F.lit(0), F.lit(max_frames - 1)), lambda i: F.bround(i * (n - 1) / float(max(1, max_frames - 1))).cast("int"))
    thinned = F.transform(F.array_distinct(marks), lambda i: F.get("kept", i))
    return x.select("clip_id", F.explode(F.when(n > max_frames, thinned).otherwise(C("kept"))).alias("t"))


def train_head(bank: DataFrame, vector: str, label: str, row_id: str, measurements: str | None = None, seed: int = 42, hidden: int = 64, epochs: int = 60):
    """(model, metrics): a two-class head on stored vectors, and on an array of ``measurements`` beside them; metrics has counts and held-out accuracy.

    About a fifth is held out, by the digest of the seed and the row's id, so a row keeps its side whatever else is in the bank. Rows without a vector,
    label or id, and those of another length than the most common, take no part.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    inputs = F.concat(vector, measurements) if measurements else C(vector)
    rows = bank.where(C(label).isNotNull() & C(row_id).isNotNull()).select(inputs.cast("array<double>").alias("v"), C(label).cast("double").alias("label"), row_id)
    _, width = finite_vectors(rows, "v")
    rows = rows.where((F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    side = partition_split(F.sha2(F.concat_ws(":", F.lit(seed), row_id), 256))
    marked = durable(rows.select(array_to_vector("v").alias("features"), "label", (side == "val").alias("held")))
    model = MultilayerPerceptronClassifier(layers=[width, hidden, 2], seed=seed, maxIter=epochs).fit(marked.where("NOT held"))
    scored = model.transform(marked.where("held"))
    held = scored.agg(F.count(F.lit(1)).alias("n_held_out"), F.avg((C("prediction") == C("label")).cast("double")).alias("accuracy"))
    return model, held.withColumn("n_trained", marked.where("NOT held").agg(F.count(F.lit(1))).scalar())
