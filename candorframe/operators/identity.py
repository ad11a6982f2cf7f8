"""Content identity: digests, block lists, the registry of known files, leak-free splits and retraining choices.

Content hashes can be hot (many copies of one file), so per-hash choices are min_by / max_by aggregates with a partial step on the map side,
and joins put the hash-unique table on the other side so that skewed partitions can be split at run time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.operators.ordering import CHUNK, position, prefix_scan
from candorframe.operators.evaluation import first_by_hash
from candorframe.functions.whitespace import strip
from candorframe.session import durable

C = F.col
LABELS = ["ai_generated", "real"]
RETRAIN_HINT_AT = 15

# Per-file and per-batch limits in MiB.
UPLOAD_LIMITS = {"image": (10.0, 500.0), "video": (100.0, 500.0), "audio": (10.0, 500.0)}


def content_digests(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumns({"sha256": F.sha2(C(content), 256), "md5": F.md5(C(content)), "size_bytes": F.octet_length(content).cast("bigint")})


def partition_split(sha256: Column) -> Column:
    """'val' when the first eight hex digits are a multiple of five, else 'train'."""
    head = F.conv(F.substring(sha256, 1, 8), 16, 10).cast("bigint")
    return F.when(head % 5 == 0, "val").otherwise("train")


def normalise_feedback(feedback: DataFrame) -> DataFrame:
    """Answers AI and REAL become registry labels; everything else is dropped."""
    answer = F.upper(strip("user_label"))
    return feedback.withColumn("label", F.when(answer == "AI", "ai_generated").when(answer == "REAL", "real")).where("label IS NOT NULL")


def hard_block_gate(files: DataFrame, blocklist: DataFrame | None) -> DataFrame:
    """Adds gate_status and gate_note. A missing or empty list and a missing digest read as INACTIVE, never as clear.

    ``blocklist``: distinct sha256, None when there is no list.
    """
    if blocklist is None:
        return files.withColumns({"gate_status": F.lit("INACTIVE"), "gate_note": F.lit("no list")})
    size = blocklist.agg(F.count(F.lit(1))).scalar()
    hit = blocklist.select(C("sha256"), F.lit(True).alias("_hit"))
    digest = F.coalesce("sha256", F.lit(""))
    out = files.join(hit, "sha256", "left").withColumn("_listed", size)
    status = (
        F.when((C("_listed") == 0) | (digest == ""), "INACTIVE").when(C("_hit"), "HARD_BLOCK_ESCALATE").otherwise("CLEAR")
    )
    note = F.when(C("_listed") == 0, "empty list").when(digest == "", "not hashed")
    return out.withColumns({"gate_status": status, "gate_note": note}).drop("_hit", "_listed")


def apply_gates(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short-circuited results, rows that go on to scoring). Input: media_id, gate_status, recognised (NULL = ordinary media)."""
    status = F.when(C("gate_status") == "HARD_BLOCK_ESCALATE", "HARD_BLOCK_ESCALATE").when(C("recognised").isNotNull(), "RECOGNIZED_OUT_OF_SCOPE")
    marked = files.withColumn("final_status", status)
    blocked = marked.where("final_status IS NOT NULL").withColumns(
        {"ai_detected": F.lit(False), "p_ai": F.lit(0.0), "p_real": F.lit(0.0), "p_undecided": F.lit(100.0)}
    )
    return blocked, marked.where("final_status IS NULL").drop("final_status")


def resolvable(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """Registry rows whose recorded path still holds them: same size there, or the same bytes."""
    there = scan.select(C("path").alias("path_hint"), C("size_bytes").alias("_size"), C("sha256").alias("_sha")).distinct()
    alive = registry.join(there, "path_hint").where((C("_size") == C("size_bytes")) | (C("_sha") == C("sha256")))
    return registry.join(alive.select("sha256").distinct(), "sha256", "left_semi")


def select_samples(registry: DataFrame, scan: DataFrame, label=None, split=None, status=None) -> DataFrame:
    """(sha256, path_hint, label) of the resolvable entries that pass the optional filters."""
    rows = registry
    if label:
        rows = rows.where(C("label") == label)
    if status:
        rows = rows.where(C("status") == status)
    if split:
        rows = rows.where(partition_split(C("sha256")) == split)
    return resolvable(rows, scan).select("sha256", "path_hint", "label")


def missing_entries(registry: DataFrame, scan: DataFrame) -> DataFrame:
    return registry.join(resolvable(registry, scan).select("sha256"), "sha256", "left_anti")


def relink(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """(sha256, old_path, new_path) for missing entries found elsewhere: only files of a missing entry's size are compared by hash; the
    first path wins."""
    gone = missing_entries(registry, scan)
    candidates = scan.join(gone.select("size_bytes").distinct(), "size_bytes", "left_semi")
    first = candidates.groupBy("sha256").agg(F.min("path").alias("new_path"))
    return gone.join(first, "sha256").select("sha256", C("path_hint").alias("old_path"), "new_path")


def mark_seen(registry: DataFrame, shas: DataFrame) -> DataFrame:
    hit = shas.select("sha256").distinct().withColumn("_seen", F.lit(True))
    return registry.join(hit, "sha256", "left").withColumn("status", F.when(C("_seen"), "seen").otherwise(C("status"))).drop("_seen")


def registry_counts(registry: DataFrame, scan: DataFrame) -> DataFrame:
    gone = missing_entries(registry, scan).agg(F.count(F.lit(1))).scalar()
    agg = registry.agg(
        F.count_if(C("label") == "ai_generated").alias("ai_generated"), F.count_if(C("label") == "real").alias("real"),
        F.count_if(C("status") == "new").alias("new"),
    )
    return agg.select("ai_generated", "real", (C("ai_generated") + C("real")).alias("total"), "new", gone.alias("missing"))


def registry_upsert(registry: DataFrame, files: DataFrame, live_paths: DataFrame) -> DataFrame:
    """The registry after adding ``files`` (pos, sha256, path, size_bytes, label) in order of pos, with the number of changes per row.

    A new hash is inserted; another label relabels and sets status new; the path hint is replaced only when it is dead. Label changes of
    one hash are counted by a prefix scan, so many copies of one file are no bottleneck.
    """
    seen = prefix_scan(files, ["sha256"], ["pos"], last={"prev_label": C("label")})
    batch = seen.groupBy("sha256").agg(
        F.min_by("label", "pos").alias("b_first"), F.max_by("label", "pos").alias("b_label"), F.min_by("path", "pos").alias("b_path"),
        F.min_by("size_bytes", "pos").alias("b_size"), F.count_if(C("prev_label") != C("label")).alias("b_turns"),
    )
    alive = live_paths.select(C("path").alias("path_hint")).distinct().withColumn("_alive", F.lit(True))
    known = registry.join(alive, "path_hint", "left").withColumn("_old", F.lit(True))
    j = known.join(batch, "sha256", "full_outer")
    in_batch, old = C("b_label").isNotNull(), C("_old").isNotNull()
    changes = F.when(~in_batch, 0).otherwise(C("b_turns") + F.when(old, (C("b_first") != C("label")).cast("int")).otherwise(1))
    dead = ~old | (in_batch & C("_alive").isNull())
    return j.select(
        "sha256",
        F.coalesce("b_label", "label").alias("label"),
        F.when(dead & in_batch, C("b_path")).otherwise(C("path_hint")).alias("path_hint"),
        F.when(dead & in_batch, C("b_size")).otherwise(C("size_bytes")).alias("size_bytes"),
        F.when(changes > 0, "new").otherwise(C("status")).alias("status"),
        changes.cast("bigint").alias("changes"),
    )


def dedupe_feedback(feedback: DataFrame, order: list[str]) -> DataFrame:
    """First record per (content hash, upper-cased label)."""
    rest = [c for c in feedback.columns if c not in ("sha256", "user_label")]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return feedback.groupBy("sha256", F.upper("user_label").alias("user_label")).agg(first).select("sha256", "user_label", "r.*")


def select_for_retrain(registry: DataFrame, scan: DataFrame, replay_ratio: int = 4, min_replay: int = 50, seed: int = 42) -> DataFrame:
    """(side, sha256, label): all new training rows, a seeded replay of seen ones, every validation row."""
    rows = resolvable(registry, scan).withColumn("side", partition_split(C("sha256")))
    train = rows.where("side = 'train'")
    fresh = train.where("status = 'new'")
    quota = fresh.agg(F.greatest(F.lit(min_replay), replay_ratio * F.count(F.lit(1)))).scalar()
    replay = first_by_hash(train.where("status = 'seen'"), ["side"], quota, "sha256", seed)
    cols = ["side", "sha256", "label"]
    return fresh.select(*cols).unionByName(replay.select(*cols)).unionByName(rows.where("side = 'val'").select(*cols))


def promotion_log(log: DataFrame) -> DataFrame:
    """Last accuracy, next version and cumulative samples of the append-only log (row_no, version, accuracy, new_samples)."""
    return log.agg(
        F.max_by("accuracy", "row_no").alias("last_accuracy"),
        F.coalesce(F.max_by("version", "row_no") + 1, F.lit(1)).alias("next_version"),
        F.coalesce(F.sum("new_samples"), F.lit(0)).alias("cumulative_samples"),
    )


def promotion_decision(registry: DataFrame, scan: DataFrame, log: DataFrame, accuracy: float | None, min_new: int) -> DataFrame:
    """One row: promoted, reason, folded, cumulative after the decision."""
    new = resolvable(registry.where("status = 'new'"), scan).agg(F.count(F.lit(1))).scalar()
    kept = resolvable(registry, scan).withColumn("side", partition_split(C("sha256")))
    train = C("side") == "train"
    sides = kept.agg(
        F.count_if(train & (C("status") == "new")).alias("n_fresh"), F.count_if(train & (C("status") == "seen")).alias("n_seen"),
        F.count_if(C("side") == "val").alias("n_val"),
    ).withColumn("n_train", C("n_fresh") + F.least(C("n_seen"), F.greatest(F.lit(50), 4 * C("n_fresh"))))
    one = promotion_log(log).withColumn("n_new", new)
    x = one.withColumn("_one", F.lit(1)).join(sides.withColumn("_one", F.lit(1)), "_one")
    acc = F.lit(accuracy).cast("double")
    reason = (
        F.when(C("n_new") < max(1, min_new), "too_few_new_samples")
        .when((C("n_train") == 0) | (C("n_val") == 0), "no_train_or_validation")
        .when(acc.isNull() | F.isnan(acc) | ~acc.between(0.0, 1.0), "accuracy_not_a_probability")
        .when(acc < C("last_accuracy"), "below_last_promoted")
        .otherwise("promoted")
    )
    ok = C("reason") == "promoted"
    return x.withColumn("reason", reason).select(
        ok.alias("promoted"), "reason", F.when(ok, C("n_new")).otherwise(0).alias("folded"),
        (C("cumulative_samples") + F.when(ok, C("n_new")).otherwise(0)).alias("cumulative"), F.when(ok, C("next_version")).alias("version"),
    )


def training_manifest(models: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per modality: files behind active models, their names and the number of corrections. The model list is a small dimension table."""
    used = C("active") & C("trained_files").isNotNull()
    agg = models.groupBy("modality").agg(
        F.coalesce(F.sum(F.when(used, C("trained_files"))), F.lit(0)).alias("training_files_total"),
        F.array_join(F.sort_array(F.collect_set(F.when(used, C("model")))), ", ").alias("trained_models"),
    )
    done = corrections.groupBy("modality").agg(F.count(F.lit(1)).alias("corrections"))
    return agg.join(done, "modality", "left").withColumn("corrections", F.coalesce("corrections", F.lit(0)))


def learning_dashboard(feedback: DataFrame, registry: DataFrame) -> DataFrame:
    """Corrections per modality and in total ('(all)'), with files waiting for the next training and the hint to retrain.

    ``registry`` carries modality and status.
    """
    agg = feedback.rollup("modality").agg(
        F.count(F.lit(1)).alias("corrections"), F.count_if(F.upper("user_label") == "AI").alias("marked_ai"),
        F.count_if(F.upper("user_label") == "REAL").alias("marked_real"),
    ).withColumn("modality", F.coalesce("modality", F.lit("(all)")))
    waiting = registry.where("status = 'new'").rollup("modality").agg(F.count(F.lit(1)).alias("pending")).withColumn(
        "modality", F.coalesce("modality", F.lit("(all)"))
    )
    return agg.join(waiting, "modality", "left").withColumn("pending", F.coalesce("pending", F.lit(0))).withColumn(
        "retrain_hint", (C("modality") != "(all)") & (C("pending") >= RETRAIN_HINT_AT)
    )


def recent_corrections(feedback: DataFrame, order: list[Column], limit: int = 15) -> DataFrame:
    return feedback.orderBy(*order).limit(limit)


def admit_batch(files: DataFrame, file_bytes: float, batch_bytes: float, already_used: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(batch, pos, size_bytes, admitted) in order of pos: a file over the file limit, or one that would take the batch past its limit, is
    turned away and does not count; so is a file of unknown or negative size. ``pos`` is unique in its batch. ``already_used`` (batch, bytes) is what a batch
    already holds; a batch without a row there is empty.

    A chunk of files takes the room left on entry to the room left on exit. Only files that fit the room can count, and if all of those fit together
    they are taken, whatever their order. Sums by power of two of the size tell that for nearly every room, so entries run through most chunks without
    looking at files. A chunk in which the room ends is folded file by file, once, from its true entry; then the entries run on. The room left there
    is less than a file of that chunk needed, so later chunks see it end more and more rarely.
    """
    src = files.select("batch", C("pos").cast("bigint").alias("pos"), C("size_bytes").cast("bigint").alias("size_bytes")).withColumn("_chunk", F.expr(f"pos div {chunk}"))
    size = C("size_bytes")
    fits = F.coalesce((size <= file_bytes) & (size >= 0), F.lit(False))
    power = F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0))
    sums = src.groupBy("batch", "_chunk", F.when(fits, power).alias("power")).agg(F.sum("size_bytes").alias("total"), F.min("size_bytes").alias("least"), F.max("size_bytes").alias("most"))
    if already_used is None:
        sums = sums.withColumn("held", F.lit(0).cast("bigint"))
    else:
        held = already_used.groupBy("batch").agg(F.sum("bytes").cast("bigint").alias("held"))
        sums = sums.join(held, "batch", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("bigint")))
    kind = dict(src.dtypes)["batch"]

    def run_on(classes: pd.DataFrame) -> pd.DataFrame:
        """One row per chunk of a batch: the room on entry as far as it is known, and whether the files must be looked at there."""
        classes = classes.sort_values(["_chunk", "power"])
        room, out = batch_bytes - int(classes["held"].iloc[0]), []
        for name, own in classes.groupby("_chunk", sort=True):
            out.append([own["batch"].iloc[0], name, room, "later" if room is None else "plain"])
            if room is None:
                continue
            own = own[own["power"].notna()]
            whole, split = own[own["most"] <= room], own[(own["least"] <= room) & (own["most"] > room)]
            taken = int(whole["total"].sum())
            if not len(split) and (not len(whole) or taken <= room):
                room -= taken
            elif len(own) and pd.notna(own["leaves"].iloc[0]):
                out[-1][3], room = "folded", int(own["leaves"].iloc[0])
            else:
                out[-1][3], room = "fold", None
        got = pd.DataFrame(out, columns=["batch", "_chunk", "room", "way"])
        return got.assign(room=got["room"].astype("Int64"), last=got["_chunk"] == got["_chunk"].max())

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        room, kept = int(rows["room"].iloc[0]), []
        for size, ok in zip(rows["size_bytes"], rows["fits"]):
            ok = bool(ok) and size <= room
            room -= int(size) if ok else 0
            kept.append(ok)
        return rows[["batch", "_chunk", "pos", "size_bytes"]].assign(admitted=kept, leaves=room)

    folded_schema = f"batch {kind}, _chunk bigint, pos bigint, size_bytes bigint, admitted boolean, leaves bigint"
    folded = None
    while True:
        exits = sums.withColumn("leaves", F.lit(None).cast("bigint"))
        if folded is not None:
            exits = sums.join(folded.select("batch", "_chunk", "leaves").distinct(), ["batch", "_chunk"], "left")
        entries = durable(exits.groupBy("batch").applyInPandas(run_on, f"batch {kind}, _chunk bigint, room bigint, way string, last boolean"))
        # Chunks to fold now; those that end their batch can wait for the result itself.
        waiting = entries.where("way = 'fold'")
        due = src.withColumn("fits", fits).join(waiting, ["batch", "_chunk"]).groupBy("batch", "_chunk").applyInPandas(fold, folded_schema)
        if not waiting.where("NOT last").take(1):
            break
        due = durable(due)
        folded = due if folded is None else folded.unionByName(due)
    done = due if folded is None else folded.unionByName(due)
    plain = src.join(entries.where("way = 'plain'").select("batch", "_chunk", "room"), ["batch", "_chunk"])
    plain = plain.select("batch", "pos", "size_bytes", (fits & (size <= C("room"))).alias("admitted"))
    return plain.unionByName(done.select("batch", "pos", "size_bytes", "admitted"))
