"""Folders, files, logs, banks, checks and streams."""

import pytest
from pyspark.sql import functions as F

from candorframe.operators.checks import CheckRegistry
from candorframe.operators.feedback import calibrate
from candorframe.sources import media as md
from candorframe.sources import sinks as sk
from candorframe.streaming import work as st

C = F.col


def test_scan_folders(spark, tmp_path):
    for name in ("ai_generated/a.JPG", "ai_generated/deep/b.png", "real/c.jpg", "other/d.jpg", "real/e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 7)
    assert md.scan_media(spark, [str(tmp_path)], [".jpg", ".png"]).count() == 4
    got = {(r.path.rsplit("/", 1)[1], r.truth) for r in md.scan_labelled_folders(spark, str(tmp_path), [".jpg", ".png"]).collect()}
    assert got == {("a.JPG", 1), ("b.png", 1), ("c.jpg", 0)}
    with pytest.raises(ValueError):
        md.scan_labelled_folders(spark, str(tmp_path), [".webp"])


def test_scan_reads_no_bytes_unless_asked(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    plan = md.scan_media(spark, [str(tmp_path)], [".jpg"])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_list_and_annotation_files(spark, tmp_path):
    h = "c" * 64
    (tmp_path / "list.txt").write_text(f"# note\n\nsha256:{h}\n{h.upper()}, again\n")
    assert [r.sha256 for r in md.read_hash_blocklist(spark, str(tmp_path / "list.txt")).collect()] == [h]
    head = "img_name,age,face_x0,face_y0,face_x1,face_y1,person_x0,person_y0,person_x1,person_y1\n"
    (tmp_path / "a.csv").write_text(head + "d/x.jpg,9,1,2,3,4,-1,-1,-1,-1\ny.jpg,-1,1,2,3,4,1,1,1,1\nz.jpg,5,-1,-1,-1,-1,1,1,1,1\n")
    rows = md.read_annotations_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.img_name, r.age, r.person_x0, r.person_y1) for r in rows] == [("x.jpg", 9, None, None)]


def test_results_resume(spark, tmp_path):
    log = str(tmp_path / "log")
    inputs = spark.createDataFrame([(f"/f{i}",) for i in range(6)], "path string")

    def score(rows):
        bad = C("path") == "/f3"
        return rows.select("path", F.lit("AI").alias("label"), F.lit(60.0).alias("ai_pct"), (~bad).alias("success"), F.when(bad, F.repeat(F.lit("e"), 900)).alias("error"))

    assert sk.append_results(inputs, log, score, limit=4).count() == 4
    second = sk.append_results(inputs, log, score)
    assert second.count() == 2 and sk.append_results(inputs, log, score).count() == 0
    failed = spark.read.json(log).where("verdict = 'ERROR'").collect()
    assert len(failed) == 1 and len(failed[0].error) == 200


def test_bank_reuse_depends_on_hash_and_fingerprint(spark, tmp_path):
    bank = str(tmp_path / "bank")
    s = spark.createDataFrame([(1, 0, "h1"), (2, 1, "h2"), (3, 1, "")], "sample_id long, label int, sha256 string")

    def extract(rows):
        return rows.withColumn("embedding", F.array(F.lit(1.0).cast("float")))

    assert sk.feature_bank_upsert(s, bank, "v1", extract).first().asDict() == {"processed": 3, "reused": 0}
    assert sk.feature_bank_upsert(s, bank, "v1", extract).first().asDict() == {"processed": 3, "reused": 2}
    assert sk.feature_bank_upsert(s, bank, "v2", extract).first().asDict() == {"processed": 3, "reused": 0}
    assert {r.fingerprint for r in spark.read.parquet(bank).select("fingerprint").collect()} == {"v1", "v2"}


def test_bank_grows_by_what_is_new(spark, tmp_path):
    """A call writes new and relabelled rows only; the newest row of a content is read; compaction changes no row."""
    bank = str(tmp_path / "bank")
    samples = lambda *rows: spark.createDataFrame(list(rows), "sample_id long, label int, sha256 string")
    calls = []

    def extract(rows):
        calls.append(rows.count())
        return rows.withColumns({"embedding": F.array(C("sample_id").cast("float")), "measured": F.array([F.lit(float(k)) for k in range(12)])})

    files = lambda: {str(p) for p in (tmp_path / "bank").rglob("*.parquet")}
    sk.feature_bank_upsert(samples(*[(i, i % 2, f"h{i}") for i in range(500)]), bank, "v1", extract)
    before = files()
    got = sk.feature_bank_upsert(samples(*[(i, i % 2, f"h{i}") for i in range(501)]), bank, "v1", extract).first().asDict()
    assert got == {"processed": 501, "reused": 500} and calls == [500, 1] and len(files() - before) == 1 and before <= files()
    got = sk.feature_bank_upsert(samples((7, 0, "h7"), (8, 0, "h8")), bank, "v1", extract).first().asDict()
    assert got == {"processed": 2, "reused": 2} and calls[-1] == 0
    held = {r.sha256: (r.sample_id, r.label, r.embedding[0], len(r.measured)) for r in sk.read_bank(spark, bank).collect()}
    assert len(held) == 501 and held["h7"] == (7, 0, 7.0, 12) and held["h9"] == (9, 1, 9.0, 12)
    old = files()
    sk.compact_bank(spark, bank)
    assert {r.sha256: (r.sample_id, r.label, r.embedding[0], len(r.measured)) for r in sk.read_bank(spark, bank).collect()} == held
    assert not old & files() and spark.read.parquet(bank).count() == 501


def test_failing_check_is_isolated(spark):
    reg = CheckRegistry()
    media = spark.createDataFrame([(1,), (2,)], "media_id long")

    @reg.register("image", "broken")
    def _(df):
        raise KeyError("nope")

    @reg.register("image", "fine")
    def _(df):
        return df.select("media_id", F.lit("PASS").alias("status"))

    got = sorted((r.media_id, r.check_id, r.status, r.evidence_class) for r in reg.run(media, "image").collect())
    assert got == [(1, "broken", "ERROR", "RELIABILITY"), (1, "fine", "PASS", None), (2, "broken", "ERROR", "RELIABILITY"), (2, "fine", "PASS", None)]
    assert reg.run(media, "audio").count() == 0


def feedback(spark, rows):
    return spark.createDataFrame(rows, "ts long, sha256 string, user_label string, modality string, noise double, smooth double, flatness double, motion_var double")


def test_stream_counts_a_pair_once_and_equals_the_batch(spark, tmp_path):
    rows = [(i, f"s{i % 12}", ["AI", "Real", "Not sure"][i % 3], ["image", "video"][i % 2], 1.0 + i % 3, 1.5, None, 20.0 * (i % 7)) for i in range(90)]
    src, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    for part in range(3):
        feedback(spark, rows[part * 30 : part * 30 + 30]).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(feedback(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(src)
        st.stream_feedback(stream, store, state, ["ts"]).awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("modality", "sha256", "user_label").distinct().count()
    live = {(r.modality, r.key): r.value for r in st.calibration_state(spark, store, ["ts"]).collect()}
    for m in ("image", "video"):
        for r in calibrate(feedback(spark, rows).where(C("modality") == m), m, ["ts"]).collect():
            assert live[m, r.key] == pytest.approx(r.value)


def test_stream_scoring_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(2):
        spark.range(part * 5, part * 5 + 5).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long").parquet(src)
        st.stream_scoring(stream, lambda d: d.withColumn("p", C("id") * 2), out, state).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_stream_scoring_keeps_error_rows(spark, tmp_path):
    from candorframe.operators.checks import score_files

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).coalesce(1).write.parquet(src)

    def scorer(row):
        if row["id"] % 7 == 3:
            raise OSError("gone")
        return {"label": "AI", "ai_percentage": float(row["id"])}

    stream = spark.readStream.schema("id long").parquet(src)
    st.stream_scoring(stream, lambda d: score_files(d, scorer, key="id"), out, str(tmp_path / "state")).awaitTermination()
    got = {r.id: (r.success, r.error) for r in spark.read.parquet(out).collect()}
    assert got == {i: (False, "OSError: gone") if i % 7 == 3 else (True, None) for i in range(20)}


def test_fresh_checkpoint_neither_overwrites_nor_recounts(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    feedback(spark, [(1, "a", "AI\t", "image", 1.0, 1.0, None, 1.0), (2, "b", "real", "image", 1.0, 1.0, None, 1.0)]).coalesce(1).write.parquet(src)
    for run in range(3):
        if run == 2:
            feedback(spark, [(3, "c", "AI", "image", 1.0, 1.0, None, 1.0)]).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(feedback(spark, []).schema).parquet(src)
        st.stream_feedback(stream, store, str(tmp_path / f"state{run}"), ["ts"]).awaitTermination()
        assert sorted(r.sha256 for r in spark.read.parquet(store).collect()) == ["a", "b"] + ["c"] * (run == 2)


def test_store_of_another_shape_is_refused(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    feedback(spark, [(1, "a", "AI", "image", 1.0, 1.0, None, 1.0)]).write.parquet(src)
    spark.range(3).write.parquet(store)
    stream = spark.readStream.schema(feedback(spark, []).schema).parquet(src)
    with pytest.raises(Exception, match="was not written by this operator"):
        st.stream_feedback(stream, store, str(tmp_path / "state"), ["ts"]).awaitTermination()
    samples = spark.createDataFrame([(1, 0, "h")], "sample_id long, label int, sha256 string")
    with pytest.raises(ValueError, match="was not written by this operator"):
        sk.feature_bank_upsert(samples, store, "v1", lambda r: r)
    assert spark.read.parquet(store).count() == 3


def test_streams_read_a_file_and_a_folder(spark, sf, tmp_path):
    from candorframe.catalog import QUERIES

    folder = str(tmp_path / "sf")
    for t in ("documents", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{folder}/{t}.parquet")
    for name in ("stream_scoring", "stream_feedback"):
        a, b = (sorted(map(tuple, QUERIES[name](spark, where).collect())) for where in (sf, folder))
        assert a == b and a
