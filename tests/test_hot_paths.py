"""One key holding most of the rows, and small chunk sizes: the split paths must give what the plain ones give."""

import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candorframe.operators import boxes as bx
from candorframe.operators import feedback as fb
from candorframe.operators import hamming as hm
from candorframe.operators import reuse as ru
from candorframe.operators import identity as idn
from candorframe.operators import sequence as sq
from candorframe.operators import truth as tr
from candorframe.operators import vectors as vc
from candorframe.operators.ordering import exact_quantiles, position, prefix_scan

C = F.col


def rows_of(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = [(0 if i % 10 < 7 else i % 10, i, rng.choice([1.0, 2.5, 4.0, 9.0]) + i % 3, rng.choice("ABC")) for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["clip_id", "t", "luminance", "label"])
    pdf["frame_idx"] = pdf.groupby("clip_id").cumcount()
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.mark.parametrize("chunk", [None, 3, 1000])
@pytest.mark.parametrize("reverse", [False, True])
def test_prefix_scan(series, chunk, reverse):
    df, pdf = series
    given = F.expr(f"frame_idx div {chunk}") if chunk else None
    out = prefix_scan(
        df, ["clip_id"], ["frame_idx"], sums={"s": C("luminance")}, maxes={"m": C("luminance")}, last={"p": C("label"), "q": C("frame_idx")}, chunk=given, reverse=reverse, totals=True
    )
    want = []
    for _, g in pdf.groupby("clip_id"):
        g = g.sort_values("frame_idx", ascending=not reverse)
        before = g["luminance"].cumsum().shift(1, fill_value=0.0)
        top = g["luminance"].cummax().shift(1)
        for (_, r), s, m, p, q in zip(g.iterrows(), before, top, g["label"].shift(1), g["frame_idx"].shift(1)):
            none = pd.isna(m)
            want.append((r.clip_id, r.frame_idx, s, None if none else m, None if none else p, None if none else int(q), g["luminance"].sum()))
    assert rows_of(out, "clip_id", "frame_idx", "s", "m", "p", "q", "total_s") == sorted(want, key=repr)


def test_position_is_dense(series):
    df, pdf = series
    out = position(df, ["clip_id"], ["t"], "n")
    assert rows_of(out, "clip_id", "t", "n") == sorted(((r.clip_id, r.t, r.frame_idx) for r in pdf.itertuples()), key=repr)


def test_exact_quantiles(series):
    df, pdf = series
    out = {r.clip_id: r for r in exact_quantiles(df, ["clip_id"], "luminance", {"a": 0.95, "b": 0.5, "c": 0.1}).collect()}
    for k, g in pdf.groupby("clip_id"):
        assert [out[k].a, out[k].b, out[k].c] == pytest.approx(list(np.percentile(g["luminance"], [95, 50, 10])))
    one = exact_quantiles(df, [], "luminance", {"a": 0.75}).first()
    assert one.a == pytest.approx(np.percentile(pdf["luminance"], 75)) and one.n_measured == len(pdf)


@pytest.mark.parametrize(
    "op",
    [
        lambda f, c: sq.motion_variance(f, chunk=c), lambda f, c: sq.flicker(f, chunk=c), lambda f, c: sq.timeline_segments(f, chunk=c), lambda f, c: sq.frame_cadence(f, chunk=c),
        lambda f, c: sq.combing(f, chunk=c), lambda f, c: sq.hum_trace(f, chunk=c), lambda f, c: sq.stream_page_continuity(f, chunk=c),
    ],
)
def test_small_chunks_change_nothing(series, op):
    df, _ = series
    f = df.withColumns(
        {
            "gray_variance": F.when(C("frame_idx") % 4 == 1, 0.0).otherwise(9.0), "row_diff": C("luminance"), "two_row_diff": C("luminance") + 1, "hz": C("luminance") / 100, "snr": F.lit(9.0),
            "page": C("frame_idx"), "serial": C("frame_idx") % 2, "seq": F.expr("frame_idx div 2"), "granule": C("t"), "crc_ok": F.lit(True),
        }
    )

    def rounded(df):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_of(df)]

    assert rounded(op(f, 2)) == rounded(op(f, 10_000))


def test_covered_seconds(spark):
    spans = [(1, "a", 0.0, 2.0), (1, "a", 1.0, 3.0), (1, "a", 5.0, 6.0), (1, "a", 5.5, 5.6), (1, "b", 0.0, 1.0)]
    got = rows_of(sq.covered_seconds(spark.createDataFrame(spans, "clip_id long, label string, start_s double, end_s double")))
    assert got == [(1, "a", 4.0), (1, "b", 1.0)]


@pytest.mark.parametrize("chunk", [3, 17, 65_536])
@pytest.mark.parametrize("limit", [900, 100_000])
def test_admit_batch_in_chunks(spark, chunk, limit):
    """Sizes that leave ever less room, batches that hold something already, and chunks in which all or none are taken."""
    rng = random.Random(3)
    rows = [(i % 3 if i < 60 else 0, i, rng.choice([rng.randint(1, 60), rng.randint(1, 60), 1, 0, None, -5])) for i in range(400)]
    held = {1: 850, 2: 5_000}
    files = spark.createDataFrame(rows, "batch int, pos long, size_bytes long")
    before = spark.createDataFrame([(1, 800), (1, 50), (2, 5_000), (9, 1)], "batch int, bytes long")
    used, want = {0: 0, **held}, []
    for b, p, s in rows:
        ok = s is not None and 0 <= s <= 50 and used[b] + s <= limit
        used[b] += s if ok else 0
        want.append((b, p, s, ok))
    assert rows_of(idn.admit_batch(files, 50, limit, before, chunk=chunk)) == sorted(want, key=repr)
    assert idn.admit_batch(files.where("false"), 50, limit, chunk=chunk).count() == 0


def test_reuse_in_chunks(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(0, 0.003, (60, 48)), axis=0)
    t = spark.createDataFrame([(0 if i < 50 else 1, i, [float(v) for v in x[i]]) for i in range(60)], "clip_id int, frame_idx long, thumb array<double>")
    a, b = vc.reuse_static_frames(t, 6, 8), vc.reuse_static_frames(t, 6, 8, chunk=7)
    assert rows_of(a) == rows_of(b) and 1 < a.select("assessed_at").distinct().count() < 60


def make_boxes(spark, n=120):
    rng = random.Random(11)
    rows = [(0 if i % 4 else 1, i, float(rng.randint(0, 300)), float(rng.randint(0, 300)), float(rng.randint(20, 200)), float(rng.randint(20, 200)), rng.choice([0.5, 0.7, 0.9])) for i in range(n)]
    return spark.createDataFrame(rows, "image_id int, box_id long, x double, y double, w double, h double, score double"), rows


def iou(a, b):
    iw, ih = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return 0.0 if iw <= 0 or ih <= 0 else iw * ih / (a[4] * a[5] + b[4] * b[5] - iw * ih)


def test_overlaps_and_suppression(spark):
    df, rows = make_boxes(spark)
    pairs = {(r.a_box_id, r.b_box_id): r.iou for r in bx.iou_join(df, df).collect()}
    want = {(a[1], b[1]): iou(a, b) for a in rows for b in rows if a[0] == b[0] and iou(a, b) > 0}
    assert set(pairs) == set(want) and all(pairs[k] == pytest.approx(want[k]) for k in want)
    kept = []
    for b in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(b[0] != k[0] or iou(b, k) < 0.40 for k in kept):
            kept.append(b)
    want_kept = sorted(((k[0], k[1]) for k in kept), key=repr)
    assert rows_of(bx.nms(df)) == want_kept


def test_suppression_with_odd_scores(spark):
    """Equal boxes: a missing or NaN score is weakest, ties go to the lower id, whatever the number of boxes."""
    for copies in (1, 40):
        rows = [(i, b, 0.0, 0.0, 10.0, 10.0, s) for i in range(copies) for b, s in ((1, None), (2, 0.9), (3, float("nan")), (4, 0.9))] + [(99, 7, 0.0, 0.0, 1.0, 1.0, None)]
        df = spark.createDataFrame(rows, "image_id int, box_id long, x double, y double, w double, h double, score double")
        assert rows_of(bx.nms(df)) == sorted([(i, 2) for i in range(copies)] + [(99, 7)], key=repr)


def test_reuse_with_odd_pictures(spark):
    nan, flat, other = [float("nan")] * 48, [0.5] * 48, [0.9] * 48
    thumbs = [flat, nan, flat, None, flat, other, other, nan, flat]
    t = spark.createDataFrame([(0, i, v) for i, v in enumerate(thumbs)], "clip_id int, frame_idx long, thumb array<double>")
    want = [0, 0, 0, 3, 4, 5, 5, 5, 8]
    for chunk in (1, 2, 100):
        assert [r.assessed_at for r in vc.reuse_static_frames(t, 6, 8, chunk=chunk).orderBy("frame_idx").collect()] == want


def test_admit_with_unknown_sizes(spark):
    files = spark.createDataFrame([(0, i, None if i == 1 else 10) for i in range(6)], "batch int, pos long, size_bytes long")
    for chunk in (2, 100):
        assert [r.admitted for r in idn.admit_batch(files, 50, 30, chunk=chunk).orderBy("pos").collect()] == [True, False, True, True, False, False]


def test_pairs_by_rounds(spark):
    df, rows = make_boxes(spark)
    faces, persons = df.where("box_id % 2 = 0").withColumns({"w": C("w") / 4, "h": C("h") / 4}), df.where("box_id % 2 = 1")
    plain = bx.pair_faces_persons(faces, persons)
    taken, want = set(), []
    f = sorted((r for r in rows if r[1] % 2 == 0), key=lambda r: (-(r[4] / 4) * (r[5] / 4), r[1]))
    for r in f:
        cx, cy = r[2] + r[4] / 8, r[3] + r[5] / 8
        own = [p for p in rows if p[1] % 2 and p[0] == r[0] and p[1] not in taken and p[2] <= cx <= p[2] + p[4] and p[3] <= cy <= p[3] + p[5]]
        best = min(own, key=lambda p: (p[4] * p[5], p[1]), default=None)
        want.append((r[0], r[1], best and best[1]))
        taken |= {best[1]} if best else set()
    want += [(p[0], None, p[1]) for p in rows if p[1] % 2 and p[1] not in taken]
    assert rows_of(plain) == sorted(want, key=repr)


def test_same_person_in_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 8))
    rows = []
    for i in range(90):
        v = centres[rng.integers(9)] + rng.normal(0, 0.5, 8)
        rows.append((0 if i < 70 else 1, i, None if i % 17 == 3 else [float(x) for x in v / np.linalg.norm(v)]))
    df = spark.createDataFrame(rows, "album int, pos long, embedding array<double>")
    firsts, want = {0: [], 1: []}, []
    for album, pos, v in rows:
        if v is None:
            want.append((album, pos, -1))
            continue
        sims = [float(np.dot(v, f)) for f in firsts[album]]
        if sims and max(sims) >= 0.7:
            want.append((album, pos, int(np.argmax(sims))))
        else:
            firsts[album].append(v)
            want.append((album, pos, len(firsts[album]) - 1))
    assert rows_of(vc.group_same_person(df, 0.7)) == sorted(want, key=repr)
    assert rows_of(vc.group_same_person(df, 0.7, block=4, most=8, piece=16)) == sorted(want, key=repr)
    assert vc.group_same_person(df.where("false"), 0.7).count() == 0


def test_same_person_on_ties_and_at_the_threshold(spark):
    """Cosines of exactly the threshold, equal faces, and a face as near to two first members: the earlier one."""
    e = lambda *v: [float(x) for x in v]
    rows = [(0, 1, e(1, 0, 0)), (0, 2, e(0, 1, 0)), (0, 3, e(0.6, 0.8, 0)), (0, 4, e(1, 0, 0)), (0, 5, e(0, 0, 1)), (0, 6, e(0.5, 0.5, 0.7071)), (0, 7, e(0.8, 0.6, 0)), (0, 9, None)]
    df = spark.createDataFrame(rows, "album int, pos long, embedding array<double>")
    for block in (1, 2, 100):
        got = {r.pos: r.group_no for r in vc.group_same_person(df, 0.8, block=block, most=block, piece=2).collect()}
        assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 2, 6: 3, 7: 0, 9: -1}
    got = {r.pos: r.group_no for r in vc.group_same_person(df.where("pos <> 3"), 0.5, block=2).collect()}
    assert got[6] == 2 and vc.nearest_first(pd.DataFrame({"album": [0], "pos": [9], "embedding": [np.array([0.6, 0.6])]}), pd.DataFrame({"pos": [3, 2], "embedding": [np.array([1.0, 0]), np.array([0, 1.0])]}), 0.5).leader.tolist() == [2]


def test_an_album_of_unlike_faces(spark, tmp_path, monkeypatch):
    """20,000 faces, each its own group: what is written stays in proportion to the faces."""
    folders = []
    monkeypatch.setattr(vc, "shared_folder", lambda s, tag: folders.append(str(tmp_path / tag)) or folders[-1])
    n, d = 20_000, 32
    rows = spark.range(n).select(F.lit(0).alias("album"), C("id").alias("pos"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.hash("id", i) / 2147483648.0).alias("x"))
    df = rows.select("album", "pos", F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y))).alias("embedding"))
    got = vc.group_same_person(df, 0.999)
    assert got.where("group_no <> pos").count() == 0 and got.count() == n
    size = sum(p.stat().st_size for f in folders for p in pathlib.Path(f).rglob("*.parquet"))
    assert size < 1.5 * n * d * 8


def test_vocabulary_in_blocks(spark):
    rng = np.random.default_rng(3)
    words = rng.normal(size=(23, 6))
    words[5] = words[4]  # a tie
    vocabulary = spark.createDataFrame([(f"w{k:02d}", [float(c) for c in w]) for k, w in enumerate(words)] + [(None, [0.0] * 6), ("x", None)], "label string, embedding array<double>")
    x = rng.normal(size=(40, 6))
    x[7], x[8] = x[6], words[4] * 2
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    logits = 3.0 * x @ words.T
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for block in (5, 1, 23, 4_096):
        got = {r.id: r.labels for r in vc.zero_shot_classify(df, "v", vocabulary, 3.0, block=block).collect()}
        assert len(got) == 41 and got[99] is None
        for i, row in enumerate(p):
            best = np.sort(row)[::-1][:3].tolist()
            assert [w.probability for w in got[i]] == pytest.approx(best) == [row[int(w.label[1:])] for w in got[i]] and len({w.label for w in got[i]}) == 3
    assert {len(r.labels) for r in vc.zero_shot_classify(df.where("id < 99"), "v", vocabulary.where("false"), 3.0).collect()} == {0}


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("k,r", [(2, 3), (6, 2), (8, 2)])
@pytest.mark.parametrize("hot", [1, 10_000])
def test_hamming_pairs_are_exact(spark, k, r, hot):
    rng = random.Random(k)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = set()
    for b in base:
        for _ in range(12):
            h = b
            for bit in rng.sample(range(64), rng.randint(0, k + 2)):
                h ^= 1 << bit
            values.add(h)
    values |= {1 << i for i in range(0, 64, 5)}  # few set bits: every band is crowded
    df = spark.createDataFrame([(signed(v),) for v in values for _ in range(2)], "hash long")
    want = sorted((*sorted((signed(a), signed(b))), bin(a ^ b).count("1")) for a in values for b in values if signed(a) < signed(b) and bin(a ^ b).count("1") <= k)
    assert rows_of(hm.hamming_pairs(df, None, k, r, hot=hot)) == sorted(want, key=repr)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(rows_of(hm.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def plain_ber(q, r):
    """Lowest error rate over all offsets with enough overlap; None above 0.30."""
    need, best = min(100, len(q), len(r)), 1.0
    for off in range(-len(q), len(r) + 1) if need >= 20 else []:
        a, b = q[max(0, -off) :], r[max(0, off) :]
        n = min(len(a), len(b))
        if n >= need:
            best = min(best, sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a[:n], b[:n])) / (32 * n))
    return best if best <= 0.30 else None


def recording_table(spark, recordings, key):
    return spark.createDataFrame([(k, i, int(v)) for k, x in recordings.items() for i, v in enumerate(x)], f"{key} long, idx long, bits long")


@pytest.mark.parametrize("piece,tile", [(1_024, (512, 2_048)), (32, (2, 3)), (64, (512, 4))])
def test_audio_matches_at_all_offsets(spark, piece, tile):
    rng = np.random.default_rng(9)
    noise = lambda n: rng.integers(0, 1 << 32, n)
    base, flat = noise(150), np.zeros(140, int)
    queries = {1: base, 2: base[:10], 3: noise(70), 4: flat, 5: base, 6: noise(25), 8: noise(19)}
    refs = {7: np.concatenate([noise(20), base[10:140] ^ 5]), 8: noise(130), 9: queries[3][5:60] ^ 0x00FF0000, 10: flat[:60], 11: queries[6], 12: base[90:], 13: noise(19), 14: refs_far(base)}
    want = sorted((i, j, plain_ber(q, r)) for i, q in queries.items() for j, r in refs.items() if plain_ber(q, r) is not None)
    got = rows_of(ru.audio_fingerprint_match(recording_table(spark, queries, "query_id"), recording_table(spark, refs, "ref_id"), piece, tile))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    assert {(1, 7), (5, 7), (3, 9), (4, 10), (6, 11)} <= {g[:2] for g in got}


def refs_far(base):
    """``base`` with about 28 % of the bits turned, evenly."""
    return base ^ 0x01249249


def test_unlike_recordings_cost_no_rows(spark):
    """1,000 references that match nothing add nothing to what leaves the tiles, also where the query has several pieces."""
    rng = np.random.default_rng(4)
    queries = {1: rng.integers(0, 1 << 32, 90), 2: rng.integers(0, 1 << 32, 40)}
    refs = {9: queries[1][10:80]} | {100 + k: rng.integers(0, 1 << 32, 40) for k in range(1_000)}
    q = recording_table(spark, queries, "query_id")
    for piece in (1_024, 64):
        got = ru.audio_fingerprint_match(q, recording_table(spark, refs, "ref_id"), piece)
        assert rows_of(got) == [(1, 9, 0.0)]
    left = ru.bit_planes([queries[1][:64]], np.zeros(1, int), 128)
    windows = [x[:64] for x in list(refs.values())[1:]]
    first, last = np.zeros(1_000, int), np.array([len(w) for w in windows])
    frames = ru.overlaps(np.array([64]), first, last, 64)
    errors = ru.offset_errors(left, ru.bit_planes(windows, first, 128), frames, 64)
    assert errors[0, 3, 0] == sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(queries[1], windows[3])) and (errors >= 0).all() and (errors <= 32 * frames).all()


def test_video_match_by_rare_frames(spark):
    """Black frames in every clip and reference, close hashes, and sizes at the borders of the rule."""
    rng = random.Random(8)
    far = lambda: rng.getrandbits(63)
    near = lambda h: h ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62))
    black = 0
    clips = {k: [black] * (k % 5) + [far() for _ in range(1 + k % 7)] for k in range(60)}
    refs = {k: [black, black ^ 3] + [near(h) for h in clips[k % 60] if h][: 1 + k % 6] + [far()] for k in range(90)}
    clips[99] = [black] * 12
    bits = lambda a, b: bin(a ^ b).count("1")
    want = []
    for c, frames in clips.items():
        for r, hashes in refs.items():
            hit = sum(any(bits(f, h) <= 8 for h in hashes) for f in frames)
            if len(frames) >= 4 and hit >= 4 and hit * 2 >= len(frames):
                want.append((c, r, hit))
    q = spark.createDataFrame([(c, i, h) for c, fs in clips.items() for i, h in enumerate(fs)], "clip_id long, frame_idx long, hash long")
    ix = spark.createDataFrame([(r, h) for r, hs in refs.items() for h in hs], "ref_id long, hash long")
    assert rows_of(ru.video_fingerprint_match(q, ix)) == sorted(want) and any(c != 99 for c, _, _ in want)
    got = {r.clip_id: r for r in ru.video_findings(q.unionByName(spark.createDataFrame([(200, 0, None)], q.schema)), ix).collect()}
    firsts = {c: (sum(w[0] == c for w in want), min((w[1:] for w in want if w[0] == c), default=(None, None))) for c in clips}
    assert {c: (r.matches, (r.first_ref, r.frames_matched)) for c, r in got.items() if c != 200} == firsts
    assert {c for c, r in got.items() if r.status == "NOT_APPLICABLE"} == {200, *(c for c, f in clips.items() if len(f) < 4)}
    none = ru.video_findings(q, ix.where("false")).collect()
    assert {(r.status, r.note) for r in none} == {("INFO", "no reference index"), ("NOT_APPLICABLE", "too short to fingerprint")}


def test_calibration_in_chunks_equals_step_by_step(spark):
    rng = random.Random(4)
    rows = [(f"{i % 90}", rng.choice(["AI", "real ", "not sure"]), i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "sha256 string, user_label string, ts long, noise double, smooth double")
    seen, w, ws, on, os_, n = set(), 0.35, 0.30, 0.0, 0.0, 0
    for sha, label, _, noise, smooth in rows:
        label = label.strip().upper()
        if label not in ("AI", "REAL") or (sha, label) in seen:
            continue
        seen.add((sha, label))
        d = lambda s: s / (1 + n / 10) ** 2
        if label == "AI":
            if noise < 2.5:
                w, on = min(0.60, w + d(0.02)), max(-0.40, on - d(0.03))
            if smooth < 3.0:
                ws, os_ = min(0.55, ws + d(0.02)), min(0.40, os_ + d(0.03))
        else:
            if noise < 2.0:
                on = min(0.35, on + d(0.03))
            if smooth < 2.0:
                os_ = max(-0.35, os_ - d(0.03))
        n += 1
    want = {"noise_residual": w, "surface_smoothness": ws, "noise_center_offset": on, "smooth_center_offset": os_}
    for chunk in (7, 10_000):
        got = {r.key: (r.value, r.samples) for r in fb.calibrate(df, "image", ["ts"], chunk=chunk).collect()}
        assert {k: v[0] for k, v in got.items()} == pytest.approx(want, abs=1e-9) and {v[1] for v in got.values()} == {n}


def test_ood_gate_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [float("nan")] * 5), (901, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    stats = vc.ood_fit(df.where("id < 901"), "v")
    cov = np.cov(x.T)
    inv = np.linalg.pinv(cov + 1e-3 * (np.trace(cov) / 5 + 1e-12) * np.eye(5))
    c = x - x.mean(axis=0)
    d = np.sqrt(np.einsum("ij,jk,ik->i", c, inv, c))
    assert stats["n"] == 200 and stats["threshold"] == pytest.approx(np.percentile(d, 99))
    got = {r.id: r for r in vc.ood_score(df, "v", stats).collect()}
    assert [got[i].distance for i in range(200)] == pytest.approx(list(d))
    assert got[900].ood_status == got[901].ood_status == "NOT_CALIBRATED"
    assert vc.ood_fit(df.where("id < 19"), "v") is None
    assert {r.ood_status for r in vc.ood_score(df, "v", None).collect()} == {"NOT_CALIBRATED"}


def test_moments_budget(spark):
    changes = [float(i) * 0.3 for i in range(100)]
    df = spark.createDataFrame([(1, 0.0, 30.0, 31.0, changes), (2, 0.0, 2.0, 2.5, [])], "clip_id int, first_t double, last_t double, duration_s double, changes array<double>")
    got = vc.choose_moments(df, 60).collect()
    one, two = sorted(r.t for r in got if r.clip_id == 1), sorted(r.t for r in got if r.clip_id == 2)
    assert len(one) <= 60 and all(b - a >= 0.4 - 1e-9 for a, b in zip(one, one[1:])) and two == [0.0, 0.5, 1.5, 2.0]


def test_truth_from_many_fragments(spark):
    """10,000 fragments, short and empty ones, both slashes, and two that fit: the first by position."""
    paths = [(i, f"C:\\media\\set{i % 13}\\file{i}.jpg" if i % 2 else f"/media/set{i % 13}/file{i}.png") for i in range(300)] + [(900, None), (901, "")]
    fragments = [(k, f"/file{k}.", "ai" if k % 2 else "real") for k in range(0, 10_000, 3)] + [(20_000, "set7/", "ai"), (20_001, "\\set1", "real"), (20_002, "png", "ai"), (20_003, "zzzz", "real"), (20_004, None, "ai")]
    media = spark.createDataFrame(paths, "id long, path string")
    truth = spark.createDataFrame(fragments, "position long, fragment string, label string")

    def plain(rows, path):
        path = path and path.replace("\\", "/")
        return None if path is None else next((v for _, f, v in sorted(rows, key=lambda r: r[0]) if f is not None and f.replace("\\", "/") in path), None)

    out = tr.label_by_fragment(media, "path", truth)
    assert {r.id: r.truth for r in out.collect()} == {i: plain(fragments, p) for i, p in paths} and out.columns == ["id", "path", "truth"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    every = fragments + [(30_000, "", "any")]
    got = tr.label_by_fragment(media, "path", spark.createDataFrame(every, truth.schema)).collect()
    assert {r.id: r.truth for r in got} == {i: plain(every, p) for i, p in paths}
    assert tr.label_by_fragment(media, "path", truth.where("false")).where("truth IS NOT NULL").count() == 0
