"""Line fields, ball codes and hard negatives against brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

from candorframe.llm import ballcodes, lines, negatives

# --- line field ------------------------------------------------------------------------------------------------------------------------------


def test_decoding_is_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    field = lines.Field(rng.standard_normal((4, 2)), rng.standard_normal((2, 2)))
    lengths = np.array([3, 1, 6, 0, 6, 2])
    x = rng.standard_normal((lengths.sum(), 4))
    got, at = field.states(x, lengths), 0
    for n in lengths:
        score = x[at : at + n] @ field.weights
        worth = {s: sum(score[i, k] for i, k in enumerate(s)) + sum(field.step[a, b] for a, b in zip(s, s[1:])) for s in itertools.product((0, 1), repeat=n)}
        assert tuple(got[at : at + n]) == max(worth, key=worth.get)
        at += n


def test_likelihood_and_gradient():
    rng = np.random.default_rng(2)
    lengths = np.array([2, 5, 1])
    x, gold = rng.standard_normal((8, 3)), rng.integers(0, 2, 8)
    w, s = rng.standard_normal((3, 2)), rng.standard_normal((2, 2))
    value, dw, ds = lines.Field(w, s).likelihood(x, lengths, gold)
    want, at = 0.0, 0
    for n in lengths:
        score = x[at : at + n] @ w
        worth = lambda q: sum(score[i, k] for i, k in enumerate(q)) + sum(s[a, b] for a, b in zip(q, q[1:]))  # noqa: E731, B023
        want += worth(gold[at : at + n]) - np.log(sum(np.exp(worth(q)) for q in itertools.product((0, 1), repeat=int(n))))
        at += n
    assert abs(value - want) < 1e-9
    for part, slope in ((w, dw), (s, ds)):
        for i in np.ndindex(part.shape):
            part[i] += 1e-6
            up = lines.Field(w, s).likelihood(x, lengths, gold)[0]
            part[i] -= 1e-6
            assert abs((up - value) / 1e-6 - slope[i]) < 1e-4


def test_ascent():
    a = np.diag([1.0, 10.0, 100.0])
    top = np.array([3.0, -1.0, 0.5])
    got = lines.ascend(lambda x: (-((x - top) @ a @ (x - top)) / 2, -a @ (x - top)), np.zeros(3), 60)
    assert np.abs(got - top).max() < 1e-2


def plain_base(text):
    t = text or ""
    ws, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {i + k for i in range(len(ws) - 7) if count[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(ws) < 20 or 100 * len(hit) > 30 * len(ws)


PROSE = "The quiet river runs below the old stone bridge and carries leaves of many trees to the distant sea."
JUNK = ["Home | News | Shop | Login | Help", "BUY!! NOW!! CHEAP!! SALE!!", "x### y### z### w###", "menu menu menu menu menu menu"]


def web(n):
    """Good texts of prose lines, low ones of junk and one prose line."""
    rows, labels = [], []
    for i in range(n):
        low = i % 3 == 0
        body = [" ".join(w[:-1] + "abcd"[k] + w[-1] for w in PROSE.split()) + f" {i}." for k in range(4)]
        if low:
            body = [f"{i} " + JUNK[(i + k) % 4] for k in range(6)] + body[:1]
        rows.append((100 + i, "\n".join(body)))
        labels.append((100 + i, 0 if low else 1, 0))
    return rows, labels


def test_line_field_on_texts(spark, odd, nothing):
    rows, labels = web(60)
    known = spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (1, None, None), (103, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    mixed = "\n".join([JUNK[0], JUNK[1], "", JUNK[3], *(PROSE.replace("old", f"old{k}") for k in range(5))])
    field = lines.fit(docs, known)
    extra = spark.createDataFrame([(900, mixed)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.label_lines(docs.unionByName(extra), field).collect()}
    assert got[900].content == [False] * 3 + [True] * 5
    assert got[900].content_chars == sum(len(PROSE.replace("old", f"old{k}").replace(" ", "")) for k in range(5))
    text = lines.content_only(extra, field).first().text
    assert text == "\n".join(["", *(PROSE.replace("old", f"old{k}") for k in range(5))])
    kept = {r.doc_id: r.kept for r in lines.judge(docs, known).collect()}
    assert all(kept[i] == (q == 1) for i, q, _ in labels)
    out = lines.judge(odd, known).collect()
    assert len(out) == odd.count() and lines.judge(nothing, known).count() == 0 and lines.judge(nothing, known.where("false")).count() == 0
    texts = collections.Counter((r.doc_id, *plain_base(r.text)) for r in odd.select("doc_id", "text").collect())
    assert texts == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert not any(r.kept for r in out if r.base_failed)
    clash = lines.label_lines(odd.withColumn("content", odd.text).withColumn("n_words", odd.text), field)
    assert clash.count() == odd.count() and len(set(clash.columns)) == len(clash.columns)
    assert lines.content_only(odd, field).where("doc_id = 1").first().text is None and lines.content_only(odd, field).columns == odd.columns
    free = lines.judge(docs, known.where("false")).collect()
    assert len(free) == len(rows) and all(r.kept != r.base_failed and all(r.content) for r in free)


def test_base_columns_of_random_texts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        t = "".join(rng.choice(list("ab \n\t#é|日 "), rng.integers(0, 120)))
        b = t.encode()
        x, chars, dup = lines.text_lines(b)
        h = lines.WordHash().of(b.split())
        assert (len(h), int(chars.sum()), dup, lines.repeat_words(h)) == tuple(plain_base(t)[k] for k in (0, 1, 3, 4)) and len(x) == len(chars)


def test_a_very_long_text():
    x, chars, _ = lines.text_lines(b"one two three four.\n" * 60_000)
    assert len(lines.Field(np.ones((lines.FEATURES, 2)), np.eye(2)).states(x.astype(float), np.array([len(x)]))) == 60_000 == len(chars)


# --- vectors ---------------------------------------------------------------------------------------------------------------------------------

ODD = [(1_000, None, 1), (1_001, [], 1), (1_003, [float("nan")] * 16, 1), (1_004, [1.0] * 3, 2), (1_005, [None] * 16, 3), (1_006, [float("inf")] + [1.0] * 15, 3)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 7, "c") for i, v, y in rows], "vec_id bigint, embedding array<float>, label int, home int, code string")


def some_vectors(seed, groups=5, each=40, dim=16, spread=0.3):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((groups, dim)), each, axis=0) + spread * rng.standard_normal((groups * each, dim))
    order = rng.permutation(len(x))
    return [(int(n), x[k].astype(np.float32).tolist(), int(k % 4)) for n, k in enumerate(order)]


def plain_codes(rows, entries=16, rounds=6, parts=8):
    x = np.array([[int(np.floor(4096 * np.float64(np.float32(c)))) for c in v] for _, v, _ in rows], dtype=object).reshape(len(rows), parts, -1)
    by_id = {}
    for n, (i, _, _) in enumerate(rows):
        if i not in by_id or x[n].ravel().tolist() < x[by_id[i]].ravel().tolist():
            by_id[i] = n
    first = [by_id[i] for i in sorted(by_id, key=lambda i: (i is None, i))[:entries]]
    books = [[x[n, p].tolist() for n in first] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for turn in range(rounds + 1):
        got = [[nearest(p, x[n, p]) for p in range(parts)] for n in range(len(rows))]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(first)):
                    own = [x[n, p] for n in range(len(rows)) if got[n][p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    sums = collections.Counter()
    for (_, _, y), g in zip(rows, got):
        sums[y] += sum(d for d, _ in g)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), sums[y], digest) for (i, _, y), g in zip(rows, got))


@pytest.mark.parametrize("seed", [1, 2])
def test_ball_codes(spark, seed):
    rows = some_vectors(seed)
    rows += [(3, rows[3][1], None), (5, rows[7][1], None), (None, rows[9][1], 2), *[(400 + k, rows[2][1], 1) for k in range(150)], (700, [0.0] * 16, 0)]
    rows[1] = (1, rows[0][1], 0)  # an entry that no part ever takes at first
    got = ballcodes.compress(table(spark, rows + ODD)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_ball_codes_of_few_and_odd(spark):
    few = [(4, [0.5] * 10, 1), (2, [-0.25] * 10, 1)]
    got = ballcodes.compress(table(spark, few)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(2, "00" * 8, 0), (4, "01" * 5 + "00" * 3, 0)]
    assert ballcodes.compress(table(spark, ODD[:3])).count() == 0 and ballcodes.compress(table(spark, few).where("false")).count() == 0
    big = ballcodes.compress(table(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 2)])).collect()
    assert len(big) == 3 and all(r.error == 0 for r in big)


def test_balls_save_work(spark):
    """Clustered vectors: after the first round nearly all parts lie in stable cores or thin rings."""
    rows = some_vectors(3, groups=16, each=60, spread=0.05)
    vectors = ballcodes.finite_rows(table(spark, rows), 16)
    _, _, works = ballcodes.learn(vectors, 16)
    assert len(works) == 6 and works[-1] < 0.6 * len(rows) * 8 * 16
    rng = np.random.default_rng(0)
    books = rng.integers(-99, 99, (8, 16, 4))
    x, home = rng.integers(-99, 99, (500, 8, 4)), rng.integers(0, 16, (500, 8)).astype(np.uint8)
    code, best, own, work = ballcodes.assign(x, home, ballcodes.balls(books, None))
    all_d = ((x[:, :, None] - books) ** 2).sum(axis=3)
    assert (code == all_d.argmin(axis=2)).all() and (best == all_d.min(axis=2)).all() and work < all_d.size
    assert (own == np.take_along_axis(all_d, home[:, :, None].astype(int), 2)[:, :, 0]).all()


def plain_negatives(rows, mod, positives=5, negatives=3):
    seen = {(i, y, tuple(np.floor(256 * np.float64(np.array(v, np.float32))).astype(int).tolist())) for i, v, y in rows if y is not None and i is not None}
    out = []
    for a, la, va in seen:
        if a % mod:
            continue
        score = [(-sum(p * q for p, q in zip(va, v)), i, y) for i, y, v in seen if i != a]
        best = sorted(s for s in score if s[2] == la)[:positives]
        rest = sorted(s for s in score if s[2] != la)
        for s, i, _ in best:
            fit = [(t, j) for t, j, _ in rest if 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(16_384, 16_384, 1_024), (20, 9, 3)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, size in zip(("FIRST", "ROW_BLOCK", "ANCHOR_BLOCK"), sizes):
        monkeypatch.setattr(negatives, name, size)
    rows = some_vectors(4, groups=6, each=60)
    rows += [(2_000 + k, rows[0][1], rows[0][2]) for k in range(30)] + [(3_000 + k, rows[0][1], 3 - rows[0][2]) for k in range(30)]
    rows += [(10, [0.0] * 16, 1), (20, rows[5][1], 2), rows[4], rows[4], (5_000, rows[4][1], None), (None, rows[4][1], 1), (7_001, rows[6][1], 99), (7_010, rows[6][1], 98)]
    got = negatives.mine(table(spark, rows + ODD), "vec_id % 10 = 0").collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, 10)
    assert got and negatives.mine(table(spark, ODD), "vec_id % 10 = 0").count() == 0


def test_hard_negatives_of_few(spark):
    rows = [(50, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.5, 1.0], 2), (3, [-1.0, 0.0], 2)]
    assert negatives.mine(table(spark, rows), "vec_id % 50 = 0").collect() == [(50, 1, 1, 2, 131_072, 98_304)]
    assert negatives.mine(table(spark, rows), "vec_id = 77").count() == 0 and negatives.mine(table(spark, rows).where("false"), "vec_id % 50 = 0").count() == 0


def test_lists_bound_every_member():
    rng = np.random.default_rng(6)
    v = rng.integers(-300, 300, (400, 8)).astype(np.int32)
    u = rng.integers(-300, 300, (90, 8)).astype(np.int32)
    c = negatives.centres(u, 5)
    norm, length = np.sqrt((v.astype(float) ** 2).sum(axis=1)), np.sqrt((u.astype(float) ** 2).sum(axis=1))
    t = negatives._angles(u.astype(float), length, c)
    of = t.argmin(axis=1)
    widest = np.array([t[of == k, k].max(initial=0) for k in range(5)])
    cap = negatives.bounds(v.astype(float), norm, c, widest)[:, of] * length
    assert (cap >= (v.astype(float) @ u.T)).all()
