"""Archives by round trip, URL templates by cases, vectors by brute force."""

import collections
import gzip
import hashlib
import json
import os
import re

import numpy as np
import pytest

from candorframe.llm import multiindex, onebit, queries, urltree, warc

BIG = "<p>" + "x" * 2_000 + "</p>"
PAGES = [
    (1, "http://a.org/1", BIG), (5, "http://a.org/5\r\nX: y", BIG), (3, None, BIG), (2, "http://b.org/é", "small"), (4, "http://b.org/4", "small"),
    (6, "http://c.org/", None), (7, "http://c.org/7", ""), (None, "http://d.org/", BIG), (9, "http://d.org/9", "ü" * 600), (9, "http://d.org/9", "ü" * 600), (8, "u", "ü" * 600),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in PAGES], "page_id bigint, url string, html string, digest string, `_shard` int")


def plain_records(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, d in data:
        if len(d) >= 1000 and i is not None:
            first[d] = max(first.get(d, i), i)
    many = collections.Counter(d for _, d in data)
    out = []
    for i, d in data:
        revisit = many[d] > 1 and d in first and i != first[d]
        out.append((str(i), len(d), hashlib.sha1(d).hexdigest(), "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,file", [(1 << 20, 1 << 20), (2_000, 700)])
def test_archives_round_trip(spark, pages, tmp_path, shard, file):
    folder = f"file://{tmp_path}/a"
    warc.write_archives(pages, folder, shard_bytes=shard, file_bytes=file)
    got = warc.read_archives(spark, folder, payload=True).collect()
    assert sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain_records(PAGES)
    assert sorted(r.payload for r in got if r.payload is not None and r.page_id == 9) == [("ü" * 600).encode()] * 2
    manifest = [json.loads(line) for line in open(tmp_path / "a" / "manifest.jsonl")]
    assert sorted(m["file"] for m in manifest) == sorted(n for n in os.listdir(tmp_path / "a") if n.endswith(".warc.gz"))
    for m in manifest:
        data = (tmp_path / "a" / m["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == m["sha256"] and len(data) == m["bytes"] and gzip.decompress(data).count(b"WARC/1.1\r\n") == m["records"]
    spans = sorted((m["shard"], m["file"], m["first_page"] or 0, m["last_page"] or 0) for m in manifest)
    assert all(a[3] <= b[2] for a, b in zip(spans, spans[1:]))


def test_archives_are_the_same_whatever_the_partitions(pages, tmp_path):
    names = []
    for k, n in enumerate((1, 5)):
        warc.write_archives(pages.repartition(n), f"file://{tmp_path}/{k}", shard_bytes=3_000, file_bytes=900)
        names.append({f: (tmp_path / str(k) / f).read_bytes() for f in sorted(os.listdir(tmp_path / str(k))) if not f.startswith(".")})
    assert names[0] == names[1] and len(names[0]) > 3


def test_archives_of_nothing(spark, pages, tmp_path):
    warc.write_archives(pages.where("false"), f"file://{tmp_path}/n")
    assert warc.read_archives(spark, f"file://{tmp_path}/n").count() == 0


def test_damage_is_seen():
    raw = gzip.decompress(warc.record(1, "http://a", b"abc", hashlib.sha1(b"abc").hexdigest(), None))
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


URLS = [
    (1, "http://WWW.Example.NET/en/1?x"), (2, "https://example.net/en"), (3, "http://x.example.com/de/1"), (4, "http://example.org/fr/1#a"), (5, "http://example.org/es/1"),
    (6, None), (7, "no scheme/at all"), (8, "http://net/"), (9, "http://net"), (10, "http://notexample.net/en/"), (11, "http://a.org?q=://z"), (12, ""), (13, "ftp://u@h:1/a//b/"), (13, "ftp://u@h:1/a//b/"),
    (14, "http://deep.org/" + "/".join("abcdefghij")), (15, "http://q.org/a'b/" + "z" * 5_000),
]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(i, u, "clash", 3) for i, u in URLS], "page_id bigint, url string, host string, template int")


def no_labels(spark):
    return spark.createDataFrame([], "url string, good boolean")


def test_hosts_paths_and_rules(spark, urls):
    got = urltree.judge_pages(urls, no_labels(spark), queries.URL_RULES).collect()
    want = {
        1: ("www.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/en", "net/", "block"), 3: ("x.example.com", "/de/1", "example.com/de/", "block"),
        4: ("example.org", "/fr/1", "org/fr/", "allow"), 5: ("example.org", "/es/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("net", "/", "net/", "block"),
        9: ("net", "", None, "allow"), 10: ("notexample.net", "/en/", "net/", "block"), 11: ("a.org", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("u@h:1", "/a//b/", None, "allow"),
    }
    assert len(got) == len(URLS)
    for r in got:
        if r.page_id in want:
            assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], r
    assert urltree.judge_pages(urls.where("false"), no_labels(spark), queries.URL_RULES).count() == 0


def test_templates_merge_alike_and_part_unlike(spark):
    pages = [(n, f"http://h.org/{s}/{n}") for n, s in enumerate(["good", "fine", "spam"] * 100)]
    labelled = spark.createDataFrame([(u, "spam" not in u) for _, u in pages], "url string, good boolean")
    got = urltree.judge_pages(spark.createDataFrame(pages, "page_id bigint, url string"), labelled, queries.URL_RULES).collect()
    assert {(r.template, r.verdict) for r in got if "spam" in r.path} == {("/spam/<n>", "block")}
    assert {r.verdict for r in got if "spam" not in r.path} == {"allow"}
    alike = [(n, f"http://h.org/{s}/{n}") for n, s in enumerate(["a", "b", "c"] * 50)]
    got = urltree.judge_pages(spark.createDataFrame(alike, "page_id bigint, url string"), no_labels(spark), queries.URL_RULES).collect()
    assert {r.template for r in got} == {"/*/<n>"}


def plain_segments(path):
    def kind(s):
        ext = re.fullmatch(r"[0-9]+(\.[A-Za-z]+)", s)
        if re.fullmatch(r"[0-9]+", s):
            return "<n>"
        if ext:
            return "<n>" + ext[1]
        if len(s) >= 16 and re.fullmatch(r"[0-9a-fA-F-]+", s):
            return "<h>"
        return "<long>" if len(s) > 60 else "~" + s if s[:1] in ("<", "*", "~") and s else s

    return tuple(kind(s) for s in path.split("/")[1:])


def plain_tree(pages, labelled):
    """page_id to (template, purity, verdict): one dictionary a level, every branch against its pooled siblings."""

    def parts(url):
        m = re.match(r"[^:]*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    rows = collections.defaultdict(lambda: [0, 0, 0])
    for _, url in pages:
        host, path = parts(url)
        rows[host, plain_segments(path)][0] += 1
    for url, good in labelled:
        host, path = parts(url)
        at = rows[host, plain_segments(path)]
        at[0], at[1], at[2] = at[0] + 1, at[1] + good, at[2] + (not good)
    template = {key: "" for key in rows}
    for k in range(1, max(len(s) for _, s in rows) + 1):
        node = collections.defaultdict(lambda: np.zeros(5))
        for (host, segs), (n, g, b) in rows.items():
            if len(segs) >= k:
                node[host, template[host, segs], segs[k - 1]] += [n, g, b, n * (len(segs) == k), n * (len(segs) > k and segs[k].startswith("<"))]
        pool = collections.defaultdict(lambda: np.zeros(6))
        for (host, t, _), x in node.items():
            pool[host, t] += [*x, 1]
        merged = {}
        for (host, t, s), (n, g, b, e, v) in node.items():
            pn, pg, pb, pe, pv, kids = pool[host, t]
            like = kids > 1 and not s.startswith("<") and s != ""
            if like:
                p1, p2, p = (b + 1) / (g + b + 2), (pb - b + 1) / (pg - g + pb - b + 2), (pb + 2) / (pg + pb + 4)
                like = abs(p1 - p2) <= 1.96 * np.sqrt(p * (1 - p) * (1 / (g + b + 2) + 1 / (pg - g + pb - b + 2)))
                like = like and abs(e / n - (pe - e) / (pn - n)) <= 0.25 and abs(v / n - (pv - v) / (pn - n)) <= 0.25
            merged[host, t, s] = like
        template = {(h, s): t if len(s) < k else t + "/" + ("*" if merged[h, t, s[k - 1]] else s[k - 1]) for (h, s), t in template.items()}
    labels = collections.defaultdict(lambda: np.zeros(2))
    for key, (_, g, b) in rows.items():
        labels[key[0], template[key]] += [g, b]
    prior = (sum(g for _, g, _ in rows.values()) + 1) / (sum(g + b for _, g, b in rows.values()) + 2)
    out = {}
    for i, url in pages:
        host, path = parts(url)
        t = template[host, plain_segments(path)]
        g, b = labels[host, t]
        purity = (g + 10 * prior) / (g + b + 10)
        out[i] = (t, round(purity, 9), "block" if purity < 0.5 else "allow")
    return out


def test_tree_against_a_plain_one(spark):
    """Deep paths that part at the ninth segment, literal wildcards, keys, lone long paths and branches that merge."""
    rng = np.random.default_rng(12)
    deep = "/".join("acdefghi")
    urls = [f"http://h.org/{deep}/{'good' if n % 2 else 'spam'}/{n}" for n in range(160)]
    urls += [f"http://h.org/x/{rng.choice(['*', '<n>', '~', 'p', 'q'])}/{n}" for n in range(120)]
    urls += [f"http://w{n % 3}.org/{rng.choice(['a', 'b', 'c', 'd'])}/{rng.choice(['', 'e', '0a1b2c3d4e5f60718', 'f.html'])}{'/' + str(n) if n % 4 else ''}" for n in range(400)]
    urls += ["http://lone.org/" + "/".join(f"s{k}" for k in range(300)), "http://lone.org/s0/" + "z" * 70, "no url", None, "http://lone.org//"]
    pages = list(enumerate(urls))
    labelled = [(u, "spam" not in u and "/b/" not in u and "/*/" not in u) for u in urls[:600] for _ in range(1 + len(u) % 2)]
    got = urltree.judge_pages(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labelled, "url string, good boolean"), queries.URL_RULES)
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in got.collect()}
    assert got == plain_tree(pages, labelled)
    assert {got[n][2] for n in range(0, 160, 2)} == {"block"} and {got[n][2] for n in range(1, 160, 2)} == {"allow"}


def clusters(seed, groups=12, each=30, dim=16, spread=0.08):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((groups, dim)), each, axis=0) + spread * rng.standard_normal((groups * each, dim)) * rng.integers(1, 6, (groups * each, 1))
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


ODD_VECTORS = [(1_000, None), (1_001, []), (1_002, [0.0] * 16), (1_003, [float("nan")] * 16), (1_004, [1.0] * 3), (1_005, [None] * 16), (1_006, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, weight int")


def plain_links(rows, least=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    low = np.array(ids)
    while True:
        then = np.array([min([low[n], *low[near[n]]]) for n in range(len(ids))])
        if (then == low).all():
            return {i: (int(near[n].sum()), int(low[n])) for n, i in enumerate(ids)}
        low = then


@pytest.mark.parametrize("block", [2_048, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    rows = clusters(4)
    rows += [(2_000 + k, rows[0][1]) for k in range(40)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.near_duplicates(vectors(spark, rows + ODD_VECTORS)).collect()}
    want = plain_links(rows)
    assert len(got) == len(rows) + len(ODD_VECTORS)
    assert all(got[i] == (0, i, True) for i, _ in ODD_VECTORS)
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i][0] for i in want) >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.9 and all(got[i][2] == (got[i][1] == i) for i in want)


def test_near_vectors_of_nothing(spark):
    assert multiindex.near_duplicates(vectors(spark, [(1, [1.0])]).where("false")).count() == 0
    assert multiindex.near_duplicates(vectors(spark, ODD_VECTORS[:3])).count() == 3


def test_traversal_is_the_order_of_all_cells():
    rng = np.random.default_rng(1)
    u, books = rng.standard_normal((20, 8)), (rng.standard_normal((6, 4)), rng.standard_normal((6, 4)))
    a, b = multiindex.half_distances(u, books)
    whole = np.argsort((a[:, :, None] + b[:, None, :]).reshape(20, -1), axis=1, kind="stable")
    assert (multiindex.traversal(u, books, 36) == whole).all() and (multiindex.traversal(u, books, 7) == whole[:, :7]).all()
    assert (multiindex.places(u, books, whole[:, 11]) == 11).all()


@pytest.mark.parametrize("blocks", [(2_048, 32_768), (7, 50)])
def test_nearest_against_all(spark, monkeypatch, blocks):
    monkeypatch.setattr(onebit, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(onebit, "VECTOR_BLOCK", blocks[1])
    rows = clusters(7, groups=8)
    rows += [(3_000 + k, rows[5][1]) for k in range(30)]
    got = collections.defaultdict(list)
    for r in onebit.nearest(vectors(spark, rows + ODD_VECTORS), "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hit = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = [n for n in np.lexsort((ids, -score)) if ids[n] != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - score[ids == i][0]) < 1e-9 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit, total = hit + len({i for _, i, _ in found} & set(ids[best].tolist())), total + 20
    assert hit / total >= 0.98


def test_nearest_of_few(spark):
    assert onebit.nearest(vectors(spark, ODD_VECTORS), "vec_id % 20 = 0").count() == 0
    assert onebit.nearest(vectors(spark, [(20, [1.0, 2.0]), (21, [2.0, 1.0])]), "vec_id % 20 = 0").collect() == [(20, 1, 21, 4.0)]
    assert onebit.nearest(vectors(spark, [(20, [1.0])]).where("false"), "vec_id % 20 = 0").count() == 0
    assert onebit.nearest(vectors(spark, [(20, [1.0, 2.0])]), "vec_id % 20 = 0").count() == 0


def test_rare_pairs_of_near_vectors(spark):
    """A few pairs just above the threshold among unlike vectors: most are in no probe's reach, and a good part lies beyond the nearest cells."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((60, 32))
    away -= (away * x[:60]).sum(axis=1, keepdims=True) * x[:60]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(n, v.tolist()) for n, v in enumerate(np.vstack([x, 0.91 * x[:60] + np.sqrt(1 - 0.91**2) * away]).astype(np.float32))]
    got = {r.vec_id: r.component_id for r in multiindex.near_duplicates(vectors(spark, rows)).where("n_links > 0").collect()}
    assert sum(got.get(12_000 + k) == got.get(k) == k for k in range(60)) >= 57


def test_steps_hold_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((3_000, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    books = (multiindex.codebook(u[:, :8], 12), multiindex.codebook(u[:, 8:], 12))
    assert 4 < multiindex.threshold_steps(u, books, 0.9, 0.99) <= 144 and multiindex.threshold_steps(u, books, 1.0, 0.99) == 1
    assert multiindex.share_steps(np.array([5, 0, 2]), np.array([1, 98, 1]), 0.99) == 3


def test_nearest_with_repeated_rows(spark):
    """Repeated rows take no places: every row twice, and one row many times."""
    rows = clusters(9, groups=4)
    plain = onebit.nearest(vectors(spark, rows), "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect()
    got = onebit.nearest(vectors(spark, rows * 2 + rows[1:2] * 40), "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect()
    assert [r[:3] for r in got] == [r[:3] for r in plain] and len(got) == 6 * 20
    # One id with two vectors of the same score: two candidates.
    same = onebit.nearest(vectors(spark, [(20, [1.0, 0.0]), (21, [2.0, 1.0]), (21, [2.0, -1.0]), (21, [2.0, -1.0])]), "vec_id % 20 = 0", 20)
    assert sorted(same.collect()) == [(20, 1, 21, 2.0), (20, 2, 21, 2.0)]
