"""Components: stars are not worked on again, and later edges join what is known."""

import random

from candorframe.llm import graph
from candorframe.llm.common import stage


def plain_roots(edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((n, r) for n, r in root.items())


def rows_of(df):
    return sorted((r.node, r.root) for r in df.collect())


def test_stars_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, tag: written.append(tag) or stage(df, tag))
    edges = [(9, 1), (8, 1), (1, 7), (20, 30), (20, 31), (20, 30)]
    assert rows_of(graph.components(spark.createDataFrame(edges, "a long, b long"))) == plain_roots(edges)
    assert written == ["stars"]


def test_later_edges_join_known_components(spark):
    rng = random.Random(5)
    draw = lambda n: [tuple(rng.sample(range(-150, 150), 2)) for _ in range(n)]
    first, path = draw(90), [(i, i + 1) for i in range(200, 240)]
    for second in (draw(40) + path, [], first[:20], [(4, 4)]):
        known = stage(graph.components(spark.createDataFrame(first, "a long, b long")), "known")
        assert rows_of(graph.joined(known, spark.createDataFrame(second, "a long, b long"))) == plain_roots(first + [e for e in second if e[0] != e[1]])
