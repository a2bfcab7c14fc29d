import numpy as np
import pytest

from doclog.llm import hnsw


def clustered(n, d=16, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 12, d))
    return [(k, (centres[r.integers(len(centres))] + r.normal(size=d) * 0.07).astype(np.float32).tolist() if k % 3 else r.normal(size=d).astype(np.float32).tolist()) for k in range(n)]


def brute(rows, least=0.9):
    ok = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {n: set() for n, _, _ in ok}, {n: i for n, i, _ in ok}
    for n, _, v in ok:
        for m, _, w in ok:
            if n < m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[n].add(m)
                links[m].add(n)
    for _ in range(len(ok)):
        new = {n: min([root[n], *(root[m] for m in links[n])]) for n in root}
        if new == root:
            break
        root = new
    return [(i, len(links.get(n, ())), root.get(n, i), i is not None and root.get(n, i) == i) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("shard", [16_384, 20])
def test_near_duplicates(spark, shard):
    rows = clustered(400)
    rows += [(500 + k, rows[4][1]) for k in range(30)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None, 1.0]), (604, [1.0, 0.0]), (605, [2.0, 0.0]), (606, []), (None, rows[4][1]), rows[7], (607, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 label", "2 shard", "3 n", "4 rep")
    got = [tuple(r) for r in hnsw.near_duplicates(df, shard=shard, recall=1.0).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_recall_of_a_graph_at_the_default_beam():
    x = hnsw.unit(np.array([v for _, v in clustered(6000, 32)])).astype(np.float32)
    graph = hnsw.Graph(x)
    want = np.argwhere(x[:600] @ x.T >= 0.9)
    r, c = graph.near(x[:600], 0.9, hnsw.BEAM)
    got = set(zip(r.tolist(), c.tolist()))
    assert len(got & {tuple(p) for p in want.tolist()}) >= 0.95 * len(want)


def test_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def cut_off(x):
    """A graph whose nodes have lost all their links."""
    graph = hnsw.Graph(x.astype(np.float32))
    graph.bottom[:] = -1
    return graph


def test_a_bad_graph_fails_its_audit():
    """The beam widens until it is as wide as the graph, and then sees all of it."""
    x = hnsw.unit(np.random.default_rng(1).normal(size=(3000, 32)))
    y = hnsw.unit(np.random.default_rng(2).normal(size=(3000, 32)))
    y[[5, 900, 2001]] = x[[7, 1000, 2000]]
    r, c, (beam, nearest, linked) = hnsw.search(x, x.astype(np.float32), cut_off(y), y, False, 0.9, hnsw.BEAM, 0.99)
    assert sorted(zip(r.tolist(), c.tolist())) == [(7, 5), (1000, 900), (2000, 2001)] and beam >= 3000 and nearest == linked == 1.0


def test_rare_links_come_from_the_graph(monkeypatch):
    """Three links among 3,000 and 3,000 vectors: brute force looks at the sample of queries and at no other."""
    x = hnsw.unit(np.random.default_rng(1).normal(size=(3000, 16)))
    y = hnsw.unit(np.random.default_rng(2).normal(size=(3000, 16)))
    y[[5, 900, 2001]] = x[[7, 1000, 2000]]
    graph, asked, compared = hnsw.Graph(y.astype(np.float32)), [], []
    near, walk = graph.near, hnsw.Graph.walk
    monkeypatch.setattr(graph, "near", lambda q, least, width: asked.append((len(q), width)) or near(q, least, width), raising=False)

    def counted(q, start, among, links, width):
        out = walk(q, start, among, links, width)
        compared.append(out[2].sum())
        return out

    monkeypatch.setattr(hnsw.Graph, "walk", staticmethod(counted))
    r, c, (beam, nearest, linked) = hnsw.search(x, x.astype(np.float32), graph, y, False, 0.9, hnsw.BEAM, 0.99)
    assert {(7, 5), (1000, 900), (2000, 2001)} <= set(zip(r.tolist(), c.tolist()))
    assert max(w for _, w in asked) < 3000 and sum(n for n, w in asked if w == beam) == 3000 + hnsw.AUDIT + hnsw.PLANTED and nearest >= 0.5 and linked >= 0.99
    assert sum(compared) < 0.5 * 3000 * 3000


def test_recall_of_links_among_clusters():
    x = hnsw.unit(np.array([v for _, v in clustered(6000, 32)]))
    graph = hnsw.Graph(x.astype(np.float32))
    r, c, _ = hnsw.search(x, x.astype(np.float32), graph, x, True, 0.9, hnsw.BEAM, 0.99)
    want = {tuple(p) for p in np.argwhere(x @ x.T >= 0.9).tolist()}
    assert len(want & set(zip(r.tolist(), c.tolist()))) >= 0.99 * len(want) and len(want) > 10_000


def test_links_found_from_one_side_count_for_both(monkeypatch):
    x = np.eye(4)
    monkeypatch.setattr(hnsw, "search", lambda a, block, graph, b, *_: (*((np.array([0, 2]), np.array([1, 3])) if a is x else (np.array([1, 0]), np.array([0, 3]))), (32, 1.0, 1.0)))
    one, two = hnsw.Graph(x.astype(np.float32)), hnsw.Graph(x.astype(np.float32))
    r, c, _ = hnsw.both_ways(x, one, x.copy(), two, False, 0.9, 32, 0.99)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (2, 3), (3, 0)]
    r, c, _ = hnsw.both_ways(x, one, x, one, True, 0.9, 32, 0.99)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (1, 0), (2, 3), (3, 2)]
