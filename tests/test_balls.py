"""Trees of balls: their invariants, and exact searches by several metrics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwin.operators import balls


def points(n=400, seed=1):
    """Clusters, repeated rows, rows far off, and rows that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 3.0, 10.0]) + rng.gauss(0, 0.3), rng.gauss(0, 1), rng.choice([0.0, 1.0])]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)] + [(n + 50, [500.0, 0.0, 0.0]), (n + 51, None), (n + 52, [1.0, None, 0.0]), (n + 53, [float("nan"), 1.0, 0.0]), (None, [0.0, 0.0, 0.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def brute(rows, metric, k, squares):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any()]
    out = []
    for qid, q in good:
        if qid % 20 == 0:
            d = sorted((float(balls.SQUARES.rows(q, v) if squares else metric.rows(q, v)), i) for i, v in good)[:k]
            out += [(qid, i, r) for r, (_, i) in enumerate(d, 1)]
    return sorted(out)


def built(df, kind, metric, **more):
    return balls.ball_tree(df, "id", "v", 3, metric, **more) if kind == "ball" else balls.cover_tree(df, "id", "v", 3, metric, **more)[0]


@pytest.mark.parametrize(("kind", "name", "more"), [
    ("ball", "euclidean", {"leaf": 8}), ("ball", "manhattan", {"leaf": 4, "whole": 60}), ("ball", "chebyshev", {"leaf": 1000}),
    ("cover", "euclidean", {"leaf": 40}), ("cover", "manhattan", {"leaf": 90, "offered": 3}),
])
def test_nearest(spark, kind, name, more):
    rows, metric = [r for r in points() if kind == "ball" or r[0] != 450], balls.METRICS[name]  # far rows make a cover tree deep
    df = frame(spark, rows)
    tree = built(df, kind, metric, **more)
    asked = df.filter("id % 20 = 0")
    got = sorted((r.qid, r.id, r.rank) for r in balls.nearest(tree, asked, "id", "v", 5).collect())
    assert got == brute(rows, metric, 5, name == "euclidean")
    held = tree.members.collect()
    assert sorted(r.id for r in held) == sorted(i for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any())
    nodes = [n for step in tree.steps for n in step.collect()]
    leaves = {n.node: n for n in nodes if n.leaf}
    assert len(leaves) == sum(n.leaf for n in nodes)
    for n in leaves.values():
        inside = [r for r in held if r.node == n.node]
        far = [float(metric.rows(np.array(r.v), np.array(n.v))) for r in inside]
        assert len(inside) == n.n and max(far) <= n.cover * (1 + 1e-12) and (n.n <= more["leaf"] or n.cover == 0)
        assert all(abs(a - r.cd) < 1e-9 for a, r in zip(far, inside, strict=True))


def test_inner_balls_hold_their_rows(spark):
    tree = built(frame(spark, points(150)), "cover", balls.EUCLIDEAN, leaf=60)
    steps = [s.collect() for s in tree.steps]
    rows = {}
    for r in tree.members.collect():
        rows.setdefault(r.node, []).append(np.array(r.v))
    for i in range(len(steps) - 1, -1, -1):
        for n in steps[i]:
            mine = rows[n.node] if n.leaf else [v for m in steps[i + 1] if m.parent == n.node for v in below[i + 1, m.node]]
            below = {**(below if i < len(steps) - 1 or n is not steps[i][0] else {}), (i, n.node): mine}
            assert len(mine) == n.n
            assert max(float(balls.EUCLIDEAN.rows(v, np.array(n.v))) for v in mine) <= n.cover * (1 + 1e-9)


def test_cover_tree_invariants(spark):
    """Nesting, covering, separation, and each centre's parent the nearest of the levels above."""
    rows = [r for r in points(200, seed=4) if r[0] != 250]
    _, centres = balls.cover_tree(frame(spark, rows), "id", "v", 3, leaf=12, offered=20)
    got = {r.id: r for r in centres.collect()}
    assert len(got) > 10 and sum(r.parent is None for r in got.values()) == 1
    d = lambda a, b: float(balls.EUCLIDEAN.rows(np.array(got[a].v), np.array(got[b].v)))
    for r in got.values():
        for other in got.values():
            if other.id != r.id:
                assert d(r.id, other.id) > balls.BASE ** min(r.level, other.level)
        if r.parent is not None:
            assert got[r.parent].level > r.level and d(r.id, r.parent) <= balls.BASE ** (r.level + 1) * (1 + 1e-9)


def test_statistics_are_fewer_than_all_pairs(spark):
    rows = [(i, [random.Random(i).random(), random.Random(-i - 1).random(), 0.0]) for i in range(3000)]
    df = frame(spark, rows)
    asked = df.filter("id % 100 = 0")
    for tree in (built(df, "ball", balls.EUCLIDEAN, leaf=32), built(df, "cover", balls.EUCLIDEAN, leaf=200)):
        leaves, looked = balls.reached(tree, asked, "id", "v", 5)
        met = balls.pairs_met(tree, leaves, 5)
        of = {r.qid: r for r in balls.statistics(tree, asked, "id", "v", 5).collect()}
        assert len(of) == 30
        assert sum(r.points for r in of.values()) == met.count() and sum(r.balls for r in of.values()) == sum(x.count() for x in looked)
        assert all(r.coordinates == 3 * (r.balls + r.points) for r in of.values())
        assert sum(r.balls + r.points for r in of.values()) < 0.3 * 30 * 3000


@pytest.mark.parametrize("tile", [balls.TILE, 200])
def test_no_pairs_of_far_rows_become_rows(spark, monkeypatch, tile):
    """1,500 rows, all farther apart than a level's radius: all become centres, and no table that is written holds their pairs."""
    held, keep = [], balls.written
    monkeypatch.setattr(balls, "written", lambda df, **o: held.append(keep(df, **o)) or held[-1])
    monkeypatch.setattr(balls, "TILE", tile)
    rng = np.random.default_rng(2)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(1500, 48)))]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    tree = balls.cover_tree(df, "id", "v", 48, leaf=64)[0]
    assert max(t.count() for t in held) <= 8 * 1500
    got = sorted((r.qid, r.id, r.rank) for r in balls.nearest(tree, df.filter("id % 20 = 0"), "id", "v", 5).collect())
    assert got == brute(rows, balls.EUCLIDEAN, 5, True)


@pytest.mark.parametrize(("whole", "written"), [(300, 40), (0, 10_000)])
def test_cover_tree_of_many_cells(spark, monkeypatch, whole, written):
    """levels are built in leaps and small cells in a task each, from few written tables; whole=0 has centres separated from all."""
    held, keep = [], balls.written
    monkeypatch.setattr(balls, "written", lambda df, **o: held.append(0) or keep(df, **o))
    monkeypatch.setattr(balls, "SHOWN", 2000)
    rng, n = np.random.default_rng(3), 4000 if whole else 400
    x = np.concatenate([rng.uniform(size=(n * 5 // 8, 3)), rng.normal(0.5, 1e-4, size=(n * 3 // 8, 3))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n + i, x[7].tolist()) for i in range(n // 10)]
    df = frame(spark, rows)
    tree, centres = balls.cover_tree(df, "id", "v", 3, leaf=25, whole=whole)
    assert len(held) <= written
    held_rows, leaves = tree.members.toPandas(), {n.node: n for s in tree.steps for n in s.filter("leaf").collect()}
    assert sorted(held_rows["id"]) == list(range(n + n // 10)) and set(held_rows["node"]) == set(leaves)
    for node, of in held_rows.groupby("node"):
        n, far = leaves[node], np.sqrt(((np.array(of["v"].tolist()) - np.array(leaves[node].v)) ** 2).sum(axis=1))
        assert n.n == len(of) and (n.n <= 25 or n.cover == 0) and far.max() <= n.cover * (1 + 1e-9)
    got = {r.id: r for r in centres.collect()}
    assert sum(r.parent is None for r in got.values()) == 1
    v, level, ids = np.array([r.v for r in got.values()]), np.array([r.level for r in got.values()]), np.array(list(got))
    apart = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(v))
    parent = np.array([-1 if r.parent is None else r.parent for r in got.values()])
    close = apart <= balls.BASE ** np.minimum(level[:, None], level[None])
    assert not (close & (parent[:, None] == parent[None])).any() and not (whole == 0 and close.any())
    for i in np.flatnonzero(parent >= 0):
        above = got[parent[i]]
        assert above.level > level[i] and np.linalg.norm(v[i] - np.array(above.v)) <= balls.BASE ** (level[i] + 1) * (1 + 1e-9), ids[i]
    asked = df.filter("id % 20 = 0")
    assert sorted((r.qid, r.id, r.rank) for r in balls.nearest(tree, asked, "id", "v", 5).collect()) == brute(rows, balls.EUCLIDEAN, 5, True)


@pytest.mark.parametrize("kind", ["ball", "cover"])
def test_small_tables(spark, kind):
    none = frame(spark, [])
    assert balls.nearest(built(none, kind, balls.EUCLIDEAN), none, "id", "v", 3).collect() == []
    same = frame(spark, [(i, [1.0, 1.0, 1.0]) for i in range(200)])
    got = balls.nearest(built(same, kind, balls.EUCLIDEAN, leaf=8), same.filter(F.col("id") == 20), "id", "v", 3).collect()
    assert sorted((r.id, r.d2, r.rank) for r in got) == [(0, 0.0, 1), (1, 0.0, 2), (2, 0.0, 3)]


def test_blocks_hold_every_leaf_once(spark):
    """A search goes down to blocks alone: each leaf is in one, none holds more rows than it may, and together they hold all."""
    tree = built(frame(spark, [(i, [float(i % 20), float(i // 20), 0.0]) for i in range(400)]), "ball", balls.EUCLIDEAN, leaf=8)
    top, inside = balls.topped(tree, 60)
    blocks = {r.node: r.n for s in top.steps for r in s.filter("leaf").collect()}
    leaves = inside.collect()
    assert len({r.node for r in leaves}) == len(leaves) > len(blocks) > 1 and {r.block for r in leaves} == set(blocks)
    assert max(blocks.values()) <= 60 and sum(blocks.values()) == sum(r.n for r in leaves) == 400


def test_tiny_nodes_are_a_block_together(spark):
    """1,500 rows, all farther apart than a level's radius: a search meets blocks of them, not a node a row."""
    rng = np.random.default_rng(2)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(1500, 48)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    top, inside = balls.topped(balls.cover_tree(df, "id", "v", 48, leaf=8)[0], 40)
    blocks = {r.node: r for s in top.steps for r in s.filter("leaf").collect()}
    leaves = inside.collect()
    assert 4 * len(blocks) < len(leaves) and {r.block for r in leaves} == set(blocks)
    assert sum(r.n for r in blocks.values()) == sum(r.n for r in leaves) == 1500
    held = {r.node: [] for r in leaves}
    for r in top.members.collect():
        held[r.node].append(r.v)
    for r in leaves:
        of = blocks[r.block]
        assert of.n <= 40 and all(balls.EUCLIDEAN.rows(np.array(v), np.array(of.v)) <= of.cover * (1 + 1e-9) for v in held[r.node])
