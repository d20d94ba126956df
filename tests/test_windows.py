"""Windows of live searches: the tree gives what the ring gives, keeps its rules, and survives restarts."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearwin.queries import settings
from nearwin.streaming import windows

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def rows(n, seed, missing=True):
    rng = random.Random(seed)
    number = lambda: math.nan if missing and rng.random() < 0.1 else rng.choice([0.0, 1.0, 2.0, rng.gauss(0, 3)])
    return [(i, (number(), number()), (rng.choice(["a", "b", None]),), rng.choice("xy")) for i in range(n)]


def check(tree):
    """Every row is in the leaf that the splits lead to, boxes hold their rows, and leaves that can be split are."""
    seen = []

    def look(node, parent):
        assert node.parent is parent
        if node.dim is None:
            for p in node.places:
                assert tree.leaf_of[p] is node
            if len(node.places) > windows.LEAF:
                assert all(w == 0 for _, w in windows.ranges({p: tree.rows[p] for p in node.places}, tree.numeric)) or not node.places
            seen.extend(node.places)
            below = list(node.places)
        else:
            assert not node.places and len(node.sides) == 2
            left, right = look(node.sides[0], node), look(node.sides[1], node)
            assert all(not tree.rows[p][1][node.dim] > node.split for p in left) and all(tree.rows[p][1][node.dim] > node.split for p in right)
            below = left + right
        for p in below:
            for d, v in enumerate(tree.rows[p][1]):
                assert node.gap[d] if v != v else node.low[d] <= v <= node.high[d]
        return below

    look(tree.root, None)
    assert sorted(seen) == sorted(tree.rows) == list(tree.rows)


@pytest.mark.parametrize(("size", "seed"), [(1, 1), (3, 2), (16, 3), (64, 4)])
def test_tree_and_ring_agree(size, seed):
    ring, tree = windows.Ring(size, 2), windows.Tree(size, 2)
    for i, row in enumerate(rows(5 * size + 40, seed)):
        for k in (1, 4):
            assert tree.nearest(row[1], row[2], k) == ring.nearest(row[1], row[2], k)
        ring.add(row)
        tree.add(row)
        check(tree)
        assert len(tree.rows) == min(i + 1, size)
        if i % 7 == 0:  # what a restart does
            again = windows.Tree(size, 2)
            again.restore(list(tree.rows.values()), tree.shape())
            tree = again
            ring2 = windows.Ring(size, 2)
            ring2.restore(list(ring.rows.values()), ring.shape())
            ring = ring2
            check(tree)


def test_many_equal_rows_through_a_small_window():
    """71 rows, most of them equal, through a window of 16: it holds 16, and gives 4."""
    table = [(0.0, 0.0)] * 35 + [(10.0, 3.0)] * 32 + [(4.0, 1.0), (5.0, 2.0), (6.0, 2.5), (7.0, 0.5)]
    tree = windows.Tree(16, 2)
    for i, x in enumerate(table):
        tree.add((i, x, (), "UP"))
        check(tree)
    assert len(tree.rows) == 16 and len(tree.nearest((0.0, 0.0), (), 4)) == 4


def test_the_tree_looks_at_fewer_rows():
    ring, tree = windows.Ring(512, 2), windows.Tree(512, 2)
    for row in [(i, (random.Random(i).random(), random.Random(-i - 1).random()), (), "x") for i in range(700)]:
        for w in (ring, tree):
            if len(w.rows) == 512:
                w.nearest(row[1], row[2], 4)
            w.add(row)
    assert ring.looked == 188 * 512 and tree.looked < 0.2 * ring.looked


def test_the_tree_passes_over_boxes_without_the_name():
    """A name that differs counts 1, so boxes without the query's name are mostly beyond the k-th distance."""
    rng = random.Random(5)
    ring, tree = windows.Ring(32, 2), windows.Tree(32, 2)
    for i in range(2000):
        row = (i, (rng.random(), rng.random()), (str(rng.randrange(7)),), "x")
        if i >= 32:
            assert tree.nearest(row[1], row[2], 4) == ring.nearest(row[1], row[2], 4)
        ring.add(row)
        tree.add(row)
    assert tree.looked < 0.6 * ring.looked


@pytest.mark.parametrize("kind", ["tree", "ring"])
def test_ranges_are_made_anew_only_when_a_limit_moves(monkeypatch, kind):
    made, whole = [], windows.ranges
    monkeypatch.setattr(windows, "ranges", lambda rows, numeric: made.append(len(rows) > windows.LEAF + 1) or whole(rows, numeric))
    window = windows.KINDS[kind](64, 2)
    rng = random.Random(8)
    for i in range(1000):
        x = (rng.random(), rng.random())
        window.nearest(x, ("a",), 4)
        window.add((i, x, ("a",), "x"))
    assert sum(made) < 500 and window.limits() == whole(window.rows, 2)


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.state, self.timers = Value(), []

    def getValueState(self, name, schema):  # noqa: N802
        return self.state

    def listTimers(self):  # noqa: N802
        return iter([(t,) for t in self.timers])

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class Clock:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_an_idle_key_loses_its_window():
    live, handle = windows.Live("tree", 1, 2, 1, 500), Handle()
    live.init(handle)
    batch = pd.DataFrame({"at": [1, 2, 3], "numbers": [[1.0], [2.0], [4.0]], "names": [[], [], []], "label": ["x", "y", "x"]})
    out = pd.concat(live.handleInputRows(("k",), iter([batch]), Clock()))
    assert out[["at", "id", "label"]].values.tolist() == [[3, 2, "y"]]
    list(live.handleInputRows(("k",), iter([batch]), Clock()))
    assert handle.timers == [1500] and handle.state.exists()
    list(live.handleExpiredTimer(("k",), Clock(), None))
    assert not handle.state.exists()


@pytest.mark.parametrize("kind", ["tree", "ring"])
def test_stream_goes_on_after_a_restart(spark, tmp_path, kind):
    data = [(f"u{i % 3}", i, *r[1], *r[2], r[3]) for i, r in enumerate(rows(120, 9))]
    want = []
    for key in ("u0", "u1", "u2"):
        ring = windows.Ring(8, 2)
        for _, at, x, z, c, y in (r for r in data if r[0] == key):
            if len(ring.rows) == 8:
                want += [(key, at, y, ring.rows[p][0], d, r, ring.rows[p][3]) for r, (d, p) in enumerate(ring.nearest((x, z), (c,), 3), 1)]
            ring.add((at, (x, z), (c,), y))
    schema = "user string, at long, x double, z double, c string, y string"
    with settings(spark, ROCKS):
        for a, b in ((0, 50), (50, 120)):
            spark.createDataFrame(data[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = windows.nearest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user", "at", ["x", "z"], ["c"], "y", 8, 3, kind)
            run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*(F.col(c.split()[0]) for c in windows.FOUND.split(", "))).collect()]
    assert sorted(got) == sorted(want)
