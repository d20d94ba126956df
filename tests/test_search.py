"""Searches against plain Python, approximate methods by recall."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwin.functions import distance as D
from nearwin.operators import approx, blocks, knn, probing, ranges, spacetree, window, zorder
from nearwin.queries import QUERIES
from nearwin.spec import FeatureSpec
from nearwin.streaming.window import squared
from tests.conftest import DATA

SPEC = FeatureSpec(("x", "z"), ("c",), "y")


def mixed_rows(n, seed=1):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.15 else v
    return [(i, maybe(float(rng.randrange(20))), maybe(rng.random()), maybe(rng.choice("pqr")), rng.choice("AB")) for i in range(n)]


def plain(a, b, limits):
    total = 0.0
    for k, (low, high) in enumerate(limits, 1):
        norm = lambda v, low=low, high=high: (v - low) / (high - low) if high > low else 0.0
        far = lambda v: v if v >= 0.5 else 1 - v
        d = 1.0 if a[k] is None and b[k] is None else far(norm(b[k])) if a[k] is None else far(norm(a[k])) if b[k] is None else norm(a[k]) - norm(b[k])
        total += d * d
    return total + (0.0 if a[3] == b[3] and a[3] is not None else 1.0)


@pytest.mark.parametrize("k", [1, 5, 500])
def test_nearest_with_missing_values(spark, k):
    rows = mixed_rows(300)
    df = spark.createDataFrame(rows, "id long, x double, z double, c string, y string")
    of = ranges.ranges_of(df, SPEC.numeric)
    limits = [(min(v), max(v)) for v in ([r[i] for r in rows if r[i] is not None] for i in (1, 2))]
    got = knn.nearest(df, df.filter("id % 50 = 0"), SPEC, of, k, leave_one_out=True, extra=("x", "y"))
    by = {}
    for r in got.collect():
        by.setdefault(r["qid"], []).append((r["rank"], r["id"], r["d2"], r["x"], r["y"]))
    assert set(by) == set(range(0, 300, 50))
    for q, found in by.items():
        want = sorted((plain(rows[q], r, limits), r[0]) for r in rows if r[0] != q)[:k]
        assert [(f[2], f[1]) for f in sorted(found)] == [(pytest.approx(d), i) for d, i in want]
        assert all(f[3] == rows[f[1]][1] and f[4] == rows[f[1]][4] for f in found)


def test_normalised_once_equals_normalised_in_pairs(spark):
    df = spark.createDataFrame(mixed_rows(80), "id long, x double, z double, c string, y string")
    of = ranges.ranges_of(df, SPEC.numeric)
    pairs = df.join(knn.sided(df.filter("id < 5"), SPEC))
    once = knn.normalised(df, SPEC, of).join(knn.sided(knn.normalised(df.filter("id < 5"), SPEC, of), SPEC))
    a = {(r[0], r[1]): r[2] for r in pairs.select("id", "qid", knn.measured(SPEC, of)).collect()}
    b = {(r[0], r[1]): r[2] for r in once.select("id", "qid", D.normal_squared(lambda c: F.col(f"q_{c}"), F.col, SPEC, of)).collect()}
    assert a == b


def test_an_attribute_without_values(spark):
    df = spark.createDataFrame([(1, None, 1.0, "p", "A"), (2, None, 2.0, "p", "A")], "id long, x double, z double, c string, y string")
    got = knn.nearest(df, df, SPEC, ranges.ranges_of(df, SPEC.numeric), 1, leave_one_out=True).collect()
    assert [r["d2"] for r in got] == [2.0, 2.0]


def vectors(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    return centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.3


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def truth(x, queries, k):
    return {q: set(np.lexsort((np.arange(len(x)), ((x - x[q]) ** 2).sum(axis=1)))[:k].tolist()) for q in queries}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], set()).add(r["id"])
    return out


def test_ball_cover_is_exact(spark):
    x = vectors(400, 6)
    df = frame(spark, x)
    want = truth(x, range(0, 400, 40), 7)
    asked = df.filter("id % 40 = 0")
    assert found(approx.ball_cover_exact(df, df.filter("id % 19 = 0"), asked, "id", "v", 6, 7)) == want
    assert found(approx.array_nearest(df, asked, "id", "v", 6, 7)) == want


def test_recall_of_approximate_searches(spark):
    x = vectors(1000, 8)
    df = frame(spark, x)
    asked = df.filter("id % 50 = 0")
    want = truth(x, range(0, 1000, 50), 10)
    for got in (approx.hashed_nearest(df, asked, "id", "v", 8, 10), approx.ball_cover_oneshot(df, df.filter("id % 31 = 0"), asked, "id", "v", 8, 10, 300)):
        of = found(got)
        assert sum(len(of.get(q, set()) & w) for q, w in want.items()) / (10 * len(want)) >= 0.9


def test_projections_keep_distances(spark):
    x = vectors(60, 32)
    df = frame(spark, x)
    dense = np.array([list(r)[1:] for r in df.select("id", *approx.dense_projection(F.col("v"), 32, 24, 1)).orderBy("id").collect()])
    fourier = np.array([r["projection"] for r in approx.fourier_projection(df, "id", "v", 32, 24, 1).orderBy("id").collect()])
    real = np.linalg.norm(x[:30] - x[30:], axis=1)
    for y in (dense, fourier):
        ratio = np.linalg.norm(y[:30] - y[30:], axis=1) / real
        assert 0.8 < ratio.mean() < 1.2 and ratio.std() < 0.3


@pytest.mark.parametrize("rule", ["max", "mid"])
def test_random_tree_grows_to_its_leaf_size(spark, rule):
    same = [(1000 + i, [0.5] * 5) for i in range(60)]
    df = frame(spark, vectors(200, 5)).unionByName(spark.createDataFrame(same, "id long, v array<double>").select(F.col("id"), F.col("v")))
    leaves = spacetree.random_tree(df, "id", "v", 5, 30, rule).collect()
    held = {}
    for r in leaves:
        held.setdefault(r["leaf"], []).append(r["id"])
    assert sum(map(len, held.values())) == 260
    assert all(len(ids) <= 30 or min(ids) >= 1000 for ids in held.values())


@pytest.mark.parametrize("rule", ["max", "mid"])
def test_forest_recall(spark, rule):
    """Of 1,500 points, leaves of 100 in four trees hold nine in ten neighbours, from under 0.3 of all pairs."""
    rng = np.random.default_rng(11)
    x = rng.random((1500, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got, want = found(spacetree.forest_nearest(df, df.filter("id % 50 = 0"), "id", "v", 2, 5, leaf=100, rule=rule)), truth(x, range(0, 1500, 50), 5)
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_morton_codes_interleave(spark):
    df = spark.createDataFrame([(5, 3)], "x long, y long")
    assert df.select(approx.morton(F.col("x"), F.col("y"), 4)).first()[0] == 0b011011


def test_stream_distance_has_the_same_rules():
    rows = [r for r in mixed_rows(40)]
    x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows], float)
    limits = [(np.nanmin(x[:, k]), np.nanmax(x[:, k])) for k in range(2)]
    for q in range(5):
        got = squared(x, x[q])
        want = [plain(rows[q], (*r[:3], rows[q][3] or "?", r[4]), limits) - (0.0 if rows[q][3] else 1.0) for r in rows]
        assert got == pytest.approx(want)


def window_distance(q, r, past):
    """By the rules for missing values, with ranges of the window's rows; columns 1 and 2 are numbers, 3 is a name."""

    def between(a, b, seen):
        low, high = (min(seen), max(seen)) if seen else (0, 0)
        a, b = (v if v is None else (v - low) / (high - low) if high > low else 0.0 for v in (a, b))
        if a is None and b is None:
            return 1.0
        if a is None or b is None:
            v = b if a is None else a
            return 1 - v if v < 0.5 else v
        return a - b

    d = [between(q[c], r[c], [p[c] for p in past if p[c] is not None]) for c in (1, 2)]
    d.append(0.0 if q[3] is not None and q[3] == r[3] else 1.0)
    return sum(v * v for v in d)


def test_window_with_missing_values(spark):
    """Neighbours among the rows before, with gaps in every attribute, against plain Python."""
    rng = random.Random(17)
    gap = lambda v: None if rng.random() < 0.3 else v
    rows = [(i, gap(rng.random() * 9), gap(float(rng.randrange(3))), gap(rng.choice("ab")), "l") for i in range(60)]
    rows[20:32] = [(i, None, 1.0, "a", "l") for i in range(20, 32)]
    spec = FeatureSpec(("x", "y"), ("n",), "label", "id")
    got = window.window_nearest(spark.createDataFrame(rows, "id long, x double, y double, n string, label string"), spec, 8, 3).collect()

    want = []
    for q in range(8, 60):
        past = rows[q - 8 : q]
        found = [(window_distance(rows[q], r, past), r[0]) for r in past]
        want += [(q, i, pytest.approx(d2), k) for k, (d2, i) in enumerate(sorted(found)[:3], 1)]
    assert sorted((r["qid"], r["id"], r["d2"], r["rank"]) for r in got) == sorted(want, key=lambda w: (w[0], w[1]))


def test_held_out_stretches(spark):
    """Rows of test stretches meet the last rows of their own train stretch, with gaps; tested rows are not learned."""
    rng = random.Random(5)
    gap = lambda v: None if rng.random() < 0.3 else v
    rows = [(i * 3, gap(rng.random() * 9), gap(float(rng.randrange(3))), gap(rng.choice("ab")), rng.choice("lm")) for i in range(53)]
    df = spark.createDataFrame(rows, "id long, x double, y double, n string, label string")
    got = window.held_out_nearest(df, FeatureSpec(("x", "y"), ("n",), "label", "id"), 10, 4, 6, 3).collect()
    want = []
    for at, q in enumerate(rows):
        period, place = divmod(at, 14)
        if place >= 10:
            past = rows[period * 14 + 4 : period * 14 + 10]
            found = sorted((window_distance(q, r, past), r[0], r[4]) for r in past)[:3]
            want += [(q[0], period, q[4], i, pytest.approx(d2), k, label) for k, (d2, i, label) in enumerate(found, 1)]
    columns = ("qid", "period", "truth", "id", "d2", "rank", "label")
    assert len(want) == 3 * (4 * 3 + 1)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=lambda r: (r[0], r[5])) == want
    assert window.held_out_nearest(df.limit(0), FeatureSpec(("x", "y"), ("n",), "label", "id"), 10, 4, 6, 3).isEmpty()
    with pytest.raises(ValueError):
        window.held_out_nearest(df, SPEC, 5, 4, 6, 3)


def test_one_shot_recall_at_the_registered_parameters(spark):
    """On embeddings, against the exact cover."""
    got, want = (found(QUERIES[name](spark, DATA)) for name in ("rbc_oneshot", "rbc_exact"))
    assert sum(len(got[q] & w) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def plain_tree(rows, dims, leaf, path="1"):
    """(leaf path, id) by the rule, in plain Python."""
    width = [max(v) - min(v) if (v := [r[d] for r in rows if r[d] is not None]) else 0.0 for d in dims]
    d = dims[width.index(max(width))]
    if len(rows) <= leaf or max(width) <= 0:
        return [(path, r[0]) for r in rows]
    split = min(r[d] for r in rows if r[d] is not None) + max(width) / 2
    right = [r for r in rows if r[d] is not None and r[d] > split]
    left = [r for r in rows if r[d] is None or r[d] <= split]
    return plain_tree(left, dims, leaf, path + "0") + plain_tree(right, dims, leaf, path + "1")


@pytest.mark.parametrize("whole", [4, 30, 4096])
def test_tree_follows_its_leaf_rule(spark, whole):
    """Missing values, many equal rows, an outlier that makes a long chain; the same tree wherever nodes are finished."""
    rng = random.Random(9)
    rows = [(i, rng.random(), None if i % 6 == 0 else float(rng.randrange(9))) for i in range(120)]
    rows += [(200 + i, 0.5, 4.0) for i in range(40)] + [(300, 1e9, 4.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assigned, nodes = spacetree.build(df, "id", ("x", "y"), 4, whole)
    want = plain_tree(rows, [1, 2], 4)
    assert sorted((r["path"], r["id"]) for r in assigned.collect()) == sorted(want)
    inner = {p[:n] for p, _ in want for n in range(1, len(p))}
    assert sorted(r["path"] for r in nodes.collect()) == sorted(inner)


def test_tree_of_nothing(spark):
    assigned, nodes = spacetree.build(spark.createDataFrame([], "id long, x double"), "id", ("x",))
    assert assigned.count() == nodes.count() == 0


@pytest.mark.parametrize("leaf", [2, 20])
def test_tree_search_is_exact(spark, leaf):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 2)), np.tile([[0.25, 0.25]], (60, 1)), [[1e6, 0.0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    assert found(spacetree.tree_nearest(df, df.filter("id % 10 = 0"), "id", ("x", "y"), 7, leaf)) == truth(x, range(0, len(x), 10), 7)


def test_small_cells_lose_nothing(spark):
    """Cells of few rows, hot cells, missing values: the same as with one cell."""
    rows = mixed_rows(400, 3) + [(1000 + i, 5.0, 0.5, "p", "A") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z double, c string, y string")
    of = ranges.ranges_of(df, SPEC.numeric)
    for raw in (False, True):
        got, want = ({(r["qid"], r["id"], r["d2"]) for r in knn.nearest(df, df.filter("id % 20 = 0"), SPEC, of, 9, raw=raw, leave_one_out=True, skip_identical=raw, per_block=b).collect()} for b in (8, 10**6))
        assert got == want


@pytest.mark.parametrize(("raw", "ties"), [(False, False), (True, False), (False, True), (True, True)])
def test_search_split_by_nominal_attributes_loses_nothing(spark, monkeypatch, raw, ties):
    rng = random.Random(8)
    rows = [(*r[:4], rng.choice(["u", "v", None]), r[4]) for r in mixed_rows(300, 3)] + [(1000 + i, 5.0, 0.5, "p", "u", "A") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, z double, c string, d string, y string")
    spec = FeatureSpec(("x", "z"), ("c", "d"), "y")
    of = ranges.ranges_of(df, spec.numeric)
    ask = lambda: {(r["qid"], r["id"], r["d2"], r["y"]) for r in knn.nearest(df, df.filter("id % 20 = 0"), spec, of, 9, raw=raw, ties=ties, leave_one_out=True, extra=("y",), per_block=8).collect()}
    want = ask()
    monkeypatch.setattr(knn, "MOST_MET", -1)
    monkeypatch.setattr(knn, "MOST_CELLS", -1)
    assert ask() == want


def test_few_numbers_do_not_make_a_search_all_pairs(spark, monkeypatch):
    """Two values of the number, 40 of the name, 20 copies of each pair: a query's 5 nearest are among its copies."""
    monkeypatch.setattr(knn, "MOST_MET", 1000, raising=False)
    monkeypatch.setattr(knn, "MOST_CELLS", 1, raising=False)
    df = spark.range(1600).selectExpr("id", "CAST(id % 2 AS double) AS x", "CAST(id DIV 2 % 40 AS string) AS c")
    spec = FeatureSpec(("x",), ("c",))
    queries = df.filter("id % 100 = 0")
    d2 = knn.measured(spec, ranges.ranges_of(df, spec.numeric))
    pairs = knn.candidates(df, queries, spec, d2, 5, {"x": 0.5}, F.col("qid") != F.col("id"), per_block=16)
    assert pairs.groupBy("qid").count().filter("count < 5 or count > 20").isEmpty() and pairs.select("qid").distinct().count() == 16


def jobs(spark, name, action) -> int:
    spark.sparkContext.setJobGroup(name, name)
    action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_nominal_attributes(spark, monkeypatch):
    """A search that is split runs about as many jobs with twelve nominal attributes as with six, and is right."""
    monkeypatch.setattr(knn, "MOST_MET", -1)
    monkeypatch.setattr(knn, "MOST_CELLS", -1)
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(3)), *(rng.choice("abc") for _ in range(12))) for i in range(300)]
    names = [f"c{j}" for j in range(12)]
    df = spark.createDataFrame(rows, "id long, x double, " + ", ".join(f"{c} string" for c in names))
    took = {}
    for n in (6, 12):
        spec = FeatureSpec(("x",), tuple(names[:n]))
        of = ranges.ranges_of(df, spec.numeric)
        got = {}
        took[n] = jobs(spark, f"nominal {n}", lambda: got.update(found={(r["qid"], r["id"], r["rank"]) for r in knn.nearest(df, df.filter("id % 50 = 0"), spec, of, 4, per_block=16).collect()}))
        d2 = lambda a, b: ((a[1] - b[1]) / 2) ** 2 + sum(x != y for x, y in zip(a[2 : 2 + n], b[2 : 2 + n], strict=True))
        want = {(q[0], i, r) for q in rows if q[0] % 50 == 0 for r, (_, i) in enumerate(sorted((d2(q, b), b[0]) for b in rows)[:4], 1)}
        assert got["found"] == want
    assert took[12] <= 1.1 * took[6], took


@pytest.mark.parametrize("ties", [False, True])
def test_equal_rows_are_met_once(spark, monkeypatch, ties):
    """100,000 equal rows and 200 queries: no query meets them all, unless all are its neighbours."""
    monkeypatch.setattr(knn, "MOST_MET", 10_000)
    monkeypatch.setattr(knn, "MOST_CELLS", 1)
    same = spark.range(100_000).selectExpr("id + 1000 AS id", "5.0D AS x", "'p' AS c", "'A' AS y")
    some = spark.range(1000).selectExpr("id", "CAST(id % 11 AS double) + id / 1e4 AS x", "CAST(id % 3 AS string) AS c", "'B' AS y")
    df, spec = some.union(same), FeatureSpec(("x",), ("c",), "y")
    of = ranges.ranges_of(df, spec.numeric)
    queries = some.filter("id % 5 = 0 AND id % 11 <> 5")
    d2 = knn.measured(spec, of)
    pairs = knn.candidates(df, queries, spec, d2, 3, {"x": 0.5}, F.col("qid") != F.col("id"), ties=ties)
    assert pairs.count() < 200 * 1000
    got = {(r["qid"], r["id"]) for r in knn.ranked(pairs.select("qid", "id", "d2"), 3, ties).collect()}
    rows = [(r.id, r.x, r.c) for r in some.collect()]
    width = of["x"].width
    for q in rows[:200:10]:
        if q[0] % 5 == 0 and q[0] % 11 != 5:
            near = sorted((((q[1] - x) / width) ** 2 + (q[2] != c), i) for i, x, c in rows if i != q[0])[:3]
            assert {i for i in (p[1] for p in got if p[0] == q[0])} >= {i for _, i in near} if ties else {p[1] for p in got if p[0] == q[0]} == {i for _, i in near}
    asked = df.filter("id = 1000")
    near = knn.nearest(df, asked, spec, of, 3, ties=True, leave_one_out=True)
    assert near.count() == 99_999 and near.filter("d2 > 0").isEmpty()


@pytest.mark.parametrize(("shifts", "near"), [(3, 2), (1, 1)])
def test_z_order_search_is_exact(spark, shifts, near):
    """Clusters, equal rows, a far row, missing values: all queries right, and most proved by the rows beside their places."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 2)), np.tile([[0.25, 0.25]], (60, 1)), [[1e4, 0.0]], rng.normal(size=(40, 2)) * 0.01 + 3])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(1000, None, 1.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got, rounds = zorder.nearest(df, df.filter("id % 10 = 0"), "id", ("x", "y"), 7, shifts, near)
    assert found(got) == truth(x, range(0, len(x), 10), 7)
    counts = {r["round"]: r["count"] for r in rounds.groupBy("round").count().collect()}
    assert sum(counts.values()) == len(range(0, len(x), 10)) and set(counts) <= {1, 2}
    if shifts == 3:
        assert counts[1] > 5 and counts[2] > 0


def test_z_order_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (10, 2.0, 5.0)], "id long, x double, y double")
    got, rounds = zorder.nearest(df, df, "id", ("x", "y"), 5)
    assert found(got) == {0: {0, 10}, 10: {0, 10}} and rounds.filter("round = 2").count() == 0
    none = df.filter("id < 0")
    assert zorder.nearest(none, none, "id", ("x", "y"), 5)[0].count() == 0


def test_morton_codes_by_bits(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 20), rng.randrange(1 << 20), rng.randrange(1 << 20)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("*", zorder.interleaved([F.col("a"), F.col("b"), F.col("c")], 20).alias("code")).collect()
    for r in got:
        assert r["code"] == sum((r[n] >> i & 1) << (3 * i + d) for i in range(20) for d, n in enumerate("abc"))


def test_cut_off_search_looks_at_fewer_values(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 6)), np.tile(rng.normal(size=(1, 6)), (20, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = df.filter("id % 50 = 0")
    got = approx.cutoff_nearest(df, asked, "id", "v", 6, 5, group=2)
    assert found(got) == truth(x, range(0, len(x), 50), 5)
    looked = {r["qid"]: (r["points"], r["coordinates"]) for r in approx.cutoff_statistics(df, asked, "id", "v", 6, 5, group=2).collect()}
    assert {n for n, _ in looked.values()} == {len(x)}
    step = max(1, len(x) // (8 * 5 + 4 * int(len(x) ** 0.5)))
    part = {r["id"] for r in df.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).collect()}
    for q, (_, coordinates) in looked.items():
        bound = sorted(((x[sorted(part)] - x[q]) ** 2).sum(axis=1))[4]
        partial = np.cumsum((x - x[q]) ** 2, axis=1)
        assert coordinates == sum(2 + 2 * (p[1] <= bound) + 2 * (p[1] <= bound and p[3] <= bound) for p in partial)
    assert sum(c for _, c in looked.values()) < 0.6 * len(looked) * len(x) * 6


def test_probing_is_exact_with_c_one(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 3)), np.tile([[0.1, 0.2, 0.3]], (50, 1)), [[90.0, 0.0, 0.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 3), (999, None)], "id long, v array<double>")
    got, met = probing.nearest(df, df.filter("id % 20 = 0"), "id", "v", 3, 6, per_bin=20)
    want = truth(x, range(0, len(x), 20), 6)
    assert found(got) == want
    looked = {r["qid"]: (r["rings"], r["points"]) for r in met.collect()}
    assert set(looked) == set(want) and all(r >= 1 and p >= 6 for r, p in looked.values())


def test_probing_stops_early(spark):
    """With c = 3 nine in ten neighbours of points in the plane come from under 0.3 of all pairs, and fewer than with c = 1."""
    rng = np.random.default_rng(6)
    x = rng.random((2000, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked, share, right = df.filter("id % 50 = 0"), {}, {}
    want = truth(x, range(0, 2000, 50), 5)
    for c in (1.0, 3.0):
        got, met = probing.nearest(df, asked, "id", "v", 2, 5, c, per_bin=50)
        near = found(got)
        right[c] = sum(len(near[q] & want[q]) for q in want) / (5 * len(want))
        share[c] = sum(r["points"] for r in met.collect()) / (2000 * len(want))
    assert right[1.0] == 1 and right[3.0] >= 0.9 and share[3.0] < share[1.0] < 0.3, (right, share)


@pytest.mark.parametrize("pairs", [knn.PAIRS, 400])
def test_probing_writes_no_pairs(spark, monkeypatch, pairs):
    """Of the pairs that a query meets at most k are written, and each ring's are dealt to tasks of about ``PAIRS``."""
    sizes, tasks, write, meet = [], [], probing.written, knn.met
    monkeypatch.setattr(knn, "PAIRS", pairs)
    monkeypatch.setattr(knn, "MOST_SENT", knn.MOST_SENT if pairs == knn.PAIRS else 10)

    def told(df):
        df = write(df)
        sizes.append(df.count() if "d2" in df.columns else 0)
        return df

    def dealt(*sides):
        found = meet(*sides)
        tasks.append((found.count(), found.rdd.getNumPartitions()))
        return found

    monkeypatch.setattr(probing, "written", told)
    monkeypatch.setattr(probing, "met", dealt, raising=False)
    x = np.random.default_rng(7).random((3000, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got, met = probing.nearest(df, df.filter("id % 30 = 0"), "id", "v", 2, 5, per_bin=50)
    assert found(got) == truth(x, range(0, 3000, 30), 5)
    assert max(sizes) <= 100 * 5 and sum(n for n, _ in tasks) == met.agg(F.sum("points")).first()[0]
    assert all(n >= made // pairs for made, n in tasks)


def test_bins_grow_with_the_rows(spark):
    df = lambda n: spark.range(n).select("id", F.array(F.col("id").cast("double"), F.sqrt("id")).alias("v"))
    cuts = [len(probing.Bins(df(n), 2, 8, 2, 1).cuts[0]) for n in (10, 800, 3200)]
    assert cuts == [1, 9, 19]


def test_z_order_boxes_across_edges_stay_small(spark):
    """A small box over the middle of all codes is held by a few short stretches, not by all codes between its corners."""
    df = spark.createDataFrame([(i, float(i % 64), float(i // 64)) for i in range(4096)], "id long, x double, y double")
    orders = zorder.Orders(df, ("x", "y"), 1)
    asked = spark.createDataFrame([(0, 31.5, 31.5, 4.0, 2.0), (1, 3.3, 60.1, 1.0, 1.0)], "qid long, q_x double, q_y double, bound double, far double")
    got = orders.spans(orders.boxed(asked), 0).collect()
    rows = orders.stepped(df).select("id", "x", "y", orders.code([F.col("s_x"), F.col("s_y")], 0).alias("code")).collect()
    for q, x, y, _, far in asked.collect():
        inside = {r.id for r in rows if any(g.qid == q and g["from"] <= r.code <= g["to"] for g in got)}
        box = {r.id for r in rows if abs(r.x - x) <= far and abs(r.y - y) <= far}
        assert box <= inside and len(inside) <= 16 * len(box)


def test_pairs_are_dealt_to_tasks(spark, monkeypatch):
    """A search whose queries crowd in a few cells makes its pairs in many tasks, and is right, missing values included."""
    monkeypatch.setattr(knn, "PAIRS", 2000)
    rng = random.Random(9)
    gap = lambda v, share: None if rng.random() < share else v
    rows = [(i, gap(float(rng.choice((0, 0, 0, 1, rng.random()))), 0.05), gap(rng.random(), 0.05), gap(rng.choice("ab"), 0.1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string").repartition(2)
    spec, queries = FeatureSpec(("x", "y"), ("c",)), df.filter("id % 10 = 0")
    of = ranges.ranges_of(df, spec.numeric)
    got = {(r["qid"], r["rank"]): (r["id"], r["d2"]) for r in knn.nearest(df, queries, spec, of, 4, per_block=64, leave_one_out=True).collect()}
    pairs = queries.select("id").join(df.withColumnsRenamed({"id": "to"}).select("to"), F.lit(True)).count()
    d2 = knn.measured(spec, of)
    every = knn.sided(queries, spec).join(df.select("id", *spec.attributes), F.col("qid") != F.col("id")).select("qid", "id", d2.alias("d2"))
    want = {(r["qid"], r["rank"]): (r["id"], r["d2"]) for r in knn.ranked(every, 4).collect()}
    assert len(want) == 600 and got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want) and sum(got[k][0] == want[k][0] for k in want) > 590
    one = lambda source, key: source.select(F.lit(0).alias("cell"), F.col("id").alias(key))
    made = knn.met(one(df, "id"), one(queries, "qid"), spark.sql("SELECT 0 AS cell, 1500L AS n"))
    most = made.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    assert made.count() == pairs and most < pairs / 4


@pytest.mark.parametrize("rule", ["max", "mid"])
def test_large_nodes_of_a_forest_take_no_round_a_level(spark, monkeypatch, rule):
    """Nodes over WHOLE rows are split by a sample in a few rounds: all rows get a leaf of at most its size, or of equal rows."""
    monkeypatch.setattr(spacetree, "WHOLE", 400)
    monkeypatch.setattr(spacetree, "FITTED", 600, raising=False)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random((4000, 2)), np.tile([[0.5, 0.5]], (900, 1)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [None, 0.1])], "id long, v array<double>")
    got = {}
    count = jobs(spark, f"forest {rule}", lambda: got.update(leaves=spacetree.random_tree(df, "id", "v", 2, 16, rule).collect()))
    held = {}
    for r in got["leaves"]:
        held.setdefault(r["leaf"], []).append(r["id"])
    assert sorted(i for ids in held.values() for i in ids) == [-2, *range(4901)]
    assert all(len(ids) <= 16 or all(4000 <= i < 4900 or i == -2 for i in ids) for ids in held.values())
    assert count < 40, count


def test_a_bound_reaches_few_coarse_cells(spark):
    """Queries meet the coarse cells between their bound's corners, not all of them; without a bound they meet all."""
    df = spark.range(20_000).selectExpr("id", "CAST(id % 200 AS double) / 199 AS x", "CAST(id DIV 200 AS double) / 99 AS y")
    dims, half = ("x", "y"), {"x": 0.5, "y": 0.5}
    grid = blocks.laid(df, dims, 16)
    boxes = blocks.boxes(grid.placed(df), ["coarse"], dims)
    asked = df.filter("id % 1000 = 77").selectExpr("id AS qid", "x AS q_x", "y AS q_y", "IF(id = 77, NULL, 1e-4D) AS bound")
    met = grid.reached(asked, half, {"x": 1.0, "y": 1.0}).join(boxes, "coarse")
    every = asked.join(boxes, blocks.in_reach(dims, half))
    near = {(r.qid, r.coarse) for r in met.filter(blocks.in_reach(dims, half)).collect()}
    assert near == {(r.qid, r.coarse) for r in every.select("qid", "coarse").collect()}
    assert met.filter("bound IS NOT NULL").count() <= 19 * 16 and met.filter("bound IS NULL").count() == boxes.count()
