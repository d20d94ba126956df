"""Searches, metrics, weights and options given by name, against a brute-force classifier."""

import random

import pytest

from nearwin.operators import classifier
from nearwin.spec import FeatureSpec, SearchOptions

SPEC = FeatureSpec(("x", "z"), ("c",), "y")
NUMBERS = FeatureSpec(("x", "z"), (), "y")


def table(seed=2, n=150):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0.0, 1.0, rng.gauss(0, 4)]), rng.random() * 10, rng.choice("ab"), rng.choice("uvw")) for i in range(n)]
    return rows + [(n + i, *rows[i][1:]) for i in range(10)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, z double, c string, y string")


def brute(rows, queries, numbers, names, options, metric, k, loo):
    place = {"x": 1, "z": 2, "c": 3}
    low = {a: min(r[place[a]] for r in rows) for a in numbers}
    width = {a: max(r[place[a]] for r in rows) - low[a] for a in numbers}
    out = {}
    for q in queries:
        found = []
        for r in rows:
            diffs = [abs(q[place[a]] - r[place[a]]) / (1 if options.raw else width[a]) for a in numbers] + [float(q[place[a]] != r[place[a]]) for a in names]
            d = {"euclidean": sum(x * x for x in diffs), "manhattan": sum(diffs), "chebyshev": max(diffs)}[metric]
            if not (loo and r[0] == q[0]) and not (options.skip_identical and d == 0):
                found.append((round(d, 9), r[0]))
        out[q[0]] = sorted(found)[:k]
    return out


@pytest.mark.parametrize(("search", "metric", "spec", "text", "loo"), [
    ("cells", "euclidean", SPEC, "-R first-last", True), ("pairs", "euclidean", SPEC, "-R 2-last -D", False), ("cells", "euclidean", SPEC, "-R 2 -V -S", False),
    ("cells", "euclidean", SPEC, "-R 1,3 -D -S", True), ("ball_tree", "manhattan", NUMBERS, "-R first-last", True),
    ("ball_tree", "chebyshev", NUMBERS, "-R first-last -D", False), ("cover_tree", "euclidean", NUMBERS, "-R first-last", True),
])
def test_neighbours(spark, search, metric, spec, text, loo):
    rows, options = table(), SearchOptions.parse(text)
    df = frame(spark, rows)
    model = classifier.KnnClassifier(5, search, metric, options=options, leave_one_out=loo).fit(df, spec)
    got = {}
    for r in model.neighbours(df.filter("id % 10 = 0")).collect():
        got.setdefault(r.qid, []).append((round(r.d2, 9), r.id))
        assert r.label == next(x[4] for x in rows if x[0] == r.id)
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], model.spec.numeric, model.spec.nominal, options, metric, 5, loo)
    for q, near in want.items():
        assert [d for d, _ in sorted(got[q])] == [d for d, _ in near]
        assert len({i for _, i in got[q]} & {i for _, i in near}) >= 4 or [d for d, _ in near].count(near[-1][0]) > 1


def test_fit_update_transform(spark):
    rows = table()
    df = frame(spark, rows)
    made = classifier.KnnClassifier(3, "pairs", weights="inverse", window=10)
    first, both = made.fit(df.filter("id < 100"), SPEC), made.fit(df, SPEC)
    said = lambda m: sorted(tuple(r) for r in m.transform(df.filter("id % 10 = 0")).collect())
    assert said(first.updated(df.filter("id >= 100"))) == said(both)
    for r in both.transform(df.filter("id % 10 = 0")).collect():
        assert r.truth == next(x[4] for x in rows if x[0] == r.qid) and 0 < r.p <= 1
    sums = both.votes(df.filter("id = 0")).groupBy().sum("p").first()[0]
    assert abs(sums - 1) < 1e-9


def test_what_a_search_cannot_do_is_said(spark):
    df = frame(spark, table(n=20))
    for made, spec in ((classifier.KnnClassifier(search="ball_tree"), SPEC), (classifier.KnnClassifier(metric="manhattan"), SPEC), (classifier.KnnClassifier(search="ball_tree", options=SearchOptions(skip_identical=True)), NUMBERS)):
        with pytest.raises(ValueError, match="alone|skip"):
            made.fit(df, spec).neighbours(df)
