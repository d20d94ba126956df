"""Hand cases: differences, votes, ties, ranges, options, sources."""

import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearwin.functions import distance as D
from nearwin.operators import evaluate, knn, primitives, ranges, spacetree, votes
from nearwin.plans.ordering import bucket_of
from nearwin.plans.shared import shared_dir
from nearwin.queries import SAMPLE_ARFF, SAMPLE_LOG
from nearwin.sources.registry import open_source
from nearwin.spec import FeatureSpec, SearchOptions, places
from nearwin.streaming import window as live

TEN = D.Range(0.0, 10.0)


@pytest.mark.parametrize(
    ("a", "b", "raw", "want"),
    [(2.0, 4.0, False, -0.2), (None, 2.0, False, 0.8), (None, 7.0, False, 0.7), (2.0, None, False, 0.8), (None, None, False, 1.0), (None, None, True, 10.0), (None, 2.0, True, 8.0), (2.0, 4.0, True, -2.0)],
)
def test_numeric_difference(spark, a, b, raw, want):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(D.numeric_difference(F.col("a"), F.col("b"), TEN, raw)).first()[0] == pytest.approx(want)


def test_no_width_adds_nothing(spark):
    df = spark.createDataFrame([(3.0, 3.0)], "a double, b double")
    assert df.select(D.numeric_difference(F.col("a"), F.col("b"), D.Range(3.0, 3.0))).first()[0] == 0


@pytest.mark.parametrize(("a", "b", "want"), [("x", "x", 0), ("x", "y", 1), (None, "y", 1), (None, None, 1)])
def test_nominal_difference(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(D.nominal_difference(F.col("a"), F.col("b"))).first()[0] == want


SPEC = FeatureSpec(("x",), (), "y")


def rows(spark, values):
    return spark.createDataFrame([(i, float(v), "A" if i % 2 else "B") for i, v in enumerate(values)], "id long, x double, y string")


def test_ties(spark):
    df, q = rows(spark, [1, 2, 2, 2, 3]), spark.createDataFrame([(9, 0.0, "A")], "id long, x double, y string")
    of = {"x": D.Range(0.0, 3.0)}
    assert knn.nearest(df, q, SPEC, of, 2, ties=True, raw=True).count() == 4
    assert [r["id"] for r in knn.nearest(df, q, SPEC, of, 2, raw=True).orderBy("rank").collect()] == [0, 1]
    assert knn.nearest(df, q, SPEC, of, 50, raw=True).count() == 5


def test_votes(spark):
    near = spark.createDataFrame([(1, "A", 0.0), (1, "A", 0.0)], "qid long, label string, d2 double")
    got = {r["label"]: r["p"] for r in votes.distribution(near, ["A", "B"], 4, votes.weight("none", 1)).collect()}
    assert got == {"A": pytest.approx(0.9), "B": pytest.approx(0.1)}
    assert near.select(votes.weight("inverse", 3)).first()[0] == pytest.approx(1000)
    assert votes.predicted(spark.createDataFrame([(1, "B", 0.5), (1, "A", 0.5)], "qid long, label string, p double")).first()["label"] == "A"


def test_kappa_is_null_where_chance_is_certain(spark):
    made = spark.createDataFrame([(1, "A", "A"), (2, "A", "A")], "qid long, truth string, label string")
    assert evaluate.kappa(made).first()["kappa_pct"] is None
    half = spark.createDataFrame([(1, "A", "A"), (2, "A", "B"), (3, "B", "A"), (4, "B", "B")], "qid long, truth string, label string")
    assert evaluate.kappa(half).first()["kappa_pct"] == 0


def test_window_of_two(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 4)], "id long, v double")
    got = ranges.windowed(df, "id", 2, {"low": F.min("v"), "n": F.count(F.lit(1))}, block=2).orderBy("id").select("id", "low", "n").collect()
    assert [tuple(r) for r in got] == [(1, None, 0), (2, 1.0, 1), (3, 1.0, 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.integers(1, 5))
def test_tree_finds_the_k_nearest(spark, values, k):
    df = spark.createDataFrame([(i, float(v), float(v * v % 7)) for i, v in enumerate(values)], "id long, x double, z double")
    got = spacetree.tree_nearest(df, df.filter("id = 0"), "id", ("x", "z"), k, leaf=4).orderBy("rank").collect()
    d2 = sorted(((values[0] - v) ** 2 + (values[0] ** 2 % 7 - v * v % 7) ** 2, i) for i, v in enumerate(values))[:k]
    assert [(r["d2"], r["id"]) for r in got] == d2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-100, 100), max_size=30, unique=True), st.integers(-110, 110))
def test_bucket_of(spark, bounds, key):
    bounds = sorted(bounds)
    assert spark.range(1).select(bucket_of(F.lit(key), bounds)).first()[0] == sum(b <= key for b in bounds)


def test_scans_on_many_buckets(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 1013).alias("v"))
    got = [r["inclusive"] for r in primitives.prefix_sums(df, "id", "v").orderBy("id").collect()]
    total, want = 0, []
    for i in range(5000):
        total += i * 7919 % 1013
        want.append(total)
    assert got == want
    order = [r["id"] for r in primitives.sort_positions(df, "v", "id").orderBy("position").collect()]
    assert order == sorted(range(5000), key=lambda i: (i * 7919 % 1013, i))


def test_small_arithmetic(spark):
    values = [0, 1, 2, 3, 4, 5, 1023, 1024, 1025]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(primitives.next_power_of_two(F.col("v"))).collect()] == [1, 1, 2, 4, 4, 8, 1024, 1024, 2048]
    assert [r[0] for r in df.select(primitives.round_up(F.col("v"), 4)).collect()] == [math.ceil(v / 4) * 4 for v in values]


def test_options():
    assert places("first-2,last", 4) == [0, 1, 3]
    assert SearchOptions.parse("-R 2-3 -S").text() == "-R 2-3 -S"
    with pytest.raises(ValueError):
        SearchOptions.parse("-Q")
    with pytest.raises(ValueError):
        places("3-9", 4)


def test_arff(spark, tmp_path):
    path = tmp_path / "a.arff"
    path.write_text(SAMPLE_ARFF)
    df = open_source(spark, "arff", str(path))
    assert df.columns == ["period", "price now", "class"]
    assert [tuple(r) for r in df.collect()] == [(0.0, 0.5, "UP"), (1.0, None, "DOWN"), (0.0, 2.5, "UP")]


def test_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(SAMPLE_LOG)
    df = open_source(spark, "log", str(path))
    assert df.count() == 12 and df.filter("section = 2").first()["window"] == 128
    assert df.filter("kappa_temporal_pct IS NULL").count() == 5


def test_generators_repeat(spark):
    for name in ("random_tree", "radial"):
        a, b = (open_source(spark, name, rows=25_000, seed=3, partitions=n).orderBy("id").limit(50).collect() for n in (1, 4))
        assert a == b
    assert open_source(spark, "random_tree", rows=25_000, seed=3).count() == 25_000


def test_trimmed_median(spark):
    """Groups over many buckets, with ties, gaps, a missing group and too few values, against plain Python."""
    rows = [("a", float(i * 7919 % 3001) / 4) for i in range(3001)] + [("b", 2.5)] * 900 + [("b", None)] * 50 + [("c", 1.0), ("c", 2.0), ("d", None)] + [(None, float(i)) for i in range(6)]
    got = dict(tuple(r) for r in primitives.trimmed_median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect())
    of = lambda g: sorted(v for h, v in rows if h == g and v is not None)[1:-1]
    assert got == {g: statistics.median(of(g)) if of(g) else None for g in ("a", "b", "c", "d", None)}


def test_stream_windows_and_missing_classes(spark, tmp_path):
    """Rows out of order in two batches; a missing class has no vote, a row without a place no part."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "key string, at long, x double, y string"
    data = [("k", i, float(i), None if i < 4 else "A") for i in range(12)]
    for name, made in (("windows", lambda s: live.windows(s, "key", "at", 3)), ("votes", lambda s: live.classify(s, "key", "at", ["x"], "y", 3, 2))):
        for part in (data[5::-1], [*data[:5:-1], ("k", None, 1.0, "B"), (None, 7, 1.0, "B")]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{name}")
            stream = made(spark.readStream.schema(schema).parquet(f"{source}/{name}"))
            stream.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/state-{name}").trigger(availableNow=True).start().awaitTermination()
    held = sorted(tuple(r) for r in spark.read.parquet(f"{out}/windows").filter("key IS NOT NULL").select("at", "held", "first").collect())
    assert held == [(i, min(i, 3), max(0, i - 3) if i else None) for i in range(12)]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/windows").filter("key IS NULL").select("at", "held", "first").collect()] == [(7, 0, None)]
    said = {r["at"]: r["label"] for r in spark.read.parquet(f"{out}/votes").collect()}
    assert said == {i: None if i < 5 else "A" for i in range(3, 12)}


def test_no_local_folder_on_a_cluster():
    class Cluster:
        sparkContext = type("Context", (), {"master": "spark://host:7077"})
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)


def test_stream_matches_batch(spark, tmp_path):
    """A stream in two batches, restarted from its checkpoint, keeps the window that one batch has."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "key string, at long, x double, y string"
    data = [("k", i, float(i * 37 % 11), "A" if i * 37 % 11 < 6 else "B") for i in range(60)]
    for n, part in enumerate((data[:33], data[33:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        made = live.classify(stream, "key", "at", ["x"], "y", 16, 3)
        made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r["at"]: r["label"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert sorted(got) == list(range(16, 60))
    for at in got:
        held = data[at - 16 : at]
        low, high = min(h[2] for h in held), max(h[2] for h in held)
        near = sorted(range(16), key=lambda i: (((held[i][2] - low) / (high - low) - (data[at][2] - low) / (high - low)) ** 2, i))[:3]
        labels = [held[i][3] for i in near]
        assert got[at] == max("AB", key=lambda c: (labels.count(c), c == "A"))
