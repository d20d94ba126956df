"""One query an operator, over whole tables, and the SQL that it is held against."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.functions import distance as D
from nearwin.operators import approx, balls, classifier, evaluate, knn, primitives, probing, ranges, spacetree, votes, window, zorder
from nearwin.plans.shared import written
from nearwin.sources.evallog import COLUMNS, read_log, summary
from nearwin.sources.registry import open_source
from nearwin.spec import FeatureSpec, SearchOptions, places
from nearwin.streaming import progress
from nearwin.streaming import window as live
from nearwin.streaming import windows as live_windows
from nearwin.tables import DIMS, GAPPED_SQL, ORDERS, ORDERS_SQL, PARTS, asked, gapped, orders, table

K, WINDOW, BUCKETS = 16, 128, 16
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            rest = sql.removeprefix("WITH RECURSIVE ") if sql.startswith("WITH RECURSIVE ") else None
            ORACLES[name or f.__name__] = f"WITH RECURSIVE o AS ({ORDERS_SQL}), g AS ({GAPPED_SQL}), {rest}" if rest else f"WITH o AS ({ORDERS_SQL}), g AS ({GAPPED_SQL}) {sql}" if not sql.startswith("WITH") else f"WITH o AS ({ORDERS_SQL}), g AS ({GAPPED_SQL}), {sql[5:]}"
        return f

    return add


# --- SQL text of distances

LIMITS_SQL = "r AS (SELECT min(price) AS a1, max(price) AS b1, min(day) AS a2, max(day) AS b2 FROM {t})"


def norm_sql(x: str, i: int) -> str:
    return f"CASE WHEN r.b{i} > r.a{i} THEN ({x} - r.a{i}) / (r.b{i} - r.a{i}) ELSE 0 END"


def diff_sql(a: str, b: str, i: int) -> str:
    far = lambda v: f"(CASE WHEN {norm_sql(v, i)} < 0.5 THEN 1.0::DOUBLE - {norm_sql(v, i)} ELSE {norm_sql(v, i)} END)"
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0::DOUBLE WHEN {a} IS NULL THEN {far(b)} WHEN {b} IS NULL THEN {far(a)} ELSE {norm_sql(a, i)} - {norm_sql(b, i)} END)"


def d2_sql(a: str, b: str) -> str:
    x, y = diff_sql(f"{a}.price", f"{b}.price", 1), diff_sql(f"{a}.day", f"{b}.day", 2)
    return f"({x} * {x} + {y} * {y} + (CASE WHEN {a}.priority = {b}.priority THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END))"


PAIRS_SQL = "q AS (SELECT * FROM o WHERE id % 100 = 0), " + LIMITS_SQL.format(t="o") + f", p AS (SELECT q.id AS qid, o.id AS id, {d2_sql('q', 'o')} AS d2, o.label AS label, q.label AS truth FROM q, o, r)"
NEAR_SQL = PAIRS_SQL + f", n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p WHERE qid <> id QUALIFY rank <= {K})"


def own_query(df: DataFrame, key: str = "id", columns: tuple[str, ...] = ()) -> DataFrame:
    """Each row beside the query row of its hundred."""
    q = asked(df, key).select(F.col(key).alias("qid"), *(F.col(c).alias(f"q_{c}") for c in columns))
    return df.join(q, F.col(key) - F.col(key) % 100 == F.col("qid"))


OWN_SQL = "FROM {t} o JOIN {t} q ON q.id = o.id - o.id % 100, r"

# --- Sources


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_by_name(spark, sf_dir):
    return open_source(spark, "parquet", f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT id, price AS x0, day AS x1, priority AS c0, 2 AS numbers, 1 AS names FROM o")
def feature_vector(spark, sf_dir):
    v = orders(spark, sf_dir).select("id", F.array(*ORDERS.numeric).alias("x"), F.array(*ORDERS.nominal).alias("c"))
    return v.select("id", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"), F.get("c", F.lit(0)).alias("c0"), F.size("x").alias("numbers"), F.size("c").alias("names"))


@query("""SELECT column_name AS name, CASE WHEN data_type IN ('VARCHAR') THEN 'nominal' ELSE 'numeric' END AS kind,
row_number() OVER (ORDER BY CASE WHEN data_type = 'VARCHAR' THEN 1 ELSE 0 END, ordinal_position) AS place
FROM information_schema.columns WHERE table_name = 'part' AND column_name <> 'p_partkey' AND (data_type = 'VARCHAR' OR data_type IN ('INTEGER', 'BIGINT', 'DOUBLE'))""")
def feature_spec(spark, sf_dir):
    spec = FeatureSpec.infer(table(spark, sf_dir, "part"), "p_partkey")
    rows = [(c, "numeric" if c in spec.numeric else "nominal", i) for i, c in enumerate(spec.attributes, 1)]
    return spark.createDataFrame(rows, "name string, kind string, place long")


SAMPLE_ARFF = """@relation sample
@attribute period numeric
@attribute 'price now' real
@attribute class {UP,DOWN}
@data
% dense, missing and sparse rows
0.0,0.5,UP
1.0,?,DOWN
{1 2.5, 2 UP}
"""


def text_file(spark, text: str, name: str) -> str:
    """A small text in a file that this process and its local executors can open."""
    path = os.path.join(tempfile.mkdtemp(prefix="nearwin-"), name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


@query()
def scan_arff(spark, sf_dir):
    return open_source(spark, "arff", text_file(spark, SAMPLE_ARFF, "sample.arff"))


@query()
def scan_memory(spark, sf_dir):
    return spark.createDataFrame([(1, 3.0, 3.0, 3.0), (2, 2.0, 2.0, 2.0), (3, 3.0, 3.0, 3.0)], "id long, a double, b double, label double")


@query()
def gen_random_tree(spark, sf_dir):
    return open_source(spark, "random_tree", rows=20_000, numerics=4, nominals=4, seed=7)


@query()
def gen_rbf(spark, sf_dir):
    return open_source(spark, "radial", rows=20_000, numerics=8, seed=7)


SAMPLE_LOG = "Test : window=128 k =32\n     : test_size=1000 train_size =1000000\nStream: a stream\n------Classifier:first\n" + ",".join(COLUMNS) + "\n" + "".join(f"{i}00000.0,1.5,{i}1000.5,1.4,{i}2000.25,0.1,{7 * i}00.5,1000.0,6{i}.5,25.{i},28.{i},{i}00000.0,0.0\n" for i in range(1, 8)) + "-" * 75 + "\n------Classifier:second\n" + "".join(f"{i}00000.0,1.5,{i}100.5,1.4,{i}200.25,0.1,{9 * i}00.5,1000.0,6{i}.5,25.{i},?,{i}00000.0,0.0\n" for i in range(1, 6))


@query()
def log_scan(spark, sf_dir):
    return open_source(spark, "log", text_file(spark, SAMPLE_LOG, "sample.txt")).drop("file")


@query()
def log_summary(spark, sf_dir):
    return summary(read_log(spark, text_file(spark, SAMPLE_LOG, "sample.txt")))


@query()
def options_roundtrip(spark, sf_dir):
    texts = ["-R first-last", "-R 1,3-last -V", "-R 2-3 -D -S"]
    rows = [(t, SearchOptions.parse(t).text(), SearchOptions.parse(SearchOptions.parse(t).text()) == SearchOptions.parse(t)) for t in texts]
    return spark.createDataFrame(rows, "given string, written string, same boolean")


# --- Projections and predicates


@query("WITH " + LIMITS_SQL.format(t="o") + f" SELECT id, {norm_sql('price', 1)} AS price, {norm_sql('day', 2)} AS day FROM o, r")
def normalize_minmax(spark, sf_dir):
    df = orders(spark, sf_dir)
    of = ranges.ranges_of(df, ORDERS.numeric)
    return df.select("id", *(of[c].norm(F.col(c)).alias(c) for c in ORDERS.numeric))


@query("SELECT id, price, priority FROM o")
def attr_select(spark, sf_dir):
    return orders(spark, sf_dir).select("id", *ORDERS.select("first,last").attributes)


@query("SELECT id, day FROM o")
def attr_select_inverted(spark, sf_dir):
    return orders(spark, sf_dir).select("id", *ORDERS.select("first,last", invert=True).attributes)


@query("""WITH r AS (
  SELECT min(price) AS a1, max(price) AS b1, min(day) AS a2, max(day) AS b2 FROM g WHERE id % 97 = 1
)
SELECT id, coalesce(price IS NULL OR price BETWEEN a1 AND b1, false) AND coalesce(day IS NULL OR day BETWEEN a2 AND b2, false) AS inside FROM g, r""")
def in_ranges(spark, sf_dir):
    """Rows within the ranges of some: those whose id leaves 1 by 97. A range of no seen value holds no value."""
    df = gapped(spark, sf_dir)
    return df.select("id", ranges.in_ranges(ranges.ranges_of(df.filter("id % 97 = 1"), ORDERS.numeric)).alias("inside"))


@query("WITH " + LIMITS_SQL.format(t="o") + " SELECT id, price <= a1 + (b1 - a1) / 2 AS low FROM o, r")
def split_predicate(spark, sf_dir):
    df = orders(spark, sf_dir)
    return df.select("id", (F.col("price") <= ranges.middle(ranges.ranges_of(df, ("price",))["price"])).alias("low"))


@query("WITH " + LIMITS_SQL.format(t="o") + " SELECT a1 + (b1 - a1) / 2 AS price, a2 + (b2 - a2) / 2 AS day FROM r")
def range_middle(spark, sf_dir):
    t = ranges.range_table(orders(spark, sf_dir), ORDERS.numeric)
    return t.select(*((F.col(f"{c}_min") + F.col(f"{c}_width") / 2).alias(c) for c in ORDERS.numeric))


BUCKET_SQL = f"least(floor((price - a1) / ((b1 - a1) / {BUCKETS})), {BUCKETS - 1})::INTEGER"


def order_bucket(df: DataFrame):
    r = ranges.ranges_of(df, ("price",))["price"]
    return primitives.bucket_index(F.col("price"), r.low, r.high, BUCKETS)


@query("WITH " + LIMITS_SQL.format(t="o") + f" SELECT id, {BUCKET_SQL} AS bucket FROM o, r")
def bucket_assign(spark, sf_dir):
    df = orders(spark, sf_dir)
    return df.select("id", order_bucket(df).alias("bucket"))


@query("WITH " + LIMITS_SQL.format(t="o") + f", b AS (SELECT id, {BUCKET_SQL} AS bucket FROM o, r) SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) - 1 AS position FROM b")
def bucket_compact(spark, sf_dir):
    df = orders(spark, sf_dir)
    return primitives.compacted(df, "id", order_bucket(df))


@query("SELECT id, (cust >> 4) & 15 AS digit FROM o")
def digit_extract(spark, sf_dir):
    return orders(spark, sf_dir).select("id", primitives.digit(F.col("cust"), 4).alias("digit"))


@query("WITH s AS (SELECT id - lag(id) OVER (ORDER BY id) AS d FROM o) SELECT coalesce(bool_and(d = 1), true) AS is_prefix_sum FROM s WHERE d IS NOT NULL")
def is_prefix_sum(spark, sf_dir):
    return primitives.steps_by_one(orders(spark, sf_dir), "id", "id")


@query("SELECT id, CASE WHEN cust <= 1 THEN 1 ELSE (1 << length(ltrim(bin(cust - 1), '0')))::BIGINT END AS power FROM o")
def next_pow2(spark, sf_dir):
    return orders(spark, sf_dir).select("id", primitives.next_power_of_two(F.col("cust")).alias("power"))


@query("SELECT id, ((cust + 63) // 64 * 64)::BIGINT AS rounded FROM o")
def round_up(spark, sf_dir):
    return orders(spark, sf_dir).select("id", primitives.round_up(F.col("cust"), 64).alias("rounded"))


# --- Distances: each row against the query row of its hundred


def mixed(df: DataFrame, spec: FeatureSpec, raw: bool = False) -> DataFrame:
    d2 = knn.measured(spec, ranges.ranges_of(df, spec.numeric), raw)
    return own_query(df, spec.key, spec.attributes).select("id", "qid", d2.alias("d2"))


MIXED_SQL = f"SELECT o.id, q.id AS qid, {d2_sql('q', 'o')} AS d2 " + OWN_SQL


@query("WITH " + LIMITS_SQL.format(t="o") + " " + MIXED_SQL.format(t="o"))
def distance_mixed(spark, sf_dir):
    return mixed(orders(spark, sf_dir), ORDERS)


@query("WITH " + LIMITS_SQL.format(t="g") + " " + MIXED_SQL.format(t="g"))
def distance_missing(spark, sf_dir):
    return mixed(gapped(spark, sf_dir), ORDERS)


@query("WITH " + LIMITS_SQL.format(t="o") + " " + MIXED_SQL.format(t="o").replace(" AS d2", " AS d2x").replace("SELECT o.id, q.id AS qid", "SELECT id, qid, sqrt(d2x) AS d FROM (SELECT o.id, q.id AS qid", 1) + ")")
def distance_euclidean(spark, sf_dir):
    return mixed(orders(spark, sf_dir), ORDERS).select("id", "qid", F.sqrt("d2").alias("d"))


@query("WITH " + LIMITS_SQL.format(t="o") + ", m AS (" + MIXED_SQL.format(t="o") + ") SELECT id, qid, CASE WHEN d2 > 0.5 THEN 'Infinity'::DOUBLE ELSE d2 END AS d2 FROM m")
def distance_cutoff(spark, sf_dir):
    return mixed(orders(spark, sf_dir), ORDERS).select("id", "qid", D.cut_off(F.col("d2"), 0.5).alias("d2"))


@query("SELECT o.id, q.id AS qid, (q.price - o.price) * (q.price - o.price) + (q.day - o.day) * (q.day - o.day) + (CASE WHEN o.priority = q.priority THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS d2 FROM o JOIN o q ON q.id = o.id - o.id % 100")
def distance_raw(spark, sf_dir):
    return mixed(orders(spark, sf_dir), ORDERS, raw=True)


@query("WITH " + LIMITS_SQL.format(t="o") + f" SELECT o.id, q.id AS qid, {diff_sql('q.price', 'o.price', 1)} * {diff_sql('q.price', 'o.price', 1)} AS d2 " + OWN_SQL.format(t="o"))
def sq_difference(spark, sf_dir):
    return mixed(orders(spark, sf_dir), ORDERS.select("first"))


@query("""SELECT e.vec_id AS id, q.vec_id AS qid, list_reduce(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)), lambda x, y: x + y) AS d2
FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id - e.vec_id % 100""")
def distance_array_fold(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return own_query(df, "id", ("v",)).select("id", "qid", D.array_squared(F.col("q_v"), F.col("v")).alias("d2"))


SPARSE_SQL = "coalesce(CASE WHEN {t}.id % 2 = 0 THEN {t}.price END, 0)", "coalesce(CASE WHEN {t}.id % 3 = 0 THEN {t}.day END, 0)"


@query("SELECT o.id, q.id AS qid, " + " + ".join(f"({s.format(t='q')} - {s.format(t='o')}) * ({s.format(t='q')} - {s.format(t='o')})" for s in SPARSE_SQL) + " AS d2 FROM o JOIN o q ON q.id = o.id - o.id % 100")
def distance_sparse(spark, sf_dir):
    entries = F.filter(F.array(F.struct(F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, F.col("price")).alias("v")), F.struct(F.lit(2).alias("k"), F.when(F.col("id") % 3 == 0, F.col("day")).alias("v"))), lambda e: e["v"].isNotNull())
    df = orders(spark, sf_dir).select("id", F.map_from_entries(entries).alias("m"))
    return own_query(df, "id", ("m",)).select("id", "qid", D.sparse_squared(F.col("q_m"), F.col("m")).alias("d2"))


@query("WITH " + PAIRS_SQL + " SELECT id, arg_min(qid, (d2, qid)) AS nearest, min(d2) AS d2 FROM p GROUP BY id")
def closest_point(spark, sf_dir):
    """Each row's nearest of the query set: a search among those, asked by all rows, so its cells are small."""
    df = orders(spark, sf_dir)
    near = knn.nearest(asked(df), df, ORDERS, ranges.ranges_of(df, ORDERS.numeric), 1, per_block=32)
    return near.select(F.col("qid").alias("id"), F.col("id").alias("nearest"), "d2")


# --- Ranges


def range_sql(source: str) -> str:
    return "SELECT " + ", ".join(f"coalesce(min({c}), 'Infinity'::DOUBLE) AS {c}_min, coalesce(max({c}), '-Infinity'::DOUBLE) AS {c}_max, coalesce(max({c}) - min({c}), 'Infinity'::DOUBLE) AS {c}_width" for c in ORDERS.numeric) + f" FROM {source}"


@query(range_sql("g"))
def ranges_all(spark, sf_dir):
    return ranges.range_table(gapped(spark, sf_dir), ORDERS.numeric)


@query(range_sql("g WHERE id IN (SELECT c_custkey FROM customer)"))
def ranges_subset(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return ranges.range_table(gapped(spark, sf_dir).join(ids, "id", "left_semi"), ORDERS.numeric)


@query(range_sql("(SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM g) WHERE position BETWEEN 200 AND 900"))
def ranges_slice(spark, sf_dir):
    return ranges.range_table(ranges.positioned(gapped(spark, sf_dir), "id").filter(F.col("position").between(200, 900)), ORDERS.numeric)


@query(range_sql("g WHERE price < 0"))
def ranges_empty(spark, sf_dir):
    return ranges.range_table(gapped(spark, sf_dir).filter("price < 0"), ORDERS.numeric)


@query("SELECT id, min(price) OVER w AS price_min, max(price) OVER w AS price_max, min(day) OVER w AS day_min, max(day) OVER w AS day_max FROM g WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def ranges_running(spark, sf_dir):
    return ranges.running_ranges(gapped(spark, sf_dir), "id", ORDERS.numeric)


@query(f"SELECT event_id, min(value) OVER w AS value_min, max(value) OVER w AS value_max, count(*) OVER w AS held FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)")
def ranges_sliding(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    made = ranges.windowed(df, "event_id", WINDOW, {"value_min": F.min("value"), "value_max": F.max("value"), "held": F.count(F.lit(1))})
    return made.select("event_id", "value_min", "value_max", "held")


# --- Joins and windows


@query(f"WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events) SELECT q.event_id AS qid, e.event_id AS id FROM e q JOIN e ON e.position >= q.position - {WINDOW} AND e.position < q.position WHERE q.event_id % 100 = 0")
def window_members(spark, sf_dir):
    at = written(ranges.positioned(table(spark, sf_dir, "events").select("event_id"), "event_id"))
    queries = asked(at, "event_id").select(F.col("event_id").alias("qid"), F.col("position").alias("q_at"))
    return window.members(at.select(F.col("event_id").alias("id"), "position"), queries, WINDOW).select("qid", "id")


EVENTS = FeatureSpec(("value", "hour"), ("user",), "event_type", "event_id")
STREAM_SQL = f"""e AS (SELECT event_id AS id, value, hour(ts)::DOUBLE AS hour, user_id AS user, event_type AS label, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events),
w AS (SELECT *, min(value) OVER f AS a1, max(value) OVER f AS b1, min(hour) OVER f AS a2, max(hour) OVER f AS b2 FROM e WINDOW f AS (ORDER BY position ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
d AS (SELECT r.id AS qid, e.id, e.label, {norm_sql("r.value", 1)} - {norm_sql("e.value", 1).replace("ELSE 0 END", "ELSE 0.0::DOUBLE END")} AS x, {norm_sql("r.hour", 2)} - {norm_sql("e.hour", 2)} AS y, CASE WHEN r.user = e.user THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS z
FROM w r JOIN e ON e.position >= r.position - {WINDOW} AND e.position < r.position WHERE r.position >= {WINDOW}),
n AS (SELECT qid, id, label, x * x + y * y + z AS d2, row_number() OVER (PARTITION BY qid ORDER BY x * x + y * y + z, id) AS rank FROM d QUALIFY rank <= {K})"""


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"), F.col("user_id").alias("user"), "event_type")


def event_neighbours(spark, sf_dir) -> DataFrame:
    return window.window_nearest(events(spark, sf_dir), EVENTS, WINDOW, K)


def most_votes(near: DataFrame, *by: str) -> DataFrame:
    """The class that most neighbours have, by query; of equals the first in order."""
    counts = near.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(*by).agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("label"))


@query("WITH " + STREAM_SQL + " SELECT qid, id, d2, rank FROM n")
def window_knn(spark, sf_dir):
    """Every event against the window before it."""
    return event_neighbours(spark, sf_dir).select("qid", "id", "d2", "rank")


@query("WITH " + STREAM_SQL + ", v AS (SELECT qid, label, count(*) AS votes FROM n GROUP BY 1, 2), p AS (SELECT qid, arg_min(label, (-votes, label)) AS label FROM v GROUP BY qid) SELECT p.qid, e.label AS truth, p.label FROM p JOIN e ON e.id = p.qid")
def window_classify(spark, sf_dir):
    made = most_votes(event_neighbours(spark, sf_dir), "qid")
    truth = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), F.col("event_type").alias("truth"))
    return made.join(truth, "qid").select("qid", "truth", "label")


def order_neighbours(spark, sf_dir, k: int = K, **how) -> DataFrame:
    df = orders(spark, sf_dir)
    return knn.nearest(df, asked(df), ORDERS, ranges.ranges_of(df, ORDERS.numeric), k, **how)


@query("WITH " + NEAR_SQL.replace("WHERE qid <> id ", "") + " SELECT qid, id, d2, rank FROM n")
def knn_bruteforce(spark, sf_dir):
    return order_neighbours(spark, sf_dir).select("qid", "id", "d2", "rank")


@query("WITH " + NEAR_SQL + " SELECT n.qid, n.id, n.rank, x.price, x.day, x.priority FROM n JOIN o x ON x.id = n.id")
def knn_gather(spark, sf_dir):
    return order_neighbours(spark, sf_dir, leave_one_out=True, extra=("price", "day", "priority")).select("qid", "id", "rank", "price", "day", "priority")


@query("WITH " + PAIRS_SQL + f", n AS (SELECT qid, id, d2, rank() OVER (PARTITION BY qid ORDER BY d2) AS rank FROM p QUALIFY rank <= {K}) SELECT * FROM n")
def knn_ties(spark, sf_dir):
    return order_neighbours(spark, sf_dir, ties=True).select("qid", "id", "d2", "rank")


@query("WITH " + NEAR_SQL + " SELECT qid, id, d2 FROM n WHERE rank = 1")
def knn_one(spark, sf_dir):
    return order_neighbours(spark, sf_dir, 1, leave_one_out=True).select("qid", "id", "d2")


@query("WITH " + NEAR_SQL + " SELECT qid, rank, sqrt(d2) AS d FROM n")
def knn_distances(spark, sf_dir):
    return order_neighbours(spark, sf_dir, leave_one_out=True).select("qid", "rank", F.sqrt("d2").alias("d"))


@query("WITH " + NEAR_SQL + " SELECT qid, id, d2, rank FROM n")
def knn_exact_k(spark, sf_dir):
    return order_neighbours(spark, sf_dir, leave_one_out=True).select("qid", "id", "d2", "rank")


@query("WITH " + NEAR_SQL + " SELECT qid, id, rank FROM n")
def knn_leave_one_out(spark, sf_dir):
    return order_neighbours(spark, sf_dir, leave_one_out=True).select("qid", "id", "rank")


@query("WITH " + NEAR_SQL.replace("WHERE qid <> id", "WHERE d2 > 0") + " SELECT qid, id, d2, rank FROM n")
def knn_skip_identical(spark, sf_dir):
    return order_neighbours(spark, sf_dir, skip_identical=True).select("qid", "id", "d2", "rank")


@query("SELECT q.id AS qid, count(*) AS points, count(*) * 3 AS coordinates FROM o q, o x WHERE q.id % 100 = 0 GROUP BY q.id")
def knn_stats(spark, sf_dir):
    df = orders(spark, sf_dir)
    return knn.statistics(df, asked(df), ORDERS)


RAW_SQL = "p AS (SELECT q.id AS qid, o.id AS id, (q.price - o.price) * (q.price - o.price) + (q.day - o.day) * (q.day - o.day) AS d2 FROM o q, o WHERE q.id % 100 = 0)"


@query("WITH " + RAW_SQL + f", n AS (SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p QUALIFY rank <= {K}) SELECT * FROM n")
def knn_kdtree(spark, sf_dir):
    df = orders(spark, sf_dir)
    return spacetree.tree_nearest(df, asked(df), "id", ("price", "day"), K)


@query("WITH q AS (SELECT label, label AS v FROM o), s AS (SELECT o_totalprice AS v, o_orderkey AS id FROM orders ORDER BY v, id LIMIT 32) SELECT id, v AS price FROM s")
def select_k_smallest(spark, sf_dir):
    return primitives.smallest(orders(spark, sf_dir).select("id", "price"), 32, "price", "id")


@query("WITH s AS (SELECT id, price FROM o ORDER BY price, id LIMIT 32) SELECT id, price FROM s")
def select_k_bucket(spark, sf_dir):
    """By buckets: all rows of the buckets below the one that the k-th falls in, then the smallest of that one."""
    df = orders(spark, sf_dir).select("id", "price")
    marked = df.withColumn("bucket", order_bucket(df))
    counts = sorted(map(tuple, marked.groupBy("bucket").count().collect()))  # a row a bucket
    held, last = 0, -1
    for bucket, n in counts:
        held, last = held + n, bucket
        if held >= 32:
            break
    return primitives.smallest(marked.filter(F.col("bucket") <= last).select("id", "price"), 32, "price", "id")


@query("WITH h AS (SELECT cust & 15 AS digit, count(*) AS n FROM o GROUP BY 1), c AS (SELECT digit, sum(n) OVER (ORDER BY digit) AS running FROM h) SELECT min(digit) AS digit FROM c WHERE running > 5000")
def kth_digit(spark, sf_dir):
    return primitives.kth_digit(orders(spark, sf_dir), primitives.digit(F.col("cust"), 0), 5000)


# --- Votes


def order_votes(spark, sf_dir, kind: str, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    df = orders(spark, sf_dir).withColumn("weight", (F.col("id") % 3 + 1).cast("double"))
    near = knn.nearest(df, asked(df), ORDERS, ranges.ranges_of(df, ORDERS.numeric), K, leave_one_out=True, extra=("label", "weight"))
    classes = [r[0] for r in df.select("label").distinct().orderBy("label").collect()]  # a row a class
    w = votes.weight(kind, len(ORDERS.attributes))
    return df, votes.distribution(near, classes, df.count(), w * F.col("weight") if weighted else w)


def vote_sql(weight: str) -> str:
    return "WITH " + NEAR_SQL + f""", w AS (SELECT count(*) AS n FROM o), c AS (SELECT DISTINCT label FROM o), v AS (SELECT qid, label, sum({weight}) AS s FROM n GROUP BY qid, label),
a AS (SELECT q.id AS qid, c.label, coalesce(v.s, 0.0::DOUBLE) AS s FROM q CROSS JOIN c LEFT JOIN v ON v.qid = q.id AND v.label = c.label)
SELECT a.qid, a.label, round((a.s + 1.0::DOUBLE / w.n) / (sum(a.s) OVER (PARTITION BY a.qid) + (SELECT count(*) FROM c) * (1.0::DOUBLE / w.n)), 6) AS p FROM a, w"""


def rounded(votes_: DataFrame) -> DataFrame:
    return votes_.select("qid", "label", F.round("p", 6).alias("p"))


@query(vote_sql("1.0::DOUBLE"))
def vote_distribution(spark, sf_dir):
    return rounded(order_votes(spark, sf_dir, "none")[1])


@query(vote_sql("1.0::DOUBLE / (sqrt(d2 / 3.0::DOUBLE) + 0.001::DOUBLE)"))
def vote_inverse(spark, sf_dir):
    return rounded(order_votes(spark, sf_dir, "inverse")[1])


@query(vote_sql("1.0::DOUBLE - sqrt(d2 / 3.0::DOUBLE)"))
def vote_similarity(spark, sf_dir):
    return rounded(order_votes(spark, sf_dir, "similarity")[1])


@query(vote_sql("(id % 3 + 1)::DOUBLE"))
def vote_instance_weight(spark, sf_dir):
    return rounded(order_votes(spark, sf_dir, "none", weighted=True)[1])


def classified(spark, sf_dir, kind: str = "none") -> DataFrame:
    df, made = order_votes(spark, sf_dir, kind)
    truth = asked(df).select(F.col("id").alias("qid"), F.col("label").alias("truth"))
    return votes.predicted(rounded(made)).join(truth, "qid").select("qid", "truth", "label", "p")


CLASSIFY_SQL = vote_sql("1.0::DOUBLE") + ")"
PREDICTED_SQL = "z AS (" + CLASSIFY_SQL.replace("WITH ", "WITH ", 1) + ", k AS (SELECT z.qid, q.label AS truth, arg_min(z.label, (-z.p, z.label)) AS label, max(z.p) AS p FROM z JOIN o q ON q.id = z.qid GROUP BY z.qid, q.label)"


@query("WITH " + PREDICTED_SQL + " SELECT * FROM k")
def knn_classify(spark, sf_dir):
    return classified(spark, sf_dir)


PART_D2 = "((CASE WHEN r.b > r.a THEN (q.p_size - r.a) / (r.b - r.a) ELSE 0 END) - (CASE WHEN r.b > r.a THEN (x.p_size - r.a) / (r.b - r.a) ELSE 0 END))"


@query(f"""WITH r AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part), p AS (
SELECT q.p_partkey AS qid, x.p_partkey AS id, x.p_retailprice AS y, {PART_D2} * {PART_D2} + (CASE WHEN q.p_brand = x.p_brand THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) + (CASE WHEN q.p_type = x.p_type THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS d2
FROM part q, part x, r WHERE q.p_partkey % 100 = 0 AND q.p_partkey <> x.p_partkey), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p QUALIFY rank <= {K})
SELECT qid, round(avg(y), 6) AS estimate FROM n GROUP BY qid""")
def knn_regression(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    near = knn.nearest(df, asked(df, "p_partkey"), PARTS, ranges.ranges_of(df, PARTS.numeric), K, leave_one_out=True, extra=("p_retailprice",))
    return votes.regression(near, F.lit(1.0), "p_retailprice").select("qid", F.round("estimate", 6).alias("estimate"))


@query(f"WITH e AS (SELECT event_id, count(*) OVER (ORDER BY event_id ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS held FROM events) SELECT event_id, held FROM e WHERE held = {WINDOW}")
def vote_ready_only(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id")
    return ranges.windowed(df, "event_id", WINDOW, {"held": F.count(F.lit(1))}).filter(F.col("held") == WINDOW).select("event_id", "held")


# --- Aggregates, scans, sorts


@query("SELECT l_returnflag, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def reduce_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id // 128 AS grp, i - 1 AS place, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def window_vector_mean(spark, sf_dir):
    made = primitives.vector_mean(table(spark, sf_dir, "embeddings"), F.floor(F.col("vec_id") / 128), "embedding", DIMS)
    return made.select("grp", "place", F.round("mean", 6).alias("mean"))


@query("SELECT id // 1024 AS block, (cust >> 4) & 15 AS digit, count(*) AS n FROM o GROUP BY 1, 2")
def digit_histogram(spark, sf_dir):
    return primitives.histogram(orders(spark, sf_dir), primitives.digit(F.col("cust"), 4), F.floor(F.col("id") / 1024))


@query("SELECT cust & 255 AS digit, count(*) AS n FROM o GROUP BY 1")
def byte_histogram(spark, sf_dir):
    return primitives.histogram(orders(spark, sf_dir), primitives.digit(F.col("cust"), 0, 8))


@query("WITH h AS (SELECT id // 1024 AS block, (cust >> 4) & 15 AS digit, count(*) AS n FROM o GROUP BY 1, 2) SELECT digit, block, n, coalesce(sum(n) OVER (ORDER BY digit, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM h")
def histogram_scan(spark, sf_dir):
    return primitives.histogram_scan(digit_histogram(spark, sf_dir))


@query("SELECT id, sum(cust) OVER (ORDER BY id)::BIGINT AS inclusive FROM o")
def prefix_sum_inclusive(spark, sf_dir):
    return primitives.prefix_sums(orders(spark, sf_dir), "id", "cust").select("id", "inclusive")


@query("SELECT id, coalesce(sum(cust) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exclusive FROM o")
def prefix_sum_exclusive(spark, sf_dir):
    return primitives.prefix_sums(orders(spark, sf_dir), "id", "cust").select("id", "exclusive")


@query("SELECT event_id, coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exclusive, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS inclusive FROM events")
def prefix_sum_blocked(spark, sf_dir):
    return primitives.prefix_sums(table(spark, sf_dir, "events"), "event_id", "user_id")


@query("WITH t AS (SELECT label, price, row_number() OVER (PARTITION BY label ORDER BY price) AS i, count(*) OVER (PARTITION BY label) AS n FROM o) SELECT label, round(quantile_cont(price, 0.5), 6) AS trimmed_median FROM t WHERE i > 1 AND i < n GROUP BY label")
def trimmed_median(spark, sf_dir):
    return primitives.trimmed_median(orders(spark, sf_dir), "label", "price").select("label", F.round("trimmed_median", 6).alias("trimmed_median"))


@query("SELECT id, price, row_number() OVER (ORDER BY price, id) - 1 AS position FROM o")
def sort_key_payload(spark, sf_dir):
    return primitives.sort_positions(orders(spark, sf_dir), "price", "id")


@query("SELECT id, cust, row_number() OVER (ORDER BY cust, id) - 1 AS position FROM o")
def sort_int(spark, sf_dir):
    return primitives.sort_positions(orders(spark, sf_dir), "cust", "id")


@query("SELECT id, (cust >> 4) & 15 AS digit, row_number() OVER (ORDER BY (cust >> 4) & 15, id) - 1 AS position FROM o")
def scatter_position(spark, sf_dir):
    return primitives.scatter_positions(orders(spark, sf_dir), "id", primitives.digit(F.col("cust"), 4))


# --- Evaluation


@query("WITH " + PREDICTED_SQL + " SELECT count(*) AS n, round(avg((truth = label)::INTEGER) * 100, 6) AS accuracy_pct FROM k")
def eval_accuracy(spark, sf_dir):
    return evaluate.accuracy(classified(spark, sf_dir))


@query("WITH " + PREDICTED_SQL + " SELECT truth, label, count(*) AS n FROM k GROUP BY 1, 2")
def eval_confusion(spark, sf_dir):
    return evaluate.confusion(classified(spark, sf_dir))


@query("WITH " + PREDICTED_SQL + """, s AS (SELECT count(*)::DOUBLE AS n, avg((truth = label)::INTEGER) AS p0 FROM k), m AS (SELECT sum(a.n * b.n)::DOUBLE AS ab FROM (SELECT truth AS c, count(*) AS n FROM k GROUP BY 1) a JOIN (SELECT label AS c, count(*) AS n FROM k GROUP BY 1) b ON a.c = b.c)
SELECT n::BIGINT AS n, round(CASE WHEN ab / (n * n) < 1 THEN (p0 - ab / (n * n)) / (1 - ab / (n * n)) END * 100, 6) AS kappa_pct FROM s, m""")
def eval_kappa(spark, sf_dir):
    return evaluate.kappa(classified(spark, sf_dir))


@query("WITH " + PREDICTED_SQL + """, t AS (SELECT *, lag(truth) OVER (ORDER BY qid) AS was FROM k), s AS (SELECT count(*) AS n, avg((truth = label)::INTEGER) AS p0, avg(coalesce((truth = was)::INTEGER, 0)) AS pp FROM t)
SELECT n, round(CASE WHEN pp < 1 THEN (p0 - pp) / (1 - pp) END * 100, 6) AS kappa_temporal_pct FROM s""")
def eval_kappa_temporal(spark, sf_dir):
    return evaluate.kappa_temporal(classified(spark, sf_dir))


TRAIN, TEST = 400, 100
PERIOD_SQL = f"""e AS (
  SELECT event_id AS id, value, hour(ts)::DOUBLE AS hour, user_id AS user, event_type AS label,
    (row_number() OVER (ORDER BY event_id) - 1) // {TRAIN + TEST} AS period, (row_number() OVER (ORDER BY event_id) - 1) % {TRAIN + TEST} AS place
  FROM events
), t AS (
  SELECT * FROM e WHERE place >= {TRAIN - WINDOW} AND place < {TRAIN}
), w AS (
  SELECT e.*, a1, b1, a2, b2
  FROM e JOIN (SELECT period, min(value) AS a1, max(value) AS b1, min(hour) AS a2, max(hour) AS b2 FROM t GROUP BY period) b ON b.period = e.period
  WHERE place >= {TRAIN}
), d AS (
  SELECT r.id AS qid, r.period, r.label AS truth, t.id, t.label, {norm_sql("r.value", 1)} - {norm_sql("t.value", 1)} AS x,
    {norm_sql("r.hour", 2)} - {norm_sql("t.hour", 2)} AS y, CASE WHEN r.user = t.user THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS z
  FROM w r JOIN t ON t.period = r.period
), n AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x * x + y * y + z, id) AS rank FROM d QUALIFY rank <= {K}
), v AS (
  SELECT qid, period, truth, label, count(*) AS votes FROM n GROUP BY ALL
), p AS (
  SELECT qid, period, truth, arg_min(label, (-votes, label)) AS label FROM v GROUP BY qid, period, truth
)"""


@query("WITH " + PERIOD_SQL + " SELECT period, count(*) AS n, round(avg((truth = label)::INTEGER) * 100, 6) AS accuracy_pct FROM p GROUP BY period")
def eval_periodic_holdout(spark, sf_dir):
    """Train on a stretch of events, then test on the next one, in turn."""
    near = window.held_out_nearest(events(spark, sf_dir), EVENTS, TRAIN, TEST, WINDOW, K)
    return evaluate.periodic(most_votes(near, "qid", "period", "truth"))


SECOND_SQL = PREDICTED_SQL.replace("z AS", "z2 AS", 1).replace("z.", "z2.").replace("FROM z ", "FROM z2 ").replace("k AS", "k2 AS").replace("sum(1.0::DOUBLE)", "sum(1.0::DOUBLE / (sqrt(d2 / 3.0::DOUBLE) + 0.001::DOUBLE))")


@query("WITH " + PREDICTED_SQL + ", " + SECOND_SQL + " SELECT count(*) AS n, round(avg((k.label = k2.label)::INTEGER) * 100, 6) AS agree_pct, round(avg((k.truth = k.label)::INTEGER) * 100, 6) AS first_pct, round(avg((k.truth = k2.label)::INTEGER) * 100, 6) AS second_pct FROM k JOIN k2 ON k.qid = k2.qid")
def eval_dual_agreement(spark, sf_dir):
    return evaluate.agreement(classified(spark, sf_dir), classified(spark, sf_dir, "inverse"))


@query()
def eval_report(spark, sf_dir):
    """A record a micro-batch of a live test-then-train run over all events, by a listener to its progress."""
    rows = event_stream(spark, sf_dir).withColumn("hour", F.hour("ts"))
    made = live.classify(rows, "user_id", "event_id", ["value", "hour"], "event_type", USER_WINDOW, USER_K)
    with progress.listening(spark) as log:
        said = drained(spark, made)
    return progress.report(spark, log, evaluate.accuracy(said.select("truth", "label")))


# --- Trees


TREE_SQL = f"""WITH RECURSIVE t AS (
  SELECT id, price, day, '1' AS path FROM o
  UNION ALL
  SELECT id, price, day, path || CASE WHEN (CASE WHEN b1 - a1 >= b2 - a2 THEN price ELSE day END) > (CASE WHEN b1 - a1 >= b2 - a2 THEN a1 + (b1 - a1) / 2 ELSE a2 + (b2 - a2) / 2 END) THEN '1' ELSE '0' END
  FROM (SELECT *, count(*) OVER p AS n, min(price) OVER p AS a1, max(price) OVER p AS b1, min(day) OVER p AS a2, max(day) OVER p AS b2 FROM t WINDOW p AS (PARTITION BY path))
  WHERE n > {spacetree.LEAF} AND greatest(b1 - a1, b2 - a2) > 0
), l AS (
  SELECT id, any_value(price) AS price, any_value(day) AS day, max_by(path, length(path)) AS path FROM t GROUP BY id
), n AS (
  SELECT path, length(path) - 1 AS level, count(*) AS n,
    CASE WHEN max(price) - min(price) >= max(day) - min(day) THEN 'price' ELSE 'day' END AS dim,
    CASE WHEN max(price) - min(price) >= max(day) - min(day) THEN min(price) + (max(price) - min(price)) / 2 ELSE min(day) + (max(day) - min(day)) / 2 END AS split
  FROM t GROUP BY path HAVING count(*) > {spacetree.LEAF} AND greatest(max(price) - min(price), max(day) - min(day)) > 0
) """


def order_tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return spacetree.build(orders(spark, sf_dir), "id", ("price", "day"))


@query(TREE_SQL + "SELECT id, path FROM l")
def kd_assign(spark, sf_dir):
    return order_tree(spark, sf_dir)[0].select("id", "path")


@query(TREE_SQL + "SELECT path, level, n, dim, split FROM n")
def kd_split(spark, sf_dir):
    return order_tree(spark, sf_dir)[1]


@query(TREE_SQL + "SELECT path, count(*) AS n FROM l GROUP BY path")
def kd_leaf_sizes(spark, sf_dir):
    return spacetree.leaf_boxes(order_tree(spark, sf_dir)[0], ("price", "day")).select("path", "n")


@query(TREE_SQL + "SELECT path, min(price) AS price_min, max(price) AS price_max, min(day) AS day_min, max(day) AS day_max FROM l GROUP BY path")
def kd_node_ranges(spark, sf_dir):
    return spacetree.leaf_boxes(order_tree(spark, sf_dir)[0], ("price", "day")).drop("n")


@query()
def rp_tree_max(spark, sf_dir):
    return spacetree.random_tree(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMS, leaf=64, rule="max")


@query()
def rp_tree_mid(spark, sf_dir):
    return spacetree.random_tree(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMS, leaf=64, rule="mid")


@query()
def rp_forest_knn(spark, sf_dir):
    """Recall is held against brute force in a test: the directions are random draws."""
    df = order_points(spark, sf_dir)
    return spacetree.forest_nearest(df, asked(df), "id", "at", 2, K)


# --- Approximate methods

EMBED_SQL = "v AS (SELECT vec_id AS id, embedding AS v FROM embeddings)"
ARRAY_D2 = "list_reduce(list_transform(range(1, 65), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)), lambda x, y: x + y)"


#: The k nearest of all embeddings, by any exact way.
NEAR_EMBEDDINGS_SQL = f"""WITH {EMBED_SQL}, p AS (
  SELECT q.id AS qid, v.id AS id, {ARRAY_D2.format(a="q.v", b="v.v")} AS d2 FROM v q, v WHERE q.id % 100 = 0
)
SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p QUALIFY rank <= {K}"""


@query(NEAR_EMBEDDINGS_SQL)
def rbc_exact(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return approx.ball_cover_exact(df, approx.representatives(df, "vec_id")[0], asked(df, "vec_id"), "vec_id", "embedding", DIMS, K)


@query(NEAR_EMBEDDINGS_SQL)
def ball_tree_knn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return balls.nearest(balls.ball_tree(df, "vec_id", "embedding", DIMS), asked(df, "vec_id"), "vec_id", "embedding", K)


@query(NEAR_EMBEDDINGS_SQL)
def cover_tree_knn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return balls.nearest(balls.cover_tree(df, "vec_id", "embedding", DIMS, leaf=256)[0], asked(df, "vec_id"), "vec_id", "embedding", K)


@query(NEAR_EMBEDDINGS_SQL)
def knn_cutoff(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return approx.cutoff_nearest(df, asked(df, "vec_id"), "vec_id", "embedding", DIMS, K)


ARRAY_D1 = "list_reduce(list_transform(range(1, 65), lambda i: abs({a}[i]::DOUBLE - {b}[i]::DOUBLE)), lambda x, y: x + y)"


@query(NEAR_EMBEDDINGS_SQL.replace(ARRAY_D2.format(a="q.v", b="v.v"), ARRAY_D1.format(a="q.v", b="v.v")))
def ball_tree_manhattan(spark, sf_dir):
    """The same search by another metric: sums of absolute differences (in d2, though they are no squares)."""
    df = table(spark, sf_dir, "embeddings")
    tree = balls.ball_tree(df, "vec_id", "embedding", DIMS, balls.MANHATTAN)
    return balls.nearest(tree, asked(df, "vec_id"), "vec_id", "embedding", K)


def order_points(spark, sf_dir) -> DataFrame:
    """Orders as points of normalised price and day."""
    df = orders(spark, sf_dir)
    of = ranges.ranges_of(df, ORDERS.numeric)
    return df.select("id", F.array(*(of[c].norm(F.col(c)) for c in ORDERS.numeric)).alias("at"))


POINTS_SQL = "WITH " + LIMITS_SQL.format(t="o") + f""", v AS (
  SELECT id, {norm_sql("price", 1)} AS x, {norm_sql("day", 2)} AS y FROM o, r
), p AS (
  SELECT q.id AS qid, v.id AS id, (q.x - v.x) * (q.x - v.x) + (q.y - v.y) * (q.y - v.y) AS d2 FROM v q, v WHERE q.id % 100 = 0
)
SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p QUALIFY rank <= {K}"""


@query(POINTS_SQL)
def cover_tree_orders(spark, sf_dir):
    df = order_points(spark, sf_dir)
    return balls.nearest(balls.cover_tree(df, "id", "at", 2, leaf=2048)[0], asked(df), "id", "at", K)


@query(POINTS_SQL)
def ball_tree_orders(spark, sf_dir):
    df = order_points(spark, sf_dir)
    return balls.nearest(balls.ball_tree(df, "id", "at", 2, leaf=256), asked(df), "id", "at", K)


@query(POINTS_SQL)
def lsh_probe_knn(spark, sf_dir):
    df = order_points(spark, sf_dir)
    return probing.nearest(df, asked(df), "id", "at", 2, K)[0]


#: Lists of OWN times as many rows as there are representatives, PROBES lists a query; the README has the recall.
OWN, PROBES = 8, 8
ONESHOT_SQL = f"""WITH {EMBED_SQL}, s AS (
  SELECT ceil(sqrt(count(*)))::BIGINT AS step FROM v
), l AS (
  SELECT r.id AS rid, v.id, v.v, row_number() OVER (PARTITION BY r.id ORDER BY {ARRAY_D2.format(a="r.v", b="v.v")}, v.id) AS place
  FROM v r, v, s WHERE r.id % step = 0 QUALIFY place <= {OWN} * any_value(step) OVER ()
), h AS (
  SELECT q.id AS qid, q.v, r.id AS rid, row_number() OVER (PARTITION BY q.id ORDER BY {ARRAY_D2.format(a="q.v", b="r.v")}, r.id) AS near
  FROM v q, v r, s WHERE q.id % 100 = 0 AND r.id % step = 0 QUALIFY near <= {PROBES}
), p AS (
  SELECT DISTINCT h.qid, l.id, {ARRAY_D2.format(a="h.v", b="l.v")} AS d2 FROM h JOIN l ON l.rid = h.rid
)
SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p QUALIFY rank <= {K}"""


@query(ONESHOT_SQL)
def rbc_oneshot(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    reps, step = approx.representatives(df, "vec_id")
    return approx.ball_cover_oneshot(df, reps, asked(df, "vec_id"), "vec_id", "embedding", DIMS, K, OWN * step, PROBES)


@query("SELECT vec_id, " + ", ".join("round((" + " + ".join(f"embedding[{i + 1}]::DOUBLE * ({approx.sparse_entry(i, j)})" for i in range(DIMS) if approx.sparse_entry(i, j)) + f") * sqrt(3.0::DOUBLE / 8), 6) AS p{j}" for j in range(8)) + " FROM embeddings")
def sparse_project(spark, sf_dir):
    cols = approx.sparse_projection(F.col("embedding"), DIMS, 8)
    made = table(spark, sf_dir, "embeddings").select("vec_id", *cols)
    return made.select("vec_id", *(F.round(f"p{j}", 6).alias(f"p{j}") for j in range(8)))


@query()
def jl_project(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *approx.dense_projection(F.col("embedding"), DIMS, 8, 11))


@query()
def fjlt_project(spark, sf_dir):
    return approx.fourier_projection(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIMS, 16, 11)


@query()
def lsh_knn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return approx.hashed_nearest(df, asked(df, "vec_id"), "vec_id", "embedding", DIMS, K)


@query("WITH " + LIMITS_SQL.format(t="o") + f", c AS (SELECT id, floor(({norm_sql('price', 1)}) * 65535)::BIGINT AS x, floor(({norm_sql('day', 2)}) * 65535)::BIGINT AS y FROM o, r) SELECT id, " + " + ".join(f"(((x >> {i}) & 1) << {2 * i}) + (((y >> {i}) & 1) << {2 * i + 1})" for i in range(16)) + " AS code FROM c")
def morton_code(spark, sf_dir):
    df = orders(spark, sf_dir)
    of = ranges.ranges_of(df, ORDERS.numeric)
    at = lambda c: F.floor(of[c].norm(F.col(c)) * 65535).cast("long")
    return df.select("id", approx.morton(at("price"), at("day")).alias("code"))


@query("WITH " + RAW_SQL + f" SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM p QUALIFY rank <= {K}")
def z_order_knn(spark, sf_dir):
    df = orders(spark, sf_dir)
    return zorder.nearest(df, asked(df), "id", ("price", "day"), K)[0]


# --- Strategies by name: searches, metrics and options as arguments of one classifier

NUMBERS = FeatureSpec(("price", "day"), (), "label")
POINT_NEAR_SQL = "WITH " + LIMITS_SQL.format(t="o") + f""", v AS (
  SELECT id, label, {norm_sql("price", 1)} AS x, {norm_sql("day", 2)} AS y FROM o, r
), p AS (
  SELECT q.id AS qid, q.label AS truth, v.id AS id, v.label, {{d2}} AS d2 FROM v q, v WHERE q.id % 100 = 0 AND q.id <> v.id
), n AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id)::INTEGER AS rank FROM p QUALIFY rank <= {K}
)"""


@query(POINT_NEAR_SQL.format(d2="(q.x - v.x) * (q.x - v.x) + (q.y - v.y) * (q.y - v.y)") + """, c AS (
  SELECT qid, truth, label, count(*) AS votes FROM n GROUP BY ALL
), k AS (
  SELECT qid, truth, arg_min(label, (-votes, label)) AS label FROM c GROUP BY qid, truth
)
SELECT count(*) AS n, 100.0::DOUBLE AS agree_pct, round(avg((truth = label)::INTEGER) * 100, 6) AS first_pct, round(avg((truth = label)::INTEGER) * 100, 6) AS second_pct FROM k""")
def eval_dual_searches(spark, sf_dir):
    """Two exact searches side by side: grid cells and a ball tree."""
    df = orders(spark, sf_dir)
    said = [classifier.KnnClassifier(K, search, leave_one_out=True).fit(df, NUMBERS).transform(asked(df)) for search in ("cells", "ball_tree")]
    return evaluate.agreement(*said)


@query(POINT_NEAR_SQL.format(d2="abs(q.x - v.x) + abs(q.y - v.y)") + " SELECT qid, id, d2, rank, label FROM n")
def knn_manhattan(spark, sf_dir):
    df = orders(spark, sf_dir)
    by = classifier.KnnClassifier(K, "ball_tree", "manhattan", leave_one_out=True)
    return by.fit(df, NUMBERS).neighbours(asked(df)).withColumn("rank", F.col("rank").cast("int"))


@query("WITH " + LIMITS_SQL.format(t="o") + f""", v AS (
  SELECT id, label, {norm_sql("day", 2)} AS y, priority FROM o, r
), p AS (
  SELECT q.id AS qid, v.id AS id, v.label, (q.y - v.y) * (q.y - v.y) + CASE WHEN q.priority = v.priority THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS d2
  FROM v q, v WHERE q.id % 100 = 0
)
SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id)::INTEGER AS rank, label FROM p WHERE d2 > 0 QUALIFY rank <= {K}""")
def knn_by_options(spark, sf_dir):
    """All attributes but the first, identical rows skipped, by an option string."""
    df = orders(spark, sf_dir)
    by = classifier.KnnClassifier(K, options=SearchOptions.parse("-R first -V -S"))
    return by.fit(df, ORDERS).neighbours(asked(df)).withColumn("rank", F.col("rank").cast("int"))


# --- Live streams: the whole events table through a stream, collected in a memory table


def drained(spark, stream: DataFrame) -> DataFrame:
    """All rows that a stream gives for what is there now, by way of files in the shared folder."""
    from nearwin.plans.shared import shared_dir

    out = shared_dir(spark)
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@contextmanager
def settings(spark, values: dict[str, str]):
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


USER_WINDOW, USER_K = 32, 8
OF_USER_SQL = f"WINDOW f AS (PARTITION BY key ORDER BY position ROWS BETWEEN {USER_WINDOW} PRECEDING AND 1 PRECEDING)"
USERS_SQL = """u AS (
  SELECT user_id::VARCHAR AS key, event_id AS "at", value, hour(ts)::DOUBLE AS hour, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position
  FROM events
)"""


@query(f'WITH {USERS_SQL} SELECT key, "at", count(*) OVER f AS held, first_value("at") OVER f AS "first" FROM u {OF_USER_SQL}')
def stream_window(spark, sf_dir):
    """Each user's events are a stream of their own."""
    return drained(spark, live.windows(event_stream(spark, sf_dir), "user_id", "event_id", USER_WINDOW))


@query(f"""WITH {USERS_SQL}, w AS (
  SELECT *, min(value) OVER f AS a1, max(value) OVER f AS b1, min(hour) OVER f AS a2, max(hour) OVER f AS b2 FROM u {OF_USER_SQL}
), d AS (
  SELECT r.key, r."at", r.label AS truth, u.position, u.label, {norm_sql("r.value", 1)} - {norm_sql("u.value", 1)} AS x, {norm_sql("r.hour", 2)} - {norm_sql("u.hour", 2)} AS y
  FROM w r JOIN u ON u.key = r.key AND u.position >= r.position - {USER_WINDOW} AND u.position < r.position WHERE r.position > {USER_WINDOW}
), n AS (
  SELECT *, row_number() OVER (PARTITION BY "at" ORDER BY x * x + y * y, position) AS rank FROM d QUALIFY rank <= {USER_K}
), v AS (
  SELECT key, "at", truth, label, count(*) AS votes FROM n GROUP BY ALL
)
SELECT key, "at", truth, arg_min(label, (-votes, label)) AS label FROM v GROUP BY key, "at", truth""")
def stream_knn(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("hour", F.hour("ts"))
    return drained(spark, live.classify(rows, "user_id", "event_id", ["value", "hour"], "event_type", USER_WINDOW, USER_K))


USER_DAYS_SQL = USERS_SQL.replace("event_type AS label,", "event_type AS label, dayofweek(ts)::VARCHAR AS day,")


@query(f"""WITH {USER_DAYS_SQL}, w AS (
  SELECT *, min(value) OVER f AS a1, max(value) OVER f AS b1, min(hour) OVER f AS a2, max(hour) OVER f AS b2 FROM u {OF_USER_SQL}
), d AS (
  SELECT r.key, r."at", r.label AS truth, u."at" AS id, u.position, u.label, {norm_sql("r.value", 1)} - {norm_sql("u.value", 1)} AS x,
    {norm_sql("r.hour", 2)} - {norm_sql("u.hour", 2)} AS y, CASE WHEN r.day = u.day THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS z
  FROM w r JOIN u ON u.key = r.key AND u.position >= r.position - {USER_WINDOW} AND u.position < r.position WHERE r.position > {USER_WINDOW}
)
SELECT key, "at", truth, id, x * x + y * y + z AS d2, row_number() OVER (PARTITION BY "at" ORDER BY x * x + y * y + z, position)::INTEGER AS rank, label
FROM d QUALIFY rank <= {USER_K}""")
def stream_tree_knn(spark, sf_dir):
    """Each user's events against a kd-tree of the user's last ones, with a nominal attribute; the tree lives in keyed state."""
    rows = event_stream(spark, sf_dir).withColumns({"hour": F.hour("ts"), "day": (F.dayofweek("ts") - 1).cast("string")})
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        return drained(spark, live_windows.nearest(rows, "user_id", "event_id", ["value", "hour"], ["day"], "event_type", USER_WINDOW, USER_K))
