"""op1, op2, op7 against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from nearwin.llm import fingerprints, jaccard, sharding, simhash
from nearwin.llm.components import components
from nearwin.plans.shared import written
from tests.llm import nasty


def ordered(rows):
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()), (r[1] or "").encode())
    return sorted(rows, key=key)


def test_fingerprints(spark):
    rows = ordered([(r[0], r[1] or "") for r in nasty.rows()])
    got = fingerprints.fingerprints(nasty.frame(spark)).collect()
    want = Counter()
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    empty = [r for r in got if not r["n_chars"]]
    assert empty and all(set(r["fingerprint"]) == {"0"} for r in empty)


def test_fingerprints_over_many_buckets(spark):
    rng = random.Random(4)
    texts = [nasty.words(rng, rng.randrange(0, 30)) for _ in range(3000)]
    df = nasty.docs(spark, texts).withColumn("doc_id", F.col("doc_id") * 1_000_003 % 2_000_003 * 11)
    ids = {i * 1_000_003 % 2_000_003 * 11: t for i, t in enumerate(texts)}
    line = sorted(ids)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(df).select("doc_id", "edited_sha256").collect()}
    assert len(got) == 3000
    for k, i in enumerate(line):
        t, after = ids[i], ids[line[(k + 1) % len(line)]]
        q = len(t) // 4
        assert got[i] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()


def lane_values(spark, texts):
    return [r[0] for r in nasty.docs(spark, texts).orderBy("doc_id").select(fingerprints.lanes(F.col("text"))).collect()]


def test_fingerprint_is_a_multiset_hash(spark):
    parts = ["a first line, of words.", "second line here", "third; one more. And then", "second line here"]
    whole, shuffled, some, rest, other = lane_values(spark, ["\n".join(parts), "\n".join(reversed(parts)), "\n".join(parts[:2]), "\n".join(parts[2:]), "\n".join(parts[:3])])
    assert whole == shuffled != other
    df = spark.createDataFrame([(some, rest, whole)], "a array<bigint>, b array<bigint>, w array<bigint>")
    got = df.select(fingerprints.combine(F.col("a"), F.col("b")), fingerprints.combine(F.col("w"), F.col("b"), -1)).first()
    assert got[0] == whole and got[1] == some


def test_likeness_follows_overlap(spark):
    rng = random.Random(9)
    line = lambda: " ".join(f"x{rng.randrange(10**6)}" for _ in range(8)) + "."
    a = [line() for _ in range(200)]
    near, half, none = a[:180] + [line() for _ in range(20)], a[:100] + [line() for _ in range(100)], [line() for _ in range(200)]
    v = lane_values(spark, ["\n".join(x) for x in (a, near, half, none)])
    df = spark.createDataFrame([tuple(v)], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    got = df.select(*(fingerprints.likeness(F.col("a"), F.col(c)) for c in "abcd")).first()
    assert got[0] == 1 and got[1] == pytest.approx(0.9, abs=0.15) and got[2] == pytest.approx(0.5, abs=0.25) and got[3] < 0.3


def test_no_python_on_the_native_path(spark):
    plan = fingerprints.fingerprints(nasty.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards(spark):
    rows = nasty.rows()
    got = sharding.shard_by_bytes(nasty.frame(spark), 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, before = sum(size(r[1]) for r in rows), 0
    line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    slots = Counter()
    for r in line:
        assert r["byte_start"] == before and r["slot"] == slots[r["shard"]] and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total))
        slots[r["shard"]] += 1
        before += r["size"]


def test_shards_are_balanced(spark):
    rng = random.Random(2)
    df = nasty.docs(spark, [nasty.words(rng, rng.randrange(0, 60)) for _ in range(5000)])
    got = sharding.shard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n"), F.max("size").alias("w")).collect()
    target = sum(r["s"] for r in got) / 16
    assert len(got) == 16 and all(abs(r["s"] - target) <= r["w"] and r["m"] == r["n"] - 1 for r in got)


def brute_print(text, k):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    seen = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if seen[b] * 2 > len(s))


def groups(prints, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    rows = [(r[0], r[1]) for r in nasty.rows()]
    prints = [brute_print(t, 3) for _, t in rows]
    of = groups(prints, 3)
    least = {g: min((i for (i, _), h in zip(rows, of, strict=True) if h == g and i is not None), default=None) for g in set(of)}
    got = simhash.near_duplicates(nasty.frame(spark)).collect()
    assert Counter(map(tuple, got)) == Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, of, strict=True))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_links_are_all_links(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(40)} | {0, (1 << 64) - 1, 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 160)}}


@pytest.mark.parametrize("f", [fingerprints.fingerprints, sharding.shard_by_bytes, simhash.near_duplicates, simhash.one_of_each])
def test_empty_table(spark, f):
    assert f(nasty.frame(spark, [])).count() == 0


def plain_shingles(text, k):
    """The set of runs of k words, by a plain split at the six signs of white space."""
    w, word = [], ""
    for c in (text or "").translate({c: c + 32 for c in range(65, 91)}) + " ":
        if c in " \t\n\x0b\x0c\r":
            w, word = w + [word] * bool(word), ""
        else:
            word += c
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def similar_groups(texts, k=5):
    """Each text's group: all pairs whose sets of shingles have a Jaccard similarity of 0.8 or more, or are equal."""
    sets = [plain_shingles(t, k) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if s == t or 5 * len(s & t) >= 4 * len(s | t):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def first_of_each(rows, k=5):
    """The smallest id of each group of (id, text); None only if a group has no other."""
    of = similar_groups([t for _, t in rows], k)
    return [min((i for (i, _), h in zip(rows, of, strict=True) if h == g and i is not None), default=None) for g in set(of)]


def test_one_of_each(spark):
    df = nasty.frame(spark)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first_of_each([(r[0], r[1]) for r in nasty.rows()]))


def test_repeated_rows_that_differ_elsewhere_give_one_row_every_time(spark):
    rows = [(1, "a b c d e f", f"s{i % 7}") for i in range(50)] + [(2, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 3, 8):
        assert sorted(map(tuple, simhash.one_of_each(df.repartition(n)).collect())) == [(1, "a b c d e f", "s0"), (2, "x y", None)]


@pytest.mark.parametrize("most", [0, 3, 9])
def test_crossing_finds_all_similar_pairs_of_different_roots(spark, most):
    """Against all pairs: groups around common sets, with roots that join parts of them; a hot root takes half of all."""
    rng = random.Random(most)
    sets, rooted = [], []
    for g in range(4):
        base = rng.sample(range(10**6), 60)
        for i in range(40):
            s = set(base) - set(rng.sample(base, rng.randrange(most + 1))) | {rng.randrange(10**6) for _ in range(rng.randrange(most + 1))}
            sets.append(frozenset(s if i % 9 else list(s)[: rng.randrange(1, 60)]))
            rooted.append(g * 1000 + (0 if i % 2 else i))
    sets, rooted = zip(*dict(zip(sets, rooted, strict=True)).items(), strict=True)
    held = spark.createDataFrame([(i, len(s), r) for i, (s, r) in enumerate(zip(sets, rooted, strict=True))], "node long, size int, root long")
    whole = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, set array<bigint>")
    got = {tuple(sorted((r["node"], r["other"]))) for r in jaccard.crossing(held, whole, (4, 5)).collect()}
    alike = lambda s, t: 5 * len(s & t) >= 4 * len(s | t)
    want = {(a, b) for b in range(len(sets)) for a in range(b) if rooted[a] != rooted[b] and alike(sets[a], sets[b])}
    assert want <= got and len(got) <= max(40, 4 * len(want)) and (want or not most)


def test_near_copies_go_and_others_stay(spark):
    """Copies with a similarity of 0.8 to 1 on five-word shingles, against documents of like words."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=400) for _ in range(60)]
    near = []
    for w in base[:30]:
        copy = list(w)
        for at in rng.sample(range(400), rng.choice([1, 3, 6])):
            copy[at] = "changed"
        near.append(copy)
    texts = [" ".join(w) for w in base + near]
    kept = {r["doc_id"] for r in simhash.one_of_each(nasty.docs(spark, texts)).collect()}
    assert kept >= set(range(60)) and len(kept) <= 62


def test_near_copies_by_exact_similarity(spark):
    """Pairs a little above and below 0.8, and a group of near copies, against all pairs' Jaccard."""
    rng = random.Random(21)
    texts = []
    for changes in list(range(2, 14)) * 8:
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([8, 60, 200]))]
        copy = list(w)
        for at in rng.sample(range(len(w)), min(len(w), changes * len(w) // 300)):
            copy[at] = "changed"
        texts += [" ".join(w), " ".join(copy) + rng.choice(["", " tail", " tail " * (changes * len(w) // 100)])]
    base = [f"b{i}" for i in range(100)]
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 5)):
            copy[at] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    kept = {r["doc_id"] for r in simhash.one_of_each(nasty.docs(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_variants_are_not_broadcast(spark):
    plan = planned(simhash.links(written(spark.range(50).select(F.xxhash64("id").alias("fp")))))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_bands_and_tokens_are_not_broadcast(spark):
    nodes = written(spark.range(50).selectExpr("id AS node", "5 AS size", "id AS root", "id % 7 AS key", "sequence(id, id + 4) AS set"))
    assert "BroadcastHashJoin" not in planned(jaccard.to_pivots(nodes.select("node", "size", "key")))
    assert "BroadcastHashJoin" not in planned(jaccard.crossing(nodes.select("node", "size", "root"), nodes.select("node", "set"), (4, 5)))
