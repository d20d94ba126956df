"""Top-k search, conversation repair and phrase mining against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from nearwin.llm import conversations, phrases, topk
from tests.llm import nasty

# --- top-k search


def brute_top_k(rows, queries, k, scale=256.0):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * x) for x in v]
    found = []
    for qid, q in queries:
        if qid is None or not ok(q):
            continue
        scores = [(-sum(a * b for a, b in zip(whole(q), whole(v), strict=False)), i is None, i or 0) for i, v in rows if ok(v) and i != qid]
        found += [(qid, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


def vectors(seed=3, n=90):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(rng.choice([6, 6, 6, 3]))]) for i in range(n)]
    rows += [(100, None), (150, [1.0, None, 0.0]), (200, [float("nan")] * 3), (250, [float("inf"), 1.0]), (300, []), (None, [0.5] * 6), (None, rows[0][1])]
    return rows + [rows[0], (0, [2.0] * 6), (50, rows[50][1]), (-50, rows[7][1]), (50 * 7, [0.0] * 6)]


def test_top_k(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, block string, score int").repartition(3)
    for blocks in ((topk.BLOCK, topk.ASKED), (7, 2)):
        slim = df.selectExpr("vec_id AS id", "embedding AS v").filter(topk.usable(topk.F.col("v")))
        got = topk.search(topk.index(slim, 256.0, blocks[0]), topk.asking(slim.filter("id % 50 = 0"), 256.0, blocks[1]), 5)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top_k(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 300)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top_k(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 300)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).collect() == []


def test_top_k_large_components(spark):
    """Scores past 32 bits, and past what a double holds exactly, are exact."""
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, -1.0]), (2, [3.0e6, 1.0]), (3, [-3.0e6, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0")).collect()), key=repr) == brute_top_k(rows, rows[:1], 5)
    big = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.top_k(big, big).collect()


# --- conversation repair

FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_edits(rows):
    """(cost, letters, lines) of the cheapest edits of (initial, role, text, truncated, gone), of equal ones the least letters."""

    @lru_cache(maxsize=None)
    def rest(i, state, inserts):
        out = []
        if i == len(rows):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            initial, role, text, cut, gone = rows[i]
            out.append(more(rest(i + 1, state, 0), 3, "D", ()))
            if not gone:
                if to := FOLLOWS.get((state, initial)):
                    out.append(more(rest(i + 1, to, 0), cut, "K", (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    if to := FOLLOWS.get((state, new[0])):
                        out.append(more(rest(i + 1, to, 0), 2 + cut, "R", (f"{new}:{text}",)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if to := FOLLOWS.get((state, new[0])):
                    out.append(more(rest(i, to, inserts + 1), 2, "I", (f"{new}:",)))
        return min(out, default=(10**9, "", ()))

    def more(found, cost, letter, line):
        return found[0] + cost, letter + found[1], line + found[2]

    return rest(0, "", 0)


def brute_repair(turns, ids):
    out = []
    for conv in {*ids, *(t[0] for t in turns)}:
        of = [(t is not None, t or 0, " " if r is None else r, hashlib.md5((" " if x is None else x).encode()).hexdigest(), t, " " if x is None else x) for c, t, r, x in turns if c == conv]
        of.sort(key=lambda r: r[:4])
        seen, rows, counts = set(), [], Counter()
        for _, _, role, _, _, text in of:
            said = text.strip(" \t\n\x0b\x0c\r")
            blank, again = not said, (role, text) in seen
            cut = not blank and not again and said[-1] not in ".!?"
            counts.update({"blank": blank, "duplicate": again and not blank, "truncated": cut})
            seen.add((role, text))
            rows.append((role[:1], role, text, int(cut), blank or again))
        known = [r[4] for r in of if r[4] is not None]
        pairs = [a[0] + b[0] for a, b in zip(rows, rows[1:], strict=False)]
        cost, letters, lines = brute_edits(tuple(rows))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n, most):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", None, "said " * rng.randrange(1, 4) + ".", "é!", "x" + str(turn), f"No. {turn}."])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sudo", "User"] if turn else ["system", "user"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
            if rng.random() < 0.1:
                rows += [rows[-1]] * rng.randrange(1, 3)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, kind int, digest string, part int").repartition(5)


@pytest.mark.parametrize("stretch", [conversations.STRETCH, 2])
def test_repair(spark, stretch):
    rows = talks(5, 60, 9)
    ids = spark.createDataFrame([(1000,), (3,)], "conv_id long")
    got = conversations.repair(frame(spark, rows), ids, stretch=stretch)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repair(rows, {1000, 3})


def test_repair_of_long_and_repeated_turns(spark):
    """A conversation over many runs and partitions, one turn very often, and a very long text."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}"])) for t in range(400)]
    rows += [(2, 0, "user", "again.")] * 300 + [(2, 1, "assistant", "w " * 600_000 + "."), (2, 2, "user", "again.")]
    got = conversations.repair(frame(spark, rows), stretch=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repair(rows, set())


def test_repair_other_key_kinds_and_empty(spark):
    got = conversations.repair(spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in got] == [("a", 0, "KK")]
    assert conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_damage(spark):
    rows = talks(6, 40, 9)
    want = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        fate, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    got = [tuple(r) for r in conversations.damaged(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_layers_are_the_cheapest_ways():
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 10]) for _ in range(rng.randrange(7)))
        rows = tuple(("suax"[c & 3], "suax"[c & 3], "", int(c & 4 > 0), c >= 8) for c in codes)
        found = conversations.layers(codes, conversations.FINISH, 1)
        letters, end = conversations.trace(codes, found, 0)
        cost, want, _ = brute_edits(rows)
        assert (len(found) - 1, letters + "I" * (conversations.FINISH[end] // 2)) == (cost, want)
        if codes:  # runs cut anywhere cost the same together
            at = rng.randrange(len(codes))
            ends = conversations.FINISH
            for part in (codes[at:], codes[:at]):
                ways = conversations.crossing(part) if part else [0 if i % 5 == 0 else conversations.NEVER for i in range(16)]
                ends = [min(ways[4 * s + to] + ends[to] for to in range(4)) for s in range(4)]
            assert ends[0] == cost


# --- phrase mining


def brute_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in some.items():
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        around = [b for (other, *more), b in some.items() if other == lang and len(more) > len(words) and any(more[i : i + len(words)] == words for i in range(len(more)))]
        if not any(100 * b >= 50 * a for b in around):
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, phrase, l, r in out:  # noqa: E741
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def phrase_rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["New", "york", "CITY", "of", "the", "É", "é", "a b", "x\u0085", "漢字", "\u0000", "-"])
    rows = [("".join(word() + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", "; "]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", None, "und", "de"])) for _ in range(60)]
    return rows + [(None, "en"), ("", None), (" \t", "de"), ("the the the the the", "en"), ("new york city " * 3000, "en"), ("...", "en"), rows[0], rows[0]]


@pytest.mark.parametrize(("least", "longest", "top"), [(10, 3, 2000), (2, 3, 7), (4, 5, 50), (3, 2, 20)])
def test_collocations(spark, least, longest, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "p", 0) for r in rows], "text string, lang string, n int, phrase string, a int").repartition(4)
    got = phrases.collocations(df, least, longest, top)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, longest, top)


def test_collocations_with_a_full_bit_table_and_small_parts(spark, monkeypatch):
    """Phrases that get a bit by chance, and texts that are counted in many parts, change nothing."""
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    monkeypatch.setattr(phrases, "SLICE", 50)
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), 3, 3, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 3, 3, 100)
    parts = list(phrases.slices([b"ab.cd ef.gh", b"x" * 9], 4))
    assert len(parts) > 2 and sorted(p for part in parts for p in part.split(b".") if p) == [b"ab", b"cd ef", b"gh", b"x" * 9]


def test_collocations_exact_beyond_64_bits(spark):
    levels = {1: spark.createDataFrame([("e", "a", 3 * 10**12), ("e", "b", 4 * 10**12)], "lang string, phrase string, n long"), 2: spark.createDataFrame([("e", "a b", 2 * 10**12 + 1)], "lang string, phrase string, n long")}
    row = phrases.cut_scores(levels[2], 2, levels).first()
    assert row.score == 1_000_000 * (2 * 10**12 + 1) ** 2 // (12 * 10**24)


def test_collocations_empty_and_nasty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    got = phrases.collocations(nasty.frame(spark), 3, 3, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases([(r[1], r[2]) for r in nasty.rows()], 3, 3, 100)
