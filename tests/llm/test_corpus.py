"""op5, op8 and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearwin.llm import mixing, spans, toxicity
from nearwin.llm.queries import OP8_SQL
from nearwin.llm.tables import table
from nearwin.plans.shared import written
from tests.conftest import DATA
from tests.llm import nasty
from tests.llm.test_hashes import first_of_each


def brute_spans(rows):
    """(n_sentences, removed places) of each (id, text), by looking up every span's first place."""
    first, split = {}, []
    for i, t in rows:
        parts, found = spans.spans(t or "")
        split.append((parts, found))
        for at, n, h in found:
            first[h] = min(first.get(h, (i, at)), (i, at))
    out = []
    for (i, _), (parts, found) in zip(rows, split, strict=True):
        out.append((len(parts), {k for at, n, h in found if first[h] != (i, at) for k in range(at, at + n)}, parts))
    return out


def test_sentences_join_to_the_text():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab .!?\n\t") for _ in range(rng.randrange(60)))
        assert "".join(spans.spans(text)[0]) == text


def test_span_dedup(spark):
    rng = random.Random(8)
    passage = "This long passage stands in many documents. It has three sentences or more. Each of them has some words in it. And it goes on for a while."
    one = " ".join(f"w{k}" for k in range(45)) + "."
    texts = [nasty.words(rng, 60) + ".\n" + (passage if i % 3 == 0 else "") + (f"\n{one}\n" if i % 4 == 0 else "") + nasty.words(rng, 30) for i in range(40)]
    texts += [texts[5], None, "", passage + "\n" + passage, "Short. Line."] * 2
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in spans.span_dedup(nasty.docs(spark, texts)).collect()}
    for (i, t), (n, gone, parts) in zip(rows, brute_spans(rows), strict=True):
        assert got[i]["n_sentences"] == n and got[i]["n_removed"] == len(gone)
        assert got[i]["text"] == (None if t is None else "".join(p for k, p in enumerate(parts) if k not in gone))
    assert sum(passage in (r["text"] or "") for r in got.values()) == 1 and sum(one in (r["text"] or "") for r in got.values()) == 1


def own_sentences(text):
    """Sentences found character by character: up to the last of a run of ending signs, or a line's end, and white space after it."""
    ends = {chr(c) for a, b in spans.TERMINALS for c in range(a, b + 1)}
    out, now, state = [], "", "in"
    for c in text:
        if (state == "end" and c not in ends and not c.isspace()) or (state == "gap" and not c.isspace()):
            out, now, state = [*out, now], "", "in"
        now += c
        if state == "end" and c.isspace():
            state = "gap"
        elif state == "in" and (c in ends or c == "\n"):
            state = "end" if c in ends else "gap"
    return [*out, now] if now else out


def test_sentences_of_all_scripts():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("ab .!?\n\t。！？।؟漢字") for _ in range(rng.randrange(40)))
        assert spans.SENTENCE.findall(text) == own_sentences(text)


def test_passages_without_spaces_and_full_stops_are_found(spark):
    """Sentences that end in signs of their script, with no white space after them."""
    rng = random.Random(12)
    said = lambda n: "".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(14)) + rng.choice("。！？") for _ in range(n))
    passage = said(8)
    texts = [said(20) + passage + said(15), said(12), said(9) + passage + said(3)]
    got = {r["doc_id"]: r for r in spans.span_dedup(nasty.docs(spark, texts)).collect()}
    assert [got[i]["n_sentences"] for i in range(3)] == [43, 12, 20] and [got[i]["n_removed"] for i in range(3)] == [0, 0, 8]
    assert got[2]["text"] == texts[2].replace(passage, "")


def test_span_dedup_edges(spark):
    df = nasty.frame(spark)
    assert spans.span_dedup(df).count() == df.count() and spans.span_dedup(nasty.frame(spark, [])).count() == 0
    kept = spans.deduplicated(df)
    assert kept.columns == df.columns and kept.filter("text IS NULL").count() == df.filter("text IS NULL").count()


def brute_targets(sizes):
    """Targets by sharing the excess over and over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix(spark, block):
    got = mixing.mix(nasty.frame(spark), block).collect()
    rows = nasty.rows()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert taken == {(sizes[s], round(target[s], 6)): math.floor(target[s] + 0.5) for s in sizes}
    assert sorted(map(tuple, mixing.mix(nasty.frame(spark).repartition(3), block).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_schedule_is_low_discrepancy(spark):
    df = nasty.docs(spark, ["a b c d e f g h"] * 300, source=[("x", "y", "z")[i % 3] for i in range(300)])
    rows = written(mixing.measured(df, "doc_id", "text", "source"))
    sources = written(mixing.targets(rows.groupBy("source").agg(F.sum("size").alias("size"))))
    got = [r["src"] for r in mixing.schedule(sources, 4).orderBy("slot").collect()]
    share = {r["src"]: r["target"] for r in sources.collect()}
    total, seen = sum(share.values()), Counter()
    for k, s in enumerate(got, 1):
        seen[s] += 1
        assert all(abs(seen[x] - k * share[x] / total) < 6 for x in share)


def test_mix_edges(spark):
    assert mixing.mix(nasty.frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(nasty.docs(spark, ["", None])).orderBy("doc_id").collect()] == [(0, 0, 0, 0.0, 0, None), (1, 0, 0, 0.0, 0, None)]
    plan = mixing.mix(nasty.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixture_rows_hold_the_taken_words(spark):
    df = nasty.frame(spark)
    rows = mixing.mixture(df)
    assert rows.columns == df.columns
    words = rows.select(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in mixing.mix(df).collect())
    assert rows.filter("n_chars <> char_length(text)").count() == 0


def test_mixture_follows_the_schedule(spark):
    """Rows in the order of their slots, and every stretch from the start near the target shares of words."""
    rng = random.Random(13)
    df = nasty.docs(spark, [nasty.words(rng, rng.randrange(1, 60)) for _ in range(900)], source=[rng.choice("xxxyz") for _ in range(900)])
    rows = mixing.mixture(df, 16).collect()
    first = {r["doc_id"]: r for r in mixing.mix(df, 16).collect()}
    slots, seen = [], Counter()
    for r in rows:
        slots += [first[r["doc_id"]]["first_slot"]] if not seen[r["doc_id"]] else []
        seen[r["doc_id"]] += 1
    assert slots == sorted(slots) and {i for i, r in first.items() if r["first_slot"] is not None} == set(seen)
    targets = {r["source"]: r["target"] for r in mixing.targets(written(mixing.measured(df, "doc_id", "text", "source")).groupBy("source").agg(F.sum("size").alias("size"))).collect()}
    total, words = sum(targets.values()), Counter()
    for r in rows:
        words[r["source"]] += len(r["text"].split())
        assert all(abs(words[s] - sum(words.values()) * t / total) < 16 * 8 + 120 for s, t in targets.items())


def test_sql_of_the_mix(spark):
    """Also targets that need more than a pass, and blocks that a short last pass ends in."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(OP8_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.mix(table(spark, DATA, "documents")).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3]) and a[4:] == b[4:]


def test_pipeline_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = docs
        docs = written(stage(spark, given, DATA))
        assert docs.columns == columns, name
        if name == "simhash near-dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in given.collect())
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(first_of_each(rows))
        if name == "substring dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in given.collect())
            left = {i: "".join(p for k, p in enumerate(parts) if k not in gone) for (i, _), (_, gone, parts) in zip(rows, brute_spans(rows), strict=True)}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: t for i, t in left.items() if t.strip()}
    assert before > docs.select("doc_id").distinct().count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.filter("piece = 0").count() == docs.count()


def test_spans_of_short_sentences_and_cut_passages(spark):
    """Repeats of one-word sentences, of lines without spaces, and passages pasted in the middle of sentences go."""
    rng = random.Random(9)
    shout = " ".join(f"Word{k}!" for k in range(60))
    lines = "\n".join("漢字かなの長い行" + chr(0x4E00 + 7 * k) for k in range(12)) + "\n"
    whole = "The second sentence of it has seventeen words in all and stands between two that are cut."
    passage = " ".join(f"p{k}" for k in range(18)) + ". " + whole + " " + " ".join(f"q{k}" for k in range(20))
    own = lambda: " ".join(f"o{rng.randrange(10**9)}" for _ in range(9))
    texts = [f"{own()}.\n{x}\n{own()}." for x in (shout, lines) for _ in range(2)] + [f"{own()} {passage} {own()}." for _ in range(2)]
    got = {r["doc_id"]: r["text"] for r in spans.span_dedup(nasty.docs(spark, texts)).collect()}
    for i in (0, 2, 4):
        assert got[i] == texts[i]
    assert "Word" not in got[1] and "漢字" not in got[3]
    assert whole not in got[5] and "p17" in got[5] and "q0" in got[5]


def test_spans_cover_every_long_enough_run():
    rng = random.Random(10)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "bb ", "c. ", "d.\n", "e! ", "f " * 9]) for _ in range(rng.randrange(60)))
        parts, found = spans.spans(text)
        said = [(k, p.strip()) for k, p in enumerate(parts) if p.strip()]
        size = [max(s.count(" ") + 1, len(s.encode()) // spans.WORD_BYTES) for _, s in said]
        for i in range(len(said)):
            for j in range(i + 1, len(said) + 1):
                if sum(size[i:j]) >= spans.LONG or j - i >= spans.RUN and sum(size[i:j]) >= spans.LEAST:
                    inside = [(at, at + n) for at, n, _ in found if at >= said[i][0] and at + n <= said[j - 1][0] + 1]
                    assert all(any(a <= k < b for a, b in inside) for k, _ in said[i:j])


def test_columns_of_any_name_stay(spark):
    """Columns named as the operators' own are passed on as they are."""
    df = nasty.frame(spark)
    rest = [c for c in df.columns if c not in ("text", "n_chars")]
    given = {tuple(r) for r in df.select(*rest).collect()}
    for out in (spans.deduplicated(df), mixing.mixture(df), toxicity.clean_only(df, spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int"))):
        assert out.columns == df.columns and {tuple(r) for r in out.select(*rest).collect()} <= given
