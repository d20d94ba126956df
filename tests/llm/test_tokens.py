"""op6, op10: ids as the library gives them, exact round trips, and packings that hold every piece once."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearwin.llm import arrowstream, packing
from nearwin.llm.queries import tokenizer_path
from nearwin.llm.tables import table
from nearwin.llm.tokens import encoder
from tests.conftest import DATA
from tests.llm import nasty

SIGNS = "abcXYZ'st 0123  ́é\n\t\x0b\x1c\x85.!?<|endoftext|>ΣßİǅÅ漢字🙂‍​#$%&*)ªºⅷ²"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS), max_size=40), max_size=6))
def test_encoder_is_the_tokenizer(texts):
    e = encoder(tokenizer_path())
    counts, flat = e.encode([t.encode() for t in texts], 2)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert flat[at : at + n].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        at += n


def expected(rows, end):
    e = encoder(tokenizer_path())
    return [(i, [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_places(spark):
    rows = sorted(((r[0], r[1]) for r in nasty.rows()), key=lambda r: (-(1 << 63) if r[0] is None else r[0], zlib.crc32((r[1] or "").encode())))
    got = arrowstream.token_places(nasty.frame(spark), tokenizer_path()).collect()
    want, at = [], 0
    for i, ids in expected(rows, 2):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert arrowstream.token_places(nasty.frame(spark, []), tokenizer_path()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=12), st.integers(1, 7), st.integers(1, 3))
def test_stream_file(sizes, length, rows):
    runs = [np.arange(n, dtype=np.uint16) + 10 * k for k, n in enumerate(sizes)]
    sink = pa.BufferOutputStream()
    out = arrowstream.StreamWriter(sink, pa.uint16(), length, rows)
    for r in runs:
        out.add(r)
    out.close()
    got, flat = arrowstream.Sequences(sink.getvalue()), np.concatenate([*runs, np.zeros(0, np.uint16)])
    assert len(got) == -(-len(flat) // length)
    at = 0
    for r in runs:
        assert got.span(at, len(r)).tolist() == r.tolist()
        at += len(r)
    for i in range(len(got)):
        real = flat[i * length : (i + 1) * length]
        assert got.ids(i)[: len(real)].tolist() == real.tolist() and got.mask(i).sum() == len(real)
        assert not got.ids(i).flags.owndata


def check_packing(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(spark):
    got = packing.pack(nasty.frame(spark), tokenizer_path(), capacity=512).collect()
    want = Counter()
    for i, ids in expected([(r[0], r[1]) for r in nasty.rows()], 1):
        for p, at in enumerate(range(0, len(ids), 512)):
            want[i, p, at, len(ids[at : at + 512]), crc(ids[at : at + 512])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    n = check_packing(got, 512)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // 512) + 1
    assert packing.pack(nasty.frame(spark, []), tokenizer_path()).count() == 0


def test_knapsack_is_optimal():
    """Each room's value against all multisets of lengths, and the rows through each length against the value."""
    rng = random.Random(5)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(2, 12), 4)))
        prices = np.array([rng.random() for _ in lengths])
        best, first = packing.knapsack(lengths, prices, 20)
        grid = np.stack(np.meshgrid(*(np.arange(20 // k + 1) for k in lengths), indexing="ij")).reshape(4, -1)
        for room in range(21):
            assert best[room] == pytest.approx((prices @ grid)[lengths @ grid <= room].max())
        for at, row in enumerate(packing.through(lengths, first, 20)):
            assert row[0] == lengths[at] and row.sum() <= 20
            assert sum(prices[list(lengths).index(k)] for k in row if k) == pytest.approx(prices[at] + best[20 - lengths[at]])


def test_program_is_fractional_and_bounded(spark):
    """Columns and what is open are all pieces; the bound is under the sequences, and within 1 % of them on real lengths."""
    lengths = packing.token_pieces(table(spark, DATA.replace("sf0.001", "sf0.01"), "documents"), tokenizer_path(), 1, 4096, "doc_id", "text").groupBy("length").count()
    counts = {r["length"]: r["count"] for r in lengths.collect()}
    found, held = packing.program(counts), Counter()
    for column, times in found.columns.items():
        assert times > 0 and sum(column) <= 4096
        for k in column:
            held[k] += times
    for k, n in counts.items():
        assert held[k] + found.open.get(k, 0) == pytest.approx(n)
    assert sum(found.columns.values()) > 0.05 * found.bound
    sequences = sum(times for times, _ in packing.configurations(counts))
    assert found.bound <= sequences <= 1.01 * found.bound + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
def test_configurations_hold_everything(counts):
    held, bins = Counter(), 0
    for times, config in packing.configurations(counts, 64):
        assert times > 0 and sum(k * c for k, c in config.items()) <= 64
        bins += times
        for k, c in config.items():
            held[k] += c * times
    assert held == Counter(counts)
    lower = max(-(-sum(k * n for k, n in counts.items()) // 64), sum(n for k, n in counts.items() if k > 32))
    assert bins <= 1.5 * lower + 2 and packing.program(counts, 64).bound <= bins + 1e-6
