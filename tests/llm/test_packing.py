"""Packing: places against the library's ids, and the number of sequences against bounds."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tectra.llm import common, packing
from tests.conftest import DATA

LIMIT = 2048


def expected_pieces(df):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for key, text in df.select("doc_id", "text").collect():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % LIMIT or LIMIT
        ends = [first, *range(first + LIMIT, len(ids) + 1, LIMIT)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            out.append((key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_places(spark, odd, table):
    df = odd if table == "odd" else common.table(spark, f"{DATA}/sf0.001", "documents")
    rows = packing.packed(df.repartition(6)).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == expected_pieces(df)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for found in sequences.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at <= LIMIT
    lower = -(-sum(r.length for r in rows) // LIMIT)
    assert lower <= len(sequences) <= lower + max(2, lower // 100)


def test_empty(empty):
    assert packing.packed(empty).count() == 0


def held(plan, n):
    counts = np.zeros(n, np.int64)
    for config, k in plan.items():
        assert k > 0 and sum(size * a for size, a in config) < n
        for size, a in config:
            counts[size] += a * k
    return counts


def fewest(items, room):
    """By trying every place for every item."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= room:
                bins[j] += items[k]
                go(k + 1, bins)
                bins[j] -= items[k]
        go(k + 1, [*bins, items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_near_the_fewest(items):
    counts = np.bincount(items, minlength=21).astype(np.int64)[:21] if items else np.zeros(21, np.int64)
    plan, bound = packing.packing_plan(counts)
    assert (held(plan, 21) == counts).all()
    least = fewest(items, 20)
    assert bound <= least <= sum(plan.values()) <= least + 1


def test_program_beats_best_fit():
    """Lengths for which best fit is far from good: the program comes within 3 percent of the bound, whatever the number."""
    sizes = np.random.default_rng(1).integers(500, 1100, 4000)
    for times in (1, 10_000):
        counts = np.bincount(sizes, minlength=LIMIT + 1) * times
        plan, bound = packing.packing_plan(counts)
        assert (held(plan, LIMIT + 1) == counts).all()
        alone = sum(packing.best_fit({}, counts).values())
        assert sum(plan.values()) < 0.97 * alone and sum(plan.values()) < 1.06 * bound


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=12, max_size=12))
def test_knapsack(prices):
    prices = np.array([0.0, *prices])
    best, last = packing.knapsack(prices)
    for room in range(13):
        ways = (sum(prices[list(c)]) for k in range(room + 1) for c in itertools.combinations_with_replacement(range(1, 13), k) if sum(c) <= room) if room <= 7 else ()
        if room <= 7:
            assert abs(best[room] - max(ways)) < 1e-9
        if last[room]:
            assert abs(best[room] - best[room - last[room]] - prices[last[room]]) < 1e-9
