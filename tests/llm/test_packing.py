import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomslice.llm import packing, queries


def check(out, data, capacity=2048, waste=0.05):
    """Every id in one piece, sequences gapless and within the capacity, little padding."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in data:
        want[(i, np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    pieces, own = defaultdict(list), defaultdict(list)
    for r in out.collect():
        assert 0 < r["length"] <= capacity
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
        own[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
    for seq in pieces.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= capacity
    for (i, ids), n in want.items():
        got = own[(i, len(ids) // 4)]
        spans = Counter(got)
        expected = [(a, len(ids[4 * a : 4 * (a + capacity)]) // 4, zlib.crc32(ids[4 * a : 4 * (a + capacity)])) for a in range(0, len(ids) // 4, capacity)]
        assert all(spans[x] >= n for x in expected)
    total = sum(len(ids) // 4 * n for (_, ids), n in want.items())
    assert sum(length for seq in pieces.values() for _, length in seq) == total
    assert len(pieces) <= max(1, -(-total // capacity)) * (1 + waste) + 1
    return len(pieces), total


def test_query(spark, sf, docs):
    check(queries.op8_pack(spark, sf), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd, clashing, none):
    check(packing.pack(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert rows(packing.pack(clashing), "doc_id", "start", "length", "ids_crc32") == rows(packing.pack(odd), "doc_id", "start", "length", "ids_crc32")
    assert packing.pack(none).count() == 0


def first_fit(demand, capacity):
    bins = []
    for s in sorted((s for s, n in demand.items() for _ in range(n)), reverse=True):
        k = next((k for k, r in enumerate(bins) if r >= s), None)
        if k is None:
            bins.append(capacity)
            k = len(bins) - 1
        bins[k] -= s
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=12))
def test_cutting_stock_places_all(demand):
    patterns = packing.cutting_stock(demand, 32)
    got = Counter()
    for p, n in patterns:
        assert n > 0 and sum(s * k for s, k in p.items()) <= 32
        for s, k in p.items():
            got[s] += n * k
    assert got == Counter(demand)
    used, least = sum(n for _, n in patterns), -(-sum(s * n for s, n in demand.items()) // 32)
    assert least <= used <= first_fit(demand, 32) + len(demand)
    rows_, n = packing.places(patterns)
    assert n == used
    for s, k in demand.items():
        spans = sorted((a, b) for size, a, b, *_ in rows_ if size == s)
        assert spans[0][0] == 0 and spans[-1][1] == k and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_beats_first_fit_where_it_wastes():
    """Sizes of which first-fit leaves a sixth empty and the linear program nothing to speak of."""
    demand = {51: 600, 27: 600, 26: 600, 23: 1200}
    used = sum(n for _, n in packing.cutting_stock(demand, 100))
    assert used <= first_fit(demand, 100) and used <= -(-sum(s * n for s, n in demand.items()) // 100) * 1.1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0.01, 1)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(1, 14))
def test_knapsack_is_brute_force(items, capacity):
    sizes, values = np.array([s for s, _ in items]), np.array([v for _, v in items])

    def best(room):
        return max([0.0, *[v + best(room - s) for s, v in items if s <= room]])

    value, chosen = packing.price(values, sizes, capacity)
    assert value == pytest.approx(best(capacity)) and sum(sizes[k] for k in chosen) <= capacity
    assert sum(values[k] for k in chosen) == pytest.approx(value)


def test_many_lengths(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choices(["stone", "river", "cloud"], k=int(rng.paretovariate(0.8) * 20) % 6000))) for i in range(1500)]
    n, total = check(packing.pack(spark.createDataFrame(data, "doc_id long, text string")), data, waste=0.02)
    assert total / (2048 * n) > 0.97


def test_capacity_must_be_on_the_grid(none):
    with pytest.raises(ValueError):
        packing.pack(none, capacity=100)
    with pytest.raises(ValueError):
        packing.cutting_stock({5: 1}, 4)


def test_linear_program_is_near_its_bound():
    """On a wide histogram: no more than rounding over what the lengths need, and in little time."""
    import time

    rng = random.Random(1)
    demand = Counter(packing.rounded(min(2048, int(rng.lognormvariate(5, 1.2)) + 1)) for _ in range(60_000))
    began = time.process_time()
    used = sum(n for _, n in packing.cutting_stock(demand, 2048))
    assert time.process_time() - began < 30
    assert used <= -(-sum(s * n for s, n in demand.items()) // 2048) * 1.01 + 2
