import random
import re

import pytest
import xxhash
from conftest_llm import rows

from loomslice.llm import queries, simhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_print(text, size):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in SPACE.split(lower) if w]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def brute_components(prints, limit):
    """Least id reachable by links of at most ``limit`` bits, by comparing all pairs."""
    ids = sorted(prints)
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: root(i) for i in ids}


def test_query_is_brute_force(spark, sf, docs):
    prints = {r["doc_id"]: brute_print(r["text"], 3) for r in docs.collect()}
    comps = brute_components(prints, 2)
    got = rows(queries.op10_simhash(spark, sf), "doc_id", "fingerprint", "component_id")
    assert got == sorted((i, f"{p:016x}", comps[i]) for i, p in prints.items())
    assert len(set(comps.values())) < len(comps)


@pytest.mark.parametrize("joined", [1, 4, 1000])
def test_close_prints_link_in_crowded_and_calm_blocks(spark, monkeypatch, joined):
    """Chains of prints two bits apart and ones three bits away, with blocks joined or grouped."""
    monkeypatch.setattr(simhash, "_JOINED", joined)
    rng = random.Random(3)
    prints = {}
    for base in range(12):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints[len(prints)] = p
            for k in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                p ^= 1 << k
    comps = brute_components(prints, 2)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    reps = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "rep long, l0 long")
    found = simhash.components(simhash.links(reps, simhash.exact_keys(2), 2))
    named = {r["node"]: r["component"] for r in found.collect()}
    assert {i: named.get(i, i) for i in prints} == comps


def test_odd_rows(odd, none, clashing):
    got = rows(simhash.simhash_report(odd), "doc_id", "fingerprint")
    want = [(r["doc_id"], f"{brute_print(r['text'], 3):016x}") for r in odd.collect()]
    assert got == sorted(want, key=lambda t: [(x is not None, x) for x in t])
    assert rows(simhash.simhash_report(clashing)) == rows(simhash.simhash_report(odd))
    assert simhash.simhash_report(none).count() == 0
    empty = [r["component_id"] for r in simhash.simhash_report(odd).where("doc_id in (-5, -2, 1, 4)").collect()]
    assert empty == [-5] * 4  # null, empty and blank texts share fingerprint zero


def test_long_paths_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict((r["node"], r["component"]) for r in simhash.components(edges).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_wide_mode_finds_near_copies_and_keeps_one(spark):
    """A share of five-word shingles of 0.8 and more links; of 0.5 doesn't."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    data, groups = [], {}
    for g in range(30):
        base = rng.choices(words, k=400)
        for c in range(3):
            text = list(base)
            for at in rng.sample(range(400), c * 4):  # 8 words: 40 shingles of 396 on either side, a similarity of 0.82
                text[at] = rng.choice(words)
            data.append((len(data), " ".join(text)))
            groups[len(data) - 1] = g
        half = base[:200] + rng.choices(words, k=200)
        data.append((len(data), " ".join(half)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    linked = sum(comp[i] == comp[min(j for j in groups if groups[j] == g)] for i, g in groups.items())
    assert linked >= 0.97 * len(groups)
    assert all(comp[i] == i for i in comp if i not in groups)
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == {i for i in comp if comp[i] == i}


def test_crowded_wide_blocks(spark, monkeypatch):
    """With every block grouped, links come from pivots and tiles and are as good as all pairs."""
    monkeypatch.setattr(simhash, "_PAIRED", 1)
    monkeypatch.setattr(simhash, "_TILE", 8)
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(500)], k=300)
    data = []
    for i in range(40):
        text = list(base)
        for at in rng.sample(range(300), rng.choice((0, 1, 2, 30))):
            text[at] = f"n{i}"
        data.append((i, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = simhash.near_duplicates(df).collect()
    prints = {r["doc_id"]: sum((r[f"l{k}"] & (1 << 64) - 1) << 64 * k for k in range(12)) for r in out}
    block = lambda p, k: p >> 16 * k & 0xFFFF
    ids, at = sorted(prints), {i: i for i in prints}

    def root(i):
        return i if at[i] == i else root(at[i])

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            p, q = prints[i], prints[j]
            if (p ^ q).bit_count() <= round(768 * 0.172) and any(block(p, k) == block(q, k) for k in range(48)):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: root(i) for i in ids}


def test_keep_one_keeps_columns_and_null_ids(odd, clashing, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1  # the other one's text is empty, as others' are
    assert simhash.keep_one(none).count() == 0
    wide = simhash.keep_one(clashing)
    assert wide.columns == clashing.columns and wide.count() == kept.count()


def jaccard(a, b):
    """Similarity of two texts' sets of five-word shingles, by words."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_repeated_lines_do_not_outweigh_content(spark):
    """Different documents that repeat one line stay apart; the same shingles with a line more often or less are one group."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    line = " ".join(rng.choices(words, k=8))
    different = [(i, " ".join(rng.choices(words, k=30)) + f" {line}" * 10 + " " + " ".join(rng.choices(words, k=30))) for i in range(40)]
    body = " ".join(rng.choices(words, k=60))
    same = [(100, body + f" {line}" * 2), (101, body + f" {line}" * 40)]
    assert max(jaccard(different[0][1], t) for _, t in different[1:]) < 0.3 and jaccard(same[0][1], same[1][1]) == 1
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(different + same, "doc_id long, text string")).collect()}
    assert comp == {**{i: i for i in range(40)}, 100: 100, 101: 100}


def test_pairs_at_the_limit_are_found_and_ones_below_are_not(spark):
    """320 of 400 shingles in common link, 319 of 401 don't."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(20000)]
    data = []
    for i in range(300):
        same = 320 if i < 200 else 319
        base = rng.choices(words, k=364)
        data += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: same + 4] + rng.choices(words, k=360 - same)))]
    assert jaccard(data[0][1], data[1][1]) == 0.8 > jaccard(data[400][1], data[401][1])
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert comp == {i: i - i % 2 if i < 400 else i for i in comp}


def test_keep_one_keeps_texts_of_their_own(spark):
    """Rows that share an id are told apart; rows without one are deduplicated after the others."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    data = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, "zz " + b[:30]), (None, "zz " + b[:30])]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (-1, "zz " + b[:30])])
