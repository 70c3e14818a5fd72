import hashlib
import struct

import xxhash
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomslice.llm import fingerprint as fp
from loomslice.llm import queries

LINE = st.text("abc d", min_size=1, max_size=3)


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", fp.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]


def test_query_edits_whole_texts(spark, sf, docs):
    data = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = []
    for k, (i, text) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        n = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    out = queries.op2_multiset_hash(spark, sf).toPandas().sort_values("doc_id")
    assert list(zip(out.doc_id, out.n_chars, out.edited_sha256)) == want
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    assert out.near_edited.mean() > 0.5 and out.near_next.median() < 0.3
    by_text = {}
    for i, f in zip(out.doc_id, out.fingerprint):
        by_text.setdefault(dict(data)[i], set()).add(f)
    assert all(len(x) == 1 for x in by_text.values())
    assert (out.near_edited[out.fingerprint == out.edited_fingerprint] == 1).all()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(LINE, max_size=6), st.lists(LINE, max_size=6), st.randoms()), min_size=1, max_size=15))
def test_sums_are_homomorphic(spark, cases):
    """Any order, insertion and deletion give what hashing the lines anew gives."""
    data = []
    for a, b, rng in cases:
        shuffled = a + b
        rng.shuffle(shuffled)
        data.append(("\n".join(a), "\n".join(b), "\n".join(shuffled)))
    df = spark.createDataFrame(data, "a string, b string, ab string").select(*[fp.fingerprint(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    out = df.select("a", "b", "ab", fp.insert(F.col("a"), F.col("b")).alias("sum"), fp.delete(F.col("ab"), F.col("b")).alias("rest")).collect()
    for r in out:
        assert r["sum"] == r["ab"] and r["rest"] == r["a"]


def test_lanes_wrap_modulo_powers(spark):
    """So many copies that every lane overflows: the lanes are the sum modulo 2**20, here computed apart."""
    one, many = prints(spark, ["line", "\n".join(["line"] * 5000)])
    for a, b in zip(one[:-1], many[:-1]):
        for k in (0, 21, 42):
            assert (b >> k) & 0xFFFFF == 5000 * ((a >> k) & 0xFFFFF) % (1 << 20)
    assert many[-1] == 5000


def test_multisets_differ(spark):
    texts = ["a\nb", "b\na", "a\na\nb", "a\nb\nb", "ab", "", "\n\n", "a\n\nb"]
    f = prints(spark, texts)
    assert f[0] == f[1] == f[7] and f[5] == f[6]
    assert len({tuple(x) for x in f}) == 5


def test_likeness_follows_the_share_in_common(spark):
    import random

    rng, data = random.Random(1), []
    for share in (0.0, 0.5, 0.9):
        for _ in range(20):
            lines = [f"{rng.random()}" for _ in range(40)]
            other = lines[: int(40 * share)] + [f"{rng.random()}" for _ in range(40 - int(40 * share))]
            data.append((share, "\n".join(lines), "\n".join(other)))
    df = spark.createDataFrame(data, "share double, a string, b string").select("share", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("x"))
    for r in df.groupBy("share").agg(F.avg("x").alias("x")).collect():
        assert abs(r["x"] - r["share"]) < 0.12


def test_odd_rows(spark, odd, clashing, none):
    out = fp.edit_report(odd)
    assert out.count() == odd.count() and fp.edit_report(none).count() == 0
    got = rows(out.where("doc_id is not null"), "doc_id", "n_chars")
    assert got == rows(odd.where("doc_id is not null").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")))
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    assert rows(fp.edit_report(clashing), *cols) == rows(out, *cols)
    alone = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")  # the first follows the last, here itself
    assert fp.edit_report(alone).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def brute(text):
    """LONGS longs of three lanes and the count, as the module's docstring has it."""
    lines = [p for p in (text or "").split("\n") if p]
    lanes = [0] * (3 * fp.LONGS)
    for p in lines:
        for k in range(fp.LONGS):
            own = xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k >> 1), 42)) >> (10 * (k % 2))
            for j in range(3):
                lanes[3 * k + j] = (lanes[3 * k + j] + (own >> 21 * j & 1023)) % (1 << 20)
    return lanes, len(lines)


def centred(lanes, n):
    half = 1 << 20
    return [(2 * x - 1023 * n + half) % (2 * half) - half for x in lanes]


def test_report_is_brute_force(spark, sf, docs):
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in queries.op2_multiset_hash(spark, sf).collect()}
    prints = [brute(t) for _, t in texts]
    for (i, t), a, b, (_, after) in zip(texts, prints, prints[1:] + prints[:1], texts[1:] + texts[:1]):
        cut = len(t) // 4
        edited = brute(t[: len(t) - cut] + after[:cut])
        for x, name in ((a, "fingerprint"), (edited, "edited_fingerprint")):
            assert got[i][name] == "".join(f"{x[0][3 * k] | x[0][3 * k + 1] << 21 | x[0][3 * k + 2] << 42:016x}" for k in range(fp.LONGS)) + f"{x[1]:010x}"
        for y, name in ((edited, "near_edited"), (b, "near_next")):
            u, v = centred(*a), centred(*y)
            own = sum(p * p + q * q for p, q in zip(u, v))
            want = 1.0 if a == y else min(1.0, max(0.0, 2 * sum(p * q for p, q in zip(u, v)) / own)) if own else 0.0
            assert abs(got[i][name] - want) < 1e-9
