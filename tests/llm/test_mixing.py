import re
from collections import defaultdict

import pytest
from conftest_llm import rows
from pyspark.sql import functions as F

from loomslice.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Fill all, stop those that are above twice their size, deal the rest again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        own = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if own[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | own
        fixed |= {s: cap * sizes[s] for s in over}
        if len(fixed) == len(order):
            return fixed


def check(out, data, rare=0):
    """Per document against brute force; per source the words taken against its target."""
    sizes = defaultdict(int)
    for _, text, source in data:
        sizes[source] += len(WORD.findall(text or ""))
    goals = brute_targets(dict(sizes))
    got = out.collect()
    assert len(got) == len(data)
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["size"]) for r in got) == sorted((i is not None, i, len(WORD.findall(t or ""))) for i, t, _ in data)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goals[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= longest[s] * (1 + rare), (s, taken[s], goal)


def test_query(spark, sf, docs):
    out = queries.op9_mix(spark, sf)
    check(out, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert rows(out) == rows(queries.op9_mix(spark, sf))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, None: 100}, {"a": 1}, {"a": 0, "b": 5}, {"x": 1000, "y": 1, "z": 1, "q": 3, "r": 50}, {None: 7, "": 9}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_many_sources_and_a_hot_one(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{i % 40}" if i % 3 else "hot") for i in range(3000)]
    check(mixing.mix_report(spark.createDataFrame(data, "doc_id long, text string, source string")), data)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    data = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 4}" if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = rows(mixing.mix_report(df))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows(mixing.mix_report(df)) == want


def test_budgets_nest(spark):
    """All that a smaller share takes, a larger one takes as well."""
    data = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    small, large = ({r["doc_id"]: r["copies"] for r in mixing.mix_report(df, share=s).collect()} for s in (0.5, 0.8))
    assert all(large[i] >= n for i, n in small.items()) and sum(large.values()) > sum(small.values())


def test_mix_repeats_rows_as_the_report_says(docs):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_report(docs).where("copies > 0").collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_odd_rows(odd, clashing, none):
    out = mixing.mix_report(odd)
    check(out, [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], rare=3)  # repeated rows go together
    assert rows(mixing.mix_report(clashing)) == rows(out)
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(clashing).columns == clashing.columns


def test_null_texts_without_ansi(spark, odd):
    """A null text has no words in either mode."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        got = []
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            got.append(rows(mixing.mix_report(odd)))
        assert got[0] == got[1] and all(r["size"] >= 0 for r in mixing.mix_report(odd).collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
