import random
import re

import pytest
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomslice.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at, covered = {}, set()
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query_is_brute_force(spark, sf, docs):
    out = queries.op6_vote_rules(spark, sf)
    assert rows(out, *COLS) == sorted((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    assert out.where("base_failed and kept").count() == 0 and out.where("kept").count() > 0.3 * docs.count()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab \n\t\x0b#|é ")), max_size=60), min_size=1, max_size=30))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows(rules.rule_report(df), *COLS) == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_odd_rows(odd, clashing, none):
    got = rows(rules.rule_report(odd), *COLS)
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in odd.collect()), key=lambda t: [(x is not None, x) for x in t])
    assert got == want
    assert rows(rules.rule_report(clashing), *COLS) == got
    assert rules.rule_report(none).count() == 0 and rules.keep_good(none).count() == 0
    assert rules.keep_good(clashing).columns == clashing.columns


def test_keep_good_and_report_agree(docs):
    kept = {r["doc_id"] for r in rules.rule_report(docs).where("kept").collect()}
    assert {r["doc_id"] for r in rules.keep_good(docs).collect()} == kept


def brute_em(patterns, prior=0.01, rounds=100):
    """The same estimate row by row, with probabilities instead of log odds."""
    votes = [p for p, n in patterns for _ in range(n)]
    right = dict.fromkeys(votes[0], rules._START)
    for _ in range(rounds):
        hit, cast = dict.fromkeys(right, 0.0), dict.fromkeys(right, 0.0)
        for p in votes:
            good = bad = 0.5
            for r, v in p.items():
                if v:
                    good *= right[r] if v > 0 else 1 - right[r]
                    bad *= right[r] if v < 0 else 1 - right[r]
            g = good / (good + bad)
            for r, v in p.items():
                if v:
                    hit[r] += g if v > 0 else 1 - g
                    cast[r] += 1
        extra = prior * len(votes)
        right = {r: min(0.999, max(0.5, (hit[r] + rules._START * extra) / (cast[r] + extra))) for r in right}
    return right


def test_expectation_maximisation_is_brute_force():
    rng = random.Random(2)
    patterns = {}
    for _ in range(600):
        truth = rng.choice((1, -1))
        p = tuple((r, 0 if rng.random() < 0.3 else truth if rng.random() < a else -truth) for r, a in (("a", 0.95), ("b", 0.9), ("c", 0.8), ("d", 0.6)))
        patterns[p] = patterns.get(p, 0) + 1
    pairs = [(dict(p), n) for p, n in patterns.items()]
    model, want = rules.fit(pairs), brute_em(pairs)
    assert model.right == pytest.approx(want, abs=1e-6)
    assert model.right["a"] > model.right["c"] > model.right["d"]  # the better a rule, the higher its accuracy
    assert model.right["a"] == pytest.approx(0.95, abs=0.05) and model.right["c"] == pytest.approx(0.8, abs=0.08)


def test_posterior_column_is_the_models(spark):
    model = rules.VoteModel(right={"a": 0.9, "b": 0.6})
    df = spark.createDataFrame([(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)], "a int, b int")
    for r in df.withColumn("p", model.column({"a": F.col("a"), "b": F.col("b")})).collect():
        assert r["p"] == pytest.approx(model.posterior({"a": r["a"], "b": r["b"]}))


def test_no_single_fault_outweighs_good_prose(spark):
    clean = " ".join(f"river{i} stone{i % 37} cloud{i * 7 % 101} walked" for i in range(60)) + "."
    junk = " ".join("#$%& !!! ||| <<>>" for _ in range(60)) + " " + " ".join(f"<{i}>" for i in range(60))
    df = spark.createDataFrame([(i, clean + f" end{i}") for i in range(30)] + [(100 + i, junk + f" <{i}>") for i in range(5)], "doc_id long, text string")
    assert {r["doc_id"] for r in rules.rule_report(df).where("kept").collect()} == set(range(30))


def test_empty_model():
    assert rules.fit([]).posterior({"a": 1}) > 0.5 > rules.fit([]).posterior({"a": -1})


@pytest.mark.parametrize("share", [1, 4, 20])
def test_single_faults_are_rejected_however_rare(spark, share):
    """Of 400 documents, share with each of four single faults, 20 short ones, and the rest without fault."""
    rng = random.Random(share)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    prose = lambda n=120: " ".join(word() for _ in range(n))
    faulty = {
        "capitals": lambda: prose().upper(),
        "shouting": lambda: " ".join(word() + "!" * (i % 2) for i in range(120)),
        "letters": lambda: " ".join(word()[:4] + str(rng.randrange(100, 10**4)) for _ in range(120)),
        "lines": lambda: "\n".join([prose(60) for _ in range(5)] + ["two words"] * 5),
    }
    data, want = [], {}
    for name, make in faulty.items():
        for _ in range(share):
            want[len(data)] = name
            data.append((len(data), make()))
    data += [(1000 + i, prose(20)) for i in range(20)] + [(2000 + i, prose()) for i in range(400 - len(data) - 20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    s = rules.statistics(F.col("text"))
    voted = df.select("doc_id", *[c.alias(r) for r, c in rules.votes(s).items()]).where("doc_id < 1000").collect()
    assert all([r for r in rules.votes(s) if v[r] < 0] == [want[v["doc_id"]]] for v in voted)
    assert {r["doc_id"] for r in rules.rule_report(df).where("kept").collect()} == {i for i, _ in data if i >= 2000}
