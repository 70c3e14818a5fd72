import hashlib

import compare
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from loomslice.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """What turn_report has to read back: turns is a list of (turn, role, text)."""
    order = sorted(turns, key=lambda t: tuple((x is not None, x) for x in (t[0], t[1] or "", t[2] or "")))
    said = [(r or "", t or "") for _, r, t in order]
    loss = "".join(t for r, t in said if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss)


def check(spark, data):
    got = rows(chat.turn_report(chat.format_conversations(spark.createDataFrame(data, SCHEMA))), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    by = {}
    for conv, *rest in data:
        by.setdefault(conv, []).append(tuple(rest))
    assert got == sorted(((c, *brute(t)) for c, t in by.items()), key=lambda t: [(x is not None, x) for x in t])


def test_query_against_sql(spark, sf):
    assert compare.same(queries.op4_chat_format(spark, sf), compare.duck(sf), queries.ORACLE["op4_chat_format"]) == ""


def test_own_conversation_and_columns(spark, sf):
    out = queries.op4_chat_format(spark, sf)
    assert {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"} <= set(out.columns)
    r = out.where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


TEXT = st.text(st.sampled_from(list("ab\\#<>:|/turn \nhlbcΩ\U0001f600")), max_size=12)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "### ", ": ", "a\\b", "</turn>", "", None]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 9)), ROLE, st.one_of(st.none(), TEXT, st.sampled_from(["</turn>\n", "<|>", "\\l", "\\\\b", "### user: "]))), min_size=1, max_size=40))
def test_any_text_comes_back(spark, data):
    check(spark, data)


def test_odd_rows(spark):
    long = [(5, i, "assistant" if i % 3 else "user", f"turn {i} " * 20) for i in range(2000)]
    check(spark, [(1, None, None, None), (1, None, None, None), (None, 1, "assistant", "x"), (None, 0, "user", ""), (2, 0, "assistant", "a" * 200_000), *long])
    assert chat.turn_report(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], SCHEMA)
    more = df.select("*", F.lit(1).alias("row"), F.lit(2).alias("turns"), F.lit(3).alias("TEXT"), F.lit(4).alias("m"))
    assert rows(chat.format_conversations(more)) == rows(chat.format_conversations(df))


def test_format_merges_neighbours_and_spans_cover_answers(spark):
    data = [(1, 0, "user", "a#"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c<"), (1, 3, "user", "d")]
    r = chat.format_conversations(spark.createDataFrame(data, SCHEMA)).first()
    assert r["formatted"] == "### user: a\\h</turn>\n### assistant: b<|>c\\l</turn>\n### user: d</turn>\n" and r["n_blocks"] == 3
    assert [r["formatted"][s["start"] : s["end"]] for s in r["spans"]] == ["b", "c\\l"]
