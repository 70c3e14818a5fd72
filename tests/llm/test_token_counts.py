import public_tokenizers
import pytest
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from loomslice.llm import queries, token_counts

PIECES = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.6, "ab": -3.1, "aba": -4.2, "▁ab": -3.4, "bab": -4.0, "c": -5.0, "é": -6.0}


def brute(pieces, word):
    """Tokens of the best split of one word, without any sharing; ties go to the fewer tokens."""
    s, unknown = token_counts.MARK + word, min(pieces.values()) - 10
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        ways = [(best[i - 1][0] + unknown, -(best[i - 1][1] + len(s[i - 1].encode())))]
        ways += [(best[j][0] + pieces[s[j:i]], -(best[j][1] + 1)) for j in range(i) if s[j:i] in pieces]
        score, n = max(ways)
        best.append((score, -n))
    return best[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcéx\U0001f600", min_size=1, max_size=12), min_size=1, max_size=20))
def test_shared_trie_is_brute_force(words):
    trie = token_counts.SharedTrie(PIECES)
    assert [trie.count(w.encode()) for w in words] == [brute(PIECES, w) for w in words]


def test_each_prefix_is_scored_once():
    trie = token_counts.SharedTrie(PIECES)
    for w in ("abab", "abac", "aba", "abab"):
        trie.count(w.encode())
    assert len(trie.char) - 1 == len({(token_counts.MARK + w)[:n] for w in ("abab", "abac", "aba") for n in range(1, 6) if n <= len(w) + 1})


@pytest.fixture(scope="module")
def pieces():
    return token_counts.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_query_is_brute_force(spark, sf, docs, pieces):
    memory, want = {}, []
    longest = max(map(len, pieces))

    def one(w):
        if w not in memory:
            s, best = token_counts.MARK + w, [(0.0, 0)]
            for i in range(1, len(s) + 1):
                ways = [(best[i - 1][0] + min_score, -(best[i - 1][1] + len(s[i - 1].encode())))]
                ways += [(best[j][0] + pieces[s[j:i]], -(best[j][1] + 1)) for j in range(max(0, i - longest), i) if s[j:i] in pieces]
                score, n = max(ways)
                best.append((score, -n))
            memory[w] = best[-1][1]
        return memory[w]

    min_score = min(pieces.values()) - 10
    for r in docs.collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        want.append((r["doc_id"], len(words), sum(map(one, words))))
    assert rows(queries.op5_token_counts(spark, sf), "doc_id", "n_words", "n_tokens") == sorted(want)


def test_clearing_the_trie_changes_nothing(docs, monkeypatch):
    want = rows(token_counts.count_tokens(docs))
    monkeypatch.setattr(token_counts, "MAX_NODES", 500)
    assert rows(token_counts.count_tokens(docs)) == want


def test_odd_rows(odd, clashing, none):
    got = rows(token_counts.count_tokens(odd))
    assert len(got) == odd.count() and {r[1:] for r in got if r[0] in (-5, -2, 1, 4)} == {(0, 0)}
    assert rows(token_counts.count_tokens(clashing)) == got
    assert token_counts.count_tokens(none).count() == 0


def test_a_long_word_is_brute_force_without_nodes(monkeypatch):
    trie = token_counts.SharedTrie(PIECES)
    word = "ababécxab" * 400
    assert trie.count(word.encode()) == brute(PIECES, word) and len(trie.char) == 1
    monkeypatch.setattr(token_counts, "_LONGEST", 1)
    short = token_counts.SharedTrie(PIECES)
    for w in ("a", "ab", "babab", "xcé", "abac" * 30):
        assert short.count(w.encode()) == brute(PIECES, w)


def test_a_text_of_many_words_stays_within_the_nodes(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_NODES", 500)
    trie = token_counts.SharedTrie(PIECES)
    for i in range(3000):
        trie.count(f"{i}ab".encode())
        assert len(trie.char) <= 500 + token_counts._LONGEST
