import json
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomslice.llm import _tokens, queries, token_files

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name):
    """The library as it is loaded."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return plain(request.param), _tokens.TextEncoder(public_tokenizers.path(request.param))


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", *" \t\n\r\x0b\x0c  \x1c\x85'sdlmtve.,#019aZéΣσςß<|>"])), max_size=60).map("".join))
def test_remembered_pieces_encode_alike(both, text):
    want, enc = both
    assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == want(text)


@pytest.mark.parametrize("name", FILES)
def test_special_strings(name):
    """They are tokens as the library has it; as ordinary text if asked for."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    text = "a <|endoftext|> b<|endoftext|>"
    for as_text in (False, True):
        t.encode_special_tokens = as_text
        enc = _tokens.TextEncoder(public_tokenizers.path(name), as_text)
        assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert max(np.frombuffer(_tokens.TextEncoder(public_tokenizers.path(name)).encode([text.encode()])[0], "<u4")) == t.get_vocab_size() - 1


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([" ", " ", "\n", ".", ",", "a", "B", "é", "É", "ß", "×", "'s", "7", "(", '"', "word", "\t", "œ"]), max_size=30).map("".join), max_size=6))
def test_texts_encode_together_alike(both, texts):
    """Simple texts are cut as one array; borders, runs of white space and marks around words don't change ids."""
    want, enc = both
    for text, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == want(text)


def test_slices_have_all_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(_tokens, "_TOGETHER", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 4, None, "", "b" * 40, "c" * 6, "é" * 3, "d"]})
    slices = list(_tokens.together(batch, 0))
    assert [t for s in slices for t in s.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [s.num_rows for s in slices] == [3, 1, 1, 2]
    assert list(_tokens.together(batch.slice(0, 0), 0)) == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(_tokens, "MEMORY", 20_000)
    enc = _tokens.TextEncoder(public_tokenizers.path(FILES[1]))
    for i in range(2000):
        enc.encode([f"word{i} other{i}".encode(), b"x" * 5000])
        assert sum(len(k) + len(v) + _tokens._ENTRY for k, v in enc.memory.items()) <= 20_000


def test_whole_documents_encode_alike(both, docs):
    want, enc = both
    texts = [r["text"] or "" for r in docs.select("text").limit(60).collect()]
    for text, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == want(text)


def brute(pairs, name="byte_bpe_50k.json", end=2):
    enc, out, at = plain(name), [], 0
    for doc, text in pairs:
        ids = np.array(enc(text or "") + [end], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_is_brute_force(spark, sf, docs):
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert rows(queries.op3_token_files(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == brute(pairs)


def test_odd_rows(spark, odd, clashing, none, tmp_path):
    folder = token_files.write_tokens(odd, f"file://{tmp_path}/a")
    got = token_files.read_tokens(spark, folder, with_ids=True).orderBy("start").collect()
    key = lambda t: (t[0] is not None, t[0] or 0)
    assert [r["doc_id"] for r in got] == [d for d, _ in sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=key)]
    enc, want = plain("byte_bpe_50k.json"), {}
    for r in odd.collect():
        want.setdefault(r["doc_id"], []).append(enc(r["text"] or "") + [2])
    assert all(r["ids"] in want[r["doc_id"]] for r in got)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert rows(token_files.read_tokens(spark, token_files.write_tokens(clashing))) == rows(token_files.read_tokens(spark, token_files.write_tokens(odd)))
    assert token_files.read_tokens(spark, token_files.write_tokens(none)).count() == 0


def test_files_are_flat_and_map(spark, docs, tmp_path):
    """The files alone, as memory maps, give every document back; bases are prefix sums."""
    folder = token_files.write_tokens(docs, f"file://{tmp_path}/flat")
    index = json.loads((tmp_path / "flat/index.json").read_text())
    base, seen = 0, []
    for s in index["shards"]:
        assert s["base"] == base
        tokens = np.memmap(tmp_path / f"flat/tokens-{s['name']}.bin", "<u2", "r")
        offsets = np.memmap(tmp_path / f"flat/offsets-{s['name']}.bin", "<i8", "r")
        assert offsets[0] == 0 and offsets[-1] == len(tokens) == s["tokens"] and len(offsets) == s["docs"] + 1
        seen += [int(tokens[b - 1]) for b in offsets[1:]]
        base += s["tokens"]
    assert base == index["tokens"] and seen == [2] * docs.count()
    assert all(os.path.getsize(p) % 2 == 0 for p in (tmp_path / "flat").glob("tokens-*"))
    wide = token_files.write_tokens(docs, f"file://{tmp_path}/wide", width=32)
    assert rows(token_files.read_tokens(spark, wide)) == rows(token_files.read_tokens(spark, folder))


def test_ranges_of_a_file(tmp_path, monkeypatch):
    """What isn't mounted is read by ranges, to the same numbers."""
    from pyarrow import fs

    np.arange(50, dtype="<u2").tofile(tmp_path / "a.bin")
    mapped, n = token_files._opened(fs.LocalFileSystem(), f"{tmp_path}/a.bin", "<u2")
    read, m = token_files._opened(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "a.bin", "<u2")
    assert n == m == 50 and mapped(3, 40).tolist() == read(3, 40).tolist() == list(range(3, 40))
