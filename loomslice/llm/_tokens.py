"""Whole texts to token ids by the tokenizers library, with a memory of pieces that were met before.

A text splits into pieces that the tokenizer treats apart, so equal pieces have equal ids. The splits
hold for the two kinds of tokenizer that are recognised; any other gets whole texts. The pieces of many
texts are cut and numbered as arrays, and each distinct one is looked up once.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of pieces and their ids that a worker process remembers, the dictionary's own share included.
MEMORY = 40_000_000
#: What a remembered piece takes besides its own bytes, and the longest piece worth it.
_ENTRY, _LONGEST = 150, 64
#: Marks of pieces that were met before, a byte each; they start anew once a quarter of them is set.
_MET = 1 << 21
#: Bytes of texts that are encoded together.
_TOGETHER = 3_000_000
#: A space belongs to the word after it; of a longer run, all but the last character are one piece.
_BYTE_PIECES = re.compile(rb" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+(?![^\x20\x09-\x0d])|[\x20\x09-\x0d]")
#: White space beyond ASCII, which the split above doesn't know.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPLIT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return table


#: What the two kinds' own patterns come to on ASCII text.
_ASCII_BYTES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


#: The kind of each byte: letter or digit (of UTF-8's longer forms only those that start with C3), space, stop or comma, other
#: mark, or one that keeps a text from being cut by bytes.
_LETTER, _SPACE, _STOP, _MARK, _ODD = b"a .!~"
_KINDS = bytes(
    _SPACE if b in b" \n" else _STOP if b in b".," else _LETTER if 128 <= b < 192 or b == 0xC3 or chr(b).isalnum() and b < 128 else _ODD if b > 127 or 9 <= b <= 13 or 28 <= b <= 31 else _MARK for b in range(256)
)


def _simple(text: bytes) -> bool:
    """Whether the text may be cut by bytes: valid, no letters but ASCII's and those of C3, no white space but spaces and line ends, at most two together and one at the end."""
    kinds = text.translate(_KINDS)
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return not (b"~" in kinds or b"   " in kinds or kinds.endswith(b"  ") or b"\xc3\x97" in text or b"\xc3\xb7" in text)


class _Memory(dict):
    """Pieces' ids; one that is missing is learnt, and a short one that was met before is kept until the memory's bytes are used up.

    Most distinct pieces of a large text are met once; without them there is room for those that come again.
    """

    def __init__(self, owner: TextEncoder):
        self.owner, self.room = owner, MEMORY
        self.met, self.n_met = bytearray(_MET), 0

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.owner.learn(piece)
        self.keep(piece, ids)
        return ids

    def keep(self, piece: bytes, ids: bytes) -> None:
        mark = hash(piece) % _MET
        if not self.met[mark]:
            if self.n_met >= _MET // 4:
                self.met, self.n_met = bytearray(_MET), 0
            self.met[mark] = 1
            self.n_met += 1
        elif len(piece) <= _LONGEST:
            own = _ENTRY + len(piece) + len(ids)
            if self.room < own:
                self.clear()
                self.room = MEMORY
            self.room -= own
            self[piece] = ids


class TextEncoder:
    """encode(list of UTF-8 bytes) gives, per text, its ids as little-endian unsigned 32-bit bytes.

    A special token's string within a text is that token, as the library has it by default; with plain=True
    it is ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.encode_special_tokens = plain
        added = self.tk.get_added_tokens_decoder().values()
        # texts with one of these go to the library whole; a token sought after normalisation can be there in many forms
        self.marks = [t.content.encode() for t in added if not (plain and t.special)]
        self.model, self.memory, self.letters = self.tk.model, _Memory(self), _byte_letters()
        self.alphabet = "".join(self.letters[b] for b in range(256))
        self.kind = "whole" if any(t.normalized and not (plain and t.special) for t in added) else self._kind()

    def _kind(self) -> str:
        state = lambda part: json.loads(part.__getstate__()) if part is not None else None
        pre, norm = state(self.tk.pre_tokenizer) or {}, state(self.tk.normalizer)
        if type(self.model).__name__ != "BPE" or self.model.dropout or self.tk.truncation:
            return "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return "bytes"
        if norm and pre.get("type") == "Sequence":
            steps = [n.get("type") for n in norm.get("normalizers", [])]
            first, *rest = pre.get("pretokenizers", [{}])
            split = first.get("pattern", {}).get("Regex") == _SPLIT_WORDS and first.get("invert") and first.get("behavior") == "Removed"
            if steps == ["NFC", "Replace", "Lowercase"] and split and [r.get("type") for r in rest] == ["ByteLevel"] and not rest[0].get("use_regex") and not rest[0].get("add_prefix_space"):
                return "words"
        return "whole"

    def _plain(self, piece: str) -> str | None:
        """The piece as one run of letters in the model's own letters, or None if it isn't certain to be one."""
        if self.kind == "words":
            if "Σ" in piece or not unicodedata.is_normalized("NFC", piece):
                return None
            piece = piece.lower()
        if not (piece[1:] if piece[:1] == " " and self.kind == "bytes" else piece).isalpha():
            return None
        return piece.encode().decode("latin-1").translate(self.letters)

    def _ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def learn(self, piece: bytes) -> bytes:
        """The ids of a piece that isn't in memory yet."""
        if not piece:
            return b""
        memory, body = self.memory, piece[:-1] if piece[-1:] in (b".", b",") else piece
        if piece.isascii():
            if self.kind == "words":
                if body.isalpha() and body is piece:
                    return self._ids(piece.decode().lower())
                parts = _ASCII_WORDS.findall(piece.decode().lower())
            else:
                if piece.isalpha():
                    return self._ids(piece.decode())
                if piece[:1] == b" " and piece[1:].isalpha():
                    return self._ids("Ġ" + piece[1:].decode())
                if body is not piece and body[-1:].isalpha():
                    return memory[body] + memory[piece[-1:]]
                parts = _ASCII_BYTES.findall(piece.decode())
            if len(parts) > 1:
                return b"".join([memory[p.encode()] for p in parts])
            return self._ids(parts[0].encode().decode("latin-1").translate(self.letters)) if parts else b""
        try:
            plain = self._plain(body.decode())
        except UnicodeDecodeError:
            plain = None
        if plain is not None:
            return self._ids(plain) if body is piece else memory[body] + memory[piece[-1:]]
        return self._whole(piece)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.kind == "whole":
            return [array("I", e.ids).tobytes() for e in self.tk.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        cut = bytes.split if self.kind == "words" else self._byte_pieces
        get = self.memory.__getitem__
        out: list[bytes] = []
        simple = []
        for t in texts:
            if any(m in t for m in self.marks):
                out.append(self._whole(t))
            elif _simple(t) and not any(m.lower() in t.lower() for m in self.marks):  # lower case must not make a mark
                simple.append(len(out))
                out.append(t)
            else:
                out.append(b"".join(map(get, cut(t))))
        for i, ids in zip(simple, self._together([out[i] for i in simple])):
            out[i] = ids
        return out

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that may be cut by bytes.

        A piece starts at each text, space and line end, after a line end, and where a stop or comma between a letter or digit and a
        space ends a word. All these are cuts of both kinds of tokenizer.
        """
        whole = b"".join(texts)
        if not whole:
            return [b""] * len(texts)
        if self.kind == "words":
            whole = whole.decode().lower().encode()  # these letters keep their lengths
        ends = np.cumsum([len(t) for t in texts])
        kinds = np.frombuffer(whole.translate(_KINDS), np.uint8)
        starts = kinds == _SPACE
        starts[1:-1] |= (kinds[1:-1] == _STOP) & (kinds[:-2] == _LETTER) & starts[2:]
        starts[1:] |= np.frombuffer(whole, np.uint8)[:-1] == 10
        starts[0] = True
        starts[ends[ends < len(whole)]] = True
        cuts = np.flatnonzero(starts)
        bounds = np.append(cuts, len(whole)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]).dictionary_encode()
        found = self._look_up(pieces.dictionary)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.cumsum(sizes) - sizes
        number = pieces.indices.to_numpy()
        n = sizes[number]
        until = np.cumsum(n)
        kind = np.int32 if until[-1] < 1 << 31 else np.int64
        place = np.repeat((at[number] - until + n).astype(kind), n)
        place += np.arange(until[-1], dtype=kind)
        ids = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        last = 4 * np.append(0, until)[np.searchsorted(cuts, ends)]
        return [ids[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist())]

    def _look_up(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each of the distinct pieces of simple texts; most that aren't in memory are a run of letters."""
        _, bounds, data = pieces.buffers()
        at, data = np.frombuffer(bounds, np.int32, len(pieces) + 1).tolist(), data.to_pybytes()
        distinct = [data[a:b] for a, b in zip(at, at[1:])]
        if self.kind == "words":
            distinct = [p.strip() for p in distinct]
        memory, tokenize, decode, alphabet = self.memory, self.model.tokenize, codecs.charmap_decode, self.alphabet
        found = list(map(memory.get, distinct))
        for i, piece in enumerate(distinct):
            if found[i] is None:
                if piece[piece[:1] == b" " :].decode().isalpha():
                    found[i] = ids = array("I", [t.id for t in tokenize(decode(piece, "strict", alphabet)[0])]).tobytes()
                    memory.keep(piece, ids)
                else:
                    found[i] = memory[piece]
        return found

    def _whole(self, text: bytes) -> bytes:
        return array("I", self.tk.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _byte_pieces(self, text: bytes) -> list[bytes]:
        if not text.isascii() and _WIDE_SPACE.search(text.decode("utf-8", "replace")):
            return [text]
        if any(c in text for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
            return [text]
        return _BYTE_PIECES.findall(text)


def together(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices with few bytes of texts each, or a single long one."""
    ends, i = np.cumsum(pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while i < batch.num_rows:
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + _TOGETHER, "right")))
        yield batch.slice(i, j - i)
        i = j


def encoder(path: str, plain: bool = False) -> TextEncoder:
    """The worker process's encoder for a tokenizer file."""
    return kept(("encoder", path, plain), lambda: TextEncoder(path, plain))


def public_path(name: str) -> str:
    """Where the installed public tokenizers have a file; asked for on the executor that opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolve(path: str) -> str:
    """A tokenizer parameter: a file's path, or ``public:NAME`` for a file of the installed package."""
    return public_path(path[7:]) if path.startswith("public:") else path
