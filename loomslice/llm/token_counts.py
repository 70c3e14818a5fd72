"""Token counts of texts under a unigram model, by dynamic programming shared over a trie.

Distinct pre-tokens (words with a leading mark) go into a trie. The best score of a prefix depends on the
prefix alone, so it is computed once per trie node, for all pre-tokens that share it; a node where a
pre-token ends stores its score and token count, and a text's count is the sum over its pre-tokens.

The pieces and scores are those of a public vocabulary: if it has ranks instead of log probabilities, a
piece's score is that of Zipf's law at its rank. A character that no piece covers costs as many tokens as
it has UTF-8 bytes. Each worker process keeps one trie, shared by all its tasks, and starts a new one
when it has too many nodes, which changes the speed and not the counts. There is no shuffle.

A null text and one without words have no tokens. Null ids are kept, repeated rows repeat, an empty table
gives no rows. Whole texts are read; a pre-token of over 256 characters doesn't enter the trie, which few
share, but is scored by the same program with the last positions alone in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, pick, tidy
from ._tokens import resolve

MARK = "▁"
#: Nodes at which a worker starts a new trie, some 200 bytes each.
MAX_NODES = 400_000
#: Characters of the longest pre-token that enters the trie.
_LONGEST = 256


def unigram_pieces(path: str) -> dict[str, float]:
    """Piece to log probability, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
    ranks = sorted(scores.values(), reverse=True)
    if ranks and all(float(s).is_integer() for s in ranks):
        total = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
        scores = {p: -math.log(1 - s) - total for p, s in scores.items()}
    return scores


class SharedTrie:
    """counts(word) by one forward score per trie node. pieces: piece to log probability."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        # a piece's characters, last first, so that the pieces that end at a node are one walk back
        self.ends: dict = {}
        for piece, score in pieces.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = score
        self.clear()

    def clear(self) -> None:
        # child nodes, character, parent, best score and its tokens, by node
        self.child: list[dict[str, int]] = [{}]
        self.char, self.up, self.score, self.tokens = [""], [-1], [0.0], [0]
        self.words: dict[bytes, int] = {}

    def _grow(self, parent: int, c: str) -> int:
        up, char, score, tokens = self.up, self.char, self.score, self.tokens
        best, count = score[parent] + self.unknown, tokens[parent] + len(c.encode("utf-8", "replace"))
        at, before, letter = self.ends.get(c), parent, c
        while at is not None:
            own = at.get("")
            if own is not None:
                s, n = score[before] + own, tokens[before] + 1
                if s > best or s == best and n < count:
                    best, count = s, n
            letter = char[before]
            if before <= 0:
                break
            at, before = at.get(letter), up[before]
        node = len(char)
        self.child.append({})
        char.append(c)
        up.append(parent)
        score.append(best)
        tokens.append(count)
        self.child[parent][c] = node
        return node

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token, from its terminal node."""
        n = self.words.get(word)
        if n is None:
            text = MARK + word.decode("utf-8", "replace")
            if len(text) > _LONGEST:
                return self._alone(text)
            if len(self.char) > MAX_NODES:
                self.clear()
            node, child = 0, self.child
            for c in text:
                after = child[node].get(c)
                node = self._grow(node, c) if after is None else after
            n = self.words[word] = self.tokens[node]
        return n

    def _alone(self, text: str) -> int:
        """Tokens of a long pre-token, without nodes; of the scores before a position, only those that a piece can reach stay."""
        score, tokens, first = [0.0], [0], 0
        for i, c in enumerate(text):
            best, count = score[-1] + self.unknown, tokens[-1] + len(c.encode("utf-8", "replace"))
            at, before = self.ends.get(c), i
            while at is not None:
                own = at.get("")
                if own is not None:
                    s, n = score[before - first] + own, tokens[before - first] + 1
                    if s > best or s == best and n < count:
                        best, count = s, n
                before -= 1
                if before < 0:
                    break
                at = at.get(text[before])
            score.append(best)
            tokens.append(count)
            if len(score) > 2 * self.longest + 1024:
                gone = len(score) - self.longest - 1
                del score[:gone], tokens[:gone]
                first += gone
        return tokens[-1]


def count_tokens(docs: DataFrame, *, vocabulary: str = "public:piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = kept(("trie", vocabulary), lambda: SharedTrie(unigram_pieces(resolve(vocabulary))))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words, tokens = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    own = (text or b"").split()
                    known, missing = trie.words, False
                    try:
                        n = sum(map(known.__getitem__, own))
                    except KeyError:
                        missing = True
                    if missing:
                        n = sum(map(trie.count, own))
                    words.append(len(own))
                    tokens.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long")
