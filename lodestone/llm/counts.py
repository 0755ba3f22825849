"""Token counts by dynamic programming over a trie of pre-tokens.

A text is cut at white space; each pre-token carries a word mark in front.  The
tokens of a pre-token are the pieces of its best segmentation under a unigram
model.  The best score of a string's prefix does not depend on what follows, so
the pre-tokens of a task share a trie: a prefix is scored once, when its node is
made, from the nodes above it; a pre-token's count is that of its last node.

Pieces come from a public vocabulary file (never trained here); it ranks its
pieces, and the score of a piece is ``-log(rank + SHIFT)``, Zipf's law.  A
character that no piece covers counts one token per UTF-8 byte.

One narrow pass; the trie is dropped when it holds ``NODES`` nodes.  A word of more
than ``LONG`` characters (it will hardly come again) has nodes for its first ones;
the rest is scored by the same rule in a window of the longest piece.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
SHIFT = 2.7
NODES = 1_000_000
BYTE = -30.0  # the score of a byte that no piece covers
LONG = 200  # characters: a longer word gets no nodes of its own beyond these


def vocabulary(path: str) -> dict[str, float]:
    """piece -> score, from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [i for i in range(model.get_piece_size()) if not special(i)]
    # A higher score in the file is an earlier piece; the characters, which
    # the file scores last, keep their place.
    order = sorted(pieces, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 1 + SHIFT) for rank, i in enumerate(order)}


class Trie:
    """Best scores and counts of all prefixes of the strings seen."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.most = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.scored = 0

    def tokens(self, s: str) -> int:
        """The number of tokens of a string."""
        if len(self.score) > self.most:
            self.clear()
        child, score, count, pieces = self.child, self.score, self.count, self.pieces
        at, path = 0, [0]
        for end, c in enumerate(s[:LONG], 1):
            node = child.get((at, c))
            if node is None:
                n = len(c.encode())
                best, tokens = score[at] + BYTE * n, count[at] + n
                for start in range(max(0, end - self.longest), end):
                    p = pieces.get(s[start:end])
                    # Of equal scores the fewer tokens.
                    if p is not None:
                        above = path[start]
                        if score[above] + p > best or (score[above] + p == best and count[above] + 1 < tokens):
                            best, tokens = score[above] + p, count[above] + 1
                node = child[at, c] = len(score)
                score.append(best)
                count.append(tokens)
                self.scored += 1
            at = node
            path.append(at)
        return count[at] if len(s) <= LONG else self._beyond(s, path)

    def _beyond(self, s: str, path: list[int]) -> int:
        """The number of tokens of a long string from the nodes of its head."""
        first = max(0, len(path) - 1 - self.longest)
        best = deque(((self.score[p], self.count[p]) for p in path[first:]), maxlen=self.longest)
        for end in range(len(path), len(s) + 1):
            n = len(s[end - 1].encode())
            top, tokens = best[-1][0] + BYTE * n, best[-1][1] + n
            for back, (x, k) in enumerate(reversed(best), 1):
                p = self.pieces.get(s[end - back : end])
                if p is not None and (x + p > top or (x + p == top and k + 1 < tokens)):
                    top, tokens = x + p, k + 1
            best.append((top, tokens))
        return best[-1][1]


_tries: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """One per worker process, so that it serves later tasks too."""
    if path not in _tries:
        _tries[path] = Trie(vocabulary(path))
    return _tries[path]


def counted(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_chars (code points) and n_tokens.

    Null and empty texts count 0; repeated rows are counted alike; a text of one
    huge word takes time that grows with its length and bounded memory; an empty
    table gives an empty one; columns of these names are replaced.
    """
    schema = T.StructType.fromDDL("n_words long, n_chars long, n_tokens long")

    def make():
        own = trie(vocabulary_path)
        known: dict[str, int] = {}

        def run(values: list) -> dict:
            out: dict[str, list] = {"n_words": [], "n_chars": [], "n_tokens": []}
            for v in values:
                words = (v or "").split()
                if len(known) > NODES // 2:
                    known.clear()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = own.tokens(MARK + w)
                        if len(w) <= LONG:
                            known[w] = n
                    total += n
                out["n_words"].append(len(words))
                out["n_chars"].append(len(v or ""))
                out["n_tokens"].append(total)
            return out

        return run

    return common.append(docs, schema, F.col(text_col).cast("string"), make)


def query(spark, sf_dir: str) -> DataFrame:
    from .binary import public

    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, public("piece_bpe_32k.model")).drop("text")
