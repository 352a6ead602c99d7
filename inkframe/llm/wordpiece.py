"""Operator 5: token counts by a linear longest-match automaton.

A trie over the vocabulary with failure links; each link carries the number of pieces that following it
emits, so that one pass over a word gives its number of greedy longest-match pieces without building
them. Words are runs of word characters and single other characters, as in ``WORD``. Each is matched with the
word mark before it; where no piece that begins with the mark fits, the bare mark is a piece and pieces that go on
with a word follow. A character at which no piece goes on is one unknown token, and matching goes on after it.

Null and empty text: zero everywhere. Words have no length limit. Repeated rows and further columns are
left as they are.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bpe import BEFORE_SPACE, pieces

WORD = re.compile(r"\w+|[^\w\s]")
#: Entries of a worker's memo of words, and characters of a word that goes there; it starts anew beyond that.
MEMO, SHORT = 200_000, 64
COUNTS = "struct<n_words: bigint, n_tokens: bigint, n_unknown: bigint>"


class Automaton:
    """heads: pieces that begin a word, an empty one if the bare mark is a piece; tails: pieces that go on with one."""

    def __init__(self, heads: Iterable[str], tails: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 has just ended a piece
        heads = set(heads)
        self.ends = ends = set()
        for root, words in ((0, heads), (1, tails)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                if word:
                    ends.add(node)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        if "" in heads:
            self.fail[0], self.popped[0] = 1, 1
        todo = deque((0, 1))
        while todo:
            node = todo.popleft()
            for c, child in self.next[node].items():
                todo.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, n = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][c], n

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it can't be covered."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for c in word:
            while c not in step[node]:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = step[node][c]
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node == 1 else 0

    def cover(self, word: str) -> tuple[int, int]:
        """Tokens of a word, and how many of them are unknown characters. Piece by piece, for words that count can't cover."""
        at = total = unknown = root = 0
        while at < len(word):
            node, to, end = root, at, -1
            while to < len(word) and word[to] in self.next[node]:
                node = self.next[node][word[to]]
                to += 1
                if node in self.ends:
                    end = to
            if end < 0 and not (root == 0 and self.fail[0] == 1):
                unknown, end = unknown + 1, at + 1
            at, root, total = max(at, end), 1, total + 1
        return total, unknown


_loaded: dict[str, tuple[Automaton, dict[str, tuple[int, int]]]] = {}


def load(model_path: str) -> tuple[Automaton, dict[str, tuple[int, int]]]:
    """The automaton of a sentencepiece vocabulary, and a memo of words, once a process. Pieces that start with the
    word mark begin a word; plain ones go on with one; control, byte and unknown pieces are left out."""
    if model_path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        words = [model.id_to_piece(i) for i in kept]
        _loaded[model_path] = (Automaton([w[1:] for w in words if w[0] == "▁"], [w for w in words if "▁" not in w]), {})
    return _loaded[model_path]


def count_text(automaton: Automaton, memo: dict[str, tuple[int, int]], text: str) -> tuple[int, int, int]:
    n_words = n_tokens = n_unknown = 0
    for piece in pieces(text, BEFORE_SPACE):
        for word, n in Counter(WORD.findall(piece)).items():
            k = memo.get(word)
            if k is None:
                covered = automaton.count(word)
                k = (covered, 0) if covered else automaton.cover(word)
                if len(word) <= SHORT:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = k
            n_words += n
            n_tokens += n * k[0]
            n_unknown += n * k[1]
    return n_words, n_tokens, n_unknown


def counter(model_path: str) -> Callable[[Column], Column]:
    """A column function: text to its numbers of words, tokens and unknown tokens."""

    @F.arrow_udf(COUNTS)
    def count(texts: pa.Array) -> pa.Array:
        automaton, memo = load(model_path)
        rows = [count_text(automaton, memo, t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["n_words", "n_tokens", "n_unknown"])

    return count
