"""Token counts by a linear longest-match automaton.

Greedy word-piece length of each word (longest vocabulary entry first, then
the longest continuation, and so on) without building the pieces: the
vocabulary is a trie with two roots, for starts of words and for
continuations.  Where the trie has no way on, a failure link leads to the node
that is reached after popping tokens, and the number of tokens popped is kept
with the link, so each character is looked at once.

Words are cut at Unicode white space and around each punctuation character,
as the usual word-piece pre-tokenizer does.  A word that the vocabulary can't
spell counts as one unknown token.

Defined results: null and empty texts have no words; there is no longest
word; rows that repeat are counted one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Memo
from quarry.llm.common import id_type, map_batches

#: Separators that str.split() takes for white space and Unicode doesn't.
_CONTROLS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[^\t-\r \x85\xa0  -     　]+")


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word starts and continuations of a sentence-piece model: pieces with its word mark, and without."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p[0] == "▁" and p[1:]], [p for p in plain if p[0] != "▁"]


def is_punctuation(c: str) -> bool:
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c)[0] == "P"


def words(chunk: str) -> list[str]:
    out, start = [], 0
    for k, c in enumerate(chunk):
        if is_punctuation(c):
            out += [chunk[start:k]] * (k > start) + [c]
            start = k + 1
    return out + [chunk[start:]] * (start < len(chunk))


class LongestMatch:
    START, INNER = 0, 1

    def __init__(self, starts: list[str], inner: list[str]):
        self.next: dict[tuple[int, str], int] = {}
        children: list[list[tuple[str, int]]] = [[], []]
        token = [False, False]
        for root, entries in ((self.START, starts), (self.INNER, inner)):
            for entry in entries:
                node = root
                for c in entry:
                    if (node, c) not in self.next:
                        self.next[node, c] = len(children)
                        children[node].append((c, len(children)))
                        children.append([])
                        token.append(False)
                    node = self.next[node, c]
                token[node] = True
        self.fail = [-1] * len(children)
        self.popped = [0] * len(children)
        queue = deque((self.START, self.INNER))
        while queue:
            above = queue.popleft()
            for c, node in children[above]:
                queue.append(node)
                if token[node]:
                    self.fail[node], self.popped[node] = self.INNER, 1
                    continue
                to, count = self.fail[above], self.popped[above]
                while to >= 0 and (to, c) not in self.next:
                    count += self.popped[to]
                    to = self.fail[to]
                if to >= 0:
                    self.fail[node], self.popped[node] = self.next[to, c], count
        self.chunks = Memo(self._chunk)

    def length(self, word: str) -> int:
        """Number of greedy pieces; -1 where there are none."""
        node, count = self.START, 0
        for c in word:
            while (node, c) not in self.next:
                if self.fail[node] < 0:
                    return -1
                count += self.popped[node]
                node = self.fail[node]
            node = self.next[node, c]
        while node != self.INNER:
            if self.fail[node] < 0:
                return -1
            count += self.popped[node]
            node = self.fail[node]
        return count

    def _chunk(self, chunk: str) -> tuple[int, int, int]:
        found = [self.length(w) for w in words(chunk)]
        return len(found), sum(abs(n) for n in found), sum(n < 0 for n in found)

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown tokens."""
        if not text:
            return 0, 0, 0
        chunks = _SPACES.findall(text) if _CONTROLS.search(text) else text.split()
        found = list(map(self.chunks.__getitem__, chunks))
        return (sum(x[0] for x in found), sum(x[1] for x in found), sum(x[2] for x in found)) if found else (0, 0, 0)


_matchers: dict[int, LongestMatch] = {}


def token_counts(docs: DataFrame, path: str, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every row."""
    starts, inner = vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast((starts, inner))  # as large as the vocabulary's file

    def make():
        key = hash((tuple(sent.value[0]), tuple(sent.value[1])))
        own = _matchers.get(key) or _matchers.setdefault(key, LongestMatch(*sent.value))

        def one(batch: pa.RecordBatch) -> dict:
            found = [own.count(t.as_py()) for t in batch.column(1)]
            return {"doc_id": batch.column(0), **{n: [x[k] for x in found] for k, n in enumerate(("n_words", "n_tokens", "n_unknown"))}}

        return one

    return map_batches(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), f"doc_id {id_type(docs, id)}, n_words bigint, n_tokens bigint, n_unknown bigint", make)
