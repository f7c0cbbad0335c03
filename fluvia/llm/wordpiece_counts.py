"""Greedy word-piece counts by a linear longest-match automaton: a vocabulary trie with failure links."""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluvia.llm.common import in_arrow, memo, safe, slices, texts

WORD = re.compile(r"\w+|[^\w\s]")
#: Words whose counts a Python worker remembers, and the longest of them.
MOST_WORDS, LONGEST_KNOWN = 300_000, 64


def vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Pieces that start a word and pieces that go on, from a sentencepiece model file: those with the
    word mark start a word, the others go on; single characters do both. Control, byte and unknown
    pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    start, inner = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        body = piece.lstrip("▁")
        if not body:
            continue
        (start if piece != body else inner).add(body)
        if len(body) == 1:
            start.add(body)
            inner.add(body)
    return start, inner


class PieceCounter:
    """Counts the pieces of greedy longest-match-first word-piece tokenization without building them.

    The trie holds the pieces that start a word under one root and those that go on under another.
    A node's failure link leads to where matching goes on after the longest pieces on the way to the
    node are popped, and ``popped`` is the number of these pieces. Each character is read once.
    """

    def __init__(self, start: set[str], inner: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, start), (1, inner)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][c]
                ends[at] = True
        self.fail: list[int] = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, child in self.next[parent].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][c], n
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """The number of pieces, or -1 if the word can't be cut into pieces (one unknown piece)."""
        at, n = 0, 0
        for c in word:
            while c not in self.next[at]:
                n += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return -1
            at = self.next[at][c]
        while at != 1:
            if at < 1:
                return -1
            n += self.popped[at]
            at = self.fail[at]
        return n

    def counts(self, text: str) -> tuple[int, int, int]:
        """Words, pieces and unknown words of a whole text; an unknown word is one piece."""
        words = WORD.findall(text)
        known, pieces, unknown = self.known, 0, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w)
                if len(known) < MOST_WORDS and len(w) <= LONGEST_KNOWN:
                    known[w] = n
            if n < 0:
                unknown += 1
                n = 1
            pieces += n
        return len(words), pieces, unknown


def counter(path: str) -> PieceCounter:
    """One for each Python worker."""
    held = memo(f"wordpiece {path}")
    if "counter" not in held:
        held["counter"] = PieceCounter(*vocabulary(path))
    return held["counter"]


def token_counts(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """Rows doc_id, n_words, n_tokens, n_unknown for each document.

    Words are runs of letters, digits and underscores, and other visible characters one by one. A null
    or empty text has none. Repeated rows give repeated results; an empty table gives none. Other
    columns, whatever their names, are ignored.
    """
    documents = safe(documents, "doc_id", "text")

    def run(batches):
        counts = counter(vocabulary_path).counts
        for part in slices(batches, "text"):
            got = np.array([counts(t) for t in texts(part.column("text"))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[:, k]) for k in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").transform(in_arrow, run, f"doc_id {id_type}, n_words bigint, n_tokens bigint, n_unknown bigint")
