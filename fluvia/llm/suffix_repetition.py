"""Repetition inside a text by suffix array: maximal repeats from longest-common-prefix intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, safe, slices, texts

#: Base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
#: The method's verdict: repeats of at least so many words count; they may cover so much of a text,
#: and the longest may be so much of it.
MIN_REPEAT = 10
MAX_COVERED = 0.40
MAX_LONGEST = 0.25


def suffix_array(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of several texts at once, of word numbers.

    ``end[i]`` is where the text of position i ends: suffixes and common prefixes stop there, and
    suffixes of one text are together. ``lcp[k]`` is the common prefix of the suffixes at k - 1 and k,
    0 across texts. Prefix doubling: in each round only suffixes that are still tied are sorted, by
    their rank and that of the suffix 2^k words on; the common prefixes then follow from the ranks of
    all rounds, longest step first.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((words, end))
    changed = np.append(True, (words[order][1:] != words[order][:-1]) | (end[order][1:] != end[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(changed)[np.cumsum(changed) - 1]
    levels, step = [rank.astype(np.int32)], 1
    size = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(size[rank] > 1)
    while len(tied):
        ahead = tied + step
        key = np.where(ahead < end[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key += rank[tied] * (n + 1)
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        changed = np.append(True, key[1:] != key[:-1])
        new_group = np.append(True, rank[tied][1:] != rank[tied][:-1])
        at = np.arange(len(tied))
        place = at - np.maximum.accumulate(np.where(new_group, at, 0))
        new = rank[tied] + np.maximum.accumulate(np.where(changed, at, 0)) - at + place
        rank = rank.copy()
        rank[tied] = new
        alone = changed & np.append(changed[1:], True)
        tied = tied[~alone]
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    pairs = np.flatnonzero((levels[0][order[1:]] == levels[0][order[:-1]])) + 1
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    found = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[order[pairs - 1]]) & (b < end[order[pairs]])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        found += same << k
        a += same << k
        b += same << k
    lcp[pairs] = found
    return order, lcp


def longest_repeats(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeat that starts there: the deepest interval of
    common prefixes that its suffix is in."""
    order, lcp = suffix_array(words, end)
    out = np.zeros(len(words), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the union of the spans of repeats of at least ``least`` words."""
    n = len(repeats)
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeats >= least)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + repeats[starts], 1)
    return np.cumsum(edge[:n]) > 0


def maximal_repeats(words: list, least: int = 1) -> list[tuple[int, int]]:
    """(start, length) of the occurrences of maximal repeats of one text: they can't be extended to the
    right by definition, nor to the left without another occurrence."""
    numbers = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, np.int64)
    m = longest_repeats(numbers.astype(np.int64), np.full(len(words), len(words), np.int64))
    return [(i, int(k)) for i, k in enumerate(m) if k >= least and (i == 0 or m[i - 1] != k + 1)]


def _number(bodies: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    seen: dict[bytes, int] = {}
    flat = [w for words in bodies for w in words]
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in flat), np.int64, len(flat))
    return numbers, np.fromiter(map(len, bodies), np.int64, len(bodies))


def measure(bodies: list[str]) -> dict[str, np.ndarray]:
    """The measures of :func:`repetition` for a list of whole texts."""
    out = {k: np.zeros(len(bodies), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest", "n_repeats")}
    words = []
    for i, text in enumerate(bodies):
        b = text.encode()
        own = b.split()
        words.append(own)
        out["n_words"][i] = len(own)
        out["word_chars"][i] = len(text) - (len(b) - sum(map(len, own)))
        out["n_symbols"][i] = sum(b.count(s) for s in SYMBOLS)
        lines = [x for x in b.split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    numbers, size = _number(words)
    stops = np.cumsum(size)
    m = longest_repeats(numbers, np.repeat(stops, size))
    some = np.flatnonzero(size)
    if len(some):
        starts = (stops - size)[some]
        out["longest"][some] = np.maximum.reduceat(m, starts)
        # A window repeats where a repeat of WINDOW words or more starts; every word of it counts.
        out["n_repeat_words"][some] = np.add.reduceat(covered(np.where(m >= WINDOW, WINDOW, 0), WINDOW).astype(np.int64), starts)
        out["n_covered"][some] = np.add.reduceat(covered(m, MIN_REPEAT).astype(np.int64), starts)
        first = np.zeros(len(m), bool)
        first[starts] = True
        maximal = (m >= MIN_REPEAT) & (first | (np.append(0, m[:-1]) != m + 1))
        out["n_repeats"][some] = np.add.reduceat(maximal.astype(np.int64), starts)
    return out


def repetition(documents: DataFrame) -> DataFrame:
    """Rows doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest,
    n_repeats, base_failed, kept for each document.

    Words are runs of characters other than ASCII white space. n_repeats counts the places
    where a longest repeat of MIN_REPEAT words or more begins that isn't the rest of the one a word before, n_covered the words in their spans' union, longest is
    the longest repeat in words. A text is kept unless the base rule fails, n_covered exceeds
    MAX_COVERED of its words or longest exceeds MAX_LONGEST of them (and MIN_REPEAT).

    A null text counts as empty; a text without words fails the base rule. Very long texts are handled
    whole. Repeated rows give repeated results; an empty table gives none. Other columns, whatever
    their names, are ignored.
    """
    documents = safe(documents, "doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest", "n_repeats"]

    def run(batches):
        for part in slices(batches, "text"):
            got = measure(texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[k]) for k in names)], ["doc_id", *names])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select("doc_id", "text").transform(in_arrow, run, f"doc_id {id_type}, " + ", ".join(f"{k} bigint" for k in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = (F.col("n_covered") <= MAX_COVERED * F.col("n_words")) & ((F.col("longest") < MIN_REPEAT) | (F.col("longest") <= MAX_LONGEST * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
