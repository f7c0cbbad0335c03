"""Periodic runs of words: Lyndon arrays with reused extensions (after Ellert and Fischer, 2021)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, memo, raw, restored, safe, slices

#: A run has so many words and so many periods at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3


def lyndon_edges(x: list[int]) -> list[tuple[int, int, int]]:
    """Edges (i, j, common) of the Lyndon array of ``x`` (numbers from 0 on) with ``common`` >= j - i.

    j is the next smaller suffix of i, or i the previous smaller one of j; ``common`` is the length of the
    longest common prefix of the two suffixes. Suffixes are compared in the order of the numbers, and
    the end of the text is smaller than any number.

    Positions are taken from left to right; those whose next smaller suffix isn't known yet are a chain
    of previous smaller suffixes. Along the chain a comparison either follows from the two before it,
    or goes on where they ended. The match that reaches farthest is kept as a window: a position inside
    it has been seen ``gap`` words before, so its extension is that of the copy unless that one
    leaves the window, and then words are compared from the window's end only. No word is thus
    matched twice as the later end of a pair, which makes the whole linear in the length of ``x``.
    """
    n = len(x)
    word = [*x, -1]
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and what it shares with this one
    after, ahead = [n] * n, [0] * n  # the next smaller suffix, and what this one shares with it
    edges = []
    reach = gap = same_end = 0
    for j in range(1, n):
        a, i = word[j], j - 1
        b = word[i]
        if b < a:
            before[j] = i
            continue
        if b > a:
            m = 0
        else:
            if same_end <= j:
                same_end = j + 1
                while word[same_end] == a:
                    same_end += 1
            m = same_end - j
            edges.append((i, j, m))
            if same_end >= reach:
                reach, gap = same_end, 1
            if word[same_end] > a:
                before[j], shared[j] = i, m
                continue
            ahead[i] = m
        after[i] = j
        while True:
            t, i = shared[i], before[i]
            if i < 0:
                break
            if t < m:
                before[j], shared[j] = i, t
                if t >= j - i:
                    edges.append((i, j, t))
                break
            if t == m:
                known = m
                if reach > j + m:
                    u, v = i - gap, j - gap
                    known = min(ahead[u] if after[u] == v else shared[v], reach - j)
                if j + known >= reach:
                    k = j + known
                    i_k = i + known
                    while word[i_k] == word[k]:
                        i_k += 1
                        k += 1
                    known = k - j
                    if known:
                        reach, gap = k, j - i
                if word[i + known] < word[j + known]:
                    before[j], shared[j] = i, known
                    if known >= j - i:
                        edges.append((i, j, known))
                    break
                m = known
            after[i], ahead[i] = j, m
            if m >= j - i:
                edges.append((i, j, m))
    return edges


def runs(words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of ``words`` with ``least`` words and ``periods`` (3 or more) periods
    at least, by start and period: stretches with that smallest period which can't be extended.

    The word at which a run of period p starts over in the smallest order is a Lyndon word of p words, and
    its first occurrence in the run is an edge (i, i + p) that shares a period or more: of the next
    smaller suffix if the run goes on with something smaller, of the previous smaller one if with
    something greater. So one order of the words gives every run with three periods. Its first edge lies in its first
    period, so that the run is extended to the left by less than a period, once.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods need both orders of the words")
    n = len(words)
    number = {w: k for k, w in enumerate(sorted(set(words)))}
    edges = lyndon_edges([number[w] for w in words])
    x = words
    first: dict[tuple[int, int], int] = {}
    for i, j, common in edges:
        p = j - i
        if 2 * p - 1 + common >= max(least, periods * p):
            key = (p, j + common)
            if first.get(key, n) > i:
                first[key] = i
    out = []
    for (p, end), start in first.items():
        while start and x[start - 1] == x[start - 1 + p]:
            start -= 1
        if end - start >= max(least, periods * p):
            out.append((start, end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def with_runs(documents: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``documents`` with the columns fl_n_words (long), fl_runs (array of start, length, period, by start and
    period) and fl_collapsed (the words that no run holds after its first period, joined by a blank).

    Words are runs of characters other than ASCII white space, numbered from 0. A null or empty text has
    no words and no runs, and collapses to an empty text. Texts are handled whole, one after the other, in memory
    that grows with the longest one. Repeated rows give repeated results, an empty table gives none; columns
    of any name stay as they are (fl_n_words, fl_runs and fl_collapsed are added after them, so a
    caller's column of that name is found by position).
    """
    kept = safe(documents, "text")
    names = kept.columns
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        memo(None)
        for part in slices(batches, "text"):
            sizes, spans, rest = [], [], []
            for text in raw(part.column("text")):
                words = text.split()
                found = runs(words, least, periods) if len(words) >= least else []
                sizes.append(len(words))
                spans.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                rest.append(b" ".join(collapsed(words, found)).decode())
            more = [pa.array(sizes, pa.int64()), pa.array(spans, run_type), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *more], [*names, "fl_n_words", "fl_runs", "fl_collapsed"])

    found = kept.transform(in_arrow, run, f"{_ddl(kept)}, fl_n_words bigint, fl_runs array<struct<start: bigint, length: bigint, period: bigint>>, fl_collapsed string")
    return found.toDF(*documents.columns, "fl_n_words", "fl_runs", "fl_collapsed")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def collapse_runs(documents: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``documents`` with each text that has a run collapsed, as in :func:`with_runs`; texts without runs, and
    all other columns, stay as they are."""
    found = with_runs(safe(documents, "text"), least, periods)
    text = F.when(F.size("fl_runs") > 0, F.col("fl_collapsed")).otherwise(F.col("text"))
    return restored(found.withColumn("text", text), documents, "text")
