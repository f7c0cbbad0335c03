"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon whose densities the trees see is learned: words, and beginnings of words, that training
rows with the label have more often than the others. No list of insults is written down.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, memo, restored, safe, slices, stored, texts

#: At most so many labelled rows are used to fit, taken in the order of a hash of doc_id.
MOST_LABELLED = 20_000
#: Counts of terms that an executor's task holds before it passes them on.
MOST_HELD = 400_000
#: A term needs so many labelled texts, and this least weight (see :func:`weights`).
LEAST_TEXTS, LEAST_WEIGHT = 2, 1.0
#: Lengths of the beginnings of words that are terms, in code points. Longer words than LONGEST_WORD stand in
#: the lexicon as a beginning and a hash of the whole.
BEGINNINGS = range(4, 9)
LONGEST_WORD = 40
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 5
FOLDS = (1, 2, 3, 4)
THRESHOLD = 0.5
#: Tokens that a Python worker remembers.
MOST_TOKENS = 200_000

#: Pronouns of the second person in the four languages.
SECOND = frozenset("you your yours yourself yourselves ur u thou du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre ti tú usted ustedes tus".split())
NEAR = 5
FEATURES = (
    "log_words", "word_weight", "word_hits", "word_count", "word_kinds", "word_most", "start_weight", "start_hits", "start_count", "start_kinds", "start_most",
    "second", "near_second", "hidden", "capital_letters", "capital_words", "shouted_hits", "exclaims", "questions", "runs_of_marks", "symbols", "digits", "mixed_words", "stretched_words", "word_length",
)

_LETTERS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][0-9@$!*_.\-]+[^\W\d_]")
_STRETCH = re.compile(r"(.)\1\1+")
_LEET = str.maketrans("01345@7$!", "oieasatsi", "*_.-")
#: Kinds of bytes: capitals, exclamation marks, question marks, symbols, digits.
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"?", b"#*$%&|<>@", b"0123456789"), 1):
    _KIND[list(_bytes)] = _k
#: Bits of what is known of a token.
_SECOND, _CAPITAL, _IS_MIXED, _STRETCHED, _LETTER = 1, 2, 4, 8, 16


def kept_whole(word: str) -> str:
    """The word as the lexicon has it: itself, or if it is long its beginning and a hash of all of it."""
    return word if len(word) <= LONGEST_WORD else f"{word[:LONGEST_WORD]}#{xxhash.xxh3_64_hexdigest(word)}"


def words_of(token: str) -> tuple[list[str], list[str], int]:
    """The words of a token between blanks, in lower case; the words that it may hide (digits and marks
    for letters, marks between letters, stretched letters); and its flags."""
    low = token.lower()
    whole = low.isalpha()
    plain, flags = [low] if whole else _LETTERS.findall(low), 0
    hidden = []
    if not whole:
        inner = low.strip(".,;:!?\"'()[]{}<>")
        if _MIXED.search(inner):
            flags |= _IS_MIXED
            hidden += _LETTERS.findall(inner.translate(_LEET))
    if len(low) > 4 and _STRETCH.search(low):
        squeezed = [_STRETCH.sub(r"\1", w) for w in plain]
        if squeezed != plain:
            flags |= _STRETCHED
            hidden += squeezed
    if len(plain) == 1:
        if plain[0] in SECOND:
            flags |= _SECOND
        if len(plain[0]) == 1 and len(low) == 1:
            flags |= _LETTER
    if token.isupper() and len(plain) and len(plain[0]) >= 3:
        flags |= _CAPITAL
    return list(map(kept_whole, plain)), list(map(kept_whole, hidden)), flags


def terms(text: str) -> set[str]:
    """The terms of a text that the lexicon counts: its words, and beginnings of words marked with ``*``."""
    words = set(map(str.lower, text.split()))
    if not all(map(str.isalpha, words)):
        words = {w for t in words for some in words_of(t)[:2] for w in some}
    words = set(map(kept_whole, words))
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if n < len(w)}


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Weights of terms found in so many labelled and so many other texts: the smoothed log-odds of the
    label given the term, less the standard error."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


class Lexicon(dict):
    """Weights of words and of beginnings of words; as a dictionary, what is known of a token, as the row of a table."""

    def __init__(self, weight: dict[str, float]):
        super().__init__()
        self.weight = weight
        self.starts = {w[:-1]: x for w, x in weight.items() if w[-1] == "*"}
        #: Numbers of the lexicon's terms from 1 on; weights, terms, flags and the veil of a token, of which there
        #: are as many as terms that meet in words.
        self.number = {w: k for k, w in enumerate(sorted(weight), 1)}
        self.rows: dict[tuple, int] = {(0.0, 0, 0.0, 0, 0, 0): 0}
        self.held = np.zeros((1, 6))

    def __reduce__(self):
        return Lexicon, (self.weight,)

    def _start(self, word: str) -> tuple[float, str]:
        """The largest weight of a beginning of the word, and that beginning as a term."""
        best, get = (0.0, ""), self.starts.get
        for n in BEGINNINGS:
            if n >= len(word):
                break
            if get(word[:n], 0.0) > best[0]:
                best = get(word[:n], 0.0), f"{word[:n]}*"
        return best

    def _table(self) -> np.ndarray:
        """The rows as an array."""
        if len(self.held) < len(self.rows):
            new = list(islice(self.rows, len(self.held), None))
            self.held = np.concatenate([self.held, np.array(new, float)])
        return self.held

    def __missing__(self, token: str) -> int:
        core = token.rstrip(".,;:!?")
        if not core.isupper():
            core = core.lower()
        if core and core != token:
            row = self[core]  # marks at the end and a capital at the start change nothing
        else:
            get = self.weight.get
            plain, hidden, flags = words_of(token)
            own, word = max([(get(w, 0.0), w) for w in plain], default=(0.0, ""))
            start, begun = max(map(self._start, plain), default=(0.0, ""))
            veiled = 0
            if hidden and own <= 0 and (best := max((get(w, 0.0), w) for w in hidden))[0] > 0:
                (own, word), veiled = best, 1
            at = self.number.get
            row = self.rows.setdefault((own, at(word, 0), start, at(begun, 0), flags, veiled), len(self.rows))
        if len(self) < MOST_TOKENS and len(token) <= 2 * LONGEST_WORD:
            self[token] = row
        return row

    def features(self, bodies) -> np.ndarray:
        """The features of whole texts (a column or a list), a row each, in the order of FEATURES; all 0 for
        one that is null or empty. Each distinct token of the texts is looked at once."""
        bodies = pc.fill_null(bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.string()), "").cast(pa.large_string())
        many = len(bodies)
        if not many:
            return np.zeros((0, len(FEATURES)))
        lists = pc.utf8_split_whitespace(bodies)
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        tokens = lists.flatten().dictionary_encode()
        distinct = tokens.dictionary.to_pylist()
        code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(many), np.diff(offsets))
        blank = np.array([t == "" for t in distinct], bool)
        n_tokens = np.bincount(of, ~blank[code], many)
        n = np.maximum(1, n_tokens)
        known = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        row = known[code]
        at = np.flatnonzero(row)
        own, word, start, begun, flags, veiled = self._table()[row[at]].reshape(-1, 6).T
        flags, text = flags.astype(np.int64), of[at]
        total = lambda x: np.bincount(text, x, many)
        out = [np.log1p(n_tokens)]
        for w, term in ((own, word), (start, begun)):
            hit = w > 0
            most = np.zeros(many)
            np.maximum.at(most, text, w)
            count = total(hit)
            out += [total(w) / n, count / n, np.log1p(count), np.bincount(np.unique((text * (len(self.number) + 1) + term.astype(np.int64))[hit]) // (len(self.number) + 1), minlength=many), most]
        second, hits = at[(flags & _SECOND) != 0], at[own > 0]
        beside = np.zeros(len(hits), bool)
        if len(second):
            k = np.searchsorted(second, hits)
            for there in (np.maximum(k - 1, 0), np.minimum(k, len(second) - 1)):
                beside |= (np.abs(hits - second[there]) <= NEAR) & (of[hits] == of[second[there]])
        letters = at[(flags & _LETTER) != 0]
        capital = (flags & _CAPITAL) != 0
        data = np.frombuffer(bodies.buffers()[2], np.uint8) if bodies.buffers()[2] else np.zeros(0, np.uint8)
        ends = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + many + 1]
        kind = np.append(_KIND[data[ends[0] : ends[-1]]], 0)
        ends = ends - ends[0]
        share = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        mark = (kind == 2) | (kind == 3)
        first = np.zeros(len(kind), bool)
        first[ends[:-1]] = True
        goes_on = np.append(mark[:-1] & mark[1:] & ~first[1:], False)
        runs = goes_on & ~np.append(False, goes_on[:-1])
        chars = np.maximum(1, np.diff(ends))
        out += [
            total((flags & _SECOND) != 0) / n,
            np.bincount(of[hits], beside, many) / n,
            (total(veiled) + self._spaced([distinct[c] for c in code[letters].tolist()], letters, of, many)) / n,
            share(kind == 1) / chars,
            total(capital) / n,
            total(capital & (own > 0)) / n,
            share(kind == 2) / n,
            share(kind == 3) / n,
            share(runs) / n,
            share(kind == 4) / n,
            share(kind == 5) / n,
            total((flags & _IS_MIXED) != 0) / n,
            total((flags & _STRETCHED) != 0) / n,
            (pc.utf8_length(bodies).to_numpy(zero_copy_only=False) - n_tokens) / n,
        ]
        out = np.stack(out, axis=1).astype(float)
        out[np.diff(ends) == 0] = 0
        return out

    def _spaced(self, tokens: list[str], at: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
        """For each text the words of the lexicon written as single letters (``tokens``, at ``at``) with blanks between."""
        out = np.zeros(many)
        cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(of[at]) > 0)) + 1 if len(at) else np.zeros(0, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            if b - a > 3 and "".join(tokens[a:b]).lower() in self.weight:
                out[of[at[a]]] += 1
        return out


class Trees:
    """Gradient-boosted trees for a 0/1 label (logistic loss, histograms, second-order leaves), and an
    isotonic map of their scores to probabilities."""

    def __init__(self):
        self.base, self.trees, self.steps = -np.inf, [], None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Both labels weigh alike in total. Without rows, or without the label, the score is 0 everywhere."""
        n, k = x.shape
        if not n or not y.any():
            return self
        weight = np.where(y > 0, n / (2 * y.sum()), n / (2 * max(1, n - y.sum())))
        share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
        # A feature that is 0 nearly everywhere gets bins within its other values.
        edges = [np.unique(np.append(e, np.append(0.0, np.quantile(v, np.linspace(0, 1, 17)[:-1])))) if len(v := x[x[:, j] > 0, j]) else e for j, e in enumerate(edges)]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        width = max(map(len, edges)) + 1
        score = np.full(n, self.base)
        flat = bins + np.arange(k) * width
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            tree = []  # (feature, threshold) of each inner node, level by level; then the leaves
            node = np.zeros(n, np.int64)
            for depth in range(DEPTH):
                size = k * width
                at = (flat + (node * size)[:, None]).ravel()
                hist = [np.bincount(at, np.repeat(v, k), minlength=(1 << depth) * size).reshape(-1, k, width) for v in (g, h, np.ones(n))]
                left = [np.cumsum(v, axis=2)[:, :, :-1] for v in hist]
                total = [v.sum(axis=2, keepdims=True) for v in hist]
                right = [t - v for t, v in zip(total, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1)
                gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = -1
                best = gain.reshape(len(gain), -1).argmax(axis=1)
                feature, cut = best // (width - 1), best % (width - 1)
                none = gain.reshape(len(gain), -1).max(axis=1) < 0
                limit = np.array([np.inf if z or c >= len(edges[f]) else edges[f][c] for f, c, z in zip(feature, cut, none, strict=True)])
                tree.append((feature, limit))
                node = 2 * node + (x[np.arange(n), feature[node]] > limit[node])
            sums = [np.bincount(node, v, minlength=1 << DEPTH) for v in (g, h)]
            leaves = RATE * sums[0] / (sums[1] + 1)
            self.trees.append((tree, leaves))
            score += leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        every = np.arange(len(x))
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, limit in tree:
                node = 2 * node + (x[every, feature[node]] > limit[node])
            score += leaves[node]
        return score

    def calibrate(self, score: np.ndarray, y: np.ndarray) -> None:
        """Isotonic regression of ``y`` on ``score``, by pooling adjacent violators."""
        blocks: list[list[float]] = []
        order = np.argsort(score, kind="stable")
        values, start = np.unique(score[order], return_index=True)
        for v, part in zip(values, np.split(y[order], start[1:]), strict=True):
            blocks.append([float(part.sum()), float(len(part)), float(v), float(v)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
        at = [p for b in blocks for p in ((b[2], b[0] / b[1]), (b[3], b[0] / b[1]))]
        self.steps = (np.array([a for a, _ in at]), np.array([b for _, b in at]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities from 0 to 1. A thousandth is the trees' own, which orders what the isotonic map holds equal."""
        s = self.raw(x)
        own = 1 / (1 + np.exp(-s))
        return own if self.steps is None or not len(self.steps[0]) else np.clip(0.999 * np.interp(s, *self.steps) + 0.001 * own, 0, 1)


class Model:
    """A lexicon and trees over its features."""

    def __init__(self, lexicon: Lexicon, trees: Trees):
        self.lexicon, self.trees = lexicon, trees

    def score(self, bodies) -> np.ndarray:
        return self.trees.score(self.lexicon.features(bodies))


def held_out():
    """Rows whose labels are never learned from: the CRC-32 of doc_id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def lexicons(counts: pa.Table, totals: dict[int, tuple[int, int]]) -> dict[int, Lexicon]:
    """The lexicon of all folds, at 0, and for each fold that of the others.

    ``counts``: term, and t1, c1 and so on: labelled and other texts of each fold that have it;
    ``totals``: labelled and other texts of each fold.
    """
    word = np.array(counts.column("term").to_pylist(), object)
    t, c = (np.stack([counts.column(f"{s}{k}").to_numpy().astype(float) for k in FOLDS]).reshape(len(FOLDS), -1) for s in "tc")
    out = {}
    for fold in (0, *FOLDS):
        use = [i for i, k in enumerate(FOLDS) if k != fold]
        toxic, clean = t[use].sum(axis=0), c[use].sum(axis=0)
        weight = weights(toxic, clean, *(sum(totals.get(FOLDS[i], (0, 0))[s] for i in use) for s in (0, 1)))
        keep = (toxic >= LEAST_TEXTS) & (weight >= LEAST_WEIGHT)
        out[fold] = Lexicon(dict(zip(word[keep].tolist(), weight[keep].tolist(), strict=True)))
    return out


def _counted(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows term, and by fold how many of ``rows`` (text, fold) have the term."""

    def emit(found):
        of = sorted(set().union(*found.values()))
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), *(pa.array([found[k][w] for w in of], pa.int64()) for k in FOLDS)], ["term", *(f"n{k}" for k in FOLDS)])

    def run(batches):
        memo(None)
        found = {k: Counter() for k in FOLDS}
        for part in slices(batches, "text"):
            for t, k in zip(texts(part.column("text")), part.column("fold").to_pylist(), strict=True):
                found[k].update(terms(t))
                if sum(map(len, found.values())) > MOST_HELD:
                    yield emit(found)
                    found = {k: Counter() for k in FOLDS}
        yield emit(found)

    schema = "term string, " + ", ".join(f"n{k} bigint" for k in FOLDS)
    return rows.select("text", "fold").transform(in_arrow, run, schema).groupBy("term").agg(*(F.sum(f"n{k}").alias(f"{prefix}{k}") for k in FOLDS))


def _counts(some: DataFrame, totals: dict[int, tuple[int, int]]) -> pa.Table:
    """Counts of the terms that one of the lexicons takes, as in :func:`lexicons`. Terms are counted, joined and
    weighed by executors; what comes to the driver are those with LEAST_TEXTS and LEAST_WEIGHT, however many they are."""
    toxic = _counted(some.where("toxic = 1"), "t").where(sum((F.col(f"t{k}") for k in FOLDS[1:]), F.col(f"t{FOLDS[0]}")) >= LEAST_TEXTS)
    clean = _counted(some.where("toxic = 0"), "c")
    both = toxic.join(clean, "term", "left").fillna(0, [f"c{k}" for k in FOLDS])
    taken = F.lit(False)
    for fold in (0, *FOLDS):
        use = [k for k in FOLDS if k != fold]
        t, c = (sum((F.col(f"{s}{k}") for k in use[1:]), F.col(f"{s}{use[0]}")) for s in "tc")
        n_t, n_c = (sum(totals.get(k, (0, 0))[s] for k in use) for s in (0, 1))
        odds = F.log((t + 0.5) / (n_t + 1)) - F.log((c + 0.5) / (n_c + 1))
        # The driver weighs what comes once more, so a last digit may not decide here.
        taken = taken | ((t >= LEAST_TEXTS) & (odds - F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= LEAST_WEIGHT - 1e-9))
    return both.where(taken).toArrow().sort_by("term")


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on at most ``most`` labelled rows that aren't held out.

    Terms are counted and weighed by executors; the counts of the lexicon's terms come to the driver, then 25
    numbers a row. The features that the trees learn from come, for each fifth of the rows, from the
    lexicon of the other fifths, and the scores for the calibration from trees that didn't see the
    fifth either. A null label is no label; of rows repeated with one doc_id the largest label counts.
    Without labelled rows, or if none of them has the label, every text scores 0.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    some = stored(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").withColumn("fold", fold), "labelled")
    totals = {k: (0, 0) for k in FOLDS} | {r.fold: (r.t, r.n - r.t) for r in some.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    counts = _counts(some, totals)
    own = lexicons(counts, totals)
    shared = documents.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        memo(None)
        for part in slices(batches, "text"):
            for k in FOLDS:
                own = part.filter(pc.equal(part.column("fold"), k))
                x = shared.value[k].features(own.column("text")).tolist()
                yield pa.RecordBatch.from_arrays([own.column("toxic"), own.column("fold"), own.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "fold", "doc_id", "x"])
        for lexicon in shared.value.values():
            lexicon.clear()

    got = some.transform(in_arrow, run, "toxic int, fold int, doc_id bigint, x array<double>").toArrow().sort_by("doc_id")
    shared.destroy()
    y = (got.column("toxic").to_numpy() > 0).astype(float)
    fold = got.column("fold").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    return Model(own[0], fitted(x, y, fold))


def fitted(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Trees:
    """Trees fitted on all rows, calibrated by scores of trees that didn't see a row's fold."""
    trees = Trees().fit(x, y)
    if y.any():
        unseen = np.zeros(len(y))
        for k in FOLDS:
            unseen[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        known = np.isfinite(unseen)
        if known.any():
            trees.calibrate(unseen[known], y[known])
    return trees


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the score of each whole text; null counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(body: pa.Array) -> pa.Array:
        memo("toxicity")["lexicon"] = shared.value.lexicon  # emptied when another operator begins
        own = [shared.value.score(part.column("text")) for part in slices([pa.RecordBatch.from_arrays([body], ["text"])], "text")]
        return pa.array(np.concatenate(own) if own else np.zeros(0))

    return documents.withColumn(name, score("text"))


def toxicity(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows doc_id, held_out, score, predicted for each document.

    Labels, language, source and id are no inputs of the score. Empty and null texts are scored like
    others. Repeated rows give repeated results; an empty table gives none; without labels every
    text scores 0. Other columns, whatever their names, are ignored.
    """
    documents = safe(documents, "doc_id", "text")
    scored = with_score(documents.select("doc_id", "text"), train(documents, safe(labels, "doc_id", "toxic"), **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``documents`` without those that score at least THRESHOLD; their columns, whatever their names, stay as they are."""
    rows = safe(documents, "doc_id", "text")
    return restored(with_score(rows, train(rows, safe(labels, "doc_id", "toxic"), **options)).where(F.col("score") < THRESHOLD), documents, "doc_id", "text")
