"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fluvia.llm.common import gathered, id_bytes, id_lists, in_arrow, memo, safe, slices, texts

MARK = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a Python worker remembers, and the longest of them.
MOST_CHUNKS = 120_000
LONGEST_KNOWN = 64


class Codec:
    """Pieces and scores of a sentencepiece model, read as a unigram model.

    The encoding is the segmentation with the highest sum of scores; of equal sums, the one whose last
    piece is longest, and so on from the end. Characters in no piece become their bytes' pieces, or
    the unknown piece if the model has none, once for unknown characters beside each other. Texts first go
    through the model's own normalizer (character map, extra blanks, mark in front), unless it only
    turns blanks into marks and puts one in front. For a model of the unigram kind the ids are then the library's; for one of
    the merge kind they are ids of its pieces, but not the ones its merges lead to.
    """

    #: The model's normalizer (None: blanks become marks, one is put in front), and whether a mark is put in front.
    normalize: Callable[[str], str] | None = None
    prefix = True

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_: dict[int, int], unknown: int, size: int):
        """pieces: (piece, score, id); bytes_: id of each byte's piece; size: number of ids."""
        self.bytes, self.unknown, self.size = bytes_, unknown, size
        nexts: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, float, int]] = {}
        for piece, score, i in pieces:
            at = 0
            for c in piece:
                if c not in nexts[at]:
                    nexts[at][c] = len(nexts)
                    nexts.append({})
                at = nexts[at][c]
            ends[at] = (len(piece), score, i)
        n = len(nexts)
        fail, link = [0] * n, [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, child in nexts[parent].items():
                queue.append(child)
                if parent:
                    at = fail[parent]
                    while at and c not in nexts[at]:
                        at = fail[at]
                    fail[child] = nexts[at].get(c, 0)
                link[child] = fail[child] if fail[child] in ends else link[fail[child]]
        letters = {c: k for k, c in enumerate(sorted({c for p, _, _ in pieces for c in p}), 1)}
        #: Number of a code point, 0 for those in no piece; edges as sorted numbers node * letters + letter.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        edges = sorted((node * self.letters + letters[c], child) for node, of in enumerate(nexts) for c, child in of.items())
        self.edge, self.child = (np.array([e[k] for e in edges] + [x], np.int64) for k, x in ((0, np.iinfo(np.int64).max), (1, 0)))
        #: For each node: where matching goes on; the next node on that way at which a piece ends (0: none);
        #: length (0: none), score and id of the piece that ends at the node itself.
        self.fail, self.link = np.array(fail), np.array(link)
        self.length, self.id = (np.array([ends.get(k, (0, 0.0, 0))[x] for k in range(n)]) for x in (0, 2))
        self.score = np.array([ends.get(k, (0, 0.0, 0))[1] for k in range(n)])
        self.unknown_score = min((s for _, s, _ in pieces), default=0.0) - UNKNOWN_PENALTY
        # No piece has the mark after another character, so none crosses from a word into the next
        # one's mark, and none has a line break: the best segmentation is that of the chunks.
        self.whole = any(MARK in p.lstrip(MARK) for p, _, _ in pieces) or "\n" in letters
        self.chunks = re.compile(".+" if self.whole else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", re.DOTALL).findall
        text = [b""] * size
        for p, _, i in pieces:
            text[i] = p.replace(MARK, " ").encode()
        for b, i in bytes_.items():
            text[i] = bytes([b])
        if unknown >= 0:
            text[unknown] = " ⁇ ".encode()
        self.text_size = np.fromiter(map(len, text), np.int64, size)
        self.text_start, self.text = np.cumsum(self.text_size) - self.text_size, np.frombuffer(b"".join(text), np.uint8)
        #: What is remembered of chunks: their number, and for each number where its ids are in the pool.
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @classmethod
    def from_file(cls, path: str) -> Codec:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_ = [], {}
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                bytes_[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                pieces.append((m.id_to_piece(i), m.get_score(i), i))
        out = cls(pieces, bytes_, m.unk_id(), m.get_piece_size())
        spec = sentencepiece_model_pb2.ModelProto.FromString(m.serialized_model_proto()).normalizer_spec
        out.prefix = spec.add_dummy_prefix
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            out.normalize = m.normalize
        return out

    def marked(self, text: str) -> str:
        """A text as its pieces spell it."""
        if self.normalize:
            return self.normalize(text)
        return MARK + text.replace(" ", MARK) if text else ""

    def plain(self, text: str) -> str:
        """What decoding the ids of ``text`` gives back if no character is unknown."""
        return self._unmarked(self.marked(text).replace(MARK, " "))

    def _unmarked(self, text: str) -> str:
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _goto(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that the automaton goes to from ``node`` on reading ``letter``."""
        out = np.zeros(len(node), np.int64)
        rest, node = np.arange(len(node)), node.copy()
        while len(rest):
            key = node * self.letters + letter[rest]
            at = np.searchsorted(self.edge, key)
            found = self.edge[at] == key
            out[rest[found]] = self.child[at[found]]
            more = ~found & (node > 0)
            rest, node = rest[more], self.fail[node[more]]
        return out

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and their number for each chunk.

        One pass over the characters, with all chunks side by side: the automaton moves by one character
        in each, then the pieces that end there, its own and those its output links lead to, relax the
        best score of the position.
        """
        if not chunks:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        chars = np.frombuffer("".join([chunks[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(size) - size
        base = first + np.arange(len(size))  # positions 0 to size of each chunk
        total = len(chars) + len(size)
        best, back, piece = np.zeros(total), np.zeros(total, np.int64), np.zeros(total, np.int64)
        letter = self.letter[chars]
        node = np.zeros(len(size), np.int64)
        still = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for j in range(int(size[0])):
            n = int(still[j])  # chunks that go on to here, the longest first
            node = self._goto(node[:n], letter[first[:n] + j])
            at = base[:n] + j + 1
            score, pick, length = np.full(n, -np.inf), np.full(n, -1), np.ones(n, np.int64)
            alone = np.zeros(n, bool)
            out = np.where(self.length[node] > 0, node, self.link[node])
            rest = np.flatnonzero(out)
            out = out[rest]
            while len(rest):
                long = self.length[out]
                sums = best[at[rest] - long] + self.score[out]
                better = sums > score[rest]
                to = rest[better]
                score[to], pick[to], length[to] = sums[better], self.id[out[better]], long[better]
                alone[rest[long == 1]] = True
                out = self.link[out]
                rest, out = rest[out > 0], out[out > 0]
            sums = best[at - 1] + self.unknown_score
            other = ~alone & (sums > score)
            score[other], pick[other], length[other] = sums[other], -1, 1
            best[at], back[at], piece[at] = score, length, pick
        # Back from the ends: the pieces' positions, of all chunks in one array each round.
        rounds, rest, at = [], np.arange(len(size)), size.copy()
        while len(rest):
            here = base[rest] + at
            code = piece[here]
            odd = code < 0
            code[odd] = self.size + chars[first[rest[odd]] + at[odd] - 1]
            rounds.append((rest, code))
            at = at - back[here]
            rest, at = rest[at > 0], at[at > 0]
        which = np.concatenate([r for r, _ in rounds])[::-1]
        code = np.concatenate([c for _, c in rounds])[::-1]
        by = np.argsort(order[which], kind="stable")
        which, code = order[which][by], code[by]
        other, number = np.unique(code[code >= self.size], return_inverse=True)
        own = [([self.bytes.get(b, self.unknown) for b in chr(c - self.size).encode("utf-8", "replace")] if self.bytes else [self.unknown]) for c in other.tolist()]
        pool = np.append(np.arange(self.size, dtype="<u4"), np.array([i for x in own for i in x], "<u4"))
        length = np.append(np.ones(self.size, np.int64), np.array([len(x) for x in own], np.int64))
        code[code >= self.size] = self.size + number
        return gathered(pool, np.cumsum(length) - length, length, code), np.bincount(which, length[code], len(chunks)).astype(np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Segments chunks that aren't known; those beyond what is remembered are forgotten after use."""
        ids, n = zip(*(self.segment(part) for part in ([c for c in chunks if len(c) <= LONGEST_KNOWN], [c for c in chunks if len(c) > LONGEST_KNOWN])), strict=True)
        chunks = sorted(chunks, key=lambda c: len(c) > LONGEST_KNOWN)
        start = len(self.known)
        self.known.update(zip(chunks, range(start, start + len(chunks)), strict=True))
        self.pool = np.concatenate([self.pool, *ids])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(n)))
        keep = min(max(0, MOST_CHUNKS - start), len(n[0]))
        self.forget = chunks[keep:]

    def _forget(self) -> None:
        for c in self.forget:
            del self.known[c]
        self.ends = self.ends[: len(self.known) + 1]
        self.pool = self.pool[: self.ends[-1]].copy()

    def encode(self, bodies) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a column or a list), one after the other, and their number for each; null counts
        as empty. A mark is put in front of a text, blanks become marks.

        Texts are cut at blanks and before line breaks on whole columns, and each distinct word, with its
        mark, is segmented once. A text with marks of its own, or with blanks beside each other, is cut into
        chunks by itself.
        """
        bodies = pc.fill_null(bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.string()), "")
        lists = pc.split_pattern(pc.replace_substring(bodies, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(bodies) else np.zeros(1, np.int64)
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = words.dictionary.to_pylist()
        units = [w if w[:1] == "\n" else MARK + w for w in distinct]
        # An empty word is a mark of its own at a text's end or before a line break only.
        marked = np.array([MARK in w for w in distinct], bool)
        empty = np.array([w == "" for w in distinct], bool)
        broken = np.array([w[:1] == "\n" for w in distinct], bool)
        odd_word = marked[code]
        last = np.zeros(len(code), bool)
        last[offsets[1:] - 1] = True
        odd_word |= empty[code] & ~last & ~np.append(broken[code][1:], False)
        odd = np.logical_or.reduceat(odd_word, offsets[:-1]) if len(bodies) else np.zeros(0, bool)
        odd |= self.whole | (self.normalize is not None) | (pc.binary_length(bodies).to_numpy(zero_copy_only=False) == 0)
        parts = {i: self.chunks(self.marked(t)) for i, t in zip(np.flatnonzero(odd).tolist(), bodies.filter(pa.array(odd)).to_pylist(), strict=True)}
        if odd.all():
            units, code = [], code[:0]
        known = self.known
        self._learn([u for u in {*units, *(c for p in parts.values() for c in p)} if u not in known])
        code = np.fromiter(map(known.__getitem__, units), np.int64, len(units))[code]
        if parts:
            own = {i: np.fromiter(map(known.__getitem__, p), np.int64, len(p)) for i, p in parts.items()}
            split = [own[i] if i in own else code[a:b] for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
            code, offsets = np.concatenate(split), np.append(0, np.cumsum([len(x) for x in split]))
        size = np.diff(self.ends)
        ids = gathered(self.pool, self.ends[:-1], size, code)
        total = np.append(0, np.cumsum(size[code]))[offsets]
        self._forget()
        if self.unknown >= 0 and not self.bytes and len(ids):
            again = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown))
            again[total[:-1][total[:-1] < len(ids)]] = False
            total -= np.append(0, np.cumsum(again))[total]
            ids = ids[~again]
        return ids, np.diff(total)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of ids, ``n`` for each text, without the blank that encoding put in front; bytes that are no
        UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        flat = gathered(self.text, self.text_start, self.text_size, ids).tobytes()
        ends = np.append(0, np.cumsum(self.text_size[ids]))[np.append(0, np.cumsum(n))].tolist()
        out = [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
        return list(map(self._unmarked, out))


def codec(path: str) -> Codec:
    """One for each Python worker."""
    held = memo(f"sentencepiece {path}")
    if "codec" not in held:
        held["codec"] = Codec.from_file(path)
    return held["codec"]


def encode(rows: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``ids`` of piece ids of the whole text; a column of that name is replaced.

    A null or empty text has no ids. The library's rule holds for the mark: a U+2581 in a text is read
    as a blank. Repeated rows give repeated results; an empty table gives none.
    """

    rows_ = safe(rows, text)

    def run(batches):
        c = codec(model_path)
        for part in slices(batches, text):
            flat, n = c.encode(part.column(text))
            yield pa.RecordBatch.from_arrays([*part.columns, id_lists(flat, n)], names)

    kept = [k for k, c in enumerate(rows.columns) if c != ids]
    inner = rows_.select(*(rows_.columns[k] for k in kept))
    names = [*inner.columns, "own"]
    return inner.transform(in_arrow, run, _fields(inner, "own array<int>")).toDF(*(rows.columns[k] for k in kept), ids)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column ``text`` decoded from ``ids``; null or no ids give an empty text. A column of that name is replaced."""

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                values = [np.frombuffer(v, "<u4") for v in id_bytes(part.column(ids))]
                flat = np.concatenate(values) if values else np.zeros(0, "<u4")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.decode(flat, np.array([len(v) for v in values], np.int64)), pa.string())], names)

    kept = [k for k, c in enumerate(rows.columns) if c != text]
    inner = safe(rows, ids)
    inner = inner.select(*(inner.columns[k] for k in kept))
    names = [*inner.columns, "own"]
    return inner.transform(in_arrow, run, _fields(inner, "own string")).toDF(*(rows.columns[k] for k in kept), text)


def _fields(rows: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *more])


#: What :func:`coded` can give, with its type.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_crc32": "bigint", "decoded": "string", "round_trip": "boolean"}


def coded(rows: DataFrame, model_path: str, outputs: tuple = tuple(OUTPUTS), text: str = "text") -> DataFrame:
    """``rows`` without their text, with the ``outputs`` of encoding it and decoding the ids again, all in
    one pass through Python: ids, their number, the CRC-32 of them as little-endian 32-bit integers, the
    decoded text, and whether that is the text (marks read as blanks) as the model's normalizer leaves it.

    Columns of the outputs' names are replaced; nulls are as in :func:`encode`.
    """
    kept = [k for k, c in enumerate(rows.columns) if c != text and c not in outputs]
    inner = safe(rows, text)
    columns = [inner.columns[k] for k in kept]
    own = [f"own{k}" for k in range(len(outputs))]

    def run(batches):
        c = codec(model_path)
        for part in slices(batches, text):
            bodies = texts(part.column(text))
            flat, n = c.encode(part.column(text))
            decoded = c.decode(flat, n) if {"decoded", "round_trip"} & {*outputs} else []
            made = {
                "ids": lambda flat=flat, n=n: id_lists(flat, n),
                "n_tokens": lambda n=n: pa.array(n, pa.int64()),
                "ids_crc32": lambda flat=flat, n=n: pa.array([zlib.crc32(x) for x in np.split(flat, np.cumsum(n)[:-1])] if len(n) else [], pa.int64()),
                "decoded": lambda decoded=decoded: pa.array(decoded, pa.string()),
                "round_trip": lambda decoded=decoded, bodies=bodies: pa.array([d == (t.replace(MARK, " ") if c.normalize is None else c.plain(t)) for d, t in zip(decoded, bodies, strict=True)], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in columns), *(made[k]() for k in outputs)], [*columns, *own])

    inner = inner.select(*columns, text)
    fields = _fields(inner.select(*columns), *(f"{o} {OUTPUTS[k]}" for o, k in zip(own, outputs, strict=True)))
    return inner.transform(in_arrow, run, fields).toDF(*(rows.columns[k] for k in kept), *outputs)
