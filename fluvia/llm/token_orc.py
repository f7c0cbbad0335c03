"""Token-ID output as ORC: sorted by document id, with row indexes, Bloom filters and prefix offsets."""

from __future__ import annotations

import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import SLICE_BYTES, gathered, id_bytes, id_lists, in_arrow, memo, new_path, safe, slices

END_ID = 2
#: Distinct words whose ids a Python worker remembers; others are encoded again.
MOST_WORDS = 600_000
#: Longer words aren't remembered, in bytes of UTF-8.
LONGEST_KNOWN = 48
#: Endings (marks after a word) whose ids a Python worker remembers.
MOST_TAILS = 6000
#: New words that go to the library as one text.
TOGETHER = 256
ORC_OPTIONS = {"compression": "lz4", "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}

_OTHER_SPACE = re.compile(r"[^\S \n]").search


class WordEncoder:
    """Byte-level BPE of the tokenizers library, with the ids of words remembered.

    The pre-tokenizer always cuts between a character that isn't white space and one that is. A text
    in which white space is single blanks and line breaks between words is therefore cut into words,
    each with the blank before it, and the ids of the words joined are the ids of the text. It also
    cuts between a letter or digit and the marks that end a word, so a new word is looked up without
    them first. Other texts, and texts with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        #: Words with their ids: of " the" for "the", of "\nthe" for "\nthe". Those of word k are
        #: pool[ends[k] : ends[k + 1]]; whole[k]: a text with that word has to be encoded whole.
        self.words = pa.array([], pa.string())
        self.pool, self.ends, self.whole = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)
        self.tails: dict[str, np.ndarray] = {}
        self.begins = {" ": self._begins(" "), "\n": self._begins("\n")}

    def _begins(self, blank: str) -> np.ndarray:
        """Which ids begin with a blank or line break."""
        first = self.tokenizer.id_to_token(self.tokenizer.encode(blank, add_special_tokens=False).ids[0])[0]
        out = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        out[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(first)]] = True
        return out

    def _library(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)] if parts else []

    def _words(self, words: list[str], blank: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with ``blank`` before it, one after the other, and their number for each.

        Hundreds of words go to the library as one text; a word starts at the id that has its blank.
        """
        flat, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self._library([blank + blank.join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.begins[blank][ids])
            if len(starts) == len(group) and not starts[0]:
                size.append(np.diff(np.append(starts, len(ids))))
                flat.append(ids)
            else:
                own = self._library([blank + w for w in group])
                size.append(np.fromiter(map(len, own), np.int64, len(own)))
                flat += own
        return np.concatenate(flat), np.concatenate(size)

    def _plain(self, body: str) -> bool:
        return body.split() == [body] and not any(s in body for s in self.special)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words, one after the other, their number for each, and which need their text encoded whole."""
        if not len(new):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, bool)
        whole = pc.is_in(new, value_set=pa.array(["", "\n"])).to_numpy(zero_copy_only=False)
        blob = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new), "").to_pylist()[0]
        if _OTHER_SPACE(blob) or any(s in blob for s in self.special):
            whole |= np.array([not self._plain(w[1:] if w[:1] == "\n" else w) for w in new.to_pylist()], bool)
        # The pre-tokenizer cuts between a letter or digit and the marks after it: words without them are looked up.
        cores = pc.utf8_rtrim(new, characters=string.punctuation)
        cores = pc.if_else(pc.match_substring_regex(cores, "[\\p{L}\\p{N}]$"), cores, new)
        distinct = pc.if_else(pa.array(whole), None, cores).dictionary_encode()
        code = distinct.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = distinct.dictionary.to_pylist()
        broken = np.array([c[0] == "\n" for c in parts], bool)
        flat, size = zip(self._words([c for c in parts if c[0] != "\n"], " "), self._words([c[1:] for c in parts if c[0] == "\n"], "\n"), strict=True)
        place = np.empty(len(parts), np.int64)
        place[np.argsort(broken, kind="stable")] = np.arange(len(parts))
        # Then the marks, of words that have some.
        marked = np.flatnonzero(~whole & (pc.binary_length(cores).to_numpy() != pc.binary_length(new).to_numpy()))
        starts = pc.utf8_length(cores.take(pa.array(marked))).to_pylist()
        tails = [w[k:] for w, k in zip(new.take(pa.array(marked)).to_pylist(), starts, strict=True)]
        unknown = [t for t in {*tails} if t not in self.tails]
        known = self.tails | dict(zip(unknown, self._library(unknown), strict=True))
        if len(known) <= MOST_TAILS:
            self.tails = {t: v for t, v in known.items() if len(t) <= LONGEST_KNOWN}
        used = {t: len(parts) + 1 + k for k, t in enumerate({*tails})}
        pool = np.concatenate([*flat, *(known[t] for t in used)])
        size = np.concatenate([*size, [0], np.array([len(known[t]) for t in used], np.int64)])  # after the words, one without ids
        pairs = np.full((len(new), 2), len(parts), np.int64)
        pairs[~whole, 0] = place[code[~whole]]
        pairs[marked, 1] = [used[t] for t in tails]
        return gathered(pool, np.cumsum(size) - size, size, pairs.ravel()), size[pairs].sum(axis=1), whole

    def _remember(self, new: pa.Array, ids: np.ndarray, n: np.ndarray, whole: np.ndarray) -> None:
        """Keeps new words, the shorter ones, while there is room."""
        keep = np.flatnonzero(pc.binary_length(new).to_numpy() <= LONGEST_KNOWN)[: max(0, self.most - len(self.words))]
        if len(keep):
            self.words = pa.concat_arrays([self.words, new.take(pa.array(keep))])
            self.pool = np.concatenate([self.pool, gathered(ids, np.cumsum(n) - n, n, keep)])
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(n[keep]))
            self.whole = np.append(self.whole, whole[keep])

    def encode(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number for each; null counts as empty.

        Each distinct word of the texts is looked up once; everything is done on whole columns.
        """
        bodies = pc.fill_null(bodies, "").cast(pa.string())
        if not len(bodies):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.replace_substring(bodies, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(words.dictionary, value_set=self.words)
        number = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(number < 0)
        new = words.dictionary.take(pa.array(missing))
        ids, n, whole = self._learn(new)
        number[missing] = len(self.words) + np.arange(len(missing))
        flags = np.append(self.whole, whole)[number][code]
        # A text's first word has no blank before it; an empty one before others is a blank at the text's start.
        heads, which = np.unique(code[offsets[:-1]], return_inverse=True)
        first = words.dictionary.take(pa.array(heads)).to_pylist()
        plain = [w for w in first if self._plain(w)]
        own = self._library(plain)
        size = np.concatenate([np.diff(self.ends), n, np.array([len(x) for x in own], np.int64), [0]])
        none = len(size) - 1
        at = dict(zip(plain, range(none - len(own), none), strict=True))
        number = number[code]
        number[offsets[:-1]] = np.array([at.get(w, none) for w in first], np.int64)[which]
        flags[offsets[:-1]] = (np.array([w not in at and w != "" for w in first], bool)[which]) | (np.array([w == "" for w in first], bool)[which] & (np.diff(offsets) > 1))
        out = gathered(np.concatenate([self.pool, ids, *own]), np.cumsum(size) - size, size, number)
        total = np.diff(np.append(0, np.cumsum(size[number]))[offsets])
        self._remember(new, ids, n, whole)
        odd = np.flatnonzero(np.logical_or.reduceat(flags, offsets[:-1]))
        if len(odd):
            parts = np.split(out, np.cumsum(total)[:-1])
            for i, v in zip(odd.tolist(), self._library(bodies.take(pa.array(odd)).to_pylist()), strict=True):
                parts[i] = v
            out, total = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return out, total


def encoder(path: str, most: int = MOST_WORDS) -> WordEncoder:
    """One for each Python worker."""
    held = memo(f"byte pairs {path} {most}")
    if "encoder" not in held:
        held["encoder"] = WordEncoder(path, most)
    return held["encoder"]


def write_token_orc(documents: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = END_ID) -> str:
    """Writes doc_id, n_tokens, part, start_in_part and ids as ORC files, in ascending doc_id order over
    all files, and returns their folder.

    Rows are range-partitioned by doc_id and each range becomes a file: files and their stripes can be
    read in parallel, row indexes and Bloom filters on doc_id let a reader skip stripes. Integers are
    run-length encoded by the format.

    A null or empty text has the end id only. A null doc_id comes first. Rows repeated with one id
    stay rows of their own, in the order of their texts. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    out = out or new_path(documents.sparkSession, "token-orc")

    def run(batches):
        encode = encoder(tokenizer_path).encode
        start, part_id = 0, TaskContext.get().partitionId()
        for part in slices(batches, "text", 2 * SLICE_BYTES):
            ids, n = encode(part.column("text"))
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(np.full(len(n), part_id, np.int32)), pa.array(starts), id_lists(ids, n)], ["doc_id", "n_tokens", "part", "start_in_part", "ids"])

    documents = safe(documents, "doc_id", "text")
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    ordered.transform(in_arrow, run, f"doc_id {id_type}, n_tokens bigint, part int, start_in_part bigint, ids array<int>").write.options(**ORC_OPTIONS).orc(out)
    return out


def read_token_orc(spark, path: str) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids of a folder of :func:`write_token_orc`.

    start is the number of ids of all documents before: what comes before in the same file, plus the
    totals of the files before, of which there is one number for each file. Nulls, empty texts and
    repeated rows come back as they were written; a folder without rows gives none.
    """
    schema = spark.read.orc(path).schema
    rows = spark.read.schema(schema).orc(path)
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, "o_part int, before bigint")
    return rows.join(F.broadcast(offsets), F.col("part") == F.col("o_part")).select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ids_crc32: the CRC-32 of the ids as little-endian 32-bit integers; of no ids, or
    null, it is 0. Repeated rows give repeated results; an empty table gives none."""

    def run(batches):
        for b in batches:
            crc = pa.array([zlib.crc32(v) for v in id_bytes(b.column(ids))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), crc], [*keep, "ids_crc32"])

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, ids).transform(in_arrow, run, f"{fields}, ids_crc32 bigint")
