"""Line dedup: range-partitioned hashes, streamed in (document, position) order, give keep bitmaps."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import Bloom, in_arrow, memo, merged, raw, restored, safe, slices, stored

#: Shortest key, in code points, and fewest documents of a repeated line.
MIN_CHARS = 20
MIN_DOCS = 3
BLANK = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id: it counts as one more document, the smallest.
NO_ID = -(1 << 63)


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> tuple[int, list[tuple[int, bytes]]]:
    """The number of lines, and (position, 128-bit hash) of each line whose key is long enough."""
    lines = text.lower().split(b"\n")
    out = []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANK)
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                out.append((i, xxhash.xxh3_128_digest(key)))
    return len(lines), out


def _keyed(documents: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        memo(None)
        for part in slices(batches, "text"):
            rows, at, hashes, found = [], [], [], []
            body = raw(part.column("text"))
            for i, text in enumerate(body):
                n, keys = line_keys(text, min_chars)
                at += [k for k, _ in keys]
                found += [h for _, h in keys]
                rows += [i] * len(keys)
                hashes.append((n, xxhash.xxh64_intdigest(text, 42)))
            rows = np.array(rows, np.int64)
            n_lines, text_hash = (np.array([h[k] for h in hashes], d) for k, d in ((0, np.int64), (1, np.uint64)))
            key = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[:, 0], key[:, 1], ids[rows], text_hash.view(np.int64)[rows], n_lines[rows].astype(np.int32), np.array(at, np.int32))], ["hi", "lo", "doc", "text_hash", "n_lines", "pos"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(in_arrow, run, "hi bigint, lo bigint, doc bigint, text_hash bigint, n_lines int, pos int")


DROP, OPEN, SUMMARY = 0, 1, 2


class _Range:
    """State of the walk through one sorted range; see :func:`_stream`."""

    def __init__(self, min_docs: int):
        self.min_docs, self.hash, self.head, self.out = min_docs, None, True, []

    def begin(self, hash_, top) -> None:
        self.head = self.hash is None
        self.hash, self.top, self.doc, self.docs, self.waiting = hash_, top, None, 0, []

    def feed(self, rows: list[np.ndarray]) -> None:
        """A piece of the group at hand, in order."""
        new = np.append(rows[2][0] != self.doc or not self.docs, rows[2][1:] != rows[2][:-1])
        ordinal = self.docs + np.cumsum(new)
        self.docs, self.doc = int(ordinal[-1]), rows[2][-1]
        if self.head:
            self.out.append((OPEN, rows))
            return
        self.waiting.append([x[ordinal > 1] for x in rows])
        if self.docs >= self.min_docs:
            self.out += [(DROP, w) for w in self.waiting]
            self.waiting = []

    def inner(self, rows: list[np.ndarray]) -> None:
        """Whole groups."""
        new_hash = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        new_doc = new_hash | np.append(True, rows[2][1:] != rows[2][:-1])
        starts = np.flatnonzero(new_hash)
        group = np.cumsum(new_hash) - 1
        count = np.cumsum(new_doc)
        ordinal = count - count[starts][group] + 1
        total = ordinal[np.append(starts[1:], len(group)) - 1]
        drop = (ordinal > 1) & (total[group] >= self.min_docs)
        self.out.append((DROP, [x[drop] for x in rows]))

    def close(self, last: bool = False) -> None:
        """The end of the group at hand, or of what this range has of it."""
        if self.hash is None:
            return
        if last:
            self.out += [(OPEN, w) for w in self.waiting]
        if self.head or last:
            self.out.append((SUMMARY, [np.array([x]) for x in (*self.hash, self.top, self.docs, 0, 0)]))

    def taken(self):
        for kind, c in self.out:
            if len(c[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c[0]), kind, np.int32)), *(pa.array(x.astype(np.int32 if k > 3 else np.int64)) for k, x in enumerate(c))], ["kind", "hi", "lo", "doc", "text_hash", "n_lines", "pos"])
        self.out = []


def _stream(min_docs: int):
    """Goes through one sorted range. For each hash the first document (the largest id) keeps its lines.

    Decides at once where the range holds the whole group. The first group may have begun in the
    range before, and the last may go on in the next: of those it passes on the rows that the rest of
    the group decides, and a summary (documents, largest id), two for each range at most. Holds one
    Arrow batch and, of a group that goes on, the rows of documents before the ``min_docs``-th.
    """

    def run(batches):
        state = _Range(min_docs)
        for batch in merged(batches):
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            hi, lo, doc = rows[:3]
            starts = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            ends = np.append(starts[1:], len(hi))
            if state.hash != (hi[0], lo[0]):
                state.close()
                state.begin((hi[0], lo[0]), doc[0])
            state.feed([x[: ends[0]] for x in rows])
            if len(starts) > 1:
                state.close()
                if len(starts) > 2:
                    state.inner([x[ends[0] : starts[-1]] for x in rows])
                state.begin((hi[-1], lo[-1]), doc[starts[-1]])
                state.feed([x[starts[-1] :] for x in rows])
            yield from state.taken()
        state.close(last=True)
        yield from state.taken()

    return run


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (doc_id, text_hash, n_lines, n_dropped, bitmap) for each document that loses a line.

    A line's key is the line with blanks stripped at both ends and A-Z lower-cased. A key of at least
    ``min_chars`` code points found in at least ``min_docs`` documents loses its lines everywhere but
    in the largest doc_id that holds it. ``bitmap`` is a zlib-compressed bit string over the lines,
    highest bit first, 1: stays. text_hash (xxhash64 of the text) tells rows repeated with one id apart.

    Hashes are range-partitioned with the document as a part of the key, so that a line of very many
    documents spreads over several ranges; what ranges don't know of each other is settled from two
    summaries for each range, which are broadcast (their number is twice that of the partitions).

    A null or empty text is one empty line, which is never long enough. A null doc_id counts as the
    smallest. Rows repeated with one id count as one document. An empty table gives no rows.
    """
    keyed = stored(_keyed(safe(documents, "doc_id", "text"), min_chars), "line-keys")
    ordered = keyed.repartitionByRange("hi", "lo", F.desc("doc")).sortWithinPartitions("hi", "lo", F.desc("doc"), "pos")
    schema = "kind int, hi bigint, lo bigint, doc bigint, text_hash bigint, n_lines int, pos int"
    seen = stored(ordered.transform(in_arrow, _stream(min_docs), schema), "line-decisions")
    shared = seen.where(F.col("kind") == SUMMARY).groupBy("hi", "lo").agg(F.sum("text_hash").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    late = seen.where(F.col("kind") == OPEN).join(F.broadcast(shared), ["hi", "lo"]).where("doc != top")
    columns = ["doc", "text_hash", "n_lines", "pos"]
    dropped = seen.where(F.col("kind") == DROP).select(columns).union(late.select(columns))
    gathered = dropped.groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("positions"))

    def pack(batches):
        for b in batches:
            maps, gone = [], []
            for n, positions in zip(b.column("n_lines").to_pylist(), b.column("positions"), strict=True):
                bits = np.ones(n, np.uint8)
                bits[positions.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
                gone.append(len(positions))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text_hash"), b.column("n_lines"), pa.array(gone, pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "bitmap"])

    packed = gathered.transform(in_arrow, pack, "doc_id bigint, text_hash bigint, n_lines int, n_dropped int, bitmap binary")
    return packed.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def apply_bitmap(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The kept lines joined by line breaks, the number of lines and of those dropped."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    kept = [line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _split(documents: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``documents`` (safe names) that may lose lines, with the column fl_bitmap (null: every line stays), and those that surely don't.

    Only rows that a Bloom filter of the bitmaps' keys lets through are shuffled to be joined.
    """
    bitmaps = stored(keep_bitmaps(documents, **options), "bitmaps").select(F.col("doc_id").alias("fl_doc"), F.col("text_hash").alias("fl_hash"), F.col("bitmap").alias("fl_bitmap"))
    bloom = Bloom(bitmaps, F.xxhash64("fl_doc", "fl_hash"))
    text_hash = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    marked = documents.withColumn("fl_text_hash", text_hash).withColumn("fl_maybe", bloom.may_hold(F.xxhash64(F.col("doc_id").cast("bigint"), F.col("fl_text_hash"))))
    joined = marked.where("fl_maybe").join(bitmaps, F.col("doc_id").cast("bigint").eqNullSafe(F.col("fl_doc")) & (F.col("fl_text_hash") == F.col("fl_hash")), "left")
    return joined.select(*documents.columns, "fl_bitmap"), marked.where("not fl_maybe").select(documents.columns)


def with_bitmaps(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with fl_bitmap as their last column, null where every line stays; see :func:`keep_bitmaps`."""
    some, whole = _split(safe(documents, "doc_id", "text"), **options)
    return some.union(whole.withColumn("fl_bitmap", F.lit(None).cast("binary"))).toDF(*documents.columns, "fl_bitmap")


def dedup_lines(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the repeated lines gone, as :func:`keep_bitmaps` says; a null text stays null. Other
    columns stay as they are, whatever their names."""
    rows = safe(documents, "doc_id", "text")
    names = rows.columns
    some, whole = _split(rows, **options)

    def run(batches):
        for part in slices(batches, "text"):
            body = part.column("text").to_pylist()
            kept = [t if b is None or t is None else apply_bitmap(t.encode(), b)[0].decode() for t, b in zip(body, part.column("fl_bitmap").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else part.column(c) for c in names], names)

    return restored(some.transform(in_arrow, run, rows.schema).union(whole), documents, "doc_id", "text")
