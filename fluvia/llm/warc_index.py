"""WARC archives and the external merge of their locally sorted capture indexes."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, new_path, raw, safe, slices, stored

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 100
#: Bytes of an archive, about; a single record may be larger.
ARCHIVE_BYTES = 8 << 20
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
#: Index rows for each merge task, about.
MERGE_ROWS = 100_000
#: Captures are one second apart from here on, by page_id (pages carry no time of their own).
FIRST_CAPTURE = 1_704_067_200
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _header(kind: str, page: str, url: str, date: str, digest: str, more: list[str], length: int) -> bytes:
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    fields += [*more, f"X-Page-Id: {page}", "Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return (CRLF.join(fields) + CRLF * 2).encode()


def _record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page}|{digest}'.encode()).hexdigest())}>"


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {n_bytes}{CRLF * 2}".encode()


def _member(record: bytes) -> bytes:
    """A record as a gzip member of its own. Its last byte is 0: the highest byte of a member's size field
    is, below 16 MB; a larger record is followed by an empty member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record + b"\r\n\r\n") + pack.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def response_record(page: str, url: str, date: str, digest: str, payload: bytes) -> bytes:
    http = _http(len(payload))
    return b"".join((_header("response", page, url, date, digest, [], len(http) + len(payload)), http, payload))


def revisit_record(page: str, url: str, date: str, digest: str, n_bytes: int, refers_to: int) -> bytes:
    http = _http(n_bytes)
    more = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(str(refers_to), digest)}", f"X-Refers-To-Page: {refers_to}"]
    return _header("revisit", page, url, date, digest, more, len(http)) + http


def responses(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, date, digest, n_bytes, member for each page: what its index needs, and its payload
    as the compressed response record. The only step that reads payloads; it hashes each once."""
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:fluvia:none")), "[\\x00-\\x20]", "%20")
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), date.alias("date"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for part in slices(batches, "html"):
            digests, sizes, members = [], [], []
            for page, address, at, payload in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("date").to_pylist(), raw(part.column("html")), strict=True):
                digest = hashlib.sha256(payload).hexdigest()
                digests.append(digest)
                sizes.append(len(payload))
                members.append(_member(response_record("-" if page is None else str(page), address, at, digest, payload)))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("date"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], ["page_id", "url", "date", "digest", "n_bytes", "member"])

    return rows.transform(in_arrow, run, "page_id bigint, url string, date string, digest string, n_bytes bigint, member binary")


def write_archives(pages: DataFrame, out: str | None = None) -> str:
    """Writes WARC 1.1 files with a record for each page and returns their folder.

    Each record is a gzip member of its own, so that the index's offsets can be sought in the file. A
    member's last byte, 0, is the line separator that the writer puts there. Archives have about
    ARCHIVE_BYTES; one record may be larger. Of pages with equal payloads of at least 100 bytes the smallest page_id is the
    response and the others revisit it: the smallest id of a payload is found by an aggregation that
    is combined before the shuffle; the join back is on the digest and can be split where one payload
    has very many pages. Only compressed records are shuffled.

    A null html is an empty payload; null urls become ``urn:fluvia:none``; a null page_id is written as
    ``-`` and is always a response. Rows repeated with one page_id and payload all have that id's type.
    An empty table gives no record. Other columns, whatever their names, are ignored.
    """
    out = out or new_path(pages.sparkSession, "warc")
    known = stored(responses(safe(pages, "page_id", "url", "html")), "responses")
    first = known.where((F.col("n_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("f_digest"), "first_id")
    first = stored(first, "first-pages")  # read back, so that the join has an exchange on either side and a large group can be split
    typed = known.join(first, F.col("digest") == F.col("f_digest"), "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")))
    typed = typed.select("page_id", "url", "date", "digest", "n_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("member")).alias("member"))

    def run(batches):
        archive, size = 0, 0
        for part in slices(batches, "member"):
            numbers, values = [], []
            for page, url, date, digest, n_bytes, refers_to, member in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                value = member if refers_to is None else _member(revisit_record(str(page), url, date, digest, n_bytes, refers_to))
                if size and size + len(value) > ARCHIVE_BYTES:
                    archive, size = archive + 1, 0
                size += len(value)
                numbers.append(archive)
                values.append(value[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], ["archive", "value"])

    members = typed.transform(in_arrow, run, "archive int, value binary").select("archive", F.col("value").cast("string").alias("value"))
    members.write.partitionBy("archive").option("lineSep", "\0").text(out)
    return out


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


def parse_record(record: bytes) -> tuple[dict, dict, bytes]:
    """Header fields, HTTP fields and payload of one WARC record."""
    stop = record.index(b"\r\n\r\n")
    if not record.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.decode(): v.decode() for k, v in _FIELD.findall(record, record.index(b"\n") + 1, stop)}
    block = record[stop + 4 : stop + 4 + int(fields["Content-Length"])]
    if record[stop + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    split = block.index(b"\r\n\r\n")
    return fields, {k.decode(): v.decode() for k, v in _FIELD.findall(block, block.index(b"\n") + 1, split + 2)}, block[split + 4 :]


def archive_records(content):
    """(offset, length, record) for each gzip member of an archive, one decompressed at a time."""
    content = memoryview(content)
    at = 0
    while at < len(content):
        unpack, parts, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if pos >= len(content):
                raise ValueError(f"the member at byte {at} has no end")
            piece = content[pos : pos + 65_536]
            parts.append(unpack.decompress(piece))
            pos += len(piece)
        pos -= len(unpack.unused_data)
        if record := b"".join(parts):
            yield at, pos - at, record
        at = pos


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query: pages of a host and a domain sort together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url, re.I)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


RUN_SCHEMA = "url_key string, capture string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string, offset bigint, length bigint, run bigint, seq int"
_RUN = [f.split()[0] for f in RUN_SCHEMA.split(", ")]


def _order(row) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[4], row[8], row[9]


def capture_runs(spark, archives: str) -> DataFrame:
    """The index of archives: for each archive one run, sorted by URL key, time and page.

    Reads every record back, checks a response's payload against its digest and takes a revisit's
    length and digest from its header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name = "/".join(path.rsplit("/", 2)[-2:])
                number = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little", signed=True)
                rows = []
                for offset, length, record in archive_records(content.as_buffer()):
                    warc, http, payload = parse_record(record)
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = warc["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{name}: the payload at byte {offset} doesn't have its digest")
                    page = warc["X-Page-Id"]
                    refers = warc.get("X-Refers-To-Page")
                    url = warc["WARC-Target-URI"]
                    rows.append((url_key(url), warc["WARC-Date"], None if page == "-" else int(page), int(http["Content-Length"]), digest, kind, None if refers is None else int(refers), url, name, offset, length))
                rows.sort(key=_order)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 11
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(np.full(len(rows), number, np.int64)), pa.array(np.arange(len(rows), dtype=np.int32))], _RUN)

    return files.transform(in_arrow, run, RUN_SCHEMA)


class LoserTree:
    """Merges k sorted iterators: each inner node holds the loser of its match, so that the next item
    takes one comparison for each level on the way from a leaf to the root."""

    def __init__(self, runs: list, key):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [self._pull(i) for i in range(len(self.runs))] or [None]
        self.tree = [-1] * self.k
        win = [0] * self.k + list(range(self.k))  # leaves at k and on; the parent of a node is its half
        for node in range(self.k - 1, 0, -1):
            a, b = win[2 * node], win[2 * node + 1]
            win[node], self.tree[node] = (a, b) if self._less(a, b) else (b, a)
        self.tree[0] = win[1] if self.k > 1 else 0

    def _pull(self, i):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self):
        while (head := self.heads[winner := self.tree[0]]) is not None:
            yield head[2]
            self.heads[winner] = self._pull(winner)
            node = (winner + self.k) // 2
            while node:
                if self._less(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs merged into one global order by URL key, time and page.

    Ranges of the order go to tasks, with the page in the range's key so that a URL of very many
    captures spreads over several; each task merges its stretches of the runs with a loser tree. The
    columns part and place give the global order; a task's range has MERGE_ROWS, about, held as Arrow
    columns, of which keys are taken out a few hundred at a time.
    """
    n = max(1, -(-runs.count() // MERGE_ROWS), runs.sparkSession.sparkContext.defaultParallelism)
    ranged = runs.repartitionByRange(n, "url_key", "capture", F.col("page_id").asc_nulls_last(), "payload_digest", "archive", "offset")

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        number, seq = (rows.column(c).to_numpy() for c in ("run", "seq"))
        order = np.lexsort((seq, number))  # blocks of one run may arrive in another order
        rows = rows.select(_RUN[:11])

        def keyed(at: np.ndarray):
            for s in range(0, len(at), 256):
                some = rows.take(pa.array(at[s : s + 256]))
                yield from zip(map(_order, zip(*(c.to_pylist() for c in some.columns), strict=True)), at[s : s + 256].tolist(), strict=True)

        stretches = np.split(order, np.flatnonzero(np.diff(number[order])) + 1)
        merged, place, part = iter(LoserTree([keyed(x) for x in stretches], lambda x: x[0])), 0, TaskContext.get().partitionId()
        while at := [i for _, i in islice(merged, 5000)]:
            own = rows.take(pa.array(at)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(np.arange(place, place + len(at)))], [*_RUN[:11], "part", "place"])
            place += len(at)

    return ranged.transform(in_arrow, run, RUN_SCHEMA.rsplit(", ", 2)[0] + ", part int, place bigint")


def archive_index(pages: DataFrame) -> DataFrame:
    """Archives of ``pages``, read back, with the merged index of all captures; see the steps' own notes."""
    return merge_runs(stored(capture_runs(pages.sparkSession, write_archives(pages)), "capture-runs"))
