"""SimHash near-dedup: 64-bit fingerprints linked by multi-index hashing over small Hamming balls."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.llm.common import Bloom, in_arrow, memo, merged, raw, restored, safe, slices, stored, tester, tidy
from fluvia.llm.graph import connected_components

SEED = 42
#: Fingerprints that share a table key and are linked in memory at once; more get longer keys first.
MOST_IN_RUN = 4096
#: Keys with so many fingerprints at most are linked side by side; larger ones one after the other.
FEW_IN_RUN = 16
#: Table rows of a part of :func:`near_links`, which one task holds at a time, and fingerprints that are entered at once.
PART_ROWS, ENTERED = 1 << 19, 2000
#: Further keys of a text for near copies: BANDS keys of MINIMA minima each. Two texts at Jaccard similarity j
#: have none in common with a chance of (1 - j ** MINIMA) ** BANDS: 3e-6 at 0.8.
BANDS, MINIMA = 24, 4
#: Texts of a block; groups with more are compared block by block, in different tasks.
BLOCK = 512
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * MINIMA, 1), np.uint64)
_ODD |= np.uint64(1)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; a text with fewer words gives all of them as one."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    parts = shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in parts), np.uint64, len(parts))


def fingerprint(h: np.ndarray) -> int:
    """Bit k is set if it is set in over half the hashes; 0 without any."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 16_384):
        part = h[start : start + 16_384]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def bands(once: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each of the smallest hash under MINIMA orders; none of an empty set."""
    if not len(once):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for start in range(0, len(once), 512):
        low = np.minimum(low, ((once[start : start + 512] ^ _XOR) * _ODD).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, MINIMA).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def fingerprints(documents: DataFrame, size: int = 3, distinct: bool = False) -> DataFrame:
    """Rows (doc_id, fp, content) for each document; fp: the fingerprint's bits as a bigint; content: a
    hash of the sorted set of shingle hashes, equal for texts with the same shingles.

    With ``distinct`` a shingle counts once however often a text repeats it, as in a Jaccard similarity,
    and the rows have the text's ``bands`` and :func:`text_key` too. A null text counts as empty: fingerprint zero.
    """

    def run(batches):
        memo(None)
        for part in slices(batches, "text"):
            fps, content, keys = [], [], []
            for text in raw(part.column("text")):
                h = hashes(text, size)
                once = np.unique(h)
                if distinct:
                    keys.append(bands(once).tobytes())
                fps.append(fingerprint(once if distinct else h))
                content.append(xxhash.xxh64_intdigest(once.tobytes(), SEED))
            more = [pa.array(keys, pa.binary()), part.column("text_key")] if distinct else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, content)), *more], names)

    names = ["doc_id", "fp", "content", *(["bands", "text_key"] if distinct else [])]
    rows = safe(documents, "doc_id", "text").select("doc_id", "text", *([text_key().alias("text_key")] if distinct else []))
    return rows.transform(in_arrow, run, "doc_id bigint, fp bigint, content bigint" + (", bands binary, text_key bigint" if distinct else ""))


class Segments:
    """How fingerprints are cut and probed.

    The 64 bits are cut into ``blocks`` equal parts (the last ones a bit shorter); each table's key is
    the value of one choice of ``chosen`` parts. Each fingerprint is entered under its own key and
    under those that differ in one bit. With ``directed``, only bits that are 0 are flipped: two keys
    that differ in one bit still meet, once. Without it, keys that differ in two bits meet as well, as
    both sides flip one.
    """

    def __init__(self, blocks: int, chosen: int, directed: bool):
        cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
        self.tables = [[b for k in pick for b in range(cuts[k], cuts[k + 1])] for pick in combinations(range(blocks), chosen)]
        self.directed = directed
        #: Rows of a fingerprint, on average.
        self.rows = sum(1 + len(bits) // (1 + directed) for bits in self.tables)

    def entries(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of fp, key) for all tables; the key's upper bits have the table's number."""
        rows, keys = [], []
        every = np.arange(len(fp))
        for t, bits in enumerate(self.tables):
            value = np.zeros(len(fp), np.uint64)
            for k, b in enumerate(bits):
                value |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
            value |= np.uint64(t << 40)
            rows.append(every)
            keys.append(value)
            for k in range(len(bits)):
                bit = np.uint64(1 << k)
                pick = np.flatnonzero(value & bit == 0) if self.directed else every
                rows.append(pick)
                keys.append(value[pick] ^ bit)
        return np.concatenate(rows), np.concatenate(keys)


#: All pairs with up to 3 differing bits: one half differs in 1 at most.
HALVES = Segments(2, 1, True)
#: Pairs with up to 8 differing bits always, most with 9 or 10: in two of five parts 2 bits at most differ.
FIFTHS = Segments(5, 2, False)


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links between ``fp``, in memory that grows with their number."""
    n = len(fp)
    near = np.bitwise_count(fp ^ fp[0]).astype(np.int64)
    parent = np.zeros(n, np.int64)
    near[0] = 99
    rest = np.ones(n, bool)
    rest[0] = False
    a, b = [], []
    for _ in range(n - 1):
        i = int(np.argmin(near))
        if near[i] <= radius:
            a.append(parent[i])
            b.append(i)
        rest[i] = False
        near[i] = 99
        d = np.bitwise_count(fp ^ fp[i])
        closer = rest & (d < near)
        near[closer] = d[closer]
        parent[closer] = i
    return np.array(a, np.int64), np.array(b, np.int64)


def _key_links(key: np.ndarray, fp: np.ndarray, radius: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (row numbers a, b) between the rows of a key whose fingerprints differ in ``radius`` bits at most, of which
    each key has fewer than rows, so that they join what all such pairs join; whether a link is one of a key's spanning
    forest; and the rows of keys with more than ``most`` rows, which aren't linked. Rows are sorted by key."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    of = np.repeat(np.arange(len(size)), size)
    hot = size > most if most is not None else np.zeros(len(size), bool)
    few = (size > 1) & (size <= FEW_IN_RUN) & ~hot
    left = np.repeat(start + size, size) - np.arange(len(key))  # rows of the key from here on
    row = np.flatnonzero(few[of])
    us, vs = [], []
    for step in range(1, FEW_IN_RUN):
        row = row[left[row] > step]
        if not len(row):
            break
        near = row[np.bitwise_count(fp[row] ^ fp[row + step]) <= radius]
        us.append(near)
        vs.append(near + step)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    many = few & (np.bincount(of[u], minlength=len(size)) >= size)
    sparse = ~many[of[u]]
    us, vs = [u[sparse]], [v[sparse]]
    for k in np.flatnonzero(many | ((size > FEW_IN_RUN) & ~hot)).tolist():
        a, b = _forest(fp[start[k] : start[k] + size[k]], radius)
        us.append(start[k] + a)
        vs.append(start[k] + b)
    u, v = np.concatenate(us), np.concatenate(vs)
    return u, v, np.arange(len(u)) >= len(us[0]), np.flatnonzero(hot[of])


def _once(fp: np.ndarray, a: np.ndarray, b: np.ndarray, forest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between the same two fingerprints, which share several keys of a part, one; of the links in forests
    of its keys, a forest of the part."""
    u, v = np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])
    order = np.lexsort((forest, v, u))
    new = np.append(True, (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0))[: len(order)]
    keep = order[new]
    root: dict[int, int] = {}

    def top(x):
        while x in root:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    stay = ~forest[keep]
    for k in np.flatnonzero(forest[keep]).tolist():
        x, y = top(int(u[keep[k]])), top(int(v[keep[k]]))
        if x != y:
            root[y] = x
            stay[k] = True
    return a[keep[stay]], b[keep[stay]]


def _run_links(radius: int):
    """Streams rows (key, fp) sorted by key; links (u, v: fingerprints) those of a key, see :func:`_key_links`."""

    def link(key, fp):
        a, b, _, _ = _key_links(key, fp.view(np.uint64), radius, None)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 2
        for batch in merged(batches):
            rows = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            yield link(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        yield link(*held)

    return run


def near_links(nodes: DataFrame, radius: int, segments: Segments, most_in_run: int = MOST_IN_RUN) -> DataFrame:
    """Links (u, v) between nodes (fp, rep) whose fingerprints differ in ``radius`` bits at most: for each
    table key fewer links than rows that join what all its links join (for keys with many links, together for those of a
    part, a spanning forest), so that their connected
    components are those of all links. Nodes of one fingerprint are linked with the smallest of them, which stands for it.

    Table rows go to parts by a hash of their key, those of some thousand fingerprints for one part as one row. Keys
    with more than ``most_in_run`` rows are dealt out again with a longer key: the bits outside
    the table's key are cut into ``radius`` + 1 parts, of which any pair within the radius has one in
    common. So no link is lost, and what one task holds stays bounded.
    """
    heads = stored(nodes.groupBy("fp").agg(F.min("rep").alias("head")), "heads")
    parts = int(min(max(1, -(-heads.count() * segments.rows // PART_ROWS)), (1 << 16) - 1))

    def entered(batches):
        for b in merged(batches, ENTERED):
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s in range(0, len(every), ENTERED):
                fp = every[s : s + ENTERED].view(np.uint64)
                rows, keys = segments.entries(fp)
                part = ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                n = np.bincount(part, minlength=parts)
                some = np.flatnonzero(n)
                ends = pa.py_buffer((8 * np.append(0, np.cumsum(n[some]))).astype(np.int32))
                packed = [pa.Array.from_buffers(pa.binary(), len(some), [None, ends, pa.py_buffer(x[order])]) for x in (keys, fp[rows])]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *packed], ["part", "keys", "fps"])

    def linked(part):
        key, fp = (np.frombuffer(b"".join(x), np.uint64) for x in zip(*part, strict=True))
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        a, b, forest, hot = _key_links(key, fp, radius, most_in_run)
        a, b = _once(fp, a, b, forest)
        kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(hot)])
        columns = (np.append(np.zeros(len(a), np.uint64), key[hot]), np.append(fp[a], fp[hot]), np.append(fp[b], fp[hot]))
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x.view(np.int64)) for x in columns)], ["kind", "key", "u", "v"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for part, keys, fps in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != at and held:
                    yield linked(held)
                    held = []
                at = part
                held.append((keys, fps))
        if held:
            yield linked(held)
        tidy()

    packed = heads.select("fp").transform(in_arrow, entered, "part int, keys binary, fps binary")
    found = stored(packed.repartition("part").sortWithinPartitions("part").transform(in_arrow, run, "kind int, key bigint, u bigint, v bigint"), "near-links")

    def longer(batches):
        for b in batches:
            key, fp = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "u"))
            out = [[], []]
            for t, bits in enumerate(segments.tables):
                pick = (key >> 40) == t
                if not pick.any():
                    continue
                other = [x for x in range(64) if x not in set(bits)]
                cuts = [round(len(other) * k / (radius + 1)) for k in range(radius + 2)]
                for k in range(radius + 1):
                    value = key[pick].view(np.uint64)
                    part = np.zeros(len(value), np.uint64)
                    for j, bit in enumerate(other[cuts[k] : cuts[k + 1]]):
                        part |= ((fp[pick].view(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)
                    mixed = _mix(value, part, k)
                    out[0].append(mixed.view(np.int64))
                    out[1].append(fp[pick])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], ["key", "fp"])

    hot = found.where("kind = 1").select("key", "u").transform(in_arrow, longer, "key bigint, fp bigint")
    again = hot.repartition("key").sortWithinPartitions("key").transform(in_arrow, _run_links(radius), "u bigint, v bigint")
    links = found.where("kind = 0").select("u", "v").union(again).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    of = lambda c: heads.toDF(c, f"{c}_rep")
    between = links.join(of("u"), "u").join(of("v"), "v").select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v"))
    same = nodes.select("fp", "rep").join(heads, "fp").select(F.col("head").alias("u"), F.col("rep").alias("v"))
    return between.union(same).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _mix(key: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key from a table key and a further part; rows that meet by chance are compared like all others."""
    x = (key ^ (part << np.uint64(44)) ^ np.uint64(k << 60)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x + part) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def near_classes(documents: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id) for each document: the smallest doc_id reachable over links of
    fingerprints that differ in ``radius`` bits at most (3 at most: then every link is found).

    Equal fingerprints are one node, so a group of copies costs one row. Null and empty texts have
    fingerprint zero and are linked like any other, as are rows whose doc_id is null; a null is never a
    component's id unless all of the component's doc_ids are null. Repeated rows give repeated results; an empty table gives none.
    """
    prints = stored(fingerprints(documents, size), "fingerprints").select("doc_id", "fp")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    parts = stored(connected_components(near_links(nodes.select("fp", F.col("fp").alias("rep")), radius, HALVES)), "parts")
    joined = nodes.join(parts, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("n_fp"), "rep", F.coalesce("component", "fp").alias("part"))
    least = joined.groupBy("part").agg(F.min("rep").alias("component_id"))
    heads = joined.join(least, "part").select("n_fp", "component_id")
    return prints.join(heads, F.col("fp") == F.col("n_fp"), "left").select("doc_id", "fp", "component_id")


def band_keys(packed: bytes) -> np.ndarray:
    """The keys of a ``bands`` value."""
    return np.frombuffer(packed, np.int64)


def key_groups(nodes: DataFrame, keys_of: Callable[[bytes], np.ndarray] = band_keys) -> DataFrame:
    """Rows (key, node, low, n) of nodes (content and what ``keys_of`` takes keys from) for each key that ``n`` > 1 nodes
    share; low: the key's smallest node. Of keys with the same nodes one is kept."""

    def entered(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(node):
                continue
            keys = [keys_of(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(node, [len(x) for x in keys]))], ["key", "node"])

    keyed = stored(nodes.select(*nodes.columns[:2]).transform(in_arrow, entered, "key bigint, node bigint"), "keys")
    h = F.xxhash64("node")
    sized = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(h).alias("x"), F.sum(h % (1 << 31)).alias("y")).where("n > 1")
    some = stored(sized.groupBy("n", "low", "x", "y").agg(F.min("key").alias("key")).select("key", "low", "n"), "shared-keys")
    return stored(keyed.join(some, "key").select("key", "node", "low", "n"), "key-groups")


def text_key():
    """A hash of a document's text, null counting as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_sets(documents: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Rows (node, grams) for the texts of ``keys`` (one column of :func:`text_key`) at least; grams: the sorted
    hashes of the text's shingles, node: their hash, as ``content`` in :func:`fingerprints`."""
    bloom = Bloom(keys, F.col(keys.columns[0]))
    bits, shared = bloom.bits, bloom.shared

    def sets(batches):
        memo(None)
        test = tester(bits, shared)
        for part in slices(batches, "text"):
            part = part.filter(pa.array(test(part.column("h").to_numpy(zero_copy_only=False))))
            grams = [np.unique(hashes(t, size)).tobytes() for t in raw(part.column("text"))]
            node = np.array([xxhash.xxh64_intdigest(x, SEED) for x in grams], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(grams, pa.binary())], ["node", "grams"])

    some = documents.select("text", text_key().alias("h"))
    return stored(some.transform(in_arrow, sets, "node bigint, grams binary").groupBy("node").agg(F.max("grams").alias("grams")), "shingle-sets")


def verified_links(links: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Those of ``links`` (u, v: nodes) whose sets of shingles have that Jaccard similarity at least."""
    both = links.join(grams.toDF("u", "gu"), "u").join(grams.toDF("v", "gv"), "v")

    def similar(batches):
        memo(None)
        for b in slices(batches, "gu", 1 << 20):
            keep = []
            for x, y in zip(b.column("gu").to_pylist(), b.column("gv").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common + 1e-9 >= similarity * (len(x) + len(y) - common))
            yield b.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return both.select("u", "v", "gu", "gv").transform(in_arrow, similar, "u bigint, v bigint")


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` has in common with each of ``right``.

    Elements that both sides have are counted by a product of 0/1 matrices, some thousand at a time; if they are many more
    than a set has, by marking those of one set after the other.
    """
    n, m = (np.array([len(x) for x in side]) for side in (left, right))
    ids = pd.factorize(np.concatenate([*left, *right]))[0]
    a, b = ids[: n.sum()], ids[n.sum() :]
    both = np.zeros((2, int(ids.max(initial=-1)) + 1), bool)
    both[0, a] = both[1, b] = True
    number = np.cumsum(both.all(axis=0)) - 1
    total = int(number[-1]) + 1 if len(number) else 0
    if total > 8 * len(b) / len(right):
        out, ends, mark = np.zeros((len(left), len(right)), np.int64), np.cumsum(m), np.zeros(both.shape[1], bool)
        for k, mine in enumerate(np.split(a, np.cumsum(n)[:-1])):
            mark[mine] = True
            out[k] = np.diff(np.append(0, np.append(0, np.cumsum(mark[b]))[ends]))
            mark[mine] = False
        return out
    out = np.zeros((len(left), len(right)), np.float32)
    shared = both.all(axis=0)
    sides = [(np.repeat(np.arange(len(k)), k)[shared[x]], number[x[shared[x]]], len(k)) for k, x in ((n, a), (m, b))]
    for start in range(0, total, 4096):
        x, y = (np.zeros((rows, min(4096, total - start)), np.float32) for _, _, rows in sides)
        for matrix, (row, col, _) in zip((x, y), sides, strict=True):
            here = (col >= start) & (col < start + 4096)
            matrix[row[here], col[here] - start] = 1
        out += x @ y.T
    return out.astype(np.int64)


def group_links(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float, probe: np.ndarray | None = None, base: np.ndarray | None = None, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between nodes at the similarity that join all labels that any pair of a ``probe`` and a
    ``base`` node joins.

    Without ``probe``, the nodes outside the commonest label are probes; without ``base``, all nodes are base nodes. Each
    probe (with ``asking``, each of those only) is compared with the base nodes of other labels, those that are probes too once, so
    a pair is left out only if its ends are joined already.
    """
    _, at, times = np.unique(label, return_inverse=True, return_counts=True)
    if len(times) < 2:
        return []
    probe = at != times.argmax() if probe is None else probe
    base = np.flatnonzero(np.ones(len(node), bool) if base is None else base)
    asking = np.flatnonzero(probe if asking is None else asking)
    if not len(asking) or not len(base):
        return []
    size = np.array([len(x) for x in sets])
    common = in_common([sets[i] for i in asking], [sets[i] for i in base])
    near = common + 1e-9 >= similarity * (size[asking][:, None] + size[base] - common)
    near &= (at[asking][:, None] != at[base]) & (~probe[base] | (node[base] > node[asking][:, None]))
    root = at.copy()
    out = []
    for k in np.flatnonzero(near.any(axis=1)):
        i, to = asking[k], base[near[k]]
        to = to[root[to] != root[i]]
        for j in to[np.unique(root[to], return_index=True)[1]]:
            out.append((int(node[i]), int(node[j])))
            root[root == root[j]] = root[i]
    return out


def _open_keys(labelled: DataFrame) -> DataFrame:
    """Rows (key, n, common, probes) for each key of (key, node, label) whose nodes have several labels: how many
    nodes it has, their commonest label and how many have another one."""
    each = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    top = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    return top.where("n > top.n").select("key", "n", F.col("top.label").alias("common"), (F.col("n") - F.col("top.n")).alias("probes"))


def missed_links(groups: DataFrame, parts: DataFrame, grams: DataFrame, similarity: float, block: int = BLOCK, more: DataFrame | None = None, keys_of: Callable[[bytes], np.ndarray] = band_keys) -> DataFrame:
    """Links (u, v) at the similarity between nodes that share a key of ``groups`` and are in different
    components of ``parts`` (node, component): with them, every such pair is in one component.

    Keys whose nodes are all in one component are done, and so are keys of two nodes, whose only pair
    was compared. The nodes of the others are dealt to blocks; those outside a key's commonest component
    (its probes) also go to all other blocks of the key and are compared with what is there, so that a
    key costs its nodes and its probes once for each block. A task holds a block and a part of the probes at a time.

    With ``more`` (node and what ``keys_of`` takes keys from) a key with more probes than ``block`` is first
    cut into longer keys, of its own and another key of the node: texts that only share a passage part there, but copies
    meet in most of the longer keys again. A pair that shares no other key is then missed.
    """
    labelled = stored(groups.where("n > 2").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "placed")
    still = stored(_open_keys(labelled), "open-keys")
    dealt = labelled.join(still, "key")
    if more is not None:

        def longer(batches):
            for b in batches:
                key, node, label = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                if not len(key):
                    continue
                own = np.stack([keys_of(x) for x in b.column(3).to_pylist()]).view(np.uint64)
                new = ((own ^ key.view(np.uint64)[:, None]) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
                # The key itself gives 0 for every key: all nodes of all hot keys would meet there.
                other = new != 0
                n = other.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(new[other]), pa.array(np.repeat(node, n)), pa.array(np.repeat(label, n))], ["key", "node", "label"])

        hot = dealt.where(F.col("probes") > block).select("key", "node", "label").join(more.toDF("node", "packed"), "node").select("key", "node", "label", "packed")
        cut = stored(hot.transform(in_arrow, longer, "key bigint, node bigint, label bigint"), "longer-keys")
        dealt = dealt.where(F.col("probes") <= block).unionByName(cut.join(stored(_open_keys(cut), "open-keys"), "key"))
    last = F.ceil(F.col("n") / block).cast("int") - 1
    mine = F.pmod(F.xxhash64("node", "key"), last + 1).cast("int")
    probe = F.col("label") != F.col("common")
    to = F.explode(F.when(probe, F.sequence(F.lit(0), last)).otherwise(F.array(mine)))
    tasks = dealt.select("key", "node", "label", probe.alias("probe"), mine.alias("mine"), to.alias("to")).select(F.xxhash64("key", "to").alias("task"), "node", "label", "probe", (F.col("mine") == F.col("to")).alias("base"))
    rows = tasks.join(grams, "node").select("task", "node", "label", "probe", "base", "grams")

    def run(batches):
        memo(None)

        def found(rows, asking=None):
            links = []
            if rows.num_rows > 1:
                node, label, probe, base = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
                links = group_links(node, label, [np.frombuffer(x.as_py(), np.uint64) for x in rows.column(5)], similarity, probe.astype(bool), base.astype(bool), asking)
            u, v = np.array(links, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        at, held = None, None  # a task and the nodes of its block; probes of other blocks follow them
        alone = False  # whether the block's own probes have yet to be compared
        for batch in slices(batches, "grams"):
            task = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                own = part.filter(part.column("base"))
                if at != task[a]:
                    if alone:
                        yield found(held)
                    at, held, alone = task[a], own, True
                elif own.num_rows:
                    held = pa.concat_batches([held, own])
                rest = part.slice(own.num_rows)
                if rest.num_rows and held.num_rows:
                    if alone:
                        yield found(held)
                        alone = False
                    yield found(pa.concat_batches([held, rest]), np.arange(held.num_rows + rest.num_rows) >= held.num_rows)
        if alone:
            yield found(held)

    return rows.repartition("task").sortWithinPartitions("task", F.desc("base")).transform(in_arrow, run, "u bigint, v bigint")


def drop_near_duplicates(documents: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 10) -> DataFrame:
    """``documents`` with one row of each group of near copies, that with the smallest doc_id.

    Candidates are pairs of texts that share one of their :func:`bands`, and pairs of fingerprints over
    ``size`` words within ``radius`` bits, found by their parts (see :data:`FIFTHS`); a candidate is a
    link if the exact Jaccard similarity of the sets of shingles is ``similarity`` at least; groups are
    connected components of links. Few links join most texts of a key first; then all pairs of a key
    that are still in different components are compared. Texts with equal sets of shingles are one
    node. So no text below the similarity goes; a pair at 0.8 shares no key with a chance of 3e-6 (see
    the README for measured shares).

    Rows with a null doc_id stay. Rows with one doc_id and equal sets of shingles are repeats, of which
    one stays; with other texts they are rows like any others. Texts without words
    (null, empty, blanks) are copies of each other. An empty table gives an empty result. Other columns
    stay as they are, whatever their names.
    """
    given, documents = documents, safe(documents, "doc_id", "text")
    documents_id = F.col("doc_id").cast("bigint")
    prints = stored(fingerprints(documents, size, distinct=True).where("doc_id is not null"), "fingerprints")
    nodes = stored(prints.groupBy("content").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.min("bands").alias("bands")), "nodes")
    groups = key_groups(nodes.select("content", "bands"))
    stars = groups.where("node != low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    links = stored(near_links(nodes.select("fp", F.col("content").alias("rep")), radius, FIFTHS).union(stars).distinct(), "candidates")
    ends = links.select(F.explode(F.array("u", "v")).alias("content")).distinct()
    grams = shingle_sets(documents, stored(nodes.join(ends, "content", "left_semi").select("text_key"), "link-ends"), size)
    first = stored(verified_links(links, grams, similarity), "verified")
    more = stored(missed_links(groups, connected_components(first), grams, similarity, BLOCK), "missed")
    parts = stored(connected_components(first.union(more)), "parts")
    joined = nodes.join(parts, F.col("content") == F.col("node"), "left").select(F.col("content").alias("n_content"), "rep", F.coalesce("component", "content").alias("part"))
    least = joined.groupBy("part").agg(F.min(F.struct("rep", "n_content")).alias("head"))
    heads = joined.join(least, "part").select("n_content", "head")
    is_head = (F.col("doc_id") == F.col("head.rep")) & (F.col("content") == F.col("head.n_content"))
    placed = stored(prints.select("doc_id", "content").join(heads, F.col("content") == F.col("n_content")).select("doc_id", "content", is_head.alias("heads")), "placed")
    # An id that occurs once and heads its group needs no shuffle of its text.
    counted = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("heads").alias("fl_heads"))
    odd = stored(counted.where("n > 1 or not fl_heads").select(F.col("doc_id").alias("fl_id"), "fl_heads"), "dropped")
    bloom = Bloom(odd, F.xxhash64("fl_id"))
    marked = documents.withColumn("fl_maybe", F.coalesce(bloom.may_hold(F.xxhash64(documents_id)) & F.col("doc_id").isNotNull(), F.lit(False)))
    some = marked.where("fl_maybe").join(odd, documents_id == F.col("fl_id"), "left").where("fl_id is null or fl_heads")
    # Of the rows of a repeated id, those go whose own text heads no group.
    chosen = placed.where("heads").select(F.col("doc_id").alias("h_id"), F.col("content").alias("h_content")).distinct()
    again = some.where("fl_id is not null").withColumn("fl_content", _content(size)(F.col("text")))
    again = again.join(chosen, (F.col("fl_id") == F.col("h_id")) & (F.col("fl_content") == F.col("h_content")), "left_semi")
    once = again.withColumn("fl_row", F.row_number().over(Window.partitionBy("fl_id", "fl_content").orderBy(F.xxhash64("text")))).where("fl_row = 1")
    kept = marked.where("not fl_maybe").select(documents.columns).union(some.where("fl_id is null").select(documents.columns)).union(once.select(documents.columns))
    return restored(kept, given, "doc_id", "text")


def _content(size: int):
    """The ``content`` of a text as in :func:`fingerprints`, as a function of columns."""

    @F.pandas_udf("bigint")
    def content(text: pd.Series) -> pd.Series:
        digest = [xxhash.xxh64_intdigest(np.unique(hashes((t or "").encode(), size)).tobytes(), SEED) for t in text]
        return pd.Series(np.array(digest, np.uint64).view(np.int64))

    return content
