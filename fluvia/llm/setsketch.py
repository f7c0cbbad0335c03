"""MinHash near-dedup on SetSketch registers (after Ertl, 2021): banded, estimated by likelihood, verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, memo, merged, raw, safe, slices, stored
from fluvia.llm.graph import connected_components
from fluvia.llm.simhash import BLOCK, hashes, key_groups, missed_links, shingle_sets, text_key, verified_links

SEED = 42
#: Keys of a set, of so many registers each. Two sets at Jaccard similarity j have no key in common with a
#: chance of (1 - j ** ROWS) ** BANDS: 5e-8 at 0.8, less above.
BANDS, ROWS = 32, 4
#: Register values are BASE apart in ratio, and RATE times a set's size is what a value of 0 stands for.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A candidate goes unverified only if the likelihood ratio against the similarity asked for is at least this
#: (twice the logarithm): a chance of about 1e-10 for a pair at that similarity.
SURELY = 42.0
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_ODD |= np.uint64(1)


def registers(once: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: for each register the smallest of the exponential variables
    of its elements (of rate RATE), on a scale of powers of BASE, cut off at 0 and TOP. A larger set has
    larger values; those of a union are the larger ones of its parts (see :func:`merge`)."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(once), 512):
        low = np.minimum(low, ((once[start : start + 512] ^ _XOR) * _ODD).min(axis=1))
    if not len(once):
        return np.zeros(BANDS * ROWS, np.uint16)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def band_keys(values: bytes) -> np.ndarray:
    """BANDS keys of a set's registers, as int64."""
    key = np.arange(BANDS, dtype=np.uint64)
    for part in np.frombuffer(values, np.uint16).reshape(BANDS, ROWS).T:
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    """The chance that a register of the one set is above the other's; x: its share of the union, less what is common."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(j: np.ndarray, u: np.ndarray, counts: tuple) -> np.ndarray:
    more, less, same = counts
    p, q = (np.maximum(_above(x), 1e-300) for x in (u - (1 - u) * j, (1 - u) - u * j))
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-300))


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
    """The Jaccard similarity of pairs of sets by maximum likelihood from their registers (rows of ``a`` and
    ``b``) and sizes; with it the counts of larger, smaller and equal registers, and the first set's share of both sizes."""
    counts = tuple(x.sum(axis=1) for x in (a > b, a < b, a == b))
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = _likelihood(x, u, counts) >= _likelihood(y, u, counts)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2, counts, u


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """False for pairs that are below the similarity by their sizes, or surely so by their registers."""
    sized = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)
    best, counts, u = estimated(a, b, n_a, n_b)
    top = np.minimum(u / (1 - u), (1 - u) / u)
    against = 2 * (_likelihood(best, u, counts) - _likelihood(np.minimum(similarity, top), u, counts))
    return sized & ((best >= similarity) | (against < SURELY))


def sketches(documents: DataFrame, size: int = 4) -> DataFrame:
    """Rows (doc_id, n_shingles, content, sketch, text_key) for each document: the number of its distinct shingles
    of ``size`` words, a hash of them, their registers and a hash of the text. A text with fewer words has one shingle, all of them; one
    without words, or a null one, has none."""

    def run(batches):
        memo(None)
        for part in slices(batches, "text"):
            size_of, content, sketch = [], [], []
            for text in raw(part.column("text")):
                once = np.unique(hashes(text, size))
                size_of.append(len(once))
                content.append(xxhash.xxh64_intdigest(once.tobytes(), SEED))
                sketch.append(registers(once).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size_of, pa.int64()), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(sketch, pa.binary()), part.column("text_key")], ["doc_id", "n_shingles", "content", "sketch", "text_key"])

    rows = safe(documents, "doc_id", "text").select("doc_id", "text", text_key().alias("text_key"))
    return rows.transform(in_arrow, run, "doc_id bigint, n_shingles bigint, content bigint, sketch binary, text_key bigint")


def likely_links(links: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``links`` (u, v) whose registers and sizes leave the similarity possible."""
    some = nodes.select("content", "sketch", "n_shingles")
    both = links.join(some.toDF("u", "su", "nu"), "u").join(some.toDF("v", "sv", "nv"), "v")

    def run(batches):
        memo(None)
        for b in merged(batches, 4000):
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in ("su", "sv"))
            n, m = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("nu", "nv"))
            yield b.filter(pa.array(may_reach(a, c, n, m, similarity))).select(["u", "v"])

    return both.select("u", "v", "su", "sv", "nu", "nv").transform(in_arrow, run, "u bigint, v bigint")


def near_groups(documents: DataFrame, size: int = 4, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for each document: the size of its set of shingles, and the smallest
    doc_id reachable over links, itself included. A link joins two sets whose Jaccard
    similarity is ``similarity`` at least.

    Documents with equal sets are one node. Nodes that share a key of registers (:func:`band_keys`) are
    candidates: first each with its key's smallest node, where the likelihood of the registers leaves the
    similarity possible, verified on full sets; then all pairs of a key that are still in different
    components are compared on full sets (:func:`missed_links`). So no pair below the similarity is
    linked, and a pair at 0.8 that nothing else joins is missed with a chance of 5e-8.

    Texts without words, and null ones, are linked with nothing. A row whose doc_id is null takes part like
    any other; its component_id is the smallest doc_id of its component, null if none has one. Repeated rows give repeated results, an
    empty table none; other columns, whatever their names, are ignored.
    """
    documents = safe(documents, "doc_id", "text")
    sketched = stored(sketches(documents, size), "sketches")
    nodes = stored(sketched.where("n_shingles > 0").groupBy("content").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.min("text_key").alias("text_key")), "nodes")
    groups = key_groups(nodes.select("content", "sketch"), band_keys)
    stars = groups.where("node != low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    likely = stored(likely_links(stars, nodes, similarity), "likely")
    ends = groups.select(F.col("node").alias("content")).distinct()
    grams = shingle_sets(documents, stored(nodes.join(ends, "content", "left_semi").select("text_key"), "shared-nodes"), size)
    first = stored(verified_links(likely, grams, similarity), "verified")
    more = stored(missed_links(groups, connected_components(first), grams, similarity, BLOCK), "missed")
    parts = stored(connected_components(first.union(more)), "parts")
    joined = nodes.select("content", "rep").join(parts, F.col("content") == F.col("node"), "left").select(F.col("content").alias("n_content"), "rep", F.coalesce("component", "content").alias("part"))
    least = joined.groupBy("part").agg(F.min("rep").alias("component_id"))
    heads = joined.join(least, "part").select("n_content", "component_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return sketched.join(heads, F.col("content") == F.col("n_content"), "left").select("doc_id", "n_shingles", alone.alias("component_id"))
