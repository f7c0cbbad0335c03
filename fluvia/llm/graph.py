"""Connected components of a link table, as rounds of joins; no component is ever gathered in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, merged, stored


def _contract(batches):
    """Links of one Arrow batch as stars: each node with the smallest node that it reaches within the batch."""
    for b in merged(batches):
        u, v = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, c = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while len(a):
            low = np.minimum(label[a], label[c])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[c], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        while (label[label] != label).any():
            label = label[label]
        far = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[far]]), pa.array(nodes[far])], ["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (two bigint columns); component: the smallest reachable node.

    Alternating large and small stars: each round points every node at a smaller one, until each
    component is one star around its smallest node. Links are first contracted batch by batch. The
    joins are plain equi-joins of a link table with one minimum for each node, so that a node with
    very many links is split by the adaptive skew join.

    Null ends and loops are ignored; repeated links count once; without links the result is empty.
    """
    a, b = links.columns
    e = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u != v").transform(in_arrow, _contract, "u bigint, v bigint")
    e = stored(e.distinct(), "links")
    seen = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u != v").distinct()
        e = stored(small, "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
