"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.llm.common import restored, safe, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST_COPIES = 3
SEED = "mix-1"
#: The table of rates is broadcast up to so many sources; beyond, it is an ordinary join.
BROADCAST_SOURCES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"


def source_rates(documents: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row for each source: source, source_size, target, rate.

    Sizes are words. The targets share 100 % of all words by weight; a target stops at ``most`` times
    its source's size and the excess is shared out again by weight until none is above. That fixed
    point is computed directly, on one row for each source: with sources ordered by size over weight, those before the first one
    that isn't full are full, and the rest get weight times what is left over the weights left.
    """
    documents = safe(documents, "source", "text")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    sizes = documents.groupBy("source").agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    sizes = sizes.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sizes = sizes.withColumn("level", left.cast("double") / weights_left.cast("double"))
    full = most * F.col("source_size") <= F.col("level") * F.col("weight")
    sizes = sizes.withColumn("place", F.row_number().over(order)).withColumn("first_open", F.min(F.when(~full, F.col("place"))).over(every))
    sizes = sizes.withColumn("open_level", F.max(F.when(F.col("place") == F.col("first_open"), F.col("level"))).over(every))
    target = F.when(F.col("first_open").isNull() | (F.col("place") < F.col("first_open")), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("open_level"))
    return sizes.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def _taken(rows: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """``rows`` (safe names) with own_source_size, own_target and own_copies."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    whole = F.floor("own_rate")
    out = rows.join(rates, F.col("source").eqNullSafe(F.col("own_source")), "left")
    return out.withColumn("own_copies", (whole + (u < F.col("own_rate") - whole).cast("bigint")).cast("bigint"))


def _rates(documents: DataFrame, **options) -> DataFrame:
    rates = source_rates(documents, **options).select(F.col("source").alias("own_source"), F.col("source_size").alias("own_source_size"), F.col("target").alias("own_target"), F.col("rate").alias("own_rate"))
    rates = stored(rates, "rates")
    return F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates


def with_copies(documents: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """``documents`` with fl_source_size, fl_target and fl_copies as their last three columns.

    A document is taken floor(rate) times, and once more if the hash of seed and doc_id, as a number
    from 0 to 1, is below the fraction of the rate: the same on every run and every partitioning.

    Null texts have size 0, a null source is a source of its own and comes last, a null doc_id hashes
    as the empty text; rows repeated with one id are taken alike; sources without words are not taken.
    An empty table gives none. Other columns stay as they are, whatever their names.
    """
    rows = safe(documents, "doc_id", "source", "text")
    taken = _taken(rows, _rates(documents, **options), seed).select(*rows.columns, "own_source_size", "own_target", "own_copies")
    return taken.toDF(*documents.columns, "fl_source_size", "fl_target", "fl_copies")


def mix(documents: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixture: each row of ``documents`` as often as :func:`with_copies` says, with its own columns, whatever their names."""
    taken = _taken(safe(documents, "doc_id", "source", "text"), _rates(documents, **options), seed).where("own_copies > 0")
    return restored(taken.withColumn("own_copy", F.explode(F.array_repeat(F.lit(0), F.col("own_copies").cast("int")))), documents, "doc_id", "source", "text")
