"""Exact dedup by progressive refinement: length, then a prefix hash, then a full hash of the survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.llm.common import lower_ascii, safe, stored

#: Code points of the text that the second step hashes.
PREFIX = 64
#: What one step tells the next is a set of numbers below this, so a broadcast of at most so many rows
#: (of 4 bytes each) whatever the data. Beyond some millions of groups it lets more rows through, none less.
BUCKETS = 1 << 20


def _survivors(groups: DataFrame, key: Column, name: str) -> DataFrame:
    """The buckets of the keys that occur twice, to be broadcast; used once, so nothing is written."""
    return F.broadcast(groups.where("n > 1").select(_bucket(key).alias(name)).distinct())


def _bucket(key: Column) -> Column:
    return F.pmod(key, F.lit(BUCKETS)).cast("int")


def exact_groups(documents: DataFrame, digest_all: bool = False) -> DataFrame:
    """Groups of rows whose text is identical after lower-casing A-Z.

    1. count rows for each byte length; 2. of rows whose length occurs twice, count rows for each
    (length, hash of the first 64 code points); 3. hash in full only the texts whose pair occurs
    twice, and group by that hash. Each step takes from the one before a broadcast set of at most
    2^20 buckets of the keys that survived, so rows are told apart where they are read: no text
    is shuffled, and a row that a bucket lets through by chance is alone after step 3. Counts are
    combined before the shuffle, so that a length or a text of very many rows costs one row for each
    task; the last join is on the full hash and can be split when a group is large.

    Returns a row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (null for a text
    that step 2 showed to be alone, unless ``digest_all``).

    Null texts count as empty; empty texts are equal. Of equal texts the largest doc_id stays (a null
    id is smallest); of rows repeated with the same id, exactly one stays. An empty table gives an
    empty result. Other columns, whatever their names, are ignored.
    """
    documents = safe(documents, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    sized = documents.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("len"))
    lengths = _survivors(sized.groupBy("len").agg(F.count("*").alias("n")), F.col("len"), "length_bucket")
    prefix = F.xxhash64(lower_ascii(F.substring("text", 1, PREFIX)))
    pairs = sized.select("len", _bucket(F.col("len")).alias("at"), "text").join(lengths, F.col("at") == F.col("length_bucket"), "left_semi").select("len", prefix.alias("prefix"))
    pairs = _survivors(pairs.groupBy("len", "prefix").agg(F.count("*").alias("n")), F.xxhash64("len", "prefix"), "pair_bucket")
    alive = F.col("pair_bucket").isNotNull()
    digest = F.sha2(lower_ascii(F.col("text")), 256)
    full = sized.withColumn("at", _bucket(F.xxhash64("len", prefix))).join(pairs, F.col("at") == F.col("pair_bucket"), "left")
    full = full.select("doc_id", "len", alive.alias("alive"), (digest if digest_all else F.when(alive, digest)).alias("sha"))
    full = stored(full.withColumn("row", F.monotonically_increasing_id()), "full-hashes")
    groups = full.where("alive").groupBy("len", "sha").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top")).where("n > 1")
    groups = stored(groups.select(F.col("len").alias("g_len"), F.col("sha").alias("g_sha"), "n", "top"), "groups")  # read back, so that the join has an exchange on either side and a large group can be split
    out = full.join(groups, (F.col("len") == F.col("g_len")) & (F.col("sha") == F.col("g_sha")), "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
