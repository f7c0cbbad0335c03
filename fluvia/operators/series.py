"""Scenes to monthly composites, and series of them: search, median, gap fill, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.config import DEFAULTS
from fluvia.operators.order import placed


def search(scenes: DataFrame, most_cloud: float, keep_unknown: bool = True) -> DataFrame:
    """Scenes below a cloud cover. A missing cover is kept, or dropped as by a server-side comparison."""
    fits = F.col("cloud") < most_cloud
    return scenes.where(F.col("cloud").isNull() | fits if keep_unknown else fits).where(F.col("month").isNotNull())


def search_year(collections: list[DataFrame], box: tuple, year: int, most_cloud: float, keep_unknown: bool = True) -> DataFrame:
    """Scenes (at, cloud, west, south, east, north) of all collections in a year that touch a box, below a cloud
    cover, with their month; scenes whose time can't be read are dropped."""
    every = collections[0]
    for more in collections[1:]:
        every = every.unionByName(more)
    west, south, east, north = box
    every = every.withColumn("month", F.date_format(F.expr("try_cast(at AS timestamp)"), "yyyy-MM")).where(F.col("month").startswith(f"{year:04d}-"))
    return search(every.where((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north)), most_cloud, keep_unknown)


def usable_scenes(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The share of valid pixels of each scene, to four decimals; scenes without a valid pixel are dropped."""
    return pixels.groupBy(*keys).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("share")).where("share > 0").withColumn("share", F.round("share", 4))


def least_cloudy(scenes: DataFrame, most: int, keys: list[str], tie: str) -> DataFrame:
    """The ``most`` least cloudy scenes of each group, a missing cover last, ties by ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("cloud", F.lit(101.0)), tie)
    return scenes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def composite(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The median of the valid values of each pixel and month, and their number. NaN is missing."""
    valid = F.when(~F.isnan(value), F.col(value))
    return pixels.groupBy(*keys).agg(F.median(valid).alias("v"), F.count(valid).alias("n_obs"))


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done, keys, "left_anti")


def calendar_stack(series: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Every key at every time from ``first`` to ``last``; missing values are null, counts are 0 to 255."""
    every = series.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return every.join(series, [*keys, "t"], "left").withColumn("n_obs", F.least(F.lit(255), F.coalesce("n_obs", F.lit(0))).cast("int"))


def gap_fill(series: DataFrame, keys: list[str], max_gap: int = DEFAULTS["max_gap"]) -> DataFrame:
    """Fills gaps of at most ``max_gap`` steps: inner ones by a line, those at the ends by the nearest value.

    Two running windows over one partitioning give the valid neighbours; no self-join. The one ahead runs from
    the far end: a frame up to the last row would be read anew for each row.
    """
    running = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = running(F.asc("t")), running(F.desc("t"))
    at = F.when(F.col("v").isNotNull(), F.col("t"))
    out = series.select("*", F.last(at, True).over(back).alias("t0"), F.last("v", True).over(back).alias("v0"), F.last(at, True).over(ahead).alias("t1"), F.last("v", True).over(ahead).alias("v1"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    filled = (
        F.when(F.col("v").isNotNull(), F.col("v"))
        .when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), F.when(F.col("t1") - F.col("t0") - 1 <= max_gap, line))
        .when(F.col("t0").isNotNull() & (F.col("t") - F.col("t0") <= max_gap), F.col("v0"))
        .when(F.col("t1").isNotNull() & (F.col("t1") - F.col("t") <= max_gap), F.col("v1"))
    )
    return out.withColumn("filled", filled).withColumn("was_filled", F.col("v").isNull() & F.col("filled").isNotNull()).drop("t0", "t1", "v0", "v1")


def smooth(series: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """Extension: centred running median over 2 k + 1 steps."""
    near = F.array_sort(F.collect_list("v").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(-k, k)))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    return series.withColumn("near", near).withColumn("smoothed", middle(F.col("near"))).drop("near")


def split_of(year, train_end: int = DEFAULTS["train_end"], val_end: int = DEFAULTS["val_end"]):
    return F.when(year <= train_end, "train").when(year <= val_end, "val").otherwise("test")


def sliding_windows(coverage: DataFrame, span: int, targets: int, least: float, stride: int = 1) -> DataFrame:
    """Window starts of each tile whose last ``targets`` frames are observed well enough.

    coverage: tile, t, observed (a fraction), gap-free in t.
    """
    order = Window.partitionBy("tile").orderBy("t")
    aim = order.rowsBetween(span - targets, span - 1)
    out = coverage.select("tile", "t", F.avg("observed").over(aim).alias("target_observed"), F.count("*").over(order.rowsBetween(0, span - 1)).alias("n"), F.min("t").over(Window.partitionBy("tile")).alias("first"))
    return out.where((F.col("n") == span) & (F.col("target_observed") >= least) & ((F.col("t") - F.col("first")) % stride == 0)).select("tile", F.col("t").alias("t0"), "target_observed")


def even_subsample(windows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """``most`` windows spread evenly: the k-th is number floor(k * n / most)."""
    numbered = placed(windows.orderBy(*order)).withColumn("i", F.col("place").cast("bigint") - 1).drop("place")
    numbered = numbered.join(F.broadcast(numbered.agg(F.count("*").alias("n"))), F.lit(True))
    # Row i is picked if some k has floor(k * n / most) = i.
    k = F.ceil(F.col("i") * most / F.col("n"))
    return numbered.where((F.col("n") <= most) | ((k < most) & (F.floor(k * F.col("n") / most) == F.col("i")))).drop("i", "n")


def rows_without(series: DataFrame, key: str, value: str) -> DataFrame:
    """Keys, such as years, whose values sum to 0."""
    return series.groupBy(key).agg(F.sum(value).alias("total")).where("total = 0").select(key)


def totals(pieces: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and number of pieces, by tile and kind or other keys."""
    return pieces.groupBy(*keys).agg(F.round(F.sum(value), 4).alias(value), F.count("*").alias("n"))


def persistence(series: DataFrame, keys: list[str], steps: int = DEFAULTS["out_frames"], scale: float = DEFAULTS["logit_scale"]) -> DataFrame:
    """The last frame, repeated for each step ahead, as a probability."""
    last = series.groupBy(*keys).agg(F.max_by("water", "t").alias("water"), F.max("t").alias("t"))
    prob = 1 / (1 + F.exp(-(F.col("water") * 2 - 1) * scale))
    return last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("prob", prob)


def anchors(coverage: DataFrame, least: float, before: int) -> DataFrame:
    """The last month of each tile with more than ``least`` usable and ``before`` months before it."""
    return coverage.groupBy("tile").agg(F.max(F.when(F.col("usable") > least, F.col("t"))).alias("anchor"), F.min("t").alias("first")).where(F.col("anchor") - F.col("first") >= before).select("tile", "anchor")


def seasonal_reference(series: DataFrame, anchors_: DataFrame, keys: list[str], h: int, season: int) -> DataFrame:
    """For each key the value a season before the step ahead, or else that at the anchor."""
    at = series.join(anchors_, "tile")
    return at.groupBy(*keys).agg(
        F.max(F.when(F.col("t") == F.col("anchor") + h - season, F.col("water"))).alias("seasonal"),
        F.max(F.when(F.col("t") == F.col("anchor"), F.col("water"))).alias("latest"),
    ).withColumn("reference", F.coalesce("seasonal", "latest"))
