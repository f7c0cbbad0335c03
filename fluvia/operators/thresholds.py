"""Histogram thresholds: land mode, Otsu's cut, calibration of an offset, binary water."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.config import DEFAULTS
from fluvia.storage import beside


def histogram(values: DataFrame, keys: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Rows keys, bin, n, lo, width of equal bins over the range that the values have, clamped to low..high."""
    v = values.select(*keys, F.greatest(F.lit(low), F.least(F.lit(high), F.col("v"))).alias("v")).where("v is not null")
    ends = v.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    joined = beside(v, ends, keys) if keys else v.join(F.broadcast(ends), F.lit(True))  # without keys one row
    number = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), width))).cast("int")
    return joined.groupBy(*keys, "lo", "hi", "total", F.coalesce(number, F.lit(0)).alias("bin")).agg(F.count("*").alias("n")).withColumn("width", width)


def land_mode(values: DataFrame, keys: list[str], low: float, high: float, bins: int = DEFAULTS["mode_bins"], least: int = DEFAULTS["least_values"]) -> DataFrame:
    """The middle of the first fullest bin; no row for fewer than ``least`` values."""
    h = histogram(values, keys, low, high, bins).where(F.col("total") >= least)
    first = h.groupBy(*keys).agg(F.max_by(F.struct("bin", "lo", "width"), F.struct("n", -F.col("bin"))).alias("b"))
    return first.select(*keys, (F.col("b.lo") + (F.col("b.bin") + 0.5) * F.col("b.width")).alias("mode"))


def otsu(values: DataFrame, keys: list[str], low: float, high: float, bins: int = DEFAULTS["otsu_bins"], least: int = DEFAULTS["least_values"]) -> DataFrame:
    """The bin centre that separates best; no row for few values or a spread below 0.001.

    Running sums over at most ``bins`` rows for each key.
    """
    h = histogram(values, keys, low, high, bins).where((F.col("total") >= least) & (F.col("hi") - F.col("lo") >= 1e-3))
    h = h.withColumn("center", F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    h = h.withColumn("w0", F.sum("n").over(below)).withColumn("s0", F.sum(F.col("n") * F.col("center")).over(below)).withColumn("s", F.sum(F.col("n") * F.col("center")).over(every))
    w1 = F.col("total") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), w1), 2))
    return h.withColumn("between", F.round(between, 6)).where("between is not null").groupBy(*keys).agg(F.max_by("center", F.struct("between", -F.col("bin"))).alias("cut"))


def water_fraction(pixels: DataFrame, keys: list[str], cut) -> DataFrame:
    """The share of all pixels above the cut; a missing value isn't above it and counts below the line."""
    return pixels.groupBy(*keys).agg(F.avg(F.coalesce(F.col("v") > cut, F.lit(False)).cast("double")).alias("fraction"))


def calibrate(pixels: DataFrame, modes: DataFrame, reference: float, low: float = -0.10, high: float = 0.45, step: float = 0.005) -> DataFrame:
    """For each family the first offset to the mode whose median water fraction over months is nearest to ``reference``.

    pixels: family, month, v; modes: family, mode. Each value is compared with all offsets at once by the
    number of offsets below it: a running count over offsets replaces a row for each value and offset.
    """
    n = round((high - low) / step)
    levels = F.floor((F.col("v") - F.col("mode") - low) / step + 1e-9)
    above = F.when(F.col("v").isNull(), -1).otherwise(F.least(F.lit(n - 1), F.greatest(F.lit(-1), F.when((F.col("v") - F.col("mode") - low) / step > levels + 1e-6, levels).otherwise(levels - 1)))).cast("int")
    counts = beside(pixels, modes, ["family"]).groupBy("family", "month", above.alias("k")).agg(F.count("*").alias("n"))
    grid = counts.select("family", "month").distinct().withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    full = grid.join(counts, ["family", "month", "k"], "left").fillna(0, ["n"])
    order = Window.partitionBy("family", "month").orderBy(F.desc("k"))
    full = full.withColumn("over", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("family", "month"))).where("k >= 0")
    gaps = full.groupBy("family", "k").agg(F.abs(F.median(F.col("over") / F.col("total")) - reference).alias("gap"))
    best = gaps.groupBy("family").agg(F.min_by("k", F.struct(F.round("gap", 9), "k")).alias("k"), F.round(F.min("gap"), 6).alias("gap"))
    return best.select("family", F.round(F.lit(low) + F.col("k") * step, 6).alias("delta"), "gap")


def calibrated_offset(pixels: DataFrame, modes: DataFrame, low: float, high: float, months: int = 60, every: int = 17, default: float = 0.15) -> DataFrame:
    """One row: Otsu's cut of a sample of pixels, less the median of the months' land modes; ``default`` without a cut.

    pixels: month, cell, v; modes: month, mode. The sample has at most ``months`` months, in the order of a
    hash, and of each the cells whose number divides by ``every``: sampling is what the calibration is.
    """
    some = modes.select("month").distinct().orderBy(F.xxhash64("month"), "month").limit(months)
    pooled = pixels.where(F.col("cell") % every == 0).join(some, "month", "left_semi").select("v")
    cut = otsu(pooled, [], low, high).agg(F.max("cut").alias("cut"))
    middle = modes.agg(F.median("mode").alias("middle"))
    return cut.join(middle, F.lit(True)).select(F.round(F.coalesce(F.col("cut") - F.col("middle"), F.lit(default)), 6).alias("offset"))


def best_cut(sweep: DataFrame) -> DataFrame:
    """The row of a sweep with the best F1, the first of equal ones."""
    best = sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("f1", -F.col("cut"))).alias("x"))
    return best.select("x.*")


def monthly_levels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Median and mean over months of the months' own mean values."""
    months = pixels.groupBy(*keys, "month").agg(F.avg("v").alias("v"))
    return months.groupBy(*keys).agg(F.round(F.median("v"), 6).alias("median"), F.round(F.avg("v"), 6).alias("mean"))


def binary_water(pixels: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """1 above the key's cut, 0 else; missing is 0."""
    return beside(pixels, cuts, keys, "left").withColumn("water", F.coalesce(F.col("v") > F.col("cut"), F.lit(False)).cast("int"))


def cut_sweep(scored: DataFrame, cuts: list[float], times: str | None = None) -> DataFrame:
    """Pooled counts for each cut in one pass over the rows: prob, truth; then precision, recall, F1. A row counts as
    often as ``times`` says, if that is given."""
    count = lambda x: F.coalesce(F.sum(F.when(x, F.col(times))), F.lit(0)) if times else F.count_if(x)
    hits = lambda c: (F.col("prob") > c, F.col("truth") == 1)
    made = []
    for k, c in enumerate(cuts):
        p, t = hits(c)
        made += [count(p & t).alias(f"tp{k}"), count(p & ~t).alias(f"fp{k}"), count(~p & t).alias(f"fn{k}")]
    one = scored.agg(*made)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn")) for k, c in enumerate(cuts)])).alias("x")).select("x.*")
    return with_f1(rows)


def with_f1(counts: DataFrame) -> DataFrame:
    """IoU (null without any), precision, recall and F1 (0 without any) from pooled counts."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("iou", F.round(F.try_divide(tp.cast("double"), tp + fp + fn), 6)).withColumn("precision", F.round(ratio(tp, tp + fp), 6)).withColumn("recall", F.round(ratio(tp, tp + fn), 6)).withColumn("f1", F.round(ratio(2 * tp, 2 * tp + fp + fn), 6))


def error_area(rows: DataFrame, keys: list[str], cut: float, cell_ha: float) -> DataFrame:
    """Hectares of change that the forecast (prob above the cut) hits, invents and misses against truth (0 or 1)."""
    p, t = F.col("prob") > cut, F.col("truth") == 1
    ha = lambda which, name: F.round(F.count_if(which) * cell_ha, 6).alias(name)
    return rows.groupBy(*keys).agg(ha(p & t, "hit_ha"), ha(p & ~t, "false_ha"), ha(~p & t, "missed_ha"))
