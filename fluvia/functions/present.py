"""Presentation: names by language, numbers in two languages, bars, cards, file names and the table's small rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.text import DIGITS, latin_key, nfc, spaced

#: Names of months, and the sort collations, in the two languages.
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "bn": ("জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর"),
}
COLLATIONS = {"en": "en_CI_AI", "bn": "bn_CI_AI"}
#: The word for a municipality, and the ending of a headquarters' name.
MUNICIPALITY, HEADQUARTERS = "পৌরসভা", "সদর"


def place_name(own: Column, bengali: Column, lang: str) -> Column:
    """The Bengali name on the Bengali page where there is one, or else the name as displayed."""
    return F.coalesce(bengali, own) if lang == "bn" else own


def fold(text: Column) -> Column:
    """Composed (NFC) and in lower case, so that what is typed matches what is stored."""
    return F.lower(nfc(text))


def by_name(name: Column, lang: str, ascending: bool = True) -> Column:
    """Sort order of a language, without regard to case and accents."""
    key = F.collate(name, COLLATIONS[lang])
    return key.asc_nulls_last() if ascending else key.desc_nulls_last()


def _digits(text: Column, lang: str) -> Column:
    return F.translate(text, "0123456789", DIGITS) if lang == "bn" else text


def half_up(n: Column) -> Column:
    """Rounded to a whole number, halves upwards; never minus zero."""
    return F.floor(n + 0.5).cast("bigint")


def whole(n: Column, lang: str) -> Column:
    """A whole number with separators: thousands, or on the Bengali page hundreds after the first thousand."""
    value = half_up(n)
    text = F.abs(value).cast("string")
    pairs = "(\\d{2})*\\d{3}" if lang == "bn" else "(\\d{3})+"
    text = F.regexp_replace(text, f"(?<=\\d)(?={pairs}$)", ",")
    return _digits(F.concat(F.when(value < 0, "-").otherwise(""), text), lang)


def hectares(n: Column, lang: str) -> Column:
    """Whole hectares, but less than one where a real area rounds to nothing."""
    return F.when((n > 0) & (n < 0.5), F.concat(F.lit("<"), whole(F.lit(1), lang))).otherwise(whole(n, lang))


def signed(n: Column, lang: str) -> Column:
    return F.concat(F.when(half_up(n) > 0, "+").otherwise(""), whole(n, lang))


def decimal(n: Column, lang: str) -> Column:
    """One decimal at most."""
    tenths = F.floor(F.abs(n) * 10 + 0.5).cast("bigint")
    head = whole(F.floor(tenths / 10), lang)
    tail = F.when(tenths % 10 > 0, F.concat(F.lit("."), _digits((tenths % 10).cast("string"), lang))).otherwise("")
    return F.concat(F.when((n < 0) & (tenths > 0), "-").otherwise(""), head, tail)


def density(n: Column, lang: str) -> Column:
    """One decimal below 10, whole above, and less than 0.1 where something rounds to nothing."""
    return F.when((n > 0) & (n < 0.05), F.concat(F.lit("<"), decimal(F.lit(0.1), lang))).when(n < 10, decimal(n, lang)).otherwise(whole(n, lang))


def percent(share: Column, lang: str) -> Column:
    """A whole percentage; what lies beyond nine decimals is the noise of a division, and takes no half down."""
    return F.concat(whole(F.round(share * 100, 9), lang), F.lit("%"))


def year(n: Column, lang: str) -> Column:
    return _digits(n.cast("int").cast("string"), lang)


def month_name(key: Column, lang: str) -> Column:
    """A month key in words."""
    names = F.array(*map(F.lit, MONTHS[lang]))
    return F.concat_ws(" ", F.try_element_at(names, F.substring(key, 6, 2).cast("int")), _digits(F.substring(key, 1, 4), lang))


def fractional_year(key: Column) -> Column:
    return F.substring(key, 1, 4).cast("int") + (F.substring(key, 6, 2).cast("int") - 1) / 12


def test_period(split: Column, lang: str) -> Column:
    """The years of a split's label with a dash between; the label itself without two years."""
    first, last = (F.regexp_extract(split, "(\\d{4})\\D+(\\d{4})", k) for k in (1, 2))
    return F.when(first != "", F.concat(_digits(first, lang), F.lit("–"), _digits(last, lang))).otherwise(split)


def file_name(month: Column, district: Column, stem: str) -> Column:
    """Name of a filtered download: what isn't a letter, digit or hyphen becomes an underscore."""
    return F.concat_ws("_", F.lit(stem), month, F.when(district != "", F.regexp_replace(district, "[^A-Za-z0-9-]+", "_")), F.lit("filtered.csv"))


def bar_share(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with bar: a value's percentage of the whole table's largest, 2 at least where there is any.

    The largest is one aggregate of the table, not a window over all of it in one task."""
    most = rows.agg(F.max(value).alias("fl_most"))
    share = F.when(F.col("fl_most") > 0, 100 * F.col(value) / F.col("fl_most")).otherwise(0.0)
    return rows.join(F.broadcast(most), F.lit(True)).withColumn("bar", F.greatest(share, F.when(F.col(value) > 0, 2.0).otherwise(0.0))).drop("fl_most")


def is_filtered(district: Column, query: Column, least: Column) -> Column:
    """Whether a table's state filters; its order doesn't count."""
    return (district != "") | (F.trim(query) != "") | (least > 0)


def toggled(sort: Column, direction: Column, key: Column) -> tuple[Column, Column]:
    """Sort key and direction after a click on a column: the same one turns round, names begin ascending, numbers descending."""
    turned = F.when(direction == "asc", "desc").otherwise("asc")
    return key, F.when(key == sort, turned).otherwise(F.when(key == "union", "asc").otherwise("desc"))


def zones_in_view(zones: DataFrame, units: DataFrame | None) -> DataFrame:
    """Zones of the units in view; all of them, those outside every unit too, if nothing is filtered."""
    return zones if units is None else zones.join(units, "unit", "left_semi")


def selected(rows: DataFrame, districts: list[str], least: float) -> DataFrame:
    """Rows of some districts, of all if none is named, from a least erosion on."""
    out = rows.where(F.col("erosion_ha") >= least)
    return out.where(F.col("district").isin(districts)) if districts else out


def restricted(rows: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Rows of the listed units only."""
    return rows.join(units.select(key).distinct(), key, "left_semi")


def unit_cells(unmapped: Column, buildings: Column, households: Column, density_: Column, level: Column, lang: str = "en", none: str = "none mapped", unknown: str = "unknown") -> dict[str, Column]:
    """What a table's row shows for buildings, households and mapping: unknown is said, never shown as 0."""
    return {
        "buildings_shown": F.when(unmapped, none).otherwise(whole(buildings, lang)),
        "households_shown": F.when(unmapped, unknown).otherwise(whole(households, lang)),
        "mapping_shown": F.when(density_.isNull(), level).otherwise(F.concat(level, F.lit(" "), density(density_, lang))),
    }


def zone_cards(zones: DataFrame, units: DataFrame, lang: str = "en", outside: str = "outside", unknown: str = "unknown") -> DataFrame:
    """The card of each zone (zone, unit, kind, ha): area, kind, place, and its unit's totals; zones outside every
    unit, or of a unit that isn't in the table (gid, name, erosion_ha, households_est, unmapped), say so."""
    rows = zones.join(units, F.col("unit") == F.col("gid"), "left")
    known = F.col("gid").isNotNull()
    households = F.when(F.col("unmapped"), unknown).otherwise(whole(F.col("households_est"), lang))
    return rows.select("zone", F.concat(hectares(F.col("ha"), lang), F.lit(" ha")).alias("value"), "kind", F.when(known, F.col("name")).otherwise(outside).alias("place"), F.when(known, F.concat_ws(" / ", whole(F.col("erosion_ha"), lang), households)).alias("totals"))


def municipality_of(union: Column, upazila: Column, district: Column) -> Column:
    """Which unit a municipality is named after: ``upazila``, ``district``, empty for a bare name; null if neither."""
    prefix = F.trim(F.regexp_replace(spaced(union), "\\s*Paurashava$", ""))
    same = lambda unit: latin_key(prefix).isin(latin_key(unit), F.regexp_replace(latin_key(unit), "sdr$", ""))
    return F.when(prefix == "", "").when(F.coalesce(same(upazila), F.lit(False)), "upazila").when(F.coalesce(same(district), F.lit(False)), "district")


def municipality_name(of: Column, upazila_bn: Column, district_bn: Column) -> Column:
    """A municipality's Bengali name: its parent's, without the headquarters' ending, and the word; null if the parent has none."""
    parent = F.when(of == "upazila", upazila_bn).when(of == "district", district_bn)
    stem = F.trim(F.regexp_replace(nfc(parent), f"\\s*{HEADQUARTERS}$", ""))
    return F.when(of == "", MUNICIPALITY).when(F.coalesce(parent, F.lit("")) != "", F.trim(F.concat_ws(" ", stem, F.lit(MUNICIPALITY))))


def ranked_models(runs: DataFrame, metric: str, larger_is_better: bool) -> DataFrame:
    """Run records with rank, the best by a metric first; missing values last, ties by model."""
    order = F.col(metric).desc_nulls_last() if larger_is_better else F.col(metric).asc_nulls_last()
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "model")))
