"""Names and presentation: consonant keys, similarity, matching, CSV cells, numbers."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folds of a romanised name, in this order.
DIGRAPHS = [("chh", "c"), ("ch", "c"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("ph", "f"), ("bh", "b"), ("rh", "r")]
#: Sequences of a Bengali name, in this order.
SEQUENCES = [("ক্ষ", "ক"), ("্য", ""), ("্ব", ""), ("ড়", "র"), ("ঢ়", "র"), ("য়", "")]
#: Consonants.
CONSONANTS = {
    "ক": "k", "খ": "k", "গ": "g", "ঘ": "g", "ঙ": "ng", "চ": "c", "ছ": "c", "জ": "j", "ঝ": "j", "ঞ": "n", "ট": "t", "ঠ": "t", "ড": "d", "ঢ": "d", "ণ": "n", "ত": "t", "থ": "t", "দ": "d",
    "ধ": "d", "ন": "n", "প": "p", "ফ": "f", "ব": "b", "ভ": "b", "ম": "m", "য": "j", "র": "r", "ল": "l", "শ": "s", "ষ": "s", "স": "s", "হ": "h", "ৎ": "t", "ং": "ng", "ঋ": "r", "ৃ": "r",
}
#: Ends of a title after the unit's name, least scores of a match, Bengali digits.
SUFFIXES = ["ইউনিয়ন পরিষদ", "ইউনিয়ন", "উপজেলা", "জেলা", "বিভাগ"]
LEAST_SCORE, LEAST_MARGIN, LEAST_CHECK = 0.75, 0.15, 0.6
DIGITS = "০১২৩৪৫৬৭৮৯"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; 0 if either is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def spaced(name: Column) -> Column:
    """A blank at each change from a small to a capital letter."""
    return F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " ")


def display_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(spaced(name), "(?<=\\S)\\(", " ("), "\\s+", " "))


def latin_key(name: Column) -> Column:
    """Consonants of a romanised name, without what romanisations disagree about."""
    s = F.regexp_replace(F.regexp_replace(F.lower(spaced(name)), "\\(.*?\\)", " "), "[^a-z]", "")
    for pair, one in DIGRAPHS:
        s = F.replace(s, F.lit(pair), F.lit(one))
    s = F.translate(s, "qzv", "kjb")  # fixed values
    return F.regexp_replace(F.regexp_replace(s, "[aeiouyw]", ""), "(.)\\1+", "$1")


def bengali_key(name: Column) -> Column:
    """Consonants of a Bengali name, comparable with :func:`latin_key`."""
    s = nfc(name)
    for sequence, one in SEQUENCES:
        s = F.replace(s, F.lit(sequence), F.lit(one))
    s = F.regexp_replace(s, "[^" + "".join(CONSONANTS) + "]", "")
    one = {k: v for k, v in CONSONANTS.items() if len(v) == 1}
    s = F.translate(s, "".join(one), "".join(one.values()))
    for k, v in CONSONANTS.items():
        if len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    return F.regexp_replace(s, "(.)\\1+", "$1")


def clean_unit_name(name: Column) -> Column:
    """A unit's bare name of a title: up to a comma, without a suffix and a leading number."""
    s = F.trim(F.split(nfc(name), ",")[0])
    ends = "|".join(unicodedata.normalize("NFC", x) for x in SUFFIXES)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, f"({ends})$", "")), "^[০-৯0-9]+\\s*(নং)?\\s*", ""))


def page_title(page: Column) -> Column:
    """What the title element of a page holds; null without one."""
    return F.nullif(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def title_name(page: Column) -> Column:
    return F.nullif(clean_unit_name(F.element_at(F.split(unescape(page_title(page)), "\\|"), -1)), F.lit(""))


def is_bengali_name(text: Column) -> Column:
    return text.rlike("^[\\u0980-\\u09FF -]+$")


def same_name(a: Column, b: Column) -> Column:
    bare = lambda x: F.regexp_replace(F.translate(nfc(x), "‌‍", ""), "[\\s-]", "")
    return bare(a) == bare(b)


def best_matches(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches names (id, parent, name) to candidates (parent, cand_id, cand, cand_bn) of their parent unit.

    In order: one equal key; one key that differs by the headquarters' suffix; one equal Bengali key;
    the most similar key, if it is similar and ahead enough. Each must read back from Bengali. The join
    is within a parent, and scores are computed once for each pair.
    """
    pairs = names.join(candidates, "parent", "left").withColumn("k", latin_key(F.col("name"))).withColumn("ck", latin_key(F.col("cand"))).withColumn("bk", bengali_key(F.col("cand_bn")))
    pairs = pairs.withColumn("score", similarity("k", "ck")).withColumn("check", similarity("k", "bk"))
    kind = F.when(F.col("ck") == F.col("k"), 0).when((F.col("ck") == F.concat("k", F.lit("sdr"))) | (F.concat("ck", F.lit("sdr")) == F.col("k")), 1).when(F.col("bk") == F.col("k"), 2).otherwise(3)
    of, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("kind", F.desc("score"), "cand_id")
    ranked = pairs.withColumn("kind", kind).withColumn("top", F.min("kind").over(of)).withColumn("n", F.count_if(F.col("kind") == F.col("top")).over(of)).withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    first = ranked.where("rank = 1").withColumn("margin", F.when(F.col("kind") < 3, 1.0).otherwise(F.col("score") - F.coalesce("next", F.lit(0.0))))
    method = (
        F.when(F.col("cand_id").isNull(), "no candidates")
        .when(F.col("kind").isin(0, 2) & (F.col("n") > 1), "ambiguous")
        .when((F.col("kind") == 1) & (F.col("n") > 1), "rejected")
        .when(F.col("check") < LEAST_CHECK, "rejected")
        .when(F.col("kind") == 0, "exact")
        .when(F.col("kind") == 1, "sadar")
        .when(F.col("kind") == 2, "exact-bengali")
        .when((F.col("score") >= LEAST_SCORE) & (F.col("margin") >= LEAST_MARGIN), "fuzzy")
        .otherwise("rejected")
    )
    accepted = F.col("method").isin("exact", "sadar", "exact-bengali", "fuzzy")
    return first.withColumn("method", method).select("id", "parent", "name", "method", F.when(accepted, F.col("cand_id")).alias("cand_id"), F.when(accepted, F.col("cand_bn")).alias("name_bn"), F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), F.round("check", 6).alias("back_check"))


def csv_text(value: Column) -> Column:
    """A text cell: null is empty, formula starts are made text, quoted where needed."""
    safe = F.when(value.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.coalesce(F.when(safe.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe), F.lit(""))


def csv_float(value: Column) -> Column:
    """A number cell of a float column: whole numbers end in .0, missing is empty."""
    return F.when(value.isNull() | F.isnan(value), "").when(value == F.floor(value), F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def csv_document(rows: DataFrame, cells: list[Column], names: list[str], order: list[str]) -> DataFrame:
    """One row with the whole file: mark, header, lines in order, each ended by CR LF. For tables of a page."""
    line = rows.select(F.struct(*order, F.concat_ws(",", *cells).alias("fl_line")).alias("x"))
    body = line.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.fl_line), "\r\n").alias("body"))
    return body.select(F.concat(F.lit("﻿" + ",".join(names) + "\r\n"), "body", F.lit("\r\n")).alias("document"))


def bengali_number(value: Column, decimals: int) -> Column:
    """Bengali digits with separators; a dash for a missing value."""
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.translate(F.format_number(value, decimals), "0123456789", DIGITS))


def roughly(n: Column, step: float) -> Column:
    return F.floor(n / step + 0.5) * step


def match_hierarchy(units: DataFrame, levels: list[tuple[str, DataFrame]], aliases: dict[str, str] | None = None) -> DataFrame:
    """Each unit's names (one column for each level, from the top) matched level by level.

    A level's candidates (parent, cand_id, cand, cand_bn) are those of the unit matched above; parent is
    0 at the top. Below an unmatched level nothing matches. A name is matched once for each parent,
    however many units carry it. ``aliases``: names that changed, as they are now. Adds columns <level>_id and <level>_method.
    """
    if aliases:
        now = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        given = [c for c, _ in levels]
        out = match_hierarchy(units.select("*", *(F.coalesce(F.try_element_at(now, F.col(c)), F.col(c)).alias(f"fl_{c}") for c in given)), [(f"fl_{c}", x) for c, x in levels])
        return out.withColumnsRenamed({f"fl_{c}_{k}": f"{c}_{k}" for c in given for k in ("id", "method")}).drop(*(f"fl_{c}" for c in given))
    out, above = units, F.lit(0)
    for column, candidates in levels:
        names = out.select(above.alias("parent"), F.col(column).alias("name")).distinct().select(F.struct("parent", "name").alias("id"), "parent", "name")
        found = best_matches(names, candidates).select(F.col("parent").alias("fl_parent"), F.col("name").alias("fl_name"), F.col("cand_id").alias(f"{column}_id"), F.col("method").alias(f"{column}_method"))
        out = out.join(found, above.eqNullSafe(F.col("fl_parent")) & F.col(column).eqNullSafe(F.col("fl_name")), "left").drop("fl_parent", "fl_name")
        above = F.col(f"{column}_id")
    return out


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (n, text) of documents put together to paragraphs, which blank lines part."""
    order = Window.partitionBy(*keys).orderBy("n")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    part = lines.withColumn("paragraph", F.count_if(blank).over(order)).where(~blank)
    out = part.groupBy(*keys, "paragraph").agg(F.array_sort(F.collect_list(F.struct("n", F.trim("text").alias("text")))).alias("x"))
    return out.select(*keys, F.get("x", 0).n.alias("n"), F.array_join(F.transform("x", lambda t: t.text), " ").alias("text"))


def word_count(markdown: Column) -> Column:
    """Words of a Markdown text without images and syntax."""
    bare = F.regexp_replace(F.regexp_replace(markdown, "!\\[.*?\\]\\(.*?\\)", " "), "[#*`|>_\\-]", " ")
    return F.regexp_count(bare, F.lit("\\S+"))


def markdown_table(rows: DataFrame, cells: list[Column], names: list[str], order: list[str]) -> DataFrame:
    """One row with a Markdown table: head, rule, rows in order. For tables of a page; null cells are a dash."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c, F.lit("—")) for c in cells)), F.lit(" |"))
    body = rows.select(F.struct(*order, line.alias("fl_line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = [F.lit(f"| {' | '.join(names)} |"), F.lit("|" + "---|" * len(names))]
    return body.select(F.array_join(F.concat(F.array(*head), F.transform("x", lambda x: x.fl_line)), "\n").alias("document"))
