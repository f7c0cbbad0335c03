"""Sources of places: buildings by cell, units, gazetteer and page titles, and sinks of map layers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.functions.text import clean_unit_name
from fluvia.sources.tables import one_file

ELEMENTS = "elements array<struct<type string, id bigint, lat double, lon double, center struct<lat double, lon double>, tags map<string, string>>>"
LAYER = "type string, features array<struct<type string, properties map<string, string>, geometry struct<type string, coordinates string>>>"
#: What a unit layer's attributes are called here.
UNIT_COLUMNS = {"NAME_1": "division", "NAME_2": "district", "NAME_3": "upazila", "NAME_4": "union", "GID_4": "gid_union"}


def element_points(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Points (osm_id, osm_type, building, lon, lat) of responses, one JSON document a row, beside its other columns.

    An element's centre counts, or else its own position; without either it is dropped. A building without
    a kind is ``yes``.
    """
    others = [c for c in responses.columns if c != payload]
    each = responses.select(*others, F.explode(F.from_json(payload, ELEMENTS).elements).alias("e"))
    at = lambda k: F.when(F.col("e.center").isNotNull(), F.col(f"e.center.{k}")).otherwise(F.col(f"e.{k}"))
    kind = F.coalesce(F.try_element_at("e.tags", F.lit("building")), F.lit("yes"))
    return each.select(*others, F.col("e.id").alias("osm_id"), F.col("e.type").alias("osm_type"), kind.alias("building"), at("lon").alias("lon"), at("lat").alias("lat")).where("lat is not null")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in an order, as one aggregation that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest)).select(rows.columns)


def buildings(responses: DataFrame) -> DataFrame:
    """Buildings of all cells' responses (cell, payload), once each: cells share edges, the first cell's counts."""
    return keep_first(element_points(responses), ["osm_type", "osm_id"], ["cell"])


def read_gazetteer(spark: SparkSession, path: str, columns: list[str], name: str = "bn_name") -> DataFrame:
    """A file without a header in which everything is text: nothing is read as missing, empty stays empty."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    rows = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))
    return rows.withColumn(name, clean_unit_name(F.col(name))) if name in columns else rows


def titles_to_ask(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Domains that aren't cached yet, once each; empty ones aren't asked."""
    return wanted.where("domain <> ''").select("domain").distinct().join(cache, "domain", "left_anti")


def cacheable(titles: DataFrame) -> DataFrame:
    """Titles (domain, name) that may be cached: those with a Bengali letter. The others are asked again."""
    return titles.where(F.col("name").rlike("[\\u0980-\\u09FF]"))


def feature(kind: Column, ha: Column, unit: Column, rings: Column, digits: int = 5) -> Column:
    """A map feature as compact JSON: kind as one letter, area to a tenth, the unit or null, rounded corners.
    Halves of a tenth go away from zero; what lies beyond nine decimals is taken for the noise of a division and decides none."""
    corners = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(p, lambda x: F.round(x, digits))))
    properties = F.struct(F.when(kind == "erosion", "e").when(kind == "accretion", "a").alias("k"), F.round(F.round(ha, 9), 1).alias("ha"), unit.alias("u"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), corners.alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def write_layer(features: DataFrame, path: str, order: str, value: str = "feature") -> None:
    """Writes features (JSON texts) as one GeoJSON collection in the order of a unique key."""
    first = features.agg(F.min(order)).first()[0]
    line = F.concat(F.when(F.col(order) == F.lit(first), "").otherwise(","), F.col(value))
    one_file(features.select(F.col(order).alias("place"), line.alias("value")), path, head='{"type":"FeatureCollection","features":[', foot="]}")


def features_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """Features (properties, kind, coordinates) of GeoJSON documents, one a row."""
    each = documents.select(F.explode(F.from_json(text, LAYER).features).alias("f"))
    return each.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.from_json("f.geometry.coordinates", "array<array<array<double>>>").alias("coordinates"))


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return features_of(spark.read.text(path, wholetext=True))


@F.pandas_udf(T.StringType())
def unzipped(content: pd.Series) -> pd.Series:
    """The text of the first JSON file in each archive."""

    def one(data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.read(next(n for n in archive.namelist() if n.endswith(".json"))).decode()

    return content.map(one)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of a zipped GeoJSON layer: their known attributes under the names used here, and their rings.
    An archive is one file, so it is one task's work."""
    rows = features_of(spark.read.format("binaryFile").load(path).select(unzipped("content").alias("value")))
    return rows.select(*(F.try_element_at("properties", F.lit(k)).alias(v) for k, v in UNIT_COLUMNS.items()), "coordinates")
