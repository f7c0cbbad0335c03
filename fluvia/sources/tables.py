"""The hand-off table: its writer, its strict reader, and the files beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions.text import csv_float, csv_text
from fluvia.operators.risk import require
from fluvia.storage import remove

#: Columns of the hand-off table, in their order, with their types.
HANDOFF = {
    "forecast_month": "string", "division": "string", "district": "string", "upazila": "string", "union": "string", "gid_union": "string",
    "erosion_ha": "double", "buildings_osm": "int", "accretion_ha": "double", "net_land_change_ha": "double", "households_est": "int", "persons_est": "int",
    "osm_completeness_assumed": "double", "osm_buildings_per_km2": "double", "osm_measured_km2": "double", "osm_mapping": "string",
    "division_bn": "string", "district_bn": "string", "upazila_bn": "string", "union_bn": "string",
}
#: Columns that may be empty, and the mapping levels.
NULLABLE = ("osm_buildings_per_km2", "division_bn", "district_bn", "upazila_bn", "union_bn")
LEVELS = ("low", "medium", "high", "not measured")
#: Order of the models in reports; others come last.
MODELS = ("timesformer", "convlstm", "persistence")
MARK = "\ufeff"


def month_of(name: Column) -> Column:
    """The month in a file's name; null without one."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), "(\\d{4}-\\d{2})", 1), F.lit(""))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Rows path of the files of a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")


def newest(names: DataFrame, name: str = "path") -> DataFrame:
    """One row: the name with the latest month in it, ties by name; names without a month don't count."""
    known = names.select(F.col(name).alias("name"), month_of(F.col(name)).alias("month")).where("month is not null")
    return known.agg(F.max(F.struct("month", "name")).alias("top")).where("top is not null").select("top.name", "top.month")


def last_named(names: DataFrame, prefix: str, name: str = "path") -> DataFrame:
    """One row: the last name, in their order, that begins with ``prefix``."""
    bare = F.element_at(F.split(F.col(name), "/"), -1)
    return names.where(bare.startswith(prefix)).agg(F.max(bare).alias("name")).where("name is not null")


def write_handoff(rows: DataFrame, path: str, month: str, order: list) -> None:
    """Writes the table as one CSV file: mark, header, the month before the other columns, lines ended by CR LF."""
    rows = rows.withColumn("forecast_month", F.lit(month))
    cell = {"string": csv_text, "double": csv_float, "int": lambda c: F.coalesce(c.cast("string"), F.lit(""))}
    line = F.concat_ws(",", *(cell[kind](F.col(f"`{c}`").cast(kind)) for c, kind in HANDOFF.items()))
    one_file(rows.select(F.struct(*order).alias("place"), line.alias("value")), path, head=MARK + ",".join(HANDOFF), line_end="\r\n")


def one_file(lines: DataFrame, path: str, head: str | None = None, foot: str | None = None, line_end: str = "\n") -> None:
    """Writes lines (place, value) as one text file in the order of place, between a first and a last line. One
    file is one task's work, which sorts with spilling: for what people read, not for data."""
    rows = lines.select(F.lit(1).alias("part"), "place", "value")
    for part, text in ((0, head), (2, foot)):
        if text is not None:
            edge = lines.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(None).cast(lines.schema["place"].dataType).alias("place"), F.lit(text).alias("value"))
            rows = rows.union(edge)
    rows.coalesce(1).sortWithinPartitions("part", "place").select("value").write.option("lineSep", line_end).text(path)


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """The table of :func:`write_handoff`. Columns have to be those of HANDOFF, in their order; a cell that
    isn't of its column's type fails the read. Empty cells are null."""
    first = spark.read.option("lineSep", "\r\n").text(path).first()
    names = first.value.removeprefix(MARK).split(",") if first else []
    if missing := [c for c in HANDOFF if c not in names]:
        raise ValueError(f"missing columns {missing}")
    if names != list(HANDOFF):
        raise ValueError(f"columns in another order: {names}")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in HANDOFF.items())
    return spark.read.schema(schema).options(header=True, enforceSchema=True, mode="FAILFAST", lineSep="\r\n", escape='"').csv(path)


def handoff_checks(rows: DataFrame, month: str) -> DataFrame:
    """One row: how many rows break each rule of the table, all counted in one pass."""
    required = [c for c in HANDOFF if c not in NULLABLE]
    density, level = F.col("osm_buildings_per_km2"), F.col("osm_mapping")
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in required]
    counts += [
        F.count_if(~level.isin(*LEVELS)).alias("unknown_mapping"),
        F.count_if(density.isNull() == (level != "not measured")).alias("density_given_wrongly"),
        F.count_if(density < 0).alias("negative_density"),
        (F.count("gid_union") - F.count_distinct("gid_union")).alias("repeated_unit"),
        F.count_if((F.col("buildings_osm") < 0) | (F.col("households_est") < 0) | (F.col("persons_est") < 0)).alias("negative_count"),
        F.count_if(F.col("forecast_month") != month).alias("other_month"),
    ]
    for c, kind in HANDOFF.items():
        if kind == "double" and c not in NULLABLE:
            counts.append(F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"nonfinite_{c}"))
    return rows.agg(*counts)


def publish(spark: SparkSession, source: str, out: str, month: str) -> str:
    """Checks a hand-off table, writes it and a summary under ``out``, and removes those of other months."""
    rows = read_handoff(spark, source)
    require(handoff_checks(rows, month))
    name = f"at_risk_{month}"
    for stem in ("at_risk_", "summary_"):
        remove(spark, f"{out}/{stem}*")
    write_handoff(rows, f"{out}/{name}", month, ["gid_union"])
    summary = rows.agg(F.lit(month).alias("month"), F.count("*").alias("rows"), F.round(F.sum("erosion_ha"), 4).alias("erosion_ha"), F.sum("households_est").alias("households"))
    one_file(summary.select(F.lit(0).alias("place"), F.to_json(F.struct("*")).alias("value")), f"{out}/summary_{month}")
    return f"{out}/{name}"


def payload_checks(payload: DataFrame) -> DataFrame:
    """Which rules each payload (table_month, summary_month, bands, model, metrics_model, rows_said, rows_there,
    schema, schema_read, box) breaks, as booleans."""
    return payload.select(
        "*",
        (~F.col("summary_month").eqNullSafe(F.col("table_month"))).alias("other_month"),
        F.coalesce(F.size("bands") == 0, F.lit(True)).alias("no_bands"),
        (~F.col("metrics_model").eqNullSafe(F.col("model"))).alias("other_model"),
        (~F.col("schema").eqNullSafe(F.col("schema_read"))).alias("other_schema"),
        (F.coalesce("rows_there", F.lit(0)) == 0).alias("no_rows"),
        (~F.col("rows_said").eqNullSafe(F.col("rows_there"))).alias("other_row_count"),
        (~F.coalesce(F.size("box") == 4, F.lit(False))).alias("no_map"),
    )


def zone_checks(zones: DataFrame, units: DataFrame) -> DataFrame:
    """One row: zones of an unknown kind, zones in another reference system, and units that zones name and the table lacks."""
    stray = zones.where("gid_union is not null").join(units.select(F.col("gid_union")), "gid_union", "left_anti").agg(F.count_distinct("gid_union").alias("stray_units"))
    own = zones.agg(F.count_if(~F.coalesce(F.col("kind").isin("erosion", "accretion"), F.lit(False))).alias("unknown_kind"), F.count_if(~F.col("crs").eqNullSafe(F.lit("EPSG:4326"))).alias("other_crs"))
    return own.join(stray, F.lit(True))  # one row each


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Run records with the column place: models in the order of MODELS, others after them, then by file."""
    place = F.coalesce(*(F.when(F.col("model") == m, F.lit(k)) for k, m in enumerate(MODELS)), F.lit(9))
    return runs.withColumn("place", place).orderBy("place", "model", "file")


def append_manifest(records: DataFrame, path: str) -> None:
    """Adds provenance records; every part has the header, none is written twice or locked."""
    records.write.mode("append").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
