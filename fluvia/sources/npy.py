"""Processed cubes as ``.npy`` arrays (time, row, column) with their metadata in JSON, as a data source of their own.

A folder holds ``<tile>_<band>.npy``, or parts ``<tile>_<band>@<first>.npy`` that begin at slice ``first``,
and ``<tile>_meta.json``. What follows the last ``_`` is the band, unless bands are asked for by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "fluvia_npy"
#: Partitions of a read: a task costs more than a small slice.
TASKS = 256
_NAME = re.compile(r"(.+)_([^_@]+?)(?:@(\d+))?\.npy$")
_TYPES = {"f4": "float", "f8": "double", "i1": "tinyint", "u1": "smallint", "i2": "smallint", "i4": "int", "i8": "bigint", "b1": "boolean"}
#: What the metadata of a tile's cube holds.
META = "tile string, months array<string>, crs string, transform array<double>, resolution_m double, height int, width int, index_families array<string>, thresholds array<double>, threshold_calibration map<string,string>, observed_fraction_raw double, usable_fraction_filled double, water_fraction double, max_gap_months int, mss_months_despeckled int"


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def header(stream) -> tuple[tuple, np.dtype, int]:
    """Shape, type and where the values begin of an array file; only its head is read."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if fortran or len(shape) != 3:
        raise ValueError(f"an array of time, row and column, rows first, is asked for, not {shape}")
    return shape, kind, stream.tell()


@dataclass
class File:
    tile: str
    band: str
    first: int
    path: str
    shape: tuple
    kind: str
    start: int


@dataclass
class Slice(InputPartition):
    """One time of one tile, in the files of all bands."""

    tile: str
    t: int
    files: list


@dataclass
class Slices(InputPartition):
    """Slices that a task reads one after the other."""

    slices: list


class FramesReader(DataSourceReader):
    def __init__(self, folder: str, files: list[File], bands: list[str]):
        self.folder, self.files, self.bands = folder, files, bands
        self.least, self.most, self.times, self.tiles = None, None, None, None

    def pushFilters(self, filters):
        for f in filters:
            of, value = f.attribute, getattr(f, "value", None)
            if of == ("t",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = value + isinstance(f, GreaterThan)
                self.least = low if self.least is None else max(self.least, low)
            elif of == ("t",) and isinstance(f, (LessThan, LessThanOrEqual)):
                high = value - isinstance(f, LessThan)
                self.most = high if self.most is None else min(self.most, high)
            elif of in (("t",), ("tile",)) and isinstance(f, (EqualTo, In)):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                name = "times" if of == ("t",) else "tiles"
                held = getattr(self, name)
                setattr(self, name, asked if held is None else held & asked)
            else:
                yield f

    def partitions(self) -> list[Slice] | list[Slices]:
        """A partition for each slice that is asked for, or for several if there are more than TASKS; no other slice is opened."""
        of: dict[tuple[str, int], dict[str, File]] = {}
        for f in self.files:
            if self.tiles is not None and f.tile not in self.tiles:
                continue
            low = f.first if self.least is None else max(f.first, self.least)
            high = f.first + f.shape[0] - 1 if self.most is None else min(f.first + f.shape[0] - 1, self.most)
            for t in range(low, high + 1):
                if self.times is None or t in self.times:
                    of.setdefault((f.tile, t), {})[f.band] = f
        every = [Slice(tile, t, [found.get(b) for b in self.bands]) for (tile, t), found in sorted(of.items())]
        many = -(-len(every) // TASKS)
        return [Slices(every[s : s + many]) for s in range(0, len(every), many)] if many > 1 else every

    def read(self, partition: Slice | Slices) -> Iterator[pa.RecordBatch]:
        for one in partition.slices if isinstance(partition, Slices) else [partition]:
            yield from self._slice(one)

    def _slice(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        shape, columns = None, []
        for f in partition.files:
            if f is None:
                columns.append(None)
                continue
            system, path = _opened(f.path)
            n = f.shape[1] * f.shape[2]
            kind = np.dtype(f.kind)
            with system.open_input_file(path) as stream:
                stream.seek(f.start + (partition.t - f.first) * n * kind.itemsize)
                values = np.frombuffer(stream.read(n * kind.itemsize), kind)
            if shape is not None and shape != f.shape[1:]:
                raise ValueError(f"bands of {partition.tile} differ in shape")
            shape = f.shape[1:]
            columns.append(values)
        r, c = np.divmod(np.arange(shape[0] * shape[1]), shape[1])
        arrays = [pa.array([partition.tile] * len(r), pa.string()), *(pa.array(x.astype(np.int32)) for x in (np.full(len(r), partition.t), r, c))]
        for band, x in zip(self.bands, columns, strict=True):
            if x is None:
                arrays.append(pa.nulls(len(r), pa.float32()))
            else:
                x = x.astype(np.int16) if x.dtype == np.uint8 else x.astype(x.dtype.newbyteorder("="))
                arrays.append(pa.array(x, mask=np.isnan(x) if x.dtype.kind == "f" else None))
        yield pa.RecordBatch.from_arrays(arrays, ["tile", "t", "r", "c", *self.bands])


class FramesSource(DataSource):
    """Options: ``path``, and ``bands``, separated by commas (all that the folder has)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _files(self) -> tuple[list[File], list[str]]:
        system, folder = _opened(self.options["path"])
        found = []
        asked = [b for b in self.options.get("bands", "").split(",") if b]
        for info in system.get_file_info(pyarrow.fs.FileSelector(folder)):
            names = [m for b in asked if (m := re.fullmatch(rf"(.+)_({re.escape(b)})(?:@(\d+))?\.npy", info.base_name))] if asked else [_NAME.fullmatch(info.base_name)]
            for named in filter(None, names[:1]):
                with system.open_input_file(info.path) as stream:
                    shape, kind, start = header(stream)
                at = self.options["path"].rstrip("/") + "/" + info.base_name
                found.append(File(named[1], named[2], int(named[3] or 0), at, shape, kind.str, start))
        found.sort(key=lambda f: (f.tile, f.band, f.first))
        return found, asked or sorted({f.band for f in found})

    def schema(self) -> str:
        files, bands = self._files()
        kinds = {f.band: _TYPES[f.kind[1:]] for f in files}
        return ", ".join(["tile string", "t int", "r int", "c int", *(f"`{b}` {kinds.get(b, 'float')}" for b in bands)])

    def reader(self, schema) -> FramesReader:
        files, bands = self._files()
        return FramesReader(self.options["path"], files, bands)


def read_frames(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """Rows tile, t, r, c and bands of the arrays in a folder; NaN is null. A filter on ``t`` or ``tile`` decides which
    slices are opened, each a partition of its own up to TASKS of them. A folder without arrays gives none."""
    spark.dataSource.register(FramesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("bands", ",".join(bands or [])).load(path)


def write_frames(rows: DataFrame, path: str, bands: dict[str, str], months: int = 12) -> DataFrame:
    """Writes a cube (tile, t, r, c, bands) as parts of ``months`` slices for each tile and band; the names that were written.

    ``bands``: the array type of each (as ``f4``, ``i1``). Cells that are missing, or null, are NaN, or 0 of a
    whole number. A part is one task's work: ``months`` frames. A repeated task writes the same file again, and a part shows
    under its name when it is whole.
    """
    part = F.floor(F.col("t") / months).cast("int")
    sizes = rows.groupBy("tile").agg((F.max("r") + 1).alias("fl_h"), (F.max("c") + 1).alias("fl_w"), F.max("t").alias("fl_t"))
    sized = rows.select("tile", "t", "r", "c", *bands, part.alias("fl_part")).join(sizes, "tile")

    def write(part: pd.DataFrame) -> pd.DataFrame:
        system, folder = _opened(path)
        tile, first = part["tile"].iloc[0], int(part["fl_part"].iloc[0]) * months
        n = min(months, int(part["fl_t"].iloc[0]) + 1 - first)
        shape = (n, int(part["fl_h"].iloc[0]), int(part["fl_w"].iloc[0]))
        at = tuple(part[k].to_numpy() - (first if k == "t" else 0) for k in ("t", "r", "c"))
        names = []
        system.create_dir(folder, recursive=True)
        for band, kind in bands.items():
            array = np.full(shape, np.nan if np.dtype(kind).kind == "f" else 0, np.dtype(kind))
            values = part[band]
            array[at] = values.fillna(0) if array.dtype.kind != "f" else values
            names.append(f"{tile}_{band}@{first}.npy")
            _put(system, f"{folder.rstrip('/')}/{names[-1]}", lambda out, array=array: np.lib.format.write_array(out, array))
        return pd.DataFrame({"name": names})

    from fluvia.storage import stored

    return stored(sized.groupBy("tile", "fl_part").applyInPandas(write, "name string"), "written")


def _put(system: pyarrow.fs.FileSystem, path: str, write) -> None:
    from pyspark import TaskContext

    half = f"{path}.{TaskContext.get().taskAttemptId()}.part" if TaskContext.get() else f"{path}.part"
    with system.open_output_stream(half) as out:
        write(out)
    system.move(half, path)


def write_meta(meta: DataFrame, path: str) -> DataFrame:
    """Writes the metadata (tile and others, nested as they are) of each tile beside its arrays; the names that were written."""
    as_json = meta.select("tile", F.to_json(F.struct(*meta.columns), {"ignoreNullFields": "false"}).alias("json"))

    def write(batches):
        system, folder = _opened(path)
        system.create_dir(folder, recursive=True)
        for b in batches:
            names = []
            for tile, text in zip(b.column("tile").to_pylist(), b.column("json").to_pylist(), strict=True):
                names.append(f"{tile}_meta.json")
                _put(system, f"{folder.rstrip('/')}/{names[-1]}", lambda out, text=text: out.write(json.dumps(json.loads(text), indent=2).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    from fluvia.storage import stored

    return stored(as_json.mapInArrow(write, T.StructType([T.StructField("name", T.StringType())])), "written")


def read_meta(spark: SparkSession, path: str, schema: str = META) -> DataFrame:
    """The metadata of all tiles of a folder; fields that a file lacks are null."""
    texts = spark.read.text(f"{path.rstrip('/')}/*_meta.json", wholetext=True)
    return texts.select(F.from_json("value", schema).alias("m")).select("m.*")
