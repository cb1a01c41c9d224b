"""Data sources of process traces and spectra in NetCDF; they need the netCDF4 package on the workers, and files on a mounted path.

``wafer_netcdf_groups``: a row for each group of each file. ``wafer_netcdf``: a row for each sample.
``wafer_netcdf_blocks``: minima, maxima and sums of each block of rows. A path may be several, comma-separated, with
wildcards. Planning opens no file: a partition is a file, or every n-th block of rows of one (``splits``).

Filters on path, group, row and t are pushed down: files and groups are skipped, and no data are read of a block where no
row is left. Only the columns of the schema given to the reader are read, and of ``data`` only the ``signals`` named.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

COMPARED = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: np.isin(x, list(v)), GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}
PUSHED = ("path", "group", "row", "t")


class FilePartition(InputPartition):
    def __init__(self, path: str, turn: int):
        self.path, self.turn = path, turn


def _open(path: str):
    try:
        from netCDF4 import Dataset
    except ImportError as e:
        raise ImportError("reading NetCDF needs the netCDF4 package") from e
    return Dataset(path)


def _lists(cells: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as lists; masked and NaN cells are null."""
    flat = np.ma.getdata(cells).ravel()
    gone = np.ma.getmaskarray(cells).ravel() | (np.isnan(flat) if flat.dtype.kind == "f" else False)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, max(cells.shape[1], 1), dtype=np.int32) if cells.shape[1] else np.zeros(len(cells) + 1, np.int32), pa.array(flat, mask=gone).cast(kind))


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        if "path" not in options:
            raise ValueError("a path must be given")
        self.columns, self.arrow = schema.fieldNames(), to_arrow_schema(schema)
        self.path, self.block, self.splits = options["path"], int(options.get("rows", "4096")), int(options.get("splits", "1"))
        self.signals, self.dictionary = json.loads(options["signals"]) if "signals" in options else None, options.get("dictionary")
        if self.block < 1 or self.splits < 1:
            raise ValueError("rows and splits must be positive")
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def passes(self, column: str, values: np.ndarray) -> np.ndarray:
        """Which values the pushed filters of a column keep; a missing one (NaN) none."""
        keep = np.ones(len(values), bool)
        for name, kind, value in self.filters:
            if name == column:
                keep &= np.asarray(COMPARED[kind](values, value), bool)
        return keep

    def one(self, column: str, value: str) -> bool:
        return bool(self.passes(column, np.array([value], dtype=object))[0])

    def asks(self, column: str) -> bool:
        return column in self.columns or any(f[0] == column for f in self.filters)

    def partitions(self) -> list[FilePartition]:
        files = sorted({f for pattern in self.path.split(",") for f in (glob.glob(pattern.strip()) or [pattern.strip()])})
        return [FilePartition(f, turn) for f in files if self.one("path", f) for turn in range(self.splits)]

    def groups(self, dataset, path: str) -> Iterator[tuple[str, object]]:
        if self.one("path", path):
            yield from ((name, g) for name, g in dataset.groups.items() if self.one("group", name))

    def batch(self, **columns) -> pa.RecordBatch:
        """The schema's columns of those given; ``rows`` copies of one that is a plain value."""
        rows = columns.pop("rows")
        made = []
        for f in self.arrow:
            x = columns[f.name]() if callable(columns[f.name]) else columns[f.name]
            x = x if isinstance(x, pa.Array) else pa.array([x] * rows, f.type) if np.isscalar(x) or isinstance(x, (str, list)) or x is None else pa.array(x, from_pandas=True)
            made.append(x.cast(f.type))
        return pa.RecordBatch.from_arrays(made, schema=self.arrow)

    def ranges(self, n: int, turn: int) -> Iterator[tuple[int, int]]:
        for start in range(turn * self.block, n, self.block * self.splits):
            yield start, min(start + self.block, n)

    def decoder(self) -> np.ndarray | None:
        if self.dictionary is None:
            return None
        with _open(self.dictionary) as d:
            return np.ma.filled(np.ma.asarray(d.variables["data"][:], dtype=float), np.nan)

    def decoded(self, codes: np.ndarray, decoder: np.ndarray | None, group: str) -> np.ndarray:
        """Values of codes; ValueError for a code without entry, or an entry that is no finite number."""
        if decoder is None:
            raise ValueError("values need the option dictionary")
        codes = np.ma.filled(codes, len(decoder)) if np.ma.isMaskedArray(codes) else np.asarray(codes)
        if codes.size and (codes.min() < 0 or codes.max() >= len(decoder)):
            raise ValueError(f"{group} contains an invalid dictionary code")
        values = decoder[codes]
        if not np.isfinite(values).all():
            raise ValueError(f"{group} contains a non-finite decoded value")
        return values


def _names(group) -> list[str] | None:
    return [str(x) for x in group.variables["feature"][:]] if "feature" in group.variables else None


def _wavelengths(group) -> list[float] | None:
    return [float(x) for x in group.variables["wavelengths"][:]] if "wavelengths" in group.variables else None


class GroupReader(_Reader):
    def partitions(self) -> list[FilePartition]:
        return [p for p in super().partitions() if p.turn == 0]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where no file is left
            return
        with _open(partition.path) as d:
            for name, g in self.groups(d, partition.path):
                yield self.batch(rows=1, path=partition.path, group=name, samples=len(g.variables["times"]), features=lambda g=g: pa.array([_names(g)], pa.list_(pa.string())), wavelengths=lambda g=g: pa.array([_wavelengths(g)], pa.list_(pa.float64())))


class TraceReader(_Reader):
    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where no file is left
            return
        with _open(partition.path) as d:
            decoder = self.decoder() if "values" in self.columns else None
            for name, g in self.groups(d, partition.path):
                places = self.places(g, name)
                for start, stop in self.ranges(len(g.variables["times"]), partition.turn):
                    yield from self.some(partition.path, name, g, places, decoder, start, stop)

    def places(self, group, name: str) -> list[int] | slice:
        if self.signals is None or not {"codes", "values"} & set(self.columns):
            return slice(None)
        own = _names(group) or []
        if lacking := [x for x in self.signals if x not in own]:
            raise ValueError(f"{name} lacks signals: {lacking}")
        return [own.index(x) for x in self.signals]

    def some(self, path: str, name: str, g, places, decoder, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        rows = np.arange(start, stop)
        keep = self.passes("row", rows)
        if not keep.any():
            return
        t = np.ma.filled(np.ma.asarray(g.variables["times"][start:stop], dtype=float), np.nan) if self.asks("t") else np.full(len(rows), np.nan)
        keep &= self.passes("t", t)
        at = np.flatnonzero(keep)
        if not len(at):
            return
        codes = None
        if {"codes", "values"} & set(self.columns):
            first, last = start + int(at[0]), start + int(at[-1]) + 1
            codes = g.variables["data"][first:last, places][at - at[0]]
        yield self.batch(
            rows=len(at), path=path, group=name, row=rows[at], t=t[at], codes=lambda: _lists(codes, pa.int32()), values=lambda: _lists(self.decoded(codes, decoder, name), pa.float64()),
        )


class BlockReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Files and groups only: a block's sums are of all its rows."""
        own = [f for f in filters if getattr(f, "attribute", None) in (("path",), ("group",))]
        yield from (f for f in filters if f not in own)
        yield from super().pushFilters(own)

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where no file is left
            return
        with _open(partition.path) as d:
            decoder = self.decoder()
            for name, g in self.groups(d, partition.path):
                for start, stop in self.ranges(len(g.variables["times"]), partition.turn):
                    x = self.decoded(g.variables["data"][start:stop, :], decoder, name)
                    whole = {"minimum": x.min(axis=0), "maximum": x.max(axis=0), "total": x.sum(axis=0), "squares": np.square(x).sum(axis=0)}
                    yield self.batch(rows=1, path=partition.path, group=name, start=start, samples=stop - start, **{k: _lists(v[None], pa.float64()) for k, v in whole.items()})


class GroupSource(DataSource):
    """``spark.read.format("wafer_netcdf_groups").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "wafer_netcdf_groups"

    def schema(self) -> str:
        return "path string, group string, samples long, features array<string>, wavelengths array<double>"

    def reader(self, schema) -> DataSourceReader:
        return GroupReader(schema, self.options)


class TraceSource(DataSource):
    """``spark.read.format("wafer_netcdf").load(path)``; ``values`` (in a schema that is given) are codes looked up in the file ``dictionary``, ``signals`` a JSON list of names in the order wanted."""

    @classmethod
    def name(cls) -> str:
        return "wafer_netcdf"

    def schema(self) -> str:
        return "path string, group string, row long, t double, codes array<int>"

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(schema, self.options)


class BlockSource(DataSource):
    """``spark.read.format("wafer_netcdf_blocks").option("dictionary", file).load(path)``: per channel over each ``rows`` samples of a group."""

    @classmethod
    def name(cls) -> str:
        return "wafer_netcdf_blocks"

    def schema(self) -> str:
        return "path string, group string, start long, samples long, minimum array<double>, maximum array<double>, total array<double>, squares array<double>"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known and turns filter pushdown of Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GroupSource, TraceSource, BlockSource):
        spark.dataSource.register(source)


def common_signals(groups: DataFrame) -> DataFrame:
    """(feature): the signals that every group of ``wafer_netcdf_groups`` has, in order."""
    n = groups.agg(F.count("*").alias("_groups"))
    each = groups.select(F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("_n"))
    return each.join(F.broadcast(n), F.col("_n") == F.col("_groups")).select("feature").orderBy("feature")


def process_traces(spark: SparkSession, path: str, dictionary: str, splits: int = 1) -> DataFrame:
    """(path, group, t, one column for each common signal): decoded samples. Groups of one name in two files are rejected."""
    groups = spark.read.format("wafer_netcdf_groups").load(path)
    if twice := groups.groupBy("group").count().filter("count > 1").first():
        raise ValueError(f"duplicate process group: {twice[0]}")
    names = [r[0] for r in common_signals(groups).collect()]
    wide = spark.read.format("wafer_netcdf").schema("path string, group string, t double, values array<double>").options(dictionary=dictionary, signals=json.dumps(names), splits=splits).load(path)
    return wide.select("path", "group", "t", *[F.col("values")[i].alias(x) for i, x in enumerate(names)])


def channel_sums(blocks: DataFrame, keys: tuple[str, ...] = ("path", "group")) -> DataFrame:
    """(keys, channel, samples, minimum, maximum, mean, deviation) of blocks: each channel over all samples of a group."""
    b = blocks.select(*keys, "samples", F.posexplode(F.arrays_zip("minimum", "maximum", "total", "squares")).alias("channel", "x"))
    n, s, q = F.sum("samples"), F.sum("x.total"), F.sum("x.squares")
    return b.groupBy(*keys, "channel").agg(
        n.alias("samples"), F.min("x.minimum").alias("minimum"), F.max("x.maximum").alias("maximum"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("deviation"),
    )
