"""Arrays in npy and npz files as rows. A header says where the numbers begin, and partitions are ranges of these, so that a
file of any size is read side by side; an array that an archive holds compressed is one partition, read as a stream."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Numbers of a partition.
RANGE = 1 << 20
#: Schemes of Spark's paths by the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    scheme, sep, rest = path.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest) if sep else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Layout:
    """Of an array in a file: its shape, kind of number, order of axes, and the byte at which it begins; -1 where it is compressed."""

    shape: tuple[int, ...]
    dtype: str
    columns_first: bool
    begin: int


def _header(file) -> Layout:
    version = np.lib.format.read_magic(file)
    shape, columns_first, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if dtype.kind not in "iufb":
        raise ValueError(f"an array of {dtype} holds no numbers")
    return Layout(tuple(shape), dtype.str, columns_first, file.tell())


def layouts(path: str) -> dict[str, Layout]:
    """The arrays of a file by name; that of an npy file has an empty one."""
    store, name = opened(path)
    with store.open_input_file(name) as file:
        if not path.endswith(".npz"):
            return {"": _header(file)}
        out = {}
        with zipfile.ZipFile(file) as z:
            for info in z.infolist():
                if not info.filename.endswith(".npy"):
                    continue
                with z.open(info) as member:
                    try:
                        found = _header(member)
                    except ValueError:
                        continue  # texts beside the numbers
                begin = -1
                if info.compress_type == zipfile.ZIP_STORED:
                    file.seek(info.header_offset + 26)
                    begin = info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4))) + found.begin
                out[info.filename.removesuffix(".npy")] = Layout(found.shape, found.dtype, found.columns_first, begin)
        return out


class _Part(InputPartition):
    def __init__(self, array: str, first: int, last: int):
        super().__init__((array, first, last))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("range", RANGE))
        wanted = options.get("array")
        self.arrays = {k: v for k, v in layouts(self.path).items() if wanted is None or k == wanted}

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, a in self.arrays.items():
            n = int(np.prod(a.shape, dtype=np.int64))
            step = n if a.begin < 0 else self.step
            out += [_Part(name, k, min(n, k + step)) for k in range(0, n, max(1, step))]
        return out or [_Part("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, first, last = partition.value
        if first == last:
            return
        a = self.arrays[name]
        wide = np.dtype(a.dtype).itemsize
        store, path = opened(self.path)
        with store.open_input_file(path) as file:
            if a.begin >= 0:
                file.seek(a.begin + first * wide)
                yield from self._rows(file, name, a, first, last)
                return
            with zipfile.ZipFile(file) as z, z.open(name + ".npy") as member:
                _header(member)
                yield from self._rows(member, name, a, first, last)

    def _rows(self, file, name: str, a: Layout, first: int, last: int) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(a.dtype).itemsize
        for k in range(first, last, 1 << 16):
            n = min(last - k, 1 << 16)
            v = np.frombuffer(file.read(n * wide), a.dtype).astype(np.float64)
            if len(v) < n:
                raise ValueError(f"{self.path} ends before its numbers do")
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(k, k + n)), pa.array(v)], names=["array", "k", "value"])


class ArraySource(DataSource):
    """Rows (array, k, value): the k-th number, in the order of the file, of each array. Options: path; array, one of an
    archive; range, the numbers of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "array string, k long, value double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(dict(self.options))


def read_array(spark: SparkSession, path: str, array: str = "", **options: int) -> DataFrame:
    """i0, i1, ... (long) and value of one array."""
    a = layouts(path).get(array)
    if a is None:
        raise ValueError(f"{path} has no array {array!r}")
    spark.dataSource.register(ArraySource)
    rows = spark.read.format("npy").option("array", array)
    for k, v in options.items():
        rows = rows.option(k, v)
    shape = a.shape[::-1] if a.columns_first else a.shape
    at, left = [], F.col("k")
    for n in reversed(shape):
        at.append(left % n)
        left = F.floor(left / n)
    at = at if a.columns_first else at[::-1]
    return rows.load(path).select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(at)], "value")


def read_coeff_arrays(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """epoch_id, n, m, c, s of a matrix: in an npy file both parts, degrees, orders and, of a series, epochs; in an archive
    arrays C and S of degrees, orders and epochs."""
    found = layouts(path)
    if "" in found:
        shape = found[""].shape
        if len(shape) not in (3, 4) or shape[0] != 2 or shape[1] != shape[2]:
            raise ValueError(f"an array of {shape} is no matrix of coefficients")
        rows = read_array(spark, path, **options).withColumnsRenamed({"i1": "n", "i2": "m", "i3": "epoch_id"})
    else:
        if not {"C", "S"} <= set(found) or found["C"].shape != found["S"].shape or len(found["C"].shape) not in (2, 3):
            raise ValueError(f"{path} lacks arrays C and S of one shape; it has {sorted(found)}")
        parts = [read_array(spark, path, x, **options).withColumn("i", F.lit(k)) for k, x in enumerate("CS")]
        rows = parts[0].unionByName(parts[1]).withColumnsRenamed({"i0": "n", "i1": "m", "i2": "epoch_id"}).withColumnRenamed("i", "i0")
    rows = rows if "epoch_id" in rows.columns else rows.withColumn("epoch_id", F.lit(0))
    part = lambda k: F.coalesce(F.max(F.when(F.col("i0") == k, F.col("value"))), F.lit(0.0))
    out = rows.where("m <= n").groupBy("epoch_id", "n", "m").agg(part(0).alias("c"), part(1).alias("s"))
    return out.select(*[F.col(c).cast("int").alias(c) for c in ("epoch_id", "n", "m")], "c", "s")


def write_coeff_arrays(coeffs: DataFrame, path: str, nmax: int) -> None:
    """The matrix of read_coeff_arrays, of a set of a bounded size: npy, or npz with C and S. Epochs are numbered in order."""
    from orbweave.operators.synthesis import sets_of

    sets = sets_of(coeffs, nmax)
    x = np.stack([sets[e] for e in sorted(sets)], -1)
    store, name = opened(path)
    with store.open_output_stream(name, compression=None) as out:
        if path.endswith(".npz"):
            np.savez(out, C=x[0], S=x[1])
        else:
            np.save(out, x)
