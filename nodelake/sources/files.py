"""Arrays in outside files, and the registry that knows which reader a resource needs.

Files are read with Spark's own file source, so any path that Spark can open will do; each file is
decoded in the task that holds it.
"""

from __future__ import annotations

import importlib.util
import io
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodelake.errors import NotFound, Unsupported, Validation

ARRAYS = "path string, shape array<bigint>, data array<double>"


def _decoded(raw: DataFrame, decode: Callable[[bytes], np.ndarray], schema: str = ARRAYS) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [decode(x.as_py()) for x in batch.column("content")]
            shapes = pa.array([list(a.shape) for a in found], pa.list_(pa.int64()))
            data = pa.array([np.ascontiguousarray(a, "<f8").ravel() for a in found], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("path"), shapes, data], ["path", "shape", "data"])

    return raw.select("path", "content").mapInArrow(run, schema)


def decode_npy(content: bytes) -> np.ndarray:
    """Type, order and shape from the header; pickled objects are refused."""
    return np.lib.format.read_array(io.BytesIO(content), allow_pickle=False)


def read_npy(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, shape, data) of .npy files, values in C order as doubles."""
    return _decoded(spark.read.format("binaryFile").load(paths), decode_npy)


def decode_tiff(content: bytes) -> np.ndarray:
    import tifffile

    return tifffile.imread(io.BytesIO(content))


def decode_hdf5(content: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Frames start .. start + count of the dataset ``entry/data/data``, else ``data``."""
    import h5py

    with h5py.File(io.BytesIO(content), "r") as f:
        data = f["entry/data/data"] if "entry/data/data" in f else f["data"]
        if start >= data.shape[0]:
            raise NotFound(f"frame {start} of {data.shape[0]}")
        return data[start : data.shape[0] if count is None else start + count]


def needs(library: str) -> None:
    if importlib.util.find_spec(library) is None:
        raise Unsupported(f"{library} is not installed")


def _number(key: str, default: int = 0) -> Column:
    return F.coalesce(F.try_variant_get("datum_kwargs", f'$["{key}"]', "bigint"), F.lit(default).cast("long"))


def plain_path(path: Column) -> Column:
    """A path without its scheme and host, and with single slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", ""), "/+", "/")


def sequence_path() -> Column:
    """``<root>/<path>_<index>.npy``; the index is ``index``, else ``point_number``, else 0."""
    at = F.coalesce(F.try_variant_get("datum_kwargs", '$["index"]', "bigint"), _number("point_number"))
    return F.concat_ws("_", "file", F.concat(at.cast("string"), F.lit(".npy")))


def tiff_path() -> Column:
    return F.concat("file", F.format_string("_%06d.tiff", _number("point_number")))


class Handlers:
    """spec -> (path of a datum's file, decoder); ``root_map`` moves roots."""

    def __init__(self, root_map: dict[str, str] | None = None):
        self.root_map = dict(root_map or {})
        self._by_spec: dict[str, tuple[Callable[[], Column], Callable[[bytes], np.ndarray], str | None]] = {}
        self.register("NPY_SEQ", sequence_path, decode_npy)
        self.register("npy", lambda: F.col("file"), decode_npy)
        self.register("AD_TIFF", tiff_path, decode_tiff, "tifffile")
        self.register("AD_HDF5", lambda: F.col("file"), decode_hdf5, "h5py")

    def register(self, spec: str, path: Callable[[], Column], decode: Callable[[bytes], np.ndarray], library: str | None = None) -> None:
        self._by_spec[spec] = (path, decode, library)

    def specs(self) -> list[str]:
        return sorted(self._by_spec)

    def located(self, resolved: DataFrame) -> DataFrame:
        """With ``file``: the resource's place under its (moved) root."""
        root = F.coalesce("root", F.lit(""))
        if self.root_map:
            moves = F.create_map(*[F.lit(x) for pair in self.root_map.items() for x in pair])
            root = F.coalesce(F.try_element_at(moves, root), root)
        return resolved.withColumn("file", F.when(root == "", F.col("resource_path")).otherwise(F.concat_ws("/", F.rtrim(root, F.lit("/")), F.ltrim("resource_path", F.lit("/")))))

    def fill(self, resolved: DataFrame) -> DataFrame:
        """(datum_id, shape, data): every datum's file decoded by its spec's handler."""
        unknown = resolved.where(~F.coalesce(F.col("spec").isin(self.specs()), F.lit(False))).select("spec").limit(5).collect()
        if unknown:
            raise Validation(f"no handler for {sorted({str(r[0]) for r in unknown})}")
        out = None
        for spec in sorted(r[0] for r in resolved.select("spec").distinct().collect()):  # registered ones only
            path, decode, library = self._by_spec[spec]
            if library:
                needs(library)
            own = self.located(resolved.where(F.col("spec") == spec)).withColumn("path", path())
            read = self._read_frames(own) if spec == "AD_HDF5" else self._read(own, decode)
            out = read if out is None else out.unionByName(read)
        if out is None:
            return resolved.select("datum_id", F.array().cast("array<bigint>").alias("shape"), F.array().cast("array<double>").alias("data"))
        return out

    def _files(self, own: DataFrame) -> DataFrame:
        """(path, content) of the files in the folders of ``own``: Spark lists and reads them; the driver sees
        the names of the folders only. Files that no datum names go in the join."""
        folders = [r[0] for r in own.select(F.regexp_extract("path", r"^(.*/)[^/]*$", 1)).distinct().collect()]
        return own.sparkSession.read.format("binaryFile").load(folders).select("content", plain_path(F.col("path")).alias("path"))

    def _read(self, own: DataFrame, decode) -> DataFrame:
        named = own.select(plain_path(F.col("path")).alias("path")).distinct()
        arrays = _decoded(self._files(own).join(named, "path", "left_semi"), decode)
        return own.select("datum_id", plain_path(F.col("path")).alias("path")).join(arrays, "path").select("datum_id", "shape", "data")

    def _read_frames(self, own: DataFrame) -> DataFrame:
        """Points of stacked files: ``frame_per_point`` frames from ``point_number`` times that on."""
        per = F.coalesce(F.try_variant_get("resource_kwargs", '$["frame_per_point"]', "bigint"), F.lit(1).cast("long"))
        points = own.select("datum_id", plain_path(F.col("path")).alias("path"), (_number("point_number") * per).alias("start"), per.alias("count"))

        def run(batches):
            for batch in batches:
                found = [decode_hdf5(c, s, n) for c, s, n in zip(*(batch.column(x).to_pylist() for x in ("content", "start", "count")), strict=True)]
                yield pa.record_batch(
                    [batch.column("datum_id"), pa.array([list(a.shape) for a in found], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(a, "<f8").ravel() for a in found], pa.list_(pa.float64()))],
                    ["datum_id", "shape", "data"],
                )

        return points.join(self._files(own), "path").mapInArrow(run, "datum_id string, shape array<bigint>, data array<double>")


def load_config(text: str) -> dict:
    """Trees and login settings of a YAML (or JSON) configuration; the first tree that names a store wins."""
    try:
        doc = json.loads(text)
    except ValueError:
        needs("yaml")
        import yaml

        doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("trees"), list):
        raise Validation("a configuration has a list of trees")
    catalog = next((t for t in doc["trees"] if "catalog" in str(t.get("tree", ""))), None)
    return {"trees": doc["trees"], "catalog": catalog, "authentication": doc.get("authentication") or {}}


def database_of(uri: str) -> str:
    """The last path segment of a store's address, before any parameters."""
    tail = uri.split("?")[0].rstrip("/").split("://")[-1]
    if "/" not in tail:
        raise Validation(f"no database in {uri!r}")
    return tail.rsplit("/", 1)[1]
