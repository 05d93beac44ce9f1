import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nodelake.errors import InvalidDType, InvalidSlice, Unsupported, Validation
from nodelake.functions import dtypes, ndslice, structures
from nodelake.functions.ndslice import ELLIPSIS, Index, Range
from nodelake.operators import arrays as A

from .conftest import rows


def test_slice_text():
    assert ndslice.parse("") == () and ndslice.parse("5") == (Index(5),) and ndslice.parse("[-1, 1:3, ::2]") == (Index(-1), Range(1, 3), Range(None, None, 2))
    assert ndslice.parse("1,...,3") == (Index(1), ELLIPSIS, Index(3))
    for text in ("", "5", "1:3,4,1:5:2", "::2", "1,...,3"):
        dims = ndslice.parse(text)
        assert ndslice.to_text(dims) == text and ndslice.from_json(ndslice.to_json(dims)) == dims
    for bad in ("...,...", "a", "1:2:3:4", "[1", "::0"):
        with pytest.raises(InvalidSlice):
            ndslice.parse(bad)
    assert ndslice.is_full(ndslice.parse(":,...")) and not ndslice.is_full(ndslice.parse("1:"))
    assert ndslice.expand(ndslice.parse("1,..."), 3) == (Index(1), Range(), Range())
    for bad, shape in (("1,2", (3,)), ("3", (3,)), ("-4", (3,))):
        with pytest.raises(InvalidSlice):
            ndslice.pick(ndslice.parse(bad), shape)
    assert ndslice.PATTERN.match("1:3,4") and not ndslice.PATTERN.match("...")


ends = st.one_of(st.none(), st.integers(-9, 9))
dim = st.one_of(st.builds(Range, ends, ends, st.one_of(st.none(), st.integers(-4, 4).filter(bool))), st.just(Range()))


@given(st.tuples(dim, dim, dim), st.tuples(*[st.integers(0, 7)] * 3))
def test_picks_match_numpy(dims, shape):
    for p, d, n in zip(ndslice.pick(dims, shape), dims, shape, strict=True):
        assert [p.start + p.step * i for i in range(p.count)] == list(range(n))[slice(d.start, d.stop, d.step)]


@settings(max_examples=4, deadline=None)
@given(st.tuples(dim, dim))
def test_slices_of_blocks_match_numpy(spark, dims):
    shape, want = (5, 7), np.arange(35.0).reshape(5, 7)[tuple(slice(d.start, d.stop, d.step) for d in dims)]
    blocks = A.ramp(spark, "x", shape, chunk=(2, 3))
    found, left = A.slice_blocks(blocks, dims, structures.ArrayStructure(None, A.grid(shape, (2, 3)), shape))
    got = np.full(left, np.nan)
    for i, j, v in rows(found):
        got[i, j] = v
    assert left == want.shape and np.array_equal(got, want)


def test_blocks(spark):
    shape, chunk = (4, 5, 3), (2, 2, 3)
    blocks = A.from_values(spark, "x", np.arange(60.0), shape, chunk).cache()
    structure = structures.ArrayStructure(None, A.grid(shape, chunk), shape)
    assert A.grid((5,), (2,)) == ((2, 2, 1),) and blocks.count() == 6
    one = A.read_block(blocks, "x", structure, (1, 2, 0)).collect()[0]
    assert one["data"] == list(np.arange(60.0).reshape(shape)[2:4, 4:5].ravel()) and one["shape"] == [2, 1, 3]
    assert [r[3] for r in rows(A.cells(A.read(blocks, "x"), 3))] == list(np.arange(60.0))
    for bad in ((0,), (2, 0, 0), (0, -1, 0)):
        with pytest.raises(Validation):
            A.read_block(blocks, "x", structure, bad)
    assert A.parse_block("", 2) == (0, 0) and A.parse_block("1, 2", 2) == (1, 2)
    for bad in ("a", "1"):
        with pytest.raises(Validation):
            A.parse_block(bad, 2)
    with pytest.raises(Validation):
        A.from_values(spark, "x", [1.0], (2,))


def test_writing_a_block_keeps_the_others(spark, tmp_path):
    blocks = A.ramp(spark, "x", (4, 2), chunk=(2, 2))
    A.write_blocks(blocks, str(tmp_path / "b"))
    A.write_blocks(A.ramp(spark, "x", (4, 2), 10.0, (2, 2)).where("b0 = 1"), str(tmp_path / "b"))
    got = {r["b0"]: list(r["data"]) for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [40, 50, 60, 70]}


def test_sparse_and_awkward(spark):
    coo = spark.createDataFrame([(0, 1, 5.0), (2, 0, 7.0)], "i0 long, i1 long, value double")
    full = A.dense(coo, (3, 2), -1.0)
    assert [r[2] for r in rows(full)] == [-1, 5, -1, -1, 7, -1] and rows(A.sparse(full, -1.0)) == rows(coo)
    assert rows(A.cell_block(coo, ((2, 1), (2,)), (1, 0))) == [(2, 0, 7.0)]
    lists = spark.createDataFrame([(0, [1, 2]), (1, []), (2, None)], "i0 long, v array<int>")
    assert rows(A.awkward_elements(lists, "v")) == [(0, 0, 1), (0, 1, 2)] and rows(A.awkward_counts(lists, "v")) == [(0, 2), (1, 0), (2, 0)]
    buffers = spark.createDataFrame([(0, {"a": bytearray(b"x"), "b": bytearray(b"y")})], "i0 long, buffers map<string,binary>")
    assert list(A.awkward_buffers(buffers, ["b"]).collect()[0]["buffers"]) == ["b"] and A.awkward_buffers(buffers) is buffers


def test_dtypes():
    d = dtypes.DType.parse("<f8")
    assert (d.kind, d.itemsize, str(d), d.spark().simpleString()) == ("f", 8, "<f8", "double")
    assert dtypes.DType.parse("<U10").itemsize == 40 and str(dtypes.DType.parse("|b1")) == "|b1" and str(dtypes.DType.parse("=i4")) == "<i4"
    assert str(dtypes.DType.parse("<M8[ns]")) == "<M8[ns]" and dtypes.DType.parse("<M8[ns]").spark().simpleString() == "bigint"
    assert dtypes.DType.parse("<M8[us]").spark().simpleString() == "timestamp_ntz" and dtypes.DType.parse("<c16").spark().simpleString() == "struct<re:double,im:double>"
    for bad in ("f8", "<q8", "", "<f8[s]"):
        with pytest.raises(InvalidDType):
            dtypes.DType.parse(bad)
    with pytest.raises(Unsupported):
        dtypes.DType.parse("<f16").spark()
    for text in ("<f8", "<u8", "|S5", "<M8[ms]", "<U3"):
        d = dtypes.DType.parse(text)
        assert dtypes.from_json(d.to_json()) == d
    inner = {"itemsize": 4, "fields": [{"name": "y", "dtype": dtypes.DType.parse("<f4").to_json(), "shape": [2, 3]}]}
    s = dtypes.from_json({"itemsize": 12, "fields": [{"name": "x", "dtype": dtypes.DType.parse("<i4").to_json()}, {"name": "n", "dtype": inner}]})
    assert s.depth() == 2 and s.spark().simpleString() == "struct<x:int,n:struct<y:array<array<float>>>>"
    assert dtypes.of_data_key("string").itemsize == 40 and str(dtypes.of_data_key("array")) == "<f8"


def test_structures():
    import pyarrow as pa

    f8 = dtypes.DType.parse("<f8").to_json()
    a = structures.from_json("array", {"data_type": f8, "shape": [10, 10], "chunks": [[5, 5], [10]], "dims": ["x", "y"], "resizable": [True, False]})
    assert (a.size(), a.nbytes(), a.strides(), a.resizable) == (100, 800, (80, 8), (True, False))
    assert structures.ArrayStructure(dtypes.DType.parse("<f8"), (), (3, 4, 5)).strides() == (160, 40, 8) and structures.ArrayStructure(None, (), ()).size() == 1
    s = structures.from_json("sparse", {"shape": [10, 10], "chunks": [[10], [10]]})
    assert s.data_type is None and str(s.coord_data_type) == "<u8"
    assert structures.from_json("awkward", {"length": 42, "form": {"class": "NumpyForm"}}).length == 42
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    t = structures.from_json("table", {"arrow_schema": structures.encode_schema(schema), "npartitions": 1, "columns": ["a", "b"]})
    assert t.schema == schema and structures.from_json("container", {"keys": ["x"]}) == ("x",)
    for family, bad in (("array", {"shape": [1]}), ("array", {"data_type": f8, "shape": [3], "chunks": [[2]]}), ("nope", {}), ("table", {"arrow_schema": "x", "npartitions": 1, "columns": []})):
        with pytest.raises(Validation):
            structures.from_json(family, bad)


def test_writing_one_block_keeps_its_neighbours(spark, tmp_path):
    where = str(tmp_path / "g")
    A.write_blocks(A.ramp(spark, "x", (4, 4), 1.0, (2, 2)), where)
    A.write_blocks(A.ramp(spark, "x", (4, 4), 10.0, (2, 2)).where("b0 = 1 and b1 = 1"), where)
    got = {(r["b0"], r["b1"]): r["data"][0] for r in spark.read.parquet(where).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 2.0, (1, 0): 8.0, (1, 1): 100.0}


def test_slice_parameters():
    assert ndslice.parse_parameter("1:3,4") == ndslice.parse("1:3, 4") and ndslice.is_empty(ndslice.parse_parameter("")) and not ndslice.is_empty(ndslice.parse(":"))
    for bad in ("1:3, 4", "...", "x"):
        with pytest.raises(InvalidSlice):
            ndslice.parse_parameter(bad)


def test_structures_are_written_and_read_back(spark):
    kind = dtypes.DType.parse("<f8")
    for family, own in (
        ("array", structures.ArrayStructure(kind, ((2, 1), (4,)), (3, 4), ("x", "y"))), ("table", structures.TableStructure(pa.schema([("a", pa.int64())]), 2, ("a",))),
        ("sparse", structures.SparseStructure((3,), ((3,),), None, kind)), ("awkward", structures.AwkwardStructure(4, {"class": "NumpyForm"})),
    ):
        assert structures.from_json(family, json.loads(json.dumps(structures.to_json(own)))) == own
    assert structures.to_json(None, 5) == {"contents": None, "count": 5}
    row = spark.range(1).select(structures.array_json(structures.dtype_column(kind), F.array(F.lit(3).cast("long")), F.array(F.lit("x"))).alias("d")).collect()[0]
    assert structures.from_json("array", json.loads(row["d"])) == structures.ArrayStructure(kind, ((3,),), (3,), ("x",))
