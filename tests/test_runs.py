import io
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nodelake.errors import NotFound, Unsupported, Validation
from nodelake.operators import arrays as A
from nodelake.operators import runs as R
from nodelake.operators import tables as B
from nodelake.sources import files, sinks
from nodelake.streaming import live

from .conftest import rows


def variant(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.parse_json(c))
    return df


@pytest.fixture(scope="module")
def model(spark):
    start = variant(spark.createDataFrame([("r1", 1.0, '{"a":1}'), ("r2", 2.0, "{}"), ("", 3.0, "{}")], "uid string, time double, doc string"), "doc")
    stop = variant(spark.createDataFrame([("r1", {"primary": 3, "base": 1}, '{"ok":true}'), ("r1", {"primary": 3, "base": 1}, '{"ok":true}')], "run_start string, num_events map<string,bigint>, doc string"), "doc")
    keys = "map<string,struct<dtype:string,shape:array<bigint>,external:string>>"
    descriptor = spark.createDataFrame(
        [("d1", "r1", None, {"x": ("number", [], None), "img": ("array", [2, 2], "FILE:")}), ("d2", "r1", "base", {"y": ("string", [], None)}), ("d3", "r1", None, {"x2": ("boolean", [], None)})],
        f"uid string, run_start string, name string, data_keys {keys}",
    )
    event = variant(
        spark.createDataFrame(
            [("d1", 1, 1.0, '{"x":1.5,"img":"i0"}'), ("d1", 2, 2.0, '{"x":2,"img":"i1"}'), ("d1", 2, 5.0, '{"x":9,"img":"i1"}'), ("d1", 0, 9.0, "{}"), ("d3", 3, 1.0, '{"x":"no"}'), ("d2", 1, 1.0, '{"y":"s"}')],
            "descriptor string, seq_num long, time double, data string",
        ),
        "data",
    )
    return start, stop, descriptor, event


def test_runs_and_streams(model):
    start, stop, descriptor, event = model
    found = R.runs(start, stop)
    assert [(r["uid"], r["stop"]) for r in found.collect()] == [("r2", None), ("r1", '{"ok":true}')]
    assert rows(found.select("uid", R.cutoff(F.col("num_events")).alias("c"), R.stream_lengths(F.col("num_events"), F.lit("base")).alias("b"))) == [("r1", 4, 1), ("r2", 1, 0)]
    own = R.descriptors(found, descriptor)
    assert rows(R.streams(own).select("stream", "descriptors")) == [("base", ["d2"]), ("primary", ["d1", "d3"])]
    assert rows(R.data_keys(own).select("stream", "data_key", "external")) == [("base", "y", False), ("primary", "img", True), ("primary", "x", False), ("primary", "x2", False)]
    assert json.loads(rows(R.run_metadata(found))[0][1]) == {"start": {"a": 1}, "stop": {"ok": True}}
    lines = [json.loads(r["line"])["name"] for r in R.documents(found, descriptor).where("uid = 'r1'").orderBy("rank").collect()]
    assert lines == ["start", "descriptor", "descriptor", "descriptor", "stop"]


def test_latest_and_columns(model):
    start, stop, descriptor, event = model
    own = R.descriptors(R.runs(start, stop), descriptor)
    some = R.events_of(event, own, below=4)
    assert rows(R.data_column(some, own, "x").where("stream = 'primary'")) == [("r1", "primary", 1, 1.5), ("r1", "primary", 2, 9.0), ("r1", "primary", 3, None)]
    assert rows(R.time_column(some, own).where("stream = 'primary'").select("seq_num", "time")) == [(1, 1.0), (2, 5.0), (3, 1.0)]
    assert rows(R.pushed(R.time_column(some, own), ["stream"], "seq_num", "time")) == [("base", [1.0]), ("primary", [1.0, 5.0, 1.0])]


def test_equal_times_go_by_the_tie_break(spark):
    e = spark.createDataFrame([("d", 1, 1.0, "b"), ("d", 1, 1.0, "a")], "descriptor string, seq_num long, time double, v string")
    assert rows(R.latest(e, ties=["v"]).select("v")) == [("b",)] and R.latest(e.limit(0)).count() == 0


def test_filling_from_files(spark, model, tmp_path):
    start, stop, descriptor, event = model
    for i in range(2):
        np.save(tmp_path / f"img_{i}.npy", np.asfortranarray(np.arange(4).reshape(2, 2) + 10 * i))
    own = R.descriptors(R.runs(start, stop), descriptor)
    resource = variant(spark.createDataFrame([("res", "NPY_SEQ", "/old", "img", "{}")], "uid string, spec string, root string, resource_path string, resource_kwargs string"), "resource_kwargs")
    datum = variant(spark.createDataFrame([("i0", "res", '{"index":0}'), ("i1", "res", '{"point_number":1}')], "datum_id string, resource string, datum_kwargs string"), "datum_kwargs")
    handlers = files.Handlers({"/old": str(tmp_path)})
    got = R.external_column(event, own, "img", datum, resource, handlers)
    assert rows(got.select("seq_num", "shape", "data")) == [(1, [2, 2], [0.0, 1.0, 2.0, 3.0]), (2, [2, 2], [10.0, 11.0, 12.0, 13.0])]
    with pytest.raises(NotFound):
        R.external_column(event, own, "img", datum.where("datum_id = 'i0'"), resource, handlers)
    with pytest.raises(Validation):
        R.external_column(event, own, "img", datum, resource.withColumn("spec", F.lit("nope")), handlers)
    with pytest.raises(Unsupported):
        files.needs("no_such_library")
    assert handlers.specs() == ["AD_HDF5", "AD_TIFF", "NPY_SEQ", "npy"]


def test_npy_types(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2, 3]], ">i2"))
    np.save(tmp_path / "b.npy", np.float32(2.5))
    got = {r["path"].rsplit("/", 1)[1]: (list(r["shape"]), list(r["data"])) for r in files.read_npy(spark, [str(tmp_path / "a.npy"), str(tmp_path / "b.npy")]).collect()}
    assert got == {"a.npy": ([1, 3], [1, 2, 3]), "b.npy": ([], [2.5])}


def test_config_and_uri():
    doc = files.load_config('{"trees": [{"tree": "demo"}, {"tree": "run-catalog", "path": "/"}], "authentication": {"k": 1}}')
    assert doc["catalog"]["path"] == "/" and doc["authentication"] == {"k": 1}
    assert files.database_of("store://h:1/db?x=1") == "db"
    for bad in (lambda: files.database_of("store://h"), lambda: files.load_config("[]")):
        with pytest.raises(Validation):
            bad()


def test_tables(spark, tmp_path):
    t = B.partitioned(spark.range(8).withColumn("v", F.col("id") * 2), "id", 3)
    assert rows(B.read_partition(t, 1)) == [(1, 2), (4, 8), (7, 14)] and B.read_partition(t, 1, B.fields_of(" v ")).columns == ["v"]
    for bad in (lambda: B.read(t, ["nope"]), lambda: B.read_partition(t, -1)):
        with pytest.raises(Validation):
            bad()
    B.write(t, str(tmp_path / "t"))
    B.write_partition(spark.createDataFrame([(100, 1)], "id long, v long"), str(tmp_path / "t"), 1)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert rows(B.read_partition(back, 1)) == [(100, 1)] and back.count() == 6
    plan = B.read_partition(back, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan


def test_sinks(spark, tmp_path):
    blocks = A.ramp(spark, "x", (2, 3), 0.5)
    assert np.array_equal(np.frombuffer(sinks.array_bytes(blocks), "<f8"), np.arange(6) * 0.5)
    assert rows(sinks.csv_rows(A.cells(blocks, 2), 2)) == [(0, "0,0.5,1"), (1, "1.5,2,2.5")]
    sinks.write_csv(A.cells(blocks, 2), 2, str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["0,0.5,1", "1.5,2,2.5"]
    assert pa.ipc.open_file(io.BytesIO(sinks.table_bytes(spark.range(3)))).read_all().num_rows == 3
    sinks.write_json_lines(sinks.json_lines(spark.range(2)), str(tmp_path / "j"), "gzip")
    assert rows(spark.read.json(str(tmp_path / "j"))) == [(0,), (1,)]
    assert pa.ipc.open_file(io.BytesIO(sinks.sparse_file(A.cells(blocks, 2), 2))).read_all().num_rows == 6
    packed = sinks.sparse_bytes(A.cells(blocks, 2), 2)
    assert np.frombuffer(packed[:96], "<u8").tolist() == [0, 0, 0, 1, 1, 1, 0, 1, 2, 0, 1, 2] and np.frombuffer(packed[96:], "<f8").tolist() == [0, 0.5, 1, 1.5, 2, 2.5]
    with pytest.raises(NotFound):
        sinks.array_bytes(blocks.limit(0))


def test_live_stream_agrees_with_the_table(spark, tmp_path):
    rows_ = [("a", "2024-01-01 00:00:01", 1), ("a", "2024-01-01 00:00:05", 2), ("b", "2024-01-01 00:10:00", 3)]
    table = spark.createDataFrame(rows_, "k string, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = live.latest(stream, ["k"], "t", ["v"]).writeStream.outputMode("update").format("memory").queryName("latest_live").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows(spark.table("latest_live").select("k", "v")) == rows(live.latest(table, ["k"], "t", ["v"]).select("k", "v")) == [("a", 2), ("b", 3)]


def test_number_text(spark):
    given = {0.0: "0", 1e-12: "0.000000000001", 1e30: "1" + "0" * 30, 0.1: "0.1", 123456.789: "123456.789", -1.5: "-1.5", 100.0: "100", 1.5e-5: "0.000015", 1.25e10: "12500000000", float("inf"): "inf", float("-inf"): "-inf"}
    frame = spark.createDataFrame([(k,) for k in [*given, -0.0, float("nan"), None]], "v double")
    assert [r[0] for r in frame.select(sinks.number_text(F.col("v"))).collect()] == [*given.values(), "-0", "NaN", None]


def test_blocks_of_filled_values(spark):
    filled = spark.createDataFrame([("r", "s", 2, [1, 2], [3.0, 4.0]), ("r", "s", 1, [2, 2], [0.0, 0.5, 1.0, 2.0]), ("q", "s", 1, [], [7.0])], "uid string, stream string, seq_num long, shape array<bigint>, data array<double>")
    assert rows(R.concatenated(filled)) == [("q", "s", [7.0]), ("r", "s", [0.0, 0.5, 1.0, 2.0, 3.0, 4.0])]
    assert rows(R.blocks_of(filled).select("uid", "b0", "off0")) == [("q", 0, 0), ("r", 0, 0), ("r", 1, 2)]


def test_unknown_specs_are_an_error(spark):
    many = spark.range(1200).select(F.col("id").cast("string").alias("datum_id"), F.concat(F.lit("spec"), "id").alias("spec"))
    with pytest.raises(Validation):
        files.Handlers().fill(many)
