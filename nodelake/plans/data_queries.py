"""Arrays, tables and runs over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodelake.functions import ndslice
from nodelake.functions.structures import ArrayStructure
from nodelake.operators import arrays as A
from nodelake.operators import runs as R
from nodelake.operators import tables as B
from nodelake.plans.catalog_queries import table
from nodelake.sources import sinks
from nodelake.streaming import live

WIDTH, CHUNK = 64, (100, 16)


def event_rows(spark, sf_dir) -> DataFrame:
    """Line items as events: run = order, number = line, delivered at the ship date."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("descriptor"), F.col("l_linenumber").alias("seq_num"), F.col("l_shipdate").alias("time"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
    )


TIES = ("part", "supp", "quantity")


def run_rows(spark, sf_dir, of=R.runs) -> DataFrame:
    """Orders as runs; those with line items have a stop document."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderdate").alias("time"), F.to_variant_object(F.struct("o_orderstatus")).alias("doc"))
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    stop = counts.groupBy(F.col("l_orderkey").cast("string").alias("run_start")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_linestatus", "n")))).alias("num_events"))
    stop = stop.select("run_start", "num_events", F.to_variant_object(F.struct("run_start")).alias("doc"))
    return of(o, stop)


def start_stop(spark, sf_dir) -> DataFrame:
    found = run_rows(spark, sf_dir, R.stopped)
    return found.select(F.col("uid").cast("long").alias("uid"), F.col("stop").isNotNull().alias("stopped"), R.cutoff(F.col("num_events")).alias("cutoff"), R.stream_lengths(F.col("num_events"), F.lit("F")).alias("n_f"))


def descriptor_rows(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus").distinct()
    return keys.select(
        F.concat_ws(":", "l_orderkey", "l_linestatus").alias("uid"), F.col("l_orderkey").alias("run_start"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("name"),
        F.create_map(F.lit("quantity"), F.struct(F.lit("number").alias("dtype"), F.array().cast("array<bigint>").alias("shape"), F.lit(None).cast("string").alias("external"))).alias("data_keys"),
    )


def run_descriptor(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"))
    return R.descriptors(o, descriptor_rows(spark, sf_dir)).select("uid", "descriptor", "stream")


def group_streams(spark, sf_dir) -> DataFrame:
    found = R.descriptors(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid")), descriptor_rows(spark, sf_dir))
    return R.streams(found).select("uid", "stream", F.size("descriptors").cast("long").alias("n"), "first")


def event_semi(spark, sf_dir) -> DataFrame:
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("descriptor"))
    return R.events_of(event_rows(spark, sf_dir), some, below=4).select("descriptor", "seq_num", "part")


def missing_anti(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("datum_id"))
    datum = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("datum_id"), F.col("l_partkey").alias("resource")).distinct()
    resource = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"))
    return R.unresolved(ids, datum, resource)


def datum_resource(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("datum_id")).distinct()
    datum = part.select(F.col("p_partkey").alias("datum_id"), F.col("p_brand").alias("resource"), F.col("p_size").alias("datum_kwargs"))
    brands = part.select("p_brand").distinct()
    resource = brands.select(F.col("p_brand").alias("uid"), F.lit("npy").alias("spec"), F.lit("/data").alias("root"), F.concat("p_brand", F.lit(".npy")).alias("resource_path"), F.lit(None).alias("resource_kwargs"))
    return R.resolved(ids, datum, resource).select("datum_id", "resource", "resource_path", F.col("datum_kwargs").alias("frame"))


def latest_event(spark, sf_dir) -> DataFrame:
    return R.latest(event_rows(spark, sf_dir), ties=TIES, values=["part", "supp", "quantity"])


def latest_window(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("descriptor", "seq_num").orderBy(F.desc("time"), *[F.desc(t) for t in TIES])
    ranked = event_rows(spark, sf_dir).withColumn("r", F.row_number().over(w))
    return ranked.where("r = 1").select("descriptor", "seq_num", "part", "supp", "quantity")


def column_push(spark, sf_dir) -> DataFrame:
    column = R.pushed(latest_event(spark, sf_dir), ["descriptor"], "seq_num", "part")
    return column.select("descriptor", F.array_join(F.transform("column", lambda x: x.cast("string")), ",").alias("parts"))


def shape_product(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return n.select(A.element_count(F.array("n", F.lit(WIDTH).cast("long"))).alias("elements"), (A.element_count(F.array("n", F.lit(WIDTH).cast("long"))) * 4).alias("nbytes"))


def matrix(spark, sf_dir) -> DataFrame:
    """Cells of the embeddings as an array of two dimensions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    return e.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("value"))


def rows_of(spark, sf_dir) -> int:
    return table(spark, sf_dir, "embeddings").count()


def sliced(text: str, shape=(WIDTH,)):
    def run(spark, sf_dir):
        full = (rows_of(spark, sf_dir), *shape)
        cells = matrix(spark, sf_dir)
        if len(full) == 3:
            cells = cells.select("i0", F.floor(F.col("i1") / 8).cast("long").alias("i1"), (F.col("i1") % 8).alias("i2"), "value")
        return A.apply_slice(cells, ndslice.parse(text), full)[0]

    return run


def block_2d(spark, sf_dir) -> DataFrame:
    return A.cell_block(matrix(spark, sf_dir), A.grid((rows_of(spark, sf_dir), WIDTH), CHUNK), (1, 2))


def blocks_read(spark, sf_dir) -> DataFrame:
    """Cut into blocks, then read one back through the block form."""
    shape = (rows_of(spark, sf_dir), WIDTH)
    blocks = A.to_blocks(matrix(spark, sf_dir), "embeddings", shape, CHUNK)
    structure = ArrayStructure(None, A.grid(shape, CHUNK), shape)
    return A.cells(A.read_block(blocks, "embeddings", structure, (2, 3)), 2)


def blocks_slice(spark, sf_dir) -> DataFrame:
    shape = (rows_of(spark, sf_dir), WIDTH)
    blocks = A.to_blocks(matrix(spark, sf_dir), "embeddings", shape, CHUNK)
    return A.slice_blocks(blocks, ndslice.parse("120:310:7,-5:"), ArrayStructure(None, A.grid(shape, CHUNK), shape))[0]


def block_1d(spark, sf_dir) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), "value")
    return A.cell_block(cells, [[1000] * 5], (3,))


def coo(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("i0"), F.col("n_regionkey").cast("long").alias("i1"), (F.col("n_nationkey") + 1).cast("double").alias("value"))


def coo_block(spark, sf_dir) -> DataFrame:
    return A.cell_block(coo(spark, sf_dir), A.grid((25, 5), (10, 3)), (1, 0))


def coo_dense(spark, sf_dir) -> DataFrame:
    return A.dense(coo(spark, sf_dir), (25, 5))


def lists(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return R.pushed(c, ["conv_id"], "turn", "role", "roles").select(F.col("conv_id").alias("i0"), "roles")


def awkward_buffers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i0"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("buffers"))
    return A.awkward_buffers(c, ["segment"]).select("i0", F.explode("buffers").alias("form_key", "buffer"))


def all_places(spark, sf_dir) -> DataFrame:
    return matrix(spark, sf_dir).select("i0", "i1", A.ravel(2, (rows_of(spark, sf_dir), WIDTH)).alias("flat"))


def places(spark, sf_dir) -> DataFrame:
    """The first 50 rows of ``all_places``, as the query's SQL has it."""
    return all_places(spark, sf_dir).where("i0 < 50")


def partition_rows(fields):
    def run(spark, sf_dir):
        parts = B.partitioned(table(spark, sf_dir, "lineitem"), "l_orderkey", 8)
        return B.read_partition(parts, 3, B.fields_of(fields))

    return run


def stream_events(spark, sf_dir) -> DataFrame:
    """Events as a run for each user, with a stream for each type, numbered by time."""
    e = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.select(F.concat_ws(":", "user_id", "event_type").alias("descriptor"), number.alias("seq_num"), F.col("ts").alias("time"), F.parse_json("props").alias("data"), "event_id")


def stream_descriptors(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return keys.select(F.concat_ws(":", "user_id", "event_type").alias("descriptor"), F.col("user_id").alias("uid"), F.col("event_type").alias("stream"))


def time_column(spark, sf_dir) -> DataFrame:
    found = R.time_column(stream_events(spark, sf_dir), stream_descriptors(spark, sf_dir), ["event_id"])
    return found.select("uid", "stream", F.col("seq_num").cast("long").alias("seq_num"), "time")


def data_column(spark, sf_dir) -> DataFrame:
    found = R.data_column(stream_events(spark, sf_dir), stream_descriptors(spark, sf_dir), "k", "bigint", ["event_id"])
    return found.select("uid", "stream", F.col("seq_num").cast("long").alias("seq_num"), "value")


def external_flag(spark, sf_dir) -> DataFrame:
    kind = "map<string,struct<dtype:string,shape:array<bigint>,external:string>>"
    rows = [(1, "a", {"x": ("array", [2], "FILE:"), "t": ("number", [], None)}), (1, "a", {"x": ("array", [2], None), "u": ("string", [], None)})]
    return R.data_keys(spark.createDataFrame(rows, f"uid long, stream string, data_keys {kind}")).select("uid", "stream", "data_key", "external")


def runs_desc(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus")


def all_runs_desc(spark, sf_dir) -> DataFrame:
    """Every run by ``runs.runs``, newest first."""
    return run_rows(spark, sf_dir).select("uid", "time", "start", "stop")


def document_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    start = F.to_json(F.struct(F.lit("start").alias("name"), F.struct(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status")).alias("doc")))
    return o.select("o_orderkey", start.alias("line"))


def all_document_lines(spark, sf_dir) -> DataFrame:
    """Start, descriptors and stop of every run; ``part`` is 0, 1 or 2."""
    keys = descriptor_rows(spark, sf_dir).withColumn("run_start", F.col("run_start").cast("string"))
    return R.documents(run_rows(spark, sf_dir), keys).select("uid", "rank.part", "rank.stream", "rank.id", "line")


def csv_lines(spark, sf_dir) -> DataFrame:
    return sinks.csv_rows(coo_dense(spark, sf_dir), 2, F.col("value").cast("long").cast("string"))


def csv_cells(spark, sf_dir) -> DataFrame:
    """The default text of the cells, halved so that some have a fraction."""
    return sinks.csv_rows(coo_dense(spark, sf_dir).withColumn("value", F.col("value") / 2), 2)


def block_3d(spark, sf_dir) -> DataFrame:
    """Embeddings as a cube, cut into blocks; one is read back."""
    shape, chunk = (rows_of(spark, sf_dir), 8, 8), (100, 4, 8)
    cells = matrix(spark, sf_dir).select("i0", F.floor(F.col("i1") / 8).cast("long").alias("i1"), (F.col("i1") % 8).alias("i2"), "value")
    blocks = A.to_blocks(cells, "cube", shape, chunk)
    return A.cells(A.read_block(blocks, "cube", ArrayStructure(None, A.grid(shape, chunk), shape), (1, 1, 0)), 3)


def column_structures(spark, sf_dir) -> DataFrame:
    """Structures of a number, an image and the time of every stream of events."""
    found = stream_descriptors(spark, sf_dir)
    key = lambda dtype, shape: F.struct(F.lit(dtype).alias("dtype"), F.array(*map(F.lit, shape)).cast("array<bigint>").alias("shape"), F.lit(None).cast("string").alias("external"))
    keyed = found.withColumn("data_keys", F.create_map(F.lit("k"), key("integer", []), F.lit("image"), key("array", [2, 3]), F.lit("on"), key("boolean", [])))
    lengths = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("stream")).agg(F.count(F.lit(1)).alias("n"))
    return R.column_structures(R.data_keys(keyed), lengths)


def stream_documents(spark, sf_dir) -> DataFrame:
    keys = descriptor_rows(spark, sf_dir)
    return R.stream_metadata(R.descriptors(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid")), keys))


def filled_rows(spark, sf_dir) -> DataFrame:
    """Embeddings as values that were read from files: a run for each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("uid"), F.lit("s").alias("stream"), F.col("vec_id").alias("seq_num"), F.array(F.size("embedding").cast("long")).alias("shape"), F.col("embedding").cast("array<double>").alias("data"))


def filled_column(spark, sf_dir) -> DataFrame:
    data = F.col("data")
    found = R.concatenated(filled_rows(spark, sf_dir))
    return found.select("uid", F.size(data).cast("long").alias("n"), F.get(data, F.lit(0)).alias("first"), F.element_at(data, -1).alias("last"))


def filled_blocks(spark, sf_dir) -> DataFrame:
    return R.blocks_of(filled_rows(spark, sf_dir)).select("uid", F.col("b0").cast("long").alias("b0"), "off0", F.get("data", F.lit(0)).alias("first"))


def live_batch(spark, sf_dir) -> DataFrame:
    """The streaming rule on a table: the last event of each user and type in an hour."""
    e = table(spark, sf_dir, "events")
    found = live.latest(e.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", ["event_id", "value"])
    return found.select("window_start", "user_id", "event_type", "event_id", "value")


def live_counts(spark, sf_dir) -> DataFrame:
    return live.counts(table(spark, sf_dir, "events"), ["event_type"], "ts")


QUERIES = {
    "j_start_stop": start_stop,
    "j_run_descriptor": run_descriptor,
    "j_event_semi": event_semi,
    "j_missing_anti": missing_anti,
    "j_datum_resource": datum_resource,
    "a_latest_event": latest_event,
    "a_latest_window": latest_window,
    "a_column_push": column_push,
    "a_group_streams": group_streams,
    "a_shape_product": shape_product,
    "l_runs_desc": runs_desc,
    "l_runs_all": all_runs_desc,
    "n_read": matrix,
    "n_block1d": block_1d,
    "n_block2d": block_2d,
    "n_block3d": sliced("0:200,2:4,1:5", (8, 8)),
    "n_block3d_read": block_3d,
    "n_blocks_read": blocks_read,
    "n_blocks_slice": blocks_slice,
    "n_slice_step": sliced("10:200:7,::3"),
    "n_slice_neg": sliced("::-5,10:2:-2"),
    "n_slice_index": sliced("17,-1:"),
    "n_slice_ellipsis": sliced("...,-1"),
    "n_coo_block": coo_block,
    "n_coo_dense": coo_dense,
    "n_awkward_explode": lambda spark, sf_dir: A.awkward_elements(lists(spark, sf_dir), "roles").select("i0", F.col("i1").cast("long").alias("i1"), "value"),
    "n_awkward_counts": lambda spark, sf_dir: A.awkward_counts(lists(spark, sf_dir), "roles").select("i0", F.col("n").cast("long").alias("n")),
    "n_awkward_buffers": awkward_buffers,
    "n_strides": places,
    "n_strides_all": all_places,
    "r_partition": partition_rows(None),
    "r_partition_fields": partition_rows("l_orderkey, l_linenumber,l_quantity"),
    "r_time_column": time_column,
    "r_data_column": data_column,
    "r_external_flag": external_flag,
    "r_column_structures": column_structures,
    "r_stream_metadata": stream_documents,
    "r_filled_column": filled_column,
    "r_filled_blocks": filled_blocks,
    "s_documents_jsonl": document_lines,
    "s_documents_all": all_document_lines,
    "s_csv_rows": csv_lines,
    "s_csv_cells": csv_cells,
    "live_latest": live_batch,
    "live_counts": live_counts,
}

_MATRIX = "(SELECT vec_id AS i0, j AS i1, embedding[j + 1]::DOUBLE AS value FROM embeddings, range(0, 64) r(j)) m"
_N = "(SELECT count(*) FROM embeddings)"
_ORDER = "(l_shipdate, l_partkey, l_suppkey, l_quantity)"
_LATEST = f"""SELECT l_orderkey AS descriptor, l_linenumber AS seq_num, arg_max(l_partkey, {_ORDER}) AS part, arg_max(l_suppkey, {_ORDER}) AS supp, arg_max(l_quantity, {_ORDER}) AS quantity
FROM lineitem GROUP BY ALL"""
_STREAM = "(SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq_num FROM events) e"

ORACLES = {
    "j_start_stop": """SELECT o_orderkey AS uid, c.k IS NOT NULL AS stopped, coalesce(m + 1, 1)::BIGINT AS cutoff, coalesce(f, 0)::BIGINT AS n_f
FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(n) AS m, max(CASE WHEN l_linestatus = 'F' THEN n END) AS f FROM (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY k) c ON k = o_orderkey""",
    "j_run_descriptor": "SELECT DISTINCT o_orderkey AS uid, l_orderkey || ':' || l_linestatus AS descriptor, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'primary' END AS stream FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "j_event_semi": "SELECT l_orderkey AS descriptor, l_linenumber AS seq_num, l_partkey AS part FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber < 4 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')",
    "j_missing_anti": "SELECT o_orderkey AS datum_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey)",
    "j_datum_resource": "SELECT p_partkey AS datum_id, p_brand AS resource, p_brand || '.npy' AS resource_path, p_size AS frame FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "a_latest_event": _LATEST,
    "a_latest_window": _LATEST,
    "a_column_push": f"SELECT descriptor, string_agg(part::VARCHAR, ',' ORDER BY seq_num) AS parts FROM ({_LATEST}) GROUP BY descriptor",
    "a_group_streams": "SELECT l_orderkey AS uid, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'primary' END AS stream, count(DISTINCT l_linestatus) AS n, min(l_orderkey || ':' || l_linestatus) AS first FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "a_shape_product": "SELECT (count(*) * 64)::BIGINT AS elements, (count(*) * 64 * 4)::BIGINT AS nbytes FROM embeddings",
    "l_runs_desc": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "n_read": f"SELECT i0, i1, value FROM {_MATRIX}",
    "l_runs_all": """SELECT o_orderkey::VARCHAR AS uid, o_orderdate AS time, '{"o_orderstatus":"' || o_orderstatus || '"}' AS start,
CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN '{"run_start":"' || o_orderkey || '"}' END AS stop FROM orders ORDER BY o_orderdate DESC, uid""",
    "n_block1d": "SELECT event_id AS i0, value FROM events WHERE event_id >= 3000 AND event_id < 4000",
    "n_block2d": f"SELECT i0, i1, value FROM {_MATRIX} WHERE i0 >= 100 AND i0 < 200 AND i1 >= 32 AND i1 < 48",
    "n_block3d": f"SELECT i0, i1 // 8 - 2 AS i1, i1 % 8 - 1 AS i2, value FROM {_MATRIX} WHERE i0 < 200 AND i1 // 8 >= 2 AND i1 // 8 < 4 AND i1 % 8 >= 1 AND i1 % 8 < 5",
    "n_block3d_read": f"SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, value FROM {_MATRIX} WHERE i0 >= 100 AND i0 < 200 AND i1 // 8 >= 4",
    "r_column_structures": """SELECT user_id AS uid, event_type AS stream, data_key, '{"data_type":{"endianness":"' || o || '","kind":"' || kind || '","itemsize":' || size || ',"dt_units":null},"chunks":[[' || n || ']' || more || '],"shape":[' || n || rest || '],"dims":["time"' || dims || '],"resizable":false}' AS structure, spec
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), (VALUES ('k', 'little', 'f', 8, '', '', '', 'xarray_data_var'), ('image', 'little', 'f', 8, ',[2],[3]', ',2,3', ',"dim_0","dim_1"', 'xarray_data_var'), ('on', 'not_applicable', 'b', 1, '', '', '', 'xarray_data_var'), ('time', 'little', 'f', 8, '', '', '', 'xarray_coord')) k(data_key, o, kind, size, more, rest, dims, spec)""",
    "r_stream_metadata": """SELECT l_orderkey AS uid, stream, '{"stream_name":"' || stream || '","descriptors":[' || string_agg('{"uid":"' || id || '","run_start":' || l_orderkey || ',"name":"' || stream || '","data_keys":{"quantity":{"dtype":"number","shape":[]}}}', ',' ORDER BY id) || ']}' AS metadata
FROM (SELECT DISTINCT l_orderkey, l_orderkey || ':' || l_linestatus AS id, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'primary' END AS stream FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY l_orderkey, stream""",
    "r_filled_column": "SELECT label AS uid, (count(*) * 64)::BIGINT AS n, arg_min(embedding[1]::DOUBLE, vec_id) AS first, arg_max(embedding[64]::DOUBLE, vec_id) AS last FROM embeddings GROUP BY label",
    "r_filled_blocks": "SELECT label AS uid, row_number() OVER w - 1 AS b0, (row_number() OVER w - 1) * 64 AS off0, embedding[1]::DOUBLE AS first FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)",
    "s_csv_cells": "SELECT i AS i0, string_agg(regexp_replace((coalesce(n_nationkey + 1, 0) / 2)::VARCHAR, '\\.0$', ''), ',' ORDER BY j) AS line FROM range(0, 25) a(i) CROSS JOIN range(0, 5) b(j) LEFT JOIN nation ON n_nationkey = i AND n_regionkey = j GROUP BY i",
    "n_blocks_read": f"SELECT i0, i1, value FROM {_MATRIX} WHERE i0 >= 200 AND i0 < 300 AND i1 >= 48",
    "n_blocks_slice": f"SELECT (i0 - 120) // 7 AS i0, i1 - 59 AS i1, value FROM {_MATRIX} WHERE i0 >= 120 AND i0 < 310 AND (i0 - 120) % 7 = 0 AND i1 >= 59",
    "n_slice_step": f"SELECT (i0 - 10) // 7 AS i0, i1 // 3 AS i1, value FROM {_MATRIX} WHERE i0 >= 10 AND i0 < 200 AND (i0 - 10) % 7 = 0 AND i1 % 3 = 0",
    "n_slice_neg": f"SELECT ({_N} - 1 - i0) // 5 AS i0, (10 - i1) // 2 AS i1, value FROM {_MATRIX} WHERE ({_N} - 1 - i0) % 5 = 0 AND i1 IN (10, 8, 6, 4)",
    "n_slice_index": f"SELECT i1 - 63 AS i0, value FROM {_MATRIX} WHERE i0 = 17 AND i1 = 63",
    "n_slice_ellipsis": f"SELECT i0, value FROM {_MATRIX} WHERE i1 = 63",
    "n_coo_block": "SELECT n_nationkey::BIGINT AS i0, n_regionkey::BIGINT AS i1, (n_nationkey + 1)::DOUBLE AS value FROM nation WHERE n_nationkey >= 10 AND n_nationkey < 20 AND n_regionkey < 3",
    "n_coo_dense": "SELECT i AS i0, j AS i1, coalesce(n_nationkey + 1, 0)::DOUBLE AS value FROM range(0, 25) a(i) CROSS JOIN range(0, 5) b(j) LEFT JOIN nation ON n_nationkey = i AND n_regionkey = j",
    "n_awkward_explode": "SELECT conv_id AS i0, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i1, role AS value FROM conversations WHERE role IS NOT NULL",
    "n_awkward_counts": "SELECT conv_id AS i0, count(*) AS n FROM conversations GROUP BY conv_id",
    "n_awkward_buffers": "SELECT c_custkey AS i0, 'segment' AS form_key, c_mktsegment AS buffer FROM customer",
    "n_strides": f"SELECT i0, i1, i0 * 64 + i1 AS flat FROM {_MATRIX} WHERE i0 < 50",
    "n_strides_all": f"SELECT i0, i1, i0 * 64 + i1 AS flat FROM {_MATRIX}",
    "r_partition": "SELECT * FROM lineitem WHERE l_orderkey % 8 = 3",
    "r_partition_fields": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 8 = 3",
    "r_time_column": f"SELECT user_id AS uid, event_type AS stream, seq_num, ts AS time FROM {_STREAM}",
    "r_data_column": f"SELECT user_id AS uid, event_type AS stream, seq_num, json_extract(props, '$.k')::BIGINT AS value FROM {_STREAM}",
    "r_external_flag": "SELECT * FROM (VALUES (1::BIGINT, 'a', 'x', true), (1, 'a', 't', false), (1, 'a', 'u', false)) t(uid, stream, data_key, external)",
    "s_documents_jsonl": """SELECT o_orderkey, '{"name":"start","doc":{"uid":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}' AS line FROM orders""",
    "s_documents_all": """SELECT o_orderkey::VARCHAR AS uid, 0 AS part, '' AS stream, '' AS id, '{"name":"start","doc":{"o_orderstatus":"' || o_orderstatus || '"}}' AS line FROM orders
UNION ALL SELECT l_orderkey::VARCHAR, 1, stream, id, '{"name":"descriptor","doc":{"uid":"' || id || '","run_start":"' || l_orderkey || '","name":"' || stream || '","data_keys":{"quantity":{"dtype":"number","shape":[]}}}}'
FROM (SELECT DISTINCT l_orderkey, l_orderkey || ':' || l_linestatus AS id, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'primary' END AS stream FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
UNION ALL SELECT o_orderkey::VARCHAR, 2, '', '', '{"name":"stop","doc":{"run_start":"' || o_orderkey || '"}}' FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "s_csv_rows": "SELECT i AS i0, string_agg(coalesce(n_nationkey + 1, 0)::VARCHAR, ',' ORDER BY j) AS line FROM range(0, 25) a(i) CROSS JOIN range(0, 5) b(j) LEFT JOIN nation ON n_nationkey = i AND n_regionkey = j GROUP BY i",
    "live_latest": """SELECT date_trunc('hour', ts) AS window_start, user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3""",
    "live_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
