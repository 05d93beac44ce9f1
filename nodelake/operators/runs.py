"""Experiment runs from their documents: runs, streams, columns, and values kept in outside files.

run_start (uid, time, doc), run_stop (run_start, num_events, doc), descriptor (uid, run_start, name,
data_keys), event (descriptor, seq_num, time, data), resource and datum. An event that is delivered
again with the same number replaces the earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodelake.errors import NotFound
from nodelake.functions import dtypes, structures

PRIMARY = "primary"


def stopped(run_start: DataFrame, run_stop: DataFrame) -> DataFrame:
    """Runs with their stop documents (null without one), in no order; empty ids are left out.

    Of several stop documents of a run, the one with the least text is taken, so that reruns agree.
    """
    text, counts = F.to_json("doc"), F.to_json("num_events")
    stop = run_stop.groupBy(F.col("run_start").alias("uid")).agg(F.min(text).alias("stop"), F.min_by("num_events", F.struct(text, counts)).alias("num_events"))
    start = run_start.where(F.col("uid") != "").select("uid", "time", F.to_json("doc").alias("start"))
    return start.join(stop, "uid", "left")


def runs(run_start: DataFrame, run_stop: DataFrame) -> DataFrame:
    """``stopped``, newest first."""
    return stopped(run_start, run_stop).orderBy(F.desc("time"), "uid")


def cutoff(num_events: Column) -> Column:
    """One past the last event number of the longest stream; 1 without a stop document."""
    return F.coalesce(F.array_max(F.map_values(num_events)) + 1, F.lit(1).cast("long"))


def stream_lengths(num_events: Column, stream: Column) -> Column:
    """The number of events of one stream; 0 where it is not known."""
    return F.coalesce(F.try_element_at(num_events, stream), F.lit(0).cast("long"))


def descriptors(run_uids: DataFrame, descriptor: DataFrame) -> DataFrame:
    """Descriptors of runs (a column ``uid``), with their stream's name."""
    own = descriptor.select(F.col("uid").alias("descriptor"), F.col("run_start").alias("uid"), F.coalesce("name", F.lit(PRIMARY)).alias("stream"), "data_keys")
    return run_uids.select("uid").join(own, "uid")


def streams(found: DataFrame, order: str = "descriptor") -> DataFrame:
    """(uid, stream, descriptors, first): a run's streams, by the first descriptor of each."""
    return found.groupBy("uid", "stream").agg(F.sort_array(F.collect_list(order)).alias("descriptors"), F.min(order).alias("first"))


def data_keys(found: DataFrame) -> DataFrame:
    """(uid, stream, data_key, dtype, shape, external): keys of all descriptors of a stream, not of one."""
    each = found.select("uid", "stream", F.explode("data_keys").alias("data_key", "v"))
    return each.groupBy("uid", "stream", "data_key").agg(F.min("v.dtype").alias("dtype"), F.min("v.shape").alias("shape"), F.max(F.col("v.external").isNotNull()).alias("external"))


def events_of(event: DataFrame, found: DataFrame, below: int | None = None) -> DataFrame:
    """Events of given descriptors with numbers from 1 (and under ``below``)."""
    inside = F.col("seq_num") >= 1
    if below is not None:
        inside = inside & (F.col("seq_num") < below)
    return event.where(inside).join(found.select("descriptor").distinct(), "descriptor", "left_semi")


def latest(event: DataFrame, keys: Sequence[str] = ("descriptor", "seq_num"), time: str = "time", ties: Sequence[str] = (), values: Sequence[str] | None = None) -> DataFrame:
    """Of the events with one number, the last by time; ``ties`` decide between equal times."""
    values = list(values) if values is not None else [c for c in event.columns if c not in keys]
    last = event.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(time, *ties)).alias("last"))
    return last.select(*keys, "last.*")


def pushed(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str = "column") -> DataFrame:
    """One list of values in order for each group."""
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["v"]).alias(name))


def time_column(event: DataFrame, found: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """(uid, stream, seq_num, time) of the latest events of each number in a stream."""
    named = event.join(found.select("descriptor", "uid", "stream"), "descriptor")
    return latest(named, ("uid", "stream", "seq_num"), ties=(*ties, "descriptor"), values=["time"])


def data_column(event: DataFrame, found: DataFrame, data_key: str, kind: str = "double", ties: Sequence[str] = ()) -> DataFrame:
    """(uid, stream, seq_num, value) of a data key, with its own type; null where it is missing or of another."""
    value = F.try_variant_get("data", f'$["{data_key}"]', kind)
    named = event.join(found.select("descriptor", "uid", "stream"), "descriptor").withColumn("value", value)
    return latest(named, ("uid", "stream", "seq_num"), ties=(*ties, "descriptor"), values=["value"])


def resolved(datum_ids: DataFrame, datum: DataFrame, resource: DataFrame) -> DataFrame:
    """datum_id -> its resource and keywords; a datum or resource that is not there is an error when filled."""
    files = resource.select(F.col("uid").alias("resource"), "spec", "root", "resource_path", "resource_kwargs")
    return datum_ids.join(datum.select("datum_id", "resource", "datum_kwargs"), "datum_id").join(files, "resource")


def unresolved(datum_ids: DataFrame, datum: DataFrame, resource: DataFrame) -> DataFrame:
    """The ids that lead to no file."""
    whole = datum.join(resource.select(F.col("uid").alias("resource")), "resource", "left_semi")
    return datum_ids.join(whole.select("datum_id"), "datum_id", "left_anti")


def filled(datum_ids: DataFrame, datum: DataFrame, resource: DataFrame, registry) -> DataFrame:
    """(datum_id, shape, data) of every id, read by the handler of its resource's spec."""
    missing = unresolved(datum_ids.select("datum_id"), datum, resource).limit(5).collect()
    if missing:
        raise NotFound(f"no file for {[r[0] for r in missing]}")
    return registry.fill(resolved(datum_ids.select("datum_id").distinct(), datum, resource))


def blocks_of(filled_column: DataFrame) -> DataFrame:
    """A filled column as blocks of one array for each (uid, stream): one block an event, in order, joined along
    the first dimension (a value without dimensions counts as one row). The array itself is never in one task."""
    size = F.when(F.size("shape") > 0, F.get("shape", F.lit(0))).otherwise(F.lit(1).cast("long"))
    w = Window.partitionBy("uid", "stream").orderBy("seq_num")
    first = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return filled_column.select("uid", "stream", (F.row_number().over(w) - 1).alias("b0"), first.alias("off0"), "shape", "data")


def concatenated(filled_column: DataFrame) -> DataFrame:
    """(uid, stream, data): the values of a filled column end to end, in order of the events; for columns that
    one answer may hold (``blocks_of`` for others)."""
    return pushed(filled_column, ["uid", "stream"], "seq_num", "data", "parts").select("uid", "stream", F.flatten("parts").alias("data"))


def column_structures(keys: DataFrame, lengths: DataFrame) -> DataFrame:
    """(uid, stream, data_key, structure, spec): the array structure, as JSON text, of each column of a stream.

    ``keys`` is what ``data_keys`` gives, ``lengths`` has (uid, stream, n). Every stream has a ``time`` column.
    """
    kind = F.lit(None)
    for declared, own in dtypes.DECLARED.items():
        kind = F.when(F.col("dtype") == declared, structures.dtype_column(own)).otherwise(kind)
    kind = F.coalesce(kind, structures.dtype_column(dtypes.of_data_key("number")))
    inner = F.coalesce("shape", F.array().cast("array<bigint>"))
    dims = F.concat(F.array(F.lit("time")), F.transform(inner, lambda _, i: F.concat(F.lit("dim_"), i.cast("string"))))
    data = keys.join(lengths, ["uid", "stream"]).select("uid", "stream", "data_key", structures.array_json(kind, F.concat(F.array("n"), inner), dims).alias("structure"), F.lit("xarray_data_var").alias("spec"))
    time = structures.array_json(structures.dtype_column(dtypes.of_data_key("number")), F.array("n"), F.array(F.lit("time")))
    return data.union(lengths.select("uid", "stream", F.lit("time"), time, F.lit("xarray_coord")))


def stream_metadata(found: DataFrame) -> DataFrame:
    """(uid, stream, metadata): {stream_name, descriptors} as JSON text, descriptors by id."""
    doc = F.to_json(F.struct(F.col("descriptor").alias("uid"), F.col("uid").alias("run_start"), F.col("stream").alias("name"), "data_keys"))
    listed = found.groupBy("uid", "stream").agg(F.sort_array(F.collect_list(F.struct("descriptor", doc.alias("doc")))).alias("docs"))
    name = F.to_json(F.struct(F.col("stream").alias("stream_name")))
    text = F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit(',"descriptors":['), F.array_join(F.transform("docs", lambda d: d["doc"]), ","), F.lit("]}"))
    return listed.select("uid", "stream", text.alias("metadata"))


def external_column(event: DataFrame, found: DataFrame, data_key: str, datum: DataFrame, resource: DataFrame, registry, ties: Sequence[str] = ()) -> DataFrame:
    """(uid, stream, seq_num, shape, data) of a data key whose values are datum ids."""
    ids = data_column(event, found, data_key, "string", ties).withColumnRenamed("value", "datum_id").where("datum_id is not null")
    return ids.join(filled(ids, datum, resource, registry), "datum_id").select("uid", "stream", "seq_num", "shape", "data")


def run_metadata(found: DataFrame) -> DataFrame:
    """(uid, metadata): {start, stop} as JSON text, stop null where there is none."""
    text = F.concat(F.lit('{"start":'), "start", F.lit(',"stop":'), F.coalesce("stop", F.lit("null")), F.lit("}"))
    return found.select("uid", text.alias("metadata"))


def documents(found: DataFrame, descriptor: DataFrame) -> DataFrame:
    """(uid, rank, line): a run's documents as JSON lines: start, the descriptors by stream, stop."""
    line = lambda name, doc: F.concat(F.lit(f'{{"name":"{name}","doc":'), doc, F.lit("}"))
    start = found.select("uid", F.struct(F.lit(0).alias("part"), F.lit("").alias("stream"), F.lit("").alias("id")).alias("rank"), line("start", F.col("start")).alias("line"))
    own = descriptors(found, descriptor)
    doc = F.to_json(F.struct(F.col("descriptor").alias("uid"), F.col("uid").alias("run_start"), F.col("stream").alias("name"), "data_keys"))
    middle = own.select("uid", F.struct(F.lit(1).alias("part"), "stream", F.col("descriptor").alias("id")).alias("rank"), line("descriptor", doc).alias("line"))
    stop = found.where("stop is not null").select("uid", F.struct(F.lit(2).alias("part"), F.lit("").alias("stream"), F.lit("").alias("id")).alias("rank"), line("stop", F.col("stop")).alias("line"))
    return start.unionByName(middle).unionByName(stop)
