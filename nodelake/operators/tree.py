"""Walking, searching and paging a node table."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.errors import NotFound, Validation
from nodelake.operators.predicates import KINDS, Context, Predicate, all_of

PAGE, PAGE_MOST, DEPTH_MOST = 100, 300, 5
ENTRY_FIELDS = ("metadata", "structure", "structure_family", "specs", "data_sources", "count", "sorting", "none")


def clean(path: str) -> str:
    """Without leading, trailing or doubled slashes."""
    return "/".join(p for p in path.split("/") if p)


def walk(nodes: DataFrame, path: str) -> DataFrame:
    """The one row of a path. Full paths are stored, so this is a filter, not a descent."""
    found = nodes.where(F.col("path") == clean(path))
    if found.isEmpty():
        raise NotFound(f"no node at {path!r}")
    return found


def container(nodes: DataFrame, path: str) -> str:
    """The clean path of a container; an error if it is another family. The root need not be a row."""
    path = clean(path)
    family = [r[0] for r in nodes.where(F.col("path") == path).select("family").limit(1).collect()]
    if not family and path:
        raise NotFound(f"no node at {path!r}")
    if family and family[0] != "container":
        raise Validation(f"{path!r} is {family[0]}, not a container")
    return path


def ancestors(path: Column) -> Column:
    """``a/b/c`` -> ["", "a", "a/b"]; the root has none."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(ups)


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("parent") == clean(path)) & (F.col("path") != ""))


def child(nodes: DataFrame, path: str, key: str) -> DataFrame:
    return children(nodes, path).where(F.col("key") == key)


def subtree(nodes: DataFrame, path: str, depth: int = DEPTH_MOST) -> DataFrame:
    """The nodes under a path, at most ``depth`` levels down."""
    path = clean(path)
    under = F.col("path").startswith(f"{path}/") if path else F.col("path") != ""
    level = path.count("/") + 1 if path else 0
    return nodes.where(under & (F.col("depth") <= level + min(depth, DEPTH_MOST)))


def search(nodes: DataFrame, path: str, predicates: Iterable[Predicate] = (), ctx: Context | None = None) -> DataFrame:
    """The children of a container that meet all predicates."""
    condition = all_of(predicates, ctx)
    found = children(nodes, path)
    return found if condition is None else found.where(condition)


def ordered(found: DataFrame, sorting: Iterable[tuple[str, int]] = (("_", 1),), ctx: Context | None = None) -> DataFrame:
    """By metadata keys (or ``_``, the order of insertion) up (1) or down (-1); the position breaks ties."""
    ctx, by = ctx or Context(), []
    for key, direction in sorting:
        if direction not in (1, -1):
            raise Validation(f"a direction is 1 or -1, not {direction!r}")
        if key == "_":
            values = [F.col("pos")]
        elif key in ctx.promoted:
            values = [F.col(ctx.promoted[key])]
        else:
            values = [ctx.typed(key, "double"), ctx.typed(key, "string")]
        by += [v.asc_nulls_last() if direction == 1 else v.desc_nulls_last() for v in values]
    return found.orderBy(*by, F.col("pos"))


def page(found: DataFrame, offset: int = 0, limit: int = PAGE, sorting=(("_", 1),), ctx: Context | None = None) -> DataFrame:
    """Rows offset .. offset + limit of a search, in order."""
    if offset < 0 or limit < 1:
        raise Validation("an offset is at least 0 and a limit at least 1")
    return ordered(found, sorting, ctx).offset(offset).limit(min(limit, PAGE_MOST))


def page_links(offset: Column, limit: Column, count: Column, base_url: str = "", route: str = "search", path: str = "") -> dict[str, Column]:
    """Columns self, first, last, next and prev (null where there is no such page)."""
    top = f"{base_url.rstrip('/')}/api/v1/{route}/{path.lstrip('/')}"
    url = lambda o: F.concat(F.lit(f"{top}?page[offset]="), o.cast("string"), F.lit("&page[limit]="), limit.cast("string"))
    last = F.when(count > 0, F.floor((count - 1) / limit) * limit).otherwise(F.lit(0))
    return {
        "self": url(offset),
        "first": url(F.lit(0)),
        "last": url(last),
        "next": F.when(offset + limit < count, url(offset + limit)),
        "prev": F.when(offset > 0, url(F.greatest(offset - limit, F.lit(0)))),
    }


def node_links(base_url: str = "") -> Column:
    """A map of link names to addresses, by family."""
    top, path, family = f"{base_url.rstrip('/')}/api/v1", F.col("path"), F.col("family")
    to = lambda route: F.concat(F.lit(f"{top}/{route}/"), path)
    by_family = (
        F.when(family == "container", F.create_map(F.lit("search"), to("search"), F.lit("full"), to("search")))
        .when(family.isin("array", "sparse"), F.create_map(F.lit("full"), to("array/full"), F.lit("block"), to("array/block")))
        .when(family == "table", F.create_map(F.lit("full"), to("table/full"), F.lit("partition"), to("table/partition")))
        .when(family == "awkward", F.create_map(F.lit("full"), to("awkward/full"), F.lit("buffers"), to("awkward/buffers")))
    )
    return F.map_concat(F.create_map(F.lit("self"), to("metadata")), by_family)


def child_counts(nodes: DataFrame) -> DataFrame:
    """(parent, n): the number of children of each container that has any."""
    return nodes.where(F.col("path") != "").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def match_count(found: DataFrame) -> DataFrame:
    """One row: the number of matches of a search."""
    return found.agg(F.count(F.lit(1)).alias("n"))


def with_keys(found: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """The nodes whose key is in a table of keys of any length (``KeysFilter`` is for a few)."""
    return found.join(keys.select(F.col(key_col).alias("key")), "key", "left_semi")


def resources(found: DataFrame, base_url: str = "", fields: Iterable[str] = ("metadata", "structure", "structure_family", "specs", "sorting"), nodes: DataFrame | None = None) -> DataFrame:
    """id, attributes (JSON text of the chosen fields and the ancestors) and links of each node.

    ``count`` is the number of a container's children, counted in ``nodes`` (left out without it, and for other
    families); ``data_sources`` is a column of that name, or empty where there is none.
    """
    fields = list(fields)
    unknown = set(fields) - set(ENTRY_FIELDS)
    if unknown:
        raise Validation(f"no such fields: {sorted(unknown)}")
    columns = {
        "metadata": F.col("metadata"),
        "structure": F.col("structure"),
        "structure_family": F.col("family"),
        "specs": F.col("specs"),
        "sorting": F.array(F.struct(F.lit("_").alias("key"), F.lit(1).alias("direction"))),
        "data_sources": F.col("data_sources") if "data_sources" in found.columns else F.array().cast("array<string>"),
        "count": F.when(F.col("family") == "container", F.coalesce("n_children", F.lit(0).cast("long"))) if nodes is not None else F.lit(None).cast("long"),
    }
    if "count" in fields and nodes is not None:
        found = found.join(child_counts(nodes).select(F.col("parent").alias("path"), F.col("n").alias("n_children")), "path", "left")
    chosen = [columns[f].alias(f) for f in fields if f in columns]
    return found.select(F.col("key").alias("id"), F.to_json(F.struct(ancestors(F.col("path")).alias("ancestors"), *chosen)).alias("attributes"), node_links(base_url).alias("links"))


def entries(nodes: DataFrame, path: str, predicates: Iterable[Predicate] = (), offset: int = 0, limit: int = PAGE, base_url: str = "", ctx: Context | None = None) -> tuple[DataFrame, int, dict[str, str | None]]:
    """A page of resources, the number of matches, and the links to other pages."""
    found = search(nodes, container(nodes, path), predicates, ctx)
    count = found.count()
    row = found.sparkSession.range(1).select(*[c.alias(k) for k, c in page_links(F.lit(offset), F.lit(limit), F.lit(count), base_url, "search", clean(path)).items()]).collect()[0]
    return resources(page(found, offset, limit, ctx=ctx), base_url), count, row.asDict()


def root(nodes: DataFrame, base_url: str = "") -> DataFrame:
    """The root's resource: an empty id and the number of its children."""
    return children(nodes, "").agg(F.count(F.lit(1)).alias("count")).select(F.lit("").alias("id"), "count", F.lit(f"{base_url.rstrip('/')}/api/v1/metadata/").alias("self"))


def about(spark, registry, base_url: str = "") -> DataFrame:
    """One row: formats and aliases (JSON), the names of the predicates, whether a login is needed, links."""
    row = (0, json.dumps(registry.formats(), sort_keys=True), json.dumps(registry.aliases(), sort_keys=True), list(KINDS), False, {"self": f"{base_url.rstrip('/')}/api/v1/"})
    return spark.createDataFrame([row], "api_version int, formats string, aliases string, queries array<string>, login_required boolean, links map<string,string>")
