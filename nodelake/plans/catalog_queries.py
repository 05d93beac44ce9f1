"""Metadata search, tree navigation and paging over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodelake.functions import dtypes, media, structures, urlcodec
from nodelake.operators import nodes as N
from nodelake.operators import predicates as P
from nodelake.operators import tree as T
from nodelake.operators.predicates import Context, Key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, sf_dir) -> DataFrame:
    """Leaves region/nation/customer; segment and balance are also plain columns (promoted)."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.concat_ws("/", "r_name", "n_name").alias("parent"), F.col("r_name").alias("region"),
        F.col("c_name").alias("key"), F.col("c_custkey").alias("pos"), F.lit(3).alias("depth"), F.lit("table").alias("family"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        N.metadata(segment=F.col("c_mktsegment"), balance=F.col("c_acctbal")).alias("metadata"),
    )


def whole_tree(spark, sf_dir) -> DataFrame:
    """region / nation / customer as paths with their place."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.col("r_name").alias("path"), F.lit("").alias("parent"), F.col("r_name").alias("key"), F.col("r_regionkey").cast("long").alias("pos"), F.lit(1).alias("depth"), F.lit("container").alias("family"))
    middle = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name"), "r_name", "n_name", F.col("n_nationkey").cast("long"), F.lit(2), F.lit("container"))
    return top.union(middle).union(customers(spark, sf_dir).select("path", "parent", "key", "pos", "depth", "family"))


def event_nodes(spark, sf_dir) -> DataFrame:
    """Events as leaves whose metadata is their JSON."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("parent"), F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("pos"), F.parse_json("props").alias("metadata"))


def documents(spark, sf_dir) -> DataFrame:
    """Documents whose language and source are specs, access data and an array in the metadata."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    spec = lambda c: F.struct(F.col(c).alias("name"), F.lit(None).cast("string").alias("version"))
    # A missing label is a missing key: to_json leaves nulls out.
    meta = F.parse_json(F.to_json(F.struct(F.array("lang", "source").alias("labels"), "quality", "lang")))
    return d.select("doc_id", "lang", "source", F.col("text").alias("metadata_text"), F.array(spec("lang"), spec("source")).alias("specs"), F.col("source").alias("user_id"), F.array("lang").alias("tags"), meta.alias("metadata"))


def _docs(predicate, ctx=None):
    return lambda spark, sf_dir: documents(spark, sf_dir).where(P.all_of([predicate], ctx)).select("doc_id")


def _events(*predicates):
    return lambda spark, sf_dir: event_nodes(spark, sf_dir).where(P.all_of(predicates)).select("event_id")


def _customers(*predicates, ctx=None):
    return lambda spark, sf_dir: customers(spark, sf_dir).where(P.all_of(predicates, ctx)).select("path", "key", "pos")


PROMOTED = Context(promoted={"segment": "segment", "balance": "balance"})
TEXT = Context(text="metadata_text")
WANTED = [Key("segment") == "BUILDING", Key("balance") > 100.0]
CUSTOMER_SQL = """SELECT r_name || '/' || n_name || '/' || c_name AS path, c_name AS key, c_custkey AS pos
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def flagship(offset: int):
    """A page of the entries under ASIA with segment BUILDING and a balance over 100."""

    def run(spark, sf_dir) -> DataFrame:
        leaves = customers(spark, sf_dir).where(F.col("region") == "ASIA").where(P.all_of(WANTED, PROMOTED))
        found = T.page(leaves, offset=offset, limit=10)
        return found.select("pos", "path", F.array_join(T.ancestors(F.col("path")), "|").alias("ancestors"), "segment", "balance")

    return run


def regex_of_text(pattern: str, case_sensitive: bool):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").select("doc_id", "text")
        return d.where(P.Regex("text", pattern, case_sensitive).column(Context(promoted={"text": "text"}))).select("doc_id")

    return run


def families(spark, sf_dir) -> DataFrame:
    both = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("pos"), F.lit(f).alias("family")) for t, k, f in (("region", "r_regionkey", "container"), ("embeddings", "vec_id", "array"), ("supplier", "s_suppkey", "table"))]
    return both[0].union(both[1]).union(both[2]).where(P.StructureFamily("array").column(Context())).select("kind", "pos")


def run_eq(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_variant_object(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("start"))).alias("metadata"))
    return o.where(P.Eq("status", "F").column(Context(scope="start"))).select("o_orderkey")


def part_like(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where(P.Like("name", "%a%e%").column(Context(promoted={"name": "p_name"}))).select("p_partkey", "p_name")


def url_decode(spark, sf_dir) -> DataFrame:
    params = [x for p in WANTED for x in urlcodec.encode(p)]
    return customers(spark, sf_dir).where(P.all_of(urlcodec.decode(params))).select("path", "key", "pos")


def paths(spark, sf_dir) -> DataFrame:
    return whole_tree(spark, sf_dir).select("path", F.col("depth").cast("long").alias("depth"), F.array_join(T.ancestors(F.col("path")), "|").alias("ancestors"))


def walk(spark, sf_dir) -> DataFrame:
    return whole_tree(spark, sf_dir).where(F.col("path") == T.clean("/ASIA//JAPAN/")).select("path", "key", "family")


def node_table(spark, sf_dir) -> DataFrame:
    """The whole tree with the columns that a resource is made of."""
    meta = F.to_variant_object(F.struct(F.col("key").alias("name")))
    return whole_tree(spark, sf_dir).select("*", meta.alias("metadata"), F.lit(None).cast("variant").alias("structure"), F.array().cast(N.SPECS).alias("specs"))


def walk_node(spark, sf_dir) -> DataFrame:
    return T.walk(whole_tree(spark, sf_dir), "/ASIA//NATION_2/").select("path", "key", "family")


def search(spark, sf_dir) -> DataFrame:
    """The children of one nation that meet two predicates."""
    return T.search(customers(spark, sf_dir), "ASIA/NATION_2", [Key("segment") == "BUILDING", Key("balance") > 100.0], PROMOTED).select("path", "key", "pos")


def entries_page(spark, sf_dir) -> DataFrame:
    """The second page of the children of a region: resources, and the number of matches."""
    found, count, links = T.entries(node_table(spark, sf_dir), "ASIA", offset=2, limit=2, base_url="http://x")
    return found.select("id", F.get_json_object("attributes", "$.metadata.name").alias("name"), F.col("links")["search"].alias("link"), F.lit(count).cast("long").alias("n"), F.lit(links["last"]).alias("last"))


def entry_counts(spark, sf_dir) -> DataFrame:
    """The ``count`` field of every node but the root: children of containers, null for others."""
    nodes = node_table(spark, sf_dir)
    found = T.resources(nodes, fields=("count", "data_sources"), nodes=nodes)
    return found.select("id", F.get_json_object("attributes", "$.count").cast("long").alias("n"), F.get_json_object("attributes", "$.data_sources").alias("sources"))


def counts_of_children(spark, sf_dir) -> DataFrame:
    return T.child_counts(whole_tree(spark, sf_dir))


def long_keys(spark, sf_dir) -> DataFrame:
    """Customers named in a table of keys: those with a finished order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    keys = table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select(F.col("c_name").alias("key"))
    return T.with_keys(customers(spark, sf_dir), keys).select("path", "key", "pos")


def array_structures(spark, sf_dir) -> DataFrame:
    """The structure of each embedding, written as JSON and read back on the driver's side in tests."""
    kind = structures.dtype_column(dtypes.DType.parse("<f4"))
    shape = F.array(F.size("embedding").cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", structures.array_json(kind, shape, F.array(F.lit("x"))).alias("doc"))


def children(spark, sf_dir) -> DataFrame:
    return T.children(whole_tree(spark, sf_dir), "ASIA").select("key", "pos")


def child_counts(spark, sf_dir) -> DataFrame:
    return whole_tree(spark, sf_dir).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def subtree(spark, sf_dir) -> DataFrame:
    return T.subtree(whole_tree(spark, sf_dir), "EUROPE", depth=1).select("path")


def event_page(offset_from_end: int | None, limit: int):
    def run(spark, sf_dir):
        e = event_nodes(spark, sf_dir)
        if offset_from_end is None:
            return T.page(e, offset=50, limit=limit).select("event_id")
        n = e.count()
        return T.page(e, offset=(max(n, 1) - 1) // limit * limit, limit=limit).select("event_id")

    return run


def links(spark, sf_dir) -> DataFrame:
    pages = spark.range(0, 100, 10).select(F.col("id").alias("offset"), F.lit(10).cast("long").alias("limit"), F.lit(100).cast("long").alias("count"))
    return pages.select("offset", *[c.alias(f"link_{k}") for k, c in T.page_links(F.col("offset"), F.col("limit"), F.col("count"), "http://x/", "search", "a").items()])


def node_links(spark, sf_dir) -> DataFrame:
    found = whole_tree(spark, sf_dir).select("path", F.explode(T.node_links("http://x")).alias("link", "url"))
    return found


def match_count(spark, sf_dir) -> DataFrame:
    return event_nodes(spark, sf_dir).where(P.all_of([Key("k") > 50])).agg(F.count(F.lit(1)).alias("n"))


def sorted_page(spark, sf_dir) -> DataFrame:
    found = T.page(customers(spark, sf_dir), 0, 25, [("segment", 1), ("balance", -1)], PROMOTED)
    return found.select("key", "segment", "balance")


def struct_json(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("doc"))


def aliases(spark, sf_dir) -> DataFrame:
    names = ["h5", ".parquet", "CSV", "unknown", "tif", "nc4"]
    return spark.createDataFrame([(x, media.of_extension(x)) for x in names], "name string, media_type string")


QUERIES = {
    "q_flagship": flagship(10),
    "q_flagship_first": flagship(0),
    "q_search": search,
    "q_keys_long": long_keys,
    "q_fulltext": _docs(P.FullText("the"), TEXT),
    "q_lookup": _customers(P.Lookup("Customer#000000007")),
    "q_keys_filter": _customers(P.KeysFilter(("Customer#000000001", "Customer#000000002", "Customer#000000999"))),
    "q_regex": regex_of_text(r"\bthe\b", True),
    "q_regex_ci": regex_of_text(r"\bthe\b", False),
    "q_eq": _customers(Key("segment") == "BUILDING"),
    "q_eq_number": _events(Key("k") == 7),
    "q_noteq": _events(Key("k") != 7),
    "q_noteq_missing": _docs(Key("quality") != 1),
    "q_lt": _events(Key("k") < 10),
    "q_gt": _events(Key("k") > 90),
    "q_le": _events(Key("k") <= 10),
    "q_ge": _events(Key("k") >= 90),
    "q_contains": _docs(P.Contains("labels", "en")),
    "q_in": _events(P.In("k", (1, 2, 3))),
    "q_notin": _docs(P.NotIn("quality", (0,))),
    "q_keypresent": _docs(P.KeyPresent("quality")),
    "q_keyabsent": _docs(P.KeyPresent("quality", False)),
    "q_like": part_like,
    "q_specs": _docs(P.Specs(("en",), ("src3", "src4"))),
    "q_access": _docs(P.AccessBlobFilter("src1", ("fr",))),
    "q_family": families,
    "q_run_eq": run_eq,
    "q_and": _customers(*WANTED, ctx=PROMOTED),
    "q_and_variant": _customers(*WANTED),
    "q_url_decode": url_decode,
    "t_paths": paths,
    "t_walk": walk,
    "t_walk_node": walk_node,
    "t_entries_page": entries_page,
    "t_entry_counts": entry_counts,
    "t_child_counts": counts_of_children,
    "t_children": children,
    "t_count": child_counts,
    "t_subtree": subtree,
    "t_page": event_page(None, 20),
    "t_page_last": event_page(0, 30),
    "t_links": links,
    "t_node_links": node_links,
    "t_entries_meta": match_count,
    "l_sorted_page": sorted_page,
    "p_struct_json": struct_json,
    "p_array_structure": array_structures,
    "s_alias": aliases,
}

_K = "json_extract(props, '$.k')::BIGINT"
_DOC = "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)"
_TREE = """(SELECT r_name AS path, '' AS parent, r_name AS key, r_regionkey::BIGINT AS pos, 1::BIGINT AS depth, 'container' AS family FROM region
UNION ALL SELECT r_name || '/' || n_name, r_name, n_name, n_nationkey::BIGINT, 2, 'container' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, r_name || '/' || n_name, c_name, c_custkey, 3, 'table'
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t"""

ORACLES = {
    "q_flagship": """SELECT c_custkey AS pos, r_name || '/' || n_name || '/' || c_name AS path, '|' || r_name || '|' || r_name || '/' || n_name AS ancestors, c_mktsegment AS segment, c_acctbal AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING' AND c_acctbal > 100 ORDER BY c_custkey LIMIT 10 OFFSET 10""",
    "q_flagship_first": """SELECT c_custkey AS pos, r_name || '/' || n_name || '/' || c_name AS path, '|' || r_name || '|' || r_name || '/' || n_name AS ancestors, c_mktsegment AS segment, c_acctbal AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING' AND c_acctbal > 100 ORDER BY c_custkey LIMIT 10""",
    "q_search": f"{CUSTOMER_SQL} WHERE r_name = 'ASIA' AND n_name = 'NATION_2' AND c_mktsegment = 'BUILDING' AND c_acctbal > 100",
    "q_keys_long": f"{CUSTOMER_SQL} WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "t_walk_node": f"SELECT path, key, family FROM {_TREE} WHERE path = 'ASIA/NATION_2'",
    "t_entries_page": f"""SELECT key AS id, key AS name, 'http://x/api/v1/search/' || path AS link, n, 'http://x/api/v1/search/ASIA?page[offset]=' || (n - 1) // 2 * 2 || '&page[limit]=2' AS last
FROM (SELECT *, count(*) OVER () AS n FROM {_TREE} WHERE parent = 'ASIA') ORDER BY pos LIMIT 2 OFFSET 2""",
    "t_entry_counts": f"""SELECT key AS id, CASE family WHEN 'container' THEN coalesce(n, 0) END AS n, '[]' AS sources
FROM {_TREE} LEFT JOIN (SELECT parent AS p, count(*) AS n FROM {_TREE} GROUP BY parent) c ON p = path""",
    "t_child_counts": f"SELECT parent, count(*) AS n FROM {_TREE} GROUP BY parent",
    "p_array_structure": """SELECT vec_id, '{"data_type":{"endianness":"little","kind":"f","itemsize":4,"dt_units":null},"chunks":[[' || len(embedding) || ']],"shape":[' || len(embedding) || '],"dims":["x"],"resizable":false}' AS doc FROM embeddings""",
    "q_fulltext": "SELECT doc_id FROM documents WHERE contains(text, 'the')",
    "q_lookup": f"{CUSTOMER_SQL} WHERE c_name = 'Customer#000000007'",
    "q_keys_filter": f"{CUSTOMER_SQL} WHERE c_name IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000999')",
    "q_regex": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bthe\b')",
    "q_regex_ci": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bthe\b')",
    "q_eq": f"{CUSTOMER_SQL} WHERE c_mktsegment = 'BUILDING'",
    "q_eq_number": f"SELECT event_id FROM events WHERE {_K} = 7",
    "q_noteq": f"SELECT event_id FROM events WHERE {_K} IS DISTINCT FROM 7",
    "q_noteq_missing": f"{_DOC} WHERE quality IS DISTINCT FROM 1",
    "q_lt": f"SELECT event_id FROM events WHERE {_K} < 10",
    "q_gt": f"SELECT event_id FROM events WHERE {_K} > 90",
    "q_le": f"SELECT event_id FROM events WHERE {_K} <= 10",
    "q_ge": f"SELECT event_id FROM events WHERE {_K} >= 90",
    "q_contains": "SELECT doc_id FROM documents WHERE list_contains([lang, source], 'en')",
    "q_in": f"SELECT event_id FROM events WHERE {_K} IN (1, 2, 3)",
    "q_notin": f"{_DOC} WHERE coalesce(quality NOT IN (0), true)",
    "q_keypresent": f"{_DOC} WHERE quality IS NOT NULL",
    "q_keyabsent": f"{_DOC} WHERE quality IS NULL",
    "q_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'",
    "q_specs": "SELECT doc_id FROM documents WHERE list_has_all([lang, source], ['en']) AND NOT list_has_any([lang, source], ['src3', 'src4'])",
    "q_access": "SELECT doc_id FROM documents WHERE source = 'src1' OR lang = 'fr'",
    "q_family": "SELECT 'embeddings' AS kind, vec_id AS pos FROM embeddings",
    "q_run_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "q_and": f"{CUSTOMER_SQL} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100",
    "q_and_variant": f"{CUSTOMER_SQL} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100",
    "q_url_decode": f"{CUSTOMER_SQL} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100",
    "t_paths": f"SELECT path, depth, CASE depth WHEN 1 THEN '' WHEN 2 THEN '|' || split_part(path, '/', 1) ELSE '|' || split_part(path, '/', 1) || '|' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS ancestors FROM {_TREE}",
    "t_walk": f"SELECT path, key, family FROM {_TREE} WHERE path = 'ASIA/JAPAN'",
    "t_children": f"SELECT key, pos FROM {_TREE} WHERE parent = 'ASIA'",
    "t_count": f"SELECT parent, count(*) AS n FROM {_TREE} GROUP BY parent",
    "t_subtree": f"SELECT path FROM {_TREE} WHERE starts_with(path, 'EUROPE/') AND depth <= 2",
    "t_page": "SELECT event_id FROM events ORDER BY event_id LIMIT 20 OFFSET 50",
    "t_page_last": "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events) WHERE i > (n - 1) // 30 * 30",
    "t_links": """SELECT o AS "offset", 'http://x/api/v1/search/a?page[offset]=' || o || '&page[limit]=10' AS link_self,
'http://x/api/v1/search/a?page[offset]=0&page[limit]=10' AS link_first, 'http://x/api/v1/search/a?page[offset]=90&page[limit]=10' AS link_last,
CASE WHEN o + 10 < 100 THEN 'http://x/api/v1/search/a?page[offset]=' || (o + 10) || '&page[limit]=10' END AS link_next,
CASE WHEN o > 0 THEN 'http://x/api/v1/search/a?page[offset]=' || (o - 10) || '&page[limit]=10' END AS link_prev FROM range(0, 100, 10) t(o)""",
    "t_node_links": f"""SELECT path, link, 'http://x/api/v1/' || CASE link WHEN 'self' THEN 'metadata' WHEN 'search' THEN 'search' WHEN 'partition' THEN 'table/partition' ELSE CASE family WHEN 'container' THEN 'search' ELSE 'table/full' END END || '/' || path AS url
FROM {_TREE}, (SELECT unnest(['self', 'search', 'full', 'partition']) AS link) l WHERE link IN ('self', 'full') OR (link = 'search') = (family = 'container') AND (link = 'partition') = (family = 'table')""",
    "t_entries_meta": f"SELECT count(*) AS n FROM events WHERE {_K} > 50",
    "l_sorted_page": "SELECT c_name AS key, c_mktsegment AS segment, c_acctbal AS balance FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 25",
    "p_struct_json": """SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS doc FROM nation""",
    "s_alias": "SELECT * FROM (VALUES ('h5', 'application/x-hdf5'), ('.parquet', 'application/x-parquet'), ('CSV', 'text/csv'), ('unknown', NULL), ('tif', 'image/tiff'), ('nc4', 'application/x-netcdf4')) t(name, media_type)",
}
