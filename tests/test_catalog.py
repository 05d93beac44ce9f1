import pytest
from pyspark.sql import functions as F

from nodelake.errors import NotFound, Validation
from nodelake.functions import media, urlcodec
from nodelake.operators import nodes as N
from nodelake.operators import predicates as P
from nodelake.operators import tree as T
from nodelake.operators.predicates import Context, Key
from nodelake.sources import sinks


@pytest.fixture(scope="module")
def tree(spark):
    entries = [
        {"path": "a", "family": "array", "metadata": {"n": 1, "f": 1.0, "s": "Cu", "z": None, "l": [1, "x", None], "o": {"b": 1, "a": 2}, "a.b": True}, "specs": ["xas", "raw"], "user_id": "u1", "tags": ["t1"]},
        {"path": "b", "family": "table", "metadata": {"n": 5, "f": 2.5, "s": "iron"}, "specs": ["xas"]},
        {"path": "c", "family": "container", "metadata": {}},
        {"path": "c/d", "family": "array", "metadata": {"n": "1"}},
        {"path": "c/d/e", "family": "array", "metadata": {}},
    ]
    return N.literal(spark, entries).cache()


def keys(tree, *predicates, path=""):
    return [r["key"] for r in T.ordered(T.search(tree, path, predicates)).collect()]


@pytest.mark.parametrize(
    "predicate, found",
    [
        (Key("n") == 1, ["a"]), (Key("n") == 1.0, []), (Key("f") == 1.0, ["a"]), (Key("f") == 1, []), (Key("s") == "Cu", ["a"]),
        (Key("z") == None, ["a"]), (Key("q") == None, []), (Key("a.b") == True, ["a"]), (Key("o") == {"a": 2, "b": 1}, ["a"]),  # noqa: E711, E712
        (Key("n") != 1, ["b", "c"]), (Key("z") != None, ["b", "c"]),  # noqa: E711
        (Key("n") > 1, ["b"]), (Key("n") >= 1, ["a", "b"]), (Key("n") < 2.5, ["a"]), (Key("f") <= 1, ["a"]), (Key("s") > "D", ["b"]), (Key("s") > 1, []),
        (P.Contains("l", "x"), ["a"]), (P.Contains("l", None), ["a"]), (P.Contains("l", 2), []), (P.Contains("s", "Cu"), []),
        (P.In("n", (1, 5)), ["a", "b"]), (P.In("n", ()), []), (P.NotIn("n", (1,)), ["b", "c"]),
        (P.KeyPresent("z"), ["a"]), (P.KeyPresent("z", False), ["b", "c"]), (P.KeyPresent("a.b"), ["a"]),
        (P.Like("s", "C_"), ["a"]), (P.Regex("s", "^IR", False), ["b"]), (P.Regex("s", "^IR"), []), (P.Regex("n", "1"), []),
        (P.FullText('"Cu"'), ["a"]), (P.FullText("cu"), []), (P.Lookup("b"), ["b"]), (P.KeysFilter(("b", "c")), ["b", "c"]),
        (P.Specs(("xas",), ("raw",)), ["b"]), (P.Specs(()), ["a", "b", "c"]), (P.AccessBlobFilter("u1"), ["a"]), (P.AccessBlobFilter(None, ("t1", "t2")), ["a"]),
        (P.StructureFamily("table"), ["b"]),
    ],
)
def test_predicates(tree, predicate, found):
    assert keys(tree, predicate) == found


def test_conjunction_scope_and_promotion(tree, spark):
    assert keys(tree, Key("n") >= 1, Key("s") == "iron") == ["b"]
    runs = N.literal(spark, [{"path": "r", "family": "container", "metadata": {"start": {"uid": "x"}, "uid": "y"}}])
    assert runs.where((Key("uid") == "x").column(Context(scope="start"))).count() == 1
    plain = tree.withColumn("n2", F.lit(3))
    ctx = Context(promoted={"n": "n2"})
    assert plain.where(P.all_of([Key("n") == 3, P.In("n", (3,)), Key("n") < 4], ctx)).count() == 5
    with pytest.raises(Validation):
        (Key("a\"b'c") == 1).column(Context())


ALL = [
    P.FullText("hello world"), P.Lookup("k"), P.KeysFilter(("a", "b")), P.Regex("k", "p", False), Key("color") == "red", Key("n") != 2, Key("t") > 300,
    P.Contains("l", None), P.In("k", (1, "x")), P.NotIn("k", (True,)), P.KeyPresent("k", False), P.Like("k", "a%"), P.Specs(("xdi", "xas"), ("draft",)),
    P.AccessBlobFilter("me", ("t",)), P.StructureFamily("array"),
]


def test_url_codec():
    params = [x for p in ALL for x in urlcodec.encode(p)]
    assert urlcodec.decode(params) == ALL
    assert ("filter[eq][condition][value]", '"red"') in params
    twice = [Key("a") == 1, Key("b") == 2]
    assert urlcodec.decode([x for p in twice for x in urlcodec.encode(p)] + [("page[limit]", "3")]) == twice
    assert urlcodec.encode(P.Specs(("a",))) == [("filter[specs][condition][include]", '["a"]')]
    for bad in [("filter[nope][condition][key]", "x")], [("filter[eq][condition][key]", "x")], [("filter[eq][condition][key]", "k"), ("filter[eq][condition][value]", "{")], [("filter[eq]", "x")]:
        with pytest.raises(Validation):
            urlcodec.decode(bad)


def test_walk_and_children(tree):
    assert T.walk(tree, "/c//d/").collect()[0]["path"] == "c/d"
    for missing in ("x", "a/b", "c/d/e/f"):
        with pytest.raises(NotFound):
            T.walk(tree, missing)
    assert [r["key"] for r in T.children(tree, "c").collect()] == ["d"]
    assert T.child(tree, "c", "d").count() == 1
    assert {r["path"] for r in T.subtree(tree, "c", 1).collect()} == {"c/d"}
    assert T.root(tree).collect()[0]["count"] == 3
    with pytest.raises(Validation):
        T.container(tree, "a")
    with pytest.raises(NotFound):
        T.container(tree, "nope")
    a = {r["path"]: r["a"] for r in tree.select("path", T.ancestors(F.col("path")).alias("a")).collect()}
    assert a["a"] == [""] and a["c/d/e"] == ["", "c", "c/d"]


def test_pages(spark, tree):
    ten = N.literal(spark, [{"path": f"item_{i}", "family": "container"} for i in range(10)])
    found, count, links = T.entries(ten, "", offset=2, limit=3, base_url="http://h/")
    assert [r["id"] for r in found.collect()] == ["item_2", "item_3", "item_4"] and count == 10
    assert links["last"].endswith("page[offset]=9&page[limit]=3") and links["prev"].endswith("page[offset]=0&page[limit]=3")
    found, count, links = T.entries(tree, "", [Key("n") == 77])
    assert found.count() == 0 and count == 0 and links["next"] is None and links["last"].endswith("[offset]=0&page[limit]=100")
    with pytest.raises(Validation):
        T.page(ten, limit=0)
    assert [r["key"] for r in T.page(tree.where("parent = ''"), sorting=[("n", -1)]).collect()] == ["b", "a", "c"]
    with pytest.raises(Validation):
        T.resources(tree, fields=["nope"])
    links = {r["key"]: r["l"] for r in tree.select("key", T.node_links("http://h").alias("l")).collect()}
    assert links["b"]["partition"] == "http://h/api/v1/table/partition/b" and links["a"]["block"] == "http://h/api/v1/array/block/a"


def test_writes_to_the_tree(spark, tree):
    new = N.literal(spark, [{"path": "x", "family": "array"}])
    both = N.inserted(tree, new)
    assert [r["key"] for r in T.ordered(T.children(both, "")).collect()] == ["a", "b", "c", "x"]
    with pytest.raises(Validation):
        N.inserted(tree, N.literal(spark, [{"path": "a", "family": "array"}]))
    changed = N.with_metadata(tree, "b", {"n": 9}, ["new"])
    assert keys(changed, Key("n") == 9, P.Specs(("new",))) == ["b"] and keys(changed, Key("n") == 1) == ["a"]
    with pytest.raises(Validation):
        N.literal(spark, [{"path": "a", "family": "nope"}])
    assert N.demo_tree(spark).where("parent = ''").count() == 6


def test_media_and_about(spark):
    assert media.of_extension(".H5") == media.HDF5 and media.of_extension("nope") is None
    r = sinks.default_registry()
    assert r.negotiate("array", "text/html, text/csv;q=0.1, */*") == media.CSV
    assert r.negotiate("array", "*/*, text/csv") == media.OCTET_STREAM
    assert r.negotiate("array", "*/*") == media.OCTET_STREAM and r.negotiate("table", None) == media.ARROW_FILE and r.negotiate("container", None) is None
    r.register_alias("array", "raw", media.OCTET_STREAM)
    assert r.resolve_alias("array", "raw") == media.OCTET_STREAM and r.resolve_alias("array", "csv") == media.CSV and r.aliases()["array"]
    with pytest.raises(Exception, match="no serializer"):
        r.dispatch("awkward", "x")
    row = T.about(spark, r, "http://h").collect()[0]
    assert len(row["queries"]) == 15 and "text/csv" in row["formats"] and row["links"]["self"] == "http://h/api/v1/"


def test_typed_comparison_is_pushed_down(spark, tmp_path):
    N.literal(spark, [{"path": "a", "family": "array", "metadata": {"n": 1}}]).withColumn("n", F.lit(1)).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = stored.where(P.all_of([Key("n") == 1], Context(promoted={"n": "n"}))).select("path")._jdf.queryExecution().toString()
    assert "EqualTo(n,1)" in plan and "Python" not in plan
    plan = stored.where(P.all_of([Key("n") == 1])).select("path")._jdf.queryExecution().toString()
    assert "EqualTo(metadata." in plan, plan


def test_promoted_columns_keep_their_types(spark):
    frame = spark.createDataFrame([(1, "x", 1.0, True), (5, "y", 2.5, False), (None, None, None, None)], "n long, s string, f double, b boolean")
    ctx = Context(promoted={k: k for k in "nsfb"})
    n = lambda *p: frame.where(P.all_of(p, ctx)).count()
    assert [n(Key("n") == 1), n(Key("n") == "x"), n(Key("n") == 1.0), n(Key("f") == 1), n(Key("f") == 1.0), n(Key("s") == 1), n(Key("b") == True), n(Key("b") == 1)] == [1, 0, 0, 0, 1, 0, 1, 0]  # noqa: E712
    assert [n(Key("n") > "a"), n(Key("n") > 1), n(Key("n") >= 0.5), n(Key("f") > 1), n(Key("s") > "x"), n(Key("s") > 3), n(Key("n") > True)] == [0, 1, 2, 1, 1, 0, 0]
    assert [n(P.In("n", (1, "x"))), n(P.In("s", ("x", "z"))), n(P.In("n", ("x",))), n(P.NotIn("n", (1,))), n(Key("n") != 1), n(Key("n") == None)] == [1, 1, 0, 2, 2, 0]  # noqa: E711
    assert [n(P.KeyPresent("n")), n(P.KeyPresent("n", False)), n(P.Regex("n", "1")), n(P.Like("s", "x%"))] == [2, 1, 0, 1]
