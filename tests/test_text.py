"""Scalar functions, query language, scan rules, extractors, search."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import scoring, text
from codeloom.operators import search
from codeloom.plans import dsl
from codeloom.sources import extract, scan, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_identifiers(spark):
    seg = lambda s: one(spark, text.identifier_segments("s"), s=s)
    assert seg("HTMLParser_base64Encode-x 42") == ["html", "parser", "base64", "encode"]
    assert seg("") == [] and seg(None) is None
    assert one(spark, text.stem_variants("s"), s="cities") == ["cities", "cit", "citi", "citie", "city"]
    assert one(spark, text.lookup_variants("s"), s="boxes") is not None
    assert one(spark, text.lookup_variants("s"), s="caches") == ["caches", "cach", "cache"]
    assert one(spark, text.camel_words("s"), s="parseHTMLDoc a.bc") == ["parse", "HTML", "Doc", "bc"]
    assert one(spark, text.search_terms("s"), s="getUser max_size")[:3] == ["get", "user", "max"]
    assert one(spark, text.query_symbols("s"), s="why does a.b.c call MAX_LEN and my_fn or doIt") == ["a.b.c", "MAX_LEN", "my_fn", "doIt"]
    assert one(spark, text.without_marks("s"), s="Crème") == "creme"
    assert one(spark, text.name_tail("s"), s="a::b.c") == "c"
    assert one(spark, text.prose_candidates("s"), s="Please resolve the pending imports 1234") == ["resolve", "pending", "imports"]


def test_texts(spark):
    html = "<title> T </title><script>x<1</script><p>a&amp;b</p><br/>c<style>q</style>"
    assert one(spark, text.html_title("s"), s=html) == "T"
    assert one(spark, text.html_to_text("s"), s=html) == "T a&b\n\nc"
    assert one(spark, text.html_links("s"), s='<a href="http://x/?uddg=http%3A%2F%2Fy.z">Y <b>z</b></a>')[0].asDict() == {"url": "http://y.z", "title": "Y z"}
    assert one(spark, text.json_blocks("s"), s='a {"k": "}"} b {{}} {') == ['{"k": "}"}', "{{}}"]
    assert one(spark, text.without_fences("s"), s="```py\nx = 1\n```") == "x = 1"
    assert one(spark, text.numbered_lines("s"), s="a\nb") == "1\ta\n2\tb"
    assert one(spark, F.length(text.truncated("s", 10, 5)), s="x" * 100) < 80
    assert one(spark, text.without_comments("s", F.lit("go")), s='a // b\n"//c" /* d\ne */ f') == 'a     \n"//c"     \n     f'
    assert one(spark, text.is_private_host("s"), s="10.0.0.1") and not one(spark, text.is_private_host("s"), s="example.org")
    assert one(spark, text.edit_distance_within(F.col("s"), F.lit("kitten"), 2), s="sitting") == 3


def test_scores(spark):
    assert one(spark, scoring.path_proximity(F.col("a"), F.col("b")), a="x/y/z/f.py", b="x/y/q/g.py") == 30
    assert one(spark, scoring.name_match_bonus("Get User", F.col("s")), s="user_get") == 15
    assert one(spark, scoring.crosses_families(F.col("a"), F.col("b")), a="go", b="python")
    assert not one(spark, scoring.crosses_families(F.col("a"), F.col("b")), a="vue", b="typescript")
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in v.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]


def test_query_language():
    q = dsl.parse('kind:function,odd lang:go path:"src/a b" name:x foo "two words" x:y')
    assert (q.kinds, q.languages, q.paths, q.names, q.text) == (["function"], ["go"], ["src/a b"], ["x"], "odd foo two words x:y")
    assert dsl.parse("lang:klingon z", strict=True).text == "klingon z"


@given(st.text(alphabet='abk:",ind ', max_size=30))
def test_query_language_never_fails(s):
    dsl.parse(s)


def test_scan_rules(spark, tmp_path):
    ignored = lambda p: one(spark, scan.is_ignored(F.col("p"), scan.ignore_rules("# c\n*.log\n/build/\n!keep.log\n")), p=p)
    assert ignored("a/x.log") and ignored("build/q/r.ts") and not ignored("keep.log") and not ignored("src/build.ts")
    for p, g in (("a.ts", "typescript"), ("x/Y.JAVA", "unknown"), ("noext", "unknown")):
        assert one(spark, scan.detect_language(F.col("p")), p=p) == g
    assert one(spark, scan.display_language(F.col("p")), p="a/B.TSX") == "typescript" and one(spark, scan.display_language(F.col("p")), p="a.odd") == "odd"
    assert not one(spark, scan.should_index(F.col("p")), p="a/node_modules/b.ts") and one(spark, scan.should_index(F.col("p")), p="a/src/b.ts")
    assert [r[0] for r in spark.createDataFrame([(100,), (500,), (20000,), (99999,)], "n int").select(scoring.explore_budget(F.col("n"))).collect()] == [1, 2, 4, 5]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("print(1)")
    (tmp_path / "d" / "b.py").write_bytes(b"\0\1")
    (tmp_path / "run").write_text("#!/usr/bin/env python\n")
    got = {r.path.rsplit("/", 1)[1]: r.reject for r in scan.guarded(scan.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"a.py": None, "b.py": "binary", "run": None}


def test_extractors(spark):
    t = spark.createDataFrame(
        [
            ("r/a.py", "python", "class A:\n    def f(self):\n        g()\n\ndef g():\n    return 1\n"),
            ("r/b.ts", "typescript", "export class B {\n  run(x: number): void {\n    help(x);\n  }\n}\nfunction help(y: any) {\n}\n"),
            ("r/c.md", "markdown", "# x"),
            ("r/d.go", "go", None),
        ],
        "path string, language string, text string",
    )
    rows = extract.extract(t).collect()
    names = {(r.kind, r.qualified_name) for r in rows if r.tag == "node" and r.kind != "file"}
    assert names == {("class", "A"), ("method", "A::f"), ("function", "g"), ("class", "B"), ("method", "B::run"), ("function", "help")}
    assert {(r.name, r.line) for r in rows if r.tag == "ref"} >= {("g", 3), ("help", 3)}
    web = spark.createDataFrame([("a.py", "python", "@app.get('/x')\nasync def read():\n    pass"), ("b.js", "javascript", "app.post('/y', auth, save)")], "path string, language string, text string")
    assert sorted((r.framework, r.route, r.handler) for r in extract.framework_routes(web).collect()) == [("express", "/y", "save"), ("fastapi", "/x", "read")]


def test_search_tiers(spark, make_nodes):
    n = make_nodes({"id": "1", "name": "parseQuery", "docstring": "Parses queries"}, {"id": "2", "name": "Store", "kind": "class", "language": "go"}, {"id": "3", "name": "storeAll", "file_path": "pkg/x.py"})
    n = n.withColumn("qualified_name", F.coalesce("qualified_name", "name"))
    run = lambda q: [(r.id, r.tier) for r in search.search(n, dsl.parse(q)).collect()]
    assert run("parsequery") == [("1", "fts")]
    assert run("eQuer") == [("1", "like")]
    assert run("Stoer") == [("2", "fuzzy")]
    assert run("path:pkg") == [("3", "filter")]
    assert run("zzzzzzzz") == []
    v = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(30)], "vec_id bigint, embedding array<float>")
    got = search.vector_search(v, "vec_id", "embedding", v.where("vec_id = 7").withColumnRenamed("vec_id", "q"), "q", 3)
    assert [r.vec_id for r in got.orderBy(F.desc("score"), "vec_id").collect()][0] == 7 and got.count() == 3


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
