"""Context building, tools, synthesis and the store."""

from pyspark.sql import functions as F

from codeloom.operators import context, graph, store, synthesis
from codeloom.sources import extract

TEXT = "path string, language string, text string"


def got(df):
    return sorted(tuple(r) for r in df.collect())


def named(df):
    return df.withColumn("qualified_name", F.coalesce("qualified_name", "name"))


def test_context_from_a_task(spark, make_nodes, make_edges):
    n = named(make_nodes(
        {"id": "1", "name": "parseQuery", "start_line": 1, "end_line": 3}, {"id": "2", "name": "runAll", "file_path": "r/b.py"},
        {"id": "3", "name": "other", "file_path": "r/c.py"}, {"id": "4", "name": "helper", "file_path": "tests/x.py"}, {"id": "5", "kind": "import", "name": "imp"},
    ))
    e = graph.clean_edges(make_edges(("2", "1", "calls"), ("1", "4", "calls"), ("3", "2", "calls"), ("5", "1", "imports")))
    assert context.symbols_in("why a.b_c and doIt MAX_N x") == ["a.b_c", "MAX_N", "b_c", "doIt"]
    entries = context.entry_points(n, "Why does parseQuery fail?")
    assert entries.first()["id"] == "1" and entries.first()["step"] == 1
    assert context.entry_points(n, "find parseQuerx").first()["step"] > 2
    assert context.entry_points(n, "").count() == 0
    t = spark.createDataFrame([("r/a.py", "python", "def parseQuery():\n  x\n  y\nz")], TEXT)
    out = context.build("Why does parseQuery fail?", n, e, t)
    assert {r.id for r in out["nodes"].collect()} >= {"1", "2", "4"}
    assert out["blocks"].where("id = 1").first()["code"] == "def parseQuery():\n  x\n  y"
    assert "### parseQuery (function) r/a.py:1" in context.markdown(out["blocks"]).first()[0]
    assert {(r.metric, r.key): r.value for r in out["summary"].collect()}["nodes", ""] >= 3
    assert got(context.imports_to_definitions(n, e)) == [("1",), ("2",), ("3",), ("4",)]


def test_tools(spark, make_nodes):
    n = named(make_nodes({"id": "1", "name": "f", "start_line": 1, "end_line": 20}, {"id": "2", "name": "f", "start_line": 5, "end_line": 9}))
    assert context.node_at(n, "f", 6).first()["id"] == "2" and context.node_at(n, "f").first()["id"] == "1"
    files = spark.createDataFrame([("r/a/x.py",), ("r/b/x.py",), ("r/b/only.py",)], "path string")
    assert [got(context.resolve_file(files, w)) for w in ("r/a/x.py", "only.py", "x.py", "b/o")] == [[("r/a/x.py",)], [("r/b/only.py",)], [], [("r/b/only.py",)]]
    assert got(context.file_tree(files, 2)) == [("r", 1, 3), ("r/a", 2, 1), ("r/b", 2, 2)]
    assert got(context.prose_to_names(make_nodes({"id": "1", "name": "resolveImports"}), "resolving of pending imports").select("name")) == [("resolveImports",)]


def test_synthesis(spark, make_nodes, make_edges):
    code = "class A {\n  fire() {\n    bus.emit('x:done');\n    for (const h of this.hooks) h();\n  }\n  add(h) {\n    this.hooks.push(h);\n  }\n}\nfunction listen() {\n  bus.on('x:done', go);\n}\n"
    t = spark.createDataFrame([("r/a.js", "javascript", code), ("r/n.js", "javascript", None)], TEXT)
    n = make_nodes({"id": "fire", "kind": "method", "start_line": 2, "end_line": 5}, {"id": "add", "kind": "method", "start_line": 6, "end_line": 8}, {"id": "listen", "start_line": 10, "end_line": 12}, {"id": "file", "kind": "file"}, {"id": "save", "file_path": "r/z.js"}, file_path="r/a.js", language="javascript")
    assert got(synthesis.event_edges(n, t)) == [("fire", "listen", "x:done")]
    assert got(synthesis.observer_edges(n, t)) == [("fire", "add", "hooks")]
    routes = extract.framework_routes(spark.createDataFrame([("r/a.js", "javascript", "app.get('/p', save)\napp.get('/q', nobody)")], TEXT))
    assert got(synthesis.route_edges(n, routes)) == [("file", "save", "/p")]
    e = graph.clean_edges(make_edges(("box", "h", "contains"), ("box", "m", "contains")))
    m = make_nodes({"id": "box", "kind": "class"}, {"id": "h", "kind": "method", "name": "handleClick"}, {"id": "m", "kind": "method", "decorators": ["@Override"]})
    assert got(synthesis.callback_edges(m, e)) == [("box", "h")] and got(synthesis.annotated_edges(m, e)) == [("box", "m")]
    go = make_nodes({"id": "t", "kind": "struct", "name": "T", "file_path": "p/a.go"}, {"id": "f", "kind": "method", "qualified_name": "T::F", "file_path": "p/b.go"}, {"id": "g", "kind": "method", "qualified_name": "T::G", "file_path": "q/b.go"}, language="go")
    assert got(synthesis.receiver_edges(go)) == [("t", "f")]


def test_chunks(spark):
    t = spark.createDataFrame([("a.py", "python", "class A:\n    def f(self):\n        return 1\n"), ("b.md", "markdown", "\n".join(map(str, range(100)))), ("c.py", "python", None)], TEXT)
    assert got(extract.code_chunks(t).select("path", "node_kind", "start_line", "end_line")) == [("a.py", "class", 1, 3), ("a.py", "method", 2, 3), ("b.md", "window", 1, 81), ("b.md", "window", 77, 100)]


def test_store_keeps_edges_across_files(spark, make_nodes):
    edge, file = "source string, target string, kind string, line int, col int", "path string, content_hash string"
    nodes = named(make_nodes({"id": "u", "file_path": "u.py"}, {"id": "old", "name": "f", "file_path": "f.py"}, {"id": "gone", "file_path": "f.py"}))
    edges = spark.createDataFrame([("u", "old", "calls", 1, 1), ("u", "gone", "calls", 2, 1), ("old", "u", "calls", 3, 1)], edge)
    files = spark.createDataFrame([("u.py", "1"), ("f.py", "1")], file)
    fresh = named(make_nodes({"id": "new", "name": "f", "file_path": "f.py"}, {"id": "", "file_path": "f.py"}))
    n, e, f = store.apply_batch(nodes, edges, files, fresh, spark.createDataFrame([("new", "u", "calls", 9, 1), ("new", "nobody", "calls", 9, 1)], edge), spark.createDataFrame([("f.py", "2"), ("u.py", "1")], file))
    assert sorted(r.id for r in n.collect()) == ["new", "u"]
    assert got(e.select("source", "target", "line")) == [("new", "u", 9), ("u", "new", 1)]
    assert got(f.select("path", "content_hash")) == [("f.py", "2"), ("u.py", "1")]
    same = store.apply_batch(nodes, edges, files, fresh, edges.limit(0), files)
    assert sorted(r.id for r in same[0].collect()) == ["gone", "old", "u"]
    assert store.pending_migrations([1], [8, 1, 7]) == [7, 8] and store.upgraded(files, {"path": "string", "size": "bigint"}).columns == ["path", "content_hash", "size"]


def test_single_file_is_indexed_again(spark, make_nodes):
    text = "def f():\n    return g()\n"
    nodes, edges = make_nodes({"id": "old", "name": "f"}, {"id": "u", "name": "u", "file_path": "u.py"}), spark.createDataFrame([("u", "old", "calls", 1, 1)], "source string, target string, kind string, line int, col int")
    files = spark.createDataFrame([("r/a.py", "0", 1), ("u.py", "1", 1)], "path string, content_hash string, indexed_at bigint")
    t = spark.createDataFrame([("r/a.py", "python", text)], "path string, language string, text string")
    n, e, f = store.index_files(t, nodes, edges, files, 7)
    assert sorted((r.kind, r.name) for r in n.collect()) == [("file", "a.py"), ("function", "f"), ("function", "u")]
    new = n.where("name = 'f'").first()["id"]
    assert new != "old" and ("u", new, "calls") in {tuple(r) for r in e.select("source", "target", "kind").collect()}
    again = store.index_files(t, n, e, f, 8)
    assert again[2].where("indexed_at = 8").count() == 0 and again[0].count() == 3
