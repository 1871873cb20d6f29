"""Extractors of more languages, structured files, bridges and plug-ins on small texts."""

from codeloom import interfaces
from codeloom.operators import bridges
from codeloom.sources import extract, structured
from pyspark.sql import functions as F

TEXT = "path string, language string, text string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def defs(language, text):
    return [(r["kind"], r["qualified_name"]) for r in extract.REGISTRY[language]("p", text) if r["tag"] == "node" and r["kind"] not in ("file", "component")], {(r["kind"], r["name"]) for r in extract.REGISTRY[language]("p", text) if r["tag"] == "ref"}


def test_more_languages():
    assert defs("cpp", "namespace a {\nclass Foo : public Bar {\n  int run(int x) const {\n    return help(x);\n  }\n};\n}\nint Foo::stop(int y) {\n  auto z = new Qux();\n}\n") == ([("namespace", "a"), ("class", "a::Foo"), ("method", "a::Foo::run"), ("method", "Foo::stop")], {("extends", "Bar"), ("calls", "help"), ("instantiates", "Qux"), ("calls", "Qux")})
    assert defs("rust", "pub struct P { a: u8 }\nimpl Show for P {\n    pub fn show(&self) -> u8 {\n        other()\n    }\n}\nfn main() {}\n") == ([("struct", "P"), ("method", "P::show"), ("function", "main")], {("implements", "Show"), ("calls", "other")})
    assert defs("kotlin", "class A(val x: Int) : B(), C {\n  fun run(): Int {\n    return x\n  }\n}\n") == ([("class", "A"), ("method", "A::run")], {("extends", "B"), ("extends", "C")})
    assert defs("csharp", "namespace N {\n  public class A : B, IC {\n    public int Run(int x) {\n      return 1;\n    }\n  }\n}\n") == ([("namespace", "N"), ("class", "N::A"), ("method", "N::A::Run")], {("extends", "B"), ("extends", "IC")})
    assert defs("ruby", "module M\n  class A < B\n    def run\n      x()\n    end\n  end\nend\n") == ([("module", "M"), ("class", "M::A"), ("method", "M::A::run")], {("extends", "B"), ("calls", "x")})
    assert defs("php", "<?php\nclass A extends B implements C {\n  public function run() {\n    new D();\n  }\n}\n")[0] == [("class", "A"), ("method", "A::run")]
    assert defs("swift", "class A: B {\n  func run() {\n  }\n}\n") == ([("class", "A"), ("method", "A::run")], {("extends", "B")})
    assert defs("lua", "local function a()\n  b()\nend\nfunction M.c()\nend\n")[0] == [("function", "a"), ("method", "M::c")]
    assert defs("vue", "<template>\n  <Card/>\n</template>\n<script lang=\"ts\">\nfunction go2() {\n  run();\n}\n</script>\n") == ([("function", "go2")], {("references", "Card"), ("calls", "run")})
    vue = [r for r in extract.REGISTRY["vue"]("p", "<template>\n</template>\n<script>\nfunction a() {\n}\n</script>\n") if r["tag"] == "node"]
    assert [(r["kind"], r["start_line"]) for r in vue] == [("component", 1), ("function", 4)]
    for language in extract.REGISTRY:
        assert list(extract.REGISTRY[language]("p", ""))


def test_structured_files(spark):
    doc = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    assert [r[2:] for r in got(structured.properties(doc(("a", "# no\na.b = 1\nc: x=y\n\n !no\nbare\n"))))] == [("a.b", "a.b", "1", 2), ("c", "c", "x=y", 3)]
    y = "a:\n  b: 1  \n  c:\n    - d: x\n      e: y\ntext: |\n  f: not a key\ng: \"q\"\n"
    assert [r[1:] for r in sorted(map(tuple, structured.yaml(doc(("a", y), ("n", None))).collect()), key=lambda r: r[5])] == [("module", "a", "a", None, 1), ("constant", "b", "a.b", "1", 2), ("module", "c", "a.c", None, 3), ("constant", "d", "a.c.d", "x", 4), ("constant", "e", "a.c.e", "y", 5), ("constant", "text", "text", "|", 6), ("constant", "g", "g", '"q"', 8)]
    x = '<mapper namespace="a.M">\n<sql id="cols">a, b</sql>\n<select id="all" resultType="x">select <include refid="cols"/> from t</select>\n</mapper>'
    assert got(structured.mapper_statements(doc(("m", x), ("n", "<other/>")))) == [("m", "a.M", "select", "all", "a.M::all", ["cols"]), ("m", "a.M", "sql", "cols", "a.M::cols", [])]
    f = "object Form1: TForm1\n  OnCreate = FormCreate\n  object B: TButton\n    OnClick = BClick\n  end\nend\n"
    assert [r[1:5] for r in sorted(map(tuple, structured.forms(doc(("f", f))).collect()), key=lambda r: r[5])] == [("component", "Form1", "Form1", "TForm1"), ("event", "OnCreate", "Form1.OnCreate", "FormCreate"), ("component", "B", "Form1.B", "TButton"), ("event", "OnClick", "Form1.B.OnClick", "BClick")]
    t = 'resource "aws_s3_bucket" "b" {\n  bucket = var.name\n}\nvariable "name" {\n}\n'
    assert got(structured.infrastructure(doc(("t", t)))) == [("t", "resource", "aws_s3_bucket.b", ["var.name"]), ("t", "variable", "name", [])]
    assert got(bridges.cargo_members(doc(("Cargo.toml", '[workspace]\nmembers = ["a", "b/c"]\n'), ("x", "[package]")))) == [("Cargo.toml", "a"), ("Cargo.toml", "b/c")]


def test_more_routes(spark):
    t = spark.createDataFrame([
        ("r.ts", "typescript", "const routes = [{ path: '/a', component: Home }, { path: '/b', component: () => import('./B.vue') }];"), ("n.tsx", "tsx", "<Stack.Screen name='Main' component={MainView} />"),
        ("s.swift", "swift", 'NavigationLink("Go", destination: DetailView())'), ("d.yml", "yaml", "x.y:\n  path: '/z'\n  defaults:\n    _title: 'T'\n    _controller: '\\Drupal\\m\\C::run'\n"), ("g.go", "go", 'group.GET("/u", user.List)'),
    ], TEXT)
    assert sorted((r.framework, r.route, r.handler) for r in extract.framework_routes(t).collect()) == [("drupal", "/z", "\\Drupal\\m\\C::run"), ("go-web", "/u", "user.List"), ("goframe", "/u", "user.List"), ("react-native", "Main", "MainView"), ("swiftui", "Go", "DetailView"), ("vue-router", "/a", "Home"), ("vue-router", "/b", "./B.vue")]
    p = spark.createDataFrame([("a/pages/users/[id].vue",), ("a/pages/index.vue",), ("src/routes/(app)/x/[...rest]/+page.svelte",), ("src/pages/blog/post.md",), ("src/a.ts",)], "path string")
    assert got(extract.page_routes(p)) == [("astro", "src/pages/blog/post.md", "/blog/post"), ("nuxt", "a/pages/index.vue", "/"), ("nuxt", "a/pages/users/[id].vue", "/users/:id"), ("sveltekit", "src/routes/(app)/x/[...rest]/+page.svelte", "/x/:rest")]


C = """typedef int (*handler_t)(int);
struct ops { int id; handler_t open; int (*close)(int); };
struct plain { int a; };
struct more { handler_t copy; };
static int do_open(int x) { return x; }
static int do_close(int x) { return x; } /* .open = nothing */
struct ops table = { .open = do_open, .close = do_close };
struct ops list[] = { { 1, do_open, 0 }, { 2, do_close, do_open } };
static void link_up(struct more *m, struct ops *o) { m->copy = o->open; }
int run(struct ops *o) {
  return o->open(1);
}
int later(struct more *m) {
  return m->copy(2);
}
int (*jump[])(int) = { do_open, &do_close };
int leap(int k) {
  return jump[k](3);
}
"""


def test_function_pointers(spark, make_nodes):
    t = spark.createDataFrame([("a.c", "c", C), ("b.c", "c", None), ("c.py", "python", "x")], TEXT)
    spans = {"do_open": (5, 5), "do_close": (6, 6), "link_up": (9, 9), "run": (10, 12), "later": (13, 15), "leap": (17, 19)}
    n = make_nodes(*({"id": k, "start_line": a, "end_line": b} for k, (a, b) in spans.items()), file_path="a.c", language="c")
    assert got(bridges.pointer_types(t)) == [("handler_t",)]
    layout = bridges.struct_layout(t)
    assert got(layout.where("pointer").select("struct", "position", "field")) == [("more", 0, "copy"), ("ops", 1, "open"), ("ops", 2, "close")]
    assert got(bridges.pointer_registrations(t, layout, n)) == [("ops", "close", "do_close"), ("ops", "close", "do_open"), ("ops", "open", "do_close"), ("ops", "open", "do_open")]
    assert got(bridges.pointer_edges(n, t)) == [("later", "do_close", "copy"), ("later", "do_open", "copy"), ("run", "do_close", "open"), ("run", "do_open", "open")]
    assert got(bridges.table_edges(n, t)) == [("leap", "do_close", "jump"), ("leap", "do_open", "jump")]
    assert bridges.pointer_edges(n, t.limit(0)).count() == 0


def test_selectors_closures_and_routes(spark, make_nodes):
    s = make_nodes({"id": "1", "name": "move", "kind": "method", "signature": "func move(to place: P, with x: Int)"}, {"id": "2", "name": "stop", "kind": "method", "signature": "func stop()"}, {"id": "3", "name": "tap", "kind": "method", "signature": "func tap(_ sender: Any)"}, language="swift")
    refs = spark.createDataFrame([(x, x, "objc") for x in ("moveTo:with:", "stop", "tap:", "stopAtEnd:", "none:")], "ref_id string, reference_name string, language string")
    assert got(bridges.selector_edges(refs, s)) == [("moveTo:with:", "1", 0.95), ("stop", "2", 0.95), ("stopAtEnd:", "2", 0.5), ("tap:", "3", 0.95)]
    t = spark.createDataFrame([("a.swift", "swift", "func add() {\n  self.jobs.append({ x })\n}\nfunc run() {\n  for j in self.jobs {\n  }\n}\n")], TEXT)
    n = make_nodes({"id": "add", "start_line": 1, "end_line": 3}, {"id": "run", "start_line": 4, "end_line": 7}, file_path="a.swift", language="swift")
    assert got(bridges.closure_edges(n, t)) == [("run", "add", "jobs")]
    g = spark.createDataFrame([("api/v1.go", "go", 'package v1\ntype ListReq struct {\n\tg.Meta `path:"/list" method:"get"`\n}\n'), ("ctl/c.go", "go", "package ctl\nfunc (c *C) List(ctx context.Context, req *v1.ListReq) error {\n}\n")], TEXT)
    m = make_nodes({"id": "T", "name": "ListReq", "kind": "struct", "file_path": "api/v1.go"}, {"id": "H", "name": "List", "kind": "method", "file_path": "ctl/c.go"}, language="go")
    assert got(bridges.parameter_routes(m, g)) == [("T", "H", "get", "/list")]


def test_plugins(spark, make_nodes, make_edges):
    class Pass:
        def __init__(self, name, pairs):
            self.name, self.pairs = name, pairs

        def run(self, nodes, edges, texts):
            return spark.createDataFrame(self.pairs, "source string, target string")

    n, e = make_nodes({"id": "a"}, {"id": "b", "kind": "class"}, {"id": "c"}), make_edges(("a", "b", "calls"), ("a", "c", "calls"))
    assert got(interfaces.synthesised([Pass("one", [("a", "b")]), Pass("two", [("a", "b"), ("b", "c")])], n, e, None)) == [("a", "b", "one"), ("b", "c", "two")]
    kept, inner = interfaces.filtered_subgraph(n, e, lambda rows: F.col("kind") == "function")
    assert kept.count() == 2 and got(inner.select("source", "target")) == [("a", "c")]
    class Sizes:
        dimension = 2

        def __call__(self, texts):
            if "fail" in texts:
                raise RuntimeError
            return [[len(t), 1] for t in texts]

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "fail")], "k bigint, t string")
    assert sorted((r.k, r.embedding) for r in interfaces.embedded(rows, "k", "t", Sizes(), 1).collect()) == [(1, [2.0, 1.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
