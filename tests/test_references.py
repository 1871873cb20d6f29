"""Imports, re-exports, members and lookups on small fixtures."""

from codeloom.operators import imports, lookups, methods
from pyspark.sql import functions as F

TEXT = "path string, language string, text string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_import_lists(spark):
    rows = {
        "a.ts": ("typescript", "import { a, b as c, type T } from './x';\nimport d, * as ns from \"y\";\nimport 'side';\nimport {\n  e,\n  f as g,\n} from './m';\n"),
        "b.js": ("javascript", "const p = require('./p');\nconst { q, r: s } = require('lib');\n// import no from 'no'\n"),
        "c.py": ("python", "from m import p, q as r, s\nfrom .rel import (\n    u,  # note\n    v as w,\n)\nimport a.b, os as o\nfrom x import *\n"),
        "D.java": ("java", "import a.b.C;\nimport static a.b.D.run;\nimport x.y.*;\n"),
        "e.go": ("go", 'import (\n\t"fmt"\n\tlog "my/logging"\n)\nimport "one"\n'),
        "f.rs": ("rust", "use a::b::{c, d as e};\nuse std::io;\n"),
        "g.cs": ("csharp", "using System.Text;\nusing J = A.B;\n"),
        "h.php": ("php", "use A\\B\\C;\nuse A\\D as E;\n"),
        "i.c": ("c", '#include <stdio.h>\n#include "my.h"\n'),
        "j.kt": ("kotlin", "import a.b.C as D\n"),
        "k.lua": ("lua", 'local m = require("a.b")\n'),
        "l.xx": ("unknown", "import x from 'y'"),
        "m.ts": ("typescript", None),
    }
    t = spark.createDataFrame([(p, *x) for p, x in rows.items()], TEXT).withColumn("source", F.lit("clash"))
    out: dict = {}
    for p, local, exported, source, default, namespace in got(imports.import_mappings(t)):
        out.setdefault(p, []).append((local, exported, source, "d" * default + "n" * namespace))
    assert out == {
        "a.ts": [("", "", "side", ""), ("T", "T", "./x", ""), ("a", "a", "./x", ""), ("c", "b", "./x", ""), ("d", "default", "y", "d"), ("e", "e", "./m", ""), ("g", "f", "./m", ""), ("ns", "*", "y", "n")],
        "b.js": [("p", "default", "./p", "d"), ("q", "q", "lib", ""), ("s", "r", "lib", "")],
        "c.py": [("*", "*", "x", "n"), ("a", "*", "a.b", "n"), ("o", "*", "os", "n"), ("p", "p", "m", ""), ("r", "q", "m", ""), ("s", "s", "m", ""), ("u", "u", ".rel", ""), ("w", "v", ".rel", "")],
        "D.java": [("*", "*", "x.y", "n"), ("C", "C", "a.b", ""), ("run", "run", "a.b.D", "")],
        "e.go": [("fmt", "*", "fmt", "n"), ("log", "*", "my/logging", "n"), ("one", "*", "one", "n")],
        "f.rs": [("c", "c", "a::b", ""), ("e", "d", "a::b", ""), ("io", "io", "std", "")],
        "g.cs": [("*", "*", "System.Text", "n"), ("J", "*", "A.B", "n")],
        "h.php": [("C", "C", "A\\B\\C", ""), ("E", "D", "A\\D", "")],
        "i.c": [("", "", "my.h", ""), ("", "", "stdio.h", "")],
        "j.kt": [("D", "C", "a.b", "")],
        "k.lua": [("m", "default", "a.b", "d")],
    }
    assert imports.import_mappings(t.limit(0)).count() == 0


def test_import_targets(spark):
    files = ["r/src/b.ts", "r/src/b.js", "r/lib/c/index.ts", "r/py/a/m.py", "r/py/a/__init__.py", "r/py/x.py", "r/j/a/b/C.java", "r/go/pkg/util/u.go", "r/c/inc/my.h", "r/c/src/own.h", "r/l/a/b.lua"]
    asked = [
        ("r/src/a.ts", "./b"), ("r/src/a.ts", "../lib/c"), ("r/src/a.ts", "lib"), ("r/src/d/e.js", "../b"), ("r/py/a/k.py", ".m"), ("r/py/a/k.py", "..x"), ("r/py/a/k.py", "a.m"), ("r/py/y.py", "a"),
        ("r/j/q/Z.java", "a.b.C"), ("r/go/main.go", "example/pkg/util"), ("r/go/main.go", "pkg/util"), ("r/c/src/a.c", "own.h"), ("r/c/src/a.c", "my.h"), ("r/l/z.lua", "a.b"), ("r/src/a.ts", None),
    ]
    m = spark.createDataFrame(asked, "path string, source string")
    f = spark.createDataFrame([(x,) for x in files], "path string")
    assert got(imports.resolve_imports(m, f, ("r/c/inc",))) == sorted([
        ("r/src/a.ts", "./b", "r/src/b.ts"), ("r/src/a.ts", "../lib/c", "r/lib/c/index.ts"), ("r/src/d/e.js", "../b", "r/src/b.js"), ("r/py/a/k.py", ".m", "r/py/a/m.py"), ("r/py/a/k.py", "..x", "r/py/x.py"), ("r/py/a/k.py", "a.m", "r/py/a/m.py"), ("r/py/y.py", "a", "r/py/a/__init__.py"),
        ("r/j/q/Z.java", "a.b.C", "r/j/a/b/C.java"), ("r/go/main.go", "pkg/util", "r/go/pkg/util/u.go"), ("r/c/src/a.c", "own.h", "r/c/src/own.h"), ("r/c/src/a.c", "my.h", "r/c/inc/my.h"), ("r/l/z.lua", "a.b", "r/l/a/b.lua"),
    ], key=repr)


def test_reexports_and_references(spark, make_nodes):
    t = spark.createDataFrame([
        ("r/index.ts", "typescript", "export { run as go } from './a';\nexport * from './b';\n"), ("r/b.ts", "typescript", "export * from './index';\nexport { deep } from './c';\n"),
        ("r/use.ts", "typescript", "import { go, deep, own } from './index';\nimport * as all from './a';\nimport { run } from './a';\n"),
    ], TEXT)
    files = spark.createDataFrame([(f"r/{x}.ts",) for x in ("index", "a", "b", "c", "use")], "path string")
    n = make_nodes({"id": "1", "name": "run", "file_path": "r/a.ts"}, {"id": "2", "name": "deep", "file_path": "r/c.ts"}, {"id": "3", "name": "hidden", "file_path": "r/a.ts", "is_exported": False}, is_exported=True, language="typescript")
    maps = imports.import_mappings(t)
    passed = imports.reexports(t)
    walk = imports.reexport_walk(passed, imports.resolve_imports(passed, files))
    refs = spark.createDataFrame([(x, x, "r/use.ts") for x in ("go", "deep", "own", "all.run", "run", "all.hidden")], "ref_id string, reference_name string, file_path string")
    out = imports.resolve_via_imports(refs, maps, imports.resolve_imports(maps, files), imports.export_index(n), walk)
    assert got(out) == [("all.run", "1", 0.9, "import"), ("deep", "2", 0.85, "re-export"), ("go", "1", 0.85, "re-export"), ("run", "1", 0.9, "import")]


def test_project_files(spark):
    doc = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    packages = imports.workspace_packages(doc(("r/p/package.json", '{"name": "@x/p", "main": "src/i.ts"}'), ("r/p/q/package.json", '{"name": "@x/p/q"}'), ("bad/package.json", "{"), ("no/package.json", "{}")))
    assert got(packages) == [("@x/p", "r/p", "src/i.ts"), ("@x/p/q", "r/p/q", "index.js")]
    i = spark.createDataFrame([("@x/p",), ("@x/p/a/b",), ("@x/p/q/z",), ("other",)], "source string")
    assert got(imports.workspace_imports(i, packages)) == [("@x/p", "r/p/src/i.ts"), ("@x/p/a/b", "r/p/a/b"), ("@x/p/q/z", "r/p/q/z"), ("other", None)]
    assert got(imports.workspace_members(doc(("package.json", '{"workspaces": ["a/*", "b"]}'), ("q/package.json", '{"workspaces": {"packages": ["c"]}}')))) == [("package.json", "a/*"), ("package.json", "b"), ("q/package.json", "c")]
    assert got(imports.path_aliases(doc(("tsconfig.json", '{"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["app/*", "lib/*"]}}}')))) == [("tsconfig.json", "@/*", "src/app/*", 0), ("tsconfig.json", "@/*", "src/lib/*", 1)]
    assert got(imports.go_module(doc(("r/go.mod", "// m\nmodule example.com/x\n\ngo 1.22\n")))) == [("r", "example.com/x")]
    assert got(imports.include_dirs(doc(("compile_commands.json", '{"command": "cc -Iinc -isystem third/inc -O2 a.c"}')))) == [("compile_commands.json", "inc"), ("compile_commands.json", "third/inc")]


def test_function_references(spark, make_nodes):
    n = make_nodes(
        {"id": "a", "name": "one", "file_path": "x.ts"}, {"id": "b", "name": "two", "file_path": "x.ts", "start_line": 9}, {"id": "c", "name": "two", "file_path": "x.ts", "start_line": 3}, {"id": "d", "name": "far", "file_path": "y.ts"},
        {"id": "e", "name": "many", "file_path": "y.ts"}, {"id": "f", "name": "many", "file_path": "z.ts"}, {"id": "g", "name": "meth", "kind": "method", "file_path": "x.ts"}, {"id": "h", "name": "on", "kind": "method", "language": "cpp", "qualified_name": "W::on", "file_path": "q.cpp"}, language="typescript",
    )
    refs = spark.createDataFrame([(x, "a", x, "function_ref", "x.ts", l) for x, l in [("one", "typescript"), ("two", "typescript"), ("far", "typescript"), ("many", "typescript"), ("meth", "typescript"), ("W::on", "cpp"), ("far2", "typescript"), ("this.far", "typescript")]], "ref_id string, from_node_id string, reference_name string, reference_kind string, file_path string, language string")
    assert got(methods.resolve_function_refs(refs, n)) == [("W::on", "h", 0.9, "function-ref"), ("far", "d", 0.8, "function-ref"), ("two", "c", 0.9, "function-ref")]


def test_method_calls(spark, make_nodes, make_edges):
    n = make_nodes(
        {"id": "A", "name": "Base", "kind": "class"}, {"id": "B", "name": "Sub", "kind": "class"}, {"id": "C", "name": "Client", "kind": "class"}, {"id": "a1", "name": "stop", "kind": "method", "qualified_name": "Base.stop"},
        {"id": "b1", "name": "run", "kind": "method", "qualified_name": "Sub.run"}, {"id": "c1", "name": "run", "kind": "method", "qualified_name": "Client.run"}, {"id": "s1", "name": "single", "kind": "method", "qualified_name": "Client.single"},
        {"id": "w1", "name": "send", "kind": "method", "qualified_name": "HttpMailSender.send", "file_path": "w.py"}, {"id": "w2", "name": "send", "kind": "method", "qualified_name": "Radio.send", "file_path": "w.py"},
    )
    supers = methods.supertypes(n, make_edges(("B", "A", "extends")))
    assert got(supers) == [("Sub", "python", "Base", 1)]
    text = "def f(z: Client):\n    x = Sub()\n    x.stop()\n    x.run()\n    y = 1\n    z.run()\n"
    names = [("x.stop", 3), ("x.run", 4), ("Client.run", 5), ("client.run", 5), ("q.single", 5), ("httpMail.send", 5), ("nothing.none", 5), ("z.run", 6)]
    refs = spark.createDataFrame([(x, "r/a.py", "python", x, line) for x, line in names], "ref_id string, file_path string, language string, reference_name string, line int")
    calls = refs.withColumn("receiver", F.split_part("reference_name", F.lit("."), F.lit(1))).withColumn("scope_line", F.lit(1))
    types = methods.infer_receivers(calls, spark.createDataFrame([("r/a.py", text)], "path string, text string"))
    assert got(types) == [("x.run", "Sub"), ("x.stop", "Sub"), ("z.run", "Client")]
    assert got(methods.resolve_method_calls(refs, n, types, supers)) == [
        ("Client.run", "c1", 0.85, "qualified-name"), ("client.run", "c1", 0.8, "instance-method"), ("httpMail.send", "w1", 0.65, "instance-method"), ("q.single", "s1", 0.7, "instance-method"), ("x.run", "b1", 0.9, "instance-method"), ("x.stop", "a1", 0.9, "instance-method"), ("z.run", "c1", 0.9, "instance-method"),
    ]
    m = make_nodes({"id": "mk", "name": "make", "signature": "def make() -> Optional[Client]:"}, {"id": "gs", "name": "get", "kind": "method", "qualified_name": "Sub.get", "return_type": "Base"})
    chains = spark.createDataFrame([("1", "make().run", "f", "python"), ("2", "Sub.get().stop", "f", "python"), ("3", "other().run", "f", "python")], "ref_id string, reference_name string, file_path string, language string")
    assert [r[:3] for r in got(methods.resolve_chains(chains, n.unionByName(m)))] == [("1", "c1", 0.85), ("2", "a1", 0.85)]
    this = spark.createDataFrame([("1", "b1", "self.stop", "f", "python"), ("2", "b1", "self.none", "f", "python")], "ref_id string, from_node_id string, reference_name string, file_path string, language string")
    assert [r[:3] for r in got(methods.resolve_this_members(this, n, supers))] == [("1", "a1", 0.85)]


def test_nested_functions_are_visible_inside_only(spark, make_nodes, make_edges):
    n = make_nodes({"id": "m", "kind": "module"}, {"id": "out"}, {"id": "in"}, {"id": "deep"}, {"id": "other"})
    e = make_edges(("m", "out", "contains"), ("out", "in", "contains"), ("in", "deep", "contains"), ("m", "other", "contains"))
    p = spark.createDataFrame([("other", "in"), ("out", "in"), ("deep", "in"), ("other", "out"), ("in", "deep"), ("out", "deep")], "source string, target string")
    assert got(methods.lexically_reachable(p, n, e)) == [("deep", "in"), ("in", "deep"), ("other", "out"), ("out", "in")]


def test_lookups(spark):
    steps = spark.createDataFrame([("p", 1, "done", []), ("p", 2, "pending", [1]), ("p", 3, "pending", [1, 2]), ("p", 4, "pending", [9]), ("p", 5, "pending", None)], "plan string, step int, status string, needs array<int>")
    assert got(lookups.ready_steps(steps)) == [("p", 2), ("p", 5)]
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", None)], "k string, v int")
    assert got(lookups.snapshot_diff(a, b, "k", "v")) == [("w", "added"), ("y", "changed"), ("z", "removed")]
    c = spark.createDataFrame([("git", "git status"), ("git", "gitk"), ("git *", "gitk"), ("npm run*", "npm run x"), ("npm run*", "npm install")], "p string, c string")
    assert [r[0] for r in c.select(lookups.command_matches(F.col("c"), F.col("p"))).collect()] == [True, False, True, True, False]
    assert got(lookups.embedded_repositories(spark.createDataFrame([("a/.git/HEAD",), ("a/b/.git",), (".git/HEAD",), ("c/x",)], "path string"))) == [("a",), ("a/b",)]
    assert spark.range(1).select(lookups.iso_time(F.lit(1736328602489))).first()[0] == "2025-01-08T09:30:02.489Z"
    assert lookups.page_after(spark.range(10), "id", 4, 2).collect()[0].id == 5
