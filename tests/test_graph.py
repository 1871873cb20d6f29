"""Walks, impact, cycles, resolution on micro-graphs."""

import random
from collections import deque

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import aggregates, graph, imports, resolve
from codeloom.plans import graph_queries


def got(df):
    return sorted(tuple(r) for r in df.collect())


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def test_chain_star_and_filters(spark, make_nodes, make_edges):
    e = graph.clean_edges(make_edges(("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "x", "contains")))
    assert got(graph.levels(ids(spark, "a"), graph.links(e, "out", ["calls"]), 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert got(graph.callers(ids(spark, "d"), e, 2)) == [("b", 2), ("c", 1), ("d", 0)]
    n = make_nodes({"id": "a"}, {"id": "b", "kind": "method"}, {"id": "x", "kind": "method"}, {"id": "c"})
    assert got(graph.levels(ids(spark, "a"), graph.links(e), 1, n.where("kind = 'method'"))) == [("a", 0), ("b", 1), ("x", 1)]
    assert got(graph.levels(ids(spark, "a").limit(0), graph.links(e), 2)) == []


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_depth_is_shortest_distance(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(18)}
    steps = spark.createDataFrame(list(pairs), "here string, there string")
    dist, queue = {"v0": 0}, deque(["v0"])
    while queue:
        x = queue.popleft()
        for a, b in pairs:
            if a == x and b not in dist:
                dist[b] = dist[x] + 1
                queue.append(b)
    assert got(graph.levels(ids(spark, "v0"), steps)) == sorted(dist.items())


def test_impact_members_cost_nothing(spark, make_nodes, make_edges):
    n = make_nodes({"id": "cls", "kind": "class"}, {"id": "m", "kind": "method"}, {"id": "u"}, {"id": "v"})
    e = graph.clean_edges(make_edges(("cls", "m", "contains"), ("u", "m", "calls"), ("v", "u", "calls"), ("root", "cls", "contains")))
    assert got(graph.impact_radius(ids(spark, "cls"), n, e, 1)) == [("cls", 0), ("m", 0), ("u", 1)]


def test_path_cycles_and_dead_code(spark, make_nodes, make_edges):
    e = graph.clean_edges(make_edges(("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "d", "calls"), ("d", "e", "calls"), ("e", "d", "calls"), ("q", "q", "calls")))
    assert got(graph.shortest_path("a", "d", e)) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert got(graph.shortest_path("d", "a", e)) == []
    assert got(graph.shortest_path("a", "a", e)) == [(0, "a")]
    assert got(graph.cyclic_groups(e, "source", "target")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    n = make_nodes({"id": "a"}, {"id": "z"}, {"id": "y", "is_exported": True}, {"id": "w", "kind": "field"})
    assert [r.id for r in graph.dead_code(n, e).collect()] == ["z"]
    assert got(graph.call_paths(ids(spark, "a", "d"), e, 3).select(F.array_join("path", ">"))) == [("a>b>c>d",)]


def strong_groups(pairs):
    """{id: least id of its group} by plain search, groups of one left out."""
    out = {}
    for x, _ in pairs:
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            for a, b in pairs:
                if a == y and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[x] = seen
    groups = {x: min(y for y in seen if x in out.get(y, ())) for x, seen in out.items() if x in seen}
    return {x: g for x, g in groups.items() if list(groups.values()).count(g) > 1}


def test_dependency_cycles_take_every_kind(spark, make_nodes, make_edges, tmp_path):
    rng = random.Random(11)
    names = [f"n{k}" for k in range(24)]
    make_nodes(*({"id": x, "file_path": f"r/f{k // 2:02d}.py"} for k, x in enumerate(names))).write.parquet(str(tmp_path / "nodes.parquet"))
    links = [(rng.choice(names), rng.choice(names), rng.choice(["imports", "calls", "references", "contains", "extends"])) for _ in range(34)]
    make_edges(*links).write.parquet(str(tmp_path / "edges.parquet"))
    file = {x: f"r/f{k // 2:02d}.py" for k, x in enumerate(names)}
    want = strong_groups({(file[a], file[b]) for a, b, kind in links if kind != "contains" and file[a] != file[b]})
    typed = strong_groups({(file[a], file[b]) for a, b, kind in links if kind == "extends" and file[a] != file[b]})
    assert len(want) > len(typed)
    assert got(graph_queries.QUERIES["dependency_cycles"](spark, str(tmp_path))) == sorted(want.items())


def test_many_cycles_below_each_other(spark):
    pairs = [(f"{k:02d}{a}", f"{k:02d}{b}") for k in range(70) for a, b in ("xy", "yx")] + [(f"{j:02d}x", f"{k:02d}x") for k in range(70) for j in range(k)]
    found = got(graph.cyclic_groups(spark.createDataFrame(pairs, "file string, depends_on string")))
    assert found == sorted((f"{k:02d}{x}", f"{k:02d}x") for k in range(70) for x in "xy")


def test_call_paths_of_all_functions(spark, make_nodes, make_edges, tmp_path):
    names = [f"f{k}" for k in range(8)]
    make_nodes(*({"id": x} for x in names), {"id": "m", "kind": "method"}).write.parquet(str(tmp_path / "nodes.parquet"))
    links = [(f"f{k}", f"f{k + 1}") for k in range(7)] + [("f3", "f1"), ("f2", "m"), ("m", "f6"), ("f5", "f5")]
    make_edges(*((a, b, "calls") for a, b in links), ("f7", "f0", "imports")).write.parquet(str(tmp_path / "edges.parquet"))
    walks, want = [[x] for x in names], []
    for _ in range(6):
        walks = [[*w, b] for w in walks for a, b in links if a == w[-1] and b not in w]
        want += [tuple(w) for w in walks if w[-1] != "m"]
    assert sorted(tuple(r.path) for r in graph_queries.QUERIES["call_paths"](spark, str(tmp_path)).collect()) == sorted(want)


def test_enclosing_is_the_innermost(spark, make_nodes):
    n = make_nodes({"id": "o", "start_line": 1, "end_line": 20}, {"id": "i", "start_line": 5, "end_line": 9}, {"id": "swapped", "start_line": 18, "end_line": 12}, {"id": "open", "start_line": 2, "end_line": None})
    p = spark.createDataFrame([("r/a.py", k) for k in (1, 6, 13, 30)] + [("other", 1), ("r/a.py", None)], "file_path string, line int")
    assert {(r.file_path, r.line): r.enclosing for r in graph.enclosing(p, n).collect()} == {("r/a.py", 1): "o", ("r/a.py", 6): "i", ("r/a.py", 13): "swapped", ("r/a.py", 30): None, ("other", 1): None, ("r/a.py", None): None}


def refs(spark, *rows):
    return spark.createDataFrame([(f"r{k}", "from", n, kind, 1, f, g) for k, (n, kind, f, g) in enumerate(rows)], "ref_id string, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")


def test_resolution_rules(spark, make_nodes):
    n = make_nodes(
        {"id": "1", "name": "foo"},
        {"id": "2", "name": "foo", "language": "go", "file_path": "r/b.go"},
        {"id": "3", "name": "Bar", "kind": "class", "qualified_name": "pkg.Bar"},
        {"id": "4", "name": "I", "kind": "interface"},
        {"id": "5", "name": "a.py", "kind": "file"},
        {"id": "6", "name": "only", "language": "go"},
        {"id": "7", "name": "print"},
    ).withColumn("key", F.lit("clash"))
    r = refs(spark, ("foo", "calls", "r/a.py", "python"), ("pkg.Bar", "references", "x", "python"), ("bar", "calls", "x", "python"), ("only", "references", "x", "python"), ("print", "calls", "x", "python"), ("r/a.py", "imports", "q", "python"), (None, "calls", None, None))
    assert {x.ref_id: (x.target, x.confidence) for x in resolve.resolve_live(r, n).collect()} == {"r0": ("1", 0.9), "r1": ("3", 0.95), "r2": ("3", 0.85), "r3": ("6", 0.9), "r4": ("7", 0.9)}
    c = {x.ref_id: (x.target, x.rule) for x in resolve.cascade(r, n).collect()}
    assert c == {"r0": ("1", "exact"), "r1": ("3", "qualified"), "r2": ("3", "fuzzy"), "r3": ("6", "fuzzy"), "r5": ("5", "path")}
    many = make_nodes(*({"id": f"m{k}", "name": "init"} for k in range(4)))
    assert resolve.resolve_exact(refs(spark, ("init", "calls", "r/a.py", "python")), many, ceiling=3).count() == 0
    made = resolve.created_edges(refs(spark, ("I", "extends", "r/a.py", "python"), ("Bar", "calls", "r/a.py", "python")), resolve.resolve_exact(refs(spark, ("I", "extends", "r/a.py", "python"), ("Bar", "calls", "r/a.py", "python")), n), n)
    assert sorted(r.kind for r in made.collect()) == ["implements", "instantiates"]


def test_synthesis(spark, make_nodes, make_edges):
    n = make_nodes(
        {"id": "b", "kind": "interface"}, {"id": "s", "kind": "struct"}, {"id": "t", "kind": "struct"},
        {"id": "b1", "kind": "method", "name": "run"}, {"id": "b2", "kind": "method", "name": "stop"},
        {"id": "s1", "kind": "method", "name": "run"}, {"id": "s2", "kind": "method", "name": "stop"}, {"id": "t1", "kind": "method", "name": "run"},
        {"id": "dec", "name": "cached"}, {"id": "user", "name": "u", "decorators": ["@cached(3)"]},
    )
    e = graph.clean_edges(make_edges(("b", "b1", "contains"), ("b", "b2", "contains"), ("s", "s1", "contains"), ("s", "s2", "contains"), ("t", "t1", "contains"), ("t", "b", "implements")))
    assert got(resolve.structural_implements(n, e)) == [("s", "b")]
    assert got(resolve.override_edges(n, e)) == [("t1", "b1")]
    assert got(resolve.decorator_edges(n)) == [("user", "dec")]


def moved(spark, df):
    """The rows of df() and the records that its stages wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = written()
    rows = got(df())
    return rows, sum(n for i, n in written().items() if i not in before)


def test_implements_common_names(spark, monkeypatch):
    """Names that all share make no pairs on the way; null and empty names; sets of more owners than a cell has, and of more names than go along."""
    rng = random.Random(3)
    methods = {f"{k}{i}": {"run", f"only {k}{i}"} for k in "ts" for i in range(300)}
    methods |= {f"{k}{i}m": set(rng.sample(["run", "stop", "", "load", "save"], rng.randrange(1, 4))) for k in "ts" for i in range(40)}
    methods |= {"s-null": {"run", None}, "t-null": {"run", None}, "s-none": {None}, "t-none": {None}}
    n = [(o, "struct" if o[0] == "t" else "interface", o) for o in methods] + [(f"{o}/{m}", "method", m) for o, own in methods.items() for m in own]
    e = [(o, f"{o}/{m}", "contains") for o, own in methods.items() for m in own for _ in range(2)] + [("s1", "gone", "contains"), ("gone", "t1/run", "contains")]
    n, e = spark.createDataFrame(n, "id string, kind string, name string"), spark.createDataFrame(e, "source string, target string, kind string")
    want = sorted((t, i) for t in methods if t[0] == "t" for i in methods if i[0] == "s" and None not in methods[i] and methods[i] <= methods[t])
    assert len(want) > 200
    monkeypatch.setattr(resolve, "CELL", 7, raising=False)
    monkeypatch.setattr(resolve, "FEW", 2, raising=False)
    rows, records = moved(spark, lambda: resolve.structural_implements(n, e))
    assert rows == want
    assert records < 40_000, records  # pairs by a common name alone are 100,000


def test_imports_and_aliases(spark):
    t = spark.createDataFrame([("r/src/a.ts", "typescript", "import { x } from './b';\nimport y from '../lib/c'"), ("r/m.py", "python", "from os import path"), ("r/n.go", "go", None)], "path string, language string, text string")
    m = imports.import_mappings(t.where("text is not null"))
    assert got(m.select("path", "local_name", "source")) == [("r/m.py", "path", "os"), ("r/src/a.ts", "x", "./b"), ("r/src/a.ts", "y", "../lib/c")]
    f = spark.createDataFrame([("r/src/b.ts",), ("r/lib/c/index.ts",), ("r/src/b.js",)], "path string")
    assert got(imports.resolve_imports(m, f)) == [("r/src/a.ts", "../lib/c", "r/lib/c/index.ts"), ("r/src/a.ts", "./b", "r/src/b.ts")]
    a = resolve.apply_aliases(spark.createDataFrame([("@/x/y",), ("lib",), ("z",)], "source string"), [("@/*", "src/*"), ("lib", "packages/lib")])
    assert got(a) == [("@/x/y", "src/x/y"), ("lib", "packages/lib"), ("z", None)]


def test_windows_and_chunks(spark):
    t = spark.createDataFrame([(str(n), "\n".join(map(str, range(n))) if n else "") for n in (0, 1, 5, 6, 81, 82, 200)], "path string, text string")
    c = aggregates.line_chunks(t, "path").groupBy("path").agg(F.count("*").alias("n"), F.max("end_line").alias("e")).collect()
    assert {r.path: (r.n, r.e) for r in c} == {"0": (1, 1), "1": (1, 1), "5": (1, 5), "6": (1, 6), "81": (1, 81), "82": (2, 82), "200": (3, 200)}
    items = spark.createDataFrame([([("a", 5), ("b", 9), ("c", 3)],)], "i array<struct<name string, cost bigint>>")
    assert items.select(aggregates.greedy_pack(F.col("i"), 8)).first()[0] == ["a", "c"]
    assert got(aggregates.read_lines(spark.createDataFrame([("p", "aa\nbb\ncc\ndd")], "path string, text string"), "path", 2, 3, 6)) == [("p", 2, "bb"), ("p", 3, "cc")]
