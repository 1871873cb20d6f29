"""File classes, documentation, splitting."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import documented, handwritten, splitting
from codeloom.llm.docs_words import says_something

BODY = "\n".join(f"def f{k}(a):\n    return a + {k}" for k in range(6)) + "\n"


def test_file_classes(spark):
    data = "X = [\n" + "\n".join("12, 34, 56, 78, 90, 11, 22, 33," for _ in range(40)) + "\n]\n"
    encoded = "const B = [\n" + ",\n".join(f"'{'aB3/' * 16}'" for _ in range(30)) + "];\n"
    mini = "!function(){" + ";".join(f"var a{k}=b({k})" for k in range(200)) + "}();"
    cases = {
        "r/a.py": BODY, "r/gen.py": "# Code generated by x 1.2. DO NOT EDIT.\n" + BODY.replace("f1", "g1"), "r/zh.py": "# 此文件由工具自动生成，请勿手动修改。\nx = 1\n", "r/x_pb2.py": "y = 2\n",
        "r/vendor/lib/b.py": "z = 3\n" + BODY, "q/util/c.py": "# our copy\nz = 3\n" + BODY, "r/vendors/d.py": "# Generates code; edit the templates to change its output.\nq = 1\n", "r/lic.js": "/*\n * ! lib 1.2.3 | released under the terms of its LICENSE file\n */\nvar a = 1;\n",
        "r/data.py": data, "r/enc.js": encoded, "r/m.js": mini, "r/long.py": BODY * 200, "r/c.json": "[" + "1, " * 500 + "1]", "r/empty.py": "", "r/x_pb_test.py": "t = 1\n", "r/late.py": "x = 1\n# Code generated by x. DO NOT EDIT.\n",
    }
    docs = spark.createDataFrame([(k, t, "file", p) for k, (p, t) in enumerate(cases.items())] + [(99, None, "file", "r/null.py")], "doc_id bigint, text string, source string, path string").withColumn("repo", F.lit("clash")).withColumn("size", F.lit("clash"))
    lang = {"py": "python", "js": "javascript", "json": "json"}
    files = spark.createDataFrame([(p, "", lang[p.rsplit(".", 1)[1]], len(t), 1) for p, t in cases.items()], "path string, content_hash string, language string, size bigint, indexed_at bigint")
    got = {r.path: r.reason for r in handwritten.classify_files(docs, files).collect()}
    want = {
        "r/gen.py": "generated", "r/zh.py": "generated", "r/x_pb2.py": "generated", "r/vendor/lib/b.py": "vendored", "q/util/c.py": "vendored", "r/lic.js": "vendored", "r/data.py": "data", "r/enc.js": "data", "r/m.js": "minified",
    }
    assert {k: v for k, v in got.items() if v} == want and set(got) == set(cases)
    assert handwritten.classify_files(docs.limit(0), files).count() == 0


def test_copies_keep_their_original(spark):
    body = "x" * 50
    rows = spark.createDataFrame(
        [("a/f", "a", False, 5, b"1", 50), ("b/f", "b", False, 3, b"1", 50), ("c/f", "c", False, 9, b"1", 50), ("a/g", "a", False, 1, b"2", 50), ("a/h", "a", False, 1, b"2", 50), ("a/v", "a", True, 9, b"3", 50), ("b/w", "b", False, 1, b"3", 50), ("a/s", "a", False, 1, b"4", 9), ("b/s", "b", False, 1, b"4", 9)]
        + [(f"r{k % 7}/m{k}", f"r{k % 7}", False, k, b"5", 50) for k in range(3000)],
        "path string, repo string, stamp boolean, first_seen bigint, body binary, body_chars bigint",
    )
    got = {r.path for r in handwritten.copied_paths(rows).collect()}
    assert {p for p in got if "/m" not in p} == {"a/f", "c/f", "a/v", "b/w"}
    assert len([p for p in got if "/m" in p]) == 2999 and "r0/m0" not in got and body


def test_layout_limits_by_language():
    longest, mean, blanks, alnum, numbers, digits, encoded = handwritten.layout("a = 1;\n" * 10)[2:9]
    assert (longest, round(mean, 1)) == (6, 6.4) and alnum == 0.5 and numbers == 0 and 0.2 < digits < 0.3 and encoded == 0
    assert len({tuple(v) for v in handwritten.PROFILES.values()}) == len(handwritten.PROFILES)


def test_says_something():
    no = [None, "", " \n ", "/**\n *\n */", "// ----", "TODO", "TODO: document this", "FIXME", "@param a\n@returns", ":param x:\n:return:", "{@inheritDoc}", "noqa", "pragma: no cover", "eslint-disable-next-line", "Description goes here.", "Beschreibung fehlt", "нет описания", "待补充", "...", "Auto-generated method stub",
          "Stores the eager segment", "Store eager segment.", "The storeEagerSegment method.", "storeEagerSegment()", "/** Stores segments. storeEagerSegment. */"]
    yes = ["Retries 5 times, then gives up.", "@returns the remote lexer, or nothing if it is unknown", "先读缓存，再查9次索引。", "Возвращает пусто.", "/** Stores the segment in the cache of the router. */", "TODO list of the router is read twice"]
    assert [x for x in no if says_something(x, "storeEagerSegment")] == []
    assert [x for x in yes if not says_something(x, "storeEagerSegment")] == []


def test_comment_spans():
    py = "# above\n@dec\ndef f(a,\n      b):\n    '''Inner\n    text'''\n    return 1\n# lost\n\nx = 1\n"
    assert documented.comment_spans(py, True) == [(1, 3, "# above"), (2, 3, "Inner\n    text")]
    ts = "/**\n * Doc.\n */\n@Get()\nfunction f() {\n  // inside\n  g();\n}\n"
    assert documented.comment_spans(ts, False) == [(3, 5, "/**\n * Doc.\n */"), (6, 7, "  // inside")]
    assert documented.comment_spans("", True) == [] and documented.comment_spans("/* open", False) == []


def test_pairs(spark, make_nodes):
    text = "// Reads it twice.\nfunction a() {\n  x();\n}\nfunction b() {\n}\n// Not for c.\nlet q = 1;\nfunction c() {\n}\n"
    docs = spark.createDataFrame([(1, text, "file", "r/a.js"), (2, None, "file", "r/b.js")], "doc_id bigint, text string, source string, path string").withColumn("at", F.lit(1)).withColumn("comment", F.lit("clash"))
    n = make_nodes(
        {"id": "a", "start_line": 4, "end_line": 2}, {"id": "b", "start_line": 5, "end_line": 6, "docstring": "Frees all of its handles."}, {"id": "c", "start_line": 9, "end_line": 10},
        {"id": "old", "docstring": "Says much about all.", "updated_at": 1}, {"id": "old", "docstring": "TODO", "updated_at": 2}, {"id": "k", "kind": "class", "docstring": "Says much about all."},
        {"id": "d", "start_line": 2, "end_line": 2, "docstring": "/** Reads it\n * twice. */"}, {"id": "e", "start_line": 2, "end_line": 2, "docstring": "Something else is said here."}, {"id": "t", "start_line": 2, "docstring": "TODO"}, {"id": "free", "file_path": None, "docstring": "Says much about all."},
        {"id": "x", "file_path": "nowhere", "docstring": "Says much about all.", "start_line": None, "end_line": None},
        file_path="r/a.js", language="javascript",
    )
    got = {r.node_id: (r.origin, r.description, r.code) for r in documented.pairs(n, docs).collect()}
    assert got == {
        "a": ("attached", "// Reads it twice.", "function a() {\n  x();\n}"),
        "b": ("recorded", "Frees all of its handles.", "function b() {\n}"),
        "x": ("recorded", "Says much about all.", None),
        "d": ("confirmed", "// Reads it twice.", "function a() {"),
        "e": ("recorded", "Something else is said here.", "function a() {"),
        "free": ("recorded", "Says much about all.", None),
    }
    assert documented.pairs(n.limit(0), docs).count() == 0
    assert documented.pairs(n, docs.limit(0)).count() == 5


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(2, 60), st.integers(0, 20), st.integers(0, 10**6))
def test_cuts_respect_limits(n, capacity, overlap, seed):
    if overlap >= capacity:
        return
    rng = random.Random(seed)
    levels = [sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(0, 12)))) if n > 1 else [] for _ in range(2)]
    ends = [*splitting.balanced_cuts(n, capacity, overlap, levels), n]
    at = 0
    for k, e in enumerate(ends):
        begin = at - overlap if k else 0
        assert e - begin <= capacity and (e > at or n == 0)
        at = e
    assert at == n


def test_splitting(spark, make_nodes):
    text = "".join(f"def f{k}():\n" + "".join(f"    x{j} = 'é{j}'\n" for j in range(30)) + "\n" for k in range(100))
    pieces = splitting.split_bytes(text, 5000, 100)
    data = text.encode()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data) and all(b - a <= 5000 for a, b in pieces)
    assert all(96 < p[1] - q[0] <= 100 for p, q in zip(pieces, pieces[1:]))
    assert all(data[p[1] - 1 : p[1]] == b"\n" for p in pieces[:-1])
    assert sum(data[p[1] :].startswith(b"def ") for p in pieces[:-1]) >= len(pieces) // 2
    assert splitting.split_bytes("", 10, 2) == [(0, 0)]
    one = splitting.split_bytes("é" * 50, 11, 2)
    assert all(b - a <= 11 for a, b in one) and "".join("é" * 50 for _ in [0]).encode()[one[0][0] : one[0][1]].decode()
    lines = ["a"] * 200
    parts = splitting.split_lines(lines, 81, 5)
    assert all(b - a <= 81 for a, b in parts) and all(p[1] - q[0] == 5 for p, q in zip(parts, parts[1:]))
    limits = spark.createDataFrame([("node_span", "lines", 81, 5), ("file_text", "bytes", 5000, 100)], "limit_name string, unit string, capacity int, overlap int")
    n = make_nodes({"id": "big", "start_line": 300, "end_line": 200, "file_path": "r/a.py"}, {"id": "edge", "start_line": 1, "end_line": 81}, {"id": "null", "end_line": None}, {"id": "mod", "kind": "module", "end_line": 999}, {"id": "lost", "end_line": 500, "file_path": "none"})
    files = spark.createDataFrame([("r/a.py", "", "python", len(data), 2), ("r/a.py", "", "python", 1, 1), ("r/n.py", "", "python", None, 1), ("r/e.py", "", "python", 5000, 1)], "path string, content_hash string, language string, size bigint, indexed_at bigint")
    docs = spark.createDataFrame([(1, text, "file", "r/a.py")], "doc_id bigint, text string, source string, path string")
    plan = splitting.plan_items(n, files, limits).where("pieces > 1").select("item_type", "item_key")
    assert sorted(map(tuple, plan.collect())) == [("file", "r/a.py"), ("node", "big"), ("node", "lost")]
    got = splitting.split_items(n, files, limits, docs).collect()
    big = sorted((r.piece, r.begin, r.finish) for r in got if r.item_key == "big")
    assert big[0][1] == 200 and big[-1][2] == 300 and len(big) == 2
    assert {r.content is None for r in got if r.item_key == "lost"} == {True}
    assert {(r.item_type, r.item_key) for r in got if r.piece == 0} == set(map(tuple, plan.collect()))
    unread = splitting.split_items(n, files, limits, docs.limit(0)).collect()  # without texts by numbers alone
    assert {(r.item_type, r.item_key) for r in unread if r.piece == 0} == {("file", "r/a.py"), ("node", "big"), ("node", "lost")} and all(r.content is None and r.finish - r.begin <= 5000 for r in unread)
    assert splitting.split_items(n, files, limits, docs, content=False).where("content is not null").count() == 0
    assert b"".join(r.content.encode()[(100 if r.piece else 0) :] for r in sorted((r for r in got if r.item_type == "file"), key=lambda r: r.piece)).startswith(data[:4000])
