"""Grammar checks and the judging of files."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import invalid_files
from codeloom.llm.syntax import diagnose, judge, rank, readings, valid

GOOD = {
    "javascript": [
        "const {a, b: [c]} = require('x'); module.exports = {a, ...b, get c() { return 1; }, async *d() {}, ['e']: 1};",
        "label: for (const x of y) { if (!x) continue label; }",
        "let r = /a[/]b/g.test(s) ? a / b / c : `x${y ? `in${z}` : '}'}`;",
        "var f = async (a, {b}, ...c) => { await a; }, g = x => ({x});",
        "class A extends B { static #p = 1; static { this.x = 1 } get y() { return this.#p } async *gen() {} 'q'() {} }",
        "do { x++ } while (x < 5)\nswitch (a) { case 1: default: break }\ntry { throw 1 } catch { } finally {}",
        "a ??= b; a?.b?.[c]?.(d)\nfor (;;) {}\nreturn a",
        "", "#!/usr/bin/env node\nfoo()", "a\n++b", "// only\n/* comments */",
    ],
    "typescript": [
        "import a, {b as c, type D} from 'x'; export default class<T> {}",
        "export type X<T> = T extends (infer U)[] ? {[K in keyof U]?: U[K]} : never | `a${string}`;",
        "interface A<T = {}> extends B, C<D> { (x: number): string; readonly [k: string]: any; m<T>(): void; p?: [a: string, ...b: number[]] }",
        "abstract class Q<T> implements I { constructor(private readonly x: string, public y = 3) { super(); } abstract m(): void; @dec() w = 1; }",
        "const f = async <T,>(x: T): Promise<T> => x as unknown as T; let g = foo<string>(1); if (a < b && c > d) {}",
        "let t: A<B<C>> = x satisfies Y; a >>= 2; a >>>= 3; let u: A<B>= 3;",
    ],
    "java": [
        'package a.b; import static c.D.*; @Ann(x = 1) public final class A<T extends B & C> { static { } A(int... xs) throws X { this(); } int x[] = {1, 2}; enum E { A(1), B; } record R(int a) { } }',
        "class A { void g() { for (int i = 0, j = 1; i < j; i++, j--) {} int y = switch (k) { case 1, 2 -> 3; default -> { yield 5; } }; Runnable r = () -> {}; f = A::new; try (var in = open()) { } catch (A | B e) { } a.<B>c(); x >>>= 2; } }",
    ],
    "go": [
        "package main\nimport (\n\t\"fmt\"\n)\ntype T[K comparable, V any] struct { a, b int `tag`; *E }\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n for k, v := range m { }\n switch y := x.(type) { case int, string: default: }\n p := &T{A: 1, B: []int{1, 2}}\n go func() { }()\n s[1:2:3] = x[:]\n return }\n",
    ],
    "python": ["def f(a, /, *, b: int = 1) -> str:\n    return f'{a!r}'\n", "return 1\n", ""],
    "json": ['{"a": [1, -2.5e3, null, "\\u00e9"]}', "1"],
}
BAD = {
    "javascript": ["let x: number = 1", "x = = 2", "function () {}", "if (a {", "a b", "const x;", "class A { foo: string }", "var 1a", "`abc", "foo(,)", "1 = 2", "<<<<<<< HEAD\na\n=======\n", "import x from 'y'"],
    "typescript": ["let x: = 1", "interface A { a b }", "type A", "function f(a: ) {}", "class { }", "const a = (", "def f():\n    pass"],
    "java": ["class A { int x }", "class A { void f() { x + 1; } }", "class A { void f( { } }", "int x = 1;", "class A { void f() { foo(,); } }", "package a.b"],
    "go": ["func f() {}", "package a\nx := 1", "package a\nfunc f() { x = = 1 }", "package a\nfunc f() { if x \n{ } }", "package a;\nclass A {}"],
    "python": ["def f(:\n pass", "def f():\n", "x = = 1", "def f():\n'''open"],
    "json": ["{a: 1}", "[1,]", "", '{"a": NaN}', "// x\n{}", "{} {}"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_and_invalid(language):
    assert [x for x in GOOD[language] if not valid(x, language)] == []
    assert [x for x in BAD[language] if valid(x, language)] == []


def test_truncation_is_found():
    for language, texts in GOOD.items():
        for t in texts:
            if len(t) > 60 and language not in ("python", "json"):
                assert valid(t, language)
                assert not valid(t + " (", language) and not valid("} " + t, language)


def test_other_grammars():
    assert valid("x", "cobol") is None
    assert diagnose("def f():\n    return 1\n", "java") == (False, "python")
    assert diagnose("package a\n\nfunc F() {}\n", "javascript") == (False, "go")
    assert diagnose("%% ((", "go") == (False, None)
    assert rank("def f(self):\n    pass")[0] == "python"


def test_depth_is_no_fault():
    assert valid("[" * 30_000 + "]" * 30_000, "json") is True
    assert valid('{"a":' * 20_000 + "1" + "}" * 20_000, "json") is True
    assert valid("[" * 30_000 + "]" * 29_999, "json") is False
    assert valid("x = " + "(" * 6000 + "1" + ")" * 6000 + ";", "javascript") is True
    assert valid("x = " + "(" * 6000 + "1 +" + ")" * 6000 + ";", "javascript") is False
    assert valid("(" * 300 + "1" + ")" * 300, "python") is None  # the interpreter's own limit


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet='[]{}",:1-.e0tn \\u', max_size=12), st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8).map(json.dumps)))
def test_deep_json_equals_the_parser(text):
    def takes(check):
        try:
            check(text)
            return True
        except ValueError:
            return False

    assert takes(judge.check_deep_json) == takes(judge.check_json)


def test_faults_and_readings(monkeypatch):
    assert readings("x = 1\n")[0][:1] != [] and set(readings("x = 1\n")[0]) == {"python", "javascript", "typescript"}
    assert readings("%% ((") == ([], [])
    assert set(readings("")[0]) == {"python", "javascript", "typescript", "java"}

    def broken(text):
        raise IndexError

    monkeypatch.setitem(judge.GRAMMARS, "go", broken)
    assert valid("package a", "go") is None
    assert diagnose("package a", "go") == (None, None)


DOC = "doc_id bigint, text string, source string, path string"
FILE = "path string, content_hash string, language string, size bigint, indexed_at bigint"


def test_judge_files(spark):
    docs = spark.createDataFrame(
        [
            (1, "x = 1\n", "file", "r/a.py"), (2, "x = = 1\n", "file", "r/b.py"), (3, "def f(): pass", "file", "r/c.js"), (4, None, "file", "r/d.py"), (5, "x = = 1", "chat", None),
            (6, "let x: number = 1;", "file", "r/e.js"), (7, "", "file", "r/f.json"), (8, "x = = 1\n", "file", "r/b.py"), (9, "a = (" + "1 + " * 50000 + "1)", "file", "r/long.py"), (10, "q", "file", "r/unlisted.py"), (11, "any", "file", "r/g.xyz"),
        ],
        DOC,
    ).withColumn("guess", F.lit("clash")).withColumn("valid", F.lit(7)).withColumn("language", F.lit("clash"))
    files = spark.createDataFrame(
        [("r/a.py", "", "python", 1, 1), ("r/b.py", "", "java", 1, 1), ("r/b.py", "", "python", 1, 2), ("r/c.js", "", "javascript", 1, 1), ("r/d.py", "", "python", 1, 1), ("r/e.js", "", "typescript", None, 1), ("r/f.json", "", "json", 0, 1), ("r/long.py", "", "python", 1, 1), ("r/g.xyz", "", "xyz", 1, 1), (None, None, None, None, None)],
        FILE,
    )
    got = {r.path: (r.language, r.valid, r.other) for r in invalid_files.judge_files(docs, files).collect()}
    assert got["r/a.py"][1] and got["r/e.js"][:2] == ("typescript", True) and got["r/long.py"][1]
    assert got["r/b.py"] == ("python", False, None) and got["r/c.js"][1:] == (False, "python")
    assert got["r/f.json"][1] is False and got["r/g.xyz"][1] is None
    assert "r/d.py" not in got and "r/unlisted.py" not in got
    rates = {(r.repo, r.language): (r.files, r.invalid, r.wrong_extension) for r in invalid_files.invalid_rates(invalid_files.judge_files(docs, files)).collect()}
    assert rates["r", "javascript"] == (1, 1, 1) and rates["r", "python"] == (3, 1, 0)
    assert invalid_files.judge_files(docs.limit(0), files).count() == 0
