"""JavaScript (script or CommonJS) and TypeScript."""

from __future__ import annotations

import re

import regex

from codeloom.llm.syntax.lexing import END, ID, NUM, RGX, STR, TPL, WORD, Alphabet, Bad, Parser, Tokens, word_coder

_RESERVED = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new null return super switch this throw true false try typeof var void while with"
_SOFT = "let static yield await async of get set as satisfies type interface declare namespace module abstract readonly public private protected override implements keyof infer is asserts unique global accessor out from using"
_OPS = "... => == === != !== <= ++ -- && || ?? ** << ?. += -= *= /= %= **= <<= &= |= ^= &&= ||= ??="
A = Alphabet(f"{_RESERVED} {_SOFT}", _OPS)
K = A.of
SOFT = A.set(_SOFT)
NAMES = SOFT | {ID}
WORDS = NAMES | A.set(_RESERVED)
BINARY = A.set("== === != !== <= && || ?? ** << + - * / % & | ^ < > in instanceof")
ASSIGN = A.set("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=")
UNARY = A.set("! ~ + - typeof void delete")
STEP = A.set("++ --")
MODIFIERS = A.set("static async get set declare abstract readonly public private protected override accessor")
ATOMS = A.set("null true false this super") | {NUM, STR, RGX}
_LITERAL = regex.compile(
    r"""(?P<c>//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*+\*/)
    |(?P<s>'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+'|"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*+")
    |(?P<t>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$(?P<b>\{(?:[^{}`'"]|'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+"|(?P>t)|(?P>b))*+\}))*+`)
    |(?P<lead>(?:[(,=:\[!&|?{};+*%<>~^-]|\breturn|\btypeof|\bcase|^)\s*)(?P<r>/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[dgimsuvy]*)""",
    regex.X | regex.V0,
)
#: The same without templates that have nested holes and without regular expressions: a last `/` or back tick calls for the full pattern.
_PLAIN = re.compile(r"""//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*+\*/|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+'|"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*+"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`'"/\n]*\})*+`|[/`]""")
_SIMPLE_HOLE = re.compile(r"\$\{([^{}]*)\}")
_HOLE = regex.compile(r"\$(?P<b>\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|`(?:[^`\\]|\\.)*+`|(?P>b))*+\})", regex.V0)
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:0|[1-9][\d_]*))n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?")
_ALLOWED = re.compile("[instr(){}\\[\\];,.<>=+\\-*/%&|^!~?:@\ue000-\uf8ff]*")


class _NotPlain(Exception):
    pass


def _plain(m) -> str:
    t = m[0]
    c = t[0]
    if c == "/":
        if len(t) == 1:
            raise _NotPlain
        return "\n" if "\n" in t else " "
    if c == "`":
        if len(t) == 1:
            raise _NotPlain
        holes = _SIMPLE_HOLE.findall(t) if "${" in t else None
        return f"({','.join(holes)})" if holes else "\x02"
    return "\x01"


def _stripped(text: str) -> str:
    try:
        return _PLAIN.sub(_plain, text)
    except _NotPlain:
        return _LITERAL.sub(_literal, text)


def _literal(m) -> str:
    kind = m.lastgroup
    if m["c"] is not None:
        return "\n" if "\n" in m["c"] else " "
    if m["s"] is not None:
        return "\x01"
    if m["r"] is not None:
        return m["lead"] + "\x03"
    holes = [h["b"][1:-1] for h in _HOLE.finditer(m["t"])] if kind and "${" in m["t"] else []
    return f"({','.join(_LITERAL.sub(_literal, h) for h in holes)})" if holes else "\x02"


_word = word_coder(A.words, _NUMBER)


def tokens(text: str) -> Tokens:
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    code = _stripped(text.lstrip("\ufeff"))
    if "`" in code or "'" in code or '"' in code or "/*" in code:
        raise Bad("literal without end")
    code = A.op_pattern.sub(lambda m: A.ops[m[0]], WORD.sub(_word, code))
    code = code.replace("\x01", STR).replace("\x02", TPL).replace("\x03", RGX)
    lines = ["".join(x.split()) for x in code.splitlines()]
    out = Tokens(lines)
    if not _ALLOWED.fullmatch(out.s[:-1]):
        raise Bad("character")
    return out


class Script(Parser):
    memo: dict = {}

    def __init__(self, tokens: Tokens, typed: bool) -> None:
        super().__init__(tokens)
        self.ts = typed
        self.target = False

    # statements

    def program(self) -> None:
        self.statements(END)

    def statements(self, end: str) -> None:
        s = self.s
        while s[self.p] != end:
            if self.p in self.first:
                stop = self.line_end()
                if s[stop - 1] == ";" and self.known(s[self.p : stop]):
                    self.p = stop
                    continue
            self.statement()

    def known(self, line: str) -> bool:
        """A line that is whole statements by itself."""
        key = (line, self.ts)
        found = self.memo.get(key)
        if found is None:
            found = False
            if not (K["if"] in line or K["do"] in line or K["try"] in line or K["else"] in line):
                try:
                    sub = Script(Tokens([line]), self.ts)
                    while sub.s[sub.p] != END:
                        sub.statement()
                    found = True
                except Bad:
                    pass
            if len(self.memo) > self.MEMO_LIMIT:
                self.memo.clear()
            self.memo[key] = found
        return found

    def end(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c != "}" and c != END and not self.line_before():
            self.fail("statement does not end")

    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.p += 1

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        s, c = self.s, self.s[self.p]
        nxt = s[self.p + 1] if c != END else END
        rule = _STATEMENTS.get(c)
        if rule is not None:
            return rule(self)
        if c in SOFT:
            if c == K["let"] and (nxt in NAMES or nxt in "[{"):
                return self.variables()
            if c == K["async"] and nxt == K["function"] and self.p + 1 not in self.first:
                self.p += 1
                return self.function()
            if self.ts and self.typed_statement(c, nxt):
                return None
        if c in NAMES and nxt == ":":
            self.p += 2
            return self.statement()
        self.expression()
        return self.end()

    def typed_statement(self, c: str, nxt: str) -> bool:
        if nxt in WORDS or nxt == STR or nxt == "{":
            if self.p + 1 in self.first:
                return False
            if c == K["interface"] and nxt in NAMES:
                self.p += 1
                self.interface()
                return True
            if c == K["type"] and nxt in NAMES:
                self.p += 2
                self.type_parameters()
                self.need("=")
                self.type()
                self.end()
                return True
            if c in (K["namespace"], K["module"], K["global"]):
                self.p += 1
                if self.s[self.p] != "{":
                    self.p += 1
                    while self.take("."):
                        self.name()
                if self.s[self.p] == "{":
                    self.block()
                else:
                    self.end()
                return True
            if c == K["declare"] and nxt != "{":
                self.p += 1
                self.statement()
                return True
            if c == K["abstract"] and nxt == K["class"]:
                self.p += 1
                self.class_()
                return True
        return False

    def name(self) -> None:
        if self.s[self.p] not in NAMES:
            self.fail("no name")
        self.p += 1

    def word(self) -> None:
        if self.s[self.p] not in WORDS:
            self.fail("no word")
        self.p += 1

    def variables(self, in_for: bool = False) -> None:
        const = self.s[self.p] == K["const"]
        self.p += 1
        if self.ts and const and self.s[self.p] == K["enum"]:
            return self.enum()
        while True:
            pattern = self.s[self.p] in "[{"
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment(not in_for)
            elif (const or pattern) and not in_for and not self.ts:
                self.fail("no value")
            elif (const or pattern) and not in_for and self.s[self.p] not in ";},\0" and not self.line_before():
                self.fail("no value")
            if not self.take(","):
                break
        if not in_for:
            self.end()
        return None

    def binding(self) -> None:
        c = self.s[self.p]
        if c in NAMES:
            self.p += 1
        elif c == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take(K["..."])
                self.binding()
                if self.take("="):
                    self.assignment()
                if self.s[self.p] != "]":
                    self.need(",")
        elif c == "{":
            self.p += 1
            while not self.take("}"):
                if self.take(K["..."]):
                    self.binding()
                else:
                    plain = self.s[self.p] in NAMES
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        self.fail("binding")
                    if self.take("="):
                        self.assignment()
                if self.s[self.p] != "}":
                    self.need(",")
        else:
            self.fail("no binding")

    def property_name(self) -> None:
        c = self.s[self.p]
        if c in WORDS or c == STR or c == NUM:
            self.p += 1
        elif c == "[":
            self.p += 1
            self.assignment()
            self.need("]")
        else:
            self.fail("no property name")

    def function(self, named: bool = True) -> None:
        self.p += 1
        self.take("*")
        if self.s[self.p] in NAMES:
            self.p += 1
        elif named:
            self.fail("no name")
        self.signature()
        if self.ts and named and self.s[self.p] != "{":
            self.end()
        else:
            self.block()

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.decorators()
            if self.ts:
                while self.s[self.p] in MODIFIERS and self.s[self.p + 1] in _BINDINGS:
                    self.p += 1
            self.take(K["..."])
            if self.ts and self.s[self.p] == K["this"]:
                self.p += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            if self.s[self.p] != ")":
                self.need(",")

    def decorators(self) -> None:
        while self.take("@"):
            if self.s[self.p] == "(":
                self.parens()
            else:
                self.name()
                while self.take("."):
                    self.word()
                if self.s[self.p] == "(":
                    self.arguments()

    def decorated(self) -> None:
        self.decorators()
        self.statement()

    def class_(self, named: bool = True) -> None:
        self.p += 1
        if self.s[self.p] in NAMES and self.s[self.p] != K["implements"]:
            self.p += 1
        elif named:
            self.fail("no name")
        self.type_parameters()
        if self.take(K["extends"]):
            self.unary()
            if self.ts and self.s[self.p] == "<":
                self.type_arguments()
        if self.ts and self.take(K["implements"]):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        s = self.s
        self.decorators()
        if s[self.p] == K["static"] and s[self.p + 1] == "{":
            self.p += 1
            return self.block()
        while s[self.p] in MODIFIERS and s[self.p + 1] not in "(=;:,}?!<" and not (self.p + 1 in self.first and s[self.p] != K["static"] and not self.ts):
            if not self.ts and s[self.p] not in _JS_MODIFIERS:
                self.fail("modifier")
            self.p += 1
        self.take("*")
        if self.ts and s[self.p] == "[" and s[self.p + 1] in NAMES and s[self.p + 2] == ":":
            self.index_signature()
            return self.end()
        self.property_name()
        if self.ts and s[self.p] in "?!":
            self.p += 1
        if s[self.p] in "(<":
            self.signature()
            if self.ts and s[self.p] != "{":
                return self.end()
            return self.block()
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        return self.end()

    def interface(self) -> None:
        self.name()
        self.type_parameters()
        if self.take(K["extends"]):
            self.type()
            while self.take(","):
                self.type()
        self.object_type()

    def enum(self) -> None:
        if not self.ts:
            self.fail("enum")
        self.p += 1
        self.name()
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assignment()
            if self.s[self.p] != "}":
                self.need(",")

    def if_(self) -> None:
        self.p += 1
        self.parens()
        self.statement()
        if self.take(K["else"]):
            self.statement()

    def for_(self) -> None:
        self.p += 1
        self.take(K["await"])
        self.need("(")
        c = self.s[self.p]
        if c in (K["var"], K["const"]) or c == K["let"]:
            self.variables(True)
        elif c != ";":
            self.expression(False)
        if self.s[self.p] in (K["of"], K["in"]):
            self.p += 1
            self.expression()
        else:
            self.need(";")
            if self.s[self.p] != ";":
                self.expression()
            self.need(";")
            if self.s[self.p] != ")":
                self.expression()
        self.need(")")
        self.statement()

    def while_(self) -> None:
        self.p += 1
        self.parens()
        self.statement()

    def do_(self) -> None:
        self.p += 1
        self.statement()
        self.need(K["while"])
        self.parens()
        self.take(";")

    def switch(self) -> None:
        self.p += 1
        self.parens()
        self.need("{")
        while not self.take("}"):
            if self.take(K["case"]):
                self.expression()
            else:
                self.need(K["default"])
            self.need(":")
            while self.s[self.p] not in _CASE_ENDS:
                self.statement()

    def jump(self) -> None:
        self.p += 1
        if self.s[self.p] in NAMES and not self.line_before():
            self.p += 1
        self.end()

    def return_(self) -> None:
        self.p += 1
        if self.s[self.p] not in ";}\0" and not self.line_before():
            self.expression()
        self.end()

    def throw(self) -> None:
        self.p += 1
        self.expression()
        self.end()

    def try_(self) -> None:
        self.p += 1
        self.block()
        ok = False
        if self.take(K["catch"]):
            ok = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take(K["finally"]):
            ok = True
            self.block()
        if not ok:
            self.fail("try alone")

    def import_(self) -> None:
        nxt = self.s[self.p + 1]
        if nxt in "(.":
            self.expression()
            return self.end()
        if not self.ts:
            self.fail("import in a script")
        self.p += 1
        if self.take(STR):
            return self.end()
        if self.s[self.p] == K["type"] and self.s[self.p + 1] not in (K["from"], "=", ","):
            self.p += 1
        if self.s[self.p] in NAMES:
            self.p += 1
            if self.take("="):
                self.expression()
                return self.end()
            if self.s[self.p] != K["from"]:
                self.need(",")
        if self.take("*"):
            self.need(K["as"])
            self.name()
        elif self.s[self.p] == "{":
            self.specifiers()
        self.need(K["from"])
        self.need(STR)
        self.attributes()
        return self.end()

    def attributes(self) -> None:
        if self.s[self.p] == K["with"]:
            self.p += 1
            self.object_literal()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.s[self.p] == K["type"] and self.s[self.p + 1] in WORDS and self.s[self.p + 1] != K["as"]:
                self.p += 1
            if not self.take(STR):
                self.word()
            if self.take(K["as"]) and not self.take(STR):
                self.word()
            if self.s[self.p] != "}":
                self.need(",")

    def export(self) -> None:
        if not self.ts:
            self.fail("export in a script")
        self.p += 1
        c, nxt = self.s[self.p], self.s[self.p + 1]
        if c == K["default"]:
            self.p += 1
            c, nxt = self.s[self.p], self.s[self.p + 1]
            if c == K["function"] or c == K["async"] and nxt == K["function"]:
                self.take(K["async"])
                return self.function(False)
            if c == K["class"] or c == K["abstract"]:
                self.take(K["abstract"])
                return self.class_(False)
            if c == K["interface"]:
                self.p += 1
                return self.interface()
            self.assignment()
            return self.end()
        if c == "=":
            self.p += 1
            self.expression()
            return self.end()
        if c == K["type"] and nxt in "{*":
            self.p += 1
            c = self.s[self.p]
        if c == "*":
            self.p += 1
            if self.take(K["as"]):
                self.word()
            self.need(K["from"])
            self.need(STR)
            return self.end()
        if c == "{":
            self.specifiers()
            if self.take(K["from"]):
                self.need(STR)
                self.attributes()
            return self.end()
        if c == "@" or c in WORDS and (c in _DECLARES or c in SOFT):
            return self.statement()
        return self.fail("export")

    def debugger(self) -> None:
        self.p += 1
        self.end()

    def empty(self) -> None:
        self.p += 1

    # expressions

    def expression(self, with_in: bool = True) -> None:
        self.assignment(with_in)
        while self.take(","):
            self.assignment(with_in)

    def arrow_ahead(self) -> bool:
        """At `(` or `<`: is this an arrow function?"""
        s = self.s
        if s[self.p] == "(":
            after = self.closing[self.p] + 1
            if s[after] == K["=>"]:
                return True
            if not self.ts or s[after] != ":":
                return False
        at = self.p
        try:
            self.signature()
            return s[self.p] == K["=>"]
        except Bad:
            return False
        finally:
            self.p = at

    def arrow_body(self) -> None:
        self.need(K["=>"])
        if self.s[self.p] == "{":
            self.block()
        else:
            self.assignment()
        self.target = False

    def assignment(self, with_in: bool = True) -> None:
        s, c = self.s, self.s[self.p]
        if c == K["async"] and s[self.p + 1] in _ASYNC_NEXT and self.p + 1 not in self.first:
            self.p += 1
            if s[self.p] in NAMES and s[self.p + 1] == K["=>"]:
                self.p += 1
                return self.arrow_body()
            if s[self.p] in "(<" and self.arrow_ahead():
                self.signature()
                return self.arrow_body()
            self.p -= 1
        elif c in NAMES and s[self.p + 1] == K["=>"]:
            self.p += 1
            return self.arrow_body()
        elif c == "(" or c == "<" and self.ts:
            if self.arrow_ahead():
                self.signature()
                return self.arrow_body()
        if c == K["yield"] and s[self.p + 1] not in "=.":
            self.p += 1
            if s[self.p] not in ")]};,:\0" and not self.line_before():
                self.take("*")
                self.assignment(with_in)
            return None
        self.unary()
        while True:
            c = s[self.p]
            if c in BINARY:
                if c == K["in"] and not with_in:
                    return None
                self.p += 1
                if c == ">":  # `>` stands alone, as it also closes type arguments
                    at = self.p
                    while s[self.p] == ">":
                        self.p += 1
                    if self.take("=") and self.p - at > 1:
                        return self.assignment(with_in)
                self.unary()
                self.target = False
            elif self.ts and c in _CASTS and not self.line_before():
                self.p += 1
                if not self.take(K["const"]):
                    self.type()
                self.target = True
            else:
                break
        if c == "?":
            self.p += 1
            self.assignment()
            self.need(":")
            self.assignment(with_in)
            self.target = False
        elif c in ASSIGN:
            if not self.target:
                self.fail("not assignable")
            self.p += 1
            self.assignment(with_in)
            self.target = False
        return None

    def unary(self) -> None:
        s = self.s
        c = s[self.p]
        if c in UNARY:
            self.p += 1
            self.unary()
            self.target = False
            return
        if c in STEP:
            self.p += 1
            self.unary()
            if not self.target:
                self.fail("step")
            self.target = False
            return
        if c == K["await"] and (s[self.p + 1] in WORDS or s[self.p + 1] in "([{nst!" or s[self.p + 1] == K["new"]) and self.p + 1 not in self.first:
            self.p += 1
            self.unary()
            self.target = False
            return
        if c == "<" and self.ts:
            self.p += 1
            self.type()
            self.close_angle()
            self.unary()
            return
        self.primary()
        self.postfix()
        if s[self.p] in STEP and not self.line_before():
            if not self.target:
                self.fail("step")
            self.p += 1
            self.target = False

    def primary(self) -> None:
        s, c = self.s, self.s[self.p]
        if c == ID:
            self.p += 1
            self.target = True
        elif c in ATOMS or c == TPL:
            self.p += 1
            self.target = False
        elif c == "(":
            self.p += 1
            self.expression()
            self.need(")")
        elif c == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take(K["..."])
                self.assignment()
                if s[self.p] != "]":
                    self.need(",")
            self.target = True
        elif c == "{":
            self.object_literal()
            self.target = True
        elif c == K["function"]:
            self.function(False)
            self.target = False
        elif c == K["async"] and s[self.p + 1] == K["function"]:
            self.p += 1
            self.function(False)
            self.target = False
        elif c == K["class"]:
            self.class_(False)
            self.target = False
        elif c == "@":
            self.decorators()
            self.class_(False)
        elif c == K["new"]:
            self.p += 1
            if self.take("."):
                self.word()
            else:
                if s[self.p] == K["import"]:
                    self.fail("new import")
                self.primary()
                self.postfix(False)
                if self.ts and s[self.p] == "<":
                    self.attempt(self.type_arguments)
                if s[self.p] == "(":
                    self.arguments()
            self.target = False
        elif c == K["import"]:
            self.p += 1
            if self.take("."):
                self.word()
            else:
                self.arguments()
            self.target = False
        elif c in SOFT:
            self.p += 1
            self.target = True
        else:
            self.fail("no expression")

    def object_literal(self) -> None:
        s = self.s
        self.need("{")
        while not self.take("}"):
            if self.take(K["..."]):
                self.assignment()
            else:
                while s[self.p] in _PREFIX and s[self.p + 1] not in "(:,}=<":
                    self.p += 1
                self.take("*")
                plain = s[self.p] in NAMES
                self.property_name()
                if self.take(":"):
                    self.assignment()
                elif s[self.p] in "(<":
                    self.signature()
                    self.block()
                elif not plain:
                    self.fail("property")
                elif self.take("="):
                    self.assignment()
            if s[self.p] != "}":
                self.need(",")

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take(K["..."])
            self.assignment()
            if self.s[self.p] != ")":
                self.need(",")

    def postfix(self, calls: bool = True) -> None:
        s = self.s
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                self.word()
                self.target = True
            elif c == "[":
                self.p += 1
                self.expression()
                self.need("]")
                self.target = True
            elif c == "(" and calls:
                self.arguments()
                self.target = False
            elif c == K["?."] and calls:
                self.p += 1
                if s[self.p] == "(":
                    self.arguments()
                elif s[self.p] == "[":
                    continue
                else:
                    self.word()
                self.target = False
            elif c == TPL:
                self.p += 1
                self.target = False
            elif self.ts and c == "!" and not self.line_before():
                self.p += 1
            elif self.ts and c == "<" and calls and self.attempt(self.call_types):
                self.target = False
            else:
                return

    def call_types(self) -> None:
        self.type_arguments()
        c = self.s[self.p]
        if not (c in "()],.;:}?t\0" or c == K["?."] or self.line_before()):
            self.fail("type arguments")

    # types

    def type_parameters(self) -> None:
        if not self.ts or self.s[self.p] != "<":
            return
        self.p += 1
        while self.s[self.p] != ">":
            while self.s[self.p] in _VARIANCE and self.s[self.p + 1] in NAMES:
                self.p += 1
            self.name()
            if self.take(K["extends"]):
                self.type()
            if self.take("="):
                self.type()
            if self.s[self.p] != ">":
                self.need(",")
        self.p += 1

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.close_angle()

    def close_angle(self) -> None:
        self.need(">")

    def return_type(self) -> None:
        s = self.s
        if s[self.p] == K["asserts"] and s[self.p + 1] in _THIS_OR_NAME and self.p + 1 not in self.first:
            self.p += 2
            if self.take(K["is"]):
                self.type()
        elif s[self.p] in _THIS_OR_NAME and s[self.p + 1] == K["is"]:
            self.p += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        s = self.s
        c = s[self.p]
        if c == K["new"] or c == K["abstract"] and s[self.p + 1] == K["new"]:
            self.take(K["abstract"])
            self.p += 1
            return self.function_type()
        if c == "<" or c == "(" and s[self.closing[self.p] + 1] == K["=>"]:
            return self.function_type()
        self.union()
        if s[self.p] == K["extends"] and not self.line_before():
            self.p += 1
            self.type()
            if self.take("?"):
                self.type()
                self.need(":")
                self.type()
        return None

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need(K["=>"])
        self.return_type()

    def union(self) -> None:
        if self.s[self.p] in "|&":
            self.p += 1
        self.type_operand()
        while self.s[self.p] in "|&":
            self.p += 1
            self.type_operand()

    def type_operand(self) -> None:
        s = self.s
        while s[self.p] in _TYPE_PREFIX and (s[self.p + 1] in WORDS or s[self.p + 1] in "{([st"):
            self.p += 1
        c = s[self.p]
        if c == K["typeof"] or c == K["import"]:
            self.p += 1
            if s[self.p] == "(":
                self.arguments()
            else:
                self.word()
                if c == K["typeof"] and s[self.p - 1] == K["import"]:
                    self.arguments()
            while self.take("."):
                self.word()
            if s[self.p] == "<" and not self.line_before():
                self.type_arguments()
        elif c in NAMES or c in (K["this"], K["void"], K["null"], K["true"], K["false"], K["const"]):
            self.p += 1
            while s[self.p] == ".":
                self.p += 1
                self.word()
            if s[self.p] == "<" and not self.line_before():
                self.type_arguments()
        elif c in (STR, NUM, TPL):
            self.p += 1
        elif c == "-":
            self.p += 1
            self.need(NUM)
        elif c == "(":
            end = self.closing[self.p]
            if s[end + 1] == K["=>"]:
                return self.function_type()
            self.p += 1
            if s[self.p] != ")":  # a template with holes leaves its expressions in brackets
                at = self.p
                try:
                    self.type()
                    self.need(")")
                except Bad:
                    self.p = at
                    self.expression()
                    self.need(")")
            else:
                self.fail("type")
        elif c == "[":
            self.p += 1
            while not self.take("]"):
                self.take(K["..."])
                if s[self.p] in NAMES and (s[self.p + 1] == ":" or s[self.p + 1] == "?" and s[self.p + 2] == ":"):
                    self.p += 1
                    self.take("?")
                    self.p += 1
                self.type()
                self.take("?")
                if s[self.p] != "]":
                    self.need(",")
        elif c == "{":
            self.object_type()
        else:
            self.fail("no type")
        while s[self.p] == "[" and not self.line_before():
            self.p += 1
            if not self.take("]"):
                self.type()
                self.need("]")
        return None

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        if self.take(":"):
            self.type()

    def object_type(self) -> None:
        s = self.s
        self.need("{")
        while not self.take("}"):
            if s[self.p] in ";,":
                self.p += 1
                continue
            if s[self.p] in "+-":
                self.p += 1
            while s[self.p] in MODIFIERS and s[self.p + 1] not in "(:?<;,}" and self.p + 1 not in self.first:
                self.p += 1
            c = s[self.p]
            if c == K["new"] and s[self.p + 1] in "(<":
                self.p += 1
                c = s[self.p]
            if c in "(<":
                self.signature()
            elif c == "[" and s[self.p + 1] in NAMES and s[self.p + 2] == K["in"]:
                self.p += 3
                self.type()
                if self.take(K["as"]):
                    self.type()
                self.need("]")
                if s[self.p] in "+-":
                    self.p += 1
                self.take("?")
                if self.take(":"):
                    self.type()
            elif c == "[" and s[self.p + 1] in NAMES and s[self.p + 2] == ":":
                self.index_signature()
            else:
                self.property_name()
                self.take("?")
                if s[self.p] in "(<":
                    self.signature()
                elif self.take(":"):
                    self.type()
            if s[self.p] not in ";,}" and not self.line_before():
                self.fail("member")


_ASYNC_NEXT = NAMES | {"(", "<"}
_BINDINGS = NAMES | {"{", "["}
_THIS_OR_NAME = NAMES | {K["this"]}
_JS_MODIFIERS = A.set("static async get set accessor")
_CASE_ENDS = A.set("case default }")
_CASTS = A.set("as satisfies")
_PREFIX = A.set("async get set")
_VARIANCE = A.set("in out const")
_TYPE_PREFIX = A.set("keyof readonly unique infer")
_DECLARES = A.set("var let const function class enum import async abstract declare interface type namespace module")
_STATEMENTS = {
    "{": Script.block,
    ";": Script.empty,
    "@": Script.decorated,
    K["var"]: Script.variables,
    K["const"]: Script.variables,
    K["function"]: Script.function,
    K["class"]: Script.class_,
    K["if"]: Script.if_,
    K["for"]: Script.for_,
    K["while"]: Script.while_,
    K["with"]: Script.while_,
    K["do"]: Script.do_,
    K["switch"]: Script.switch,
    K["break"]: Script.jump,
    K["continue"]: Script.jump,
    K["return"]: Script.return_,
    K["throw"]: Script.throw,
    K["try"]: Script.try_,
    K["import"]: Script.import_,
    K["export"]: Script.export,
    K["debugger"]: Script.debugger,
    K["enum"]: Script.enum,
}


#: Beginnings that no script has; most texts of other languages end here, before they are cut into tokens.
_NOT_FIRST = re.compile(r"\ufeff*(?:\s+|//[^\n]*|/\*(?s:.*?)\*/)*+(?:package\s+\w|#(?!!)\s|\"\"\"|'''|from\s+[\w.]+\s+import\b|import\s+\w+(?:\.|\s+as\b)|def\s+\w)")
_last: tuple[str, Tokens | Bad] = ("", Bad("none"))


def _tokens_of(text: str) -> Tokens:
    """Tokens of a text, or why it has none, kept for the other of the two languages."""
    global _last
    if _last[0] is not text:
        try:
            if _NOT_FIRST.match(text):
                raise Bad("beginning")
            _last = (text, tokens(text))
        except Bad as e:
            _last = (text, e)
    if isinstance(_last[1], Bad):
        raise _last[1].with_traceback(None)
    return _last[1]


def check_javascript(text: str) -> None:
    Script(_tokens_of(text), False).program()


def check_typescript(text: str) -> None:
    Script(_tokens_of(text), True).program()
